"""Personal data in DataFrame functions: direct identifiers, and terms that give them away.

Four kinds of identifiers (email, ip, card, phone) are found by pattern and checked. Their values are the protected
entities. Terms near a mention of an entity may reveal it: corpus co-occurrence estimates how much. A term t that stands
co times near entity e and n times in the whole corpus tells the share ``1 - log2(n / co) / log2(N / slots)`` of the
information e has, with N terms in the corpus and ``slots`` of them near mentions of e (pointwise mutual information over
information content: 1 if t stands nowhere else, 0 if near e as often as anywhere). Terms seen near the entity at least
``support`` times that tell ``generalise`` or more are replaced by a general class, from ``remove`` on they go, wherever
they stand in the corpus, near a mention or not; of the entities a term tells about the one it tells most of counts.

Null texts are empty. Documents are told apart by id and text; repeated rows get equal results. Offsets count code points,
ends are exclusive. All counts cover all rows; the only window is that of the terms around a mention, for estimating.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiregrain.llm.quality import let
from wiregrain.llm.rows import require, text_key
from wiregrain.session import Scratch

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
_LOCAL = "[A-Za-z0-9._%+-]"
#: The kinds' patterns, written so that a long run of characters is scanned once: a match that starts inside a run
#: would start at its first character, or where the match before it ended. Runs of digits that hold fewer than
#: thirteen can not be a card.
_PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a value must contain to be searched for at all.
_HINTS = {"email": "@", "phone": "+"}
_SPAN = "array<struct<start:int,end:int,value:string>>"
_TERM_PATTERN = r"[\p{L}\p{N}]+"
#: Characters on each side of a mention in which its terms are looked for, and how many terms count on a side.
CONTEXT_CHARS = 120
CONTEXT_TERMS = 5
#: Characters of a piece of text from which contexts are cut, more than a context has.
_PIECE = 1024
#: Stretches of identifiers, of five characters at least, that can begin or end in a context, and one that reaches into it.
_NEAR = CONTEXT_CHARS // 5 + 2


def matches(text: Column, pattern: str) -> Column:
    """Spans (start, end, value) of the leftmost non-overlapping matches."""

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(F.length(g).alias("gap"), F.length(v).alias("size"), v.alias("value")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

        def step(acc: Column, s: Column) -> Column:
            begin = acc["at"] + s["gap"]
            end = begin + s["size"]
            return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(begin.alias("start"), end.alias("end"), s["value"].alias("value"))).alias("spans"))

        return F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(F.aggregate(steps, start, step, lambda acc: acc["spans"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: let(
            F.substring(digits, n - i + 1, F.lit(1)).cast("int"),
            lambda d: F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d),
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.when(F.length(digits) <= 19, _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(kind: str, text: Column) -> Column:
    """Valid spans of one kind."""
    found = matches(text, _PATTERNS[kind])
    if kind in _HINTS:
        found = F.when(F.contains(text, F.lit(_HINTS[kind])), found).otherwise(F.array().cast(_SPAN))
    return found if kind == "email" else F.filter(found, lambda s: _valid(kind, s["value"]))


def with_base(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, crc, text) and the spans of each kind; null texts are empty."""
    rows = require(docs, key, text).select(F.col(f"`{key}`").alias("key"), text_key(text).alias("crc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.select("*", *[base_spans(k, F.col("text")).alias(k) for k in KINDS])


def _tagged(spans: Column, tag: Callable[[Column, str], Column], kind: str) -> Column:
    """Start and end of spans, and what ``tag`` makes of a span and its kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tag(s, kind)))


def _covers(spans: Column) -> Column:
    """Disjoint stretches (start, end, members) of sorted spans; spans that overlap are one stretch."""
    kind = "array<struct<start:int,end:int,entity:string>>"
    nothing = F.struct(
        F.array().cast(f"array<struct<start:int,end:int,members:{kind}>>").alias("done"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.array().cast(kind).alias("members")
    )
    closed = lambda acc: F.when(
        F.size(acc["members"]) > 0, F.array_append(acc["done"], F.struct(acc["start"].alias("start"), acc["end"].alias("end"), acc["members"].alias("members")))
    ).otherwise(acc["done"])

    def step(acc: Column, m: Column) -> Column:
        inside = m["start"] < acc["end"]
        return F.struct(
            F.when(inside, acc["done"]).otherwise(closed(acc)).alias("done"),
            F.when(inside, acc["start"]).otherwise(m["start"]).alias("start"),
            F.greatest(F.when(inside, acc["end"]).otherwise(F.lit(0)), m["end"]).alias("end"),
            F.when(inside, F.array_append(acc["members"], m)).otherwise(F.array(m)).alias("members"),
        )

    return F.aggregate(spans, nothing, step, closed)


def _contexts(rows: DataFrame) -> DataFrame:
    """(key, crc, entity, terms): the terms (term, start, end) on both sides of every mention of an identifier.

    A mention takes its context out of the one or two pieces of the text around it, and compares terms with the
    stretches of identifiers next to its own, so the work grows with the text and its mentions, not with their product.
    """
    mention = F.concat(*[_tagged(F.col(k), lambda s, kind: F.concat(F.lit(f"{kind}:"), F.lower(s["value"])).alias("entity"), k) for k in KINDS])
    rows = rows.select("key", "crc", "text", F.sort_array(mention).alias("mentions")).filter(F.size("mentions") > 0)

    def surrounded(pieces: Column, covers: Column, length: Column) -> Column:
        def cut_out(at: Column, size: Column) -> Column:
            piece = F.floor(at / _PIECE).cast("int")
            both = F.concat(F.coalesce(F.get(pieces, piece), F.lit("")), F.coalesce(F.get(pieces, piece + 1), F.lit("")))
            return F.substring(both, at - piece * _PIECE + 1, size)

        def context(m: Column, near: Column) -> Column:
            first = F.greatest(m["start"] - CONTEXT_CHARS, F.lit(0))
            return F.struct(
                m["entity"].alias("entity"),
                m["end"].alias("end"),
                first.alias("left_at"),
                cut_out(first, m["start"] - first).alias("left"),
                cut_out(m["end"], F.lit(CONTEXT_CHARS)).alias("right"),
                (m["end"] + CONTEXT_CHARS < length).alias("cut"),
                near.alias("near"),
            )

        bounds = F.transform(covers, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
        return let(
            bounds,
            lambda all_: F.flatten(
                F.transform(
                    covers,
                    lambda c, i: let(F.slice(all_, F.greatest(i - _NEAR + 1, F.lit(1)), 2 * _NEAR + 1), lambda near: F.transform(c["members"], lambda m: context(m, near))),
                )
            ),
        )

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    found = let(pieces, lambda p: let(_covers(F.col("mentions")), lambda c: let(F.length("text"), lambda n: surrounded(p, c, n))))
    rows = rows.select("key", "crc", F.inline(found))
    placed = lambda spans, by: F.transform(
        spans, lambda s: F.struct(F.lower(s["value"]).alias("term"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"))
    )
    # A term that the window cuts is not a term of the text.
    before = let(matches(F.col("left"), _TERM_PATTERN), lambda t: F.filter(t, lambda s: (s["start"] > 0) | (F.col("left_at") == 0)))
    after = F.filter(matches(F.col("right"), _TERM_PATTERN), lambda s: (s["end"] < CONTEXT_CHARS) | ~F.col("cut"))
    free = lambda t: (F.length(t["term"]) >= 3) & ~F.exists("near", lambda m: (m["start"] < t["end"]) & (m["end"] > t["start"]))
    left = let(F.filter(placed(before, F.col("left_at")), free), lambda t: F.slice(t, F.greatest(F.size(t) - CONTEXT_TERMS + 1, F.lit(1)), CONTEXT_TERMS))
    right = F.slice(F.filter(placed(after, F.col("end")), free), 1, CONTEXT_TERMS)
    return rows.select("key", "crc", "entity", F.concat(left, right).alias("terms"))


def _term_counts(docs: DataFrame, text: str) -> DataFrame:
    """(h, n): how often each term, by its hash, stands in the corpus; the row with h null holds the sum.

    Counts are combined in each task before they are shuffled.
    """
    terms = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = let(
        F.transform(terms, lambda w: F.struct(F.xxhash64(w).alias("h"), F.lit(1).cast("long").alias("n"))),
        lambda t: F.array_append(t, F.struct(F.lit(None).cast("long").alias("h"), F.size(t).cast("long").alias("n"))),
    )
    return require(docs, text).select(F.inline(hashed)).groupBy("h").agg(F.sum("n").alias("n"))


def _everywhere(docs: DataFrame, told: DataFrame, key: str, text: str) -> DataFrame:
    """(key, crc, start, end, term, share): all places of the told terms (term, h, share) outside identifiers.

    Texts are joined only with the list of told terms that they hold.
    """
    rows = require(docs, key, text).select(F.col(f"`{key}`").alias("key"), text_key(text).alias("crc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    hashes = F.array_distinct(F.transform(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(F.lower(w))))
    held = rows.select("key", "crc", F.explode(hashes).alias("h")).join(told, "h")
    held = held.groupBy("key", "crc").agg(F.collect_set(F.struct("term", "share")).alias("told")).withColumnsRenamed({"key": "_key", "crc": "_crc"})
    met = rows.join(held, F.col("key").eqNullSafe(F.col("_key")) & (F.col("crc") == F.col("_crc")))
    mentions = F.concat(*[_tagged(base_spans(k, F.col("text")), lambda _, kind: F.lit(kind).alias("kind"), k) for k in KINDS])
    met = met.select("key", "crc", "text", F.map_from_entries("told").alias("told"), mentions.alias("all"))
    words = F.regexp_extract_all("text", F.lit(_TERM_PATTERN), F.lit(0))
    steps = let(
        words,
        lambda found: F.zip_with(
            F.slice(F.split("text", _TERM_PATTERN, -1), 1, F.size(found)), found, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("size"), F.lower(w).alias("term"))
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,term:string,share:double>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        share = F.try_element_at(F.col("told"), s["term"])
        place = F.struct(begin.alias("start"), (begin + s["size"]).alias("end"), s["term"].alias("term"), share.alias("share"))
        return F.struct((begin + s["size"]).alias("at"), F.when(share.isNotNull(), F.array_append(acc["spans"], place)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(steps, start, step, lambda acc: acc["spans"])
    marks = F.transform("all", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("share")))
    placed = met.select("key", "crc", F.inline(F.concat(spans, marks)))
    # A term is free if the identifiers that begin before it have ended and the next one begins after it.
    earlier = Window.partitionBy("key", "crc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("key", "crc").orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    mark = lambda c: F.when(F.col("term").isNull(), F.col(c))
    placed = placed.withColumn("ended", F.max(mark("end")).over(earlier)).withColumn("next", F.min(mark("start")).over(later))
    free = F.col("term").isNotNull() & (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return placed.filter(free).select("key", "crc", "start", "end", "term", "share").distinct()


def revealing(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", support: int = 2, generalise: float = 0.75, remove: float = 0.95) -> DataFrame:
    """(key, crc, start, end, value, share, action): places of terms that give identifiers away.

    The corpus is read for the terms near mentions, for the counts of all terms, and for the places of those that tell.
    What is kept, terms near mentions and those that tell, is small beside the texts and written to the scratch folder.
    """
    near = scratch.settle(_contexts(with_base(docs, key, text)))
    entities = near.groupBy("entity").agg(F.sum(F.size("terms")).alias("slots"))
    occurrences = near.select("key", "crc", "entity", F.inline("terms"))
    together = occurrences.groupBy("entity", "term").agg(F.count("*").alias("co")).filter(F.col("co") >= support).withColumn("h", F.xxhash64("term"))
    # Terms of no entity are dropped right after the count; the sum comes along as a term of its own.
    counts = _term_counts(docs, text)
    wanted = together.select("h").distinct().unionByName(docs.sparkSession.range(1).select(F.lit(None).cast("long").alias("h")))
    held = scratch.settle(counts.join(wanted.withColumnRenamed("h", "w"), F.col("h").eqNullSafe(F.col("w")), "left_semi"))
    total = held.filter("h is null").select("n")
    share = 1 - F.log2(F.col("n") / F.col("co")) / F.log2(F.greatest(F.col("total") / F.col("slots"), F.lit(2.0)))
    told = together.join(held, "h").join(entities, "entity").withColumn("total", total.scalar()).withColumn("share", F.round(share, 6))
    told = told.filter(F.col("share") >= generalise).select("entity", "term", "h", "share")
    told = scratch.settle(told.groupBy("term", "h").agg(F.max("share").alias("share")))
    found = _everywhere(docs, told, key, text)
    return found.select("key", "crc", "start", "end", F.col("term").alias("value"), "share", F.when(F.col("share") >= remove, "removed").otherwise("generalised").alias("action"))


def _by_document(found: DataFrame) -> DataFrame:
    general = F.when(F.col("value").rlike(r"^\p{N}+$"), "number").when(F.col("value").rlike(r"\p{N}"), "code").otherwise(TERM)
    listed = F.sort_array(F.collect_set(F.struct("start", "end", F.when(F.col("action") == "removed", "").otherwise(F.upper(general)).alias("by"))))
    return found.groupBy("key", "crc").agg(listed.alias("terms")).withColumnsRenamed({"key": "_key", "crc": "_crc"})


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    met = rows.join(_by_document(found), F.col("key").eqNullSafe(F.col("_key")) & (F.col("crc") == F.col("_crc")), "left")
    none = F.array().cast("array<struct<start:int,end:int,by:string>>")
    return met.drop("_key", "_crc").withColumn("terms", F.coalesce("terms", none))


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def personal_data(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: key, the number of spans of each kind and of revealing terms, SHA-256 of the base spans, all spans.

    Only offsets are joined; texts stay where they are read.
    """
    base = F.concat(*[_written(k, F.col(k)) for k in KINDS])
    rows = with_base(docs, key, text).select("key", "crc", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"))
    met = _joined(rows, revealing(docs, scratch, key, text, **options))
    return met.select(
        F.col("key").alias(key),
        *[f"n_{k}" for k in KINDS],
        F.size("terms").cast("long").alias("n_term"),
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join(F.concat("base", _written(TERM, F.col("terms"))), ",").alias("spans"),
    )


def sanitise(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with identifiers replaced by their kind in brackets, revealing terms removed or replaced by their general
    class: [NUMBER], [CODE] (letters and digits) or [TERM].

    Spans that overlap are replaced together, by the kind of the first. Null texts stay null.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    plain = rows.select("row", F.col(f"row.`{key}`").alias("key"), text_key(f"row.`{text}`").alias("crc"), F.coalesce(F.col(f"row.`{text}`"), F.lit("")).alias("text"))
    met = _joined(plain, revealing(docs, scratch, key, text, **options))
    labelled = [_tagged(base_spans(k, F.col("text")), lambda _, kind: F.lit(f"[{kind.upper()}]").alias("by"), k) for k in KINDS]
    general = _tagged(F.col("terms"), lambda s, kind: F.when(s["by"] == "", "").otherwise(F.concat(F.lit("["), s["by"], F.lit("]"))).alias("by"), TERM)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), s["by"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    changed = F.aggregate(F.sort_array(F.concat(*labelled, general)), start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    new_text = F.when(F.col(f"row.`{text}`").isNotNull(), changed)
    return met.select(*[new_text.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns])
