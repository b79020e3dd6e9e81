"""Quality rules in DataFrame functions: word and line rules, and a hashed n-gram log-likelihood ratio.

Words and word pairs of a text are hashed into ``BUCKETS`` buckets. Two multinomials over the buckets, one of the trusted
texts and one of the whole raw corpus, give every bucket a log ratio (add-one smoothing); a text's verdict is the mean ratio of
its n-grams against a fixed threshold. So a text as likely in the raw corpus as in the trusted part has 0, whatever
its length. All counts cover all rows. Without trusted rows every ratio is 0 and only the rules decide.

Null texts have no words and fail the rules. Rows keep their key, also null or repeated ones; equal texts get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiregrain.llm.rows import require

BUCKETS = 10_000
#: Mean log ratio (nats an n-gram) below which a text is dropped: clearly less likely in trusted text than in the corpus.
THRESHOLD = -0.1
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Words of a repeated window.
_WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text, divided by ASCII white space."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _joined(hashes: Column, step: int) -> Column:
    """Hashes of each entry with the one ``step`` places on: of word runs twice as long when runs of ``step`` came in."""
    n = F.size(hashes)
    both = F.zip_with(hashes, F.slice(hashes, step + 1, n), lambda a, b: F.xxhash64(a, b))
    return F.slice(both, 1, F.greatest(n - step, F.lit(0)))


def hashed(text: Column) -> Column:
    """Hashes of all words of a text."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _repeated_words(pairs: Column) -> Column:
    """Words that lie in a window of eight words found twice or more; ``pairs`` are the hashes of word pairs."""

    def covered(found: Column) -> Column:
        ranked = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            ranked,
            lambda r: F.filter(
                F.transform(r, lambda x, k: F.when((F.get(r, k - 1)["h"] == x["h"]) | (F.get(r, k + 1)["h"] == x["h"]), x["i"])),
                lambda i: i.isNotNull(),
            ),
        )
        spans = let(
            F.sort_array(twice),
            lambda at: F.aggregate(
                F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(_WINDOW)), F.lit(_WINDOW))), F.lit(0), lambda a, x: a + x
            ),
        )
        return F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(spans)

    eights = let(pairs, lambda p: let(_joined(p, 2), lambda q: let(_joined(q, 4), covered)))
    return F.when(F.size(pairs) < _WINDOW, 0).otherwise(eights).cast("long")


def rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, hashes and pairs of every row."""
    rows = require(docs, key, text).withColumn(text, F.coalesce(text, F.lit("")))
    whole = F.col(text)
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    rows = rows.select(
        key,
        hashed(whole).alias("hashes"),
        F.length(F.translate(whole, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    rows = rows.select("*", F.size("hashes").cast("long").alias("n_words"), _joined(F.col("hashes"), 1).alias("pairs"))
    rows = rows.withColumn("n_repeat_words", _repeated_words(F.col("pairs")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def log_ratios(docs: DataFrame, text: str = "text", trusted: str = "trusted") -> DataFrame:
    """One row with the array ``ratios``: for each bucket the log of its trusted over its raw probability.

    Counts are summed by bucket before they are shuffled, so at most ``BUCKETS`` rows leave a task.
    """
    rows = require(docs, text, trusted).select(
        F.coalesce(F.col(trusted), F.lit(False)).cast("long").alias("t"),
        F.explode(let(hashed(F.coalesce(F.col(text), F.lit(""))), lambda h: F.concat(h, _joined(h, 1)))).alias("h"),
    )
    counts = rows.groupBy(F.pmod("h", F.lit(BUCKETS)).alias("b")).agg(F.count("*").alias("raw"), F.sum("t").alias("good"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("good"))
    filled = counts.unionByName(every).groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    # Three arrays of BUCKETS numbers: bounded, whatever the corpus.
    one = filled.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "good"))).alias("x"), F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    ratio = lambda x: F.log((x["good"] + 1) / (F.col("good") + BUCKETS)) - F.log((x["raw"] + 1) / (F.col("raw") + BUCKETS))
    return one.select(F.when(F.col("good") == 0, F.transform("x", lambda _: F.lit(0.0))).otherwise(F.transform("x", ratio)).alias("ratios"))


def judge(docs: DataFrame, ratios: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rules' columns, the mean log ratio ``score`` and ``kept`` of every row; ``ratios`` comes from ``log_ratios``."""
    rows = rules(docs, key, text).withColumn("ratios", ratios.scalar())
    summed = lambda hashes: F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.get(F.col("ratios"), F.pmod(h, F.lit(BUCKETS)).cast("int")))
    total = summed("hashes") + summed("pairs")
    n = F.when(F.col("n_words") > 0, 2 * F.col("n_words") - 1)
    rows = rows.withColumn("score", F.coalesce(total / n, F.lit(0.0))).drop("hashes", "pairs", "ratios")
    # Six digits: sums of floating-point numbers must not decide by their order.
    return rows.withColumn("kept", ~F.col("base_failed") & (F.round("score", 6) >= threshold))


def with_trusted(docs: DataFrame, trusted_ids: DataFrame, key: str = "doc_id", most: int = 20_000) -> DataFrame:
    """``docs`` with the boolean ``trusted``: rows whose key is among the ``most`` trusted keys with the smallest hashes."""
    ids = require(trusted_ids, key).dropna().distinct().orderBy(F.xxhash64(key), key).limit(most).withColumn("trusted", F.lit(True))
    # At most ``most`` keys.
    return require(docs, *[c for c in docs.columns if c != "trusted"]).join(F.broadcast(ids), key, "left")
