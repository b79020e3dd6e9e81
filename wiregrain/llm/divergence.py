"""Audit of sources: how far the words of each source of a language are from those of the others, and which words are its own.

Terms are runs of letters A-Z (lower-cased) and characters beyond ASCII. Each language keeps the V terms that stand in at
least ``least`` of its documents. A kept term has the weight ``p = 1 + floor(scale * (count + 2) / (N + 2 V))`` in a source,
with N the source's occurrences of kept terms, and two weights differ by ``floor((p - q)**2 / (p + q))``. All is whole
numbers.

Kept terms, sorted, become a minimal acyclic transducer; the texts are streamed through it and counted by the ordinals it
gives, so that no text and no word is shuffled for the counts. Ordinals follow the order of UTF-8 bytes and break all ties.
The transducer holds at most ``most_terms`` terms of 64 bytes (the most frequent ones), a proven size; if a corpus keeps
more, the rest is counted by a join on the word. Counts travel as vectors over blocks of ordinals, and sources are compared
block by block in tiles of ``tile`` sources.

Null texts, languages and sources are empty strings. Rows are documents, repeated ones too. Groups without terms take part
with counts of zero; a language without kept terms has pairs with the value 0. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiregrain.llm import transducer
from wiregrain.llm.rows import bytes_of, least_count, portions
from wiregrain.session import Scratch

LEAST = 10
SCALE = 1_000_000_000
#: Terms of the transducer at most, and bytes of one.
MOST_TERMS = 500_000
_TERM_BYTES = 64
#: Ordinals of a block, and sources of a tile.
BLOCK = 1 << 14
TILE = 32
#: Entries of counts that a task holds before it passes them on.
_HELD = 1 << 21
#: Partitions whose counts are added up by one task first.
_FAN_IN = 256
#: Everything but letters becomes a blank, A-Z become a-z, bytes beyond ASCII stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(data: bytes) -> list[bytes]:
    """All terms of a text, in order."""
    return data.translate(_FOLD).split()


def _documents(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])


def _frequencies(rows: DataFrame) -> DataFrame:
    """(lang, term, n): in how many documents of the language a term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            found: dict[str, Counter] = {}
            for lang, data in zip(batch.column(0).to_pylist(), bytes_of(batch, "text"), strict=True):
                found.setdefault(lang, Counter()).update(set(terms(data)))
            for lang, own in found.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.binary()).cast(pa.string()), pa.array(own.values(), pa.int64())], ["lang", "term", "n"]
                )

    return rows.select("lang", "text").mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def vocabulary(rows: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """(lang, term, n, ordinal): kept terms, numbered from 0 in the order of their bytes, by ranges and their sizes."""
    kept = _frequencies(rows).filter(F.col("n") >= least).repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    placed = scratch.settle(kept.select("lang", "term", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    sizes = placed.groupBy("lang", "part").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("lang", "part", "first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return scratch.settle(placed.join(starts, ["lang", "part"]).select("lang", "term", "n", (F.col("start") + F.col("at") - F.col("first")).alias("ordinal")))


@dataclass
class Vocabulary:
    """The transducer over language numbers and terms, and where each language starts in it."""

    automaton: transducer.Transducer
    langs: dict[str, tuple[int, int]]
    ordinals: np.ndarray


def _compiled(kept: DataFrame, most_terms: int) -> tuple[Vocabulary, DataFrame]:
    """The transducer of the most frequent terms, and the table of the others."""
    short = F.octet_length("term") <= _TERM_BYTES
    floor = least_count(kept.filter(short), most_terms)
    inside = short & (F.col("n") >= floor)
    chosen = kept.filter(inside).select("lang", "term", "ordinal").toArrow()
    lang, term = chosen.column("lang").to_pylist(), chosen.column("term").cast(pa.binary()).to_pylist()
    numbers = {x: i.to_bytes(4) for i, x in enumerate(sorted(set(lang)))}
    words = [numbers[a] + b for a, b in zip(lang, term, strict=True)]
    order = sorted(range(len(words)), key=words.__getitem__)
    automaton = transducer.build([words[i] for i in order])
    starts = {}
    for x, number in numbers.items():
        state, skipped = np.array([automaton.root]), 0
        for b in number:
            state, more = automaton.step(state, np.array([b]))
            skipped += int(more[0])
        starts[x] = (int(state[0]), skipped)
    ordinals = chosen.column("ordinal").to_numpy()[order] if order else np.empty(0, np.int64)
    return Vocabulary(automaton, starts, ordinals), kept.filter(~inside).select("lang", "term", "ordinal")


def _streamed(vocabulary: Vocabulary, langs: list[str], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """For each term of the texts: its text, ordinal (-1: not in the transducer), and where it stands in the folded bytes."""
    folded = b" ".join([*(x.translate(_FOLD) for x in texts), b""])
    data = np.frombuffer(folded, np.uint8)
    letter = np.concatenate(([False], data != 32, [False]))
    edge = np.nonzero(letter[1:] != letter[:-1])[0]
    start, end = edge[::2], edge[1::2]
    first = np.cumsum([0, *(len(x) + 1 for x in texts)])
    of = np.searchsorted(first, start, "right") - 1
    begin = np.array([vocabulary.langs.get(x, (-1, 0)) for x in langs], np.int64).reshape(-1, 2)
    found = vocabulary.automaton.walk(begin[of, 0], begin[of, 1], data, start, end - start)
    ordinal = np.where(found >= 0, vocabulary.ordinals[np.maximum(found, 0)] if len(vocabulary.ordinals) else -1, -1)
    return of, ordinal, folded, start, end


_VECTORS = "lang string, source string, block long, at binary, n binary"


def _vectors(groups: list[tuple[str, str]], group: np.ndarray, ordinal: np.ndarray, n: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """Sorted counts as one row for each group and block: places in the block (two bytes each) and counts (eight)."""
    if not len(group):
        return
    number = ordinal // block
    heads = np.nonzero(np.concatenate(([True], (np.diff(group) != 0) | (np.diff(number) != 0))))[0]
    ends = np.append(heads[1:], len(group))
    for at in range(0, len(heads), 256):
        rows = [
            (*groups[group[a]], int(number[a]), (ordinal[a:b] % block).astype("<u2").tobytes(), n[a:b].astype("<i8").tobytes())
            for a, b in zip(heads[at : at + 256].tolist(), ends[at : at + 256].tolist(), strict=True)
        ]
        columns = list(zip(*rows, strict=True))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "block", "at", "n"])


class _Counts:
    """Counts by group and ordinal that are passed on when they are many."""

    def __init__(self, block: int):
        self.block = block
        self.groups: dict[tuple[str, str], int] = {}
        self.keys, self.n = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, group: np.ndarray, ordinal: np.ndarray, n: np.ndarray) -> None:
        keys, back = np.unique(np.concatenate((self.keys, group << 40 | ordinal)), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, back, np.concatenate((self.n, n)))
        self.keys, self.n = keys, total

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield from _vectors(list(self.groups), self.keys >> 40, self.keys & ((1 << 40) - 1), self.n, self.block)
        self.__init__(self.block)


def _counted(rows: DataFrame, vocabulary: Vocabulary, block: int) -> DataFrame:
    """Vectors of counts of the terms in the transducer."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts(block)
        for batch in portions(batches, "text"):
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            number = np.array([held.groups.setdefault(p, len(held.groups)) for p in pairs], np.int64)
            of, ordinal, *_ = _streamed(shared.value, [p[0] for p in pairs], bytes_of(batch, "text"))
            hit = ordinal >= 0
            held.add(number[of[hit]], ordinal[hit], np.ones(int(hit.sum()), np.int64))
            if len(held.keys) > _HELD:
                yield from held.rows()
        yield from held.rows()

    return rows.mapInArrow(run, _VECTORS)


def _joined(rows: DataFrame, vocabulary: Vocabulary, others: DataFrame, block: int) -> DataFrame:
    """Vectors of counts of kept terms that the transducer does not hold, by a join on the word."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            of, ordinal, folded, start, end = _streamed(shared.value, [p[0] for p in pairs], bytes_of(batch, "text"))
            miss = np.nonzero(ordinal < 0)[0]
            found = Counter((*pairs[i], folded[a:b]) for i, a, b in zip(of[miss].tolist(), start[miss].tolist(), end[miss].tolist(), strict=True))
            columns = [[k[0] for k in found], [k[1] for k in found], [k[2].decode() for k in found], list(found.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 3 else pa.string()) for i, c in enumerate(columns)], ["lang", "source", "term", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts(block)
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            held.add(np.array([held.groups.setdefault(p, len(held.groups)) for p in pairs], np.int64), batch.column(2).to_numpy(), batch.column(3).to_numpy())
            if len(held.keys) > _HELD:
                yield from held.rows()
        yield from held.rows()

    missed = rows.mapInArrow(run, "lang string, source string, term string, n long")
    summed = missed.join(others, ["lang", "term"]).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))
    return summed.select("lang", "source", "ordinal", "n").mapInArrow(pack, _VECTORS)


def _dense(at: bytes | None, n: bytes | None, out: np.ndarray) -> np.ndarray:
    if at:
        out[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i8")
    return out


def _added(vectors: DataFrame, block: int, *by: str) -> DataFrame:
    """Vectors added up by lang, source, block and ``by``; one dense vector of a block is held at a time."""
    keys = ["lang", "source", "block", *by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, np.zeros(block, np.int64)

        def row() -> pa.RecordBatch:
            at = np.nonzero(total)[0]
            values = [*held[:3], at.astype("<u2").tobytes(), total[at].astype("<i8").tobytes()]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["lang", "source", "block", "at", "n"])

        for batch in batches:
            for at, n, *key in zip(*(batch.column(c).to_pylist() for c in ("at", "n", *keys)), strict=True):
                if key != held:
                    if held:
                        yield row()
                    held = key
                    total[:] = 0
                _dense(at, n, total)
        if held:
            yield row()

    return vectors.select(*keys, "at", "n").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _VECTORS)


def _totals(vectors: DataFrame, rows: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """One vector for each group and block; in two steps where many partitions have a part of it."""
    shares = rows.rdd.getNumPartitions() // _FAN_IN
    if shares > 1:
        vectors = _added(vectors.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(shares))), block, "share")
    return scratch.settle(_added(vectors, block))


def _weights(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """Weights of counts in a group with ``total`` occurrences; exact also where products exceed 64 bits."""
    if (int(counts.max(initial=0)) + 2) * SCALE < 1 << 62:
        return 1 + SCALE * (counts + 2) // (total + 2 * kept)
    return np.array([1 + SCALE * (int(c) + 2) // (total + 2 * kept) for c in counts], np.int64)


def _difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _own_terms(totals: DataFrame, sizes: DataFrame, most: int, width: int) -> DataFrame:
    """(lang, source, ordinal, value): in each block of each group the terms that differ most from the language."""
    summed = _added(totals.select("lang", F.lit("").alias("source"), "block", "at", "n"), width)
    langs = sizes.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    whole = summed.select("lang", "block", F.col("at").alias("lang_at"), F.col("n").alias("lang_n")).join(langs, "lang")
    met = totals.join(whole, ["lang", "block"]).join(sizes.select("lang", "source", "total", "kept"), ["lang", "source"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, source, block, at, n, lang_at, lang_n, lang_total, total, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places = np.frombuffer(at, "<u2").astype(np.int64)
                p = _weights(np.frombuffer(n, "<i8"), total, kept)
                q = _weights(_dense(lang_at, lang_n, np.zeros(width, np.int64))[places], lang_total, kept)
                value = _difference(p, q)
                over = np.nonzero(p > q)[0]
                top = over[np.lexsort((places[over], -value[over]))][:most]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(top), pa.string()), pa.array([source] * len(top), pa.string()), pa.array(block * width + places[top], pa.int64()), pa.array(value[top], pa.int64())],
                    ["lang", "source", "ordinal", "value"],
                )

    columns = ["lang", "source", "block", "at", "n", "lang_at", "lang_n", "lang_total", "total", "kept"]
    return met.select(*columns).mapInArrow(run, "lang string, source string, ordinal long, value long")


def _compared(totals: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """(lang, source, item, value): differences of two sources over all kept terms, added up by blocks."""
    tiles = groups.groupBy("lang").agg(F.max("tile").alias("last_tile"))
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"(kept - 1) div {width}"))
    every = groups.filter("kept > 0").withColumn("block", F.explode(blocks)).join(totals, ["lang", "source", "block"], "left").join(tiles, "lang")
    dealt = every.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last_tile")))
    dealt = dealt.withColumn("one", F.least("tile", "other")).withColumn("two", F.greatest("tile", "other"))
    unit = ["lang", "block", "one", "two"]
    columns = [*unit, "tile", "source", "total", "kept", "at", "n"]
    rows = dealt.select(*columns).repartition(*unit).sortWithinPartitions(*unit, "tile", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(key: list, rows: list[tuple]) -> pa.RecordBatch:
            lang, block, one, two = key
            size = min(rows[0][3] - block * width, width)
            weights = np.stack([_weights(_dense(at, n, np.zeros(width, np.int64))[:size], total, kept) for _, _, total, kept, at, n in rows])
            tile = np.array([r[0] for r in rows])
            found = []
            for i in range(len(rows)):
                for j in range(i + 1, len(rows)):
                    if (one == two) or tile[i] != tile[j]:
                        value = int(_difference(weights[i], weights[j]).sum())
                        found += [(lang, rows[i][1], rows[j][1], value), (lang, rows[j][1], rows[i][1], value)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 3 else pa.string()) for k, c in enumerate(columns)], ["lang", "source", "item", "value"])

        key, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != key:
                    if held:
                        yield compare(key, held)
                    key, held = row[:4], []
                held.append(row[4:])
        if held:
            yield compare(key, held)

    return rows.mapInArrow(run, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame,
    scratch: Scratch,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least: int = LEAST,
    top: int = 10,
    most_terms: int = MOST_TERMS,
    block: int = BLOCK,
    tile: int = TILE,
) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source with its difference (``pair``), and the ``top`` terms that
    a source uses more than its language (``term``); ranked by value, ties by the order of UTF-8 bytes."""
    rows = _documents(docs, text, lang, source)
    kept = vocabulary(rows, scratch, least)
    compiled, others = _compiled(kept, most_terms)
    vectors = _counted(rows, compiled, block)
    if not others.isEmpty():
        vectors = vectors.union(_joined(rows, compiled, others, block))
    totals = _totals(vectors, rows, scratch, block)
    groups = rows.select("lang", "source").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
    sums = _sizes(totals)
    groups = groups.join(sums, ["lang", "source"], "left").fillna(0, ["kept", "total"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = scratch.settle(groups.withColumn("tile", F.floor(number / tile)))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = pairs.join(_compared(totals, groups, block), ["lang", "source", "item"], "left").fillna(0, ["value"])
    by_pair = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_pair).alias("rank"))
    by_term = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    own = _own_terms(totals, groups, top, block).withColumn("rank", F.row_number().over(by_term)).filter(F.col("rank") <= top)
    own = own.join(kept.select("lang", "ordinal", "term"), ["lang", "ordinal"])
    return pairs.union(own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


def _sizes(totals: DataFrame) -> DataFrame:
    """(lang, source, total): occurrences of kept terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(x, "<i8").sum()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], ["lang", "source", "total"])

    return totals.select("lang", "source", "n").mapInArrow(run, "lang string, source string, total long").groupBy("lang", "source").agg(F.sum("total").alias("total"))
