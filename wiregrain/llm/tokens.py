"""Token counts of whole texts by a two-tier lookup of pre-token lengths, without a shuffle of pre-tokens.

First tier: a table of the token lengths of frequent pre-tokens, broadcast to the executors and bounded by
``table_size``. It only saves time: a pre-token that is not in it is encoded by the tokenizer library itself, and
each Python worker remembers what it encoded (second tier, bounded too). Texts with characters outside the ranges
in which pre-tokens are divided here go to the library whole, so every count is the library's.

Null texts are empty: no bytes, no tokens. Strings of special tokens inside a text count as the library counts them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrain.llm.rows import portions, require

#: How byte-level BPE divides a text (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that all Unicode versions class alike: printable ASCII and white space, Latin, Greek, Cyrillic.
PLAIN = r"[\t\n\x0b\x0c\r\x20-\x7e -ȷΆΈ-ΊΌΎ-ΡΣ-ώЀ-ҁҊ-ԓ–-…€]*"
#: Longest pre-token, in characters, that is remembered.
_LONGEST = 48
#: Pre-tokens that a worker remembers.
_CACHE = 1 << 19


class _Lengths(dict):
    """Token counts of pre-tokens: the broadcast table, then what this worker encoded."""

    def __init__(self, tokenizer, table: dict[str, int]):
        super().__init__(table)
        self.tokenizer, self.table = tokenizer, table

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= _LONGEST:
            if len(self) >= _CACHE + len(self.table):
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n


class Counter2Tier:
    """Counts tokens of texts; ``table`` holds the lengths of frequent pre-tokens."""

    def __init__(self, path: str, table: dict[str, int]):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(PATTERN).findall
        self.plain = regex.compile(PLAIN).fullmatch
        self.lengths = _Lengths(self.tokenizer, table)

    def divided(self, text: str) -> list[str] | None:
        """Pre-tokens of a text, or None where only the library may divide it."""
        if not self.plain(text) or any(s in text for s in self.special):
            return None
        return self.find(text)

    def count(self, text: str) -> int:
        pieces = self.divided(text)
        if pieces is None:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.lengths.__getitem__, pieces))


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", table_size: int = 1 << 15, sample_rows: int = 2000) -> dict[str, int]:
    """Token lengths of the most frequent pre-tokens among the ``sample_rows`` texts with the smallest hashes.

    The table steers speed only, so a bounded sample is enough; counts never depend on it.
    """
    counter = Counter2Tier(path, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = Counter2Tier(path, {}), Counter()
        for batch in portions(batches, text):
            for value in pc.fill_null(batch.column(0), "").to_pylist():
                found.update(p for p in own.divided(value) or () if len(p) <= _LONGEST)
                if len(found) > 8 * table_size:  # keep what is frequent so far
                    found = Counter(dict(found.most_common(2 * table_size)))
        top = found.most_common(table_size)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    rows = require(docs, text)
    chosen = rows.select(F.xxhash64(text).alias("h")).groupBy("h").count().orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if chosen is None:
        return {}
    # Copies of a chosen text add nothing to the table; one of them is enough.
    sample = rows.filter(F.xxhash64(text) <= chosen).groupBy(F.xxhash64(text)).agg(F.min(text).alias(text)).select(text)
    top = sample.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = [r.piece for r in top.orderBy(F.desc("n"), "piece").limit(table_size).collect()]
    return {p: counter.lengths[p] for p in pieces}


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512, table_size: int = 1 << 15) -> DataFrame:
    """Key, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``path`` is the tokenizer file, which every executor must have at the same place.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text, table_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter2Tier(path, table.value)
        for batch in portions(batches, text):
            texts = pc.fill_null(batch.column(1), "")
            n = np.fromiter(map(counter.count, texts.to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                ["key", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    found = require(docs, key, text).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return found.withColumnRenamed("key", key)
