"""Removal of repeated word spans over a whole corpus: a token de Bruijn graph whose paths are compacted.

Every window of ``size`` consecutive words of a document is an edge of the graph. Windows that share their
minimizer (the smallest hash among their ``anchor``-word pieces, the last one in a tie) follow each other on one
path; such a path travels as one row under its minimizer. Equal windows have equal minimizers at equal distance, so
rows with one minimizer hold every occurrence of each of their edges, and nothing else has to be compared.
The first occurrence of an edge, by (document, position), stays; every other one is a repeated edge. Its words go.

Documents are ordered by id, null first; rows of one id by the CRC-32 of their text. Rows with equal id and text are
one document and get equal results. Null texts have no words; texts shorter than a window lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrain.llm.rows import bytes_of, portions, require, text_key

_BASE = 0x9E3779B97F4A7C15 | 1
#: Distinct words whose hashes a worker remembers.
_CACHE = 1 << 20


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` entries, mixed so that their order is arbitrary."""
    mask = (1 << 64) - 1
    done, length, power, bit = None, 0, hashes, 1
    while bit <= size:
        if size & bit:
            if done is None:
                done = power
            else:
                keep = len(hashes) - length - bit + 1
                done = done[: max(0, keep)] * np.uint64(pow(_BASE, bit, mask + 1)) + power[length : length + max(0, keep)]
            length += bit
        keep = max(0, len(power) - bit)
        power = power[:keep] * np.uint64(pow(_BASE, bit, mask + 1)) + power[bit : bit + keep]
        bit *= 2
    done = done ^ (done >> np.uint64(29))
    done = done * np.uint64(0xBF58476D1CE4E5B9)
    return done ^ (done >> np.uint64(32))


def last_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the last smallest value in each run of ``width`` values."""
    n = len(values)
    if n < width:
        return np.empty(0, np.int64)
    best, length = np.arange(n), 1
    while length < width:
        step = min(length, width - length)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] <= values[left], right, left)
        length += step
    return best


def _first_seen(windows: np.ndarray, doc: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first entry of each distinct window, and whether an entry lies elsewhere than that first one."""
    _, first, inverse = np.unique(windows, return_index=True, return_inverse=True)
    source = first[inverse]
    return first, (doc[source] != doc) | (sub[source] != sub)


def _paths(docs: DataFrame, key: str, text: str, size: int, anchor: int) -> DataFrame:
    """Rows (place, doc, sub, n, edges): a path of n windows that starts at word ``sub`` (low 32 bits).

    Windows that have an earlier equal one in the same portion of documents are decided at once: they come
    without edges and are dealt evenly, so a passage that many documents share reaches its minimizer's partition once
    for each portion only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in portions(batches, text):
            ids = batch.column(0)
            doc = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            crc = batch.column(2).to_numpy(zero_copy_only=False)
            order = np.lexsort((crc, doc))
            same = np.concatenate(([False], (doc[order][1:] == doc[order][:-1]) & (crc[order][1:] == crc[order][:-1])))
            order = order[~same]
            texts = bytes_of(batch, text)
            words = [texts[i].split() for i in order]
            long_enough = [k for k, w in enumerate(words) if len(w) >= size]
            if not long_enough:
                continue
            order, words = order[long_enough], [words[k] for k in long_enough]
            counts = np.array([len(w) for w in words])
            begin = np.cumsum(counts) - counts
            flat = np.concatenate([hashes.of(w) for w in words])
            windows = rolling(flat, size)
            anchors = rolling(flat, anchor)
            nearest = last_minimum(anchors, size - anchor + 1)
            n_windows = counts - size + 1
            owner = np.repeat(np.arange(len(counts)), n_windows)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + begin[owner]
            start = at - begin[owner]
            _, again = _first_seen(windows[at], owner, start)
            piece = np.where(again, -1, nearest[at])
            fresh = np.concatenate(([True], (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])))
            heads = np.nonzero(fresh)[0]
            n = np.diff(np.concatenate((heads, [len(owner)])))
            decided = piece[heads] < 0
            spread = anchors[at[heads]] ^ doc[order[owner[heads]]].view(np.uint64) * np.uint64(_BASE)
            place = np.where(decided, spread, anchors[np.maximum(piece[heads], 0)])
            held = ~again
            ends = np.cumsum(np.where(decided, 0, n))
            offsets = np.concatenate(([0], ends * 8)).astype(np.int64)
            edges = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(windows[at[held]]))]
            ).cast(pa.binary())
            source = order[owner[heads]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place.view(np.int64)),
                    ids.take(pa.array(source)),
                    pa.array((crc[source] << 32) | start[heads]),
                    pa.array(n.astype(np.int32)),
                    edges,
                ],
                ["place", "doc", "sub", "n", "edges"],
            )

    # Less 2^31, the CRC fits the high 32 bits of a long in its order.
    rows = require(docs, key, text).withColumn("crc", text_key(text) - 2147483648)
    return rows.mapInArrow(run, "place long, doc long, sub long, n int, edges binary")


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs (doc, sub, n) of paths that come sorted by place, document and position."""
    seen_place, seen = None, (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.column(0).to_numpy()
        ids = batch.column(1)
        doc = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        sub, n = batch.column(2).to_numpy(), batch.column(3).to_numpy().astype(np.int64)
        blocks = batch.column(4).to_pylist()
        edges = np.frombuffer(b"".join(blocks), np.uint64)
        held = np.array([len(x) // 8 for x in blocks], np.int64)
        row = np.repeat(np.arange(len(held)), held)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
        old = len(seen[0]) if seen_place == place[0] else 0
        old_edges, old_doc, old_sub = (x[:old] for x in seen)
        all_edges = np.concatenate((old_edges, edges))
        all_doc, all_sub = np.concatenate((old_doc, doc[row])), np.concatenate((old_sub, sub[row] + inside))
        first, again = _first_seen(all_edges, all_doc, all_sub)
        last = np.concatenate((np.full(old, place[0]), place[row]))[first] == place[-1]
        keep = first[last]
        seen_place, seen = place[-1], (all_edges[keep], all_doc[keep], all_sub[keep])
        again = again[old:]
        # Runs of repeated windows, and the runs that were decided before.
        hit = np.nonzero(again)[0]
        fresh = np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)))[: len(hit)]
        heads = hit[fresh]
        sizes = np.diff(np.concatenate((np.nonzero(fresh)[0], [len(hit)])))
        before = np.nonzero(held == 0)[0]
        rows = np.concatenate((row[heads], before))
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(rows)),
                pa.array(np.concatenate((sub[row[heads]] + inside[heads], sub[before]))),
                pa.array(np.concatenate((sizes, n[before])).astype(np.int64)),
            ],
            ["doc", "sub", "n"],
        )


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 20, anchor: int = 8) -> DataFrame:
    """(doc, crc, start, n): n consecutive windows from word ``start`` on that occur earlier in the corpus."""
    paths = _paths(docs, key, text, size, anchor)
    sorted_paths = paths.repartition("place").sortWithinPartitions("place", F.col("doc").asc_nulls_first(), "sub")
    runs = sorted_paths.mapInArrow(_repeats, "doc long, sub long, n long")
    return runs.select("doc", F.shiftright("sub", 32).alias("crc"), F.expr("sub & 4294967295").alias("start"), "n")


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 20, anchor: int = 8, texts: bool = True) -> DataFrame:
    """Per row: key, n_words, n_removed, the text that is left (kept words joined by one space; null without
    ``texts``) and its SHA-256."""
    spans = repeated_spans(docs, key, text, size, anchor)
    lists = spans.groupBy("doc", "crc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    rows = require(docs, key, text).withColumn("own_crc", text_key(text) - 2147483648)
    kind = docs.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each text, compressed: whole texts are the larger part of what the join moves."""
        for batch in portions(batches, text):
            codec = pa.Codec("zstd", compression_level=3)
            joined = [b" ".join(data.split()) for data in bytes_of(batch, text)]
            packed = pa.array([codec.compress(x, asbytes=True) for x in joined], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(x) for x in joined], pa.int64()), packed], ["key", "own_crc", "size", "packed"])

    rows = rows.mapInArrow(pack, f"key {kind}, own_crc long, size long, packed binary").withColumnRenamed("key", key)
    joined = rows.join(lists, F.col(key).eqNullSafe(F.col("doc")) & (F.col("own_crc") == F.col("crc")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in portions(batches, "size"):
            out: list[tuple[int, int, bytes, str]] = []
            for whole, packed, spans in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                words = codec.decompress(packed, whole, asbytes=True).split() if whole else []
                kept = words
                if spans:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, [s["start"] for s in spans], 1)
                    np.add.at(gone, [s["start"] + s["n"] + size - 1 for s in spans], -1)
                    kept = [words[i] for i in np.nonzero(np.cumsum(gone)[:-1] == 0)[0].tolist()]
                left = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), left, hashlib.sha256(left).hexdigest()))
            n_words, n_removed, left, digest = map(list, zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left if texts else [None] * len(left), pa.binary()).cast(pa.string()), pa.array(digest, pa.string())],
                ["key", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    found = joined.select(key, "size", "packed", "spans").mapInArrow(run, f"key {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return found.withColumnRenamed("key", key)
