"""Language-model scores of documents: stupid backoff over n-grams of up to three words, computed relationally.

N-grams of all words and of all orders are counted over all documents; there is no vocabulary. A document begins with a
start sign and is scored by what the others say: its own counts are taken off. The longest n-gram that is left gives
count(n-gram) / count(its context), times 0.4 for each word given up on the way; a word that is left nowhere counts once
among all words. Words and n-grams are hashed to 64 bits; of these 20 more are compared than it takes to number all n-grams
of the corpus (49 for 0.5 GB), so that fewer than one n-gram in a million is taken for another one, at any size.

Texts are written once as portions of bounded size. Each portion sends every n-gram it holds once, with its count, to the
part of the hash space that owns it, so that a word found everywhere costs one entry for each portion. A part sums the
counts and answers each portion with the n-grams that stand in two or more documents: one bit for each n-gram sent, and the
sums. All others are left nowhere once a document's own counts are off, so no answer is needed. Portions then meet their
answers and score. The number of parts grows with the words; no table is broadcast and only two sums reach the driver.

Null texts and texts without words have 0 words and a null score. Rows with equal id and text are two documents for the
counts and get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrain.llm.rows import bytes_of, portions, require
from wiregrain.session import Scratch

BACKOFF = 0.4
ORDER = 3
#: Bytes of text of a portion, and n-grams that a part of the hash space is to get.
PORTION_BYTES, PART_GRAMS = 4 << 20, 1_000_000
#: Bits that are compared beyond those that number all n-grams.
SPARE_BITS = 20
_START = np.uint64(0x243F6A8885A308D3)
_ODD, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits of the n-gram of a context and the word after it."""
    x = context * _ODD + word
    x = (x ^ (x >> np.uint64(32))) * _SPREAD
    return x ^ (x >> np.uint64(29))


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as one byte with their width and compressed planes of equal bytes."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int) -> np.ndarray:
    out, width = np.zeros((size, 8), np.uint8), data[0]
    planes = pa.decompress(data[1:], size * width, codec="zstd", asbytes=True) if size else b""
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, size).T
    return out.reshape(-1).view("<u8")


def _words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """All words and the text of each. Words are what is left between ASCII spaces and controls 9 to 13."""
    split = pc.ascii_split_whitespace(texts)
    pieces = split.flatten()
    some = pc.greater(pc.binary_length(pieces), 0)
    return pieces.filter(some), pc.list_parent_indices(split).filter(some).to_numpy()


@dataclass
class _Grams:
    """The n-grams of a portion. Arrays of places cover each text's start sign and words, text after text."""

    n_words: np.ndarray  # words of each text
    owner: np.ndarray  # text of each place
    offset: np.ndarray  # place within its text, 0 for the start sign
    distinct: np.ndarray  # distinct n-grams of all orders, sorted
    count: np.ndarray  # how often each stands here
    in_texts: np.ndarray  # in how many texts
    at: list[np.ndarray]  # per order: places where an n-gram of it ends
    entry: list[np.ndarray]  # per order and such place: its place in ``distinct``
    own: list[np.ndarray]  # per order and such place: its count in that text


def _hashes(words: pa.StringArray) -> np.ndarray:
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).tolist() if len(words) else [0]
    whole = words.buffers()[2].to_pybytes() if len(words) else b""
    return np.fromiter((xxhash.xxh64_intdigest(whole[a:b]) for a, b in zip(ends, ends[1:], strict=False)), np.uint64, len(words))


def _grams(texts: pa.StringArray, order: int, bits: int, places: bool) -> _Grams:
    """All n-grams of the texts; where they stand (``entry`` and ``own``) only if ``places`` are wanted."""
    pieces, text_of = _words(texts)
    n_words = np.bincount(text_of, minlength=len(texts))
    coded = pieces.dictionary_encode()
    hashes = _hashes(coded.dictionary)
    size = n_words + 1
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(texts)), size)
    offset = np.arange(len(owner)) - begin[owner]
    word = np.full(len(owner), _START, np.uint64)
    word[offset > 0] = hashes[coded.indices.to_numpy()]
    gram, at, found = word, [], []
    for k in range(1, order + 1):
        if k > 1:
            gram = np.concatenate((gram[:1], _joined(gram[:-1], word[1:])))
        at.append(np.nonzero(offset >= max(1, k - 1))[0])
        found.append(gram[at[-1]])
    ends = np.cumsum([len(x) for x in at])[:-1]
    every, text = np.concatenate(found) >> np.uint64(64 - bits), owner[np.concatenate(at)]
    # Texts stand in order within each order of n-grams, so places in order keep those of one n-gram together.
    by = np.argsort(every)
    fresh = np.ones(len(every), bool)
    fresh[1:] = np.diff(every[by]) != 0
    by = (np.sort(np.cumsum(fresh).astype(np.uint64) << np.uint64(40) | by.astype(np.uint64)) & np.uint64((1 << 40) - 1)).astype(np.int64)
    every, text = every[by], text[by]
    entered = fresh.copy()
    entered[1:] |= np.diff(text) != 0
    heads = np.nonzero(fresh)[0]
    in_texts = np.add.reduceat(entered.astype(np.int64), heads) if len(heads) else heads
    found = _Grams(n_words, owner, offset, every[heads], np.diff(np.append(heads, len(every))), in_texts, at, [], [])
    if places:
        lengths = np.diff(np.append(np.nonzero(entered)[0], len(every)))
        entry, own = np.empty(len(every), np.int64), np.empty(len(every), np.int64)
        entry[by] = np.cumsum(fresh) - 1
        own[by] = np.repeat(lengths, lengths)
        found.entry, found.own = np.split(entry, ends), np.split(own, ends)
    return found


def _part(grams: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Part of the hash space; it rises with the hash."""
    high = grams >> np.uint64(bits - 32) if bits > 32 else grams << np.uint64(32 - bits)
    return (high * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _texts(row: dict) -> pa.StringArray:
    """The texts of a written portion."""
    whole = pa.decompress(row["body"], row["n_bytes"], codec="zstd") if row["n_bytes"] else pa.py_buffer(b"")
    ends = np.concatenate(([0], np.cumsum(row["sizes"]))).astype(np.int32)
    return pa.StringArray.from_buffers(len(row["sizes"]), pa.py_buffer(ends), whole)


def write_portions(docs: DataFrame, scratch: Scratch, key: str, text: str, most: int = PORTION_BYTES) -> DataFrame:
    """All rows in portions (portion, keys, sizes, body, n_bytes, n_words, starts), each with about ``most`` bytes of text."""
    rows = require(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        packer = pa.Codec("zstd", compression_level=9)  # the texts lie on disk twice
        for batch in portions(batches, text, most):
            texts = bytes_of(batch, text)
            owner = _words(pc.fill_null(batch.column(text), ""))[1]
            whole = b"".join(texts)
            columns = {
                "portion": pa.array([number], pa.int64()),
                "keys": pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column(0)),
                "sizes": pa.array([[len(x) for x in texts]], pa.list_(pa.int64())),
                "body": pa.array([packer.compress(whole, asbytes=True)], pa.binary()),
                "n_bytes": pa.array([len(whole)], pa.int64()),
                "n_words": pa.array([len(owner)], pa.int64()),
                "starts": pa.array([len(np.unique(owner))], pa.int64()),
            }
            number += 1
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"portion long, keys array<{kind}>, sizes array<long>, body binary, n_bytes long, n_words long, starts long"
    return scratch.settle(rows.mapInArrow(cut, schema))


def count_grams(written: DataFrame, order: int, bits: int, parts: int) -> DataFrame:
    """For each portion and part of the hash space: which of the n-grams sent stand in two or more documents, and the
    counts of these over all documents (portion, part, size, shared, totals)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["portion", "sizes", "body", "n_bytes"]).to_pylist():
                grams = _grams(_texts(row), order, bits, places=False)
                part = _part(grams.distinct, parts, bits)
                cuts = [*np.nonzero(np.diff(part, prepend=-1))[0].tolist(), len(part)]
                out = []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    steps = np.diff(grams.distinct[a:b], prepend=np.uint64(0))
                    # The first is kept whole beside the steps, which need fewer bytes.
                    first, steps[0] = int(steps[0]) - (1 << 63), 0
                    out.append((int(part[a]), row["portion"], b - a, first, _pack(steps), _pack(grams.count[a:b]), _pack(grams.in_texts[a:b])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["part", "portion", "size", "first", "steps", "n", "docs"])

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        first = [np.uint64(r["first"] + (1 << 63)) for r in rows]
        every = np.concatenate([f + np.cumsum(_unpack(r["steps"], r["size"]), dtype=np.uint64) for f, r in zip(first, rows, strict=True)])
        by = np.argsort(every)
        fresh = np.diff(every[by], prepend=~every[by[:1]]) != 0
        entry = np.empty(len(every), np.int64)
        entry[by] = np.cumsum(fresh) - 1
        added = lambda c: np.bincount(entry, np.concatenate([_unpack(r[c], r["size"]) for r in rows])).astype(np.int64)[entry]
        total, shared = added("n"), added("docs") > 1
        out, end = [], 0
        for r in rows:
            begin, end = end, end + r["size"]
            if shared[begin:end].any():
                told = shared[begin:end]
                out.append((r["portion"], r["part"], r["size"], np.packbits(told).tobytes(), _pack(total[begin:end][told])))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["portion", "part", "size", "shared", "totals"])

    sent = written.mapInArrow(send, "part long, portion long, size long, first long, steps binary, n binary, docs binary")
    return sent.groupBy("part").applyInArrow(answer, "portion long, part long, size long, shared binary, totals binary")


def score(
    docs: DataFrame,
    scratch: Scratch,
    key: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    portion_bytes: int = PORTION_BYTES,
    part_grams: int = PART_GRAMS,
) -> DataFrame:
    """Per row: key, n_words, log10_prob of the text, n_backoff (words whose longest n-gram is not left) and log10_prob
    per word. The sizes of portions and parts change nothing in the result."""
    written = write_portions(docs, scratch, key, text, portion_bytes)
    sums = written.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.sum("starts"), F.lit(0)).alias("starts")).first()
    all_words, all_starts = sums.words, sums.starts
    most = order * all_words
    parts, bits = max(1, -(-most // part_grams)), min(64, most.bit_length() + SPARE_BITS)

    def judge(portion: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = portion.select(["sizes", "body", "n_bytes"]).to_pylist()
        grams = _grams(_texts(row), order, bits, places=True)
        part, totals = _part(grams.distinct, parts, bits), np.zeros(len(grams.distinct), np.int64)
        for r in answers.to_pylist():
            begin = int(np.searchsorted(part, r["part"]))
            told = np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=r["size"]).astype(bool)
            totals[begin : begin + r["size"]][told] = _unpack(r["totals"], int(told.sum()))
        places = len(grams.owner)
        others = np.maximum(all_words - grams.n_words[grams.owner], 1)
        # Longest n-gram that may end at a place, the start sign counted as a word of the context.
        longest = np.minimum(grams.offset + 1, order)
        value, hit_order = np.zeros(places), np.zeros(places, np.int64)
        context = np.zeros(places, np.int64)
        for k in range(1, order + 1):
            at = grams.at[k - 1]
            total = totals[grams.entry[k - 1]]
            left = np.where(total > 0, total - grams.own[k - 1], 0)
            if k == 1:
                value[at] = np.log10(np.maximum(left, 1)) - np.log10(others[at])
                hit_order[at] = 1
            else:
                seen = left > 0
                value[at[seen]] = np.log10(left[seen]) - np.log10(np.maximum(context[at[seen] - 1], 1))
                hit_order[at[seen]] = k
            context = np.zeros(places, np.int64)
            context[at] = left
            if k == 1:
                context[grams.offset == 0] = all_starts - 1
        given_up = np.where(grams.offset > 0, longest - hit_order, 0)
        value += np.log10(BACKOFF) * given_up
        texts = len(grams.n_words)
        some = grams.n_words > 0
        log_prob = np.round(np.bincount(grams.owner, value, texts), 6)
        per_word = np.round(log_prob / np.maximum(grams.n_words, 1), 6)
        keys = portion.column("keys").combine_chunks().flatten()
        backed = np.bincount(grams.owner, given_up > 0, texts).astype(np.int64)
        columns = [keys, pa.array(grams.n_words), pa.array(log_prob, mask=~some), pa.array(backed), pa.array(per_word, mask=~some)]
        return pa.table(columns, [key, "n_words", "log10_prob", "n_backoff", "score"])

    answers = count_grams(written, order, bits, parts)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, log10_prob double, n_backoff long, score double"
    return written.groupBy("portion").cogroup(answers.groupBy("portion")).applyInArrow(judge, schema)
