"""Benchmark decontamination by templates: questions are found again when only their numbers, names or units changed.

Words become template tokens: numbers, units and names turn into typed placeholders (neighbouring names into one), all
other words are lower-cased and lose the signs around them. A capitalised word at the start of a sentence may be a name or
not: texts are read both ways, and readings of one kind are compared. Windows of ``size`` tokens of documents and benchmark
items are joined by hash. Windows that lie on one diagonal (equal distance of their positions) form an alignment; it
counts only if its slots are consistent: each value of the item stands for one value of the document, and different
values for different ones. A document is contaminated by an item if consistent alignments cover at least ``coverage``
of the item's windows.

A template window needs ``literals`` words that are no placeholders. Items with fewer than ``size`` tokens have one
window, all of the item; as templates, items with fewer literals than that match nothing. Windows of the unchanged
lower-cased words are a further reading that needs no literals: it finds unchanged items of numbers, names and units, of
any length. Null and empty texts match nothing. Documents that
share an id are told apart by their text; repeated rows count once. Repeated items give equal rows once each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrain.llm.rows import bytes_of, portions, released, require, text_key
from wiregrain.llm.spans import rolling

#: Words for numbers and units (fixed values).
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()
UNIT_WORDS = """mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons
pound pounds ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day
days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres percent
dollar dollars euro euros cent cents degree degrees mph kph watt watts volt volts""".split()
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th|[a-z]{1,3})?")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_MONEY = re.compile(r"[+-]?[$€£]?\d.*")

_LITERAL, _NUM, _UNIT, _NAME = range(4)
_KINDS = ("", "num", "unit", "name")
_EMPTY, _CAPITAL, _ENDS = 4, 8, 16
#: With _EMPTY: a sign such as + that stands alone; only verbatim windows have it.
_SIGN = 1
_POINTS = "()[]{}\"'.,;:!?"
_PLACEHOLDER = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], np.uint64)
#: Distinct words that a worker remembers.
_CACHE = 1 << 20
#: Readings of a text: words at the start of sentences as literals, and as names.
READINGS = (0, 1)
_SALTS = (0, 0x5851F42D4C957F2D)
#: A further reading: all words as they are.
VERBATIM, _VERBATIM_SALT = 2, 0x14057B7EF767814F
#: Bits of the filter that keeps windows no item has from being shuffled: 512 KB for any benchmark.
FILTER_BITS = 22


class _Words(dict):
    """A word's literal hash (upper bits) with its kind and flags (lowest five bits)."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHE:
            self.clear()
        text = word.decode("utf-8", "replace")
        core = _EDGES.sub("", text)
        lowered = core.lower()
        money = _MONEY.fullmatch(text.strip(_POINTS))
        if not core:
            core = lowered = text.strip(_POINTS)
            value = _EMPTY | (_SIGN if core else 0)
        elif lowered in _NUMBER_SET or (core[0].isdigit() or money) and _NUMBER.fullmatch(lowered):
            value = _NUM
        elif lowered in _UNIT_SET:
            value = _UNIT
        else:
            value = _LITERAL | (_CAPITAL if len(core) > 1 and core[0].isupper() and not core.isupper() else 0)
        if text.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":"):
            value |= _ENDS
        value |= xxhash.xxh3_64_intdigest(lowered.encode()) >> 5 << 5
        self[word] = value
        return value


_NUMBER_SET, _UNIT_SET = frozenset(NUMBER_WORDS), frozenset(UNIT_WORDS)


def _packed(data: bytes, cache: _Words) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, and what the cache knows of them."""
    words = data.split()
    return words, np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


class Template:
    """Template tokens of a text: ``hashes``, ``kinds`` and where each token lies among the text's words.

    With ``named``, a capitalised word at the start of a sentence is a name.
    """

    def __init__(self, words: list[bytes], packed: np.ndarray, named: bool):
        self.words, self.salt = words, np.uint64(_SALTS[named])
        at = np.nonzero((packed & np.uint64(_EMPTY)) == 0)[0]
        packed = packed[at]
        flags = (packed & np.uint64(31)).astype(np.int64)
        begins = np.ones(len(at), bool)
        begins[1:] = (flags[:-1] & _ENDS) > 0
        kinds = flags & 3
        kinds[(kinds == _LITERAL) & ((flags & _CAPITAL) > 0) & (named | ~begins)] = _NAME
        merged = np.zeros(len(at), bool)
        merged[1:] = (kinds[1:] == _NAME) & (kinds[:-1] == _NAME) & ~begins[1:]
        heads = np.nonzero(~merged)[0]
        self.first, self.kinds = at[heads], kinds[heads]
        self.stop = np.concatenate((at[heads[1:] - 1] + 1, at[-1:] + 1)) if len(heads) else at
        self.hashes = np.where(self.kinds == _LITERAL, packed[heads] >> np.uint64(5), _PLACEHOLDER[self.kinds])

    def windows(self, size: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the windows with enough literal words."""
        n = len(self.hashes)
        if n < size:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        known = np.concatenate(([0], np.cumsum(self.kinds == _LITERAL)))
        at = np.nonzero(known[size:] - known[:-size] >= literals)[0]
        return at, rolling(self.hashes, size)[at] ^ np.uint64(size) ^ self.salt

    def slots(self, at: int, size: int) -> list[str]:
        """``offset kind value`` of the placeholders in a window."""
        found = []
        for i in np.nonzero(self.kinds[at : at + size])[0].tolist():
            words = self.words[self.first[at + i] : self.stop[at + i]]
            value = " ".join(_EDGES.sub("", w.decode("utf-8", "replace")).lower() for w in words)
            found.append(f"{i} {_KINDS[self.kinds[at + i]]} {value}")
        return found


class Verbatim:
    """The lower-cased words of a text without the signs around them, and signs that stand alone."""

    def __init__(self, packed: np.ndarray):
        flags = packed & np.uint64(_EMPTY | _SIGN)
        self.hashes = packed[flags != np.uint64(_EMPTY)] >> np.uint64(5)

    def windows(self, size: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all windows."""
        n = len(self.hashes) - size + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.arange(n), rolling(self.hashes, size) ^ np.uint64(size) ^ np.uint64(_VERBATIM_SALT)

    def slots(self, at: int, size: int) -> list[str]:
        return []


def _windows(rows: DataFrame, size_of, literals: int, bits: np.ndarray | None) -> DataFrame:
    """(key, crc, text) to (key, crc, reading, pos, size, total, hash, slots); ``bits`` filters the hashes.

    ``size_of`` gives the sizes of the windows for a reading and a number of tokens.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in portions(batches, "text"):
            out: list[tuple] = []
            for i, data in enumerate(bytes_of(batch, "text")):
                words, packed = _packed(data, cache)
                for reading in (*READINGS, VERBATIM):
                    template = Verbatim(packed) if reading == VERBATIM else Template(words, packed, reading == 1)
                    for size in size_of(reading, len(template.hashes)):
                        at, hashes = template.windows(size, literals)
                        total = len(at)
                        if bits is not None and total:
                            cell = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                            passed = bits[cell >> 3] >> (cell & 7) & 1 > 0
                            at, hashes = at[passed], hashes[passed]
                        for p, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
                            out.append((i, reading, p, size, total, h, template.slots(p, size)))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            row, *rest = (pa.array(c, k) for c, k in zip(columns, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *rest], ["key", "crc", "reading", "pos", "size", "total", "hash", "slots"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, crc long, reading int, pos long, size int, total long, hash long, slots array<string>")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = 8,
    literals: int = 4,
    coverage: float = 0.5,
) -> DataFrame:
    """(key, crc, item, covered, changed): documents that hold an item, the share of its windows that they hold,
    and the number of its slots with another value than in the item. ``crc`` is ``text_key`` of the document.
    """
    items = require(benchmark, item, item_text).select(F.col(f"`{item}`").alias("key"), F.lit(0).cast("long").alias("crc"), F.col(f"`{item_text}`").alias("text"))
    least = lambda reading: 1 if reading == VERBATIM else literals
    own = _windows(items, lambda r, n: [size] if n >= size else [n] if n >= least(r) else [], literals, None).distinct()
    # The filter has a fixed size; the lengths of short items are fewer than ``size``.
    cells = own.select(F.expr(f"shiftrightunsigned(hash, {64 - FILTER_BITS})").alias("cell")).distinct().collect()
    sizes: dict[int, list[int]] = {}
    for reading, n in own.select("reading", "size").distinct().collect():
        sizes.setdefault(reading, []).append(n)
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for (cell,) in cells:
        bits[cell >> 3] |= 1 << (cell & 7)
    rows = require(docs, key, text).select(F.col(f"`{key}`").alias("key"), text_key(text).alias("crc"), F.col(f"`{text}`").alias("text"))
    theirs = _windows(rows, lambda r, n: [s for s in sizes.get(r, ()) if s <= n], literals, bits).drop("total", "size").distinct()
    own = own.select(F.col("key").alias("item"), "reading", F.col("pos").alias("item_pos"), "total", "hash", F.col("slots").alias("item_slots"))
    pairs = F.transform(
        F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")),
        lambda z: F.struct(
            (F.substring_index(z["i"], " ", 1).cast("long") + F.col("item_pos")).alias("at"),
            F.regexp_replace(z["i"], r"^\d+ ", "").alias("i"),
            F.regexp_replace(z["d"], r"^\d+ ", "").alias("d"),
        ),
    )
    met = theirs.join(own, ["hash", "reading"]).select("key", "crc", "item", "reading", "total", "item_pos", (F.col("pos") - F.col("item_pos")).alias("diagonal"), pairs.alias("pairs"))
    lines = met.groupBy("key", "crc", "item", "reading", "total", "diagonal").agg(
        F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs")
    )
    values = lambda *names: F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(*[p[n].alias(n) for n in names]))))
    consistent = (values("i", "d") == values("i")) & (values("i", "d") == values("d"))
    changed = F.size(F.filter("pairs", lambda p: p["i"] != p["d"]))
    sound = lines.filter(consistent).select("key", "crc", "item", "reading", "total", F.explode("at").alias("at"), changed.alias("changed"))
    whole = sound.groupBy("key", "crc", "item", "reading", "total").agg(F.count_distinct("at").alias("n"), F.max("changed").cast("long").alias("changed"))
    found = whole.filter(F.col("n") >= coverage * F.col("total")).withColumn("covered", F.col("n") / F.col("total"))
    # Of several readings the one that covers most counts, then the one with the fewest changes.
    best = found.groupBy("key", "crc", "item").agg(F.max(F.struct("covered", (-F.col("changed")).alias("kept"))).alias("best"))
    return best.select(F.col("key").alias(key), "crc", F.col("item").alias(item), "best.covered", (-F.col("best.kept")).alias("changed"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    found = contaminated(docs, benchmark, key, text, **options).select(F.col(key).alias("_key"), F.col("crc").alias("_crc")).distinct()
    return docs.join(found, F.col(key).eqNullSafe(F.col("_key")) & (text_key(text) == F.col("_crc")), "left_anti")
