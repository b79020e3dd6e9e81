"""Near-duplicate documents: 64-bit SimHash fingerprints, a binary trie self-join, connected components.

Null texts and texts without a word have fingerprint zero and are linked like any other. Rows with a null
document id take part but never name a component, unless nothing else is in it (the id is null then).
Repeated rows share fingerprint and component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrain.llm.components import star_components
from wiregrain.llm.rows import bytes_of, portions, released, require, text_key
from wiregrain.session import Scratch

#: Shingles whose bits are counted at a time.
_BLOCK = 1 << 15
#: Node pairs of the trie that are expanded at a time.
_FRONTIER = 1 << 17
#: A node pair with no more leaf pairs than this is compared leaf by leaf.
_LEAF_PAIRS = 64
#: Fingerprints that one traversal holds; larger bands are cut into node pairs first.
HELD = 1 << 21
#: Levels of the trie by which an overfull band is cut.
_CUT_BITS = 6


def simhash(data: bytes, words: int = 4, seed: int = 42) -> int:
    """Bits set in more than half of the XXH64 hashes of a text's word shingles, as an unsigned integer."""
    import xxhash

    found = data.lower().split()  # bytes: only A-Z change, only ASCII white space divides
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) > words:
        starts, ends = starts[: -(words - 1) or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        hashes = np.array(
            [
                digest(joined[a:b], seed)
                for a, b in zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist(), strict=True)
            ],
            "<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """Key and fingerprint (as a signed long) of every row."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text):
            prints = np.array([simhash(x, words) for x in bytes_of(batch, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["key", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return require(docs, key, text).mapInArrow(run, f"key {kind}, fingerprint long").withColumnRenamed("key", key)


class _Labels:
    """Component labels of the leaves of one trie."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._runs()

    def _runs(self) -> None:
        self.changes = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1]))) if len(self.label) else self.label

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the components of a[i] and b[i]; a label is always the smallest leaf of its component."""
        label = self.label
        while len(a):
            a, b = label[a], label[b]
            differ = a != b
            a, b = a[differ], b[differ]
            if not len(a):
                break
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            while True:  # pointer jumping
                further = label[label]
                if np.array_equal(further, label):
                    break
                label[:] = further
            a, b = low, high
        self._runs()

    def settled(self, alo, ahi, blo, bhi) -> np.ndarray:
        """Node pairs whose leaves are all in one component already."""
        flat = (self.changes[ahi - 1] == self.changes[alo]) & (self.changes[bhi - 1] == self.changes[blo])
        return flat & (self.label[alo] == self.label[blo])


def trie_links(prints: np.ndarray, roots: np.ndarray, first_bit: np.ndarray, budget: int) -> np.ndarray:
    """Component labels of sorted fingerprints, by a self-join of the binary tries they form.

    A trie node is a range of the sorted array. The ranges between ``roots`` are tries of their own, each joined
    with itself from bit ``first_bit`` (0: the highest) on. Node pairs go down together: equal branches keep their
    count of differing bits, unequal branches add one, and a pair over the budget is pruned. A pair whose leaves
    all are in one component has nothing to add and is pruned too, so a dense group costs no pair of its members.
    """
    n = len(prints)
    labels = _Labels(n)
    if n < 2:
        return labels.label
    root_of = np.repeat(np.arange(len(roots) - 1), np.diff(roots))
    for step in (1, 2, 3):  # neighbours in order are most often close: links from the start
        if n > step:
            near = (np.bitwise_count(prints[step:] ^ prints[:-step]) <= budget) & (root_of[step:] == root_of[:-step])
            at = np.nonzero(near)[0]
            labels.union(at, at + step)
    ones: dict[int, np.ndarray] = {}

    def below(bit: int) -> np.ndarray:
        if bit not in ones:
            if len(ones) > 4:
                ones.clear()
            set_bit = (prints >> np.uint64(63 - bit)) & np.uint64(1)
            ones[bit] = np.concatenate(([0], np.cumsum(set_bit.astype(np.int64))))
        return ones[bit]

    stack = []
    for bit in np.unique(first_bit):
        own = np.nonzero(first_bit == bit)[0]
        lo, hi = roots[:-1][own], roots[1:][own]
        stack.append((int(bit), lo, hi, lo, hi, np.zeros(len(lo), np.int8)))
    while stack:
        bit, alo, ahi, blo, bhi, diff = stack.pop()
        keep = ~labels.settled(alo, ahi, blo, bhi)
        alo, ahi, blo, bhi, diff = (x[keep] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        if len(alo) > _FRONTIER:
            half = len(alo) // 2
            stack.append((bit, *(x[half:] for x in (alo, ahi, blo, bhi, diff))))
            stack.append((bit, *(x[:half] for x in (alo, ahi, blo, bhi, diff))))
            continue
        pairs = (ahi - alo) * (bhi - blo)
        leaf = (pairs <= _LEAF_PAIRS) | (bit >= 64)
        if leaf.any():
            _compare(prints, labels, alo[leaf], ahi[leaf], blo[leaf], bhi[leaf], budget)
            alo, ahi, blo, bhi, diff = (x[~leaf] for x in (alo, ahi, blo, bhi, diff))
            if not len(alo):
                continue
        c = below(bit)
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        self_pair = alo == blo
        children = (
            (alo, amid, blo, bmid, diff, slice(None)),
            (amid, ahi, bmid, bhi, diff, slice(None)),
            (alo, amid, bmid, bhi, diff + 1, slice(None)),
            (amid, ahi, blo, bmid, diff + 1, ~self_pair),
        )
        parts = []
        for p, q, r, s, d, where in children:
            p, q, r, s, d = p[where], q[where], r[where], s[where], d[where]
            alive = (q > p) & (s > r) & (d <= budget)
            parts.append([x[alive] for x in (p, q, r, s, d)])
        stack.append((bit + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))
    return labels.label


def _compare(prints, labels, alo, ahi, blo, bhi, budget) -> None:
    """Compare the leaves of node pairs, a bounded number of leaf pairs at a time."""
    most = 1 << 21
    width = bhi - blo
    sizes = (ahi - alo) * width
    total = np.cumsum(sizes)
    for begin in range(0, int(total[-1]), most):
        ids = np.arange(begin, min(begin + most, int(total[-1])))
        pair = np.searchsorted(total, ids, side="right")
        inside = ids - (total[pair] - sizes[pair])
        a, b = alo[pair] + inside // width[pair], blo[pair] + inside % width[pair]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= budget
        if near.any():
            labels.union(a[near], b[near])


def _bands(budget: int) -> list[tuple[int, int]]:
    """First bit and width of budget + 1 bands of a fingerprint; two close fingerprints agree on one of them."""
    edges = [round(i * 64 / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def near_links(prints: DataFrame, budget: int = 4, held: int = HELD) -> DataFrame:
    """Links (src, dst) that connect all fingerprints within ``budget`` differing bits of each other.

    Fingerprints at most ``budget`` bits apart agree on at least one of ``budget + 1`` bands of bits. For each
    band the fingerprints are rotated so that the band leads; those that share it are one trie, joined with
    itself. A band value with more than ``held`` fingerprints is cut: its node pairs of the next six levels
    that are within the budget become tries of their own. Only links of a spanning forest come out.
    """
    bands = _bands(budget)
    rotated = lambda at: (
        F.shiftleft("fingerprint", at).bitwiseOR(F.shiftrightunsigned("fingerprint", 64 - at)) if at else F.col("fingerprint")
    )
    rows = prints.select(
        "fingerprint",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("band"), F.lit(w).alias("width"), rotated(a).alias("turned")) for i, (a, w) in enumerate(bands)])
        ).alias("b"),
    ).select("b.*")
    rows = rows.withColumn("slot", F.expr("shiftrightunsigned(turned, 64 - width)"))
    full = rows.groupBy("band", "slot").count().filter(F.col("count") > held).select("band", "slot", F.lit(True).alias("full"))
    rows = rows.join(full, ["band", "slot"], "left")
    node = F.expr(f"cast(shiftrightunsigned(shiftleft(turned, width), {64 - _CUT_BITS}) as int)")
    partners = F.filter(
        F.sequence(F.lit(0), F.lit((1 << _CUT_BITS) - 1)), lambda v: F.bit_count(v.bitwiseXOR(F.col("node"))) <= budget
    )
    task = lambda v: F.least(F.col("node"), v) * (1 << _CUT_BITS) + F.greatest(F.col("node"), v)
    rows = rows.withColumn("node", node).select(
        "band",
        "width",
        "turned",
        "slot",
        F.explode(F.when(F.col("full"), F.transform(partners, task)).otherwise(F.array(F.lit(-1)))).alias("task"),
    )
    order = F.col("turned").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    dealt = rows.repartition("band", "slot", "task").withColumn("order", order).sortWithinPartitions("band", "slot", "task", "order")
    starts = [a for a, _ in bands]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, width, turned, roots in _whole_tries(batches, held):
            label = trie_links(turned, roots, width[roots[:-1]], budget)
            own = np.nonzero(label != np.arange(len(label)))[0]
            shift = np.array(starts, np.uint64)[band[own]]
            back = lambda x: np.where(shift == 0, x, (x >> shift) | (x << ((np.uint64(64) - shift) & np.uint64(63)))).view(np.int64)  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays([pa.array(back(turned[own])), pa.array(back(turned[label[own]]))], ["src", "dst"])

    return dealt.select("band", "width", "slot", "task", "turned").mapInArrow(run, "src long, dst long").distinct()


def _whole_tries(batches: Iterator[pa.RecordBatch], held: int):
    """Rows of sorted batches in chunks that end where a trie ends."""
    kept: list[np.ndarray] = []
    rows = 0

    def ready(table: np.ndarray):
        band, width, slot, task, turned = table
        starts = np.nonzero((np.diff(band) != 0) | (np.diff(slot) != 0) | (np.diff(task) != 0))[0] + 1
        return band, width, turned.view(np.uint64), np.concatenate(([0], starts, [len(band)]))

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        rows += batch.num_rows
        if rows >= held:
            table = np.concatenate(kept, axis=1)
            band, width, turned, roots = ready(table)
            cut = int(roots[-2])
            if cut:
                yield band[:cut], width[:cut], turned[:cut], roots[:-1]
            kept, rows = [table[:, cut:]], len(band) - cut
    if rows:
        yield ready(np.concatenate(kept, axis=1))


def components(prints: DataFrame, scratch: Scratch, key: str = "doc_id", budget: int = 4) -> DataFrame:
    """Fingerprint and ``component_id``: the smallest key of all rows it is linked with, directly or through others."""
    first = scratch.settle(prints.groupBy("fingerprint").agg(F.min(key).alias("first")))
    stars = star_components(near_links(first, budget), scratch)
    member = first.join(stars.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left")
    member = member.withColumn("root", F.coalesce("root", "fingerprint"))
    named = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return member.join(named, "root").select("fingerprint", "component_id")


def near_duplicates(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", words: int = 4, budget: int = 4) -> DataFrame:
    """Key, fingerprint and component of every row."""
    prints = scratch.settle(fingerprints(docs, key, text, words))
    return prints.join(components(prints, scratch, key, budget), "fingerprint").select(key, "fingerprint", "component_id")


def keep_one(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", words: int = 4, budget: int = 4) -> DataFrame:
    """One row of each component, that with the smallest id (null first) and text checksum, with all its columns."""
    keyed = docs.withColumn("_near", F.struct(F.col(f"`{key}`").alias("id"), text_key(text).alias("crc")))
    found = near_duplicates(keyed, scratch, "_near", text, words, budget)
    first = found.select(F.col("component_id").alias("_first")).distinct()
    # Rows with equal id and text are one document.
    return keyed.join(first, F.col("_near").eqNullSafe(F.col("_first"))).dropDuplicates(["_near"]).drop("_near", "_first")
