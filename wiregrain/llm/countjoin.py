"""Similarity join of word n-gram sets by the Jaccard similarity, exact, over trees of group counts.

A document is the set of its distinct ``words``-word shingles (A-Z lower-cased; a shorter text is one shingle). Two
documents are linked when ``100 * intersection >= percent * union``. Shingles are hashed into groups, and the counts of the
groups are the document's point: the overlap of two sets is at most the sum of the smaller coordinates of their points.

* **Directory.** Two linked sets differ in at most ``d`` shingles. Dealt into more than ``d`` groups, they agree in the
  whole content of some group, so documents meet in cells: sets of one size band with one group's content. Sets for
  which all agreeing groups could be empty ones are dealt again by another hash, so that no link is lost. Bands overlap
  where partners can be larger.
* **Stars.** In each cell every set is first paired with one only. Pairs that pass the bound of summed minima are checked
  on the whole sets and connected, so that a large group of near copies costs one pair for each member, not all pairs.
* **Bundles.** Cells that still hold more than one component are put together by the member with the smallest hash: two
  cells meet with the probability of their Jaccard similarity, so a group of near copies, which meets in a cell for each
  group that its members agree in, is joined about once, and cells that have little in common stay apart.
* **R-trees.** Bundles become pages of an R-tree: sorted by size, with the largest coordinates, sizes and components of
  their points, folded to a quarter, as bounding box. Page pairs, then nodes inside pages, then points go on only if the
  summed minima of their boxes reach the overlap that their sizes need and more than one component is left; pairs of points
  then also by all their coordinates, which leaves few that are not links.
  First every point is paired with its ``BEST`` nearest partners of each page only, which connects nearly all of a large
  group of near copies; then all pairs that are still in different components follow.
* **Check.** Surviving pairs are compared on their whole sets of 64-bit shingle hashes.

Equal sets are one class, told by 128 bits. Texts null, empty or without a word have the empty set and are linked with
nothing. Repeated rows are linked with each other. Rows with a null key take part and never name a component, unless
nothing else is in it. An empty table gives an empty result. Other columns are not read. A very long text is one row of
one task; its points have at most 65,536 coordinates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiregrain.llm.components import star_components
from wiregrain.llm.rows import bytes_of, portions, released, require
from wiregrain.session import Scratch

#: Sizes of one band differ by less than this factor; larger bands mean smaller groups, smaller bands more overlap.
_BAND = 1.5
#: Hash functions by which a set is dealt at most.
_ROUNDS = 8
#: Coordinates of a point at most.
_COORDINATES = 1 << 16
#: Times as many coordinates as boxes have: with a quarter of a shingle in each, few pairs pass that are no links.
_FINE = 4
#: Rows of a cell from which its first member is found by an aggregation of its own, at least, and how many such cells
#: there are at most, about: the limit grows with the table, the list does not.
_HOT_ROWS = 4096
_HOT_CELLS = 100_000
#: Points and bytes of points of a page, and children of a node.
PAGE_ROWS = 1024
#: Partners of a point in one page that are tried before all others.
BEST = 4
_PAGE_BYTES = 2 << 20
_FANOUT = 8
#: Pairs that are compared at a time, in bytes of points.
_STEP = 4 << 20
#: Pairs with one source that meet in one task.
_PAIRS = 5000

#: Bytes of text whose shingles a worker holds at a time.
_TEXT_BYTES = 2 << 20
#: Rows of ids that are broadcast at most, some ten bytes each.
_BROADCAST_ROWS = 2_000_000

_U = np.uint64


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well mixed 64-bit permutation of unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x + _U(seed)) * _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def shingles(data: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle."""
    import xxhash

    found = data.lower().split()  # bytes: only A-Z change, only ASCII white space divides
    if not found:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    word = np.fromiter((digest(w) for w in found), np.uint64, len(found))
    width = min(words, len(word))
    hashes = _mix(word[: len(word) - width + 1], width)
    for i in range(1, width):
        hashes = _mix(hashes ^ word[i : len(word) - width + 1 + i], i)
    return np.unique(hashes)


def _edges(largest: int) -> np.ndarray:
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] * _BAND)))
    return np.array([*edges, edges[-1] * 4])


_EDGES = _edges(1 << 40)


def _allowed(total: np.ndarray | int, percent: int):
    """Shingles in which two linked sets with ``total`` shingles together differ at most."""
    return total * (100 - percent) // (100 + percent)


@cache
def _groups(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each band the differences allowed and the number of groups: so many that sets leave few enough of them empty
    for a group that agrees to have content nearly always, twice the differences at most."""
    differ = _allowed(2 * (_EDGES[1:] - 1), percent)
    least = np.maximum(_EDGES[:-1] * percent // 100, 1)
    groups = differ + 2
    for _ in range(200):
        short = (groups * -np.expm1(-least / groups) < 1.03 * differ + 2) & (groups < 2 * differ)
        groups = np.where(short, groups + groups // 100 + 1, groups)
    return differ, groups


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and 64-bit signature of the cells of every set, in order of owners."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    begin = np.cumsum(sizes) - sizes
    band = np.searchsorted(_EDGES, sizes, "right") - 1
    owners, found = [], []
    reach = sizes * 100 // percent  # the largest partner
    allowed, wanted = _groups(percent)
    own = np.nonzero(sizes > 0)[0]
    while len(own):
        # Sets that differ in nothing are one class already.
        dealt = own[allowed[band[own]] > 0]
        differ, groups = allowed[band[dealt]], wanted[band[dealt]]
        for turn in range(_ROUNDS):
            if not len(dealt):
                break
            offset = np.cumsum(groups) - groups
            n = sizes[dealt]
            at = np.repeat(begin[dealt] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hashes = every[at]
            slot = np.repeat(offset, n) + (_mix(hashes, 77 + turn) % np.repeat(groups, n).astype(np.uint64)).astype(np.int64)
            count = np.bincount(slot, minlength=int(groups.sum()))
            content = np.zeros(len(count), np.uint64)
            np.add.at(content, slot, _mix(hashes, 1001))
            of = np.repeat(np.arange(len(dealt)), groups)
            empty = np.bincount(of[count == 0], minlength=len(dealt))
            again = empty >= groups - differ  # all agreeing groups could be empty ones
            kept = (count > 0) | (again[of] & (turn == _ROUNDS - 1))
            code = (band[dealt][of] << 44 | turn << 40 | (np.arange(len(of)) - offset[of])).astype(np.uint64)
            found.append(_mix(content[kept] ^ _mix(code[kept], 5)))
            owners.append(dealt[of[kept]])
            dealt, differ, groups = dealt[again], differ[again], groups[again]
        band[own] += 1
        own = own[reach[own] >= _EDGES[band[own]]]
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    owner, signature = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return owner[order], signature[order]


def point(hashes: np.ndarray) -> bytes:
    """Group counts of a set, half a byte each; twice as large sets have twice as many coordinates.

    Groups are the low bits of a hash, so a point is folded to fewer coordinates by adding its halves.
    """
    width = min(_FINE << max(int(len(hashes)).bit_length() - 2, 3), _COORDINATES)
    counts = np.bincount((_mix(hashes, 3) & _U(width - 1)).astype(np.int64), minlength=width)
    counts = np.minimum(counts, 15).astype(np.uint8)
    return (counts[: width // 2] << 4 | counts[width // 2 :]).tobytes()


def _matrix(points: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
    """Points with ``width`` coordinates each, and one more for what half a byte could not count."""
    out = np.empty((len(points), width + 1), np.int32)
    for i, packed in enumerate(points):
        own = np.frombuffer(packed, np.uint8)
        own = np.concatenate((own >> 4, own & 15))
        out[i, :-1] = own.reshape(-1, width).sum(axis=0, dtype=np.int32)
    out[:, -1] = sizes - out[:, :-1].sum(axis=1)
    return out


def _width(points: Iterable[bytes]) -> int:
    """Coordinates that all these points can be folded to."""
    return 2 * min(map(len, points))


def _enough(bound: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of ``bound`` links sets with ``total`` shingles together."""
    return bound * (100 + percent) >= percent * total


class Tree:
    """R-tree of the points of one page: per level the largest coordinates, smallest sizes and components of its nodes.

    ``fine`` are the points with more coordinates, by which pairs of leaves are compared once more.
    """

    def __init__(self, sizes: np.ndarray, points: np.ndarray, roots: np.ndarray, fine: np.ndarray | None = None):
        self.fine = fine
        self.levels = [(points, sizes, sizes, roots, roots)]
        while len(self.levels[-1][0]) > 1:
            top, least, most, low, high = self.levels[-1]
            at = np.arange(0, len(top), _FANOUT)
            self.levels.append(
                (np.maximum.reduceat(top, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at))
            )


def tree_pairs(one: Tree, two: Tree, percent: int, best: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Leaves (i, j) of two trees with different components whose summed minima allow a link; i < j if it is one tree.

    With ``best`` only the pairs are given that are among the nearest so many of one of their leaves.
    """
    same = one is two
    while len(one.levels) < len(two.levels):
        one.levels.append(one.levels[-1])
    while len(two.levels) < len(one.levels):
        two.levels.append(two.levels[-1])
    a = b = np.zeros(1, np.int64)
    for level in range(len(one.levels) - 1, -1, -1):
        p, q = one.levels[level], two.levels[level]
        if level < len(one.levels) - 1:
            a, b = _children(a, len(p[0]), len(one.levels[level + 1][0])), _children(b, len(q[0]), len(two.levels[level + 1][0]))
            a, b = _product(a, b)
        keep = (p[1][a] * percent <= 100 * q[2][b]) & (q[1][b] * percent <= 100 * p[2][a])
        keep &= (p[3][a] != p[4][a]) | (q[3][b] != q[4][b]) | (p[3][a] != q[3][b])
        if same:
            keep &= (a < b) if level == 0 else (a <= b)
        a, b = a[keep], b[keep]
        a, b, near = _near(a, b, (p[0], p[1]), (q[0], q[1]), percent)
    if one.fine is not None:
        a, b, near = _near(a, b, (one.fine, one.levels[0][1]), (two.fine, two.levels[0][1]), percent)
    if best is not None:
        first = (_ranked(a, near) < best) | (_ranked(b, near) < best)
        a, b = a[first], b[first]
    return a, b


def _near(a: np.ndarray, b: np.ndarray, one: tuple, two: tuple, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs whose summed minima allow a link, and how near they are; ``one`` and ``two``: points and sizes."""
    fits, near = np.empty(len(a), bool), np.empty(len(a))
    step = max(_STEP // (4 * one[0].shape[1]), 1)
    for at in range(0, len(a), step):
        x, y = a[at : at + step], b[at : at + step]
        bound, total = np.minimum(one[0][x], two[0][y]).sum(axis=1, dtype=np.int64), one[1][x] + two[1][y]
        fits[at : at + step], near[at : at + step] = _enough(bound, total, percent), bound / total
    return a[fits], b[fits], near[fits]


def _ranked(leaf: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Place of each pair among those of its leaf, the nearest first."""
    order = np.lexsort((-near, leaf))
    head = np.concatenate(([True], np.diff(leaf[order]) != 0))[: len(order)]
    start = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - start
    return rank


def _children(nodes: np.ndarray, below: int, above: int) -> tuple[np.ndarray, np.ndarray]:
    """First child and number of children of each node."""
    if below == above:  # a level repeated to reach the height of the other tree
        return nodes, np.ones(len(nodes), np.int64)
    first = nodes * _FANOUT
    return first, np.minimum(first + _FANOUT, below) - first


def _product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = a[1] * b[1]
    of = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a[0][of] + inside // b[1][of], b[0][of] + inside % b[1][of]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _described(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, text) to (key, d1, d2, size, cells, point)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", _TEXT_BYTES):
            sets = [shingles(x, words) for x in bytes_of(batch, "text")]
            digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            owner, signature = signatures(sets, percent)
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(sets)))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(digests[:, 0].copy()),
                    pa.array(digests[:, 1].copy()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _long(signature)),
                    pa.array([point(s) for s in sets], pa.binary()),
                ],
                ["key", "d1", "d2", "size", "cells", "point"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, d1 long, d2 long, size long, cells array<long>, point binary")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """(cid, text) to (cid, shingles as bytes)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", _TEXT_BYTES):
            found = [shingles(x, words).tobytes() for x in bytes_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["cid", "shingles"])

    return rows.mapInArrow(run, "cid long, shingles binary")


def _small(table: DataFrame) -> DataFrame:
    """A settled table of ids, broadcast if it is counted to be small; else Spark joins it by its key."""
    return F.broadcast(table) if table.count() <= _BROADCAST_ROWS else table


def _sizes_fit(n: str, m: str, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (src, dst) whose summed minima allow a link."""
    met = pairs.join(points.toDF("src", "n", "p"), "src").join(points.toDF("dst", "m", "q"), "dst")
    met = met.filter(_sizes_fit("n", "m", percent)).select("src", "dst", "n", "m", "p", "q")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                width = _width((p, q))
                x, y = _matrix([p], n[i : i + 1], width)[0], _matrix([q], m[i : i + 1], width)[0]
                keep[i] = _enough(np.minimum(x, y).sum(dtype=np.int64), n[i] + m[i], percent)
            yield batch.select(["src", "dst"]).filter(pa.array(keep))

    return met.mapInArrow(run, "src long, dst long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (src, dst) whose whole sets are similar enough.

    The set of a source goes to each task that has pairs of it once, not along with every pair; pairs of one source
    that exceed ``_PAIRS`` are dealt over several tasks.
    """
    many = pairs.groupBy("src").agg(F.ceil(F.count("*") / _PAIRS).alias("shares"))
    dealt = pairs.join(many, "src").select("src", "dst", F.pmod(F.xxhash64("dst"), "shares").alias("share"))
    heads = dealt.select("src", "share").distinct().join(sets.toDF("src", "shingles"), "src")
    tails = dealt.join(sets.toDF("dst", "shingles"), "dst")
    rows = heads.select("src", "share", F.lit(None).cast("long").alias("dst"), "shingles").union(tails.select("src", "share", "dst", "shingles"))
    rows = rows.repartition("src", "share").sortWithinPartitions("src", "share", F.asc_nulls_first("dst"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.uint64)
        for batch in batches:
            src, dst = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            hits: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column(3)[i].as_py(), np.uint64)
                if dst[i] is None:
                    held = own
                    continue
                at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                both = int((held[at] == own).sum())
                if 100 * both >= percent * (len(held) + len(own) - both):
                    hits.append((src[i], dst[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in hits], pa.int64()) for i in (0, 1)], ["src", "dst"])

    return rows.mapInArrow(run, "src long, dst long")


def _cells(described: DataFrame, copies: DataFrame, scratch: Scratch) -> DataFrame:
    """(cell, cid, first): the classes of every cell with two or more of them, and one of them for all.

    ``copies`` are the rows that do not name their class.
    """
    listed = described.select("row", F.explode("cells").alias("cell"))
    total = described.agg(F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()[0]
    limit = max(_HOT_ROWS, total // _HOT_CELLS)
    # Cells that stand in many rows, by a sample that steers only where their first class is looked for.
    sample = listed.filter(F.pmod(F.xxhash64("row"), F.lit(64)) == 0).groupBy("cell").count().filter(F.col("count") > limit // 128)
    # Rows of the sample divided by the count asked for: no more than about two hundred thousand cells.
    hot = scratch.settle(sample.select("cell"))
    own = described.join(copies, "row", "left_anti").select(F.col("row").alias("cid"), F.explode("cells").alias("cell"))
    cell = Window.partitionBy("cell")
    any_hot = not hot.isEmpty()
    cold = (own.join(F.broadcast(hot), "cell", "left_anti") if any_hot else own).select("cell", "cid", F.count("*").over(cell).alias("n"), F.min("cid").over(cell).alias("first"))
    cold = cold.filter("n > 1").select("cell", "cid", "first")
    if not any_hot:
        return cold
    # The smallest row of a class names it, so the smallest row of a cell is a class.
    firsts = scratch.settle(listed.join(F.broadcast(hot), "cell", "left_semi").groupBy("cell").agg(F.min("row").alias("first")))
    return cold.union(own.join(F.broadcast(firsts), "cell").select("cell", "cid", "first"))


def _paged(members: DataFrame, page_rows: int) -> DataFrame:
    """Members (cell, cid, root, size, point) with the page they are in, and a row with ``cid`` null for each page:
    its box (``point``: largest coordinates; sizes and components from and to)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def page(rows: list[tuple]) -> pa.RecordBatch:
            cells, cids, roots, sizes, points = zip(*rows, strict=True)
            width = _width(points) // _FINE
            top = _matrix(list(points), np.array(sizes), width).max(axis=0).astype("<i4").tobytes()
            number = cids[0]  # one of this cell in one page only
            box = (cells[0], number, None, min(roots), max(roots), min(sizes), max(sizes), top)
            out = [(c, number, i, r, r, s, s, p) for c, i, r, s, p in rows]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.binary() if at == 7 else pa.int64()) for at, x in enumerate(zip(*out, box, strict=True))],
                ["cell", "page", "cid", "low", "high", "least", "most", "point"],
            )

        held: list[tuple] = []
        weight = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != held[0][0] or len(held) >= page_rows or weight + len(row[4]) > _PAGE_BYTES):
                    yield page(held)
                    held, weight = [], 0
                held.append(row)
                weight += len(row[4])
        if held:
            yield page(held)

    # By ranges of cells and sizes: a large cell is cut over tasks, each task cuts what it has into pages.
    spread = members.repartitionByRange("cell", "size", "cid").sortWithinPartitions("cell", "size", "cid")
    kinds = "cell long, page long, cid long, low long, high long, least long, most long, point binary"
    return spread.select("cell", "cid", "root", "size", "point").mapInArrow(run, kinds)


def _page_pairs(boxes: DataFrame, percent: int) -> DataFrame:
    """(cell, page, other), each page with itself too, whose boxes allow a link of two components."""
    one = boxes.select("cell", *[F.col(c).alias(f"{c}_1") for c in ("page", "low", "high", "least", "most", "point")])
    two = boxes.select("cell", *[F.col(c).alias(f"{c}_2") for c in ("page", "low", "high", "least", "most", "point")])
    met = one.join(two, "cell").filter(
        (F.col("page_1") <= F.col("page_2"))
        & (F.col("least_1") * percent <= F.col("most_2") * 100)
        & (F.col("least_2") * percent <= F.col("most_1") * 100)
        & ((F.col("low_1") != F.col("high_1")) | (F.col("low_2") != F.col("high_2")) | (F.col("low_1") != F.col("low_2")))
    )

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = batch.column(3).to_numpy() + batch.column(4).to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = (np.frombuffer(batch.column(c)[i].as_py(), "<i4") for c in (5, 6))
                width = min(len(p), len(q)) - 1
                x, y = (v[:-1].reshape(-1, width).sum(axis=0) for v in (p, q))
                keep[i] = _enough(np.minimum(x, y).sum(dtype=np.int64) + min(p[-1], q[-1]), least[i], percent)
            yield batch.select([0, 1, 2]).filter(pa.array(keep)).rename_columns(["cell", "page", "other"])

    return met.select("cell", "page_1", "page_2", "least_1", "least_2", "point_1", "point_2").mapInArrow(run, "cell long, page long, other long")


def _tree_join(pages: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Pairs (src, dst) of different components in one cell that the trees of their pages let pass."""
    members = pages.filter("cid is not null").select("cell", "page", "cid", F.col("low").alias("root"), F.col("least").alias("size"), "point")
    units = _page_pairs(pages.filter("cid is null"), percent)
    left = units.join(members, ["cell", "page"]).select("cell", "page", "other", F.lit(0).alias("side"), "cid", "root", "size", "point")
    right = units.filter("page <> other").join(members.withColumnRenamed("page", "other"), ["cell", "other"])
    rows = left.union(right.select("cell", "page", "other", F.lit(1).alias("side"), "cid", "root", "size", "point"))
    rows = rows.repartition("cell", "page", "other").sortWithinPartitions("cell", "page", "other", "side", "size", "cid")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def join(rows: list[tuple]) -> pa.RecordBatch:
            width = _width(r[7] for r in rows)
            coarse = width // _FINE
            parts = [[r for r in rows if r[3] == side] for side in (0, 1)]
            ids, trees = [], []
            for part in parts:
                sizes = np.array([r[6] for r in part], np.int64)
                ids.append(np.array([r[4] for r in part], np.int64))
                fine = _matrix([r[7] for r in part], sizes, width)
                points = np.column_stack((fine[:, :-1].reshape(len(part), _FINE, coarse).sum(axis=1, dtype=np.int32), fine[:, -1]))
                trees.append(Tree(sizes, points, np.array([r[5] for r in part], np.int64), fine) if part else None)
            alone = trees[1] is None
            a, b = tree_pairs(trees[0], trees[0] if alone else trees[1], percent, best)
            x, y = ids[0][a], ids[0 if alone else 1][b]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["src", "dst"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield join(held)
                    held = []
                held.append(row)
        if held:
            yield join(held)

    return rows.mapInArrow(run, "src long, dst long").distinct()


def groups(rows: DataFrame, scratch: Scratch, words: int = 4, percent: int = 85, page_rows: int = PAGE_ROWS, seeds: DataFrame | None = None) -> DataFrame:
    """(key, text) to (key, size, root): equal roots for all rows of a component; empty sets have the root null.

    Keys must tell rows with different texts apart. ``seeds`` are pairs (key_1, key_2) that are checked first besides the
    stars; they save work where they are right and do no harm where not.
    """
    with Scratch(rows.sparkSession) as first:
        described = first.settle(_described(rows, words, percent).withColumn("row", F.monotonically_increasing_id()))
        full = described.filter("size > 0")
        classes = full.groupBy("d1", "d2").agg(F.min("row").alias("cid"))
        members = scratch.settle(full.select("key", "row", "d1", "d2", "size").join(classes, ["d1", "d2"]).select("key", "row", "size", "cid"))
        held = scratch.settle(_cells(full, _small(members.filter("row <> cid").select("row")), first))
        tried = held.filter("cid <> first").select(F.col("first").alias("src"), F.col("cid").alias("dst"))
        if seeds is not None:
            end = lambda i: members.select(F.col("key").alias(f"k{i}"), F.col("cid").alias(f"c{i}"))
            met = seeds.join(end(1), F.col("key_1").eqNullSafe(F.col("k1"))).join(end(2), F.col("key_2").eqNullSafe(F.col("k2")))
            tried = tried.union(met.filter("c1 <> c2").select(F.least("c1", "c2"), F.greatest("c1", "c2")))
        tried = scratch.settle(tried.distinct())
        near = scratch.settle(held.select("cid").union(tried.select("src")).union(tried.select("dst")).distinct())
        points = scratch.settle(described.select(F.col("row").alias("cid"), "size", "point").join(_small(near), "cid", "left_semi"))
        empty = scratch.settle(described.filter("size = 0").select("key", "size", F.lit(None).cast("long").alias("root")))

    def check(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("src").alias("cid")).union(pairs.select(F.col("dst").alias("cid"))).distinct()
        chosen = _small(scratch.settle(members.filter("row = cid").join(wanted, "cid", "left_semi").select("cid", F.col("key").alias("_key"))))
        own = rows.join(chosen, F.col("key").eqNullSafe(F.col("_key"))).select("cid", "text").dropDuplicates(["cid"])
        return scratch.settle(_verified(pairs, _sets(own, words), percent))

    links = check(scratch.settle(_bounded(tried, points, percent)))
    roots = star_components(links, scratch).withColumnRenamed("node", "cid")
    for best in (BEST, None):
        rooted = scratch.settle(held.select("cell", "cid").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")))
        # Cells with the same classes are one; of the others those with the same smallest hash are put together.
        sums = [F.sum(F.xxhash64("cid", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (0, 1)]
        state = rooted.groupBy("cell").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.min(F.xxhash64("cid", F.lit(2))).alias("bundle"), *sums
        )
        open_ = state.filter("low <> high").groupBy("n", "s0", "s1").agg(F.min("cell").alias("cell"), F.min("bundle").alias("bundle"))
        if best is None:  # in smaller bundles all pairs were among the best
            open_ = open_.join(wide, "bundle", "left_semi")
        bundled = rooted.join(open_.select("cell", "bundle"), "cell").select("bundle", "cid", "root").distinct()
        left = scratch.settle(bundled.join(points, "cid").select(F.col("bundle").alias("cell"), "cid", "root", "size", "point"))
        wide = left.groupBy(F.col("cell").alias("bundle")).count().filter(F.col("count") > BEST + 1).select("bundle")
        rest = _tree_join(scratch.settle(_paged(left, page_rows)), percent, best)
        rest = scratch.settle(rest.join(tried, ["src", "dst"], "left_anti"))
        links, tried = links.union(check(rest)), tried.union(rest)
        roots = star_components(links, scratch).withColumnRenamed("node", "cid")
    found = members.join(roots, "cid", "left").select("key", "size", F.coalesce("root", "cid").alias("root"))
    return found.union(empty)


def jaccard_groups(
    docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85, page_rows: int = PAGE_ROWS
) -> DataFrame:
    """Per row: key, ``n_shingles`` and ``component_id``, the smallest key of all that it is linked with."""
    keyed = require(docs, key, text).toDF("id", "text")
    keyed = keyed.select(F.struct("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("crc")).alias("key"), "text")
    found = scratch.settle(groups(keyed, scratch, words, percent, page_rows))
    named = found.filter("root is not null").groupBy("root").agg(F.min("key.id").alias("component_id"))
    out = found.join(named, "root", "left")
    own = F.when(F.col("root").isNull(), F.col("key.id")).otherwise(F.col("component_id"))
    return out.select(F.col("key.id").alias(key), F.col("size").alias("n_shingles"), own.alias("component_id"))
