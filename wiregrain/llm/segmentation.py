"""SentencePiece encoding by sampling without replacement, and decoding.

The lattice of a text holds every way to write it in pieces of a public model; characters without a piece of their
own are written as bytes. The model's piece ranks r give log-probabilities by Zipf's law, ``-log(r + 2.7)``, scaled by
``alpha`` and normalised over the lattice. The ``k`` segmentations with the largest Gumbel-perturbed log-probabilities are k
distinct samples without replacement. They are found by A-star search from above: the largest perturbed value of
all segmentations is drawn for the root and handed down; a sampled path leaves at each of its steps the set of
paths that part from it there, with a truncated Gumbel value; the set with the largest value is opened next.

Pieces never join a blank to what stands before it, so the lattice is a chain of word lattices. A worker
builds the lattice of each distinct word once, within a bound, and walks all words of many texts at the same time.

Random numbers come from the row's key and the seed alone: results do not depend on partitions or batches. As in the model's own
library, the sign that stands for a blank (U+2581) is read as a blank. Null and
empty texts have one empty segmentation. A text with fewer than k segmentations gives them all. Repeated rows give
equal samples; rows with a null key use one key.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable, Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from wiregrain.llm.rows import bytes_of, portions, released, require

_BLANK = "▁"
#: Characters that end a word of their own if no piece holds them.
_CONTROLS = "\n\t\r"
#: Nodes of word lattices that a worker keeps.
_NODES = 3 << 19
#: Characters of new words whose lattices are built at a time.
_BUILD = 1 << 15
#: Bytes of text that are walked at the same time.
_STEP_BYTES = 1 << 20
#: Rows that are decoded at the same time.
_DECODED_ROWS = 512
#: Bounds of Gumbel noise from numbers of 53 bits: log(-log(u)) at the smallest u, and the largest noise.
_LEAST_NOISE, _MOST_NOISE = 3.7, 37.5
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_NO_EDGES = np.empty(0, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0xD6E8FEB86659FD93)


def _prefix_hashes(text: str) -> list[int]:
    """Polynomial hashes of all beginnings of a text."""
    value, out = 0, []
    for c in text:
        value = (value * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
        out.append(value)
    return out


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((_mixed(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Pieces:
    """Pieces of a model: their text, bytes and log-probabilities."""

    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.of, self.byte_ids, self.raw, self.log_prob = {}, {}, [b""] * n, {}
        lowest = -alpha * math.log(n + 2.7)
        for i in range(n):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                self.raw[i] = bytes([int(text[3:5], 16)])
                self.log_prob[i] = lowest
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.of[text] = i
                self.raw[i] = text.replace(_BLANK, " ").encode()
                rank = -model.get_score(i)
                self.log_prob[i] = -alpha * math.log(rank + 2.7) if rank < n else lowest
        self.longest = max(map(len, self.of))
        crossing = any(_BLANK in p.lstrip(_BLANK) for p in self.of)
        alone = "".join(c for c in _CONTROLS if not any(c in p for p in self.of))
        parts = f"[{alone}]|" if alone else ""
        self.words = re.compile(r"(?s).+" if crossing else f"{parts}{_BLANK}*[^{_BLANK}{alone}]+|{_BLANK}+").findall

    def normalised(self, text: str) -> str:
        return _BLANK + text.replace(" ", _BLANK) if text else ""


class Lattices(dict):
    """First node of each word's lattice; nodes and edges of all words lie in common arrays (``table``)."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        beginnings: list[dict[int, int]] = [{} for _ in range(pieces.longest + 1)]
        for text, piece in pieces.of.items():
            hashes = _prefix_hashes(text)
            for length, value in enumerate(hashes, 1):
                if length == len(text):
                    beginnings[length][value] = piece
                else:
                    beginnings[length].setdefault(value, -1)
        #: For each length the sorted hashes of all beginnings of pieces, and the pieces (-1: no whole piece).
        self.known = {}
        for length, found in enumerate(beginnings):
            hashes = sorted(found)
            self.known[length] = np.array(hashes, np.uint64), np.array([found[h] for h in hashes], np.int32)
        self.scores = np.array([pieces.log_prob.get(i, 0.0) for i in range(len(pieces.raw))])
        self.byte_of = np.array([pieces.byte_ids[b] for b in range(256)], np.int32)
        self.byte_score = self.scores[pieces.byte_ids[0]]
        self.reset()

    def reset(self) -> None:
        self.clear()
        # ``met``: at the first node of a word, whether the word came again since it was built.
        kinds = {"first": np.int32, "met": bool, "reach": np.float32, "log": float, "rest": np.float32, "next": np.int32, "piece": np.int32}
        self.room = {k: np.empty(0, v) for k, v in kinds.items()}
        self.table = dict(self.room)  # the part that is in use

    def keep(self, kept: list[str]) -> None:
        """Only the lattices of these words stay, as they are."""
        old, nodes = (np.fromiter(map(f, kept), np.int64, len(kept)) for f in (self.__getitem__, len))
        bounds = np.append(self.table["first"], np.int32(len(self.table["next"])))
        edge = bounds[old].astype(np.int64)
        edges = bounds[old + nodes] - edge  # a word's nodes and their edges lie together
        new, new_edge = np.cumsum(nodes) - nodes, np.cumsum(edges) - edges
        every = np.arange(nodes.sum()) + np.repeat(old - new, nodes)
        self.table["first"] = (self.table["first"][every] - np.repeat(edge - new_edge, nodes)).astype(np.int32)
        self.table["met"] = np.zeros(len(every), bool)
        every = np.arange(edges.sum()) + np.repeat(edge - new_edge, edges)
        after = self.table["next"][every]
        self.table["next"] = np.where(after < 0, -1, after + np.repeat(new - old, edges)).astype(np.int32)
        for name in ("reach", "log", "rest", "piece"):
            self.table[name] = self.table[name][every]
        self.room = dict(self.table)
        self.clear()
        self.update(zip(kept, new.tolist(), strict=True))

    def nodes(self, words: list[list[str]]) -> list[np.ndarray]:
        """First nodes of the words of each text; new words are built, words met again are noted."""
        found = self._known(words)
        if len(self.table["first"]) > _NODES:
            self.make_room()
            found = self._known(words)
        gone = [np.nonzero(own < 0)[0].tolist() for own in found]
        new = [list(map(own.__getitem__, at)) for own, at in zip(words, gone, strict=True)]
        self.add(set().union(*new))
        for own, at, missed in zip(found, gone, new, strict=True):
            own[at] = np.fromiter(map(self.__getitem__, missed), np.int64, len(missed))
        return found

    def _known(self, words: list[list[str]]) -> list[np.ndarray]:
        """First nodes of the words of each text, -1 where they are not built."""
        found = [np.fromiter(map(self.get, own, repeat(-1)), np.int64, len(own)) for own in words]
        for own in found:
            self.table["met"][own[own >= 0]] = True
        return found

    def make_room(self) -> None:
        """Words that were met again since they were built stay, as far as they take half the room."""
        again = list(compress(self, self.table["met"][np.fromiter(self.values(), np.int64, len(self))].tolist()))
        if sum(map(len, again)) <= _NODES // 2:
            self.keep(again)
        else:
            self.reset()

    def add(self, words: Iterable[str]) -> None:
        """Build the lattices of new words."""
        parts = []
        nodes, edges = len(self.table["first"]), len(self.table["next"])
        ordered = sorted(words, key=len)  # words of like length make narrow tables
        ends = np.cumsum(np.fromiter(map(len, ordered), np.int64, len(ordered)))
        begin = done = 0
        while begin < len(ordered):
            end = min(int(ends.searchsorted(done + _BUILD)) + 1, len(ordered))
            parts.append(self._built(ordered[begin:end], nodes, edges))
            nodes, edges = nodes + len(parts[-1]["first"]), edges + len(parts[-1]["next"])
            begin, done = end, int(ends[end - 1])
        for name in self.table if parts else ():  # one array at a time is held twice
            own, new = self.table[name], [p.pop(name) for p in parts]
            size = len(own) + sum(map(len, new))
            if size > len(self.room[name]):
                self.room[name] = np.empty(size + size // 2, own.dtype)
                self.room[name][: len(own)] = own
            np.concatenate(new, out=self.room[name][len(own) : size])
            self.table[name] = self.room[name][:size]

    def _built(self, words: list[str], nodes: int, edges: int) -> dict[str, np.ndarray]:
        lengths = np.array([len(w) for w in words])
        begin = np.cumsum(lengths) - lengths
        self.update(zip(words, (begin + nodes).tolist(), strict=True))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n, longest = len(codes), min(self.pieces.longest, int(lengths.max()))
        left = np.repeat(begin + lengths, lengths) - np.arange(n)  # characters up to the word's end
        edges_of = []  # (first character, length, piece) of all pieces in all words
        at, rolled = np.arange(n), np.zeros(n, np.uint64)
        for length in range(1, longest + 1):
            inside = left[at] >= length
            at, rolled = at[inside], rolled[inside]
            rolled = rolled * _BASE + codes[at + (length - 1)] + np.uint64(1)
            hashes, ids = self.known[length]
            found = np.searchsorted(hashes, rolled)
            found[found == len(hashes)] = 0
            met = hashes[found] == rolled
            at, rolled, found = at[met], rolled[met], ids[found[met]]
            whole = found >= 0  # else only the beginning of pieces
            edges_of.append((at[whole], length, found[whole]))
        # Characters without a piece: one byte by its own piece, more than one as ``-2 - character``.
        single = np.zeros(n, bool)
        single[edges_of[0][0]] = True
        alone = np.nonzero(~single)[0]
        c = codes[alone].astype(np.int64)
        c[c == ord(_BLANK)] = 32
        c[(c >= 0xD800) & (c < 0xE000)] = ord("?")
        edges_of.insert(1, (alone, 1, np.where(c < 128, self.byte_of[np.minimum(c, 127)], -2 - c)))
        degree = np.bincount(np.concatenate([at for at, _, _ in edges_of]), minlength=n)  # every character has an edge
        first = np.cumsum(degree) - degree
        node = np.repeat(np.arange(n), degree)
        step, piece, free = np.empty(len(node), np.int64), np.empty(len(node), np.int64), first.copy()
        for at, length, found in edges_of:  # the edges of a node by their length
            place = free[at]
            step[place], piece[place] = length, found
            free[at] += 1
        score = self.scores[np.maximum(piece, 0)]
        score[first[alone]] = self.byte_score * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
        ends = step == left[node]
        # Nodes by their distance from the end of their word, and their edges one after the other.
        level = np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[level], np.arange(1, int(left.max()) + 2))
        width = degree[level]
        start = np.cumsum(width) - width
        own = np.repeat(first[level] - start, width) + np.arange(len(node))
        target = np.where(ends[own], n, node[own] + step[own])
        values, share = score[own], np.empty(len(node))
        through = np.zeros(n + 1)  # log of the sum over all ways from a node to its word's end
        bounds = np.append(start, len(node))
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin == end:
                continue
            some, at = slice(bounds[begin], bounds[end]), start[begin:end] - bounds[begin]
            value = values[some] + through[target[some]]
            top = np.maximum.reduceat(value, at)
            weight = np.exp(value - np.repeat(top, width[begin:end]))
            total = np.add.reduceat(weight, at)
            through[level[begin:end]] = whole = top + np.log(total)
            share[some] = weight / np.repeat(total, width[begin:end])
            values[some] = value - np.repeat(whole, width[begin:end])
        log, chance = np.empty(len(node)), np.empty(len(node))  # of each edge, given its node
        log[own], chance[own] = values, share
        # Sums up to each edge and from it on, by its place among those of its node.
        ahead, behind = chance.copy(), chance.copy()
        longer = np.nonzero(degree > 1)[0]
        for place in range(1, int(degree.max())):
            longer = longer[degree[longer] > place]
            x = first[longer] + place
            ahead[x] += ahead[x - 1]
            x = first[longer] + degree[longer] - 1 - place
            behind[x] += behind[x + 1]
        last = first + degree - 1
        rest = np.zeros(len(node))
        rest[1:] += ahead[:-1]
        rest[first] = 0.0
        after = np.append(behind[1:], 0.0)
        after[last] = 0.0
        rest += after
        ahead[last] = 1.0  # the last edge takes what rounding leaves
        with np.errstate(divide="ignore"):
            return {
                "first": (first + edges).astype(np.int32),
                "met": np.zeros(n, bool),
                "reach": ahead.astype(np.float32),
                "log": log,
                "rest": np.log(rest).astype(np.float32),
                "next": np.where(ends, -1, node + step + nodes).astype(np.int32),
                "piece": piece.astype(np.int32),
            }

    def ids(self, path: np.ndarray) -> np.ndarray:
        """Pieces along a path, characters without a piece as bytes."""
        found = self.table["piece"][path]
        odd = np.nonzero(found < 0)[0]
        if not len(odd):
            return found
        texts = {i: self.byte_of[list(chr(-2 - int(found[i])).encode())] for i in odd.tolist()}
        parts, at = [], 0
        for i, own in texts.items():
            parts += [found[at:i], own]
            at = i + 1
        return np.concatenate((*parts, found[at:]))


def _walk(table: dict, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Random ways from nodes to the ends of their words: all edges in order, and how many each way has."""
    active, at, step = np.arange(len(nodes)), nodes, 0
    taken, who = [], []
    while len(active):
        u = _uniform(keys[active] + np.uint64((step + 1) * int(_GOLDEN) & (1 << 64) - 1))
        edge = table["first"][at]
        more = np.nonzero(table["reach"][edge] <= u)[0]
        while len(more):  # the next edge of the node, until the sum of their probabilities exceeds u
            edge[more] += 1
            more = more[table["reach"][edge[more]] <= u[more]]
        taken.append(edge)
        who.append(active)
        after = table["next"][edge]
        going = after >= 0
        active, at, step = active[going], after[going], step + 1
    if not taken:
        return np.empty(0, np.int64), np.zeros(len(nodes), np.int64)
    counts = np.bincount(np.concatenate(who), minlength=len(nodes))
    offset = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    for i, (own, edge) in enumerate(zip(who, taken, strict=True)):
        out[offset[own] + i] = edge
    return out, counts


def _truncated(mass: np.ndarray, below: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Gumbel values at ``mass``, given that they are smaller than ``below``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(mass == -np.inf, -np.inf, mass - np.logaddexp(mass - below, np.log(-np.log(_uniform(keys)))))


class _Document:
    """The search of one text: its samples, and the open sets by falling perturbed value."""

    __slots__ = ("key", "words", "paths", "logs", "values", "open", "steps")

    def __init__(self, key: int, words: np.ndarray):
        self.key, self.words = key, words
        self.paths, self.logs, self.values, self.steps = [], [], [], []
        self.open: list[tuple] = []


def sample(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[_Document]:
    """Up to k samples of each text; ``open`` then holds what was not drawn, its largest value first."""
    pieces = lattices.pieces
    words = [pieces.words(pieces.normalised(t)) for t in texts]
    docs = [_Document(int(key), own) for own, key in zip(lattices.nodes(words), keys, strict=True)]
    table = lattices.table
    # Round by round: every text continues the most promising of its open sets. Random numbers of a round are drawn at once.
    firsts = (-np.log(-np.log(_uniform(_keys(docs))))).tolist()
    todo = [(d, value, None, 0, ()) for d, value in zip(docs, firsts, strict=True)]
    for rank in range(k):
        if not todo:
            break
        own_keys = _keys(d for d, *_ in todo)
        turns = _uniform(own_keys ^ np.uint64((rank + 1) << 50)).tolist()
        starts, heads = [], []
        for (d, _, parent, at, banned), turn in zip(todo, turns, strict=True):
            nodes, prefix, word = d.words, _NO_EDGES, 0
            if parent is not None:
                path, own_steps = d.paths[parent], d.steps[parent]
                edge = _other_edge(table, path[at], banned, turn)
                word = int(np.searchsorted(np.cumsum(own_steps), at, side="right"))
                prefix = np.append(path[:at], edge)
                inner = table["next"][edge]
                nodes = d.words[word + 1 :]
                if inner >= 0:
                    nodes = np.concatenate(([inner], nodes))
            starts.append(nodes)
            heads.append((prefix, word))
        ways = np.array([len(x) for x in starts])
        serial = np.arange(ways.sum()) - np.repeat(np.cumsum(ways) - ways, ways) + ((rank << 40) + 1)
        counters = _mixed(np.repeat(own_keys, ways) + serial.view(np.uint64) * _GOLDEN)
        edges, counts = _walk(table, np.concatenate(starts), counters)
        every = table["log"][edges], table["rest"][edges]
        begin = way = 0
        masses, places, lefts = [], [], []
        for (d, value, parent, at, banned), nodes, (prefix, word) in zip(todo, starts, heads, strict=True):
            own = counts[way : way + len(nodes)]
            end = begin + int(own.sum())
            path, logs, rest = edges[begin:end], every[0][begin:end], every[1][begin:end]
            begin, way = end, way + len(nodes)
            steps = own
            if parent is not None:
                path, logs = np.concatenate((prefix, path)), np.concatenate((table["log"][prefix], logs))
                before = d.steps[parent][: word + 1].copy()
                into = len(prefix) - int(before[:word].sum())  # steps of the parted word up to the new edge
                inside = len(nodes) > len(d.words) - word - 1
                before[word] = into + (int(own[0]) if inside else 0)
                steps = np.concatenate((before, own[1:] if inside else own))
            passed = np.cumsum(logs)
            passed -= logs
            d.paths.append(path)
            d.steps.append(steps)
            d.logs.append(float(logs.sum()))
            d.values.append(value)
            mass = passed[len(prefix) :] + rest
            # No more than k sets of one path can come up, and noise has bounds: the rest needs no draw.
            near = np.arange(len(mass))
            if len(mass) > k + 1:
                most = np.partition(mass, len(mass) - k - 1)[len(mass) - k - 1]
                near = np.nonzero(mass > most - np.logaddexp(most - value, _LEAST_NOISE) - _MOST_NOISE)[0]
            masses.append(mass[near])
            places.append(near + len(prefix))
            if parent is not None:
                gone = (*banned, int(prefix[-1]))
                left = _left_mass(table, int(prefix[-1]), gone)
                if left > -math.inf:
                    lefts.append((d, at, gone[:-1], passed[at] + left, value))
        sizes = np.array([len(x) for x in masses])
        serial = np.concatenate(places).astype(np.uint64) + np.uint64((rank << 40) + (1 << 62))
        values = np.repeat([value for _, value, *_ in todo], sizes)
        found = _truncated(np.concatenate(masses), values, _mixed(np.repeat(own_keys, sizes) ^ (serial * _GOLDEN)))
        begin = 0
        for (d, *_), place in zip(todo, places, strict=True):
            own = found[begin : begin + len(place)]
            begin += len(place)
            best = np.argpartition(-own, min(k, len(own) - 1))[: k + 1] if len(own) > k + 1 else np.arange(len(own))
            for v, at in zip(own[best].tolist(), place[best].tolist(), strict=True):
                if v > -math.inf:
                    heapq.heappush(d.open, (-v, rank, at, ()))
        if lefts:
            serial = np.array([(rank << 40) + (3 << 60) + at for _, at, *_ in lefts], np.uint64)
            mass, values = (np.array([x[i] for x in lefts]) for i in (3, 4))
            found = _truncated(mass, values, _mixed(_keys(d for d, *_ in lefts) ^ (serial * _GOLDEN)))
            for (d, at, gone, *_), v in zip(lefts, found.tolist(), strict=True):
                heapq.heappush(d.open, (-v, rank, at, gone))
        following = []
        for d, *_ in todo:
            if d.open and rank + 1 < k:
                v, source, at, gone = heapq.heappop(d.open)
                following.append((d, -v, source, at, (*gone, int(d.paths[source][at]))))
        todo = following
    return docs


def _keys(docs: Iterable[_Document]) -> np.ndarray:
    return np.array([d.key for d in docs], np.uint64)


def _node_edges(table: dict, edge: int) -> range:
    node = int(table["first"].searchsorted(np.int32(edge), side="right")) - 1  # another type would copy all nodes
    end = table["first"][node + 1] if node + 1 < len(table["first"]) else len(table["next"])
    return range(int(table["first"][node]), int(end))


def _left_mass(table: dict, edge: int, gone: tuple) -> float:
    left = sum(math.exp(table["log"][e]) for e in _node_edges(table, edge) if e not in gone)
    return math.log(left) if left > 0 else -math.inf


def _other_edge(table: dict, edge: int, gone: tuple, turn: float) -> int:
    """Another edge of the same node, by its probability among those that are left, at ``turn`` of their sum."""
    others = [e for e in _node_edges(table, int(edge)) if e not in gone]
    shares = np.cumsum([math.exp(table["log"][e]) for e in others])
    return others[min(int(np.searchsorted(shares, turn * shares[-1], side="right")), len(others) - 1)]


def _written(raw: list[bytes], ids: np.ndarray) -> bytes:
    """The text that pieces write, without the blank before its first word."""
    text = b"".join(map(raw.__getitem__, ids.tolist()))
    return text[1:] if text[:1] == b" " else text


def _texts(raw: pa.LargeBinaryArray, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """What the pieces from each of ``ends`` to the next write, as ``_written`` does."""
    pieces = raw.take(pa.array(ids, pa.int32()))
    _, offsets, data = pieces.buffers()
    cuts = np.frombuffer(offsets, np.int64, len(ids) + 1)[ends].tolist() if len(ids) else [0] * len(ends)
    data = memoryview(data or b"")
    return [bytes(data[a + (data[a : a + 1] == b" " and a < b) : b]) for a, b in zip(cuts, cuts[1:], strict=False)]


_SAMPLE = "key {}, rank int, ids array<int>, log_prob double, perturbed double, log_inclusion double, exact boolean"


def encode(docs: DataFrame, path: str, k: int = 3, alpha: float = 1.0, seed: int = 7, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Up to k rows (key, rank, ids, log_prob, perturbed, log_inclusion, exact) for every row, rank 1 with the
    largest value; ``exact`` tells whether the pieces, decoded, write the text again, which ``decoded`` adds as a column.

    ``log_inclusion`` is the log of the probability that the segmentation is among the k drawn, given the largest value
    that was not drawn. ``path`` is the model file, which every executor must have at the same place.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(Pieces(path, alpha))
        raw = pa.array(lattices.pieces.raw, pa.large_binary())
        for batch in portions(batches, text, _STEP_BYTES):
            keys = batch.column(2).to_numpy().view(np.uint64)
            found = sample(lattices, pc.fill_null(batch.column(1), "").to_pylist(), _mixed(keys), k)
            rows, ranks, ids, sizes, logs, values, inclusion = [], [], [], [0], [], [], []
            for i, d in enumerate(found):
                bound = -d.open[0][0] if d.open else -math.inf
                for rank, (way, log, value) in enumerate(zip(d.paths, d.logs, d.values, strict=True)):
                    rows.append(i)
                    ranks.append(rank + 1)
                    ids.append(lattices.ids(way))
                    sizes.append(len(ids[-1]))
                    logs.append(log)
                    values.append(value)
                    x = log - bound
                    inclusion.append(0.0 if x > 36 else x if x < -36 else math.log(-math.expm1(-math.exp(x))))
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            again = _texts(raw, flat, ends)
            texts = bytes_of(batch, text)
            exact = [written == texts[i] for i, written in zip(rows, again, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ranks, pa.int32()), lists, pa.array(logs, pa.float64()), pa.array(values, pa.float64()), pa.array(inclusion, pa.float64()), pa.array(exact, pa.bool_()), *([pa.array(again, pa.binary()).cast(pa.string())] if decoded else [])],
                ["key", "rank", "ids", "log_prob", "perturbed", "log_inclusion", "exact", *(["decoded"] if decoded else [])],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = require(docs, key, text).withColumn("_seed", F.xxhash64(F.lit(seed), F.col(f"`{key}`")))
    return rows.mapInArrow(run, _SAMPLE.format(kind) + (", decoded string" if decoded else "")).withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text that the pieces in ``ids`` write; null stays null."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = Pieces(path, 1.0).raw
        for whole in batches:
            for at in range(0, whole.num_rows, _DECODED_ROWS):
                yield decoded(raw, whole.slice(at, _DECODED_ROWS))

    def decoded(raw: list[bytes], batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.schema.get_field_index(ids))
        lists = (column[i] for i in range(batch.num_rows))
        texts = [_written(raw, own.values.to_numpy(zero_copy_only=False)) if own.is_valid else None for own in lists]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, into])

    kept = [f for f in rows.schema.fields if f.name != into]
    return rows.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, StructType(kept).add(into, StringType()))
