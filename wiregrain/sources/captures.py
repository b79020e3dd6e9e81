"""Packet captures (pcap and pcapng) as a ``packets`` DataFrame.

Two Spark steps. The first walks the records of each file in a stream of reads and cuts the file into
parts of about ``PART_BYTES`` with the number of their first packet. The second reads the parts
in parallel: as many partitions as parts, dealt round robin with a given count, which adaptive
execution does not merge. So one huge capture is no more than many parts, no task holds a file,
and packet numbers are exact. Python only follows the chain of record headers; frames leave as
Arrow arrays, and everything from the IP header on is decoded by column expressions.

A file has no marks where records start, so a large one is walked by guess and confirmation. Each segment of
``SEGMENT_BYTES`` is a task that looks for a run of plausible headers and follows it to the segment's end. Where the
chain of a segment ends must be where the next one began; every segment for which that is not so is walked again from
there, all of them at once, until none is left. The guess only saves time: what is returned is what one walk from the
first byte finds, damaged files included. A part list and a segment list are a few rows for each segment of a file.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiregrain.operators.decode import PROTOCOLS, decode_frames
from wiregrain.schemas import CAPTURE_PARTS, CAPTURE_SEGMENTS, FRAMES
from wiregrain.session import settle

PART_BYTES = 32 << 20
#: Larger files are walked in segments of this size.
SEGMENT_BYTES = 64 << 20
_READ_BYTES = 4 << 20
_FRAMES_PER_BATCH = 8192
_PARTS_PER_BATCH = 1024
#: A guess reads this much of a segment, takes records up to this size, and believes a run of this many.
_GUESS_BYTES, _GUESS_RECORD, _GUESS_RUN = 2 << 20, 1 << 18, 24
#: Partitions of one read of parts; larger directories have several parts in each.
_MOST_PARTITIONS = 100_000

# File magic (as read big-endian) to byte order and ticks per second.
_PCAP_MAGIC = {
    0xA1B2C3D4: (">", 1_000_000),
    0xD4C3B2A1: ("<", 1_000_000),
    0xA1B23C4D: (">", 1_000_000_000),
    0x4D3CB2A1: ("<", 1_000_000_000),
}
_NG_SECTION, _NG_INTERFACE, _NG_SIMPLE, _NG_PACKET = 0x0A0D0D0A, 1, 3, 6


def list_captures(spark: SparkSession, root: str, pattern: str = "*.{pcap,pcapng}") -> DataFrame:
    """Capture files under ``root`` with source tags; the file contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return files.select(capture_id(F.col("path"), root), "path", "length").transform(tag_source)


def capture_id(path, root: str):
    """Path below the root, the name under which labels and packets meet."""
    return F.substring_index(path, root.rstrip("/") + "/", -1).alias("capture_id")


def tag_source(df: DataFrame) -> DataFrame:
    """File name and directory name of the capture."""
    return df.withColumns(
        {
            "source_pcap": F.regexp_extract("path", r"([^/]+)$", 1),
            "source_dir": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1),
        }
    )


@dataclass
class _Layout:
    """How to read the records of the current part."""

    kind: str
    order: str
    links: list[int]
    ticks: list[int]


def _open(path: str):
    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def _record(buf: bytes, at: int, layout: _Layout):
    """Next record as ``(end, data start, data length, time in µs, interface, block type)``; None if cut off."""
    if layout.kind == "pcap":
        if at + 16 > len(buf):
            return None
        seconds, fraction, size, _ = struct.unpack_from(layout.order + "4I", buf, at)
        us = seconds * 1_000_000 + fraction * 1_000_000 // layout.ticks[0]
        return at + 16 + size, at + 16, size, us, 0, _NG_PACKET
    if at + 12 > len(buf):
        return None
    block, length = struct.unpack_from(layout.order + "2I", buf, at)
    if block == _NG_SECTION:
        length = struct.unpack_from(_section_order(buf, at) + "I", buf, at + 4)[0]
    if length < 12 or length % 4:
        raise ValueError(f"bad block length {length}")
    if block == _NG_PACKET and at + 28 <= len(buf):
        face, high, low, size = struct.unpack_from(layout.order + "4I", buf, at + 8)
        us = ((high << 32) | low) * 1_000_000 // layout.ticks[face]
        return at + length, at + 28, size, us, face, block
    if block == _NG_SIMPLE and at + 12 <= len(buf):
        return at + length, at + 12, length - 16, 0, 0, block
    return at + length, at, 0, 0, 0, block


def _section_order(buf: bytes, at: int) -> str:
    return "<" if buf[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"


def _add_interface(buf: bytes, at: int, end: int, layout: _Layout) -> None:
    layout.links.append(struct.unpack_from(layout.order + "H", buf, at + 8)[0])
    ticks, option = 1_000_000, at + 16
    while option + 4 <= end - 4:
        code, size = struct.unpack_from(layout.order + "2H", buf, option)
        if code == 9 and size:
            power = buf[option + 4]
            ticks = 2 ** (power & 127) if power & 128 else 10**power
        option += 4 + (size + 3) // 4 * 4
        if code == 0:
            break
    layout.ticks.append(ticks)


def _start(head: bytes) -> tuple[_Layout, int]:
    magic = struct.unpack(">I", head[:4])[0] if len(head) >= 4 else 0
    if magic == _NG_SECTION:
        return _Layout("pcapng", _section_order(head, 0), [], []), 0
    if magic not in _PCAP_MAGIC or len(head) < 24:
        raise ValueError("not a capture file")
    order, ticks = _PCAP_MAGIC[magic]
    link = struct.unpack_from(order + "I", head, 20)[0] & 0xFFFF
    return _Layout("pcap", order, [link], [ticks]), 24


def _border(buf: bytes, at: int, layout: _Layout):
    """``(end, block type, interface)`` of the next record; None if its header is cut off."""
    if layout.kind == "pcap":
        if at + 16 > len(buf):
            return None
        return at + 16 + struct.unpack_from(layout.order + "I", buf, at + 8)[0], _NG_PACKET, 0
    if at + 12 > len(buf):
        return None
    block, length, face = struct.unpack_from(layout.order + "3I", buf, at)
    if block == _NG_SECTION:
        length = struct.unpack_from(_section_order(buf, at) + "I", buf, at + 4)[0]
    if length < 12 or length % 4:
        raise ValueError(f"bad block length {length}")
    return at + length, block, face if block == _NG_PACKET else 0


@dataclass
class _Stretch:
    """Where a walk is. ``layout`` holds what was declared in the stretch; it is complete if ``fresh``."""

    layout: _Layout
    fresh: bool
    at: int
    packets: int = 0
    #: Interfaces that must have been declared before the stretch, and how many were (None: not known yet).
    need: int = 0
    faces: int | None = None
    problem: str | None = None


def _walk(file, length: int, here: _Stretch, stop: int, part_bytes: int) -> Iterator[tuple]:
    """Parts of the records that start before ``stop``; ``here`` moves along and says at the end where the walk is.

    A part is ``(packets before it, packets, begin, size, fresh, order, links, ticks, problem)``.
    """
    base, buf, at = here.at, file.read_at(min(_READ_BYTES, max(length - here.at, 0)), here.at), 0
    first, begin = 0, here.at

    def part(end: int) -> tuple:
        shape = (here.fresh, here.layout.order, list(here.layout.links), list(here.layout.ticks))
        return (first, here.packets - first, begin, end - begin, *shape, here.problem)

    while base + at < stop:
        try:
            border = _border(buf, at, here.layout)
            if border is not None and base + border[0] > length:
                here.problem = "truncated"
                break
            if border is None or border[0] > len(buf):
                more = file.read_at(max(_READ_BYTES, (border[0] - len(buf)) if border else 0), base + len(buf))
                if not more:
                    here.problem = "truncated"
                    break
                base, buf, at = base + at, buf[at:] + more, 0
                continue
            end, block, face = border
            if block in (_NG_SECTION, _NG_INTERFACE):
                # Interface numbers change here, so a part never spans such a block.
                if here.packets > first:
                    yield part(base + at)
                    first = here.packets
                if block == _NG_SECTION:
                    here.layout, here.fresh = _Layout("pcapng", _section_order(buf, at), [], []), True
                else:
                    _add_interface(buf, at, end, here.layout)
                begin = base + end
            elif block in (_NG_PACKET, _NG_SIMPLE):
                before = face + 1 - len(here.layout.links)
                if before > (0 if here.fresh else before if here.faces is None else here.faces):
                    raise IndexError(f"interface {face} was not declared")
                if not here.fresh:
                    here.need = max(here.need, before)
                here.packets += 1
                if base + end - begin >= part_bytes:
                    yield part(base + end)
                    first, begin = here.packets, base + end
            at = end
        except (ValueError, IndexError, struct.error) as error:
            here.problem = f"{type(error).__name__}: {error}"
            break
    here.at = base + at
    if here.packets > first or here.problem:
        yield part(base + at)


def _parts_of(path: str, part_bytes: int) -> Iterator[tuple]:
    """``(first_packet, packets, begin, size, kind, order, links, ticks, problem)`` of each part."""
    with _open(path) as file:
        length = file.size()
        layout, at = _start(file.read_at(min(24, length), 0))
        here, empty = _Stretch(layout, layout.kind == "pcap", at), True
        for first, packets, begin, size, _, order, links, ticks, problem in _walk(file, length, here, length, part_bytes):
            empty = False
            yield first + 1, packets, begin, size, layout.kind, order, links, ticks, problem
        if empty:  # a capture without a record is one empty part
            end = here.layout
            yield 1, 0, at, here.at - at, end.kind, end.order, end.links, end.ticks, None


def _guess(file, length: int, layout: _Layout, lo: int, hi: int) -> tuple[int, str] | None:
    """A likely record start at or behind ``lo`` and the byte order there: a run of plausible headers follows it."""
    buf = file.read_at(min(_GUESS_BYTES, length - lo), lo)
    orders = [layout.order] if layout.kind == "pcap" else ["<", ">"]
    found = [(at, order) for order in orders for at in _likely(buf, lo, order, layout)]
    for at, order in sorted(found):
        if lo + at >= hi:
            return None
        if _runs(buf, at, order, layout, lo + len(buf) == length):
            return lo + at, order
    return None


def _likely(buf: bytes, lo: int, order: str, layout: _Layout) -> Iterator[int]:
    """Offsets whose next bytes could be a record header. Blocks lie at multiples of four in a file, pcap records anywhere."""
    for shift in range(4) if layout.kind == "pcap" else [-lo % 4]:
        words = np.frombuffer(buf, order + "u4", count=max(len(buf) - shift, 0) // 4, offset=shift)
        if len(words) < 4:
            continue
        a, b, c, d = words[:-3], words[1:-2], words[2:-1], words[3:]
        if layout.kind == "pcap":
            good = (b < layout.ticks[0]) & (c > 0) & (c <= _GUESS_RECORD) & (d >= c)
        else:
            good = np.isin(a, [_NG_INTERFACE, _NG_SIMPLE, 4, 5, _NG_PACKET]) & (b >= 12) & (b % 4 == 0) & (b <= _GUESS_RECORD)
        yield from (np.flatnonzero(good) * 4 + shift).tolist()


def _runs(buf: bytes, at: int, order: str, layout: _Layout, is_end: bool) -> bool:
    """Whether a run of plausible records starts here; it may be shorter if the file ends with it."""
    probe, last = _Layout(layout.kind, order, [], []), None
    for _ in range(_GUESS_RUN):
        if at == len(buf):
            return is_end
        try:
            border = _border(buf, at, probe)
        except ValueError:
            return False
        if border is None or border[0] > len(buf):
            return False
        end = border[0]
        if layout.kind == "pcap":
            seconds, fraction, size, whole = struct.unpack_from(order + "4I", buf, at)
            if not (0 < size <= whole and fraction < layout.ticks[0]) or (last is not None and abs(seconds - last) > 86_400):
                return False
            last = seconds
        elif border[1] == _NG_SECTION:
            probe.order = _section_order(buf, at)
        if layout.kind != "pcap" and buf[end - 4 : end] != buf[at + 4 : at + 8]:
            return False
        at = end
    return True


def _segment_of(task: dict, part_bytes: int, segment_bytes: int) -> dict:
    """One segment walked from its given entry, or from a guessed one; one row with its parts."""
    lo, length = task["segment"] * segment_bytes, task["length"]
    row = {**task, "kind": "", "exit": None, "exit_order": None, "fresh": False, "links": [], "ticks": [], "need": 0, "packets": 0}
    row.update(stopped=False, parts=[])
    try:
        with _open(task["path"]) as file:
            hi, layout, at = min(lo + segment_bytes, length), *_start(file.read_at(min(24, length), 0))
            row["kind"] = layout.kind
            if task["segment"] == 0:
                here = _Stretch(layout, layout.kind == "pcap", at)
                row.update(entry=at, entry_order=layout.order)
            else:
                if task["entry"] is None:
                    row["entry"], row["entry_order"] = _guess(file, length, layout, lo, hi) or (None, None)
                if row["entry"] is None:
                    return row
                # What the head of a file declares belongs to its first segment.
                here = _Stretch(_Layout(layout.kind, row["entry_order"], [], []), False, row["entry"], faces=task["faces"])
            row["parts"] = [dict(zip(_SEGMENT_PART, p, strict=True)) for p in _walk(file, length, here, hi, part_bytes)]
            row.update(fresh=here.fresh, links=here.layout.links, ticks=here.layout.ticks, need=here.need, packets=here.packets)
            row.update(stopped=here.problem is not None, exit=here.at, exit_order=here.layout.order)
    except Exception as error:  # one bad file must not stop the others
        problem = f"{type(error).__name__}: {error}"
        values = (0, 0, 0, 0, False, "", [], [], problem)
        row.update(stopped=True, parts=[dict(zip(_SEGMENT_PART, values, strict=True))])
    if row["stopped"]:
        row["exit"] = row["exit_order"] = None
    return row


def _walk_segments(tasks: DataFrame, part_bytes: int, segment_bytes: int, count: int) -> DataFrame:
    """Each segment in a task of its own; the number of tasks is given, as for parts."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([_segment_of(task, part_bytes, segment_bytes)], _SEGMENT_SCHEMA)

    columns = ["capture_id", "path", "length", "segment", "entry", "entry_order", "faces"]
    dealt = tasks.select(columns).repartition(min(count, _MOST_PARTITIONS))
    return dealt.mapInArrow(walk, CAPTURE_SEGMENTS)


def _confirmed(walked: DataFrame) -> DataFrame:
    """Segments with what their predecessors say: ``at``, ``order``, declared interfaces, packets before, ``again``, ``keep``.

    The rows of one file are its bytes over ``SEGMENT_BYTES``, so a window by file stays small.
    """
    file = Window.partitionBy("capture_id", "path")
    ordered = file.orderBy("segment")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    declared = F.when(F.col("fresh") | (F.size("links") > 0), F.struct("fresh", "links", "ticks"))
    rows = walked.withColumns(
        {
            "__at": F.lag("exit").over(ordered),
            "__order": F.lag("exit_order").over(ordered),
            "__first": F.coalesce(F.sum("packets").over(before), F.lit(0)),
            "__said": F.collect_list(declared).over(before),
        }
    )
    # Declarations count from the last section on.
    back = F.expr("array_position(reverse(transform(__said, x -> x.fresh)), true)")
    rows = rows.withColumn("__back", F.coalesce(back, F.lit(0)).cast("int"))
    rows = rows.withColumn("__said", F.when(F.col("__back") > 0, F.expr("slice(__said, -__back, __back)")))
    for name in ("links", "ticks"):
        rows = rows.withColumn(f"__{name}", F.coalesce(F.expr(f"flatten(transform(__said, x -> x.{name}))"), F.expr(f"slice({name}, 1, 0)")))
    known = F.size("__links")
    joins = F.col("entry").eqNullSafe(F.col("__at")) & F.col("entry_order").eqNullSafe(F.col("__order")) & F.col("entry").isNotNull()
    # A walk that stopped may have done so for the number of interfaces it was told.
    fits = (F.col("need") <= known) & ~(F.col("stopped") & F.coalesce(F.col("faces") != known, F.lit(False)))
    rows = rows.withColumn("__bad", (F.col("segment") > 0) & ~(joins & fits))
    rows = rows.withColumn("__open", F.min(F.when(F.col("__bad"), F.col("segment"))).over(file))
    sure = F.col("stopped") & (F.col("segment") < F.coalesce("__open", F.col("segment") + 1))
    rows = rows.withColumn("__stop", F.min(F.when(sure, F.col("segment"))).over(file))
    keep = F.col("segment") <= F.coalesce("__stop", F.col("segment"))
    return rows.withColumn("__keep", keep).withColumn("__again", F.col("__bad") & keep & F.col("__at").isNotNull())


def _parallel_parts(files: DataFrame, part_bytes: int, segment_bytes: int, count: int) -> DataFrame:
    """Parts of large captures, walked in segments; see the head of this module."""
    tasks = files.select(
        "capture_id",
        "path",
        "length",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / segment_bytes))).alias("segment"),
        F.lit(None).cast("long").alias("entry"),
        F.lit(None).cast("string").alias("entry_order"),
        F.lit(None).cast("int").alias("faces"),
    )
    walked = settle(_walk_segments(tasks, part_bytes, segment_bytes, count))
    while redo := _confirmed(walked).where("__again").count():
        rows = settle(_confirmed(walked))
        late = rows.where("__again").select(
            "capture_id", "path", "length", "segment", F.col("__at").alias("entry"),
            F.col("__order").alias("entry_order"), F.size("__links").alias("faces"),
        )
        fine = rows.where(~F.col("__again")).select(walked.columns)
        walked = settle(fine.unionByName(_walk_segments(late, part_bytes, segment_bytes, redo)))
    rows = _confirmed(walked).where("__keep").withColumn("p", F.explode("parts"))
    own = lambda name: F.when(F.col("p.fresh"), F.col(f"p.{name}")).otherwise(F.concat(f"__{name}", f"p.{name}"))
    return rows.select(
        "capture_id",
        "path",
        (F.col("__first") + F.col("p.offset") + 1).alias("first_packet"),
        "p.packets",
        "p.begin",
        "p.size",
        "kind",
        "p.byte_order",
        own("links").alias("link_types"),
        own("ticks").alias("ticks"),
        "p.problem",
    )


def capture_parts(files: DataFrame, part_bytes: int = PART_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Parts of every capture; a file that cannot be read gives one row that says why.

    Files above ``segment_bytes`` are walked by many tasks. Streams, and lists without ``length``, take one task a file.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for capture, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    for p in _parts_of(path, part_bytes):
                        rows.append((capture, path, *p))
                        if len(rows) == _PARTS_PER_BATCH:
                            yield _part_batch(rows)
                            rows = []
                except Exception as error:  # one bad file must not stop the others, nor lose its own good parts
                    rows.append((capture, path, 0, 0, 0, 0, "", "", [], [], f"{type(error).__name__}: {error}"))
                if rows:
                    yield _part_batch(rows)

    # Listed files are packed by size already; one task walks a few files.
    whole = lambda some: some.select("capture_id", "path").mapInArrow(walk, CAPTURE_PARTS)
    if files.isStreaming or "length" not in files.columns:
        return whole(files)
    large = files.where(F.col("length") > segment_bytes)
    count = large.agg(F.sum(F.ceil(F.col("length") / segment_bytes))).first()[0]
    if not count:
        return whole(files)
    small = files.where(F.col("length") <= segment_bytes)
    return whole(small).unionByName(_parallel_parts(large, part_bytes, segment_bytes, count))


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PART_TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(columns, _PART_NAMES)


_PART_NAMES = [field.split()[0] for field in CAPTURE_PARTS.split(", ")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
_PART_TYPES = [_ARROW[field.split()[1]] for field in CAPTURE_PARTS.split(", ")]
_ARROW.update(int=pa.int32(), boolean=pa.bool_())
_SEGMENT_PART = ["offset", "packets", "begin", "size", "fresh", "byte_order", "links", "ticks", "problem"]
_SEGMENT_PART_TYPES = [pa.int64()] * 4 + [pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string()]
_SEGMENT_SCHEMA = pa.schema(
    [(name, _ARROW[kind]) for name, kind in (field.split() for field in CAPTURE_SEGMENTS.split(", parts ")[0].split(", "))]
    + [("parts", pa.list_(pa.struct(list(zip(_SEGMENT_PART, _SEGMENT_PART_TYPES, strict=True)))))]
)


def frames_of(part: dict, choose: Callable[[dict], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Frames of one part in batches; Python touches the record headers, numpy the frames.

    ``choose`` gets numbers, times, lengths, ports and protocol of a batch as arrays and says which frames stay; these columns
    then go along behind the usual ones.
    """
    layout = _Layout(part["kind"], part["byte_order"], part["link_types"], part["ticks"])
    with _open(part["path"]) as file:
        buf = file.read_at(part["size"], part["begin"])
    data = np.frombuffer(buf, np.uint8)
    at, number, left = 0, part["first_packet"], part["packets"]
    while left:
        found = []
        while len(found) < min(left, _FRAMES_PER_BATCH):
            end, start, size, us, face, block = _record(buf, at, layout)
            at = end
            if block in (_NG_PACKET, _NG_SIMPLE):
                found.append((start, size, us, face))
        starts, sizes, times, faces = (np.array(c, np.int64) for c in zip(*found, strict=True))
        links = np.array(layout.links, np.int64)[faces]
        facts = {"packet_number": np.arange(number, number + len(found)), "ts_us": times, "frame_len": sizes}
        facts["ip_at"] = _ip_at(links, data, starts, sizes)
        number, left = number + len(found), left - len(found)
        if choose is not None:
            facts.update(_ports(data, starts, sizes, facts["ip_at"].astype(np.int64)))
            kept = np.flatnonzero(choose(facts))
            if not len(kept):
                continue
            facts = {name: values[kept] for name, values in facts.items()}
            starts = starts[kept]
        yield _frame_batch(part["capture_id"], buf, starts, facts)


def _frame_batch(capture: str, buf: bytes, starts: np.ndarray, facts: dict) -> pa.RecordBatch:
    sizes, n = facts["frame_len"], len(starts)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    body = b"".join([buf[a : a + k] for a, k in zip(starts.tolist(), sizes.tolist(), strict=True)])
    columns = {
        "capture_id": pa.array([capture] * n, pa.string()),
        "packet_number": pa.array(facts["packet_number"]),
        "ts_us": pa.array(facts["ts_us"]),
        "frame_len": pa.array(sizes.astype(np.int32)),
        "ip_at": pa.array(facts["ip_at"]),
        "frame": pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(body)]),
    }
    for name in ("src_port", "dst_port", "is_tcp", "is_udp"):
        if name in facts:
            columns[name] = pa.array(facts[name].astype(np.int32))
    if "protocol" in facts:
        columns["protocol"] = pa.array(facts["protocol"].tolist(), pa.string())
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


# Link types, Ethernet type codes and the IPv4 family number of loopback frames.
_ETHERNET, _COOKED, _LOOPBACK, _RAW = 1, 113, 0, (12, 101, 228)
_IPV4, _VLAN = 0x0800, (0x8100, 0x88A8)
_FAMILY = 2


def _bytes_at(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Callable:
    """The byte of each frame at an offset, -1 behind its end."""

    def byte(offset: np.ndarray | int) -> np.ndarray:
        place = np.minimum(starts + offset, len(data) - 1)
        return np.where(sizes > offset, data[place].astype(np.int64), -1)

    return byte


def _ports(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ip: np.ndarray) -> dict[str, np.ndarray]:
    """Ports, transport and protocol of each frame, by the rules of ``decode_frames``."""
    byte = _bytes_at(data, starts, sizes)
    at = np.maximum(ip, 0)
    first = (ip >= 0) & (((byte(at + 6) << 8 | byte(at + 7)) & 0x1FFF) == 0)
    l4 = at + (byte(at) & 15) * 4
    tcp = first & (byte(at + 9) == 6) & (sizes >= l4 + 20)
    udp = first & (byte(at + 9) == 17) & (sizes >= l4 + 8)
    source, target = (np.where(tcp | udp, byte(l4 + k) << 8 | byte(l4 + k + 1), 0) for k in (0, 2))
    name = np.full(len(starts), "other", object)
    for p in reversed(PROTOCOLS.values()):
        name[tcp & ((source == p.port) | (target == p.port))] = p.name
    return {"src_port": source, "dst_port": target, "is_tcp": tcp.astype(int), "is_udp": udp.astype(int), "protocol": name}


def _ip_at(links: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Offset of the IPv4 header behind the link layer of each frame, -1 when there is none."""

    byte = _bytes_at(data, starts, sizes)

    def kind(offset: np.ndarray | int) -> np.ndarray:
        return np.where(byte(offset + 1) >= 0, byte(offset) << 8 | byte(offset + 1), -1)

    tag = np.full(len(starts), 12)
    while (tagged := (links == _ETHERNET) & np.isin(kind(tag), _VLAN)).any():
        tag = tag + 4 * tagged
    at = np.full(len(starts), -1)
    at = np.where((links == _ETHERNET) & (kind(tag) == _IPV4), tag + 2, at)
    at = np.where((links == _COOKED) & (kind(14) == _IPV4), 16, at)
    at = np.where((links == _LOOPBACK) & (sizes > 4) & ((byte(0) == _FAMILY) | (byte(3) == _FAMILY)), 4, at)
    at = np.where(np.isin(links, _RAW), 0, at)
    whole = (at >= 0) & (sizes >= at + 20) & (byte(np.maximum(at, 0)) >> 4 == 4)
    return np.where(whole, at, -1).astype(np.int32)


def read_frames(parts: DataFrame) -> DataFrame:
    """Raw frames of the parts. A part list is a few bytes, so the number of partitions is given: one for each part."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                yield from frames_of(part)

    usable = parts.where(F.col("packets") > 0)
    if not usable.isStreaming:
        usable = usable.repartition(min(max(usable.count(), 1), _MOST_PARTITIONS))
    return usable.mapInArrow(frames, FRAMES)


def bad_files(parts: DataFrame) -> DataFrame:
    """Captures that could not be read, or only up to a cut-off record."""
    return parts.where(F.col("problem").isNotNull()).select("capture_id", "path", "problem")


def read_parts(spark: SparkSession, root: str, pattern: str = "*.{pcap,pcapng}") -> DataFrame:
    """The part list of a directory, written once so that reading packets does not walk the files again."""
    return settle(capture_parts(list_captures(spark, root, pattern)))


def read_packets(
    spark: SparkSession,
    root: str,
    pattern: str = "*.{pcap,pcapng}",
    parts: DataFrame | None = None,
) -> DataFrame:
    """All frames of all captures under ``root``, decoded to the ``packets`` schema."""
    parts = read_parts(spark, root, pattern) if parts is None else parts
    return decode_frames(read_frames(parts))
