"""Captures walked in segments give what one walk from the first byte gives."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from wiregrain.sources import captures as cap


def frames(n: int, seed: int = 1) -> list[tuple[float, bytes]]:
    pick = random.Random(seed)
    return [
        (fx.packet_time(i), fx.ip_frame(pick.randbytes(pick.randrange(1, 900)), "10.0.0.1", "10.0.0.2", 5000, 502))
        for i in range(n)
    ]


def block(kind: int, body: bytes, order: str = "<") -> bytes:
    body += b"\x00" * (-len(body) % 4)
    size = struct.pack(order + "I", len(body) + 12)
    return struct.pack(order + "I", kind) + size + body + size


def section(order: str = "<") -> bytes:
    return block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)


def interface(link: int, power: int, order: str = "<") -> bytes:
    option = struct.pack(order + "HHB3x", 9, 1, power) + struct.pack(order + "HH", 0, 0)
    return block(1, struct.pack(order + "HHI", link, 0, 65535) + option, order)


def packet(face: int, us: int, frame: bytes, power: int, order: str = "<") -> bytes:
    ticks = us * 10 ** (power - 6)
    return block(6, struct.pack(order + "IIIII", face, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame, order)


def changing(n: int) -> bytes:
    """Interfaces declared in the middle, a section of the other byte order, other ticks and links."""
    out, us = section() + interface(1, 6), 1_234_567_890_000_000
    for i, (_, f) in enumerate(frames(n, 2)):
        if i == n // 3:
            out += interface(101, 9)
        out += packet(1, us + i, f[14:], 9) if i > n // 3 and i % 2 else packet(0, us + i, f, 6)
    out += section(">") + interface(101, 9, ">")
    for i, (_, f) in enumerate(frames(n, 3)):
        out += packet(0, us + i, f[14:], 9, ">")
    return out


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("segments")
    fx.write_pcap(str(base / "plain.pcap"), frames(400))
    fx.write_pcap(str(base / "nano.pcap"), frames(300), ">", nano=True)
    fx.write_pcapng(str(base / "blocks.pcapng"), frames(300))
    (base / "changing.pcapng").write_bytes(changing(150))
    whole = (base / "plain.pcap").read_bytes()
    (base / "cut.pcap").write_bytes(whole[:-7])
    (base / "torn.pcap").write_bytes(whole[:60_000] + b"\xff" * 300 + whole[60_300:])
    blocks = (base / "blocks.pcapng").read_bytes()
    (base / "bad_block.pcapng").write_bytes(blocks[:50_000] + b"\x07" * 64 + blocks[50_064:])
    unknown = section() + interface(1, 6) + b"".join(packet(int(i == 90), i, f, 6) for i, (_, f) in enumerate(frames(200)))
    (base / "unknown_interface.pcapng").write_bytes(unknown)
    simple = section() + interface(1, 6) + b"".join(block(3, struct.pack("<I", len(f)) + f) for _, f in frames(100))
    (base / "simple.pcapng").write_bytes(simple)
    # Frames that hold a capture, empty records, and one record that is larger than several segments.
    inner = [(t, fx.ip_frame(whole[40:1400], "1.1.1.1", "2.2.2.2", 20, 21)) for t, _ in frames(60)]
    empty = [(t, b"") for t, _ in frames(400)]
    fx.write_pcap(str(base / "odd.pcap"), inner + empty + [(fx.START, bytes(60_000))] + frames(50) + inner)
    (base / "empty.pcap").write_bytes(whole[:24])
    (base / "none.pcap").write_bytes(b"")
    (base / "text.pcap").write_bytes(b"no capture " * 5000)
    return str(base)


def test_segments_equal_one_walk(spark, root):
    files = cap.list_captures(spark, root)
    one = cap.capture_parts(files, part_bytes=5000, segment_bytes=1 << 40).cache()
    many = cap.capture_parts(files, part_bytes=5000, segment_bytes=20_000).cache()
    a, b = cap.read_frames(one), cap.read_frames(many)
    assert a.count() == b.count() > 100
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    bad = lambda parts: sorted(map(tuple, cap.bad_files(parts).collect()))
    assert bad(one) == bad(many)
    covered = lambda parts: {r[0]: r[1] for r in parts.groupBy("capture_id").agg(F.sum("packets")).collect()}
    assert covered(one) == covered(many)


def test_a_large_file_is_walked_by_many_tasks(spark, tmp_path, monkeypatch):
    fx.write_pcap(str(tmp_path / "big.pcap"), frames(12_000))
    files = cap.list_captures(spark, str(tmp_path))
    walks, walk = [], cap._walk_segments

    def counted(tasks, *rest):
        out = walk(tasks, *rest)
        walks.append(out.groupBy(F.spark_partition_id()).count().count())
        return out

    monkeypatch.setattr(cap, "_walk_segments", counted)
    parts = cap.capture_parts(files, segment_bytes=256 << 10)
    assert parts.agg(F.sum("packets")).first()[0] == 12_000
    assert len(walks) == 1 and walks[0] > 10  # every guess was right
    rows = parts.orderBy("first_packet").collect()
    assert all(y.first_packet == x.first_packet + x.packets for x, y in zip(rows, rows[1:], strict=False))
    assert all(y.begin == x.begin + x.size for x, y in zip(rows, rows[1:], strict=False))
