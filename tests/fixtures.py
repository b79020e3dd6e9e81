"""Synthetic packets and capture files, byte by byte."""

from __future__ import annotations

import struct
from datetime import datetime, timezone

from wiregrain.schemas import PACKETS

START = 1234567890.0


def modbus_bytes(i: int, code: int | None = None) -> bytes:
    fc = [1, 3, 4, 16][i % 4] if code is None else code
    return struct.pack(">HHHBBHH", i, 0, 6, i % 5 + 1, fc, 0, 10)


def dnp3_bytes(i: int) -> bytes:
    head = b"\x05\x64" + bytes([10, 0x44]) + struct.pack("<HH", i % 5 + 1, i)
    return head + b"\x00\x00" + bytes([[0, 1, 2, 129][i % 4]]) + struct.pack(">HH", 0, 10)


def packet_time(i: int, jitter: bool = True) -> float:
    return START + i * 0.1 + ((i % 3) * 0.02 if jitter else 0.0)


def packet_rows(n: int, protocol: str = "modbus", capture: str = "a.pcap", **kw) -> list[tuple]:
    rows = []
    for i in range(n):
        payload = modbus_bytes(i, kw.get("code")) if protocol == "modbus" else dnp3_bytes(i)
        port = 502 if protocol == "modbus" else 20000
        t = round(packet_time(i, kw.get("jitter", True)) * 1_000_000)
        ts = datetime.fromtimestamp(t // 1_000_000, timezone.utc).replace(microsecond=t % 1_000_000)
        rows.append(
            (
                capture,
                i + 1,
                ts,
                t / 1e6,
                "192.168.1.100",
                f"192.168.1.{10 + i % 3}",
                50000,
                port,
                1,
                0,
                54 + len(payload),
                40 + len(payload),
                bytearray(payload),
                protocol,
            )
        )
    return rows


def packets(spark, n: int, protocol: str = "modbus", **kw):
    return spark.createDataFrame(packet_rows(n, protocol, **kw), PACKETS)


# --- capture files ---------------------------------------------------------------


def ip_frame(payload: bytes, src: str, dst: str, sport: int, dport: int, udp: bool = False, vlan: bool = False) -> bytes:
    if udp:
        l4 = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0)
    else:
        l4 = struct.pack(">HHIIBBHHH", sport, dport, 1, 1, 5 << 4, 0x18, 8192, 0, 0)
    total = 20 + len(l4) + len(payload)
    ip = struct.pack(">BBHHHBBH", 0x45, 0, total, 1, 0, 64, 17 if udp else 6, 0)
    ip += bytes(int(x) for x in src.split(".")) + bytes(int(x) for x in dst.split("."))
    tag = b"\x81\x00\x00\x05" if vlan else b""
    frame = b"\x02" * 12 + tag + b"\x08\x00" + ip + l4 + payload
    return frame + b"\x00" * max(0, 60 - len(frame))


def arp_frame() -> bytes:
    return b"\xff" * 6 + b"\x02" * 6 + b"\x08\x06" + b"\x00" * 46


def write_pcap(path: str, frames: list[tuple[float, bytes]], order: str = "<", nano: bool = False) -> None:
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    scale = 1_000_000_000 if nano else 1_000_000
    with open(path, "wb") as f:
        f.write(struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1))
        for t, frame in frames:
            us = round(t * 1e6)
            part = us % 1_000_000 * (scale // 1_000_000)
            f.write(struct.pack(order + "IIII", us // 1_000_000, part, len(frame), len(frame)) + frame)


def write_pcapng(path: str, frames: list[tuple[float, bytes]], tsresol: int = 9) -> None:
    def block(kind: int, body: bytes) -> bytes:
        body += b"\x00" * (-len(body) % 4)
        size = len(body) + 12
        return struct.pack("<II", kind, size) + body + struct.pack("<I", size)

    with open(path, "wb") as f:
        f.write(block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)))
        option = struct.pack("<HHB3x", 9, 1, tsresol) + struct.pack("<HH", 0, 0)
        f.write(block(1, struct.pack("<HHI", 1, 0, 65535) + option))
        for t, frame in frames:
            ticks = round(t * 1e6) * 10 ** (tsresol - 6)
            head = struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame))
            f.write(block(6, head + frame))
