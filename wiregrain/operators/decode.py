"""Frame, Modbus and DNP3 header decoding as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiregrain import constants as C
from wiregrain.functions.bytefields import be16, field, head64, le16, rest, u8
from wiregrain.functions.text import epoch_seconds


@dataclass(frozen=True)
class Protocol:
    """What differs between the two protocols."""

    name: str
    port: int
    functions: dict[int, str]
    reads: list[int]
    writes: list[int]
    data_offset: int
    magic: bytes = b""
    code_range: tuple[int, int] = (1, 127)
    error_text: str = ""
    error_base: int = 0
    zero_is_known: bool = True


MODBUS = Protocol(
    "modbus",
    C.MODBUS_PORT,
    C.MODBUS_FUNCTIONS,
    C.MODBUS_READS,
    C.MODBUS_WRITES,
    data_offset=8,
    error_text="Error Response (Exception Code: %d)",
    error_base=128,
    zero_is_known=False,
)
DNP3 = Protocol(
    "dnp3",
    C.DNP3_PORT,
    C.DNP3_FUNCTIONS,
    C.DNP3_READS,
    C.DNP3_WRITES,
    data_offset=11,
    magic=b"\x05\x64",
    code_range=(0, 255),
    error_text="Response (Code: %d)",
)
PROTOCOLS = {p.name: p for p in (MODBUS, DNP3)}


# --- frames to packets -------------------------------------------------------

def _address(frame: Column, offset: Column) -> Column:
    return F.concat_ws(".", *[u8(frame, offset + i).cast("string") for i in range(4)])


def decode_frames(frames: DataFrame) -> DataFrame:
    """IPv4, TCP and UDP layers of ``FRAMES`` rows; every frame gives one row.

    Ports are 0 and addresses NULL where a layer is missing. The payload is cut
    at the IP total length, so link-layer padding never counts as data.
    """
    f = F.col("frame")
    start = F.nullif(F.col("ip_at"), F.lit(-1))
    # A fragment after the first carries no transport header.
    first = (be16(f, start + 6).bitwiseAND(F.lit(0x1FFF))) == 0
    ip = (
        frames.withColumn("__l4", start + u8(f, start).bitwiseAND(F.lit(15)) * 4)
        .withColumn("__proto", F.when(first, u8(f, start + 9)))
        .withColumn("ip_len", F.coalesce(be16(f, start + 2), F.lit(0)))
    )
    l4 = F.col("__l4")
    is_tcp = (F.col("__proto") == 6) & (F.length(f) >= l4 + 20)
    is_udp = (F.col("__proto") == 17) & (F.length(f) >= l4 + 8)
    body = F.when(is_tcp, l4 + F.shiftright(u8(f, l4 + 12), 4) * 4).when(is_udp, l4 + 8)
    # Segmentation offload leaves a total length of 0: then the frame end counts.
    ip_end = F.when(F.col("ip_len") == 0, F.length(f)).otherwise(
        F.least(start + F.col("ip_len"), F.length(f))
    )
    has_ports = is_tcp | is_udp
    ts = F.timestamp_micros("ts_us")
    return ip.select(
        "capture_id",
        "packet_number",
        ts.alias("ts"),
        epoch_seconds(ts).alias("ts_epoch"),
        F.when(start.isNotNull(), _address(f, start + 12)).alias("src_ip"),
        F.when(start.isNotNull(), _address(f, start + 16)).alias("dst_ip"),
        F.coalesce(F.when(has_ports, be16(f, l4)), F.lit(0)).alias("src_port"),
        F.coalesce(F.when(has_ports, be16(f, l4 + 2)), F.lit(0)).alias("dst_port"),
        F.coalesce(is_tcp.cast("int"), F.lit(0)).alias("is_tcp"),
        F.coalesce(is_udp.cast("int"), F.lit(0)).alias("is_udp"),
        "frame_len",
        "ip_len",
        F.when(
            is_tcp | is_udp,
            F.substring(f, body + 1, F.greatest(ip_end - body, F.lit(0))),
        ).alias("payload"),
    ).withColumn("protocol", _protocol_name())


def _protocol_name() -> Column:
    out = F
    for p in PROTOCOLS.values():
        out = out.when(
            (F.col("is_tcp") == 1) & ((F.col("dst_port") == p.port) | (F.col("src_port") == p.port)),
            p.name,
        )
    return out.otherwise(F.lit("other"))


# --- protocol headers --------------------------------------------------------


def on_port(packets: DataFrame, protocol: Protocol) -> DataFrame:
    """TCP packets of the protocol: port on either side, IPv4, non-empty payload, right magic."""
    keep = (
        (F.col("is_tcp") == 1)
        & ((F.col("dst_port") == protocol.port) | (F.col("src_port") == protocol.port))
        & F.col("src_ip").isNotNull()
        & (F.length("payload") > 0)
    )
    if protocol.magic:
        keep = keep & (F.substring("payload", 1, len(protocol.magic)) == F.lit(protocol.magic))
    return packets.where(keep)


def modbus_header(packets: DataFrame, raw: str = "payload") -> DataFrame:
    """Transaction, protocol, length, unit, function code and data of the MBAP header: one number, then shifts."""
    b, head = F.col(raw), F.col("__head")
    n = F.length(b)
    return (
        packets.withColumn("__head", head64(b))
        .withColumns(
            {
                "transaction_id": F.when(n >= 7, field(head, 0, 2)),
                "protocol_id": F.when(n >= 7, field(head, 2, 2)),
                "modbus_length": F.when(n >= 7, field(head, 4, 2)),
                "unit_id": F.when(n >= 7, field(head, 6, 1)),
                "function_code": F.when(n >= 8, field(head, 7, 1)),
                "data": F.when(n > 8, rest(b, 8)),
            }
        )
        .drop("__head")
    )


def dnp3_header(packets: DataFrame, raw: str = "payload") -> DataFrame:
    """Link header; ``function_code`` is byte 10, ``app_*`` read the application layer behind it."""
    b = F.col(raw)
    n = F.length(b)
    linked = (n >= 10) & (F.substring(b, 1, 2) == F.lit(DNP3.magic))
    control = u8(b, 11)
    return packets.withColumns(
        {
            "transaction_id": F.when(linked, le16(b, 6)),
            "protocol_id": F.when(linked, F.lit(0)),
            "modbus_length": F.when(linked, u8(b, 2)),
            "unit_id": F.when(linked, le16(b, 4)),
            "function_code": F.when(linked & (n >= 11), u8(b, 10)),
            "data": F.when(linked & (n > 11), rest(b, 11)),
            "app_function_code": F.when(linked & (n >= 13), u8(b, 12)),
            "app_sequence": F.when(linked & (n >= 13), control.bitwiseAND(F.lit(15))),
            "app_first": F.when(linked & (n >= 13), F.shiftright(control, 7)),
            "app_final": F.when(linked & (n >= 13), F.shiftright(control, 6).bitwiseAND(F.lit(1))),
        }
    )


def is_valid(protocol: Protocol) -> Column:
    """Never NULL."""
    ok = F.col("function_code").between(*protocol.code_range) & (F.col("protocol_id") == 0)
    return F.coalesce(ok, F.lit(False))


def function_name(code: Column, protocol: Protocol) -> Column:
    name = F.when(code.isNull(), "Unknown")
    if not protocol.zero_is_known:
        name = name.when(code == 0, "Unknown")
    for number, text in protocol.functions.items():
        name = name.when(code == number, text)
    return name.when(
        code >= 128, F.format_string(protocol.error_text, code - protocol.error_base)
    ).otherwise(F.format_string("Unknown Function Code: %d", code))


def decode(packets: DataFrame, protocol: Protocol, keep_invalid: bool = False) -> DataFrame:
    """Protocol packets with header fields, ``is_valid`` and lengths.

    Invalid packets are dropped unless asked for: only with ``keep_invalid`` can
    Modbus exception responses (codes from 128) be counted later on.
    """
    header = modbus_header if protocol.name == "modbus" else dnp3_header
    out = header(on_port(packets, protocol)).withColumns(
        {
            "packet_length": F.length("payload"),
            "data_length": F.coalesce(F.length("data"), F.lit(0)),
            "function_name": function_name(F.col("function_code"), protocol),
            "is_valid": is_valid(protocol),
        }
    )
    return out if keep_invalid else out.where("is_valid")


BASIC_COLUMNS = [
    "timestamp",
    "src_ip",
    "dst_ip",
    "src_port",
    "dst_port",
    "transaction_id",
    "protocol_id",
    "unit_id",
    "function_code",
    "function_name",
    "packet_length",
    "modbus_length",
    "data_length",
    "is_valid",
]


def basic_features(decoded: DataFrame) -> DataFrame:
    """The fourteen basic columns behind capture and packet number."""
    return decoded.withColumn("timestamp", epoch_seconds(F.col("ts"))).select(
        "capture_id", "packet_number", *BASIC_COLUMNS
    )


def packet_records(decoded: DataFrame) -> DataFrame:
    """One JSON record of thirteen fields per packet."""
    fields = [c for c in BASIC_COLUMNS if c not in ("function_name", "modbus_length")]
    row = decoded.withColumn("timestamp", epoch_seconds(F.col("ts")))
    record = F.struct(*fields, F.col("modbus_length").alias("length"))
    return row.select("capture_id", "packet_number", F.to_json(record).alias("record"))


def with_function_code(decoded: DataFrame, code: int) -> DataFrame:
    return decoded.where(F.col("function_code") == code)


def function_codes(decoded: DataFrame) -> DataFrame:
    return decoded.select("function_code").dropna().distinct().orderBy("function_code")


def capture_audit(packets: DataFrame, protocol: Protocol) -> DataFrame:
    """Frames read, packets on the port and valid packets per capture, empty captures included."""
    header = modbus_header if protocol.name == "modbus" else dnp3_header
    matched = header(on_port(packets, protocol)).select("capture_id", is_valid(protocol).alias("ok"))
    kept = matched.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("protocol_packets"), F.count_if("ok").alias("valid_packets")
    )
    read = packets.groupBy("capture_id").agg(F.count(F.lit(1)).alias("frames"))
    return read.join(kept, "capture_id", "left").fillna(0, ["protocol_packets", "valid_packets"])
