"""Explicit schemas: no source in this package infers one."""

from __future__ import annotations

from pyspark.sql import types as T

PACKETS = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("packet_number", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ts_epoch", T.DoubleType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("is_tcp", T.IntegerType()),
        T.StructField("is_udp", T.IntegerType()),
        T.StructField("frame_len", T.IntegerType()),
        T.StructField("ip_len", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("protocol", T.StringType()),
    ]
)

FRAMES = (
    "capture_id string, packet_number long, ts_us long, frame_len int, ip_at int, frame binary"
)
CAPTURE_PARTS = (
    "capture_id string, path string, first_packet long, packets long, begin long, size long, "
    "kind string, byte_order string, link_types array<int>, ticks array<long>, problem string"
)

CAPTURE_SEGMENTS = (
    "capture_id string, path string, length long, segment long, kind string, entry long, entry_order string, exit long, "
    "exit_order string, fresh boolean, links array<int>, ticks array<long>, need int, faces int, packets long, stopped boolean, "
    "parts array<struct<offset: long, packets: long, begin: long, size: long, fresh: boolean, byte_order: string, "
    "links: array<int>, ticks: array<long>, problem: string>>"
)

PACKET_LABELS = T.StructType(
    [
        T.StructField(
            "packet_labels",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("packet_number", T.LongType()),
                        T.StructField("label", T.StringType()),
                    ]
                )
            ),
        )
    ]
)
LABEL_FILE = T.MapType(T.StringType(), PACKET_LABELS)


def attack_event(fc_field: str = "modbus_fc_used") -> T.StructType:
    """Attack event record; DNP3 logs name the code field ``dnp3_fc_used``."""
    return T.StructType(
        [
            T.StructField("timestamp_utc", T.StringType()),
            T.StructField("source_ip", T.StringType()),
            T.StructField("target_ip", T.StringType()),
            T.StructField("transaction_id", T.IntegerType()),
            T.StructField("attacker_profile_id", T.StringType()),
            T.StructField("attack_category", T.StringType()),
            T.StructField("attack_type_detail", T.StringType()),
            T.StructField(fc_field, T.IntegerType()),
            T.StructField("target_register_address", T.IntegerType()),
            T.StructField("injected_value", T.IntegerType()),
            T.StructField("attack_intensity_rps", T.DoubleType()),
            T.StructField("induced_delay_ms", T.DoubleType()),
        ]
    )


_ENDPOINTS = [
    ("ts", "time"),
    ("uid", "string"),
    ("id.orig_h", "addr"),
    ("id.orig_p", "port"),
    ("id.resp_h", "addr"),
    ("id.resp_p", "port"),
]

# Zeek logs as (column, Zeek type), in file order.
ZEEK_LOGS: dict[str, list[tuple[str, str]]] = {
    "conn": _ENDPOINTS
    + [
        ("proto", "enum"),
        ("service", "string"),
        ("duration", "interval"),
        ("orig_bytes", "count"),
        ("resp_bytes", "count"),
        ("conn_state", "string"),
        ("local_orig", "bool"),
        ("local_resp", "bool"),
        ("missed_bytes", "count"),
        ("history", "string"),
        ("orig_pkts", "count"),
        ("orig_ip_bytes", "count"),
        ("resp_pkts", "count"),
        ("resp_ip_bytes", "count"),
        ("tunnel_parents", "set[string]"),
    ],
    "modbus": _ENDPOINTS + [("func", "string"), ("exception", "string")],
    "dnp3": _ENDPOINTS + [("fc_request", "string"), ("fc_reply", "string"), ("iin", "count")],
    "weird": _ENDPOINTS
    + [("name", "string"), ("addl", "string"), ("notice", "bool"), ("peer", "string")],
    "packet_filter": [
        ("ts", "time"),
        ("node", "string"),
        ("filter", "string"),
        ("init", "bool"),
        ("success", "bool"),
    ],
}
