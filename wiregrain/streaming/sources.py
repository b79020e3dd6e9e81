"""Packet streams from files that land in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiregrain.operators.decode import decode_frames
from wiregrain.schemas import PACKETS
from wiregrain.sources.captures import capture_id, capture_parts, read_frames
from wiregrain.sources.logs import attack_events


def packet_stream(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    schema: T.StructType = PACKETS,
    **options: object,
) -> DataFrame:
    """Packets from Parquet or JSON files; pass ``maxFilesPerTrigger`` or the like to size the batches."""
    reader = spark.readStream.format(format).schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def capture_stream(spark: SparkSession, root: str, pattern: str = "*.{pcap,pcapng}") -> DataFrame:
    """Packets of capture files as they arrive; each file is cut into parts as in batch."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(root)
    )
    parts = capture_parts(files.select(capture_id(F.col("path"), root), "path"))
    return decode_frames(read_frames(parts))


def attack_stream(spark: SparkSession, path: str, fc_field: str = "modbus_fc_used") -> DataFrame:
    """Attack events from log files that grow by new files."""
    return attack_events(spark.readStream.text(path), fc_field)


def drop_repeats(packets: DataFrame, late: str = "2 minutes") -> DataFrame:
    """Drop packets delivered twice; state is kept only as long as the watermark allows."""
    return packets.withWatermark("ts", late).dropDuplicatesWithinWatermark(
        ["capture_id", "packet_number"]
    )
