"""Frames of captures as a data source whose reader takes filters.

The part list is written by Spark (``read_parts``) and dealt to files; one input partition is one of these files, so the
driver sees their names only. Filters on capture, packet number, time, ports and protocol are applied in the
reader: parts of other captures are not opened, and frames that fail never leave Python.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from wiregrain.operators.decode import Protocol, decode_frames
from wiregrain.schemas import FRAMES
from wiregrain.session import Scratch
from wiregrain.sources.captures import frames_of, read_parts

FILTERED_FRAMES = f"{FRAMES}, src_port int, dst_port int, is_tcp int, is_udp int, protocol string"

_COMPARE = {
    ds.EqualTo: operator.eq,
    ds.GreaterThan: operator.gt,
    ds.GreaterThanOrEqual: operator.ge,
    ds.LessThan: operator.lt,
    ds.LessThanOrEqual: operator.le,
}
#: Columns that are never NULL; the reader decides filters on these alone.
_TESTED = ("capture_id", "packet_number", "ts_us", "frame_len", "src_port", "dst_port", "is_tcp", "is_udp", "protocol")


@dataclass
class PartList(ds.InputPartition):
    path: str


class FrameReader(ds.DataSourceReader):
    def __init__(self, folder: str):
        self._folder = folder
        self._tests: list[tuple] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in _TESTED and type(f) in _COMPARE and f.value is not None:
                self._tests.append((name, _COMPARE[type(f)], f.value))
            elif name in _TESTED and isinstance(f, ds.In) and None not in f.value:
                self._tests.append((name, None, tuple(f.value)))
            elif name in _TESTED and isinstance(f, ds.IsNotNull):
                continue
            else:
                yield f

    def partitions(self) -> list[PartList]:
        fs, inner = _file_system(self._folder)
        files = fs.get_file_info(pafs.FileSelector(inner))
        return [PartList(f"{self._folder}/{f.base_name}") for f in files if f.base_name.endswith(".parquet")]

    def read(self, partition: PartList) -> Iterator[pa.RecordBatch]:
        fs, inner = _file_system(partition.path)
        for part in pq.read_table(inner, filesystem=fs).to_pylist():
            if part["packets"] and all(_holds(part["capture_id"], t) for t in self._tests if t[0] == "capture_id"):
                yield from frames_of(part, self._chosen)

    def _chosen(self, facts: dict[str, np.ndarray]) -> np.ndarray:
        mask = np.ones(len(facts["packet_number"]), bool)
        for name, compare, value in self._tests:
            if name != "capture_id":
                mask &= np.isin(facts[name], list(value)) if compare is None else compare(facts[name], value)
        return mask


def _holds(value: str, test: tuple) -> bool:
    return value in test[2] if test[1] is None else test[1](value, test[2])


def _file_system(path: str):
    if path.startswith("file:"):
        path = path[5:]
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), "/" + path.lstrip("/")


class CaptureFrames(ds.DataSource):
    """``spark.read.format("capture_frames").load(folder of a part list)``."""

    @classmethod
    def name(cls) -> str:
        return "capture_frames"

    def schema(self) -> str:
        return FILTERED_FRAMES

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"])


def capture_frames(
    spark: SparkSession, root: str, pattern: str = "*.{pcap,pcapng}", parts: DataFrame | None = None
) -> DataFrame:
    """All frames below ``root`` with ports and protocol; filters on these columns reach the reader."""
    parts = read_parts(spark, root, pattern) if parts is None else parts
    usable = parts.where(F.col("packets") > 0)
    folder = f"{Scratch(spark, 'parts').path}/parts"
    usable.repartition(min(max(usable.count(), 1), 100_000)).write.parquet(folder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureFrames)
    return spark.read.format("capture_frames").load(folder)


def read_protocol(
    spark: SparkSession, root: str, protocol: Protocol, pattern: str = "*.{pcap,pcapng}", parts: DataFrame | None = None
) -> DataFrame:
    """Packets of one protocol's port, as ``read_packets`` with a filter on ``protocol`` gives them, without the other frames."""
    frames = capture_frames(spark, root, pattern, parts).where(F.col("protocol") == protocol.name)
    return decode_frames(frames)
