"""Streaming forms of rules and scoring, and a runner for finite runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrain.operators.decode import Protocol, decode
from wiregrain.operators.detect import FEATURES, packet_fields, score
from wiregrain.operators.features import entropy_features, operation_flags, validation_flags
from wiregrain.operators.rules import flag_anomalies
from wiregrain.session import Scratch
from wiregrain.streaming.gaps import gap_stream
from wiregrain.streaming.rolling import rolling_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: What rules and reports read besides the rolling features.
RULE_COLUMNS = (
    "src_ip",
    "dst_ip",
    "function_name",
    "is_read_operation",
    "is_write_operation",
    "is_error_response",
    "protocol_id_valid",
    "unit_id_valid",
    "length_consistent",
)


def feature_stream(packets: DataFrame, protocol: Protocol, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Everything the rules read, of a stream of raw packets: header, flags and entropy per packet, then keyed state."""
    rows = decode(packets, protocol)
    rows = validation_flags(operation_flags(entropy_features(rows, protocol), protocol), protocol)
    return rolling_stream(rows, keys, RULE_COLUMNS)


def flag_stream(features: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rules against a stored baseline: a stream-static join whose size Spark knows from the stored files."""
    return flag_anomalies(features, baseline)


def ml_feature_stream(packets: DataFrame) -> DataFrame:
    """Classifier features of a stream of raw packets: header fields per packet, the time gap from keyed state."""
    return gap_stream(packet_fields(packets))


def score_stream(model: PipelineModel, features: DataFrame, columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    return score(model, features, columns)


def alert_writer(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: attack packets of a batch, one folder per batch so that a retry overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where(F.col("prediction") != "N").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_available(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now, to a Parquet folder in the shared scratch space, and read it back."""
    spark = stream.sparkSession
    base = Scratch(spark, "stream").path
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", checkpoint or f"{base}/state")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
