"""Process-model files, attack-event logs, Zeek logs, saved fingerprints and models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiregrain.constants import SAFE_RANGES
from wiregrain.schemas import ZEEK_LOGS, attack_event

_PROCESS_MODEL = (
    "safe_ranges map<string, array<int>>, "
    "plc_targets array<struct<logical_ip: string, unit_id: int>>, "
    "loopback_mapping struct<use_loopback: boolean, loopback_ip: string, base_port: int>"
)


def _process_model(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_PROCESS_MODEL).option("multiLine", True).json(path)
    except AnalysisException:
        return None


def read_safe_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``(register, low, high)`` of a process-model file; the default ranges where there is no file."""
    model = _process_model(spark, path)
    if model is None:
        rows = [(register, *bounds) for register, bounds in SAFE_RANGES.items()]
        return spark.createDataFrame(rows, "register int, low int, high int")
    return model.select(F.explode("safe_ranges").alias("register", "bounds")).select(
        F.col("register").cast("int"),
        F.col("bounds")[0].alias("low"),
        F.col("bounds")[1].alias("high"),
    )


def read_plc_targets(spark: SparkSession, path: str) -> DataFrame:
    """``(logical_ip, unit_id)`` of a process-model file."""
    model = _process_model(spark, path)
    if model is None:
        return spark.createDataFrame([], "logical_ip string, unit_id int")
    return model.select(F.inline("plc_targets"))


def attack_events(lines: DataFrame, fc_field: str = "modbus_fc_used") -> DataFrame:
    """Structured events out of log lines (``value``), for batch and stream alike."""
    json = F.regexp_extract("value", r"ATTACK: (\{.*\})", 1)
    parsed = lines.where(F.col("value").contains("ATTACK: ")).select(
        F.from_json(json, attack_event(fc_field)).alias("e")
    )
    return parsed.where(F.col("e").isNotNull()).select("e.*").withColumn(
        "ts", F.try_to_timestamp("timestamp_utc")
    )


def read_attack_log(spark: SparkSession, path: str, fc_field: str = "modbus_fc_used") -> DataFrame:
    return attack_events(spark.read.text(path), fc_field)


def read_zeek(spark: SparkSession, path: str, log: str) -> DataFrame:
    """A Zeek TSV log with typed columns; dots in names become underscores, ``ts`` also a timestamp."""
    fields = ZEEK_LOGS[log]
    names = [name.replace(".", "_") for name, _ in fields]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("comment", "#")
        .option("nullValue", "-")
        .option("quote", "")
        .csv(path)
    )
    typed = [_zeek_value(F.col(n), kind).alias(n) for n, (_, kind) in zip(names, fields)]
    return raw.select(*typed).withColumn(
        "ts_time", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long"))
    )


def _zeek_value(value: Column, kind: str) -> Column:
    if kind in ("time", "interval"):
        return value.cast("double")
    if kind == "port":
        return value.cast("int")
    if kind == "count":
        return value.cast("long")
    if kind == "bool":
        return F.when(value == "T", True).when(value == "F", False)
    if kind.startswith("set["):
        empty = F.array().cast("array<string>")
        return F.when(value == "(empty)", empty).otherwise(F.split(value, ","))
    return value


def read_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """A long fingerprint saved as JSON lines."""
    return spark.read.schema(
        "src_ip string, dst_ip string, unit_id int, feature string, mean double, std double, n long, "
        "threshold double, count_below long, count_above long"
    ).json(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Summary documents saved as JSON lines: totals, statistics and the distributions of codes and units."""
    return spark.read.json(path)
