"""Supervised packet classifier: features, split, scaling, training and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiregrain.constants import FOREST, LABELS, SEED, TEST_SHARE
from wiregrain.functions.text import label_name
from wiregrain.operators.decode import DNP3, MODBUS, dnp3_header, modbus_header
from wiregrain.operators.labels import balanced_weights
from wiregrain.operators.spread import HOT_ROWS
from wiregrain.operators.windows import inter_arrival
from wiregrain.session import settle

FEATURES = [
    "packet_size",
    "ip_len",
    "src_port",
    "dst_port",
    "is_tcp",
    "is_udp",
    "inter_arrival_time",
    "is_modbus",
    "mb_func_code",
    "mb_read_coils",
    "mb_write_reg",
    "is_dnp3",
    "dnp3_func_code",
    "dnp3_app_seq",
    "dnp3_app_fir",
    "dnp3_app_fin",
]

# Sentinels: the packet is not of this protocol / the field could not be read.
_OTHER, _UNKNOWN = -2, -1


def modbus_ml_features(packets: DataFrame) -> DataFrame:
    """``is_modbus``, code, and whether it is a register read (code 3) or write (code 6) request."""
    port = F.lit(MODBUS.port)
    on = (
        (F.col("is_tcp") == 1)
        & ((F.col("dst_port") == port) | (F.col("src_port") == port))
        & (F.coalesce(F.length("payload"), F.lit(0)) > 0)
    )
    code, request = F.col("function_code"), F.col("dst_port") == port
    header = ["transaction_id", "protocol_id", "modbus_length", "unit_id", "function_code", "data"]
    return (
        modbus_header(packets)
        .withColumns(
            {
                "is_modbus": on.cast("int"),
                "mb_func_code": F.when(on, F.coalesce(code, F.lit(_UNKNOWN))).otherwise(_OTHER),
                "mb_read_coils": F.coalesce((on & request & (code == 3)).cast("int"), F.lit(0)),
                "mb_write_reg": F.coalesce((on & request & (code == 6)).cast("int"), F.lit(0)),
            }
        )
        .drop(*header)
    )


def dnp3_ml_features(packets: DataFrame) -> DataFrame:
    """``is_dnp3`` with application function code, sequence and first/final bits."""
    port = F.lit(DNP3.port)
    on = (
        (F.col("is_tcp") == 1)
        & ((F.col("dst_port") == port) | (F.col("src_port") == port))
        & F.coalesce(F.substring("payload", 1, 2) == F.lit(DNP3.magic), F.lit(False))
    )
    fields = {
        "dnp3_func_code": ("app_function_code", _OTHER),
        "dnp3_app_seq": ("app_sequence", _UNKNOWN),
        "dnp3_app_fir": ("app_first", _UNKNOWN),
        "dnp3_app_fin": ("app_final", _UNKNOWN),
    }
    decoded = dnp3_header(packets).withColumn("is_dnp3", on.cast("int"))
    return decoded.withColumns(
        {
            name: F.when(on, F.coalesce(F.col(source), F.lit(_UNKNOWN))).otherwise(other)
            for name, (source, other) in fields.items()
        }
    ).drop(
        "transaction_id",
        "protocol_id",
        "modbus_length",
        "unit_id",
        "function_code",
        "data",
        *[source for source, _ in fields.values()],
    )


def packet_fields(packets: DataFrame) -> DataFrame:
    """The classifier features that a packet has by itself, for batch and streams."""
    return (
        packets.transform(modbus_ml_features)
        .transform(dnp3_ml_features)
        .withColumn("packet_size", F.col("frame_len"))
        .drop("payload", "frame_len")
    )


def packet_ml_features(packets: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Classifier features of every frame of every capture, with its ids."""
    return packet_fields(packets).transform(inter_arrival, hot_rows=hot_rows)


# --- split ------------------------------------------------------------------------

_CELLS = 1 << 18


def stratified_split(
    df: DataFrame,
    label: str,
    keys: Sequence[str],
    test_share: float = TEST_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Add ``is_test``: exactly ``round(share * n)`` rows of each label, chosen by a hash of ``keys``.

    The hash space is cut into cells. Cell counts say which cells are all test and
    which are all training; only the one cell per label where the border falls is sorted.
    """
    hashed = df.withColumn("__h", F.xxhash64(*keys, F.lit(seed)))
    hashed = hashed.withColumn("__cell", F.pmod(F.col("__h"), F.lit(_CELLS)).cast("int"))
    cells = hashed.groupBy(label, "__cell").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(label).orderBy("__cell")
    want = F.round(F.sum("c").over(Window.partitionBy(label)) * test_share)
    ends = cells.withColumns({"end": F.sum("c").over(upto), "want": want})
    border = settle(
        ends.where((F.col("end") > F.col("want")) & (F.col("end") - F.col("c") <= F.col("want"))).select(
            label,
            F.col("__cell").alias("__border"),
            (F.col("want") - (F.col("end") - F.col("c"))).cast("long").alias("__need"),
        )
    )
    placed = hashed.join(border, label, "left")
    # Without a border row the whole label is test (share 1).
    whole = F.coalesce(F.col("__cell") < F.col("__border"), F.lit(True))
    clear = placed.where(~F.coalesce(F.col("__cell") == F.col("__border"), F.lit(False)))
    edge = placed.where(F.col("__cell") == F.col("__border"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("__h", *keys))
    out = clear.withColumn("is_test", whole).unionByName(
        edge.withColumn("is_test", rank <= F.col("__need"))
    )
    return out.drop("__h", "__cell", "__border", "__need")


def folds(df: DataFrame, keys: Sequence[str], k: int = 5, seed: int = SEED) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(*keys, F.lit(seed + 1)), F.lit(k)).cast("int"))


# --- scaling and training -----------------------------------------------------------


def scaler_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation per column (1 where there is no spread)."""
    aggs = []
    for c in columns:
        std = F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))
        aggs += [F.avg(c).alias(f"{c}_mean"), std.alias(f"{c}_std")]
    return df.agg(*aggs)


def scale(df: DataFrame, columns: Sequence[str], table: DataFrame | None = None) -> DataFrame:
    """``<c>_scaled`` columns."""
    table = scaler_table(df, columns) if table is None else table
    s = table.select(F.struct(*table.columns).alias("s")).scalar()
    return df.withColumns(
        {f"{c}_scaled": (F.col(c) - s[f"{c}_mean"]) / s[f"{c}_std"] for c in columns}
    )


def _scaling_stage(train: DataFrame, columns: Sequence[str]) -> SQLTransformer:
    """The fitted scaler as a stage that is saved with the model; its numbers are two per feature."""
    fitted = scaler_table(train, columns).first()
    terms = ", ".join(
        f"(`{c}` - {fitted[f'{c}_mean']!r}D) / {fitted[f'{c}_std']!r}D AS `{c}_scaled`" for c in columns
    )
    return SQLTransformer(statement=f"SELECT *, {terms} FROM __THIS__")


def train_classifier(
    train: DataFrame,
    features: Sequence[str] = tuple(FEATURES),
    label: str = "numeric_label",
    **forest: object,
) -> PipelineModel:
    """Scaler, assembler and a class-balanced random forest as one persistable model."""
    weights = balanced_weights(train, label).select(label, "weight")
    # One row per class of the label set.
    weighted = train.join(F.broadcast(weights), label)
    stages = [
        _scaling_stage(train, features),
        VectorAssembler(inputCols=[f"{c}_scaled" for c in features], outputCol="features"),
        RandomForestClassifier(
            labelCol=label, featuresCol="features", weightCol="weight", **{**FOREST, **forest}
        ),
    ]
    return Pipeline(stages=stages).fit(weighted)


def score(model: PipelineModel, df: DataFrame, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Prediction, confidence and one probability per label next to the input columns."""
    p = vector_to_array(F.col("probability"))
    probs = {
        f"prob_{name}": F.coalesce(F.try_element_at(p, F.lit(number + 1)), F.lit(0.0))
        for name, number in LABELS.items()
    }
    out = model.transform(df).withColumns(
        {
            **probs,
            "confidence": F.array_max(p),
            "predicted_label": F.col("prediction").cast("int"),
        }
    )
    out = out.withColumn("prediction", label_name(F.col("predicted_label")))
    return out.drop("rawPrediction", "probability", "features", *[f"{c}_scaled" for c in features])


def feature_importance(
    model: PipelineModel, features: Sequence[str] = tuple(FEATURES), protocol: str | None = None
) -> DataFrame:
    """Features by importance with the running total; ``protocol`` keeps that protocol's own features."""
    values = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(features, map(float, values)), key=lambda fv: (-fv[1], fv[0]))
    rows, total = [], 0.0
    for position, (name, value) in enumerate(ranked, 1):
        total += value
        rows.append((position, name, value, total, total >= 0.95))
    schema = "position int, feature string, importance double, cumulative double, past_95 boolean"
    table = SparkSession.active().createDataFrame(rows, schema)
    own = {"modbus": r"mb_|modbus", "dnp3": r"dnp3"}
    return table.where(F.col("feature").rlike(own[protocol])) if protocol else table


def top_features(importance: DataFrame, k: int = 15) -> DataFrame:
    return importance.orderBy("position").limit(k)


def protocol_importance(
    model: PipelineModel,
    dataset: DataFrame,
    features: Sequence[str] = tuple(FEATURES),
    min_rows: int = 100,
) -> DataFrame:
    """Importance of each protocol's own features, for protocols with more than ``min_rows`` packets."""
    counts = dataset.groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"))
    enough = counts.where(F.col("packets") > min_rows)
    own = [
        feature_importance(model, features, name).withColumn("protocol", F.lit(name))
        for name in ("modbus", "dnp3")
    ]
    return own[0].unionByName(own[1]).join(enough, "protocol")


def learning_curve(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str] = tuple(FEATURES),
    label: str = "numeric_label",
    sizes: Sequence[float] = tuple(i / 10 for i in range(1, 11)),
    k: int = 5,
    **forest: object,
) -> DataFrame:
    """Mean and deviation of training and validation accuracy per training size, over ``k`` folds.

    The driver loops over fits; every fit and every accuracy is a Spark job on all rows of its part.
    """
    parts = settle(folds(df.select(*keys, *features, label), keys, k))
    share = F.pmod(F.xxhash64(*keys, F.lit(SEED + 2)), F.lit(10_000)) / 10_000
    results = []
    for size in sizes:
        for fold in range(k):
            train = parts.where((F.col("fold") != fold) & (share < size))
            held = parts.where(F.col("fold") == fold)
            model = train_classifier(train, features, label, **forest)

            def accuracy(rows: DataFrame) -> float:
                hit = (F.col("prediction") == F.col(label)).cast("int")
                return model.transform(rows).agg(F.avg(hit)).first()[0]

            results.append((size, fold, accuracy(train), accuracy(held)))
    scores = df.sparkSession.createDataFrame(
        results, "train_share double, fold int, train double, validation double"
    )
    return scores.groupBy("train_share").agg(
        F.avg("train").alias("train_mean"),
        F.stddev_pop("train").alias("train_std"),
        F.avg("validation").alias("validation_mean"),
        F.stddev_pop("validation").alias("validation_std"),
    )
