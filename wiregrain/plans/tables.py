"""The test tables in the roles of packets, attack events and labels.

``events`` rows become real Modbus and DNP3 byte strings, so the queries run the
same decoding a capture goes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiregrain.functions.bytefields import put
from wiregrain.functions.text import epoch_seconds


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; times are UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def _case(column: str, values: dict[str, int], other: int) -> Column:
    out = F
    for key, value in values.items():
        out = out.when(F.col(column) == key, value)
    return out.otherwise(other)


def _little(value: Column) -> Column:
    return F.concat(put(F.pmod(value, F.lit(256)), 1), put(F.floor(value / 256), 1))


def _packets(events: DataFrame, payload: Column, port: int, protocol: str) -> DataFrame:
    answer = F.col("event_type").isin("purchase", "error")
    client = F.concat(F.lit("10.0.0."), (F.col("user_id") % 40).cast("string"))
    server = F.concat(F.lit("10.0.1."), (F.col("user_id") % 7).cast("string"))
    client_port = (40000 + F.col("user_id") % 1000).cast("int")
    rows = events.withColumn("payload", payload)
    return rows.select(
        F.date_format("ts", "yyyy-MM-dd").alias("capture_id"),
        F.col("event_id").alias("packet_number"),
        "ts",
        epoch_seconds(F.col("ts")).alias("ts_epoch"),
        F.when(answer, server).otherwise(client).alias("src_ip"),
        F.when(answer, client).otherwise(server).alias("dst_ip"),
        F.when(answer, F.lit(port)).otherwise(client_port).alias("src_port"),
        F.when(answer, client_port).otherwise(F.lit(port)).alias("dst_port"),
        F.lit(1).alias("is_tcp"),
        F.lit(0).alias("is_udp"),
        (F.length("payload") + 54).alias("frame_len"),
        (F.length("payload") + 40).alias("ip_len"),
        "payload",
        F.lit(protocol).alias("protocol"),
    )


def _body() -> Column:
    times = (F.floor("value") % 23 + 1).cast("int")
    return F.repeat("props", times).cast("binary")


def modbus_packets(spark: SparkSession, folder: str) -> DataFrame:
    """One Modbus packet per event; every 33rd has a wrong protocol id, every 20th a wrong length."""
    n = F.col("event_id")
    code = _case("event_type", {"view": 3, "click": 6, "signup": 23, "purchase": 16}, 131)
    payload = F.concat(
        put(F.col("user_id") % 65536, 2),
        put(F.when(n % 33 == 0, 7).otherwise(0), 2),
        put(F.length(_body()) + 2 + F.when(n % 20 == 0, 5).otherwise(0), 2),
        put(F.col("user_id") % 256, 1),
        put(code, 1),
        _body(),
    )
    return _packets(table(spark, folder, "events"), payload, 502, "modbus")


def dnp3_packets(spark: SparkSession, folder: str) -> DataFrame:
    """One DNP3 packet per event; the application layer follows the transport byte."""
    n, user = F.col("event_id"), F.col("user_id")
    code = _case("event_type", {"view": 1, "click": 2, "signup": 5, "purchase": 129}, 0)
    payload = F.concat(
        F.lit(b"\x05\x64"),
        put(F.length("props") + 4 + n % 5, 1),
        F.lit(b"\x44"),
        _little(user % 65536),
        _little(n % 65536),
        F.lit(b"\x00\x00"),
        put(code, 1),
        put(n % 256, 1),
        put(user % 32, 1),
        F.col("props").cast("binary"),
    )
    return _packets(table(spark, folder, "events"), payload, 20000, "dnp3")


def attack_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as attack records: profile and register by user, category by type."""
    e = table(spark, folder, "events")
    profile = F.element_at(
        F.array(*[F.lit(p) for p in ("P1_APT", "P2_Insider", "P3_Opportunistic", "P9_Unknown")]),
        (F.col("user_id") % 4 + 1).cast("int"),
    )
    category = (
        F.when(F.col("event_type") == "view", "Reconnaissance")
        .when(F.col("event_type") == "error", "Availability")
        .otherwise("Integrity")
    )
    code = _case("event_type", {"view": 3, "click": 6, "signup": 16, "purchase": 15}, 43)
    return e.select(
        "event_id",
        "ts",
        F.date_format("ts", "yyyy-MM-dd").alias("capture_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp_utc"),
        F.concat(F.lit("192.168.1."), (F.col("user_id") % 45).cast("string")).alias("source_ip"),
        F.lit("192.168.1.100").alias("target_ip"),
        (F.col("event_id") % 65536).cast("int").alias("transaction_id"),
        profile.alias("attacker_profile_id"),
        category.alias("attack_category"),
        F.col("event_type").alias("attack_type_detail"),
        code.alias("modbus_fc_used"),
        (40001 + F.col("user_id") % 6).cast("int").alias("target_register_address"),
        F.floor("value").cast("int").alias("injected_value"),
        F.col("value").alias("attack_intensity_rps"),
        F.lit(0.0).alias("induced_delay_ms"),
    )


def labelled_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents as packets of five captures, and the labels table as their packet labels.

    Every 50th label is outside the label set.
    """
    capture = F.concat(F.lit("cap"), (F.col("doc_id") % 5).cast("string")).alias("capture_id")
    number = F.col("doc_id").alias("packet_number")
    documents = table(spark, folder, "documents").select(capture, number, "lang", "source", "n_chars")
    name = F.element_at(
        F.array(*[F.lit(x) for x in ("P3", "P2", "N", "P1")]),
        (F.col("quality") * 2 + F.col("toxic") + 1).cast("int"),
    )
    label = F.when(F.col("doc_id") % 50 == 0, "odd").otherwise(name).alias("label")
    return documents, table(spark, folder, "labels").select(capture, number, label)


def scored_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a true label by user and a rule in place of a model, for the metric queries."""
    names = F.array(*[F.lit(x) for x in ("N", "P1", "P2", "P3")])
    true = (F.col("user_id") % 4).cast("int")
    wrong = F.col("event_id") % 7 >= 5
    guess = F.when(wrong, (true + 1 + F.col("event_id") % 3) % 4).otherwise(true).cast("int")
    confidence = 0.5 + (F.col("event_id") * 37 % 50) / 100
    rows = table(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("capture_id"),
        F.col("event_id").alias("packet_number"),
        "ts",
        F.col("event_type").alias("protocol"),
        F.element_at(names, true + 1).alias("label"),
        F.element_at(names, guess + 1).alias("prediction"),
        guess.alias("guess"),
        confidence.alias("confidence"),
        F.lit(1).alias("is_modbus"),
        F.lit(1).alias("is_tcp"),
        F.lit(0).alias("is_udp"),
    )
    share = (1 - F.col("confidence")) / 3
    return rows.withColumns(
        {
            f"prob_{name}": F.when(F.col("guess") == i, F.col("confidence")).otherwise(share)
            for i, name in enumerate(("N", "P1", "P2", "P3"))
        }
    ).drop("guess")
