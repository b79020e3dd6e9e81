"""Packet label files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiregrain.schemas import LABEL_FILE, PACKET_LABELS
from wiregrain.sources.captures import capture_id

_PATTERN = "{pcap_labels*.json,*_labels.json}"
_ONE_LABEL = "packet_number long, label string"


def _text(spark: SparkSession, root: str, **options: object) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", _PATTERN)
    for key, value in options.items():
        reader = reader.option(key, value)
    path = F.col("_metadata.file_path")
    text = reader.text(root).select("value", capture_id(path, root).alias("file"))
    return text.withColumn("dir", F.regexp_extract("file", r"^(.*/)?[^/]+$", 1))


def read_labels(spark: SparkSession, root: str, captures: DataFrame | None = None) -> DataFrame:
    """Rows ``(capture_id, packet_number, label)`` of all label files under ``root``.

    Files name their captures, or hold a bare list that belongs to the first
    capture (by name) of their directory; those need ``captures``. A label file is
    one JSON document, but it is read in pieces that end at each closing brace, so a
    long file splits like any text. Only a file with several captures has to be parsed whole.
    """
    pieces = _text(spark, root, lineSep="}")
    head = r'"([^"]+)"\s*:\s*\{\s*"packet_labels"'
    named = pieces.select("file", F.regexp_extract("value", head, 1).alias("name"))
    owners = (
        named.where(F.col("name") != "")
        .groupBy("file")
        .agg(F.count(F.lit(1)).alias("captures"), F.first("name").alias("name"))
    )
    piece = F.concat(F.regexp_extract("value", r"(\{[^{}]*)$", 1), F.lit("}"))
    label = F.from_json(piece, _ONE_LABEL)
    single = (
        pieces.join(owners, "file", "left")
        .where(F.coalesce(F.col("captures"), F.lit(0)) <= 1)
        .select("file", "dir", "name", label.alias("l"))
        .where(F.col("l.packet_number").isNotNull())
        .select("dir", "name", "l.*")
    )
    several = (
        _text(spark, root, wholetext=True)
        .join(owners.where(F.col("captures") > 1), "file", "left_semi")
        .select("dir", F.explode(F.from_json("value", LABEL_FILE)).alias("name", "doc"))
        .select("dir", "name", F.inline("doc.packet_labels"))
    )
    rows = single.unionByName(several)
    if captures is not None:
        rows = rows.join(first_captures(captures), "dir", "left")
    else:
        rows = rows.withColumn("first_name", F.lit(None).cast("string"))
    # Two files may hold the same label; if they disagree, the one that names its capture wins, then the first label.
    named = rows.withColumn("own", F.col("name").isNull()).withColumn("name", F.coalesce("name", "first_name"))
    placed = named.where(F.col("name").isNotNull()).withColumn("capture_id", F.concat("dir", "name"))
    chosen = placed.groupBy("capture_id", "packet_number").agg(F.min(F.struct("own", "label")).alias("first"))
    return chosen.select("capture_id", "packet_number", F.col("first.label").alias("label"))


class LabelRows:
    """SQL table function over one label document in either shape."""

    def eval(self, document: str):
        parsed = json.loads(document)
        bare = "packet_labels" in parsed
        for name, body in ({None: parsed} if bare else parsed).items():
            for entry in body["packet_labels"]:
                yield name, entry["packet_number"], entry["label"]


def register(spark: SparkSession) -> None:
    """``SELECT * FROM explode_labels(document)`` for SQL users; documents are bounded by their writer."""
    table_function = F.udtf(LabelRows, returnType="capture string, packet_number long, label string")
    spark.udtf.register("explode_labels", table_function)


def first_captures(captures: DataFrame) -> DataFrame:
    """Name of the first capture of every directory."""
    parts = captures.select(
        F.regexp_extract("capture_id", r"^(.*/)?[^/]+$", 1).alias("dir"),
        F.regexp_extract("capture_id", r"([^/]+)$", 1).alias("name"),
    )
    return parts.groupBy("dir").agg(F.min("name").alias("first_name"))


def explode_labels(df: DataFrame, column: str = "value") -> DataFrame:
    """Label rows of JSON documents in either shape, from a string column."""
    doc = F.from_json(column, LABEL_FILE)
    bare = F.from_json(column, PACKET_LABELS)["packet_labels"]
    named = df.select(F.explode(doc).alias("capture", "d")).where(F.col("capture") != "packet_labels")
    return named.select("capture", F.inline("d.packet_labels")).unionByName(
        df.select(F.lit(None).cast("string").alias("capture"), F.inline(bare))
    )
