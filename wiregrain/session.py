"""Session settings, the shared scratch folder, and the package on the executors."""

from __future__ import annotations

import atexit
import io
import os
import uuid
import zipfile
from contextlib import suppress
from typing import ClassVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "wiregrain", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; cluster settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; with a local master, where all is one machine,
    a folder in the warehouse if that is not set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def _path(spark: SparkSession, path: str):
    """A path of the shared folder and its file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Owner of intermediate tables in the shared folder; ``release`` deletes them, at the latest when Python ends.

    Folder and file system are looked up at once, so that tables can be deleted after the session was stopped.
    """

    _open: ClassVar[dict[str, Scratch]] = {}

    def __init__(self, spark: SparkSession, kind: str = "scratch"):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
        self._at, self._files = _path(spark, self.path)
        Scratch._open[self.path] = self

    def settle(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write an intermediate result and read it back; see ``settle``."""
        path = f"{self.path}/{uuid.uuid4().hex}"
        writer = df.write.mode("error")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Delete the tables; results that were not written yet can no longer be read."""
        self._files.delete(self._at, True)
        Scratch._open.pop(self.path, None)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.release()


_OWNERS: dict[str, Scratch] = {}


def _owner(spark: SparkSession) -> Scratch:
    """The session-wide owner, released at the latest when Python ends."""
    return _OWNERS.setdefault(spark.sparkContext.applicationId, Scratch(spark))


def settle(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Three things follow: the result is computed once, a lost executor costs only
    a re-read, and Spark knows the exact byte size of what it joins next, so
    ``spark.sql.autoBroadcastJoinThreshold`` decides between a broadcast and a
    sort-merge join on facts instead of guesses. ``release_all`` deletes the tables.
    """
    return _owner(df.sparkSession).settle(df, partition_by)


@atexit.register
def release_all() -> None:
    """Delete the tables of all owners; runs by itself when Python ends, also after the session was stopped."""
    _OWNERS.clear()
    for owner in list(Scratch._open.values()):
        with suppress(Py4JError, OSError):  # a JVM that is gone can not delete; its folder stays
            owner.release()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, wherever Python was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(here)))
    at, files = _path(spark, f"{_owner(spark).path}/{os.path.basename(here)}.zip")
    stream = files.create(at, True)
    stream.write(packed.getvalue())
    stream.close()
    context.addPyFile(at.toUri().toString() if at.toUri().getScheme() else at.toString())
