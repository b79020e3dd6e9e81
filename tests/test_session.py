"""Scratch tables: who deletes them, and where they may be."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from wiregrain import session as S

SCRIPT = """
import sys
from wiregrain.session import Scratch, build_session, settle
from wiregrain.streaming.jobs import run_available

spark = build_session("local[2]", **{"spark.checkpoint.dir": sys.argv[1] + "/shared", "spark.ui.enabled": "false"})
Scratch(spark).settle(spark.range(5))
settle(spark.range(7)).count()
spark.range(9).write.parquet(sys.argv[1] + "/in")
print(run_available(spark.readStream.schema("id long").parquet(sys.argv[1] + "/in")).count())
spark.stop()
"""


def test_nothing_stays_after_the_application(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(S.__file__)))
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": root}, check=True)
    assert done.stdout.strip().endswith("9")
    # Spark itself makes an empty folder for checkpoints.
    assert not [x for x in os.listdir(tmp_path / "shared") if x.startswith(("scratch-", "stream-"))]


def test_release_deletes_the_tables(spark):
    with S.Scratch(spark) as scratch:
        table = scratch.settle(spark.range(3))
        assert table.count() == 3 and scratch.path in S.Scratch._open
    assert scratch.path not in S.Scratch._open and not os.path.exists(scratch.path.removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.shared_dir(Session)
