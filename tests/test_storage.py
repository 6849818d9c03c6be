"""Tables of an application leave nothing behind."""

import subprocess
import sys
from pathlib import Path

import pytest

from tracemill import storage

SCRIPT = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, sys.argv[2])
from tracemill.storage import written
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", sys.argv[1]).getOrCreate())
stored = written(spark.range(5))
assert stored.count() == 5 and sys.argv[1] in stored.inputFiles()[0]
spark.stop()
"""


def test_no_folder_is_left_over(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path), root], check=True, timeout=120)
    assert not list(tmp_path.rglob("*.parquet"))


def test_clear(spark):
    stored = storage.written(spark.range(3))
    folder = storage.app_dir(spark)
    assert stored.count() == 3 and Path(folder.removeprefix("file:")).exists()
    storage.clear(spark)
    assert not Path(folder.removeprefix("file:")).exists()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
