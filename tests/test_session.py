import os
import subprocess
import sys

import pytest

from nearvote import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_tables_go_with_the_process(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from nearvote.session import written
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
print(written(spark.range(5), "numbers").count(), len(list(__import__("pathlib").Path("{tmp_path}").glob("numbers-*"))))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True, env=os.environ | {"PYTHONPATH": ROOT})
    assert done.stdout.split() == ["5", "1"] and not list(tmp_path.glob("numbers-*"))


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())
    assert session.new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
