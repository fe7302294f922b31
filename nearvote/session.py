"""Session settings that the engine's queries need."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Paths of this process's tables in the shared folder.
_MADE: list[str] = []


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver did, whatever folder they start in."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new folder of this
    machine, which serves a local master alone."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="nearvote-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, for a table that lasts as long as this process."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(remove_tables)
    _MADE.append(path)
    return path


def remove_tables() -> None:
    """Removes what this process has written at new_path, as far as Spark still runs."""
    context = SparkContext._active_spark_context
    while _MADE and context is not None:
        try:
            path = context._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        except (Py4JError, OSError):  # the JVM is gone, or the folder can't be reached: what is left stays
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts lineage, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
