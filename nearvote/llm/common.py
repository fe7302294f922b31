"""What the operators of this subpackage share: the shared folder, held-out rows, bounded labelled samples."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote.session import new_path, written  # noqa: F401  for the operators

#: Rows of the largest bounded sample that a classifier of whole texts is fitted on.
SAMPLE_ROWS = 6000
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8_000_000


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver did, whatever folder they start in; and unless the
    cluster says otherwise, they get Arrow batches of bounded bytes, as rows can be long."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(limit):
        spark.conf.set(limit, BATCH_BYTES)


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier here may learn from. A null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def labelled_ids(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the rows with a label that are not held out; of repeated ids the smallest label."""
    ids = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    return ids.groupBy("doc_id").agg(F.min("y").alias("y"))


def labelled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the rows of labelled_ids that docs has; of repeated ids one text is taken."""
    return (
        docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .where(~held_out(F.col("doc_id")))
        .join(ids, "doc_id")
        .groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("y").alias("y"))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` rows (doc_id, text, y) with a label and not held out, the same at each run.

    Ids are chosen by their hash from `labels` alone; only their texts are then looked up, through a
    broadcast of at most `rows` ids. Of repeated ids one text and the smallest label are taken.
    """
    return labelled_texts(docs, F.broadcast(labelled_ids(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)))


def text_blocks(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none has more than about `most` bytes of text (or one row)."""
    for batch in batches:
        names = batch.schema.names
        col = batch.column(names.index("text"))
        if batch.num_rows < 2 or col.nbytes <= most:
            yield batch
            continue
        step = max(1, int(batch.num_rows * most / col.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
