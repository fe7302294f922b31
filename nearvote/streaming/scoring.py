"""Scoring of a stream of request bodies: each request alone, without state; micro-batches run the batch plan,
as windows by rank do not run on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearvote.functions.features import vectorize_int16
from nearvote.operators.decision import decode, respond
from nearvote.operators.index import Index
from nearvote.operators.topk import exact_top_k, votes
from nearvote.plans import search


def score(bodies: DataFrame, index: Index, exact: bool = False) -> DataFrame:
    """(q_id, parse_ok, approved, fraud_score, body) of request bodies (q_id, body). What does not parse is
    approved with score 0."""
    rows = vectorize_int16(decode(bodies)).withColumn("parse_ok", F.col("parse_ok") & F.col("v").isNotNull()).select("q_id", "parse_ok", "v")
    good = rows.where("parse_ok").select("q_id", "v")
    counts = votes(exact_top_k(index.refs, good, index.dims), good) if exact else search.ivf(index, good)
    return respond(rows.select("q_id", "parse_ok").join(counts.select("q_id", "frauds"), "q_id", "left")).select("q_id", "parse_ok", "approved", "fraud_score", "body")


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, index: Index, exact: bool = False) -> StreamingQuery:
    """Scores JSON lines {q_id, body} that arrive in the folder `source` into Parquet at `sink`. A batch that is
    run again replaces its own folder, so each request is answered once."""

    def batch(rows: DataFrame, number: int) -> None:
        score(rows, index, exact).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    lines = spark.readStream.schema("q_id long, body string").json(source)
    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
