"""Votes to answers; anything that fails to parse is approved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearvote import schema as S


def decide(frauds: Column) -> tuple[Column, Column]:
    """(approved, fraud_score) of a fraud count among the nearest."""
    score = frauds / F.lit(float(S.TOP))
    return score < S.DECLINE_AT, score


def respond(counted: DataFrame) -> DataFrame:
    """counted (frauds, parse_ok) with approved, fraud_score and the JSON body. A count out of range, or a
    request that did not parse, gets the default answer: approved with score 0."""
    ok = F.coalesce(F.col("parse_ok") & F.col("frauds").between(0, S.TOP), F.lit(False))
    approved, score = decide(F.col("frauds"))
    out = counted.withColumn("approved", F.when(ok, approved).otherwise(True)).withColumn("fraud_score", F.when(ok, score).otherwise(0.0))
    return out.withColumn("body", F.format_string('{"approved":%s,"fraud_score":%.1f}', F.col("approved").cast("string"), F.col("fraud_score")))


def decode(bodies: DataFrame) -> DataFrame:
    """bodies (id, body) with the payload's fields and parse_ok: valid JSON of the right types."""
    parsed = F.from_json("body", f"{S.PAYLOAD}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    rows = bodies.withColumn("_p", parsed).withColumn("parse_ok", F.coalesce(F.col("_p").isNotNull() & F.col("_p._corrupt_record").isNull(), F.lit(False)))
    return rows.select(*bodies.columns, "parse_ok", *(F.col(f"_p.{f}").alias(f) for f in S.PAYLOAD_FIELDS if f not in bodies.columns))
