"""Evaluation of searches: recall, agreement, and the calibration of escalation thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote import schema as S

APPROVED = "frauds_ok"


def breakdown(records: DataFrame) -> DataFrame:
    """(fast_count, n, fast_wrong, full_wrong, fixable) for counts 0 to 5 of records (fast_count, fast_worst,
    full_count, expected_approved)."""
    wrong = lambda c: (F.col(c) <= 2) != F.col("expected_approved")
    got = records.groupBy("fast_count").agg(F.count("*").alias("n"), F.count_if(wrong("fast_count")).alias("fast_wrong"), F.count_if(wrong("full_count")).alias("full_wrong"), F.count_if(wrong("fast_count") & ~wrong("full_count")).alias("fixable"))
    classes = records.sparkSession.range(S.TOP + 1).select(F.col("id").cast("int").alias("fast_count"))
    return classes.join(F.broadcast(got), "fast_count", "left").fillna(0)


def thresholds(records: DataFrame) -> DataFrame:
    """(fast_count, threshold): one less than the least worst distance of fixable records; 0 without any, and for
    the counts that escalate anyway."""
    fixable = ((F.col("fast_count") <= 2) != F.col("expected_approved")) & ((F.col("full_count") <= 2) == F.col("expected_approved"))
    got = records.where(fixable & ~F.col("fast_count").isin(*S.AMBIGUOUS)).groupBy("fast_count").agg((F.min("fast_worst") - 1).alias("threshold"))
    classes = records.sparkSession.range(S.TOP + 1).select(F.col("id").cast("int").alias("fast_count"))
    return classes.join(F.broadcast(got), "fast_count", "left").fillna(0)


def _escalated(records: DataFrame, table: DataFrame) -> DataFrame:
    joined = records.join(F.broadcast(table), "fast_count")
    return joined.withColumn("escalated", F.col("fast_count").isin(*S.AMBIGUOUS) | ((F.col("threshold") > 0) & (F.col("fast_worst") > F.col("threshold"))))


def escalations(records: DataFrame, table: DataFrame) -> DataFrame:
    return _escalated(records, table).agg(F.count("*").alias("n"), F.count_if("escalated").alias("escalations"))


def confusion(records: DataFrame, table: DataFrame) -> DataFrame:
    """False positives (declined, expected approved) and false negatives after calibration."""
    approved = F.when(F.col("escalated"), F.col("full_count")).otherwise(F.col("fast_count")) <= 2
    e = F.col("expected_approved")
    return _escalated(records, table).agg(F.count_if(~approved & e).alias("false_positives"), F.count_if(approved & ~e).alias("false_negatives"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(hits, possible, recall) of neighbours (q_id, ref_id) against the true ones."""
    hits = truth.join(found.select("q_id", "ref_id", F.lit(1).alias("hit")), ["q_id", "ref_id"], "left")
    return hits.agg(F.count("hit").alias("hits"), F.count("*").alias("possible"), (F.count("hit") / F.count("*")).alias("recall"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, agreed, share): queries on which two searches (q_id, frauds) approve alike."""
    both = a.select("q_id", (F.col("frauds") <= 2).alias("x")).join(b.select("q_id", (F.col("frauds") <= 2).alias("y")), "q_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("agreed"), (F.count_if(F.col("x") == F.col("y")) / F.count("*")).alias("share"))


def report(records: DataFrame) -> DataFrame:
    """(section, fast_count, measure, value): the whole calibration as one table, to be written. fast_count is -1
    where a value is for all counts."""
    by, table = breakdown(records), thresholds(records)
    all_ = F.lit(-1)
    parts = [("breakdown", by, "fast_count", c) for c in ("n", "fast_wrong", "full_wrong", "fixable")] + [("thresholds", table, "fast_count", "threshold")]
    parts += [("escalations", escalations(records, table), all_, c) for c in ("n", "escalations")] + [("confusion", confusion(records, table), all_, c) for c in ("false_positives", "false_negatives")]
    rows = [df.select(F.lit(section).alias("section"), F.coalesce(key).cast("int").alias("fast_count"), F.lit(c).alias("measure"), F.col(c).cast("long").alias("value")) for section, df, key, c in parts]
    return reduce(DataFrame.unionAll, rows)
