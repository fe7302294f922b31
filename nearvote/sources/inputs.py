"""Readers of the engine's inputs, and adapters that make them from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote import schema as S
from nearvote.functions.vectors import quantize
from nearvote.session import importable, written

#: Fixed values of the adapter: a merchant category for each kind of event.
EVENT_MCC = {"click": "5411", "error": "7995", "purchase": "5812", "signup": "9999", "view": "7801"}


def label_code(label: Column) -> Column:
    """fraud 1, legit 0, anything else an error."""
    return F.when(label == "fraud", 1).when(label == "legit", 0).otherwise(F.raise_error(F.concat(F.lit("unexpected label "), F.coalesce(label, F.lit("null"))))).cast("int")


def read_references(spark: SparkSession, path: str, parts: int = 64, lines: bool = False) -> DataFrame:
    """(ref_id, x, v, label) of JSON arrays of {vector, label}, or (lines) of one such object a line, plain or
    gzip. A file is one task's; so rows are dealt out afterwards. ref_id grows with the files and the places in
    them."""
    rows = spark.read.schema(S.REFERENCE).option("multiLine", not lines).json(path).withColumn("ref_id", F.monotonically_increasing_id())
    return rows.repartition(parts).select("ref_id", F.col("vector").alias("x"), F.transform("vector", quantize).alias("v"), label_code(F.col("label")).alias("label"))


def read_evaluation(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(q_id, request, expected_approved) of a JSON document {entries: [...]}, or (lines) of one such document a line;
    q_id is the place in the document."""
    kind = f"entries array<struct<request:struct<{S.PAYLOAD}>,expected_approved:boolean>>"
    rows = spark.read.schema(kind).option("multiLine", not lines).json(path)
    return rows.select(F.posexplode("entries").alias("q_id", "e")).select(F.col("q_id").cast("long").alias("q_id"), "e.request", "e.expected_approved")


def embedding_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, x, v, label) of the table embeddings; odd labels count as fraud."""
    importable(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("x"), F.transform("embedding", quantize).alias("v"), (F.col("label") % 2).cast("int").alias("label"))


def search_queries(refs: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return refs.where(F.col("ref_id") % 100 == 0).select(F.col("ref_id").alias("q_id"), "x", "v", "label")


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads from all events, with event_id and event_type. The history of a customer is made from plain
    aggregates, so no customer's events gather in a task."""
    importable(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cents = F.round(F.col("value") * 100).cast("long")
    # Tables of their own: a join that reuses an aggregate's partitions can't split a hot customer's.
    days = written(events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("tx"), F.sum(cents).alias("cents")), "days")
    users = written(days.groupBy("user_id").agg((F.sum("cents") / (F.sum("tx") * 100)).alias("avg_amount")), "users")
    days = days.drop("cents")
    merchants = events.groupBy(F.col("event_type").alias("event_type")).agg((F.sum(cents) / (F.count("*") * 100)).alias("merchant_avg"))
    rows = events.withColumn("day", F.to_date("ts")).join(users, "user_id").join(days, ["user_id", "day"]).join(F.broadcast(merchants), "event_type")
    e = F.col("event_id")
    stamp = lambda t: F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    mcc = F.create_map(*(F.lit(x) for pair in EVENT_MCC.items() for x in pair))
    return rows.select(
        "event_id", "event_type", e.cast("string").alias("id"),
        F.struct(F.col("value").alias("amount"), (e % 14).alias("installments"), stamp(F.col("ts")).alias("requested_at")).alias("transaction"),
        F.struct("avg_amount", F.col("tx").alias("tx_count_24h"), F.array(F.concat(F.lit("m"), (e % 7).cast("string")), F.concat(F.lit("m"), (e % 5).cast("string"))).alias("known_merchants")).alias("customer"),
        F.struct(F.concat(F.lit("m"), (e % 11).cast("string")).alias("id"), F.try_element_at(mcc, F.col("event_type")).alias("mcc"), F.col("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct((e % 2 == 0).alias("is_online"), (e % 3 == 0).alias("card_present"), ((e * 13) % 1500).cast("double").alias("km_from_home")).alias("terminal"),
        F.when(e % 5 != 0, F.struct(stamp(F.col("ts") - F.make_dt_interval(mins=((e * 17) % 3000 - 100).cast("int"))).alias("timestamp"), ((e * 7) % 1200).cast("double").alias("km_from_current"))).alias("last_transaction"),
    )
