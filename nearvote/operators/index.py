"""The clustered index: seeding, assignment, update, statistics, layout and validation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearvote import schema as S
from nearvote.functions.vectors import is_whole, quantize
from nearvote.operators.topk import _matrix, distances, whole_rows
from nearvote.session import written

#: Clusters that an index may have; so the centroid table is small enough to go to every executor.
MOST_CLUSTERS = 65_536


def centroid_array(centroids: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of centroids (cluster_id, c), by id; at most MOST_CLUSTERS."""
    rows = centroids.select("cluster_id", "c").orderBy("cluster_id").limit(MOST_CLUSTERS + 1).collect()
    if len(rows) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    return np.array([r.cluster_id for r in rows], np.int64), np.array([r.c for r in rows], np.float64).reshape(-1, dims)


def nearest_centroids(rows: DataFrame, centroids: DataFrame, dims: int, n: int, vector: str = "v") -> DataFrame:
    """rows with `probes`, an array of (cluster_id, d) of the n nearest centroids, ties to the lowest id. Rows whose
    vector is null, has null numbers or not `dims` of them are left out."""
    ids, c = centroid_array(centroids, dims)
    whole = dict(rows.dtypes)[vector] not in ("array<double>", "array<float>")
    kind = "bigint" if whole else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole_rows(b, vector, dims) for b in batches):
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                d = distances(_matrix(b.column(vector), dims), c)
                d = d.astype(np.int64) if whole else np.maximum(d, 0.0)
                order = np.argsort(d, axis=1, kind="stable")[:, :n]
                k = order.shape[1]
                flat = pa.StructArray.from_arrays([pa.array(ids[order].ravel()), pa.array(np.take_along_axis(d, order, axis=1).ravel())], ["cluster_id", "d"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), flat)
                yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "probes"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"probes array<struct<cluster_id:bigint,d:{kind}>>").fields]))


def assign(rows: DataFrame, centroids: DataFrame, dims: int, vector: str = "v") -> DataFrame:
    """rows of whole vectors with their nearest centroid's cluster_id and d."""
    near = nearest_centroids(rows, centroids, dims, 1, vector)
    return near.select(*rows.columns, F.col("probes")[0]["cluster_id"].alias("cluster_id"), F.col("probes")[0]["d"].alias("d"))


def update(assigned: DataFrame, clusters: DataFrame, dims: int, vector: str = "v") -> DataFrame:
    """(cluster_id, c): means of members by dimension, one partial aggregation; an empty cluster's is zero."""
    kind = "double" if dict(assigned.dtypes)[vector] in ("array<double>", "array<float>") else "bigint"
    sums = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"), *(F.sum(F.get(vector, F.lit(i)).cast(kind)).alias(f"s{i}") for i in range(dims)))
    means = sums.select("cluster_id", F.array(*(F.col(f"s{i}") / F.col("n") for i in range(dims))).alias("c"))
    return clusters.select("cluster_id").join(F.broadcast(means), "cluster_id", "left").select("cluster_id", F.coalesce("c", F.array_repeat(F.lit(0.0), dims)).alias("c"))


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("d").alias("inertia"))


def quantize_centroids(centroids: DataFrame) -> DataFrame:
    """Float centroids in the scale of vectors; a negative mean becomes the null marker."""
    return centroids.withColumn("c", F.transform("c", quantize))


def sample(rows: DataFrame, n: int, key: str = "ref_id", seed: int = S.SEED) -> DataFrame:
    """n rows without replacement, the same for a seed; all rows where there are no more."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def train(rows: DataFrame, dims: int, k: int = S.CLUSTERS, iterations: int = S.ITERATIONS, sample_rows: int = S.SAMPLE, refines: int = S.REFINES, seed: int = S.SEED) -> DataFrame:
    """(cluster_id, c) of float rows (ref_id, x): two seeded runs on a sample, that of lower inertia (the first on
    a tie), then rounds of assignment and update over all rows."""
    drawn = sample(rows, sample_rows, seed=seed).select(array_to_vector("x").alias("features")).cache()
    models = [KMeans(k=k, maxIter=iterations, tol=0.0, seed=seed + i).fit(drawn) for i in range(2)]
    drawn.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    spark = rows.sparkSession
    found = [(i, [float(x) for x in c]) for i, c in enumerate(best.clusterCenters())]
    ids = spark.range(k).select(F.col("id").alias("cluster_id"))
    centroids = spark.createDataFrame(found + [(i, [0.0] * dims) for i in range(len(found), k)], "cluster_id long, c array<double>")
    for _ in range(refines):
        centroids = update(assign(rows, centroids, dims, "x"), ids, dims, "x")
        centroids = spark.createDataFrame(centroids.collect(), "cluster_id long, c array<double>")  # k rows: cuts lineage
    return centroids


#: The layouts of an index: vectors alone; clusters without boxes and radius; clusters with all.
FLAT, PLAIN, CLUSTERED = "flat", "clustered-plain", "clustered"


@dataclass
class Index:
    """refs (ref_id, label, v, cluster_id, d, pos), and centroids (cluster_id, c, cnt, bmin, bmax, radius). A flat
    one has no clusters: refs (ref_id, label, v), and None."""

    refs: DataFrame
    centroids: DataFrame | None
    dims: int
    format: str = CLUSTERED


def member_order(assigned: DataFrame) -> DataFrame:
    """assigned with `pos`, the place in its cluster by distance to the centroid, then id: the scan order.

    Rows are cut into even ranges of that order, numbered within a range, and moved by what the cluster has in
    ranges before; so a large cluster is many tasks' work."""
    ranges = written(assigned.repartitionByRange("cluster_id", "d", "ref_id").withColumn("_part", F.spark_partition_id()), "ordered")
    counts = ranges.groupBy("cluster_id", "_part").agg(F.count("*").alias("n"))
    before = written(counts.select("cluster_id", "_part", (F.sum("n").over(Window.partitionBy("cluster_id").orderBy("_part")) - F.col("n")).alias("_before")), "ranges")
    own = F.row_number().over(Window.partitionBy("cluster_id", "_part").orderBy("d", "ref_id"))
    return ranges.withColumn("_own", own).join(before, ["cluster_id", "_part"]).withColumn("pos", (F.col("_before") + F.col("_own")).cast("long")).select(*assigned.columns, "pos")


BOXES = "cluster_id long, cnt long, d long, lo array<int>, hi array<int>"


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of BOXES for each cluster of rows of BOXES: at most MOST_CLUSTERS of them are held."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        # As arrays: Spark's batches and tables made here differ in their fields' names and nullability.
        rows = [batch.column(c).to_numpy() for c in ("cluster_id", "cnt", "d")] + [batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("lo", "hi")]
        cluster, cnt, d, lo, hi = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        order = np.argsort(cluster, kind="stable")
        starts = np.flatnonzero(np.diff(cluster[order], prepend=cluster[order[0]] - 1))
        held = [cluster[order][starts], *(f.reduceat(x[order], starts, axis=0) for f, x in ((np.add, cnt), (np.maximum, d), (np.minimum, lo), (np.maximum, hi)))]
    if held is not None:
        sides = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), pa.int32())) for x in held[3:]]
        yield from pa.table([*map(pa.array, held[:3]), *sides], names=["cluster_id", "cnt", "d", "lo", "hi"]).to_batches(max_chunksize=4096)


def statistics(assigned: DataFrame, clusters: DataFrame, dims: int) -> DataFrame:
    """(cluster_id, cnt, bmin, bmax, radius): empty clusters have an inside-out box and radius 0. Each task makes
    a box of its rows of a cluster before any is shuffled."""
    ints = F.col("v").cast("array<int>")
    parts = assigned.select("cluster_id", F.lit(1).cast("long").alias("cnt"), F.col("d").cast("long").alias("d"), ints.alias("lo"), ints.alias("hi")).mapInArrow(_boxes, BOXES)
    got = parts.repartition("cluster_id").mapInArrow(_boxes, BOXES)
    facts = clusters.select("cluster_id").join(got, "cluster_id", "left")
    box = lambda c, empty: F.coalesce(F.col(c), F.array_repeat(F.lit(empty), dims))
    return facts.select("cluster_id", F.coalesce("cnt", F.lit(0)).alias("cnt"), box("lo", 32767).alias("bmin"), box("hi", -32768).alias("bmax"), F.coalesce(F.sqrt("d"), F.lit(0.0)).cast("float").alias("radius"))


def size_statistics(centroids: DataFrame) -> DataFrame:
    return centroids.agg(F.min("cnt").alias("smallest"), F.max("cnt").alias("largest"), F.avg("cnt").alias("mean"))


def build(refs: DataFrame, centroids: DataFrame, dims: int) -> Index:
    """An index of refs (ref_id, label, v) of whole vectors on quantised centroids (cluster_id, c)."""
    assigned = written(assign(refs, centroids, dims), "assigned")
    return Index(member_order(assigned), _with_statistics(assigned, centroids, dims), dims)


def _with_statistics(assigned: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    return centroids.select("cluster_id", "c").join(statistics(assigned, centroids, dims), "cluster_id")


def flat(refs: DataFrame, dims: int) -> Index:
    """An index without clusters, of refs (ref_id, label, v) of whole vectors."""
    return Index(refs.where(is_whole(F.col("v"), dims)).select("ref_id", "label", "v"), None, dims, FLAT)


def save(index: Index, path: str) -> None:
    """refs are partitioned by cluster, so a probe reads its clusters alone; a meta row names the format."""
    if index.format == FLAT:
        index.refs.write.mode("overwrite").parquet(f"{path}/refs")
        facts = index.refs.agg(F.count("*").alias("num_vectors"), F.lit(0).cast("long").alias("num_clusters"))
    else:
        kept = ("cluster_id", "c", "cnt") if index.format == PLAIN else index.centroids.columns
        index.refs.repartition("cluster_id", F.floor(F.col("pos") / 1_000_000)).sortWithinPartitions("cluster_id", "pos").write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/refs")
        index.centroids.select(*kept).write.mode("overwrite").parquet(f"{path}/centroids")
        facts = index.refs.sparkSession.read.parquet(f"{path}/centroids").agg(F.sum("cnt").alias("num_vectors"), F.count("*").alias("num_clusters"))
    facts.select(F.lit(index.format).alias("format"), "num_vectors", F.lit(index.dims).alias("dim_count"), "num_clusters").write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, dims: int = S.DIMS, check: bool = True) -> Index:
    """An index that `save` wrote, by its format: a flat one has vectors alone, a plain one gets its boxes here. An
    error if its format or dimensions are others, it has too many clusters, or (check) it does not hold together."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta.format not in (FLAT, PLAIN, CLUSTERED) or meta.dim_count != dims:
        raise ValueError(f"unknown index: {meta.format}, {meta.dim_count} dimensions")
    if meta.num_clusters > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    refs = spark.read.parquet(f"{path}/refs")
    if meta.format == FLAT:
        index = Index(refs, None, dims, FLAT)
    else:
        refs, centroids = refs.withColumn("cluster_id", F.col("cluster_id").cast("long")), spark.read.parquet(f"{path}/centroids")
        index = Index(refs, centroids, dims, meta.format)
    bad = validate(index, meta.num_vectors).where("problems > 0").collect() if check else []
    if bad:
        raise ValueError(f"broken index: {[(r.check_name, r.problems) for r in bad]}")
    return replace(index, centroids=_with_statistics(refs, centroids, dims), format=CLUSTERED) if meta.format == PLAIN else index


def warm(index: Index) -> int:
    """Holds the vectors on the executors from now on; returns their number."""
    return index.refs.persist().count()


def validate(index: Index, vectors: int | None = None) -> DataFrame:
    """(check_name, problems): labels outside 0 and 1, vectors of other dimensions; members of unknown clusters and
    counts that differ, of clusters or, in a flat index, of all (`vectors`, if given)."""
    refs, known = index.refs, index.centroids
    checks = {
        "labels": refs.agg(F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("problems")),
        "dimensions": refs.agg(F.count_if(~is_whole(F.col("v"), index.dims)).alias("problems")),
    }
    if known is None:
        checks["counts"] = refs.agg(F.when(F.lit(vectors is None) | (F.count("*") == F.lit(vectors or 0)), 0).otherwise(1).alias("problems"))
    else:
        counted = refs.groupBy("cluster_id").agg(F.count("*").alias("n"))
        checks["clusters"] = counted.join(known.select("cluster_id"), "cluster_id", "left_anti").agg(F.sum("n").alias("problems"))
        checks["counts"] = known.select("cluster_id", "cnt").join(counted, "cluster_id", "full").agg(F.count_if(F.coalesce("cnt", F.lit(0)) != F.coalesce("n", F.lit(0))).alias("problems"))
    out = None
    for name, df in checks.items():
        part = df.select(F.lit(name).alias("check_name"), F.coalesce("problems", F.lit(0)).cast("long").alias("problems"))
        out = part if out is None else out.unionAll(part)
    return out


def cluster_vectors(index: Index, cluster_id: int) -> DataFrame:
    return index.refs.where(F.col("cluster_id") == cluster_id)
