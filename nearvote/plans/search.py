"""Clustered search as joins: probes of the nearest clusters, and more of them for queries that stay unsure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote import schema as S
from nearvote.functions.vectors import box_bound, squared_l2
from nearvote.operators.index import FLAT, Index, nearest_centroids
from nearvote.operators.topk import exact_top_k, top_k, votes
from nearvote.session import written


def ranked_probes(index: Index, queries: DataFrame, n: int) -> DataFrame:
    """(q_id, v, cluster_id, d, probe_rank) of the n nearest clusters; empty ones take a place as well."""
    near = nearest_centroids(queries.select("q_id", "v"), index.centroids, index.dims, n)
    return near.select("q_id", "v", F.posexplode("probes").alias("i", "p")).select("q_id", "v", F.col("p.cluster_id").alias("cluster_id"), F.col("p.d").alias("d"), (F.col("i") + 1).alias("probe_rank"))


def scan(index: Index, probes: DataFrame) -> DataFrame:
    """(q_id, dist, probe_rank, pos, ref_id, label) of the members of probed clusters: an equi-join."""
    members = index.refs.select("cluster_id", "ref_id", "label", "pos", F.col("v").alias("rv"))
    return probes.join(members, "cluster_id").select("q_id", squared_l2(F.col("v"), F.col("rv"), index.dims).alias("dist"), "probe_rank", "pos", "ref_id", "label")


ORDER = ("dist", "probe_rank", "pos")


def fast(index: Index, queries: DataFrame, probes: int = S.FAST_PROBES) -> tuple[DataFrame, DataFrame]:
    """The top of the nearest clusters alone, and its votes."""
    nearest = top_k(scan(index, ranked_probes(index, queries, probes)), *ORDER)
    return nearest, votes(nearest, queries)


def escalates(frauds, worst, thresholds: dict[int, int] = S.THRESHOLDS, ambiguous=S.AMBIGUOUS):
    """An ambiguous count, or a worst distance beyond the count's threshold (0: none)."""
    far = [(frauds == n) & (worst > t) for n, t in thresholds.items() if t > 0]
    return reduce(lambda a, b: a | b, far, frauds.isin(*ambiguous))


def ivf(index: Index, queries: DataFrame, fast_probes: int = S.FAST_PROBES, extra: int = S.EXTRA_PROBES, thresholds: dict[int, int] = S.THRESHOLDS, ambiguous=S.AMBIGUOUS) -> DataFrame:
    """(q_id, frauds, fast_frauds, worst, escalated). Extra clusters are read for escalated queries alone."""
    ranked = ranked_probes(index, queries, fast_probes + extra)
    # Each is used more than once.
    ranked = written(ranked, "probes")
    first = written(top_k(scan(index, ranked.where(F.col("probe_rank") <= fast_probes)), *ORDER), "first")
    told = votes(first, queries).select("q_id", F.col("frauds").alias("fast_frauds"), "worst", escalates(F.col("frauds"), F.col("worst"), thresholds, ambiguous).alias("escalated"))
    told = written(told, "told")
    unsure = told.where("escalated").select("q_id")
    more = scan(index, ranked.where(F.col("probe_rank") > fast_probes).join(unsure, "q_id", "left_semi"))
    merged = top_k(first.drop("rank").unionByName(more), *ORDER)
    return votes(merged, queries).drop("worst").join(told, "q_id").select("q_id", "frauds", "fast_frauds", "worst", "escalated")


def full(index: Index, queries: DataFrame) -> DataFrame:
    """(q_id, frauds, worst) of all vectors."""
    return votes(exact_top_k(index.refs, queries, index.dims), queries)


def dispatch(index: Index, queries: DataFrame, thresholds: dict[int, int] = S.THRESHOLDS) -> DataFrame:
    """(q_id, frauds) by the index's format: exhaustive for a flat one, by clusters for others."""
    return (full(index, queries) if index.format == FLAT else ivf(index, queries, thresholds=thresholds)).select("q_id", "frauds")


def legacy(index: Index, queries: DataFrame, nprobe: int, retry_extra: int) -> DataFrame:
    """Counts 2 and 3 alone escalate, and no distance does; nprobe <= 0 finds nothing."""
    if nprobe <= 0:
        return queries.select("q_id", F.lit(0).alias("frauds"))
    return ivf(index, queries, nprobe, retry_extra, {}, (2, 3)).select("q_id", "frauds")


def box_bounds(index: Index, queries: DataFrame, probes: int, kind: str = "bigint") -> DataFrame:
    """(q_id, cluster_id, probe_rank, bound) of the probed clusters: the least distance to any member. By kind as
    whole numbers, or as float or double of the scale of features."""
    boxes = index.centroids.select("cluster_id", "bmin", "bmax", "cnt")
    ranked = ranked_probes(index, queries, probes).join(F.broadcast(boxes), "cluster_id").where("cnt > 0")
    scaled = lambda c: F.col(c) if kind == "bigint" else F.transform(c, lambda x: x.cast("double") / S.SCALE)
    return ranked.select("q_id", "cluster_id", "probe_rank", box_bound(scaled("v"), scaled("bmin"), scaled("bmax"), index.dims, kind).alias("bound"))
