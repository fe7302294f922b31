"""The engine's queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote import schema as S
from nearvote.functions.features import feature_columns, vectorize_int16
from nearvote.functions.vectors import bool_to_int8, dim_differences, squared_l2
from nearvote.operators import evaluate, index as ix
from nearvote.operators.decision import respond
from nearvote.operators.topk import all_distances, exact_top_k, sorted_neighbours, top_k, votes
from nearvote.plans import search
from nearvote.session import new_path, written
from nearvote.sources import inputs
from nearvote.streaming import scoring

D = 64
K = 64
#: For the test vectors, whose distances are far beyond those the default thresholds fit.
T = {0: 30_000_000_000, 1: 28_000_000_000, 2: 0, 3: 0, 4: 0, 5: 30_000_000_000}
NAMES = [f"f{i}" for i in range(S.DIMS)]
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _refs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    refs = inputs.embedding_refs(spark, sf)
    return refs, inputs.search_queries(refs)


def _seeds(refs: DataFrame) -> DataFrame:
    """The first K vectors are the first centroids."""
    return refs.where(F.col("ref_id") < K).select(F.col("ref_id").alias("cluster_id"), F.col("v").alias("c"))


def _centroids(refs: DataFrame) -> DataFrame:
    """One assignment and one update, rounded to whole numbers."""
    seeds = _seeds(refs)
    means = ix.update(ix.assign(refs.select("ref_id", "v"), seeds, D), seeds, D)
    return means.select("cluster_id", F.transform("c", lambda x: F.round(x).cast("smallint")).alias("c"))


#: By application and tables, the path of the index that was saved.
_SAVED: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, sf: str) -> ix.Index:
    """The index of the vectors: built and saved once, then loaded."""
    key = spark.sparkContext.applicationId, sf
    if key in _SAVED:
        try:
            return ix.load(spark, _SAVED[key], D, check=False)
        except AnalysisException:  # its folder is gone
            del _SAVED[key]
    refs, path = _refs(spark, sf)[0], new_path(spark, "index")
    ix.save(ix.build(refs.select("ref_id", "label", "v"), _centroids(refs), D), path)
    _SAVED[key] = path
    return ix.load(spark, path, D, check=False)


# SQL parts.
_Q = "CASE WHEN x < 0 THEN -32768 ELSE round(least(x::DOUBLE, 1.0) * 32767)::BIGINT END"
_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
d2 = lambda a, b: _D2.format(a=a, b=b)
REFS = f"refs AS (SELECT vec_id AS ref_id, label % 2 AS label, embedding::DOUBLE[] AS x, list_transform(embedding, lambda x: {_Q}) AS v FROM embeddings), q AS (SELECT ref_id AS q_id, v, x FROM refs WHERE ref_id % 100 = 0)"
PAIRS = f"{REFS}, pairs AS (SELECT q_id, ref_id, label, {d2('q.v', 'r.v')} AS dist FROM q CROSS JOIN refs r)"
NEAR = f"{PAIRS}, near AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, ref_id) AS rank FROM pairs QUALIFY rank <= 5)"
VOTES = f"{NEAR}, counts AS (SELECT q_id, sum(label)::INTEGER AS frauds, coalesce(max(dist) FILTER (rank = 5), 4611686018427387904) AS worst FROM near GROUP BY q_id)"
SEEDS = f"{REFS}, seeds AS (SELECT ref_id AS cluster_id, v AS c FROM refs WHERE ref_id < {K}), first AS (SELECT ref_id, v, x, cluster_id, d FROM (SELECT r.ref_id, r.v, r.x, s.cluster_id, {d2('r.v', 's.c')} AS d FROM refs r CROSS JOIN seeds s) QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY d, cluster_id) = 1)"
MEANS = f"{SEEDS}, dims AS (SELECT unnest(range(1, {D + 1})) AS i), means AS (SELECT s.cluster_id, i, coalesce(sum(f.v[i]) / count(f.ref_id), 0.0)::DOUBLE AS m FROM seeds s CROSS JOIN dims LEFT JOIN first f ON f.cluster_id = s.cluster_id GROUP BY s.cluster_id, i)"
CLUSTERS = f"{MEANS}, cent AS (SELECT cluster_id, list(round(m)::BIGINT ORDER BY i) AS c FROM means GROUP BY cluster_id), memb AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY d, ref_id) AS pos FROM (SELECT r.ref_id, r.label, r.v, cluster_id, {d2('r.v', 'c')} AS d FROM refs r CROSS JOIN cent QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY d, cluster_id) = 1))"
STATS = f"{CLUSTERS}, stats AS (SELECT c.cluster_id, count(m.ref_id) AS cnt, coalesce(sqrt(max(m.d)), 0)::FLOAT AS radius FROM cent c LEFT JOIN memb m USING (cluster_id) GROUP BY c.cluster_id)"
BOXES = f"{CLUSTERS}, boxes AS (SELECT c.cluster_id, i, coalesce(min(m.v[i]), 32767)::INTEGER AS lo, coalesce(max(m.v[i]), -32768)::INTEGER AS hi, count(m.ref_id) AS cnt FROM cent c CROSS JOIN dims LEFT JOIN memb m ON m.cluster_id = c.cluster_id GROUP BY c.cluster_id, i)"
RANKS = f"{CLUSTERS}, ranks AS (SELECT q_id, q.v, cluster_id, {d2('q.v', 'c')} AS d, row_number() OVER (PARTITION BY q_id ORDER BY {d2('q.v', 'c')}, cluster_id)::INTEGER AS probe_rank FROM q CROSS JOIN cent)"


def _ivf_sql(fast: int, extra: int, thresholds: dict[int, int], ambiguous=S.AMBIGUOUS) -> str:
    far = " OR ".join([f"fast_frauds IN ({', '.join(map(str, ambiguous))})", *(f"(fast_frauds = {n} AND worst > {t})" for n, t in thresholds.items() if t)])
    top = "row_number() OVER (PARTITION BY q_id ORDER BY dist, probe_rank, pos) AS rank"
    return f"""{RANKS}, cand AS (SELECT q_id, probe_rank, pos, ref_id, label, {d2('ranks.v', 'm.v')} AS dist FROM ranks JOIN memb m USING (cluster_id) WHERE probe_rank <= {fast + extra}),
    t1 AS (SELECT *, {top} FROM cand WHERE probe_rank <= {fast} QUALIFY rank <= 5),
    fastc AS (SELECT q.q_id, coalesce(sum(label), 0)::INTEGER AS fast_frauds, coalesce(max(dist) FILTER (rank = 5), 4611686018427387904) AS worst FROM q LEFT JOIN t1 USING (q_id) GROUP BY q.q_id),
    told AS (SELECT *, ({far}) AS escalated FROM fastc),
    t2 AS (SELECT q_id, ref_id, label, dist, {top} FROM cand JOIN told USING (q_id) WHERE escalated OR probe_rank <= {fast} QUALIFY rank <= 5),
    ivf AS (SELECT told.q_id, coalesce(sum(label), 0)::INTEGER AS frauds, any_value(fast_frauds) AS fast_frauds, any_value(worst) AS worst, any_value(escalated) AS escalated FROM told LEFT JOIN t2 USING (q_id) GROUP BY told.q_id)"""


IVF = _ivf_sql(2, 32, T)


@query(f"WITH {REFS} SELECT ref_id, unnest(range({D})) AS dim, unnest(v) AS value FROM refs")
def quantize_vectors(spark, sf):
    return _refs(spark, sf)[0].select("ref_id", F.posexplode("v").alias("dim", "value"))


_DIST = "WITH {0} SELECT q_id, ref_id, dist FROM pairs"


@query(_DIST.format(PAIRS))
def l2_distance_int16(spark, sf):
    refs, queries = _refs(spark, sf)
    return all_distances(refs, queries, D).select("q_id", "ref_id", "dist")


@query(f"WITH {CLUSTERS} SELECT ref_id, round(list_sum(list_transform(list_zip(r.x, c.c), lambda p: (p[1] - p[2] / 32767.0::DOUBLE) * (p[1] - p[2] / 32767.0::DOUBLE))), 6) AS dist FROM memb JOIN refs r USING (ref_id) JOIN cent c USING (cluster_id)")
def l2_distance_float(spark, sf):
    refs, _ = _refs(spark, sf)
    i = _index(spark, sf)
    scaled = i.centroids.select("cluster_id", F.transform("c", lambda x: x / F.lit(32767.0)).alias("cx"))
    return i.refs.select("ref_id", "cluster_id").join(refs.select("ref_id", "x"), "ref_id").join(F.broadcast(scaled), "cluster_id").select("ref_id", F.round(squared_l2(F.col("x"), F.col("cx"), D, "double"), 6).alias("dist"))


@query(f"WITH {NEAR} SELECT q_id, rank, ref_id, dist, label FROM near")
def knn_bruteforce(spark, sf):
    refs, queries = _refs(spark, sf)
    return exact_top_k(refs, queries, D).select("q_id", "rank", "ref_id", "dist", "label")


@query(f"WITH {PAIRS} SELECT q_id, ref_id, dist, row_number() OVER (PARTITION BY q_id ORDER BY dist, ref_id DESC) AS rank FROM pairs QUALIFY rank <= 5")
def topk_last_wins(spark, sf):
    refs, queries = _refs(spark, sf)
    blocks = exact_top_k(refs.withColumn("ref_id", -F.col("ref_id")), queries, D)
    return blocks.select("q_id", (-F.col("ref_id")).alias("ref_id"), "dist", "rank")


@query(f"WITH {NEAR} SELECT q_id, string_agg(ref_id || ':' || dist || ':' || label, ',' ORDER BY rank) AS neighbours FROM near GROUP BY q_id")
def topk_sorted(spark, sf):
    refs, queries = _refs(spark, sf)
    near = sorted_neighbours(exact_top_k(refs, queries, D))
    return near.select("q_id", F.array_join(F.transform("neighbours", lambda n: F.concat_ws(":", n["ref_id"], n["dist"], n["label"])), ",").alias("neighbours"))


@query(f"WITH {REFS} SELECT q_id, (ref_id // 8)::BIGINT AS block, string_agg((q.v[6] - r.v[6])::VARCHAR, ',' ORDER BY ref_id) AS differences FROM q CROSS JOIN refs r WHERE r.ref_id // 8 = q_id // 8 GROUP BY 1, 2")
def block_difference(spark, sf):
    """In one dimension, how far the eight vectors of a query's block are from it."""
    refs, queries = _refs(spark, sf)
    blocks = refs.groupBy(F.floor(F.col("ref_id") / 8).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_id", "v"))), lambda x: x["v"]).alias("vs"))
    rows = queries.withColumn("block", F.floor(F.col("q_id") / 8)).join(blocks, "block")
    return rows.select("q_id", "block", F.array_join(dim_differences(F.col("v"), F.col("vs"), 5), ",").alias("differences"))


@query(f"WITH {VOTES} SELECT q_id, frauds, worst FROM counts")
def fraud_vote(spark, sf):
    refs, queries = _refs(spark, sf)
    return votes(exact_top_k(refs, queries, D), queries)


@query(f"""WITH {VOTES} SELECT q_id, frauds <= 2 AS approved, frauds / 5.0::DOUBLE AS fraud_score, '{{"approved":' || (frauds <= 2)::VARCHAR || ',"fraud_score":' || (frauds / 5.0)::DECIMAL(2, 1) || '}}' AS body FROM counts""")
def decide(spark, sf):
    return respond(fraud_vote(spark, sf).withColumn("parse_ok", F.lit(True))).select("q_id", "approved", "fraud_score", "body")


@query(f"WITH {SEEDS} SELECT ref_id, cluster_id, d FROM first")
def kmeans_seed_assign(spark, sf):
    refs, _ = _refs(spark, sf)
    return ix.assign(refs.select("ref_id", "v"), _seeds(refs), D).select("ref_id", "cluster_id", "d")


@query(f"WITH {MEANS} SELECT cluster_id, i - 1 AS dim, round(m, 6) AS mean FROM means")
def kmeans_update(spark, sf):
    refs, _ = _refs(spark, sf)
    seeds = _seeds(refs)
    return ix.update(ix.assign(refs.select("ref_id", "v"), seeds, D), seeds, D).select("cluster_id", F.posexplode("c").alias("dim", "m")).select("cluster_id", "dim", F.round("m", 6).alias("mean"))


@query(f"WITH {SEEDS} SELECT sum(d)::BIGINT AS inertia FROM first")
def kmeans_inertia(spark, sf):
    refs, _ = _refs(spark, sf)
    return ix.inertia(ix.assign(refs.select("ref_id", "v"), _seeds(refs), D))


@query(f"WITH {MEANS} SELECT cluster_id, i - 1 AS dim, CASE WHEN m < 0 THEN -32768 ELSE round(least(m / 32767, 1.0) * 32767)::INTEGER END AS value FROM means")
def centroid_quantize(spark, sf):
    refs, _ = _refs(spark, sf)
    seeds = _seeds(refs)
    means = ix.update(ix.assign(refs.select("ref_id", "v"), seeds, D), seeds, D).select("cluster_id", F.transform("c", lambda x: x / 32767).alias("c"))
    return ix.quantize_centroids(means).select("cluster_id", F.posexplode("c").alias("dim", "value"))


@query(f"WITH {BOXES} SELECT cluster_id, i - 1 AS dim, lo, hi FROM boxes")
def cluster_bbox(spark, sf):
    c = _index(spark, sf).centroids
    return c.select("cluster_id", F.posexplode(F.arrays_zip("bmin", "bmax")).alias("dim", "b")).select("cluster_id", "dim", F.col("b.bmin").alias("lo"), F.col("b.bmax").alias("hi"))


@query(f"WITH {STATS} SELECT cluster_id, cnt FROM stats")
def cluster_sizes(spark, sf):
    return _index(spark, sf).centroids.select("cluster_id", "cnt")


@query(f"WITH {STATS} SELECT min(cnt) AS smallest, max(cnt) AS largest, avg(cnt) AS mean FROM stats")
def cluster_size_stats(spark, sf):
    return ix.size_statistics(_index(spark, sf).centroids)


@query(f"WITH {STATS} SELECT cluster_id, radius FROM stats")
def cluster_radius(spark, sf):
    return _index(spark, sf).centroids.select("cluster_id", "radius")


@query(f"WITH {CLUSTERS} SELECT cluster_id, ref_id, pos FROM memb")
def cluster_member_order(spark, sf):
    return _index(spark, sf).refs.select("cluster_id", "ref_id", "pos")


def _ranks(spark, sf, low, high):
    refs, queries = _refs(spark, sf)
    ranked = search.ranked_probes(ix.Index(refs, _centroids(refs), D), queries, high)
    return ranked.where(F.col("probe_rank") >= low).select("q_id", "cluster_id", "d", "probe_rank")


@query(f"WITH {RANKS} SELECT q_id, cluster_id, d, probe_rank FROM ranks")
def rank_centroids(spark, sf):
    return _ranks(spark, sf, 1, K)


@query(f"WITH {RANKS} SELECT q_id, cluster_id, d, probe_rank FROM ranks WHERE probe_rank <= 2")
def pick_top2(spark, sf):
    return _ranks(spark, sf, 1, 2)


@query(f"WITH {RANKS} SELECT q_id, cluster_id, d, probe_rank FROM ranks WHERE probe_rank BETWEEN 3 AND 34")
def pick_next32(spark, sf):
    return _ranks(spark, sf, 3, 34)


_BOUND = f"{BOXES}, ranks AS (SELECT q_id, q.v, cluster_id FROM q CROSS JOIN cent), bounds AS (SELECT q_id, ranks.cluster_id, sum(greatest(lo - v[i], v[i] - hi, 0) ** 2)::BIGINT AS bound FROM ranks JOIN boxes ON boxes.cluster_id = ranks.cluster_id WHERE cnt > 0 GROUP BY q_id, ranks.cluster_id)"


@query(f"WITH {_BOUND} SELECT q_id, cluster_id, bound FROM bounds")
def bbox_lower_bound(spark, sf):
    refs, queries = _refs(spark, sf)
    return search.box_bounds(_index(spark, sf), queries, K).select("q_id", "cluster_id", "bound")


@query(f"WITH {_BOUND.replace('** 2)::BIGINT', '/ 32767.0::DOUBLE) ** 2)').replace('sum(greatest', 'sum((greatest')} SELECT q_id, cluster_id, round(bound, 6) AS bound FROM bounds")
def bbox_lower_bound_float(spark, sf):
    queries = _refs(spark, sf)[1]
    return search.box_bounds(_index(spark, sf), queries, K, "double").select("q_id", "cluster_id", F.round("bound", 6).alias("bound"))


@query(f"WITH {_BOUND}, pairs AS (SELECT q_id, ref_id, label, {d2('q.v', 'r.v')} AS dist FROM q CROSS JOIN refs r), near AS (SELECT q_id, dist FROM pairs QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY dist, ref_id) = 5) SELECT q_id, count(*) AS clusters, count(*) FILTER (bound < dist) AS kept FROM bounds JOIN near USING (q_id) GROUP BY q_id")
def bbox_prune(spark, sf):
    """How many clusters a bound by the fifth distance keeps."""
    refs, queries = _refs(spark, sf)
    worst = votes(exact_top_k(refs, queries, D), queries)
    return search.box_bounds(_index(spark, sf), queries, K).join(worst, "q_id").groupBy("q_id").agg(F.count("*").alias("clusters"), F.count_if(F.col("bound") < F.col("worst")).alias("kept"))


@query(f"WITH {CLUSTERS} SELECT ref_id, label, pos FROM memb WHERE cluster_id = 3")
def cluster_lookup(spark, sf):
    return ix.cluster_vectors(_index(spark, sf), 3).select("ref_id", "label", "pos")


@query(f"WITH {IVF} SELECT q_id, fast_frauds AS frauds, worst FROM told")
def search_fast_only(spark, sf):
    refs, queries = _refs(spark, sf)
    return search.fast(_index(spark, sf), queries)[1]


@query(f"WITH {VOTES} SELECT q_id, frauds, worst FROM counts")
def search_full(spark, sf):
    refs, queries = _refs(spark, sf)
    return search.full(ix.Index(refs, refs, D), queries)


@query(f"WITH {IVF} SELECT q_id, frauds, fast_frauds, worst, escalated FROM ivf")
def search_ivf(spark, sf):
    refs, queries = _refs(spark, sf)
    return search.ivf(_index(spark, sf), queries, thresholds=T)


@query(f"WITH {IVF} SELECT q_id, frauds FROM ivf")
def search_dispatch_clustered(spark, sf):
    """A saved index with clusters but no boxes, loaded and searched by its format."""
    i, path = _index(spark, sf), new_path(spark, "plain")
    ix.save(ix.replace(i, format=ix.PLAIN), path)
    return search.dispatch(ix.load(spark, path, D), _refs(spark, sf)[1], T)


@query(f"WITH {VOTES} SELECT q_id, frauds FROM counts")
def search_dispatch_flat(spark, sf):
    """A saved flat index, loaded and searched by its format."""
    refs, queries = _refs(spark, sf)
    path = new_path(spark, "flat")
    ix.save(ix.flat(refs, D), path)
    return search.dispatch(ix.load(spark, path, D), queries, T)


@query("SELECT count(*) AS vectors FROM embeddings")
def index_warmup(spark, sf):
    i = _index(spark, sf)
    n = ix.warm(i)
    i.refs.unpersist()
    return spark.range(1).select(F.lit(n).cast("long").alias("vectors"))


@query(f"WITH {_ivf_sql(2, 8, T)} SELECT q_id, frauds FROM ivf")
def search_topn(spark, sf):
    refs, queries = _refs(spark, sf)
    return search.ivf(_index(spark, sf), queries, extra=8, thresholds=T).select("q_id", "frauds")


@query(f"WITH {_ivf_sql(4, 8, {}, (2, 3))} SELECT q_id, frauds FROM ivf")
def search_legacy(spark, sf):
    refs, queries = _refs(spark, sf)
    return search.legacy(_index(spark, sf), queries, 4, 8)


# Events.
_cl = lambda x: f"least(greatest({x}, 0.0), 1.0)"
_MCC = " ".join(f"WHEN '{k}' THEN {S.MCC_RISK.get(v, S.MCC_DEFAULT)}::DOUBLE" for k, v in inputs.EVENT_MCC.items())
EVENTS = f"""users AS (SELECT user_id, sum(round(value * 100)::BIGINT)::DOUBLE / (count(*) * 100) AS avg_amount FROM events GROUP BY user_id),
days AS (SELECT user_id, ts::DATE AS day, count(*) AS tx FROM events GROUP BY 1, 2),
kinds AS (SELECT event_type, sum(round(value * 100)::BIGINT)::DOUBLE / (count(*) * 100) AS merchant_avg FROM events GROUP BY 1),
feats AS (SELECT event_id AS ref_id, event_type, (event_type = 'error')::INTEGER AS label, [
  {_cl('value / 10000')}, {_cl('(event_id % 14)::DOUBLE / 12')},
  CASE WHEN avg_amount = 0 THEN CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END ELSE {_cl('(value / avg_amount) / 10')} END,
  hour(ts)::DOUBLE / 23, (isodow(ts) - 1)::DOUBLE / 6,
  CASE WHEN event_id % 5 = 0 THEN -1.0 ELSE {_cl('((event_id * 17) % 3000 - 100)::DOUBLE / 1440')} END,
  CASE WHEN event_id % 5 = 0 THEN -1.0 ELSE {_cl('((event_id * 7) % 1200)::DOUBLE / 1000')} END,
  {_cl('((event_id * 13) % 1500)::DOUBLE / 1000')}, {_cl('tx::DOUBLE / 20')},
  (event_id % 2 = 0)::INTEGER::DOUBLE, (event_id % 3 = 0)::INTEGER::DOUBLE,
  CASE WHEN event_id % 11 IN (event_id % 7, event_id % 5) THEN 0.0 ELSE 1.0 END,
  CASE event_type {_MCC} END, {_cl('merchant_avg / 10000')}]::DOUBLE[] AS f
  FROM events e JOIN users USING (user_id) JOIN days ON days.user_id = e.user_id AND days.day = e.ts::DATE JOIN kinds USING (event_type)),
refs AS (SELECT ref_id, label, list_transform(f, lambda x: {_Q}) AS v FROM feats), q AS (SELECT ref_id AS q_id, v, label FROM refs WHERE ref_id % 100 = 0)"""
EVENT_NEAR = f"{EVENTS}, near AS (SELECT q_id, ref_id, r.label, {d2('q.v', 'r.v')} AS dist, row_number() OVER (PARTITION BY q_id ORDER BY dist, ref_id) AS rank FROM q CROSS JOIN refs r QUALIFY rank <= 5), counts AS (SELECT q_id, sum(label)::INTEGER AS frauds FROM near GROUP BY q_id)"


@query(f"WITH {EVENTS} SELECT ref_id AS event_id, " + ", ".join(f"round(f[{i + 1}], 9) AS {n}" for i, n in enumerate(NAMES)) + " FROM feats")
def features_float(spark, sf):
    return inputs.event_payloads(spark, sf).select("event_id", *(F.round(c, 9).alias(n) for c, n in zip(feature_columns(), NAMES, strict=True)))


@query(f"WITH {EVENTS} SELECT ref_id AS event_id, " + ", ".join(f"v[{i + 1}]::INTEGER AS {n}" for i, n in enumerate(NAMES)) + " FROM refs")
def features_int16(spark, sf):
    rows = vectorize_int16(inputs.event_payloads(spark, sf))
    # Within the lambda a vector is one value; 14 columns of it would be computed anew each.
    return rows.select("event_id", F.inline(F.transform(F.array("v"), lambda v: F.struct(*(v[i].cast("int").alias(n) for i, n in enumerate(NAMES))))))


def _event_refs(spark, sf) -> DataFrame:
    """The events' vectors, as a table: references, queries and votes all read them."""
    rows = vectorize_int16(inputs.event_payloads(spark, sf))
    return written(rows.select(F.col("event_id").alias("ref_id"), "v", (F.col("event_type") == "error").cast("int").alias("label")), "event-refs")


_ANSWER = """frauds <= 2 AS approved, frauds / 5.0::DOUBLE AS fraud_score"""


@query(f"WITH {EVENT_NEAR} SELECT q_id, frauds, {_ANSWER} FROM counts")
def score_transactions(spark, sf):
    refs = _event_refs(spark, sf)
    queries = refs.where(F.col("ref_id") % 100 == 0).select(F.col("ref_id").alias("q_id"), "v")
    counts = votes(exact_top_k(refs, queries, S.DIMS), queries)
    return respond(counts.withColumn("parse_ok", F.lit(True))).select("q_id", "frauds", "approved", "fraud_score")


def _bodies(spark, sf) -> DataFrame:
    """Request bodies of the query events; some damaged: not JSON, a wrong type, a timestamp without a zone."""
    rows = inputs.event_payloads(spark, sf).where(F.col("event_id") % 100 == 0)
    good = F.to_json(F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction"))
    kind = F.floor(F.col("event_id") / 100) % 5
    body = F.when(kind == 1, F.lit("invalid")).when(kind == 2, F.regexp_replace(good, '"installments":[0-9]+', '"installments":"x"')).when(kind == 3, F.regexp_replace(good, 'Z"', '"')).otherwise(good)
    return rows.select(F.col("event_id").alias("q_id"), body.alias("body"))


@query(f"WITH {EVENT_NEAR} SELECT q_id, (q_id // 100) % 5 NOT IN (1, 2, 3) AS parse_ok, (q_id // 100) % 5 IN (1, 2, 3) OR frauds <= 2 AS approved, CASE WHEN (q_id // 100) % 5 IN (1, 2, 3) THEN 0.0 ELSE frauds / 5.0 END::DOUBLE AS fraud_score FROM counts")
def score_fail_open(spark, sf):
    return scoring.score(_bodies(spark, sf), ix.Index(_event_refs(spark, sf), None, S.DIMS), exact=True).drop("body")


@query("SELECT label % 2 AS label, count(*) AS n, sum(" + _Q.replace("x", "embedding[1]") + ")::BIGINT AS total FROM embeddings GROUP BY 1")
def reference_scan(spark, sf):
    """The vectors written as compressed JSON and read back: rows and the sum of the first number by label."""
    refs, path = _refs(spark, sf)[0], new_path(spark, "references")
    # As doubles: a float's shortest decimal, read as a double, is another number, which can round the other way.
    refs.select(F.col("x").cast("array<double>").alias("vector"), F.when(F.col("label") == 1, F.lit("fraud")).otherwise(F.lit("legit")).alias("label")).write.json(path, compression="gzip")
    rows = inputs.read_references(spark, path, lines=True)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("v")[0].cast("long")).alias("total"))


@query("SELECT event_id, (event_id % 2 = 0)::INTEGER AS online, (event_id % 3 = 0)::INTEGER AS present FROM events")
def bool_flags(spark, sf):
    rows = inputs.event_payloads(spark, sf)
    return rows.select("event_id", bool_to_int8(F.col("terminal.is_online")).cast("int").alias("online"), bool_to_int8(F.col("terminal.card_present")).cast("int").alias("present"))


@query(f"WITH {EVENTS} SELECT q_id, label = 0 AS expected_approved FROM q")
def eval_explode(spark, sf):
    """An evaluation document of all events, written as one JSON file a part, and read back; of its entries the query set."""
    rows = inputs.event_payloads(spark, sf)
    path = new_path(spark, "files")
    entry = F.struct(F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction").alias("request"), (F.col("event_type") != "error").alias("expected_approved"))
    rows.select(F.array(entry).alias("entries")).write.json(path, compression="gzip", ignoreNullFields=False)
    return inputs.read_evaluation(spark, path, lines=True).select(F.col("request.id").cast("long").alias("q_id"), "expected_approved").where("q_id % 100 = 0")


# Calibration: fast against full search of the vectors; a query's own label is the expected answer.
RECORDS = f"{IVF}, fullc AS (SELECT q_id, sum(label)::INTEGER AS full_count FROM (SELECT q_id, r.label, row_number() OVER (PARTITION BY q_id ORDER BY {d2('q.v', 'r.v')}, ref_id) AS rank FROM q CROSS JOIN refs r QUALIFY rank <= 5) GROUP BY q_id), rec AS (SELECT told.q_id, fast_frauds AS fast_count, worst AS fast_worst, full_count, refs.label = 0 AS expected_approved FROM told JOIN fullc USING (q_id) JOIN refs ON refs.ref_id = told.q_id)"
_FW, _LW = "((fast_count <= 2) <> expected_approved)", "((full_count <= 2) <> expected_approved)"
THR = f"{RECORDS}, classes AS (SELECT unnest(range(6))::INTEGER AS fast_count), thr AS (SELECT c.fast_count, coalesce(min(fast_worst) FILTER ({_FW} AND NOT {_LW}) - 1, 0) AS threshold FROM classes c LEFT JOIN rec r ON r.fast_count = c.fast_count AND r.fast_count NOT IN (2, 3, 4) GROUP BY c.fast_count), esc AS (SELECT *, fast_count IN (2, 3, 4) OR (threshold > 0 AND fast_worst > threshold) AS esc FROM rec JOIN thr USING (fast_count))"


def _records(spark, sf) -> DataFrame:
    refs, queries = _refs(spark, sf)
    fast = search.fast(_index(spark, sf), queries)[1].select("q_id", F.col("frauds").alias("fast_count"), F.col("worst").alias("fast_worst"))
    full = votes(exact_top_k(refs, queries, D), queries).select("q_id", F.col("frauds").alias("full_count"))
    return fast.join(full, "q_id").join(queries.select("q_id", (F.col("label") == 0).alias("expected_approved")), "q_id")


@query(f"WITH {RECORDS}, classes AS (SELECT unnest(range(6))::INTEGER AS fast_count) SELECT c.fast_count, count(q_id) AS n, count(*) FILTER ({_FW.replace('fast_count', 'r.fast_count')}) AS fast_wrong, count(*) FILTER ({_LW}) AS full_wrong, count(*) FILTER ({_FW.replace('fast_count', 'r.fast_count')} AND NOT {_LW}) AS fixable FROM classes c LEFT JOIN rec r ON r.fast_count = c.fast_count GROUP BY c.fast_count")
def calibrate_breakdown(spark, sf):
    return evaluate.breakdown(_records(spark, sf))


@query(f"WITH {THR.replace(_FW + ' AND', _FW.replace('fast_count', 'r.fast_count') + ' AND')} SELECT fast_count, threshold FROM thr")
def calibrate_thresholds(spark, sf):
    return evaluate.thresholds(_records(spark, sf))


@query(f"WITH {THR.replace(_FW + ' AND', _FW.replace('fast_count', 'r.fast_count') + ' AND')} SELECT count(*) AS n, count(*) FILTER (esc) AS escalations FROM esc")
def calibrate_escalations(spark, sf):
    records = _records(spark, sf)
    return evaluate.escalations(records, evaluate.thresholds(records))


@query(f"WITH {THR.replace(_FW + ' AND', _FW.replace('fast_count', 'r.fast_count') + ' AND')}, said AS (SELECT expected_approved AS e, CASE WHEN esc THEN full_count ELSE fast_count END <= 2 AS a FROM esc) SELECT count(*) FILTER (NOT a AND e) AS false_positives, count(*) FILTER (a AND NOT e) AS false_negatives FROM said")
def calibrate_confusion(spark, sf):
    records = _records(spark, sf)
    return evaluate.confusion(records, evaluate.thresholds(records))


def _report_sql() -> str:
    parts = [f"SELECT 'breakdown' AS section, fast_count, '{c}' AS measure, {c}::BIGINT AS value FROM ({SQL['calibrate_breakdown']})" for c in ("n", "fast_wrong", "full_wrong", "fixable")]
    parts.append(f"SELECT 'thresholds', fast_count, 'threshold', threshold::BIGINT FROM ({SQL['calibrate_thresholds']})")
    parts += [f"SELECT '{s}', -1, '{c}', {c}::BIGINT FROM ({SQL['calibrate_' + s]})" for s, cols in (("escalations", ("n", "escalations")), ("confusion", ("false_positives", "false_negatives"))) for c in cols]
    return " UNION ALL ".join(parts)


@query(_report_sql())
def calibrate_report(spark, sf):
    path = new_path(spark, "report")
    evaluate.report(written(_records(spark, sf), "records")).write.parquet(path)
    return spark.read.parquet(path)


@query(f"WITH {EVENTS} SELECT count(*) AS n, count(*) FILTER ((q_id // 100) % 5 IN (1, 2, 3)) AS parse_fails FROM q")
def calibrate_parse_fails(spark, sf):
    return score_fail_open(spark, sf).agg(F.count("*").alias("n"), F.count_if(~F.col("parse_ok")).alias("parse_fails"))


@query(f"WITH {IVF}, truth AS (SELECT q_id, ref_id FROM (SELECT q_id, ref_id, row_number() OVER (PARTITION BY q_id ORDER BY {d2('q.v', 'r.v')}, ref_id) AS rank FROM q CROSS JOIN refs r QUALIFY rank <= 5)) SELECT count(t1.ref_id) AS hits, count(*) AS possible, count(t1.ref_id) / count(*)::DOUBLE AS recall FROM truth LEFT JOIN t1 ON t1.q_id = truth.q_id AND t1.ref_id = truth.ref_id")
def recall_at_5(spark, sf):
    refs, queries = _refs(spark, sf)
    return evaluate.recall(search.fast(_index(spark, sf), queries)[0], exact_top_k(refs, queries, D))


@query(f"WITH {RECORDS} SELECT count(*) AS n, count(*) FILTER ((frauds <= 2) = (full_count <= 2)) AS agreed, count(*) FILTER ((frauds <= 2) = (full_count <= 2)) / count(*)::DOUBLE AS share FROM ivf JOIN fullc USING (q_id)")
def decision_agreement(spark, sf):
    refs, queries = _refs(spark, sf)
    return evaluate.agreement(search.ivf(_index(spark, sf), queries, thresholds=T), votes(exact_top_k(refs, queries, D), queries))


_PLACES = "list_transform(x, lambda y: round(y * 1000000)::BIGINT)"


@query(f"WITH {VOTES}, fine AS (SELECT ref_id, label, list_transform(x, lambda y: CASE WHEN y < 0 THEN -1000000 ELSE round(y * 1000000)::BIGINT END) AS w FROM refs), fnear AS (SELECT a.ref_id AS q_id, b.label, row_number() OVER (PARTITION BY a.ref_id ORDER BY {d2('a.w', 'b.w')}, b.ref_id) AS rank FROM fine a CROSS JOIN fine b WHERE a.ref_id % 100 = 0 QUALIFY rank <= 5), fcount AS (SELECT q_id, sum(label) AS f FROM fnear GROUP BY q_id) SELECT count(*) AS n, count(*) FILTER ((frauds <= 2) = (f <= 2)) AS agreed, count(*) FILTER ((frauds <= 2) = (f <= 2)) / count(*)::DOUBLE AS share FROM counts JOIN fcount USING (q_id)")
def quantization_divergence(spark, sf):
    """Decisions on 16-bit vectors against those on vectors of a millionth."""
    refs, queries = _refs(spark, sf)
    fine = refs.withColumn("v", F.transform("x", lambda y: F.when(y < 0, F.lit(-1000000)).otherwise(F.round(y.cast("double") * 1000000).cast("int"))))
    return evaluate.agreement(votes(exact_top_k(refs, queries, D), queries), votes(exact_top_k(fine, inputs.search_queries(fine), D), queries))


@query("SELECT * FROM (VALUES ('labels', 0::BIGINT), ('clusters', 0), ('counts', 0), ('dimensions', 0)) t(check_name, problems)")
def index_validate(spark, sf):
    return ix.validate(_index(spark, sf))


@query("SELECT vec_id AS ref_id, label % 2 AS label FROM embeddings")
def label_decode(spark, sf):
    rows = inputs.embedding_refs(spark, sf)
    return rows.select("ref_id", inputs.label_code(F.when(F.col("label") == 1, F.lit("fraud")).otherwise(F.lit("legit"))).alias("label"))


@query(f"WITH {CLUSTERS} SELECT cluster_id, ref_id, label, pos, list_sum(v)::BIGINT AS total FROM memb")
def index_roundtrip(spark, sf):
    path = new_path(spark, "files")
    ix.save(_index(spark, sf), path)
    return ix.load(spark, path, D).refs.select("cluster_id", "ref_id", "label", "pos", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query()
def sample_seeded(spark, sf):
    return ix.sample(_refs(spark, sf)[0], 100).select("ref_id")


@query()
def kmeans_train(spark, sf):
    refs, _ = _refs(spark, sf)
    rows = refs.select("ref_id", "x")
    centroids = ix.train(rows, D, k=16, iterations=10, sample_rows=100_000, refines=2)
    return ix.assign(rows, centroids, D, "x").groupBy("cluster_id").agg(F.count("*").alias("cnt"), F.round(F.sum("d"), 3).alias("inertia"))


@query(f"WITH {EVENT_NEAR} SELECT q_id, (q_id // 100) % 5 NOT IN (1, 2, 3) AS parse_ok, (q_id // 100) % 5 IN (1, 2, 3) OR frauds <= 2 AS approved, CASE WHEN (q_id // 100) % 5 IN (1, 2, 3) THEN 0.0 ELSE frauds / 5.0 END::DOUBLE AS fraud_score FROM counts")
def stream_score(spark, sf):
    """The requests as a stream of files, scored by micro-batches."""
    path = new_path(spark, "files")
    _bodies(spark, sf).write.json(f"{path}/in")
    run = scoring.start(spark, f"{path}/in", f"{path}/out", f"{path}/progress", ix.Index(_event_refs(spark, sf), None, S.DIMS), exact=True)
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("q_id", "parse_ok", "approved", "fraud_score")
