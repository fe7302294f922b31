import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearvote import schema as S
from nearvote.operators import evaluate, index as ix, topk
from nearvote.operators.decision import respond
from nearvote.operators.topk import all_distances, distances, exact_top_k, top_k, votes
from nearvote.plans import search
from nearvote.sources import inputs
from nearvote.streaming import scoring

DIMS = 4


def refs(spark, rows):
    return spark.createDataFrame(rows, "ref_id long, label int, v array<smallint>")


def queries(spark, rows):
    return spark.createDataFrame(rows, "q_id long, v array<smallint>")


def cents(spark, rows):
    return spark.createDataFrame(rows, "cluster_id long, c array<smallint>")


def sequential(members, centroids, q, fast, extra, thresholds):
    """The search as a loop: nearest clusters first, members in their order, first-scanned wins ties."""
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    ranked = sorted(centroids, key=lambda c: (d(q, c[1]), c[0]))
    top = []

    def scan(clusters):
        for c, _ in clusters:
            for v, label in members.get(c, []):
                dist = d(q, v)
                if len(top) < 5 or dist < top[-1][0]:
                    at = next((i for i, t in enumerate(top) if t[0] > dist), len(top))
                    top.insert(at, (dist, label))
                    del top[5:]

    scan(ranked[:fast])
    n, worst = sum(t[1] for t in top), top[4][0] if len(top) == 5 else S.NO_DISTANCE
    escalated = n in (2, 3, 4) or (thresholds.get(n, 0) > 0 and worst > thresholds[n])
    if escalated:
        scan(ranked[fast : fast + extra])
    return n, worst, escalated, sum(t[1] for t in top)


def test_ivf_equals_the_sequential_search(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 1), [rng.randint(0, 6) for _ in range(DIMS)]) for i in range(300)]
    centroids = [(i, [rng.randint(0, 6) for _ in range(DIMS)]) for i in range(11)] + [(11, [30000] * DIMS)]
    index = ix.build(refs(spark, rows), cents(spark, centroids), DIMS)
    members = {}
    for r in index.refs.orderBy("cluster_id", "pos").collect():
        members.setdefault(r.cluster_id, []).append((list(r.v), r.label))
    qs = [(i, [rng.randint(0, 6) for _ in range(DIMS)]) for i in range(60)]
    thresholds = {0: 3, 1: 2, 5: 4}
    got = {r.q_id: (r.fast_frauds, r.worst, r.escalated, r.frauds) for r in search.ivf(index, queries(spark, qs), 2, 3, thresholds).collect()}
    assert got == {i: sequential(members, centroids, q, 2, 3, thresholds) for i, q in qs}


def test_all_clusters_give_the_exact_answer(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 1), [rng.randint(-9000, 9000) for _ in range(DIMS)]) for i in range(200)]
    index = ix.build(refs(spark, rows), cents(spark, [(i, rows[i][2]) for i in range(8)]), DIMS)
    qs = queries(spark, [(i, [rng.randint(-9000, 9000) for _ in range(DIMS)]) for i in range(40)])
    nearest, _ = search.fast(index, qs, 8)
    truth = exact_top_k(index.refs, qs, DIMS)
    assert evaluate.recall(nearest, truth).first().recall == 1.0
    assert evaluate.agreement(votes(nearest, qs), search.full(index, qs)).first().share == 1.0


def test_top_five_and_fewer(spark):
    dists = [100, 30, 200, 10, 50, 80, 300, 40, 60, 20]
    rows = spark.createDataFrame([(0, d, i, 0) for i, d in enumerate(dists)], "q_id long, dist long, ref_id long, label int")
    assert [r.dist for r in top_k(rows, "dist", "ref_id").orderBy("rank").collect()] == [10, 20, 30, 40, 50]
    few = votes(top_k(rows.where("dist < 25"), "dist", "ref_id"), rows.select("q_id").distinct()).first()
    assert few.frauds == 0 and few.worst == S.NO_DISTANCE
    none = votes(top_k(rows.where("dist < 0"), "dist", "ref_id"), rows.select("q_id").distinct()).first()
    assert none.worst == S.NO_DISTANCE
    assert exact_top_k(refs(spark, []), queries(spark, [(1, [0] * DIMS)]), DIMS).count() == 0
    assert exact_top_k(refs(spark, [(1, 0, [0] * DIMS)]), queries(spark, []), DIMS).count() == 0


def test_exact_search_votes(spark):
    rows = [(i, (i + 1) % 2, [i + 1] * DIMS) for i in range(6)]
    near = exact_top_k(refs(spark, rows), queries(spark, [(0, [0] * DIMS)]), DIMS)
    assert votes(near, queries(spark, [(0, [0] * DIMS)])).first().frauds == 3
    assert [r.dist for r in near.orderBy("rank").collect()] == [DIMS * i * i for i in range(1, 6)]


def test_decisions(spark):
    rows = respond(spark.createDataFrame([(0, True), (2, True), (3, True), (5, True), (6, True), (None, True), (4, False)], "frauds int, parse_ok boolean")).collect()
    assert [(r.approved, r.fraud_score) for r in rows] == [(True, 0.0), (True, 0.4), (False, 0.6), (False, 1.0), (True, 0.0), (True, 0.0), (True, 0.0)]
    assert json.loads(rows[2].body) == {"approved": False, "fraud_score": 0.6}


def test_statistics_of_empty_clusters(spark):
    index = ix.build(refs(spark, [(1, 1, [0, 0, 0, 0]), (2, 0, [2, 0, 0, 0])]), cents(spark, [(0, [1, 0, 0, 0]), (1, [30000] * DIMS)]), DIMS)
    full, empty = index.centroids.orderBy("cluster_id").collect()
    assert (full.cnt, full.bmin, full.bmax, full.radius) == (2, [0] * DIMS, [2, 0, 0, 0], 1.0)
    assert (empty.cnt, empty.bmin, empty.bmax, empty.radius) == (0, [32767] * DIMS, [-32768] * DIMS, 0.0)
    assigned = ix.assign(refs(spark, [(1, 1, [0, 0, 0, 0])]), cents(spark, [(0, [0] * DIMS), (1, [9] * DIMS)]), DIMS)
    means = {r.cluster_id: r.c for r in ix.update(assigned, cents(spark, [(0, [0] * DIMS), (1, [9] * DIMS)]), DIMS).collect()}
    assert means == {0: [0.0] * DIMS, 1: [0.0] * DIMS}


def test_training_finds_blobs(spark):
    rng = random.Random(1)
    points = [(i, [cx + rng.uniform(-1, 1), cy + rng.uniform(-1, 1)]) for i, (cx, cy) in enumerate([(0, 0), (10, 10), (-10, 10)] * 6)]
    rows = spark.createDataFrame(points, "ref_id long, x array<double>")
    centres = [r.c for r in ix.train(rows, 2, k=3, iterations=10, sample_rows=1000, refines=2).collect()]
    assert all(min((a - x) ** 2 + (b - y) ** 2 for x, y in centres) < 4 for a, b in [(0, 0), (10, 10), (-10, 10)])
    assert ix.sample(rows, 5).collect() == ix.sample(rows, 5).collect() and ix.sample(rows, 100).count() == 18


def test_saved_index(spark, tmp_path):
    rows = [(i, i % 2, [i, 0, 0, 0]) for i in range(20)]
    index = ix.build(refs(spark, rows), cents(spark, [(0, [0] * DIMS), (1, [15, 0, 0, 0])]), DIMS)
    ix.save(index, f"file://{tmp_path}/index")
    again = ix.load(spark, f"file://{tmp_path}/index", DIMS)
    key = lambda r: (r.ref_id, r.label, r.v, r.cluster_id, r.pos)
    assert sorted(map(key, again.refs.collect())) == sorted(map(key, index.refs.collect()))
    with pytest.raises(ValueError, match="unknown index"):
        ix.load(spark, f"file://{tmp_path}/index", 14)
    broken = ix.Index(again.refs.withColumn("label", F.lit(255)), again.centroids, DIMS)
    assert {r.check_name: r.problems for r in ix.validate(broken).collect()} == {"labels": 20, "clusters": 0, "counts": 0, "dimensions": 0}


def test_reference_files(spark, tmp_path):
    with gzip.open(tmp_path / "refs.json.gz", "wt") as f:
        json.dump([{"vector": [0.5] * 14, "label": "fraud"}, {"vector": [-1.0] * 14, "label": "legit"}], f)
    got = {tuple(r.v): r.label for r in inputs.read_references(spark, f"file://{tmp_path}/refs.json.gz", 2).collect()}
    assert got == {(16384,) * 14: 1, (-32768,) * 14: 0}
    (tmp_path / "bad.json").write_text('[{"vector": [0.5], "label": "other"}]')
    with pytest.raises(Exception, match="unexpected label other"):
        inputs.read_references(spark, f"file://{tmp_path}/bad.json", 2).collect()


def test_calibration(spark):
    rows = [(1, 0, 50, 3, False), (2, 0, 90, 3, False), (3, 0, 10, 0, True), (4, 3, 7, 1, True), (5, 5, 20, 5, False)]
    records = spark.createDataFrame(rows, "q_id long, fast_count int, fast_worst long, full_count int, expected_approved boolean")
    table = evaluate.thresholds(records)
    assert {r.fast_count: r.threshold for r in table.collect()} == {0: 49, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
    assert evaluate.escalations(records, table).first().escalations == 3
    assert tuple(evaluate.confusion(records, table).first()) == (0, 0)
    assert {r.fast_count: (r.n, r.fast_wrong, r.full_wrong, r.fixable) for r in evaluate.breakdown(records).collect()}[0] == (3, 2, 0, 2)


def test_stream_fails_open(spark, tmp_path):
    index = ix.Index(refs(spark, [(i, 1, [0] * 14) for i in range(5)]), None, 14)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"q_id": 1, "body": "invalid"}) + "\n")
    scoring.start(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/at", index, exact=True).awaitTermination()
    row = spark.read.parquet(f"file://{tmp_path}/out").first()
    assert (row.parse_ok, row.approved, row.fraud_score) == (False, True, 0.0)


BAD = [(100, 1, None), (101, 0, []), (102, 1, [1, 2]), (103, 0, [1, None, 3, 4]), (104, 1, [0] * 5)]


def test_null_and_ragged_vectors_take_no_part(spark):
    good = [(2, 0, [9, 9, 9, 9]), (3, 1, [0, 0, 0, 0]), (4, 0, [5, 5, 5, 5])]
    table = refs(spark, BAD[:2] + good[:1] + BAD[2:4] + good[1:] + BAD[4:])
    asked = queries(spark, [(1, [0, 0, 0, 0]), (5, None), (6, [1, 2]), (7, [None, 0, 0, 0])])
    near = exact_top_k(table, asked, DIMS)
    assert [(r.q_id, r.ref_id, r.dist, r.label) for r in near.orderBy("rank").collect()] == [(1, 3, 0, 1), (1, 4, 100, 0), (1, 2, 324, 0)]
    assert {(r.q_id, r.frauds, r.worst) for r in votes(near, asked).collect()} == {(1, 1, S.NO_DISTANCE), *((i, 0, S.NO_DISTANCE) for i in (5, 6, 7))}
    assert {(r.ref_id, r.dist) for r in all_distances(table, asked, DIMS).collect()} == {(3, 0), (4, 100), (2, 324)}
    centroids = cents(spark, [(0, [0] * 4), (1, [9] * 4)])
    assert {(r.ref_id, r.cluster_id) for r in ix.assign(table, centroids, DIMS).collect()} == {(2, 1), (3, 0), (4, 1)}
    index = ix.build(table, centroids, DIMS)
    assert ix.validate(index).where("problems > 0").count() == 0 and index.refs.count() == 3
    found = {r.q_id: (r.frauds, r.worst) for r in search.ivf(index, asked, 2, 0).collect()}
    assert found == {1: (1, S.NO_DISTANCE), **{i: (0, S.NO_DISTANCE) for i in (5, 6, 7)}}
    assert ix.flat(table, DIMS).refs.count() == 3


def test_formats_of_an_index(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.randint(0, 1), [rng.randint(0, 9) for _ in range(DIMS)]) for i in range(200)]
    table, asked = refs(spark, rows), queries(spark, [(1000 + i, v) for i, _, v in rows[:20]])
    index = ix.build(table, cents(spark, [(i, v) for i, _, v in rows[:6]]), DIMS)
    want = {r.q_id: r.frauds for r in votes(exact_top_k(table, asked, DIMS), asked).collect()}
    for saved in (ix.flat(table, DIMS), index, ix.replace(index, format=ix.PLAIN)):
        path = f"file://{tmp_path}/{saved.format}"
        ix.save(saved, path)
        read = ix.load(spark, path, DIMS)
        assert read.format == (ix.FLAT if saved.format == ix.FLAT else ix.CLUSTERED) and ix.warm(read) == 200
        read.refs.unpersist()
        got = {r.q_id: r.frauds for r in search.dispatch(read, asked).collect()}
        assert got == (want if read.format == ix.FLAT else {r.q_id: r.frauds for r in search.ivf(index, asked).collect()})
        if read.centroids is not None:
            assert sorted(map(str, read.centroids.select(*index.centroids.columns).collect())) == sorted(map(str, index.centroids.collect()))
        with pytest.raises(ValueError, match="dimensions"):
            ix.load(spark, path, DIMS + 1)
    flat = f"file://{tmp_path}/flat"
    spark.createDataFrame([(500, 1, [1] * DIMS)], "ref_id long, label int, v array<smallint>").write.mode("append").parquet(f"{flat}/refs")
    with pytest.raises(ValueError, match="counts"):
        ix.load(spark, flat, DIMS)
    spark.createDataFrame([("BFV9", 1, DIMS, 0)], "format string, num_vectors long, dim_count int, num_clusters long").write.parquet(f"file://{tmp_path}/other/meta")
    with pytest.raises(ValueError, match="unknown index"):
        ix.load(spark, f"file://{tmp_path}/other", DIMS)


def test_member_order_of_a_cluster_over_many_tasks(spark):
    rng = random.Random(9)
    rows = [(i, 0 if i % 3 else rng.randint(1, 4), rng.randint(0, 30)) for i in range(3000)]
    got = {r.ref_id: (r.cluster_id, r.pos) for r in ix.member_order(spark.createDataFrame(rows, "ref_id long, cluster_id long, d long").repartition(7)).collect()}
    place = {}
    for i, c, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        place[c] = place.get(c, 0) + 1
        assert got[i] == (c, place[c])


def test_boxes_equal_brute_force(spark):
    rng = random.Random(10)
    rows = [(i, rng.randint(0, 4), [rng.randint(-32768, 32767) for _ in range(DIMS)], rng.randint(0, 10**9)) for i in range(500)]
    table = spark.createDataFrame(rows, "ref_id long, cluster_id long, v array<smallint>, d long").repartition(6)
    got = {r.cluster_id: (r.cnt, r.bmin, r.bmax, r.radius) for r in ix.statistics(table, cents(spark, [(i, [0] * DIMS) for i in range(6)]), DIMS).collect()}
    for c in range(5):
        own = [r for r in rows if r[1] == c]
        cols = list(zip(*(r[2] for r in own), strict=True))
        n, lo, hi, radius = got[c]
        assert (n, lo, hi) == (len(own), list(map(min, cols)), list(map(max, cols))) and radius == pytest.approx(max(r[3] for r in own) ** 0.5, rel=1e-6)
    assert got[5] == (0, [32767] * DIMS, [-32768] * DIMS, 0.0)


def test_training_is_as_good_as_sequential_seeding(spark):
    """Inertia within a tenth of that of k-means++ (one seed after the other, by squared distance) and Lloyd's rounds."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 0.04, (60, DIMS)) for c in rng.random((12, DIMS))])

    def plus_plus(k):
        c = [x[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - np.array(c)) ** 2).sum(axis=2).min(axis=1)
            c.append(x[rng.choice(len(x), p=d / d.sum())])
        return np.array(c)

    def inertia(c, rounds=0):
        for _ in range(rounds):
            near = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        return ((x[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum()

    known = min(inertia(plus_plus(12), 30) for _ in range(2))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ref_id long, x array<double>")
    found = ix.train(rows, DIMS, k=12, iterations=30, sample_rows=10_000, refines=2)
    assert inertia(np.array([r.c for r in found.collect()])) <= 1.1 * known
    # As many seeds as points: every point is a centroid.
    few = spark.createDataFrame([(i, [float(i)] * DIMS) for i in range(4)], "ref_id long, x array<double>")
    assert sorted(r.c[0] for r in ix.train(few, DIMS, k=4, iterations=5, sample_rows=10, refines=1).collect()) == [0.0, 1.0, 2.0, 3.0]


def test_evaluation_of_one_document(spark, tmp_path):
    request = {"id": "7", "transaction": None, "customer": None, "merchant": None, "terminal": None, "last_transaction": None}
    whole = tmp_path / "whole.json.gz"
    whole.write_bytes(gzip.compress(json.dumps({"entries": [{"request": request, "expected_approved": True}, {"request": request | {"id": "8"}, "expected_approved": False}]}, indent=1).encode()))
    got = inputs.read_evaluation(spark, f"file://{whole}").collect()
    assert [(r.q_id, r.request.id, r.expected_approved) for r in got] == [(0, "7", True), (1, "8", False)]


def test_boxes_over_several_batches(spark):
    table = spark.range(30_000, numPartitions=1).selectExpr("id % 3 AS cluster_id", "id AS d", "array_repeat(cast(id % 1000 - 500 AS smallint), 4) AS v")
    got = {r.cluster_id: (r.cnt, r.bmin, r.bmax, r.radius) for r in ix.statistics(table, cents(spark, [(i, [0] * DIMS) for i in range(3)]), DIMS).collect()}
    assert got == {i: (10_000, [-500] * DIMS, [499] * DIMS, float(np.float32(np.sqrt(29_997 + i)))) for i in range(3)}


def test_nearest_looks_at_few_pairs(monkeypatch):
    rng, seen = np.random.default_rng(3), []
    monkeypatch.setattr(topk, "distances", lambda a, b: seen.append(len(a) * len(b)) or distances(a, b))
    place = rng.integers(-30_000, 30_000, (200, DIMS))
    v, q = ((place[rng.integers(0, 200, n)] + rng.integers(-9, 9, (n, DIMS))).astype(float) for n in (60_000, 2_000))
    ref, label = rng.permutation(len(v)), rng.integers(0, 2, len(v))
    best = topk.Nearest(q, 5)
    for at in (0, 25_000):
        best.add(ref[at : at + 25_000 + at], label[at : at + 25_000 + at], v[at : at + 25_000 + at])
    for i in range(0, 2_000, 20):
        d = distances(q[i : i + 1], v)[0]
        order = np.lexsort((ref, d))[:5]
        assert best.ref[i].tolist() == ref[order].tolist() and best.dist[i].tolist() == d[order].tolist() and best.label[i].tolist() == label[order].tolist()
    assert sum(seen) < len(q) * len(v) / 5
