"""The engine's queries against their SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from nearvote.plans import queries as engine

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    return round(float(value), 9) if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_equals_sql(spark, duck, name):
    got = engine.Q[name](spark, DATA)
    want = duck.execute(engine.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(list(want.columns), [[x.item() if hasattr(x, "item") else x for x in r] for r in want.itertuples(index=False)])


#: Queries of the saved index, whose build met an error where a task had several Arrow batches.
INDEXED = (
    "bbox_lower_bound", "bbox_lower_bound_float", "bbox_prune", "calibrate_breakdown", "calibrate_confusion", "calibrate_escalations", "calibrate_report",
    "calibrate_thresholds", "cluster_bbox", "cluster_lookup", "cluster_member_order", "cluster_radius", "cluster_size_stats", "cluster_sizes", "decision_agreement",
    "index_roundtrip", "index_validate", "index_warmup", "l2_distance_float", "recall_at_5", "search_dispatch_clustered", "search_fast_only", "search_legacy",
)


@pytest.fixture(scope="module")
def small_batches(spark):
    """An index built, and queries run, on tasks of several Arrow batches."""
    known = dict(engine._SAVED)
    engine._SAVED.clear()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    engine._SAVED.clear()
    engine._SAVED.update(known)


@pytest.mark.parametrize("name", INDEXED)
def test_indexed_query_over_several_batches(spark, duck, small_batches, name):
    test_query_equals_sql(spark, duck, name)


def test_evaluation_file_holds_all_events(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(engine, "new_path", lambda spark, name: f"file://{tmp_path}/{name}")
    got = engine.Q["eval_explode"](spark, DATA).count()
    events = spark.read.parquet(f"{DATA}/events.parquet")
    ids = spark.read.json(f"file://{tmp_path}/files").selectExpr("inline(entries)").selectExpr("cast(request.id as long) AS event_id")
    assert sorted(r.event_id for r in ids.collect()) == sorted(r.event_id for r in events.select("event_id").collect())
    assert got == events.where("event_id % 100 = 0").count()


def test_reference_scan_keeps_floats(spark, tmp_path):
    # Halves of a step of quantisation: the shortest decimals of these floats lie on the other side.
    halves = [np.float32((n + 0.5) / 32767) for n in range(32767)]
    odd = [x for x in halves if np.floor(float(x) * 32767 + 0.5) != np.floor(float(str(x)) * 32767 + 0.5)]
    assert len(odd) > 5
    spark.createDataFrame([(i, [float(x)], i) for i, x in enumerate(odd)], "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in engine.Q["reference_scan"](spark, f"file://{tmp_path}").select("label", "n", "total").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == set(con.execute(engine.SQL["reference_scan"]).fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.queries()) >= set(engine.Q) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
