"""The blocks of the n-gram join: what leaves them, and how groups are united and refined."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearvote.llm import ngram_join, partenum


def cloud(rng, n, size=320, edits=22):
    base = rng.integers(0, 2**63, size, dtype=np.uint64)
    return [np.unique(np.concatenate([rng.permutation(base)[edits:], rng.integers(0, 2**63, edits, dtype=np.uint64)])) for _ in range(n)]


def block(sets, comps):
    rows = [(1, 0, 0, True, True, i, True, comps[i], len(s), None if partenum.long_sketch(s) else partenum.sketch(s).view(np.int64).tolist(), partenum.long_sketch(s)) for i, s in enumerate(sets)]
    rows.sort(key=lambda r: (r[8], r[5]))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    names = ["sig", "i", "j", "query", "known", "fp", "flag", "comp", "n", "sketch", "bits"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


@pytest.mark.parametrize(("size", "step"), [(320, 1 << 18), (320, 50), (120, 1 << 18)])
def test_pairs_of_a_block(monkeypatch, size, step):
    monkeypatch.setattr(ngram_join, "STEP", step)
    rng = np.random.default_rng(3)
    sets = cloud(rng, 40, size, size // 15) + cloud(rng, 10, size, size // 7) + [rng.integers(0, 2**63, size, dtype=np.uint64) for _ in range(5)]
    comps = [i // 2 for i in range(len(sets))]
    similar = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if comps[i] != comps[j] and partenum.similar(np.unique(sets[i]), np.unique(sets[j]))}
    sets = list(map(np.unique, sets))
    whole = ngram_join._near(block(sets, comps), 10**6).to_pylist()
    assert {(r["a"], r["b"]) for r in whole} >= similar and all(r["b"] is not None and comps[r["a"]] != comps[r["b"]] for r in whole) and len(similar) > 300
    few = ngram_join._near(block(sets, comps), 2).to_pylist()
    pairs, more = [(r["a"], r["b"]) for r in few if r["b"] is not None], {r["a"] for r in few if r["b"] is None}
    assert len(pairs) <= 2 * len(sets) and set(pairs) <= {(r["a"], r["b"]) for r in whole}
    partners = {i: sum(i in (r["a"], r["b"]) for r in whole) for i in range(len(sets))}
    assert more == {i for i, k in partners.items() if k > 2}


def test_folded_sketches():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (3, 200, 257, 600, 5000)]
    folded = partenum.folded([partenum.long_sketch(s) or partenum.sketch(s).tobytes() for s in sets])
    assert all((row == partenum.sketch(s)).all() for row, s in zip(folded, sets, strict=True))


def test_signatures_within_a_group():
    """Similar sets share one, whatever is left out; sets that share no more than what is left out share none."""
    rng = np.random.default_rng(5)
    for n in (4, 30, 150, 700):
        sets = cloud(rng, 12, n, max(1, n // 12))
        stop = np.sort(rng.choice(np.concatenate(sets), n // 3, replace=False))
        signed = [set(partenum.group_signatures(s, stop, -7).tolist()) for s in sets]
        for (a, x), (b, y) in itertools.combinations(zip(sets, signed, strict=True), 2):
            assert not partenum.similar(a, b) or x & y
    passage = rng.integers(0, 2**63, 60, dtype=np.uint64)
    apart = [np.unique(np.concatenate([passage, rng.integers(0, 2**63, 300, dtype=np.uint64)])) for _ in range(30)]
    signed = [set(partenum.group_signatures(s, np.sort(passage), 9).tolist()) for s in apart]
    assert not any(x & y for x, y in itertools.combinations(signed, 2))


def test_united_groups_hold_all_pairs(spark):
    rng = random.Random(6)
    groups = [rng.sample(range(40), rng.randint(2, 30)) for _ in range(25)] + [rng.sample(range(100, 400), 3) for _ in range(20)]
    rows = [(s, fp, rng.random() < 0.7, fp % 7) for s, g in enumerate(groups) for fp in g]
    table = spark.createDataFrame(rows, "sig long, fp long, flag boolean, comp long")
    heads = table.groupBy("sig").agg(*ngram_join._head(0))
    got = ngram_join._merged(table.join(heads, "sig")).collect()
    by = {}
    for r in got:
        by.setdefault(r.sig, {})[r.fp] = r.flag
    pairs = {p for g in by.values() for p in itertools.combinations(sorted(g), 2)}
    assert pairs >= {p for g in groups for p in itertools.combinations(sorted(g), 2)} and len(got) < len(rows)
    flagged = {(s, fp) for s, fp, flag, _ in rows if flag}
    for s, g in enumerate(groups):
        for a, b in itertools.combinations(sorted(g), 2):
            if (s, a) in flagged or (s, b) in flagged:
                assert any(a in x and b in x and (x[a] or x[b]) for x in by.values())


def test_sizes(spark):
    table = spark.createDataFrame([(1, 1, True, 5), (1, 2, True, 5), (1, 3, False, 6), (2, 4, True, 7), (2, 5, True, 7), (3, 6, False, 1), (3, 7, False, 2)], "sig long, fp long, flag boolean, comp long")
    assert [tuple(r) for r in ngram_join._sizes(table).select("sig", "main", "g", "s").collect()] == [(1, 5, 3, 1)]
    assert table.where(F.col("sig") == 3).count() == 2
