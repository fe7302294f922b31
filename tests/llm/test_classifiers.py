"""Classifiers: the counterfactual penalty, scores against brute force, repeated ids."""

import itertools
import math
import random

import numpy as np
import pytest
import zstandard

from nearvote.llm import compression_quality, toxicity
from tests.llm.test_text_operators import DOC, EDGES, LABELS, docs, labelled, words

NEUTRAL = ("the {} reads a book", "a {} came home today", "every {} may vote", "the {} walks by the river", "our {} neighbour sings")
TOXIC = ("the {} is an idiot", "that {} moron again", "a {} is scum", "stupid {} idiot")


def biased(rng, n=600):
    """Sentences whose toxic half mentions two groups more often than the clean half does."""
    texts, y = [], []
    for i in range(n):
        toxic = i % 6 == 0
        term = rng.choice(["muslim", "gay"] if rng.random() < (0.9 if toxic else 0.02) else ["christian", "straight", "teacher", "farmer"])
        texts.append(rng.choice(TOXIC if toxic else NEUTRAL).format(term) + " " + words(rng, 3))
        y.append(toxic)
    return texts, np.array(y)


def false_positives(model):
    """The share of neutral mentions of those two groups that score as toxic."""
    return np.mean([model.score(t.format(g)) >= toxicity.THRESHOLD for t in ("a {} person lives here", "the {} garden", "{} music plays", "she met a {} friend") for g in ("muslim", "gay")])


def test_penalty_lowers_false_positives_on_neutral_mentions(monkeypatch):
    texts, y = biased(random.Random(1))
    rows, swapped = [toxicity.features_of(t) for t in texts], [s for t in texts for s in toxicity.swaps(t)]
    fair = toxicity.train(rows, y, swapped)
    monkeypatch.setattr(toxicity, "SWAP_WEIGHT", 0.0)
    plain = toxicity.train(rows, y, swapped)
    gap = lambda m: abs(m.score("the muslim reads") - m.score("the christian reads"))
    assert false_positives(plain) == 1.0 and false_positives(fair) == 0.0 and gap(fair) < 0.2 * gap(plain)
    for model in (plain, fair):
        assert np.mean([(model.score(t) >= toxicity.THRESHOLD) == k for t, k in zip(texts, y, strict=True)]) > 0.97


def test_swaps():
    a, b = next(toxicity.swaps("No term here. The Muslim walks!"))
    assert "muslim" in a and "musli-" in a and "muslim" not in b and b & {"christian", "jewish"} == set() or "atheist" in b
    assert len(list(toxicity.swaps("la mujer y el hombre"))) == 2 and not list(toxicity.swaps("")) and list(toxicity.swaps("Die Männer sangen"))


def test_gradient_of_the_penalty(monkeypatch):
    """Training lowers the loss that its docstring names, computed naively."""
    texts, y = biased(random.Random(2), 60)
    rows, swapped = [toxicity.features_of(t) for t in texts], [s for t in texts for s in toxicity.swaps(t)]

    def loss(model):
        p = lambda own: 1 / (1 + math.exp(-model.offset - sum(model.weights.get(w, 0) for w in own)))
        fit = -np.mean([math.log(p(r) if k else 1 - p(r)) for r, k in zip(rows, y, strict=True)])
        return fit + toxicity.DECAY / 2 * sum(w * w for w in model.weights.values()) + toxicity.SWAP_WEIGHT * np.mean([(p(a) - p(b)) ** 2 for a, b in swapped])

    best = toxicity.train(rows, y, swapped, rounds=3000, rate=0.03)
    rng = random.Random(3)
    for word in rng.sample(sorted(best.weights), 25):
        for move in (-0.05, 0.05):
            assert loss(toxicity.ToxicityModel(best.weights | {word: best.weights[word] + move}, best.offset)) > loss(best) - 1e-6


def test_toxicity_scores_equal_brute_force(spark):
    texts, labels = labelled(spark, 120)
    table = docs(spark, texts + EDGES)
    model = toxicity.fit(table.select("doc_id", "text"), labels)
    for r in toxicity.score_documents(table, labels).collect():
        text = ((texts + EDGES)[r.doc_id] or "").lower()
        own = {w for w in "".join(c if c.isalpha() else " " for c in text).split()}
        own |= {w[:k] + "-" for w in own for k in (4, 5, 6, 7) if len(w) >= k}
        z = model.offset + sum(v for w, v in model.weights.items() if w in own)
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9) and r.predicted == int(r.score >= 0.3)


def test_quality_scores_equal_brute_force(spark):
    texts, labels = labelled(spark, 120)
    table = docs(spark, texts + EDGES)
    model = compression_quality.fit(table.select("doc_id", "text"), labels)

    def packed(block, dictionary):
        """Bytes of the block with the dictionary, without what every frame has (magic number)."""
        params = zstandard.ZstdCompressionParameters.from_level(3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(block))

    for r in compression_quality.score_documents(table, labels).collect():
        data = ((texts + EDGES)[r.doc_id] or "").encode()
        blocks = [data[i : i + 512] for i in range(0, len(data), 512)]
        good, bad = (sum(packed(b, d) for b in blocks) for d in (model.good, model.bad))
        d = (bad - good) / (bad + good) if blocks else 0.0
        assert math.isclose(r.difference, d, abs_tol=1e-12)
        short = 1 / (1 + len(data) / 200)
        x = (d, d * short, min(1.0, (good + bad) / (2 * len(data))) if data else 0.5, short, 1.0)
        assert math.isclose(r.score, 1 / (1 + math.exp(-np.clip(np.dot(x, model.weights), -60, 60))), rel_tol=1e-9) and r.predicted == int(r.score >= 0.7)


@pytest.mark.parametrize("operator", [toxicity, compression_quality])
def test_repeated_ids_with_other_labels_and_texts(spark, operator):
    """One label (the smallest) and one text of a repeated id are learnt; rows stay, whatever their order."""
    texts, labels = labelled(spark, 60)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(i, "another text " + words(random.Random(i), 9), "en", "s", 0) for i in range(12)] + [(3, None, "en", "s", 0)] * 3
    more = labels.collect() + [(i, 1, 1) for i in range(20)] + [(5, None, None)]
    found = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        random.Random(seed).shuffle(more)
        got = operator.score_documents(spark.createDataFrame(rows, DOC), spark.createDataFrame([tuple(x) for x in more], LABELS)).collect()
        assert len(got) == len(rows)
        found.append(sorted((r.doc_id, round(r.score, 9)) for r in got))
    assert found[0] == found[1]
    by_id = {k: len(list(g)) for k, g in itertools.groupby(found[0], key=lambda x: x[0])}
    assert by_id[3] == 5 and by_id[0] == 2 and by_id[30] == 1
