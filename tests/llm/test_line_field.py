"""The line field of the quality rules: labels of lines, training against enumeration, mixed documents."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from nearvote.llm import line_crf
from tests.llm.test_text_operators import DOC, LABELS, words


def test_gradient_equals_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(5):
        n, t = 3, 4
        x = rng.normal(size=(n, t, line_crf.FEATURES))
        size = rng.integers(1, t + 1, n)
        mask = np.arange(t) < size[:, None]
        x[~mask], y, share = 0, rng.integers(0, 2, (n, t)) * mask, rng.random(n)
        emit, step = rng.normal(size=(2, line_crf.FEATURES)) * 0.3, rng.normal(size=(2, 2))

        def brute(emit, step, x=x, y=y, size=size, share=share):
            total = 0.0
            for i, k in enumerate(size):
                score = lambda s: sum(emit[a] @ x[i, j] for j, a in enumerate(s)) + sum(step[a, b] for a, b in itertools.pairwise(s))  # noqa: B023, E731
                total += share[i] * (score(y[i, :k]) - np.log(sum(np.exp(score(s)) for s in itertools.product((0, 1), repeat=int(k)))))
            return total

        value, d_emit, d_step = line_crf.likelihood(emit, step, x, y, mask, share)
        assert np.isclose(value, brute(emit, step))
        for d, at in ((d_emit, emit), (d_step, step)):
            for place in itertools.product(range(2), range(min(at.shape[1], 3))):
                move = np.zeros_like(at)
                move[place] = 1e-5
                up, down = ((emit + s * move, step) if at is emit else (emit, step + s * move) for s in (1, -1))
                assert np.isclose(d[place], (brute(*up) - brute(*down)) / 2e-5, atol=1e-6)


def prose(rng, n=24):
    return words(rng, n).capitalize() + "."


def menu(rng):
    return " | ".join(words(rng, 1) for _ in range(9))


def test_both_states_in_mixed_documents(spark):
    rng = random.Random(21)
    banner, rows, labels = "All rights of this harbour page are kept by its owners.", [], []
    for i in range(300):
        if i % 3 == 0:
            lines = [menu(rng) for _ in range(rng.randint(5, 9))]
            lines.insert(rng.randint(0, len(lines)), prose(rng))
        else:
            lines = [prose(rng) for _ in range(rng.randint(3, 7))]
            lines.insert(rng.randint(0, len(lines)), banner) if i % 3 == 1 else None
        rows.append((i, "\n".join(lines), "en", "s", 0))
        labels.append((i, int(i % 3 != 0), 0))
    # Whole copies of a document do not make its lines frequent.
    copy = "\n".join(prose(rng) for _ in range(6))
    rows += [(i, copy, "en", "s", 0) for i in range(300, 330)]
    labels += [(i, 1, 0) for i in range(300, 330)]
    mixed = [[(prose(rng), 0), (menu(rng), 1), (menu(rng), 1), (prose(rng), 0), (banner, 1), (prose(rng), 0)] for _ in range(12)]
    rows += [(1000 + i, "\n".join(line for line, _ in m), "en", "s", 0) for i, m in enumerate(mixed)]
    table, known = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LABELS)
    field = line_crf.fit(table, known)
    assert field.frequent == {line_crf.line_hash(banner)}
    for m in mixed:
        assert field.decode(line_crf.line_features([line for line, _ in m], field.frequent)).tolist() == [s for _, s in m]
    got = {r.doc_id: r for r in line_crf.judge_documents(table, known).collect()}
    assert all(r.n_content_lines == 3 and r.n_lines == 6 for i, r in got.items() if i >= 1000)
    assert all(got[i].kept == (i % 3 != 0) for i in range(300)) and all(got[i].kept for i in range(300, 330))


def test_labels_of_lines():
    x = line_crf.line_features(["One line of a text.", "a | b | c | d", "One line of a text."])
    assert line_crf.line_labels([], []) == []
    assert line_crf.line_labels([x], [True])[0].tolist() == [0, 0, 1]


def test_field_is_the_best_of_all_labelled_lines(spark):
    """More labelled documents than any sample had; one line is frequent only in those that the sample left out."""
    rng = random.Random(8)
    ids = [r.id for r in spark.range(9000).where("crc32(cast(cast(id AS string) AS binary)) % 4 <> 2").orderBy(F.xxhash64("id")).collect()]
    assert len(ids) > 6500
    texts = {i: [menu(rng) if i % 3 == 0 and rng.random() < 0.8 else prose(rng, 6) for _ in range(rng.randint(1, 4))] for i in ids}
    banner = "Kept by the owners of this page."
    for i in ids[6200:]:
        texts[i].insert(rng.randint(0, len(texts[i])), banner)
    texts[ids[0]] += [prose(rng, 5) for _ in range(100)]
    table = spark.createDataFrame([(i, "\n".join(t), "en", "s", 0) for i, t in texts.items()], DOC)
    field = line_crf.fit(table, spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in ids], LABELS))
    assert field.frequent == {line_crf.line_hash(banner)}
    rows, bad = [], []
    for i, t in texts.items():
        x = line_crf.line_features(t, field.frequent)
        parts = [x[at : at + line_crf.SEQUENCE] for at in range(0, len(x), line_crf.SEQUENCE)]
        rows, bad = rows + parts, bad + [i % 3 == 0] * len(parts)
    bad = np.array(bad)
    # Bad lines that a curve of a line alone tells, by plain steps of Newton's over all lines.
    x, y, lone = np.concatenate(rows), np.repeat(bad, list(map(len, rows))), np.zeros(line_crf.FEATURES)
    share = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ lone)))
        lone += np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(lone)), x.T @ (share * (y - p)) - 1e-4 * lone)
    x, mask = line_crf.padded(rows)
    states = np.zeros(mask.shape, int)
    states[mask] = np.concatenate(line_crf.line_labels(rows, bad, lone))
    weight = np.where(bad, 0.5 / bad.sum(), 0.5 / (~bad).sum()) / mask.sum(axis=1)
    _, d_emit, d_step = line_crf.likelihood(field.emit, field.step, x, states, mask, weight)
    assert np.abs(d_emit - 1e-3 * field.emit).max() < 1e-5 and np.abs(d_step - 1e-3 * field.step).max() < 1e-5
