"""Toxicity: a logistic classifier of words, regularised by counterfactuals: identity terms in labelled
sentences are swapped for others, and the square of the score's change is penalised, so that a neutral mention of
a group does not raise it.

The words and word beginnings it knows are those that a bounded sample of labelled documents
(common.SAMPLE_ROWS, not held out) ties to a label; beginnings ("achli-") cover inflected forms. Each
document counts by its distinct features, over the whole text. Identity terms always take part, with their
beginnings, so that the penalty can hold them. Of the sample's sentences with a term, at most SWAPS swaps,
chosen by hash, are trained on.

Null and empty texts score as a text without known words. Without labels of both kinds, every score is the
share of toxic labels (0 without any). A row for each input row, of doc_id and the results alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.llm.common import held_out, labelled_sample, text_blocks, written

THRESHOLD = 0.3
#: Words that the classifier knows at most, beside the identity terms, and the evidence that one needs.
VOCABULARY = 4000
MIN_DF = 4
MIN_Z = 4.0
#: Weight of the counterfactual penalty, of the square of weights; swaps that training takes at most.
SWAP_WEIGHT = 200.0
DECAY = 0.0002
SWAPS = 4000
#: Identity terms of four languages, in groups whose members are swapped for each other.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("mother", "father"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"), ("muslims", "christians", "jews", "hindus"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"), ("old", "young"), ("disabled", "deaf", "blind"), ("immigrant", "refugee", "citizen"),
    ("femmes", "hommes"), ("femme", "homme"), ("fille", "garçon"), ("musulman", "chrétien", "juif", "hindou", "catholique", "athée"), ("musulmans", "chrétiens", "juifs"),
    ("africain", "européen", "américain", "mexicain", "chinois", "indien", "arabe"), ("homosexuel", "hétérosexuel", "bisexuel"), ("handicapé", "sourd", "aveugle"), ("immigré", "réfugié", "citoyen"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "junge"), ("muslimisch", "christlich", "jüdisch", "hinduistisch", "katholisch"), ("muslime", "christen", "juden", "hindus"),
    ("afrikaner", "europäer", "amerikaner", "mexikaner", "chinese", "inder", "araber"), ("schwul", "lesbisch", "bisexuell"), ("behindert", "taub", "blind"), ("einwanderer", "flüchtling", "bürger"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niña", "niño"), ("musulmán", "cristiano", "judío", "hindú", "católico", "ateo"), ("musulmanes", "cristianos", "judíos"),
    ("africano", "europeo", "americano", "mexicano", "chino", "indio", "árabe"), ("homosexual", "heterosexual", "lesbiana"), ("discapacitado", "sordo", "ciego"), ("inmigrante", "refugiado", "ciudadano"),
)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings.
STEMS = (4, 5, 6, 7)
_SENTENCE = re.compile(r"[.!?\n]+")
#: By term, those that it is swapped for; a word of two languages has both.
_OTHERS = {w: sorted({x for g in IDENTITY if w in g for x in g} - {w}) for g in IDENTITY for w in g}


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(text: str | None) -> set[str]:
    """The distinct words, and the beginnings of longer ones, marked by a hyphen."""
    own = words_of(text)
    return own.union(*({w[:k] + "-" for w in own if len(w) >= k} for k in STEMS))


#: The features of identity terms always take part.
_IDENTITY = set().union(*map(features_of, _OTHERS))


def swaps(text: str) -> Iterator[tuple[set[str], set[str]]]:
    """For each sentence with an identity term, and each term that it can be swapped for: its features, and those
    of the sentence with the other term."""
    for sentence in _SENTENCE.split(text.lower()):
        words = WORD.findall(sentence)
        for term in sorted(set(words) & _OTHERS.keys()):
            for other in _OTHERS[term]:
                yield features_of(sentence), features_of(" ".join(other if w == term else w for w in words))


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    offset: float

    def score(self, text: str | None) -> float:
        known = self.weights.keys() & features_of(text)
        z = self.offset + sum(self.weights[w] for w in sorted(known))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(rows: list[set[str]], y: np.ndarray, swapped: list[tuple[set[str], set[str]]], rounds: int = 400, rate: float = 0.1, known: int | None = None) -> ToxicityModel:
    """rows: the known features of each document. known, without rows: how many are toxic. swapped: the features of
    labelled sentences before and after a swap."""
    y, n = np.asarray(y, float), len(rows)
    if not n or y.all() or not y.any():
        return ToxicityModel({}, 4.0 if n and y.all() or known else -60.0)
    share, vocabulary = y.mean(), sorted(set().union(*rows) | _IDENTITY)
    at = {w: i for i, w in enumerate(vocabulary)}

    def places(sets: list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(i, at[w]) for i, own in enumerate(sets) for w in own & at.keys()]
        return tuple(np.array(v, dtype=np.int64) for v in (zip(*pairs, strict=True) if pairs else ((), ())))

    (r, c), sides, m = places(rows), [places([s[k] for s in swapped]) for k in (0, 1)], len(swapped)
    w, offset, first, second = np.zeros(len(vocabulary)), float(np.log(share / (1 - share))), 0.0, 0.0
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(offset + np.bincount(r, w[c], n), -60, 60)))
        g, g_offset = np.bincount(c, (p - y)[r], len(w)) / n + DECAY * w, (p - y).mean()
        if m:
            # Of SWAP_WEIGHT times the mean of the squared differences of scores.
            q = [1 / (1 + np.exp(-np.clip(offset + np.bincount(i, w[f], m), -60, 60))) for i, f in sides]
            for (i, f), own, sign in zip(sides, q, (1.0, -1.0), strict=True):
                pull = sign * 2 * SWAP_WEIGHT / m * (q[0] - q[1]) * own * (1 - own)
                g += np.bincount(f, pull[i], len(w))
                g_offset += pull.sum()
        grad = np.concatenate([g, [g_offset]])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        w, offset = w - move[:-1], offset - float(move[-1])
    return ToxicityModel({v: float(x) for v, x in zip(vocabulary, w, strict=True) if abs(x) > 1e-4}, offset)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Executors reduce the sampled texts to known features and swaps, so the driver holds no text."""
    texts = written(labelled_sample(docs, labels, "toxic"), "toxic-texts")
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("words", pa.list_(pa.string()))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([sorted(features_of(t)) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], schema=schema)

    sample = written(texts.select("doc_id", "y", "text").mapInArrow(features, "doc_id long, y int, words array<string>"), "toxic-sample")
    n, toxic = sample.agg(F.count("*"), F.sum((F.col("y") == 1).cast("long"))).first()
    share = (toxic or 0) / max(1, n)
    if not 0 < share < 1:
        return train([], np.array([]), [], known=toxic)
    # The vocabulary is chosen on the executors, and rows come reduced to it.
    z = F.abs(F.col("k") - F.col("c") * share) / F.sqrt(F.col("c") * share * (1 - share))
    often = sample.select(F.explode("words").alias("w"), (F.col("y") == 1).cast("int").alias("k")).groupBy("w").agg(F.count("*").alias("c"), F.sum("k").alias("k"))
    often = often.where((F.col("c") >= MIN_DF) & (z >= MIN_Z)).orderBy(z.desc(), "w").limit(VOCABULARY).select("w").toArrow().column("w").to_pylist()
    known = set(often) | _IDENTITY

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted(known.intersection(w)) for w in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(words, pa.list_(pa.string()))], schema=schema)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            found = sorted({tuple("\t".join(sorted(known & s)) for s in pair) for t in b.column("text").to_pylist() for pair in swaps(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["a", "b"])

    rows = sample.mapInArrow(reduced, "doc_id long, y int, words array<string>").toArrow().sort_by("doc_id").to_pylist()
    swapped = texts.select("text").mapInArrow(pairs, "a string, b string").distinct().orderBy(F.xxhash64("a", "b"), "a", "b").limit(SWAPS).toArrow().to_pylist()
    split = lambda x: set(x.split("\t")) if x else set()
    return train([set(r["words"]) for r in rows], np.array([r["y"] == 1 for r in rows]), [(split(x["a"]), split(x["b"])) for x in swapped])


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(map(model.score, b.column("text").to_pylist())), pa.float64())], ["doc_id", "score"])

    out = docs.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
