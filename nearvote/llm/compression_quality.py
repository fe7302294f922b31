"""Quality classifier by compression: zstandard dictionaries built from good and from bad labelled text; the
normalised difference of compressed sizes, calibrated by a logistic curve, is the score. The calibration knows
the text's size, as short texts give little evidence, and how far it compresses at all.

A text is compressed in blocks of BLOCK bytes, all of them, with either dictionary, so that the dictionaries
matter to the end of a long text. A bounded sample of labelled documents that are not held out
(common.SAMPLE_ROWS) is used: blocks of one half of it, of either label at most TRAIN_BLOCKS, chosen by hash, build the
dictionaries; the other half calibrates, by whole texts as in scoring.

Null and empty texts have a difference of 0 and get the curve's value for a text of no bytes. Without labels of both kinds the
score is the share of good labels (0.5 without any). Rows, ids and other columns: a row for each input row,
of doc_id and the results alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.llm.common import held_out, labelled_sample, text_blocks, written

BLOCK = 512
#: Bytes of a dictionary; blocks of either label that it is trained on at most.
DICTIONARY = 48_000
TRAIN_BLOCKS = 8_000
LEVEL = 3
THRESHOLD = 0.7
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, difference double"


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self):
        """A function from text to (score, difference)."""
        sizes = _sizes(self.good), _sizes(self.bad)

        def run(text: str | None) -> tuple[float, float]:
            x = _evidence(text or "", *sizes)
            return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -60, 60)))), float(x[0])

        return run


def _blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def _sizes(dictionary: bytes):
    own = zstd.ZstdCompressionDict(dictionary) if dictionary else None
    params = zstd.ZstdCompressionParameters.from_level(LEVEL, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    if own:
        own.precompute_compress(compression_params=params)
    pack = zstd.ZstdCompressor(dict_data=own, compression_params=params).compress
    return lambda block: len(pack(block))


def _evidence(text: str, good_size, bad_size) -> np.ndarray:
    """What the curve takes: the normalised difference (above 0, the text is more like good text), the same for
    short texts alone, how far it compresses, shortness, 1."""
    blocks = _blocks(text)
    good, bad, size = sum(map(good_size, blocks)), sum(map(bad_size, blocks)), sum(map(len, blocks))
    d = (bad - good) / (bad + good) if good + bad else 0.0
    short = 1 / (1 + size / 200)
    return np.array([d, d * short, min(1.0, (good + bad) / (2 * size)) if size else 0.5, short, 1.0])


def _dictionary(samples: list[bytes]) -> bytes:
    total = sum(map(len, samples))
    if not total:
        return b""
    try:
        return zstd.train_dictionary(min(DICTIONARY, max(1024, total // 4)), samples, level=LEVEL).as_bytes()
    except zstd.ZstdError:  # too few samples for training: their bytes themselves
        return b"".join(samples)[-DICTIONARY:]


def fit(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    sample = written(labelled_sample(docs, labels, "quality"), "quality-sample").select("doc_id", "text", (F.col("y") == 1).alias("good"))
    kinds = sorted(r.good for r in sample.select("good").distinct().collect())
    if len(kinds) < 2:
        return CompressionModel(b"", b"", (0.0, 0.0, 0.0, 0.0, {(): 0.0, (False,): -4.0, (True,): 4.0}[tuple(kinds)]))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            rows = [(good, x) for text, good in zip(b.column("text").to_pylist(), b.column("good").to_pylist(), strict=True) for x in _blocks(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in ((0, pa.bool_()), (1, pa.binary()))], ["good", "block"])

    # A text in both halves, as a copy, would flatter the curve; so a text's hash decides.
    build = F.pmod(F.xxhash64("text"), F.lit(2)) == 1
    own = sample.where(build).select("text", "good").mapInArrow(blocks, "good boolean, block binary").distinct()

    def dictionary(good: bool) -> bytes:
        rows = own.where(F.col("good") == good).orderBy(F.xxhash64("block"), "block").limit(TRAIN_BLOCKS).select("block").toArrow()
        return _dictionary(rows.column("block").to_pylist())

    good, bad = dictionary(True), dictionary(False)

    def evidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _sizes(good), _sizes(bad)
        for b in text_blocks(batches):
            rows = [_evidence(text, *sizes).tolist() for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("good"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "good", "x"])

    # Where one half has no text, all calibrate.
    rest = sample.where(~build)
    rows = (sample if rest.isEmpty() else rest).mapInArrow(evidences, "doc_id long, good boolean, x array<double>").toArrow().sort_by("doc_id").to_pylist()
    return CompressionModel(good, bad, _logistic(np.array([r["x"] for r in rows]), np.array([float(r["good"]) for r in rows])))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, ...]:
    """Weights by Newton steps, with a weak prior but on the last, and targets off 0 and 1 if all are one."""
    y = (y * y.sum() + 1) / (y.sum() + 2) if y.all() or not y.any() else y
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z, w, prior = x / scale, np.zeros(x.shape[1]), np.array([0.05] * (x.shape[1] - 1) + [1e-6])

    def loss(w: np.ndarray) -> float:
        return float((np.logaddexp(0, z @ w) - y * (z @ w)).sum() + 0.5 * (prior * w * w).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(prior)
        move, now = np.linalg.solve(h, z.T @ (y - p) - prior * w), loss(w)
        while loss(w + move) > now and np.abs(move).max() > 1e-9:  # a whole step can lead past the minimum
            move = move / 2
        w = w + move
    return tuple(float(v) for v in w / scale)


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in text_blocks(batches):
            got = [score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "score", "difference"])

    out = docs.mapInArrow(run, "doc_id long, score double, difference double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "difference")
