"""Quality rules: a linear-chain conditional random field labels the lines of a text as content or boilerplate
(Viterbi decoding); the share of content decides whether a document stays.

The field is trained here, on all labelled documents that are not held out, with a label for each line.
Boilerplate are lines that many of these documents have between different neighbours (licences, menus, banners;
whole copies of a document do not make its lines so), lines that a document repeats, and those lines of documents
of bad quality that a line by itself tells from lines of good ones. All others are content, so states change
within documents. Line features do not look at words, but for the table of frequent lines. Sums over all lines are
made by tasks, from a table of features; only they and the frequent lines' hashes go to the driver. Without labels
of both kinds the weights are zero and every line counts as content.

Null texts are empty: no words, so base_failed. All lines of a text take part, however long it is. Repeated
rows and ids give rows of their own; other columns of the input are ignored or, in `keep_documents`, kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.llm.common import labelled_ids, labelled_texts, text_blocks, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document stays if at least this share of its characters in lines with words is content.
MIN_CONTENT = 0.5
#: Lines of one training sequence; longer texts give several.
SEQUENCE = 48
#: Training sequences of a block, of like lengths; a block is padded and summed at once.
BLOCK = 512
#: A frequent line has so many different neighbours before and after it, in half of the documents that have it or
#: more.
NEIGHBOURS = 5
FEATURES = 15
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"
_ODD = (np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_END = re.compile(r"[.!?…:;]$")


@dataclass(frozen=True)
class LineField:
    """Weights (2, FEATURES) of the states content 0 and boilerplate 1, and (2, 2) of transitions; frequent lines."""

    emit: np.ndarray
    step: np.ndarray
    frequent: frozenset[int] = frozenset()

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely states of a sequence of lines; on a tie, content."""
        scores = x @ self.emit.T
        a, b = scores[0]
        (s00, s01), (s10, s11) = self.step.tolist()
        back = []
        for c, d in scores[1:].tolist():
            to0, to1 = a + s00 >= b + s10, a + s01 >= b + s11
            back.append((not to0, not to1))
            a, b = (a + s00 if to0 else b + s10) + c, (a + s01 if to1 else b + s11) + d
        states = [int(b > a)]
        for choice in reversed(back):
            states.append(int(choice[states[-1]]))
        return np.array(states[::-1])


def repeated_words(words: list[bytes]) -> int:
    """Words in WINDOW-word windows that a text holds twice or more, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    s = h[:n] * _ODD[0]
    for i in range(1, WINDOW):
        s += h[i : i + n] * _ODD[i]
    order = np.argsort(s)
    again = s[order[1:]] == s[order[:-1]]
    if not again.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][again]] = True
    twice[order[:-1][again]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.strip().encode("utf-8", "surrogatepass")) >> 1


def line_features(lines: list[str], frequent: frozenset[int] = frozenset()) -> np.ndarray:
    """A row for each line; shares, so that long and short lines compare. frequent: hashes of frequent lines."""
    out, seen = np.zeros((len(lines), FEATURES)), set()
    for i, line in enumerate(lines):
        words = line.split()
        k, n = len(words), max(1, len(line))
        distinct = len(set(words))
        symbols = sum(map(line.count, SYMBOLS))
        ends = sum(w[-1] in ".,!?;:" for w in words)
        upper = 0.0 if line.islower() else sum(map(str.isupper, words)) / max(1, k)
        out[i] = (
            1, upper, min(1, 4 * symbols / n), min(1, 2 * line.count("|") / max(1, k)), min(1, line.count("!!") / max(1, k)),
            1 - distinct / max(1, k), line in seen, bool(_END.search(line)), k < 4, k > 12, ends / max(1, k),
            min(1, sum(map(line.count, "0123456789")) / n * 4), k == 0, sum(w[0].isupper() for w in words) / max(1, k),
            bool(frequent) and line_hash(line) in frequent,
        )
        seen.add(line)
    return out


#: Columns of line_features that by themselves make a line boilerplate.
REPEATED, COMMON = 6, 14


def line_labels(rows: list[np.ndarray], bad: list[bool], lone: np.ndarray | None = None) -> list[np.ndarray]:
    """States of all lines of sequences (rows of line_features), whose documents are of bad quality or not. lone:
    the weights of _lone, if there are documents of both kinds."""
    x = np.concatenate(rows) if rows else np.zeros((0, FEATURES))
    y = np.repeat(np.asarray(bad, bool), [len(r) for r in rows])
    state = (x[:, REPEATED] > 0) | (x[:, COMMON] > 0) | (y & (x @ lone > 0) if lone is not None else False)
    return np.split(state.astype(int), np.cumsum([len(r) for r in rows])[:-1]) if rows else []


def _lone(blocks: DataFrame, n_bad: int, n_good: int, rounds: int = 25) -> np.ndarray:
    """The weights of the logistic curve by which a line alone tells bad documents (Newton steps, both kinds, of n_bad
    and n_good lines, of one weight)."""
    w = np.zeros(FEATURES)
    for _ in range(rounds):

        def part(rows: list[np.ndarray], bad: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            x, y = np.concatenate(rows), np.repeat(bad, [len(r) for r in rows])
            share, p = np.where(y, 0.5 / n_bad, 0.5 / n_good), 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            return np.concatenate([x.T @ (share * (y - p)), ((x * (share * p * (1 - p))[:, None]).T @ x).ravel()])

        sums = _total(blocks, part)
        move = np.linalg.solve(sums[FEATURES:].reshape(FEATURES, FEATURES) + 1e-4 * np.eye(FEATURES), sums[:FEATURES] - 1e-4 * w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def likelihood(emit: np.ndarray, step: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The conditional log-likelihood of the states y (n, t) under x (n, t, FEATURES), each sequence by its share,
    and its gradients by emit and step (forward-backward)."""
    n, t = y.shape
    e = x @ emit.T
    fwd, bwd = np.zeros_like(e), np.zeros_like(e)
    fwd[:, 0] = e[:, 0]
    for j in range(1, t):
        new = np.logaddexp(fwd[:, j - 1, 0, None] + step[0], fwd[:, j - 1, 1, None] + step[1]) + e[:, j]
        fwd[:, j] = np.where(mask[:, j, None], new, fwd[:, j - 1])
    z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    for j in range(t - 2, -1, -1):
        ahead = e[:, j + 1] + bwd[:, j + 1]
        new = np.logaddexp(step[:, 0] + ahead[:, 0, None], step[:, 1] + ahead[:, 1, None])
        bwd[:, j] = np.where(mask[:, j + 1, None], new, bwd[:, j + 1])
    weight = mask * share[:, None]
    hot = np.eye(2)[y]
    post = np.exp(np.clip(fwd + bwd - z[:, None, None], -60, 0))
    d_emit = np.einsum("ntk,ntf->kf", (hot - post) * weight[..., None], x, optimize=True)
    pair = np.exp(np.clip(fwd[:, :-1, :, None] + step + (e + bwd)[:, 1:, None, :] - z[:, None, None, None], -60, 0))
    real = hot[:, :-1, :, None] * hot[:, 1:, None, :]
    d_step = ((real - pair) * weight[:, 1:, None, None]).sum(axis=(0, 1))
    path = (e * hot).sum(axis=2) * mask
    path[:, 1:] += step[y[:, :-1], y[:, 1:]] * mask[:, 1:]
    return float((share * (path.sum(axis=1) - z)).sum()), d_emit, d_step


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as one array (n, t, FEATURES), and which of its lines are real."""
    mask = np.arange(max(map(len, rows))) < np.array([len(r) for r in rows])[:, None]
    x = np.zeros((*mask.shape, FEATURES))
    x[mask] = np.concatenate(rows)
    return x, mask


def maximum(ascent: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, rounds: int = 200, near: float = 1e-6) -> np.ndarray:
    """Where a concave function is largest (BFGS), from (value, gradient); done when no part of the gradient exceeds `near`."""
    w, h = np.zeros(size), np.eye(size)
    value, grad = ascent(w)
    for r in range(rounds):
        if np.abs(grad).max() <= near:
            break
        way = h @ grad
        if r == 0:
            way /= max(np.linalg.norm(grad), 1e-12)
        step, ahead = 1.0, ascent(w + way)
        while ahead[0] < value + 1e-4 * step * (grad @ way) and step > 1e-8:
            step /= 4
            ahead = ascent(w + step * way)
        if step <= 1e-8:
            break  # as near as the sums' own precision lets it come
        s, y = step * way, grad - ahead[1]
        if s @ y > 1e-18:
            if r == 0:
                h = np.eye(size) * (s @ y) / (y @ y)
            keep = np.eye(size) - np.outer(s, y) / (s @ y)
            h = keep @ h @ keep.T + np.outer(s, s) / (s @ y)
        w, value, grad = w + s, *ahead
    return w


def train(blocks: DataFrame, bad: int, good: int, lone: np.ndarray, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(emit, step) of maximum conditional likelihood, of the labels of all lines; the sequences of documents of either
    quality, so many, weigh as much."""

    def ascent(w: np.ndarray) -> tuple[float, np.ndarray]:
        emit, step = w[: 2 * FEATURES].reshape(2, FEATURES), w[2 * FEATURES :].reshape(2, 2)

        def part(rows: list[np.ndarray], poor: np.ndarray) -> np.ndarray:
            x, mask = padded(rows)
            y = np.zeros(mask.shape, int)
            y[mask] = np.concatenate(line_labels(rows, poor, lone))
            value, d_emit, d_step = likelihood(emit, step, x, y, mask, np.where(poor, 0.5 / bad, 0.5 / good) / mask.sum(axis=1))
            return np.concatenate([[value], d_emit.ravel(), d_step.ravel()])

        sums = _total(blocks, part)
        return sums[0] - decay / 2 * (w @ w), sums[1:] - decay * w

    w = maximum(ascent, 2 * FEATURES + 4)
    return w[: 2 * FEATURES].reshape(2, FEATURES), w[2 * FEATURES :].reshape(2, 2)


def _lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip(SPACES)]


def _sequences(texts: DataFrame) -> DataFrame:
    """(doc_id, at, lines, bad, h, x) of each SEQUENCE lines of texts (doc_id, text, y): the hashes of the lines, of the one
    before and the one after; their features, without COMMON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            rows = []
            for doc_id, text, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True):
                lines = _lines(text)
                h, x = np.array([0, *map(line_hash, lines), 1], np.int64), line_features(lines).astype(np.float32)
                rows += [(doc_id, at, min(SEQUENCE, len(x) - at), y != 1, h[at : at + SEQUENCE + 2].tobytes(), x[at : at + SEQUENCE].tobytes()) for at in range(0, len(x), SEQUENCE)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], ["doc_id", "at", "lines", "bad", "h", "x"])

    return texts.mapInArrow(run, "doc_id long, at long, lines long, bad boolean, h binary, x binary")


def _frequent(sequences: DataFrame) -> frozenset[int]:
    """Hashes of the frequent lines (NEIGHBOURS) of all sequences."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.frombuffer(h, np.int64) for h in b.column("h").to_pylist()]
            parts = [np.concatenate([r[cut] for r in rows]) if rows else np.zeros(0, np.int64) for cut in (np.s_[1:-1], np.s_[:-2], np.s_[2:])]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], ["h", "before", "after"])

    # A line counts once for each pair of neighbours: copies of a document, also in part, bring no new ones.
    by = sequences.select("h").mapInArrow(lines, "h long, before long, after long").distinct()
    some = by.groupBy("h").agg(F.count("*").alias("n"), F.countDistinct("before").alias("b"), F.countDistinct("after").alias("a"))
    some = some.where(F.least("a", "b") >= F.greatest(F.lit(NEIGHBOURS), F.col("n") / 2))
    return frozenset(some.select("h").toArrow().column("h").to_pylist())


def _blocks(sequences: DataFrame, frequent: frozenset[int]) -> DataFrame:
    """(sequences, bad_sequences, n, bad_n, lines, bad, x): BLOCK sequences a row, with all features, and their numbers of
    sequences and lines."""
    known = np.array(sorted(frequent), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                lines, bad = b.column("lines").to_numpy(), b.column("bad").to_numpy(zero_copy_only=False).astype(bool)
                x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(-1, FEATURES).copy()
                x[:, COMMON] = np.isin(np.concatenate([np.frombuffer(h, np.int64)[1:-1] for h in b.column("h").to_pylist()]), known)
                numbers = [[len(lines)], [int(bad.sum())], [int(lines.sum())], [int(lines[bad].sum())]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), *(pa.array([v.tobytes()], pa.binary()) for v in (lines, bad, x))], ["sequences", "bad_sequences", "n", "bad_n", "lines", "bad", "x"])

    ordered = sequences.repartition("doc_id", "at").sortWithinPartitions("lines", "doc_id", "at")
    return ordered.mapInArrow(run, "sequences long, bad_sequences long, n long, bad_n long, lines binary, bad binary, x binary")


def _total(blocks: DataFrame, part: Callable[[list[np.ndarray], np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(sequences, bad) over all blocks, whatever their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lines, bad, x in zip(*(b.column(c).to_pylist() for c in ("lines", "bad", "x")), strict=True):
                rows = np.split(np.frombuffer(x, np.float32).reshape(-1, FEATURES).astype(float), np.cumsum(np.frombuffer(lines, np.int64))[:-1])
                yield pa.RecordBatch.from_arrays([pa.array([part(rows, np.frombuffer(bad, bool)).tolist()], pa.list_(pa.float64()))], ["sums"])

    got = blocks.select("lines", "bad", "x").mapInArrow(run, "sums array<double>").toArrow().column("sums").to_pylist()
    return np.array([math.fsum(c) for c in zip(*got, strict=True)])


def fit(docs: DataFrame, labels: DataFrame) -> LineField:
    """The field of all labelled documents that are not held out."""
    sequences = written(_sequences(labelled_texts(docs, labelled_ids(labels, "quality"))), "line-sequences")
    frequent = _frequent(sequences)
    blocks = written(_blocks(sequences, frequent), "line-blocks")
    n = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sequences", "bad_sequences", "n", "bad_n"))).first()
    if n.bad_sequences in (0, n.sequences):
        return LineField(np.zeros((2, FEATURES)), np.zeros((2, 2)), frequent)
    lone = _lone(blocks, n.bad_n, n.n - n.bad_n)
    return LineField(*train(blocks, n.bad_sequences, n.sequences - n.bad_sequences, lone), frequent)


def judge(text: str | None, field: LineField) -> tuple:
    """The values of SCHEMA after doc_id."""
    text = text or ""
    words = text.encode("utf-8").split()
    n = len(words)
    seen, dup = set(), 0
    lines = _lines(text)
    for line in lines:
        dup += line in seen
        seen.add(line)
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    states = field.decode(line_features(lines, field.frequent)) if lines else np.zeros(0, int)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    share = float(sizes[states == 0].sum() / sizes.sum()) if lines else 0.0
    chars = len(text) - sum(map(text.count, SPACES))
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeat, failed, not failed and share >= MIN_CONTENT, share, len(lines), int((states == 0).sum())


def judge_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """SCHEMA for each row of documents (doc_id, text)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    field = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            rows = [judge(t, field) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[]] * 10
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.mapInArrow(run, SCHEMA)


def keep_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that stay, with all their columns: judged in one pass, without a join."""
    field = fit(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            yield b.filter(pa.array([judge(t, field)[6] for t in b.column("text").to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
