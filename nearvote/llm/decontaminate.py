"""Benchmark decontamination by the q-gram lemma: windows of benchmark items share enough character q-grams
with a region of a document, in one of the overlapping bands of diagonals, or are dropped; regions that meet
the bound are verified by banded alignment.

Texts are compared as UTF-8 bytes, case-folded, in Unicode's composed form (NFC), and with runs of ASCII white
space as one blank.
A window of w bytes may differ by EDITS = w * EDIT_SHARE edits; then it shares at least w - Q + 1 - Q * EDITS
q-grams with its region, whose diagonals lie within EDITS of each other. Windows of WINDOW bytes, half of
one apart, cover an item.

Besides, verbatim stretches (runs of shared q-grams on one diagonal) cover the item's bytes that they hold, so
truncated passages and passages with replaced words count by what is left of them. Stretches of LONG bytes count
wherever they are in the document, shorter ones if their diagonals lie in one band of half the item's length.

A document is contaminated by an item if at least MIN_COVER of its bytes, and MIN_MATCH bytes, are covered by both
together. `edits` are those of the verified windows.

Items are taken in blocks whose tables have at most BLOCK_BYTES, each block against all documents; so what goes
to the executors has a bounded size. Hits are made HITS at a time, and stretches alone are kept of them. Items shorter than MIN_ITEM bytes, down to one character, match
where they are whole and verbatim, and don't begin or end amid a word (an edge that is a letter, digit or underscore has
none beside it). Null or empty documents and items match nothing. Repeated items and documents give rows of
their own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.llm.common import text_blocks

U = np.uint64
Q = 12
WINDOW = 96
EDIT_SHARE = 0.06
MIN_COVER = 0.5
MIN_ITEM = 48
MIN_MATCH = 40
LONG = 32
#: Bytes of the table of a block of items, and of each byte of text in it.
BLOCK_BYTES = 32_000_000
ENTRY_BYTES = 18
#: Hits of q-grams that are made, and stretches that are counted, at a time.
HITS, SLICE = 1 << 20, 1 << 17
SCHEMA = "doc_id long, item_id long, start long, length long, edits int, cover double"
_P = U(0x9E3779B97F4A7C15)


def plain(text: str | None) -> bytes:
    text = text or ""
    if text.isascii():
        text = text.lower()
    else:  # folded letters can be decomposed, and letters that are composed first can fold to others
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return b" ".join(text.encode("utf-8").split())


def grams(a: np.ndarray) -> np.ndarray:
    """Hashes of the Q = 8 + 4 byte grams of a byte array, by doubling."""
    if len(a) < Q:
        return np.empty(0, U)
    w, p = a.astype(U), _P
    parts = {1: w}
    for k in (1, 2, 4):
        w = w[: len(w) - k] * p + w[k:]
        w ^= w >> U(29)
        p = U(int(p) * int(_P) & 0xFFFFFFFFFFFFFFFF | 1)
        parts[2 * k] = w
    h = parts[8][: len(a) - Q + 1] * p + parts[4][8:]
    h ^= h >> U(31)
    h *= U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def _rolling(a: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(q, hashes of the grams of q bytes) for q from 1 to `most`; each from the one before."""
    w, a = np.zeros(len(a) + 1, U), a.astype(U)
    for q in range(1, min(most, len(a)) + 1):
        w = w[:-1] * _P + (a[q - 1 :] + U(1))
        yield q, w


@dataclass
class Shorts:
    """Items shorter than MIN_ITEM. Each is looked up by one of its grams of at most Q bytes, the one that the fewest
    of them share: `tables` has by q the sorted hashes, the items' numbers, and the last 16 bits that occur."""

    ids: list[int]
    texts: list[bytes]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple[int, bytes]]) -> Shorts:
        ids, texts = [r[0] for r in rows], [r[1] for r in rows]
        by_q: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, text in enumerate(texts):
            *_, (q, h) = _rolling(np.frombuffer(text, np.uint8), Q)
            by_q.setdefault(q, []).append((i, h))
        tables = {}
        for q, own in by_q.items():
            known, count = np.unique(np.concatenate([np.unique(h) for _, h in own]), return_counts=True)
            h = np.array([h[np.argmin(count[np.searchsorted(known, h)])] for _, h in own], U)
            order = np.argsort(h, kind="stable")
            last = np.zeros(1 << 16, bool)
            last[(h & U(0xFFFF)).astype(np.int64)] = True
            tables[q] = h[order], np.array([i for i, _ in own], np.int64)[order], last
        return Shorts(ids, texts, tables)

    def matches(self, docs: list[bytes]) -> list[tuple[int, int, int, int, int, float]]:
        """As `matches` below gives them; the first place of each item in a document."""
        if not self.tables or not docs:
            return []
        pairs = []
        begin = np.concatenate(([0], np.cumsum([len(d) + 1 for d in docs])))
        for q, w in _rolling(np.frombuffer(b"\n".join(docs) + b"\n", np.uint8), max(self.tables)):
            if q in self.tables:
                hashes, numbers, last = self.tables[q]
                at = np.flatnonzero(last[(w & U(0xFFFF)).astype(np.int64)])
                lo, hi = np.searchsorted(hashes, w[at], "left"), np.searchsorted(hashes, w[at], "right")
                doc, some = np.searchsorted(begin, at, "right") - 1, hi > lo
                for d, a, b in np.unique(np.stack([doc[some], lo[some], hi[some]], axis=1), axis=0).tolist():
                    pairs.extend((d, i) for i in numbers[a:b].tolist())
        out, text, known = [], "", -1
        for d, i in sorted(pairs):
            if self.texts[i] in docs[d]:
                if d != known:
                    text, known = docs[d].decode("utf-8"), d
                item = self.texts[i].decode("utf-8")
                at = _whole(text, item)
                if at >= 0:
                    out.append((d, self.ids[i], len(text[:at].encode("utf-8")), len(self.texts[i]), 0, 1.0))
        return out


def _word(c: str) -> bool:
    return c.isalnum() or c == "_" or unicodedata.category(c)[:1] == "M"


def _whole(text: str, item: str) -> int:
    """The first place where the item is in the text and cuts no word, or -1."""
    at = text.find(item)
    while at >= 0:
        end = at + len(item)
        if not (at and _word(item[0]) and _word(text[at - 1])) and not (end < len(text) and _word(item[-1]) and _word(text[end])):
            return at
        at = text.find(item, at + 1)
    return -1


@dataclass
class Items:
    """A block of items: their plain bytes; `data`, these joined, from `base` on each; windows (item, start, width,
    edits); and the q-gram table sorted by hash, with the item and the place
    in it; `first` marks the first 22 bits of hashes that occur. `shorts` has those shorter than MIN_ITEM."""

    ids: list[int]
    texts: list[bytes]
    data: np.ndarray
    base: np.ndarray
    windows: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    first: np.ndarray
    shorts: Shorts

    @staticmethod
    def of(rows: list[tuple[int, bytes]]) -> Items:
        shorts = Shorts.of([r for r in rows if 0 < len(r[1]) < MIN_ITEM])
        long = [r for r in rows if len(r[1]) >= MIN_ITEM]
        texts, windows, hs = [text for _, text in long], [], []
        for i, text in enumerate(texts):
            n, width = len(text), min(WINDOW, len(text))
            windows += [(i, s, width, int(width * EDIT_SHARE)) for s in sorted({*range(0, n - width + 1, max(1, width // 2)), n - width})]
            hs.append(grams(np.frombuffer(text, np.uint8)))
        h = np.concatenate(hs) if hs else np.empty(0, U)
        counts = [len(x) for x in hs]
        order = np.argsort(h, kind="stable")
        owner, place = np.repeat(np.arange(len(hs)), counts), np.concatenate([np.arange(n) for n in counts]) if hs else np.empty(0, np.int64)
        first = np.zeros(1 << 22, bool)
        first[(h >> U(42)).astype(np.int64)] = True
        base = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        data = np.frombuffer(b"".join(texts) + b"\0" * (Q + 1), np.uint8)
        return Items([i for i, _ in long], texts, data, base, np.array(windows, np.int64).reshape(-1, 4), h[order], owner[order].astype(np.int32), place[order].astype(np.int32), first, shorts)


def edit_distances(patterns: list[bytes], regions: list[bytes], most: int) -> np.ndarray:
    """The least edits from each pattern to any stretch of its region, or more than `most`: dynamic programming in
    a band of diagonals, for all pairs at once. All patterns have one length, and regions that length + 4 * most
    at the most; a region's start is free within the band."""
    w, width = len(patterns[0]), max(map(len, regions))
    band = width - w + 1 + 2 * most
    p = np.array([np.frombuffer(x, np.uint8) for x in patterns]).astype(np.int16)
    r = np.full((len(regions), width + 2 * band), -1, np.int16)
    for i, x in enumerate(regions):
        r[i, most : most + len(x)] = np.frombuffer(x, np.uint8)
    big = most + 1
    cost = np.zeros((len(regions), band), np.int16)  # cost[:, b]: row i of the pattern ends at place i + b - most of the region
    for i in range(w):
        diagonal = cost + (r[:, i : i + band] != p[:, i, None])
        up = np.concatenate([cost[:, 1:] + 1, np.full((len(regions), 1), big, np.int16)], axis=1)
        new = np.minimum(diagonal, up)
        steps = np.arange(band, dtype=np.int16)  # left moves: a running minimum of cost minus place
        new = np.minimum.accumulate(new - steps, axis=1) + steps
        cost = np.minimum(new, big)
    return cost.min(axis=1)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """The numbers, from 0, of the runs of equal keys in sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _union(group: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """By group, from 0, the bytes of the union of its stretches [s, e)."""
    order = np.lexsort((s, group))
    group, s, e = group[order], s[order], e[order]
    lift = group * (int(e.max()) + 1)
    top = np.maximum.accumulate(e + lift)
    before = np.concatenate(([0], top[:-1])) - lift
    return np.bincount(group, np.maximum(0, e - np.maximum(s, before)), int(group[-1]) + 1).astype(np.int64)


@dataclass
class Stretches:
    """Verbatim stretches of items in documents, sorted by document, item and diagonal: [start, stop) in the item."""

    doc: np.ndarray
    item: np.ndarray
    diagonal: np.ndarray
    start: np.ndarray
    stop: np.ndarray

    @staticmethod
    def of(docs: list[bytes], items: Items) -> Stretches:
        """Those of q-gram hits (place in the documents, place in an item), HITS of which are made at a time.

        A hit begins a stretch if the bytes before it differ, and ends one if those after it do; only these are
        kept, so a run of one character in both takes as many as its documents have bytes, not their product."""
        buffer = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
        begin = np.concatenate(([0], np.cumsum([len(d) + 1 for d in docs])))
        h, size = grams(buffer), np.diff(items.base)
        at = np.flatnonzero(items.first[(h >> U(42)).astype(np.int64)])
        lo, hi = np.searchsorted(items.hashes, h[at], "left"), np.searchsorted(items.hashes, h[at], "right")
        some = hi > lo
        at, lo, n = at[some], lo[some], (hi - lo)[some]
        total = np.concatenate(([0], np.cumsum(n)))
        ends: tuple[list, list] = [], []
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(total, total[i] + HITS, "right")) - 1)
            entry = np.repeat(lo[i:j] - (total[i:j] - total[i]), n[i:j]) + np.arange(total[j] - total[i])
            pos, item, place = np.repeat(at[i:j], n[i:j]), items.owner[entry], items.place[entry]
            i, own = j, items.base[item] + place
            starts = (place == 0) | (pos == 0) | (buffer[pos - 1] != items.data[own - 1])
            stops = (place == size[item] - Q) | (buffer[np.minimum(pos + Q, len(buffer) - 1)] != items.data[own + Q])
            for kept, some in zip(ends, (starts, stops), strict=True):
                kept.append((item[some].astype(np.int64), pos[some] - place[some], place[some].astype(np.int64)))
        if not len(at):
            return Stretches(*(np.empty(0, np.int64) for _ in range(5)))
        both = []
        for kept in ends:
            cols = [np.concatenate(c) for c in zip(*kept, strict=True)]
            order = np.lexsort(cols[::-1])
            both.append([c[order] for c in cols])
        (item, diagonal, start), (_, _, last) = both
        doc = np.searchsorted(begin, diagonal + start, "right") - 1
        diagonal = diagonal - begin[doc]
        order = np.lexsort((start, diagonal, item, doc))
        return Stretches(*(x[order] for x in (doc, item, diagonal, start, last + Q)))

    def part(self, rows) -> Stretches:
        return Stretches(self.doc[rows], self.item[rows], self.diagonal[rows], self.start[rows], self.stop[rows])

    def regions(self, items: Items) -> np.ndarray:
        """(document, window, first diagonal of a band) where the band has enough of the window's q-grams. Bands
        have 2 * (edits + 1) diagonals, each half of one apart.

        SLICE stretches are taken at a time, and again those whose diagonals could be in one band with the last."""
        out, n, wide = [np.empty((0, 3), np.int64)], len(self.doc), 2 * (int(WINDOW * EDIT_SHARE) + 1)
        key = items.windows[:, 0] << 32
        for i in range(0, n, SLICE):
            j = min(n, i + SLICE)
            while j < n and (self.doc[j], self.item[j]) == (self.doc[i + SLICE - 1], self.item[i + SLICE - 1]) and self.diagonal[j] < self.diagonal[i + SLICE - 1] + wide:
                j += 1
            s = self.part(slice(i, j))
            lo = np.searchsorted(key + items.windows[:, 1] + items.windows[:, 2] - Q, (s.item << 32) + s.start, "left")
            hi = np.searchsorted(key + items.windows[:, 1], (s.item << 32) + s.stop - Q, "right")
            count = np.maximum(0, hi - lo)
            row = np.repeat(np.arange(len(count)), count)
            window = np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)
            _, ws, w, e = items.windows[window].T
            diagonal, doc = s.diagonal[row] + ws, s.doc[row]
            start, stop = np.maximum(s.start[row], ws), np.minimum(s.stop[row] - Q, ws + w - Q) + 1
            for shift in (0, 1):
                band = (diagonal + shift * (e + 1)) // (2 * (e + 1))
                order = np.lexsort((band, window, doc))
                keys = doc[order], window[order], band[order]
                if not len(order):
                    continue
                group = _groups(*keys)
                head = np.flatnonzero(np.diff(group, prepend=-1))
                d, k, b = (x[head] for x in keys)
                most = items.windows[k, 3]
                ok = _union(group, start[order], stop[order]) >= np.maximum(1, items.windows[k, 2] - Q + 1 - Q * most)
                out.append(np.stack([d, k, b * 2 * (most + 1) - shift * (most + 1)], axis=1)[ok])
        return np.unique(np.concatenate(out), axis=0)

    def bands(self, sizes: np.ndarray, shift: int) -> np.ndarray:
        """Bands of half an item's length, each half of one apart; so diagonals a quarter apart share one."""
        step = np.maximum(16, sizes[self.item] // 4)
        return (self.diagonal + shift * step) // (2 * step)

    def likely(self, sizes: np.ndarray, known: dict[tuple[int, int], int]) -> Iterator[tuple[int, int, slice]]:
        """(document, item, rows) where the best band, all long stretches and the `known` bytes could suffice."""
        pair = _groups(self.doc, self.item)
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        best = np.zeros(len(first), np.int64)
        for shift in (0, 1):
            band = _groups(self.doc, self.item, self.bands(sizes, shift))
            np.maximum.at(best, pair[np.flatnonzero(np.diff(band, prepend=-1))], _union(band, self.start, self.stop))
        long = self.stop - self.start >= LONG
        if long.any():
            some, own = np.unique(pair[long], return_inverse=True)
            best[some] += _union(own, self.start[long], self.stop[long])
        stop = np.concatenate((first[1:], [len(pair)]))
        need = _need(sizes[self.item[first]])
        for d, i, a, b, n, m in zip(*(x.tolist() for x in (self.doc[first], self.item[first], first, stop, best, need)), strict=True):
            if n + known.get((d, i), 0) >= m:
                yield d, i, slice(a, b)


def _need(size):
    """The least covered bytes of an item that contaminate."""
    return np.maximum(np.ceil(MIN_COVER * size), np.minimum(MIN_MATCH, size))


def matches(docs: list[bytes], items: Items) -> list[tuple[int, int, int, int, int, float]]:
    """(document, item, start, length, edits, cover) of each contaminated document and item; start and length
    are of the region in the plain document, in bytes."""
    return sorted(_long_matches(docs, items) + items.shorts.matches(docs))


def _long_matches(docs: list[bytes], items: Items) -> list[tuple[int, int, int, int, int, float]]:
    """Those of items of MIN_ITEM bytes or more."""
    if not len(items.hashes) or not docs:
        return []
    verbatim = Stretches.of(docs, items)
    if not len(verbatim.doc):
        return []
    # A region of one window can lie in two bands; both are verified, grouped by window size.
    found: dict[tuple[int, int], Found] = {}
    todo: dict[int, list[tuple[int, int, int, bytes, bytes]]] = {}

    def verify(w: int) -> None:
        e, group = int(w * EDIT_SHARE), todo.pop(w)
        cost = edit_distances([x[3] for x in group], [x[4] for x in group], e)
        for (d, k, left, _, _), c in zip(group, cost.tolist(), strict=True):
            if c <= e:
                item, start = items.windows[k, :2].tolist()
                found.setdefault((d, item), Found.of(len(items.texts[item]))).add(start, w, left + e, int(c))

    for d, k, first in verbatim.regions(items).tolist():
        item, start, w, e = items.windows[k].tolist()
        pattern = items.texts[item][start : start + w]
        left = max(0, first - e)
        region = docs[d][left : first + 3 * e + 2 + w]
        exact = region.find(pattern)
        if exact >= 0:
            found.setdefault((d, item), Found.of(len(items.texts[item]))).add(start, w, left + exact, 0)
        elif len(region) >= w - e:
            todo.setdefault(w, []).append((d, k, left, pattern, region))
            if len(todo[w]) == 512:
                verify(w)
    for w in list(todo):
        verify(w)
    sizes = np.diff(items.base)
    best = {pair: (f.covered, f.low, f.high) for pair, f in found.items()}
    for d, item, rows in verbatim.likely(sizes, {pair: int(f.covered.sum()) for pair, f in found.items()}):
        own = verbatim.part(rows)
        long = own.stop - own.start >= LONG
        base = _covered(int(sizes[item]), own.start[long], own.stop[long])
        if (d, item) in found:
            base |= found[d, item].covered
        # What a band adds to that, counted in the bytes that it lacks.
        lacks = np.concatenate(([0], np.cumsum(~base)))
        for shift in (0, 1):
            band = own.bands(sizes, shift)
            group = _groups(band)
            gain = _union(group, lacks[own.start], lacks[own.stop])
            use = (group == np.argmax(gain)) | long
            if (d, item) not in best or base.sum() + gain.max() > best[d, item][0].sum():
                at = own.diagonal[use] + own.start[use]
                covered = base | _covered(int(sizes[item]), own.start[use], own.stop[use])
                best[d, item] = covered, int(at.min()), int((at + own.stop[use] - own.start[use]).max())
    out = []
    for (d, item), (covered, low, high) in sorted(best.items(), key=lambda x: x[0]):
        if covered.sum() >= _need(sizes[item]):
            f = found.get((d, item))
            low, high = (min(low, f.low), max(high, f.high)) if f else (low, high)
            out.append((d, items.ids[item], low, high - low, sum(f.edits.values()) if f else 0, float(covered.mean())))
    return out


@dataclass
class Found:
    """The verified windows of an item in a document: bytes that they cover, the least edits of each, where they are."""

    covered: np.ndarray
    edits: dict[int, int]
    low: int
    high: int

    @staticmethod
    def of(size: int) -> Found:
        return Found(np.zeros(size, bool), {}, 1 << 62, -1)

    def add(self, start: int, w: int, at: int, cost: int) -> None:
        self.covered[start : start + w] = True
        self.edits[start] = min(cost, self.edits.get(start, cost))
        self.low, self.high = min(self.low, at), max(self.high, at + w)


def _covered(size: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return np.cumsum(np.bincount(start, minlength=size + 1) - np.bincount(stop, minlength=size + 1))[:size] > 0


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items, in blocks whose tables have at most BLOCK_BYTES (an item longer than that is a block); streamed, not collected."""
    rows, size = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null").orderBy("item_id", "text").toLocalIterator():
        own = plain(text)
        if rows and size + len(own) * ENTRY_BYTES > BLOCK_BYTES:
            yield rows
            rows, size = [], 0
        rows.append((item_id, own))
        size += len(own) * ENTRY_BYTES
    yield rows


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """SCHEMA: a row for each document (row) and item that contaminates it."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def against(items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in text_blocks(batches, 1_000_000):
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[r[0]], *r[1:]) for r in matches([plain(t) for t in b.column("text").to_pylist()], items)]
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "start", "length", "edits", "cover"), r, strict=True)) for r in rows], pa.schema([(x, pa.int64()) for x in ("doc_id", "item_id", "start", "length")] + [("edits", pa.int32()), ("cover", pa.float64())]))

        return docs.mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionAll, [against(Items.of(rows)) for rows in _item_blocks(benchmark)])


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that no item contaminates, with all their columns; one pass for each block of items."""
    for rows in _item_blocks(benchmark):
        items = Items.of(rows)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in text_blocks(batches, 1_000_000):
                stays = np.ones(b.num_rows, bool)
                stays[[r[0] for r in matches([plain(t) for t in b.column("text").to_pylist()], items)]] = False
                yield b.filter(pa.array(stays))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
