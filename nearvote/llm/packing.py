"""Hierarchical multi-length packing: documents are routed to context-size tiers by length, each tier is packed
to its exact size, gaps of long windows are filled from shorter tiers, and step groups hold equal tokens.

A document's ids are its text's byte-level BPE ids and then END_ID. Documents longer than the largest tier
give whole windows; what remains goes to the smallest tier that holds it. A window that lacks tokens takes
the longest piece that fits from the shorter tiers, and, where none fits, the head of one. So all sequences
but the last of a task are full, and tiers are powers of two. A task packs its own partition, in blocks of
BLOCK_TOKENS; tokens are never shuffled, and a lost task is redone with the same result.

Null texts are empty: one piece of END_ID alone. Rows with a null or repeated id are documents of their own.
Other columns are ignored. The string of the vocabulary's special token becomes that token, as its library has it.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.llm.common import text_blocks

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens of one step group; tokens that a task packs at a time.
STEP_TOKENS = 32 * 2048
BLOCK_TOKENS = 2_000_000
#: Fixed value: the vocabulary's special token and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: White space as the tokenizer's pattern knows it; runs of LONG_RUN characters are encoded on their own.
LONG_RUN = 65_536
_LONG = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_id long"


def tokenizer(path: str | None = None):
    """A function from text to ids. The ranks are the vocabulary of byte_bpe_50k.json; the ids are the same as
    that library's (a test holds them together), several times as fast.

    The pattern steps back through a run of white space and panics on very long ones. It makes one piece of a run
    but its last character, or of all of a run at the end; so a long run's piece is merged without the pattern,
    and the texts around it are encoded as ever. The texts around a special token are encoded apart."""
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return known.encode_ordinary(text)
        ids, at = [], 0
        for run in _LONG.finditer(text):
            stop = run.end() - (run.end() < len(text))
            ids += known.encode_ordinary(text[at : run.start()])
            ids += known._core_bpe.encode_single_piece(text[run.start() : stop].encode("utf-8"))
            at = stop
        return ids + known.encode_ordinary(text[at:])

    def encode(text: str) -> list[int]:
        first, *rest = text.split(SPECIAL)
        ids = plain(first)
        for part in rest:
            ids.append(SPECIAL_ID)
            ids += plain(part)
        return ids

    return encode


def tier_of(length: int) -> int:
    return next(t for t in TIERS if length <= t)


class Packer:
    """Takes documents, gives full sequences: lists of (document, start, length), with their tier.

    Pools hold pieces (length, number, document, start) by tier, sorted by length."""

    def __init__(self) -> None:
        self.pools: dict[int, list[tuple]] = {t: [] for t in TIERS}
        self.count = 0
        self.tokens = 0

    def _put(self, doc, start: int, length: int) -> None:
        self.count += 1
        self.tokens += length
        insort(self.pools[tier_of(length)], (length, self.count, doc, start))

    def _take(self, tier: int, at: int) -> tuple:
        piece = self.pools[tier].pop(at)
        self.tokens -= piece[0]
        return piece

    def add(self, doc, length: int) -> Iterator[tuple[int, list[tuple]]]:
        top = TIERS[-1]
        whole = length // top
        for w in range(whole):
            yield top, [(doc, w * top, top)]
        if rest := length - whole * top:
            self._put(doc, whole * top, rest)

    def _fill(self, tier: int, gap: int) -> tuple | None:
        """The longest piece of `tier` or a shorter one that fits the gap, else the head of the shortest piece."""
        for t in reversed(TIERS[: TIERS.index(tier) + 1]):
            at = bisect_right(self.pools[t], (gap, float("inf"))) - 1
            if at >= 0:
                return self._take(t, at)
        for t in TIERS:
            if self.pools[t]:
                length, number, doc, start = self._take(t, 0)
                self._put(doc, start + gap, length - gap)
                return gap, number, doc, start
        return None

    def pack(self, last: bool = False) -> Iterator[tuple[int, list[tuple]]]:
        """Full sequences of what is held. What fills no sequence stays, or, at last, gives padded ones."""
        for tier in reversed(TIERS):
            pool = self.pools[tier]
            while pool and self.tokens >= tier:
                length, _, doc, start = self._take(tier, len(pool) - 1)
                sequence, gap = [(doc, start, length)], tier - length
                while gap:
                    length, _, doc, start = self._fill(tier, gap)
                    sequence.append((doc, start, length))
                    gap -= length
                yield tier, sequence
        if last and self.tokens:
            rest = deque(p for t in reversed(TIERS) for p in reversed(self.pools[t]))
            sequence, room = [], TIERS[-1]
            while rest:
                length, _, doc, start = rest.popleft()
                part = min(length, room)
                sequence.append((doc, start, part))
                room -= part
                if part < length:
                    rest.appendleft((length - part, 0, doc, start + part))
                if not room or not rest:
                    yield TIERS[-1], sequence
                    sequence, room = [], TIERS[-1]
            self.__init__()


def pack_documents(documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """SCHEMA: a row for each piece. ids are little-endian unsigned 32-bit; offset is the piece's place in its
    sequence, gapless from 0; sequences shorter than the largest tier and not full are to be padded to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path)
        task = TaskContext.get().partitionId() << 36
        packer, next_sequence, in_tier, out = Packer(), 0, dict.fromkeys(TIERS, 0), []

        def emit(sequences) -> None:
            nonlocal next_sequence
            for tier, sequence in sequences:
                step = task + (TIERS.index(tier) << 32) + in_tier[tier] // (STEP_TOKENS // tier)
                in_tier[tier] += 1
                offset = 0
                for (doc_id, ids), start, length in sequence:
                    out.append((doc_id, start, length, ids[start : start + length].tobytes(), len(ids), task + next_sequence, offset, tier, step))
                    offset += length
                next_sequence += 1

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])
                out.clear()

        for batch in text_blocks(batches, 2_000_000):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                emit(packer.add((doc_id, ids), len(ids)))
            if packer.tokens >= BLOCK_TOKENS:
                emit(packer.pack())
            yield from flush()
        emit(packer.pack())
        emit(packer.pack(last=True))
        yield from flush()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, SCHEMA)


def report(documents: DataFrame) -> DataFrame:
    """The pieces with a digest in place of their ids."""
    return pack_documents(documents).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id")
