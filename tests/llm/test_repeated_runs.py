"""Decontamination of texts and items with repeated runs: bounded hits, the same results at any slice."""

import random
import subprocess
import sys

import pytest

from nearvote.llm import decontaminate
from tests.llm.test_text_operators import words


def test_memory_of_one_repeated_character():
    """A text of 1 MB of one character and items with runs of it: less than 700 MB in all, imports included."""
    code = """
import resource
from nearvote.llm.decontaminate import Items, matches
got = matches([b"=" * 1_000_000, b"other"], Items.of([(1, b"=" * 200), (2, b"=" * 90 + b" and words that no other text has at all" * 4)]))
print([(r[0], r[1], r[5]) for r in got], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 700_000)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert done.stdout.strip() == "[(0, 1, 1.0)] True"


@pytest.mark.parametrize(("hits", "part"), [(1, 1), (50, 7), (1 << 20, 1 << 17)])
def test_slices_change_nothing(monkeypatch, hits, part):
    rng = random.Random(31)
    items = [(i, decontaminate.plain(words(rng, 22))) for i in range(5)] + [(8, b"=-" * 60), (9, b"ab ab " + b"xyz " * 30), (10, b"q" * 130 + words(rng, 12).encode())]
    texts = [b"=-" * 300, b"xyz " * 90, items[0][1] + b" " + items[0][1], b"q" * 400, items[7][1][60:], b"", *(decontaminate.plain(words(rng, 30) + " " + items[i][1].decode()[: 60 + 9 * i]) for i in range(5))]
    whole = decontaminate.matches(texts, block := decontaminate.Items.of(items))
    monkeypatch.setattr(decontaminate, "HITS", hits)
    monkeypatch.setattr(decontaminate, "SLICE", part)
    assert decontaminate.matches(texts, block) == whole and {(0, 8), (1, 9), (2, 0), (4, 10)} <= {r[:2] for r in whole}


def test_stretches_equal_brute_force():
    rng = random.Random(32)
    for _ in range(40):
        items = decontaminate.Items.of([(i, bytes(rng.choice(b"ab") for _ in range(60)) * rng.randint(1, 2)) for i in range(2)])
        docs = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) + items.texts[rng.randint(0, 1)][rng.randint(0, 30) :] for _ in range(2)]
        want = set()
        for d, text in enumerate(docs):
            for i, item in enumerate(items.texts):
                hit = {(p - k, k) for k in range(len(item) - 11) for p in range(len(text) - 11) if item[k : k + 12] == text[p : p + 12]}
                for diagonal, k in hit:
                    if (diagonal, k - 1) not in hit:
                        last = k
                        while (diagonal, last + 1) in hit:
                            last += 1
                        want.add((d, i, diagonal, k, last + 12))
        s = decontaminate.Stretches.of(docs, items)
        assert set(zip(*(x.tolist() for x in (s.doc, s.item, s.diagonal, s.start, s.stop)), strict=True)) == want
