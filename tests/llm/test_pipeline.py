"""The whole pipeline against a plain one: a loop over documents in memory, stage by stage."""

import os
import zlib

import numpy as np
import pytest

from nearvote.llm import decontaminate, line_crf
from tests.llm.test_text_operators import brute_components, brute_rules, brute_spans

DATA = "/root/testdata/sf0.001"


def without_spans(text):
    out, at = "", 0
    merged = []
    for s, _, _, e in brute_spans(text):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out, at = out + text[at:s] + "[SECRET]", e
    return out + text[at:]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_run_equals_a_plain_pipeline(spark):
    import corpus_pipeline
    from public_tokenizers import path
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    field = line_crf.fit(docs.select("doc_id", "text"), labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}

    def content(text):
        lines = [x for x in text.split("\n") if x.strip(line_crf.SPACES)]
        x = line_crf.line_features(lines, field.frequent)
        # Viterbi over pairs of (score, states); the last states first on ties, as content is 0.
        best = [(x[0] @ field.emit[k], (k,)) for k in (0, 1)]
        for row in x[1:]:
            best = [max(((s + field.step[way[-1], k] + row @ field.emit[k], (*way, k)) for s, way in best), key=lambda b: b[0]) for k in (0, 1)]
        states = max(best, key=lambda b: b[0])[1]
        return sum(len(line) for line, k in zip(lines, states, strict=True) if k == 0) / sum(map(len, lines))

    texts = {i: t for i, t in texts.items() if not brute_rules(t)[5] and content(t) >= line_crf.MIN_CONTENT}
    ids = sorted(texts)
    first = {}
    for i, (_, root) in brute_components([texts[i] for i in ids]).items():
        first.setdefault(root, ids[i])
    texts = {i: texts[i] for i in first.values()}
    items = [decontaminate.Items.of([(r.item_id, decontaminate.plain(r.text))]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not any(decontaminate.matches([decontaminate.plain(t)], item) for item in items)}
    known = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = {i: np.array([*known.encode(without_spans(t), add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == set(want) and sum(r.length for r in got) == sum(map(len, want.values()))
    for r in got:
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
