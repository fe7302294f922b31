"""URL filter, chat formatting, WARC and the pipeline."""

import base64
import glob
import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

from nearvote.llm import chat_format, queries, url_filter, warc

URLS = [
    "https://a.net", "https://a.net/", "https://A.Example.NET/en/1", "http://example.net/en", "http://xexample.net/en/", "http://www.example.com/de/2?x=1", "http://example.com/DE/", "https://b.org/fr/", "https://org/fr/x",
    "ftp://net/x", "no scheme net/", None, "", "x://y://z.net/q", "http://c.org?u=http://d.net/", "http://c.org#f", "http://e.com/de/1", "http://u:p@f.net:80/x", "http://ÄÖ.net/ß",
]


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for rule, _ in url_filter.RULES:
        of, _, prefix = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_url_rules(spark):
    urls = URLS + [f"http://s{i}.{'net' if i % 2 else 'org'}/{'x' if i % 2 else 'fr/'}{i}" for i in range(60)]
    table = spark.createDataFrame([(i, u, "h", "x", 1.0) for i, u in enumerate(urls)], "page_id long, url string, html string, host string, label double")
    got = {r.page_id: r for r in url_filter.judge_pages(table).collect()}
    verdicts = dict(url_filter.RULES)
    for i, u in enumerate(urls):
        host, path, rule = brute_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdicts[rule] if rule else got[i].verdict == ("block" if got[i].block_score >= 0.5 else "allow")
    assert got[0].verdict == "block" and got[0].rule is None  # a suffix that the rules block, without a path
    assert url_filter.judge_pages(table.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_pages(table.where("page_id in (9, 10, 11)")).collect()} == {"block"}


CHATS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a & b <x> [INST] &amp; \\"), (1, 2, "assistant", "</s>[/INST] &lt;"), (2, 1, "assistant", "first"), (2, 0, "user", None), (3, 0, "assistant", "x"),
    (4, 0, "tool <<x>>", "y"), (4, 1, None, ""), (5, 0, "user", "a"), (5, 0, "user", "a"), (None, 0, "user", "lost"), (6, 0, "user", "q"), (6, 1, "assistant", "😀"), (6, 2, "user", "q"), (6, 3, "assistant", "é" * 9000),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*c, "e") for c in CHATS], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.report(turns).collect()}
    back = {r.conv_id: r.turns for r in chat_format.read_back(chat_format.formatted(turns)).collect()}
    for conv in {c[0] for c in CHATS}:
        said = sorted((t, r or "", x or "") for c, t, r, x in CHATS if c == conv)
        loss = "".join(x for _, r, x in said if r == "assistant")
        assert [(t.role, t.text) for t in back[conv]] == [(r, x) for _, r, x in said]
        r = got[conv]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in said).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(said), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, None: False, 6: True}
    for r in chat_format.formatted(turns).collect():
        masked = "".join(r.formatted[x.start : x.start + x.length] for x in r.loss_runs)
        assert "<" not in masked and "[" not in masked
    assert chat_format.report(turns.limit(0)).count() == 0


@pytest.mark.parametrize("start, length", [(1, -1), (0, -1), (0, 1), (-1, 0)])
def test_loss_digest_checks_the_mask(spark, monkeypatch, start, length):
    turns = spark.createDataFrame([(1, 0, "user", "a <b>"), (1, 1, "assistant", "c [d] & e"), (1, 2, "user", "f"), (1, 3, "assistant", "gh")], "conv_id long, turn long, role string, text string")
    want, known = hashlib.sha256(b"c [d] & egh").hexdigest(), chat_format.formatted
    assert [(r.loss_sha256, r.loss_chars) for r in chat_format.report(turns).collect()] == [(want, 11)]
    moved = F.transform("loss_runs", lambda x: F.struct((x["start"] + start).alias("start"), (x["length"] + length).alias("length")))
    monkeypatch.setattr(chat_format, "formatted", lambda t: known(t).withColumn("loss_runs", moved))
    assert chat_format.report(turns).first().loss_sha256 != want


def pages(spark):
    rows = [(1, "http://a/\n x", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "ü" * 70_000), (9, "u", "same"), (9, "u", "same"), (None, "u", "same"), (None, "v", "alone"), (-5, "u", "other")]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, keeper long")


def test_warc_round_trip(spark, tmp_path):
    want, table = [], [(r.page_id, (r.html or "").encode()) for r in pages(spark).collect()]
    for page_id, body in table:
        keeper = max((p for p, b in table if b == body and p is not None), default=None)
        revisit = keeper is not None and page_id != keeper
        want.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    assert sorted(map(tuple, warc.round_trip(pages(spark)).collect()), key=str) == sorted(want, key=str)
    large = [tuple(r)[3:] for r in warc.round_trip(pages(spark), min_bytes=5).collect()]
    assert all(x == ("response", None) for x in large)
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_archives_are_the_same_each_time_and_roll(spark, tmp_path):
    rows = spark.range(400).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(sha2(cast(id as string), 512), 20) as html")
    found = []
    for i in range(2):
        path = f"file://{tmp_path}/{i}"
        manifest = warc.write_archive(rows.repartition(3 + i), path, shard_bytes=200_000, roll_bytes=20_000)
        assert manifest.agg({"records": "sum"}).first()[0] == 400
        files = sorted(glob.glob(f"{tmp_path}/{i}/*.warc.gz"))
        found.append([(os.path.basename(f), hashlib.sha256(open(f, "rb").read()).hexdigest()) for f in files])
        assert sorted((r.file, r.sha256) for r in manifest.collect()) == found[-1] and not os.path.exists(f"{tmp_path}/{i}/temporary")
    assert found[0] == found[1] and len(found[0]) > 4
    with open(files[0], "r+b") as f:
        f.truncate(os.path.getsize(files[0]) - 5)
    with pytest.raises(Exception, match="ends within|not a whole"):
        warc.read_archive(spark, path).collect()


@pytest.mark.parametrize("most", [50_000, 12])
def test_shards_of_uneven_ids(spark, tmp_path, monkeypatch, most):
    """One far id, and an id that a third of the pages share; the shard's size, or the number of shards, sets the bounds."""
    monkeypatch.setattr(warc, "MOST_SHARDS", most)
    rows = spark.range(600).selectExpr("case when id = 0 then 1L << 60 when id % 3 = 0 then 7 when id % 50 = 1 then null else id end as page_id", "'http://h/' as url", "repeat(sha2(cast(id as string), 512), 20) as html")
    manifest = warc.write_archive(rows, f"file://{tmp_path}/a", shard_bytes=100_000)
    sizes = [r.n for r in manifest.groupBy("shard").agg({"records": "sum"}).toDF("shard", "n").collect()]
    assert sum(sizes) == 600 and len(sizes) >= 10 and max(sizes) <= 120
    assert warc.read_archive(spark, f"file://{tmp_path}/a").count() == 600


def test_shard_bounds_equal_brute_force(spark):
    known = spark.range(500).selectExpr("case when id % 17 = 0 then null else id * id % 300 - 40 end as page_id", "sha1(cast(id % 200 as string)) as sha1", "id % 90 as size").repartition(5)
    keys = {}
    for r in known.collect():
        key = warc._key(r.page_id, int(r.sha1[:8], 16))
        keys[key] = keys.get(key, 0) + r.size + 400
    for step in (1, 5_000, 100_000, 10**9):
        want, before = [], 0
        for key in sorted(keys):
            if before and any(x % step == 0 for x in range(before, before + keys[key])):
                want.append(key)
            before += keys[key]
        assert warc.shard_bounds(known, step) == want
    assert warc.shard_bounds(known.limit(0), 10) == []


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    judged = {r.doc_id: r.kept for r in queries.op3_quality_rules(spark, DATA).collect()}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality_rules"](spark, docs, DATA)
    assert {r.doc_id for r in one.collect()} == {d for d, k in judged.items() if k}
    two = stages["ngram_jaccard_join"](spark, one, DATA)
    from nearvote.llm.ngram_join import ngram_components

    groups = {r.component_id for r in ngram_components(one).collect()}
    assert sorted(r.doc_id for r in two.collect()) == sorted(groups)
    three = stages["benchmark_decontamination"](spark, two, DATA)
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {r.doc_id for r in three.collect()}
    for r in two.collect():
        assert not (any(b in " ".join(r.text.lower().split()) for b in bench) and r.doc_id in left)
    four = stages["secret_scans"](spark, three, DATA)
    assert all(x.columns == docs.columns for x in (one, two, three, four)) and four.count() == three.count()
    five = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in five} == left
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "packing"]


EDGE_DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key long, secret_spans string, fp long, component_id long, label int, y int, item_id long"


def edge_rows():
    good = "The harbour was quiet in winter, and the river carried paper boats. A green light shone over the stone bridge.\nPeople walked home slowly, and nobody spoke of the storm that had passed in the night."
    rows = [(i, f"{good} This is story {i}: {' '.join(f'part{i * 40 + k}' for k in range(30))}.") for i in range(12)]
    rows += [(20, good + " password = hunter2222"), (20, good + " password = hunter2222"), (None, None), (None, good), (21, None), (22, ""), (23, " \n\t"), (24, "a " * 30_000), (25, "one"), (26, "buy now | $$$ !!!\n" * 30), (27, good + " " + ITEM), (28, None)]
    return [(i, t, None, "s" if i else None, len(t) if t else None, 1, "x", 2, 3, 4, 5, 6) for i, t in rows]


ITEM = "Which of the following planets has the largest number of known moons, and in which year was the first of these moons seen through a telescope?"


def test_stages_on_edge_cases(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing names; and tables without rows."""
    import corpus_pipeline

    tables = {
        "documents": spark.createDataFrame(edge_rows(), EDGE_DOCS),
        "labels": spark.createDataFrame([(i, 1, 0, "z") for i in range(12)] + [(26, 0, 1, "z"), (24, 0, 0, "z"), (None, 1, 1, None), (20, None, None, None)], "doc_id long, quality int, toxic int, text string"),
        "benchmark": spark.createDataFrame([(0, ITEM, "q"), (1, None, None), (None, ITEM, "q"), (2, "", "q")], "item_id long, text string, doc_id string"),
    }
    for k, whole in (("rows", True), ("none", False)):
        for name, table in tables.items():
            (table if whole else table.limit(0)).write.parquet(f"file://{tmp_path}/{k}/{name}.parquet")
    place = f"file://{tmp_path}/rows"
    docs = spark.read.parquet(f"{place}/documents.parquet")
    stages, seen = dict(corpus_pipeline.STAGES), lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    for name in ("quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans"):
        assert stages[name](spark, docs, place).columns == docs.columns
    assert {26, 24, 21, 25} & {d for d, _ in seen(stages["quality_rules"](spark, docs, place))} == set()
    assert [d for d, _ in seen(stages["ngram_jaccard_join"](spark, docs, place))].count(None) == 2
    assert {r.doc_id for r in docs.collect()} - {d for d, _ in seen(stages["benchmark_decontamination"](spark, docs, place))} == {27}
    clean = stages["secret_scans"](spark, docs, place)
    assert seen(clean) == sorted([(r[0], r[1] and r[1].replace("password = hunter2222", "[SECRET]")) for r in edge_rows()], key=str)
    assert {(r.secret_spans, r._key) for r in clean.collect()} == {("x", 1)}
    packed = stages["packing"](spark, docs, place).collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0) and sum(r.start == 0 for r in packed) == len(edge_rows())
    assert {r.doc_id for r in corpus_pipeline.run(spark, place).collect()} >= {None, *range(12)}
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_very_long_conversation(spark):
    """Time follows the turns: 60,000 of them, and a turn of 3 MB."""
    n = 60_000
    rows = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id, ' <é>') as text")
    rows = rows.unionByName(spark.sql("select 2L as conv_id, 0L as turn, 'user' as role, 'q' as text union all select 2L, 1L, 'assistant', repeat('long [é] ', 400000)"))
    began = time.time()
    got = {r.conv_id: r for r in chat_format.report(rows).collect()}
    assert time.time() - began < 60
    for conv, loss in ((1, "".join(f"t{i} <é>" for i in range(1, n, 2))), (2, "long [é] " * 400_000)):
        assert (got[conv].loss_chars, got[conv].loss_sha256, got[conv].valid) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), True)


def test_long_and_repeated_urls(spark):
    """A URL of 200,000 characters, equal URLs and others with the same features; the latter tie."""
    urls = [f"http://s{i}.{'net' if i % 2 else 'org'}/{'x' if i % 2 else 'fr/'}{i}" for i in range(60)]
    urls += ["http://b.com/" + "y?&=#" * 40_000] * 2 + ["http://c.com/ab"] * 3 + ["http://c.com/ba", None, None]
    rows = url_filter.judge_pages(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(urls) and got[60][1:] == got[61][1:] and len({got[i][1:] for i in (62, 63, 64)}) == 1 and got[66][1:] == got[67][1:]
    assert got[62].block_score == got[65].block_score and got[62].verdict == got[65].verdict
    assert all(r.verdict == ("block" if r.block_score >= 0.5 else "allow") for r in rows if r.rule is None) and got[60].host == "b.com" and got[60].path == "/y"
