"""N-gram Jaccard join by PartEnum signatures (see partenum), exact: every pair of different texts with a
similarity of at least 3/4 is linked, and components are the documents reachable by links.

Steps, each over all documents:
1. One pass over the texts makes a class (equal shingle sets) of each document and the signatures of the
   class. Signatures travel packed, one block for each batch and part of the signature space, with at most
   HOT entries for each batch and signature; members beyond that go their own way, evenly spread.
2. Signatures of two classes give a pair; those of more give a group of members, once for all signatures of a
   part that have the same members.
3. Each group compares its members to three leaders, chosen by hash: as many pairs as members. Pairs that the
   sizes or the parity sketches rule out are dropped (exact); the others are verified on the full sets.
   Components follow by label propagation.
4. Groups whose members are still of several components are united where they overlap; very large ones are
   signed anew without the shingles that their members have in common. Then all members that are not of their
   group's main component are held against the group's sizes and sketches, in blocks of bounded size. Each gives
   its nearest few, which are verified; rounds with more follow until no pair of different components is left
   untried. So what leaves a block follows its rows, while links still unite most components early.

Null or wordless texts have no shingle, no links and form a component each; null ids get a null component
and no links. Repeated ids are rows of their own. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.llm import partenum as P
from nearvote.llm.common import SAMPLE_ROWS, text_blocks, written

#: The most stop shingles kept; any set of them gives the same result.
STOP_SHINGLES = 200_000
STOP_DF = 3
LEADERS = 3
#: From more classes of one batch that share a signature on, they no longer go where other entries of it go.
HOT = 64
#: Rows of one block in step 4; pairs that are compared at once.
BLOCK = 2048
STEP = 1 << 18
#: Pairs that each row of a block gives in the first round; every round gives MORE times as many.
MOST, MORE = 16, 16
#: Rounds in which overlapping groups are united; pairs whose comparison costs as much as one row of a group.
UNIONS, ROW_PAIRS = 2, 256
#: Groups of more pairs than WIDE blocks hold are refined, LEVELS times at the most, by what about SAMPLE members share.
WIDE, LEVELS, SAMPLE = 16, 2, 64
#: Bytes of text whose signatures one task of step 2 takes.
PART_BYTES = 24_000_000
#: Bits of the filter that picks candidate documents in a pass over the texts.
FILTER_BITS = 1 << 22


def _stop_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that at least STOP_DF documents of a bounded sample hold."""
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            got = [P.shingles(t).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got) if got else np.empty(0, np.int64), pa.int64())], ["h"])

    rows = (
        docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .select("text").mapInArrow(sets, "h long")
        .groupBy("h").count().where(F.col("count") >= STOP_DF)
        .orderBy(F.desc("count"), "h").limit(STOP_SHINGLES).select("h").toArrow()
    )
    return np.sort(np.asarray(rows.column("h").to_numpy(), dtype=np.int64).view(P.U))


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, ...: the upper bytes of sorted numbers compress well."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(P.U).ravel()


def _docs_row(rows: list[tuple], classes: dict[int, tuple]) -> pa.RecordBatch:
    """Documents (doc_id, fp, n), and for each class the sketches; packed as an Arrow file for the way."""
    empty = (np.zeros(8, P.U), None)
    words = np.concatenate([classes.get(r[1], empty)[0] for r in rows]).view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * 8), pa.array(words))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))] + [lists, pa.array([classes.get(r[1], empty)[1] for r in rows], pa.binary())], ["doc_id", "fp", "n", "sketch", "bits"])


def _mapper(stop: np.ndarray, parts: int):
    """Rows (p, kind, a, b, c). Kind 0: entries of a part of the signatures: the sorted signatures, the numbers
    of their classes with two marks, and the classes. Kind 1: members of signatures that many classes of the
    batch share (HOT); kind 0 has only one of them, with a mark. Kind 2: documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in text_blocks(batches):
            classes, rows, keep, sigs, flags = {}, [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = P.shingles(text)
                fp = P.fingerprint(s) if len(s) else 0
                rows.append((doc_id, fp, len(s)))
                if len(s) and doc_id is not None and fp not in classes:
                    classes[fp] = P.sketch(s), P.long_sketch(s)
                    keep.append(fp)
                    sig, flag = P.signatures(s, stop)
                    sigs.append(sig)
                    flags.append(flag)
            turn += 1
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, (own := _docs_row(rows, classes)).schema) as w:
                w.write_batch(own)
            out = [(turn % parts, 2, sink.getvalue().to_pybytes(), b"", b"")]
            if sigs:
                fps = np.array(keep, np.int64)
                sig, flag = np.concatenate(sigs), np.concatenate(flags)
                own = np.repeat(np.arange(len(fps), dtype=np.int64), [len(x) for x in sigs])
                part = ((sig >> P.U(20)) % P.U(parts)).astype(np.int64)
                order = np.lexsort((~flag, sig, part))
                sig, flag, own, part = sig[order], flag[order], own[order], part[order]
                first = np.concatenate(([True], sig[1:] != sig[:-1]))
                starts = np.flatnonzero(first)
                count = np.diff(np.concatenate((starts, [len(sig)])))
                hot = np.repeat(count > HOT, count)
                if hot.any():
                    out.append((turn % parts, 1, sig[hot].tobytes(), fps[own[hot]].tobytes(), flag[hot].tobytes()))
                sent = first | ~hot
                sig, part, mark = sig[sent], part[sent], (own * 4 + flag * 2 + hot)[sent]
                cuts = np.searchsorted(part, np.arange(parts + 1))
                for p in range(parts):
                    at = slice(cuts[p], cuts[p + 1])
                    if at.start < at.stop:
                        used, number = np.unique(mark[at] >> 2, return_inverse=True)
                        code = number * 4 + (mark[at] & 3)
                        out.append((p, 0, _planes(sig[at]), code.astype("<u2" if len(used) < 1 << 14 else "<u4").tobytes(), fps[used].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["p", "kind", "a", "b", "c"])

    return run


SIGNED = "kind string, sig long, fp long, flag boolean, doc_id long, n int, sketch array<long>, bits binary"


def _reducer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SIGNED. Kind pair: classes sig and fp share a signature that no third class has. Kind member: fp is a
    member of the group sig, a signature, or all signatures here that have just the same members. Kind
    document: doc_id, its class and the class's sketches."""
    names = [x.split()[0] for x in SIGNED.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]

    def tell(kind: str, sig: np.ndarray, fp: np.ndarray, flag: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(sig), 50_000):
            x, y, z = sig[at : at + 50_000], fp[at : at + 50_000], flag[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(x)), pa.array(x.view(np.int64)), pa.array(y), pa.array(z), *(pa.nulls(len(x), t) for t in types[4:])], names)

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for kind, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("kind", "a", "b", "c")), strict=True):
            if kind == 2:
                for x in pa.ipc.open_stream(a):
                    yield pa.RecordBatch.from_arrays([pa.array(["document"] * len(x)), pa.nulls(len(x), types[1]), x.column("fp"), pa.nulls(len(x), types[3]), *(x.column(n) for n in names[4:])], names)
            elif kind == 1:
                yield from tell("member", np.frombuffer(a, P.U), np.frombuffer(b, np.int64), np.frombuffer(c, bool))
            else:
                sig, fps = _from_planes(a), np.frombuffer(c, np.int64)
                code = np.frombuffer(b, "<u2" if len(fps) < 1 << 14 else "<u4").astype(np.int64)
                held.append((sig, fps[code >> 2], (code & 3).astype(np.uint8)))
    if not held:
        return
    sig, fp, mark = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.argsort(sig, kind="stable")
    again = sig[order[1:]] == sig[order[:-1]]
    live = np.concatenate((again, [False])) | np.concatenate(([False], again))
    order = order[live]
    sig, fp, mark = sig[order], fp[order], mark[order]
    order = np.lexsort((fp, sig))
    sig, fp, mark = sig[order], fp[order], mark[order]
    new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])))[: len(sig)]
    # One entry for each signature and class; it is hot if any of them is.
    at = np.flatnonzero(new)
    if not len(at):
        return
    mark = np.bitwise_or.reduceat(mark, at)
    sig, fp = sig[at], fp[at]
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    marks = np.bitwise_or.reduceat(mark, starts)
    count = np.diff(np.concatenate((starts, [len(sig)])))
    flag = (mark & 2) > 0
    hot = np.repeat((marks & 1) > 0, count)
    yield from tell("member", sig[hot], fp[hot], flag[hot])
    useful = ((marks & 1) == 0) & ((marks & 2) > 0)
    two = starts[useful & (count == 2)]
    pairs = np.unique(np.stack([fp[two], fp[two + 1]], axis=1), axis=0)
    yield from tell("pair", pairs[:, 0].view(P.U), pairs[:, 1], np.ones(len(pairs), bool))
    # Groups with the same members and flags are one.
    name = P.mix(np.add.reduceat(P.mix(P.mix(fp.view(P.U)) + flag), starts) + count.astype(P.U))
    _, one = np.unique(name, return_index=True)
    several = np.zeros(len(starts), bool)
    several[one] = True
    several &= useful & (count > 2)
    chosen = np.repeat(several, count)
    yield from tell("member", np.repeat(name, count)[chosen], fp[chosen], flag[chosen])


SKETCH_APART = " + ".join(f"bit_count(sketch_a[{i}] ^ sketch_b[{i}])" for i in range(8))
#: True for all pairs of a similarity of 3/4 or more.
MAY_LINK = f"7 * ({SKETCH_APART}) <= n_a + n_b and 4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)"


def _may_link(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out."""
    for side in "ab":
        pairs = pairs.join(classes.select(*(F.col(c).alias(f"{c}_{side}") for c in ("fp", "n", "sketch"))).withColumnRenamed(f"fp_{side}", side), side)
    return _long_apart(pairs.where(MAY_LINK).select("a", "b", "n_a", "n_b"), classes).select("a", "b")


def _long_apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Without the pairs (a, b, n_a, n_b) of large sets that their long sketches rule out."""
    pairs, long = written(pairs, "near"), classes.where("bits is not null")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
            ok = 7 * P.apart(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist()) <= sizes
            yield b.select(["a", "b"]).filter(pa.array(ok))

    large = pairs.where(f"n_a > {P.LONG} and n_b > {P.LONG}")
    for side in "ab":
        large = large.join(long.select(F.col("fp").alias(side), F.col("bits").alias(f"bits_{side}")), side)
    large = large.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(near, "a long, b long")
    return large.union(pairs.where(f"n_a <= {P.LONG} or n_b <= {P.LONG}").select("a", "b"))


def _sets(docs: DataFrame, reps: DataFrame, fps: DataFrame) -> DataFrame:
    """(fp, features) of the classes `fps`, each from one document.

    One pass over the texts picks these documents through a filter of FILTER_BITS bits, a table of at most
    FILTER_BITS / 32 rows whatever the input; false picks leave by the join.
    """
    wanted = written(fps.join(reps, "fp").select("fp", F.col("rep").alias("id")), "wanted")
    word = lambda c: F.shiftright(F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)), 5)
    bit = lambda c: f"shiftleft(1L, cast(pmod(xxhash64({c}), {FILTER_BITS}) & 31 as int))"
    known = written(wanted.select(word("id").alias("_w"), F.expr(bit("id")).alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_b")), "filter")
    picked = docs.where("doc_id is not null").withColumn("_w", word("doc_id")).join(F.broadcast(known), "_w").where(F.expr(f"_b & {bit('doc_id')} <> 0"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            got = [P.shingles(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([P.fingerprint(s) if len(s) else 0 for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], ["id", "fp", "features"])

    found = picked.select("doc_id", "text").mapInArrow(sets, "id long, fp long, features binary")
    # A repeated id can have other texts, and rows can repeat: one row of each class.
    return written(found.join(wanted, ["id", "fp"]).groupBy("fp").agg(F.first("features").alias("features")), "sets")


def _linked(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are links, found on the full sets of one document of each class."""
    sets = _sets(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [P.similar(np.frombuffer(x, P.U), np.frombuffer(y, P.U)) for x, y in zip(b.column("fa").to_pylist(), b.column("fb").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs
    for side in "ab":
        both = both.join(sets.select(F.col("fp").alias(side), F.col("features").alias(f"f{side}")), side)
    return written(both.select("a", "b", "fa", "fb").mapInArrow(verify, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of all ids in links (a, b): label is the smallest id reachable. Labels spread to
    neighbours and jump to their label's label until none changes; each round is a written table."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("j"), F.col("label").alias("far"))
        new = written(step.join(jump, step.label == jump.j, "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")


def _placed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members with their components, of those groups alone that hold several and have something to compare; and by
    group its first member `head` (by hash) and the number g of its members."""
    placed = written(members.join(comps, members.fp == comps.id, "left").select(*members.columns, F.coalesce("label", "fp").alias("comp")), "placed")
    groups = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("flag").alias("any"), *_head(0)).where("any and lo <> hi")
    return placed.join(written(groups.select("sig", "head", "g"), "mixed"), "sig")


def _head(seed: int) -> tuple:
    return F.min_by("fp", F.xxhash64("fp", F.lit(seed))).alias("head"), F.count("*").alias("g")


def _merged(placed: DataFrame) -> DataFrame:
    """Members (sig, fp, flag, comp) by fewer groups: near copies, or documents with one passage, share many of
    their signatures, so their groups overlap. Groups with one head become one group where that costs no more, in
    pairs and in rows, than they do; and once more, with heads by another hash."""
    keys = [c for c in ("sig", "parent", "fp") if c in placed.columns]
    for seed in range(UNIONS):
        if seed:
            placed = placed.join(written(placed.groupBy("sig").agg(*_head(seed)), "heads"), "sig")
        rows = written(placed, "headed")
        cost = rows.groupBy("head", "fp").agg(F.sum(F.col("g") + ROW_PAIRS).alias("apart")).groupBy("head").agg(F.sum("apart").alias("apart"), F.count("*").alias("n"))
        one = written(cost.where(f"double(n) * (n + {ROW_PAIRS}) <= apart").select(F.col("head").alias("one")), "united")
        rows = rows.join(one, F.col("head") == F.col("one"), "left").withColumn("sig", F.when(F.col("one").isNull(), F.col("sig")).otherwise(F.xxhash64("head", F.lit(seed + 1))))
        placed = written(rows.groupBy(*keys).agg(F.max("flag").alias("flag"), F.first("comp").alias("comp")), "merged")
    return placed


def _sizes(merged: DataFrame) -> DataFrame:
    """By group: its most frequent component `main`, the number g of its members, and how many, s, are of others.
    A pair of different components has at least one of these s."""
    keys = [c for c in ("sig", "parent") if c in merged.columns]
    by = merged.groupBy(*keys, "comp").agg(F.count("*").alias("c"), F.max("flag").alias("flag"))
    own = by.groupBy(*keys).agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("g"), F.max("c").alias("c"), F.max("flag").alias("flag"))
    return written(own.where("flag and g > c").select(*keys, "main", "g", (F.col("g") - F.col("c")).alias("s")), "sizes")


def _refined(large: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Members (sig, parent, fp, flag) of finer groups of the large groups `large` (sig, fp, g): signatures anew,
    without what members have in common.

    What at least 3 of about SAMPLE members of a group hold is left out of all its sets (any such choice is
    exact, see partenum), so members that share a passage and no more meet no longer. Signatures of one set go.
    """
    sets = _sets(docs, reps, large.select("fp").distinct())
    full = written(large.join(sets, "fp").select("sig", "fp", "g", "features"), "full")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sig, features in zip(b.column("sig").to_pylist(), b.column("features").to_pylist(), strict=True):
                h = np.frombuffer(features, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), sig, np.int64)), pa.array(h)], ["sig", "h"])

    some = full.where(F.pmod(F.xxhash64("fp", "sig"), F.col("g")) < SAMPLE).select("sig", "features").mapInArrow(spread, "sig long, h long")
    common = some.groupBy("sig", "h").count().where("count >= 3").groupBy("sig").agg(F.sort_array(F.collect_list("h")).alias("common"))
    common = written(common, "common")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sig, fp, features, stop in zip(*(b.column(c).to_pylist() for c in ("sig", "fp", "features", "common")), strict=True):
                s = np.frombuffer(features, P.U)
                own = P.group_signatures(s, np.sort(np.array(stop or [], np.int64).view(P.U)), sig)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), sig)), pa.array(np.full(len(own), fp))], ["sig", "parent", "fp"])

    finer = written(full.join(common, "sig", "left").select("sig", "fp", "features", "common").mapInArrow(sign, "sig long, parent long, fp long"), "finer")
    several = written(finer.groupBy("sig").count().where("count > 1").select("sig"), "several")
    return finer.join(several, "sig").select("sig", "parent", "fp", F.lit(True).alias("flag")).distinct()


def _to_compare(members: DataFrame, comps: DataFrame, docs: DataFrame, reps: DataFrame, large: int) -> DataFrame:
    """(sig, fp, flag): groups that together hold all pairs of different components in the groups of `members`.
    Groups of over `large` such pairs are replaced by finer ones where these have fewer pairs in all."""
    merged = _merged(_placed(members, comps))
    done = []
    for _ in range(LEVELS):
        sizes = _sizes(merged)
        wide = written(sizes.where(F.expr("double(s) * g") > large).select("sig", "g", "s"), "wide")
        if wide.isEmpty():
            break
        finer = _merged(_placed(_refined(merged.join(wide, "sig").select("sig", "fp", "g"), docs, reps), comps))
        work = _sizes(finer).groupBy("parent").agg(F.sum(F.expr("double(s) * g")).alias("work"))
        # Groups without a finer group have nothing left to compare.
        kept = written(wide.join(work, wide.sig == work.parent, "left").where("work >= double(s) * g").select("sig"), "kept")
        done += [merged.join(wide, "sig", "left_anti"), merged.join(kept, "sig", "left_semi")]
        merged = written(finer.join(kept.withColumnRenamed("sig", "parent"), "parent", "left_anti").select("sig", "fp", "flag", "comp"), "finer")
    for x in done:
        merged = merged.unionByName(x.select(*merged.columns))
    return written(merged.select("sig", "fp", "flag"), "compare")


def _cross_pairs(members: DataFrame, comps: DataFrame, classes: DataFrame, ask: DataFrame | None, block: int, most: int) -> DataFrame:
    """Pairs (a, b) of different components in the groups of `members` that may link: for each member that is not of
    its group's main component, or, if given, for those in `ask`, the `most` nearest by the sketches in each block. A
    row (a, null) tells that the member a has more. (Another component can be the main one by then; so `ask` decides.)

    The s members and all g members of a group are dealt into blocks of about `block` rows; a task holds two.
    """
    placed = written(_placed(members, comps).select("sig", "fp", "flag", "comp"), "mixed-members")
    rows = placed.join(_sizes(placed), "sig")
    if ask is None:
        asked = rows.where("comp <> main")
    else:
        asked = rows.join(ask, "fp", "left_semi")
        rows = rows.join(written(asked.select("sig").distinct(), "asked"), "sig", "left_semi")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    place = lambda n, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    cols = ["sig", "i", "j", "query", "known", "fp", "flag", "comp"]
    # Where there is one block, a row in both parts goes once.
    once = asked.where(blocks("g") == 1).select("sig", "fp", F.lit(True).alias("once"))
    asked = asked.withColumn("query", F.lit(True)).withColumn("known", blocks("g") == 1).withColumn("i", place("s", 1)).withColumn("j", every("g")).select(cols)
    known = rows.join(once, ["sig", "fp"], "left_anti") if ask is not None else rows.where((blocks("g") > 1) | F.expr("comp = main"))
    known = known.withColumn("query", F.lit(False)).withColumn("known", F.lit(True)).withColumn("j", place("g", 2)).withColumn("i", every("s")).select(cols)
    sketches = classes.select("fp", "n", F.when(F.col("bits").isNull(), F.col("sketch")).alias("sketch"), "bits")
    dealt = asked.union(known).join(sketches, "fp").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "n", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            keys = [table.column(c).to_numpy() for c in ("sig", "i", "j")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            rest = table.slice(int(new[-1]) if len(new) else 0)
            if len(new):
                yield _near(table.slice(0, int(new[-1])).combine_chunks(), most)
        if rest is not None and rest.num_rows:
            yield _near(rest.combine_chunks(), most)

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _near(t: pa.Table, most: int) -> pa.RecordBatch:
    """Whole blocks, sorted by (sig, i, j, n): the pairs of `_cross_pairs`. Each row that asks is compared to the
    known rows of its block whose size allows a link, STEP pairs at a time."""
    fp, comp, n = (t.column(c).to_numpy() for c in ("fp", "comp", "n"))
    n = n.astype(np.int64)
    flag, query, known = (t.column(c).to_numpy(zero_copy_only=False) for c in ("flag", "query", "known"))
    keys = [t.column(c).to_numpy() for c in ("sig", "i", "j")]
    number = np.cumsum(np.concatenate(([0], np.any([k[1:] != k[:-1] for k in keys], axis=0)))).astype(np.int64) << 40
    bits = t.column("bits").to_pylist()
    sk = P.folded([np.array(s, np.int64).tobytes() if b is None else b for s, b in zip(t.column("sketch").to_pylist(), bits, strict=True)])
    known, asked = np.flatnonzero(known), np.flatnonzero(query)
    place = number[known] + n[known]
    lo = np.searchsorted(place, number[asked] + (3 * n[asked] + 3) // 4, "left")
    hi = np.searchsorted(place, number[asked] + 4 * n[asked] // 3, "right")
    total = np.concatenate(([0], np.cumsum(hi - lo)))
    found, more, begin = [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)], 0
    while begin < len(asked):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + STEP, "right")) - 1)
        count = (hi - lo)[begin:end]
        x = np.repeat(asked[begin:end], count)
        y = known[np.repeat(lo[begin:end] - (total[begin:end] - total[begin]), count) + np.arange(count.sum())]
        begin = end
        ok = (comp[x] != comp[y]) & (flag[x] | flag[y])
        x, y = x[ok], y[ok]
        far = np.bitwise_count(sk[x] ^ sk[y]).sum(axis=1, dtype=np.int64)
        ok = 7 * far <= n[x] + n[y]
        x, y, far = x[ok], y[ok], far[ok]
        if len(long := np.flatnonzero((n[x] > P.LONG) & (n[y] > P.LONG))):
            far[long] = P.apart([bits[r] for r in x[long]], [bits[r] for r in y[long]])
            ok = 7 * far <= n[x] + n[y]
            x, y, far = x[ok], y[ok], far[ok]
        order = np.lexsort((fp[y], far / (n[x] + n[y]), x))
        x, y = x[order], y[order]
        rank = np.arange(len(x)) - np.searchsorted(x, x, "left")
        more.append(np.unique(fp[x[rank >= most]]))
        a, b = fp[x[rank < most]], fp[y[rank < most]]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    more = np.unique(np.concatenate(more))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((pairs[:, 0], more))), pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(more), pa.int64())])], ["a", "b"])


def ngram_components(documents: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of documents (doc_id, text)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(32, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    stop = _stop_shingles(docs)
    packed = docs.mapInArrow(_mapper(stop, parts), "p int, kind int, a binary, b binary, c binary").repartitionById(parts, F.col("p"))
    first = written(packed.mapInArrow(_reducer, SIGNED), "signed")
    rows = first.where("kind = 'document'").select("doc_id", "fp", "n", "sketch", "bits")
    real = rows.where("n > 0 and doc_id is not null")
    classes = written(real.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits")), "classes")
    members = written(first.where("kind = 'member'").groupBy("sig", "fp").agg(F.max("flag").alias("flag")), "members")

    def leader(i: int):
        x = F.min(F.struct(~F.col("flag"), F.xxhash64("fp", F.lit(i)), "fp"))
        return F.when(~x["col1"], x["fp"]).alias(f"l{i}")

    # Aggregates are written before they are joined to what they came from: a join that reuses an aggregate's
    # partitions can't split those of a hot key.
    leaders = written(members.groupBy("sig").agg(*(leader(i) for i in range(LEADERS))), "leaders")
    stars = members.join(leaders, "sig").select("fp", F.explode(F.array_distinct(F.array(*(f"l{i}" for i in range(LEADERS))))).alias("l")).where("l <> fp")
    twos = first.where("kind = 'pair'").select("fp", F.col("sig").alias("l"))
    stars = stars.union(twos).select(F.least("fp", "l").alias("a"), F.greatest("fp", "l").alias("b")).distinct()
    reps = classes.select("fp", "rep")
    tried = written(_may_link(stars, classes), "stars")
    links = _linked(docs, reps, tried)
    comps = components(links)
    members = _to_compare(members, comps, docs, reps, block * block * WIDE)
    ask = None
    while ask is None or not ask.isEmpty():
        found = written(_cross_pairs(members, comps, classes.select("fp", "n", "sketch", "bits"), ask, block, most), "found")
        ask, most = found.where("b is null").select(F.col("a").alias("fp")), most * MORE
        cross = written(found.where("b is not null").join(tried, ["a", "b"], "left_anti"), "cross")
        if not cross.isEmpty():
            tried, new = tried.union(cross), _linked(docs, reps, cross)
            if not new.isEmpty():
                links = links.union(new)
                comps = components(links)
    merged = classes.join(comps, classes.fp == comps.id, "left").select("fp", "rep", F.coalesce("label", "fp").alias("comp"))
    least = written(merged.groupBy("comp").agg(F.min("rep").alias("component_id")), "least")
    merged = merged.join(least, "comp").select(F.col("fp").alias("cfp"), "component_id")
    key = F.when(F.col("n") > 0, F.col("fp"))
    return rows.join(merged, key == merged.cfp, "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
