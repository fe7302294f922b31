"""Deterministic sharded WARC writer and reader.

Records sort by page id and digest. Shards are ranges of both with about SHARD_BYTES of payload, or the MOST_SHARDS-th
part of all if that is more. Their bounds follow from running sums over the sizes of all keys (id, head of the
digest), made by the executors; so they are the same at each run, whatever the ids' spread, and an id that many pages
share is cut by its digests. Only bounds come to the driver. Within a shard, files roll at ROLL_BYTES of compressed size. Headers and digests are made anew. A task writes under temporary names; the rows that it returns, as
a written table, name the files of the attempts that count. A second job renames them, and the manifest,
written last, with Spark's commit marker, makes the archive valid.

Of records with equal payloads of at least `min_bytes` bytes, that of the largest page id is a response (as
are rows that repeat it), and others revisit it. Null html is empty. Null page ids sort first; they respond
only where no equal payload has an id. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearvote.llm.common import new_path, written

SHARD_BYTES = 32_000_000
ROLL_BYTES = 8_000_000
#: Shards of an archive at most, about: a bound on what the driver holds and tasks are sent.
MOST_SHARDS = 50_000
#: Tasks that read an archive at most.
MOST_READERS = 20_000
DATE = "1970-01-01T00:00:00Z"
LEVEL = 4
MANIFEST = "shard int, file string, temporary string, records long, bytes long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


PACKED = "page_id long, url string, payload_bytes long, sha1 string, member binary, shard int"
#: (page id, first 32 bits of the SHA-1): what records sort by, as far as bounds know.
Key = tuple[int, int]


def _digest(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _key(page_id: int | None, head: int) -> Key:
    """Null ids sort first."""
    return (-(1 << 63) - 1 if page_id is None else page_id, head)


def _shard(bounds: list[Key], page_id: int | None, sha1: str) -> int:
    return bisect_right(bounds, _key(page_id, int(sha1[:8], 16)))


def packed(pages: DataFrame, bounds: list[Key]) -> DataFrame:
    """PACKED: each page with its compressed response record, so that html is shuffled small, and its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 512) for at in range(0, b.num_rows, 512)):
                out = []
                for page_id, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    payload = (html or "").encode("utf-8")
                    sha1, member = hashlib.sha1(payload).hexdigest(), _member(record(page_id, url, payload, len(payload), _digest(payload), "response", None))
                    out.append((page_id, url, len(payload), sha1, member, _shard(bounds, page_id, sha1)))
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in PACKED.split(", ")])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, PACKED)


def keys(pages: DataFrame) -> DataFrame:
    """(page_id, sha1, size) of each page's payload, as a table: all that shards and revisits need to know."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return written(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("size")), "warc-keys")


def revisits(known: DataFrame, bounds: list[Key], min_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, keeper, shard): the pages among `known` (keys) that revisit the page `keeper`."""
    large = known.where(F.col("size") >= min_bytes).select("page_id", "sha1")
    # Only payloads that several rows have take part in the join, as a table: so a hot payload's rows can be split.
    groups = written(large.groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("k")).where("k > 1 and keeper is not null").select("sha1", "keeper"), "warc-keepers")
    found = large.join(groups, "sha1").where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select("page_id", "sha1", "keeper").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards = [_shard(bounds, p, h) for p, h in zip(b.column("page_id").to_pylist(), b.column("sha1").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shards, pa.int32())], [*b.schema.names, "shard"])

    return found.mapInArrow(run, "page_id long, sha1 string, keeper long, shard int")


def shard_bounds(known: DataFrame, shard_bytes: int) -> list[Key]:
    """The first keys of all shards but the first. A key in whose bytes, counted over all keys before it, a multiple
    of the shard's size lies begins a shard."""
    head = F.conv(F.substring("sha1", 1, 8), 16, 10).cast("long")
    sizes = known.select("page_id", head.alias("head"), (F.col("size") + 400).alias("size")).groupBy("page_id", "head").agg(F.sum("size").alias("size"))
    ranges = written(sizes.repartitionByRange("page_id", "head").withColumn("part", F.spark_partition_id()), "warc-sizes")
    parts = sorted(map(tuple, ranges.groupBy("part").agg(F.sum("size")).collect()))  # a row for each partition
    begins = [(part, before) for (part, _), before in zip(parts, accumulate((size for _, size in parts), initial=0), strict=False)]
    if not begins:
        return []
    step = max(shard_bytes, -(-sum(size for _, size in parts) // MOST_SHARDS))
    own = Window.partitionBy("part").orderBy(F.col("page_id").asc_nulls_first(), "head").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = known.sparkSession.createDataFrame(begins, "part int, before long")
    ends = ranges.join(F.broadcast(offsets), "part").withColumn("end", F.col("before") + F.sum("size").over(own))
    begins_one = F.floor((F.col("end") - 1) / step) > F.floor((F.col("end") - F.col("size") - 1) / step)
    rows = ends.where(F.col("end") > F.col("size")).where(begins_one).select("page_id", "head").collect()
    return sorted(_key(r.page_id, r.head) for r in rows)


def _header(kind: str, record_id: str, length: int, more: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in more), f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, payload_bytes: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """A record's bytes; a revisit has the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    block = http + payload if kind == "response" else http
    more = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_digest(block)}")]
    if url:
        more.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if kind == "revisit":
        more += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return _header(kind, f"urn:page:{'' if page_id is None else page_id}", len(block), more) + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip member without a time
    return z.compress(data) + z.flush()


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) under `path`, and returns the manifest."""
    spark = pages.sparkSession
    known = keys(pages)
    bounds = shard_bounds(known, shard_bytes)
    # A mark (no member) comes before the records that it makes revisits; so members are shuffled once.
    marks = revisits(known, bounds, min_bytes).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(0).cast("long").alias("payload_bytes"), "sha1", F.lit(None).cast("binary").alias("member"), "keeper", "shard")
    rows = packed(pages, bounds).withColumn("keeper", F.lit(None).cast("long")).unionByName(marks)
    rows = rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "sha1", F.col("member").isNotNull(), "url")
    names = ["page_id", "url", "payload_bytes", "sha1", "member", "keeper"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        attempt = uuid.uuid4().hex
        store.create_dir(f"{root}/temporary", recursive=True)
        out = file = None
        done: list[dict] = []
        mark = (None, None, None)

        def close() -> None:
            nonlocal out, file
            if out is not None:
                out.close()
                done.append({"shard": file["shard"], "file": file["file"], "temporary": file["temporary"], "records": file["records"], "bytes": file["bytes"], "sha256": file["sum"].hexdigest()})
                out = None

        def put(data: bytes) -> None:
            out.write(data)
            file["bytes"] += len(data)
            file["sum"].update(data)

        for batch in batches:
            for shard, page_id, url, payload_bytes, sha1, member, keeper in zip(*(batch.column(c).to_pylist() for c in ("shard", *names)), strict=True):
                if member is None:
                    mark = (page_id, sha1, keeper)
                    continue
                if out is None or file["shard"] != shard or file["bytes"] >= roll_bytes:
                    roll = file["roll"] + 1 if file and file["shard"] == shard else 0
                    close()
                    name = f"part-{shard:06d}-{roll:04d}.warc.gz"
                    file = {"shard": shard, "roll": roll, "file": name, "temporary": f"temporary/{name}.{attempt}", "records": 0, "bytes": 0, "sum": hashlib.sha256()}
                    out = store.open_output_stream(f"{root}/{file['temporary']}", compression=None)
                    info = b"format: WARC File Format 1.1\r\n"
                    put(_member(_header("warcinfo", f"urn:file:{name}", len(info), [("Content-Type", "application/warc-fields"), ("WARC-Filename", name)]) + info + b"\r\n\r\n"))
                if mark[:2] == (page_id, sha1):
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    member = _member(record(page_id, url, b"", payload_bytes, digest, "revisit", mark[2]))
                put(member)
                file["records"] += 1
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.int32()), ("file", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    files = written(rows.select("shard", *names).mapInArrow(write, MANIFEST), "warc-files")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        for b in batches:
            for old, new in zip(b.column("temporary").to_pylist(), b.column("file").to_pylist(), strict=True):
                # A task that is run again finds what it has renamed before.
                if store.get_file_info(f"{root}/{old}").type != pafs.FileType.NotFound:
                    store.move(f"{root}/{old}", f"{root}/{new}")
            yield b

    files.mapInArrow(rename, MANIFEST).drop("temporary").write.mode("overwrite").json(f"{path}/manifest")
    store, root = pafs.FileSystem.from_uri(path)
    if store.get_file_info(f"{root}/temporary").type != pafs.FileType.NotFound:
        store.delete_dir(f"{root}/temporary")
    return spark.read.schema(MANIFEST).json(f"{path}/manifest").drop("temporary")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file of gzip members, read in pieces."""
    z, data, rest = zlib.decompressobj(31), [], stream.read(1 << 20)
    while rest:
        data.append(z.decompress(rest))
        rest = z.unused_data
        if z.eof:
            head, _, body = b"".join(data).partition(b"\r\n\r\n")
            first, *lines = head.decode("utf-8").split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines)
            if first != "WARC/1.1" or len(body) != int(headers["Content-Length"]) + 4:
                raise ValueError(f"not a whole WARC record: {json.dumps(headers)}")
            yield headers, body[:-4]
            z, data = zlib.decompressobj(31), []
        if not rest:
            rest = stream.read(1 << 20)
    if data:
        raise ValueError("the file ends within a record")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """RECORD for each record of an archive with a manifest; digests of blocks and payloads are checked."""
    files = spark.read.schema(MANIFEST).json(f"{path}/manifest").select("file", "records")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        digest = lambda x: "sha1:" + _digest(x)
        number = lambda urn: int(urn[10:-1]) if urn and urn != "<urn:page:>" else None
        for b in batches:
            for name, count in zip(b.column("file").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for h, block in records_of(f):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size, response = int(re.search(rb"Content-Length: (\d+)", head)[1]), h["WARC-Type"] == "response"
                        if h["WARC-Block-Digest"] != digest(block) or response and (h["WARC-Payload-Digest"] != digest(payload) or size != len(payload)):
                            raise ValueError(f"{name}: a digest of {h['WARC-Record-ID']} is wrong")
                        rows.append((number(h["WARC-Record-ID"]), size, h["WARC-Payload-Digest"][5:], h["WARC-Type"], number(h.get("WARC-Refers-To"))))
                if len(rows) != count:
                    raise ValueError(f"{name}: {len(rows)} records, the manifest has {count}")
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in RECORD.split(", ")])

    # A task for each few files: their rows are tiny, so a plan by size would read them all in one task.
    return files.repartition(max(1, min(files.count(), MOST_READERS)), "file").mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """RECORD of all pages, read back from an archive written to the shared folder."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_bytes)
    return read_archive(pages.sparkSession, path)
