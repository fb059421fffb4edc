"""Deterministic sharded WARC archives: written in range order, committed by manifest, read back.

Records are in the order of (id, hash of url and digest). A shard is a range of that order, cut where the running sum of payload
bytes passes a multiple of the shard size, so shards depend on the rows alone and hold equal bytes whatever the ids
look like. Each shard is a task, which writes record by record, each record a gzip member, and starts a new file once
the compressed size passes the limit. Files are written under temporary names and renamed when whole; the manifest,
itself a table that Spark commits, lists the files that count. A task that runs twice writes the same bytes.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm.common import materialise, parts_for, save, shared_dir, text_of

MANIFEST = "file string, shard long, seq int, n_records long, n_bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
LEVEL = 3


def _record_id(page_id, url, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}|{url}|{digest}|{copy}')}>"


def record(page_id, url, payload: bytes, digest: str, refers: tuple | None, copy: int, date: str) -> bytes:
    """One WARC record; ``refers`` is (page_id, url) of the response that a revisit stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, url, digest, copy)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if url is not None:
        uri = urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))))
        head.append(f"WARC-Target-URI: {uri}")
        if uri != url:  # what no header can hold is escaped there, and stands exactly in a header of its own
            head.append(f"X-Page-URL: {json.dumps(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(*refers, digest, 0)}",
        ]
        if refers[0] is not None:
            head.append(f"X-Refers-To-Page-ID: {refers[0]}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """An archive file under a temporary name until ``commit``."""

    def __init__(self, fs, folder: str, shard: int, seq: int):
        self.fs, self.shard, self.seq = fs, shard, seq
        self.name = f"pages-{shard:08d}-{seq:05d}.warc.gz"
        self.temp, self.final = f"{folder}/.tmp-{uuid.uuid4().hex}-{self.name}", f"{folder}/{self.name}"
        self.out, self.sha, self.size, self.records = fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0

    def add(self, data: bytes) -> None:
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(data) + z.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def commit(self) -> list:
        self.out.close()
        self.fs.move(self.temp, self.final)
        return [self.name, self.shard, self.seq, self.records, self.size, self.sha.hexdigest()]


def _write(folder_uri: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa.fs.FileSystem.from_uri(folder_uri)
        file, done = None, []
        last_key, copy, refers = None, 0, None
        for b in batches:
            names = ("shard", "page_id", "url", "digest", "is_page", "refers", "refers_url", "payload")
            for shard, page_id, url, digest, is_page, to, to_url, payload in zip(*(b.column(n) for n in names), strict=True):
                key = (page_id.as_py(), url.as_py(), digest.as_py())
                if not is_page.as_py():  # the verdict on the rows that follow
                    last_key, copy, refers = key, 0, (to.as_py(), to_url.as_py())
                    continue
                if key != last_key:
                    last_key, copy, refers = key, 0, None
                body, at = payload.as_py() or b"", shard.as_py()
                again = refers or (copy and len(body) >= SMALLEST and key[:2]) or None
                if file and (file.shard != at or file.size >= roll_bytes):
                    done.append(file.commit())
                    file = _File(fs, folder, at, file.seq + 1 if file.shard == at else 0)
                file = file or _File(fs, folder, at, 0)
                file.add(record(key[0], key[1], body, key[2], again, copy, date))
                copy += 1
        if file:
            done.append(file.commit())
        if done:
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("file", "shard", "seq", "n_records", "n_bytes", "sha256"), d)) for d in done],
                pa.schema([("file", pa.string()), ("shard", pa.int64()), ("seq", pa.int32()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]),
            )

    return run


#: Equal payloads below this many bytes are stored again instead of revisited.
SMALLEST = 100


#: Rows of a range whose payload bytes are summed by one task, and shards at most: their first keys go to all tasks.
RANGE_ROWS, MOST_SHARDS = 1_000_000, 1 << 16
#: What a record weighs besides its payload.
HEADERS = 500
KEY = "struct<no_id: boolean, id: bigint, h: bigint>"


def _key() -> Column:
    """The order of records: 17 bytes without nulls. Only rows that repeat are alike in it, but for chance."""
    return F.struct(
        F.col("page_id").isNull().alias("no_id"), F.coalesce("page_id", F.lit(0)).cast("long").alias("id"),
        F.xxhash64(F.col("url").isNull(), "url", "digest").alias("h"),
    )


def _cuts(digests: DataFrame, shard_bytes: int) -> tuple[str, int]:
    """``(cuts, n)``: the sorted first keys of the n shards as JSON; n is at most ``MOST_SHARDS``, so this is small.

    Keys are range-sorted; the bytes before a key are those of the ranges before it and those before it in its range.
    Where Spark draws the ranges makes no difference to these sums.
    """
    rows, total = digests.agg(F.count("*"), F.coalesce(F.sum(F.col("n_bytes") + HEADERS), F.lit(0))).first()
    size = max(shard_bytes, -(-total // MOST_SHARDS))
    weights = digests.groupBy(_key().alias("key")).agg(F.sum(F.col("n_bytes") + HEADERS).alias("w"))
    ranged = weights.repartitionByRange(parts_for(rows, RANGE_ROWS), "key").withColumn("range", F.spark_partition_id())
    ranged = materialise(ranged, "warc-ranges")
    sums = ranged.groupBy("range").agg(F.sum("w").alias("w"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = sums.select("range", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("w").over(inside), F.lit(0))).join(F.broadcast(sums), "range")
    shard = F.floor((F.col("base") + F.col("inside")) / F.lit(size)).cast("long")
    firsts = placed.groupBy(shard.alias("shard")).agg(F.min("key").alias("key"))
    return tuple(firsts.select(F.array_sort(F.collect_list("key")).alias("c")).select(F.to_json("c"), F.size("c")).first())


def _shard_of(key: Column, cuts: str, n: int) -> Column:
    """How many of the sorted ``cuts`` are at or before the key, less one: a binary search in a constant."""
    first = F.from_json(F.lit(cuts), f"array<{KEY}>")

    def halve(span: Column, _: Column) -> Column:
        middle = F.shiftright(span["low"] + span["high"] + 1, 1)
        here = F.get(first, middle) <= key
        return F.struct(F.when(here, middle).otherwise(span["low"]).alias("low"), F.when(here, span["high"]).otherwise(middle - 1).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(max(0, n - 1)).alias("high")), halve)["low"]


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    shard_bytes: int = 64 << 20,
    roll_bytes: int = 32 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row to ``folder`` (a URI that all executors see); returns the committed manifest.

    Ids are integers or null. Of records with equal payloads of at least ``SMALLEST`` bytes that with the smallest id
    is the response (ties: smallest url; of repeated rows one), a null id comes last; the others are revisits. Null
    html is an empty payload, null urls are left out of the header, an empty table writes no file. Rows that repeat
    with id, url and html stay together in a shard. Extra columns are ignored.
    """
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    payload = text_of(html_col).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.sha2(payload, 256).alias("digest"), payload.alias("payload")
    )
    digests = materialise(rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n_bytes")), "warc-digests")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("u"), "url"))
    firsts = digests.where(F.col("n_bytes") >= SMALLEST).groupBy("digest").agg(first.alias("f"), F.count("*").alias("n")).where("n > 1")
    again = digests.join(firsts, "digest").where(
        ~(F.col("page_id").eqNullSafe(F.col("f.page_id")) & F.col("url").eqNullSafe(F.col("f.url")))
    )
    verdicts = again.select(
        "page_id", "url", "digest", F.lit(None).cast("binary").alias("payload"), F.lit(False).alias("is_page"),
        F.col("f.page_id").alias("refers"), F.col("f.url").alias("refers_url"),
    ).distinct()
    none = F.lit(None)
    both = verdicts.unionByName(
        rows.withColumns({"is_page": F.lit(True), "refers": none.cast("long"), "refers_url": none.cast("string")})
    )
    cuts, n = _cuts(digests, shard_bytes)
    placed = both.withColumn("shard", _shard_of(_key(), cuts, n).cast("long"))
    ordered = placed.repartitionById(max(1, n), F.col("shard").cast("int")).sortWithinPartitions("shard", _key(), "url", "digest", "is_page")
    manifest = ordered.select("shard", "page_id", "url", "digest", "is_page", "refers", "refers_url", "payload").mapInArrow(
        _write(folder, roll_bytes, date), MANIFEST
    )
    return save(manifest, f"{folder}/manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            head[name] = value.strip()
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, block


def parse(head: dict[str, str], block: bytes) -> tuple:
    """The fields of a record; digests are computed anew and must agree with the header."""
    if "sha256:" + hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"]:
        raise ValueError(f"block digest differs: {head['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, n = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(http.rpartition(b"Content-Length: ")[2])
    if head["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload differs: {head['WARC-Record-ID']}")
    number = lambda k: int(head[k]) if k in head else None
    url = json.loads(head["X-Page-URL"]) if "X-Page-URL" in head else head.get("WARC-Target-URI")
    return number("X-Page-ID"), url, head["WARC-Type"], n, digest, number("X-Refers-To-Page-ID"), head["WARC-Record-ID"], payload


def _read(folder_uri: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa.fs.FileSystem.from_uri(folder_uri)
        names = [f.split()[0] for f in RECORD.split(", ")] + ["payload"] * with_payload
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for name, expected in zip(b.column("file").to_pylist(), b.column("n_records").to_pylist(), strict=True):
                rows, n, size = [], 0, 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in _records(stream):
                        rows.append(parse(head, block)[: len(names)])
                        n, size = n + 1, size + len(block)
                        if len(rows) >= 5000 or with_payload and size > 16 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if n != expected:
                    raise ValueError(f"{name}: {n} records, the manifest says {expected}")
                if rows:
                    yield batch(rows)

    return run


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False, most_tasks: int = 100_000) -> DataFrame:
    """Every record of the files that the manifest lists; every digest is verified. A file is a task, up to ``most_tasks``."""
    tasks = min(max(1, manifest.count()), most_tasks)
    files = manifest.select("file", "n_records").repartition(tasks)
    return files.mapInArrow(_read(folder, with_payload), RECORD + ", payload binary" * with_payload)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
