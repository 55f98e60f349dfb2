"""A deterministic, sharded WARC writer, and the reader.

Records are sorted by id and cut into shards of about equal payload, at bounds that are computed from
the payload lengths, not sampled, so a rerun writes the same files.  A shard is written by one task,
which starts a new file when the current one has reached its compressed size.  Headers, record ids and
digests are made anew from the payload.  Of equal payloads, the one with the largest id is stored and
the others become revisits of it.

A task writes under a name of its own attempt in ``_temporary``.  What it wrote is a row of the pending
manifest, which Spark commits once per task; only then are the listed files renamed, and the final
manifest names them.  Files of lost or repeated attempts are in no manifest, and the reader reads only
what the manifest lists.  Renaming twice does no harm, so every step may be run again.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.llm.columns import map_batches
from siftlog.operators.running import running_total

ROLL_BYTES = 32 << 20  # compressed size at which a file is closed
SHARD_BYTES = 8 << 20  # payload of a shard, at least; more where this would make over MOST_SHARDS
MOST_SHARDS = 100_000  # bounds of shards the driver holds, 8 bytes each
RECORD_BYTES = 512  # counted for headers
DATE = "2000-01-01T00:00:00Z"
NAMES = uuid.UUID("6f1b0b0e-6b0f-5d43-9d1c-0f6f3f1c7a55")  # for ids of records
LEVEL = 6

MANIFEST = "name string, temporary string, records long, bytes long, sha256 string"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}:{digest}')}>"


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    out = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + out.flush()


def info_record(name: str) -> bytes:
    return _member([
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, "info")), ("WARC-Date", DATE),
        ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
    ], b"software: siftlog\r\nformat: WARC File Format 1.1\r\n")


def page_record(page_id, url: str | None, payload: bytes, revisit: bool, refers_to) -> bytes:
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", page_id), ("X-Refers-To-Page-Id", refers_to if revisit else None),
        ("X-Payload-Length", len(payload)),
    ], http if revisit else http + payload)


class _Files:
    """Files of the current shard, one open at a time, under names of this attempt."""

    def __init__(self, folder: str):
        import pyarrow.fs as fs

        self.fs, self.top = fs.FileSystem.from_uri(folder)
        self.attempt = f"_temporary/{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.top}/{self.attempt}", recursive=True)
        self.shard, self.roll, self.out, self.done = None, 0, None, []

    def put(self, shard: int, data: bytes, roll_bytes: int) -> None:
        if shard != self.shard or self.size >= roll_bytes:
            self.close()
            self.roll = 0 if shard != self.shard else self.roll + 1
            self.shard, self.size, self.records, self.hash = shard, 0, 0, hashlib.sha256()
            self.name = f"part-{shard:08d}-{self.roll:05d}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.top}/{self.attempt}/{self.name}", compression=None)
            self._write(info_record(self.name))
        self._write(data)
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.done.append((self.name, f"{self.attempt}/{self.name}", self.records, self.size, self.hash.hexdigest()))

    def rows(self):
        import pyarrow as pa

        done, self.done = self.done, []
        return pa.RecordBatch.from_pylist(
            [dict(zip(("name", "temporary", "records", "bytes", "sha256"), x, strict=True)) for x in done],
            pa.schema([("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()),
                       ("sha256", pa.string())]))


def _writer(folder: str, roll_bytes: int):
    def make(batches):
        files = _Files(folder)
        revisit = response = refers = None
        for batch in batches:
            shards, ids, digests, refs, urls, pages = (batch.column(i) for i in range(6))
            is_page = batch.column(6).to_pylist()
            for i in range(batch.num_rows):
                page_id = ids[i].as_py()
                this = (page_id, digests[i].as_py())
                if not is_page[i]:  # says what the next page refers to
                    revisit, refers = this, refs[i].as_py()
                    continue
                again = this == revisit or this == response
                data = page_record(
                    page_id, urls[i].as_py(), (pages[i].as_py() or "").encode(), again, refers if this == revisit else page_id)
                if not again:
                    response = this
                files.put(shards[i].as_py(), data, roll_bytes)
            yield files.rows()
        files.close()
        yield files.rows()

    return make


def _renamer(folder: str):
    def make(batches):
        import pyarrow.fs as fs

        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{top}/{row['temporary']}", f"{top}/{row['name']}"
                if store.get_file_info(source).type == fs.FileType.File:
                    store.move(source, target)
                elif store.get_file_info(target).size != row["bytes"]:
                    raise OSError(f"{target} is missing or not what was written")
            yield batch

    return make


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write all rows as WARC files below ``folder`` (a new one, which all executors reach); returns the manifest.

    Null html is an empty payload, null url leaves out the target, null ids come first and refer to a known id if
    there is one.  Of rows with equal id and payload one is a response, the others revisit it.  Other columns are ignored.
    """
    spark = pages.sparkSession
    # null ids come first: as they are in the sort
    facts = pages.select(
        pages[page_id].alias("id"), F.sha1(F.coalesce(pages[html], F.lit("")).cast("binary")).alias("sha"),
        F.coalesce(F.octet_length(pages[html]), F.lit(0)).cast("bigint").alias("size"))
    equal = facts.groupBy("sha").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = facts.join(equal, "sha").filter("first is not null and (id is null or id < first)").select(
        "id", "sha", "first").distinct()

    total = facts.agg(F.sum(F.col("size") + RECORD_BYTES)).first()[0] or 0
    width = max(shard_bytes, -(-total // MOST_SHARDS))
    by_id = facts.filter("id is not null").groupBy("id").agg(F.sum(F.col("size") + RECORD_BYTES).alias("bytes")).withColumns(
        {"one": F.lit(1), "block": F.shiftright("id", 12)})
    placed = running_total(by_id, ["one"], "block", ["id"], F.col("bytes"), "upto")
    bounds = placed.groupBy(F.floor((F.col("upto") - F.col("bytes")) / width).alias("shard")).agg(F.min("id").alias("low"))
    lows = sorted(r.low for r in bounds.select("low").collect())  # at most MOST_SHARDS

    def shard(ids):
        import numpy as np

        known = ids.fillna(-(1 << 63)).astype("int64")
        return ids.__class__(np.maximum(np.searchsorted(np.array(lows, np.int64), known, "right") - 1, 0))

    shard_of = F.pandas_udf(shard, "long")
    both = pages.select(
        pages[page_id].alias("id"), F.sha1(F.coalesce(pages[html], F.lit("")).cast("binary")).alias("sha"),
        F.lit(None).cast("long").alias("refers"), pages[url].alias("url"), pages[html].alias("html"), F.lit(True).alias("is_page"),
    ).unionByName(revisits.select(
        "id", "sha", F.col("first").alias("refers"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("html"), F.lit(False).alias("is_page")))
    rows = both.withColumn("shard", shard_of("id")).repartition(max(1, len(lows)), "shard").sortWithinPartitions(
        "shard", F.col("id").asc_nulls_first(), "sha", "is_page").select("shard", "id", "sha", "refers", "url", "html", "is_page")
    pending = f"{folder}/_pending"
    map_batches(rows, _writer(folder, roll_bytes), MANIFEST).write.parquet(pending)
    listed = spark.read.schema(MANIFEST).parquet(pending)
    map_batches(listed, _renamer(folder), MANIFEST).write.parquet(f"{folder}/_manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def records_of(stream, step: int = 1 << 20):
    """(headers, block) of every record of a gzipped WARC stream, one gzip member after another."""
    inflate, held, found = zlib.decompressobj(31), b"", []
    while held or (held := stream.read(step)):
        found.append(inflate.decompress(held))
        held = inflate.unused_data
        if inflate.eof:
            data = b"".join(found)
            head, _, rest = data.partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(headers["Content-Length"])
            if rest[size:] != b"\r\n\r\n":
                raise ValueError("a record's length is wrong")
            yield headers, rest[:size]
            inflate, found = zlib.decompressobj(31), []
    if found:
        raise ValueError("the archive ends inside a record")


READ = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "payload string")


def _reader(folder: str, with_payload: bool):
    def make(batches):
        import pyarrow as pa
        import pyarrow.fs as fs

        store, top = fs.FileSystem.from_uri(folder)
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])

        def number(x):
            return None if x is None else int(x)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for h, block in records_of(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response" and digest32(payload) != digest:
                            raise ValueError(f"{name}: the digest of {h['WARC-Record-ID']} is wrong")
                        rows.append({
                            "page_id": number(h.get("X-Page-Id")), "url": h.get("WARC-Target-URI"),
                            "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": digest, "record_type": h["WARC-Type"],
                            "refers_to": number(h.get("X-Refers-To-Page-Id")),
                            "payload": payload.decode() if with_payload and h["WARC-Type"] == "response" else None})
                        held += len(payload) if with_payload else 100
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return make


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the files that the manifest lists; digests of stored payloads are verified."""
    listed = manifest(spark, folder)
    names = listed.select("name").repartition(max(1, min(listed.count(), 10_000)))  # a task for each file or few
    return map_batches(names, _reader(folder, with_payload), READ)
