"""WARC archives: deterministic sharded writer, and a reader.

Shards are ranges of page_id of about equal size, cut by running totals of payload bytes over all pages in order, so they
depend on the table alone and not on how it is partitioned. A task sorts its shards' records, writes each as a gzip member
with regenerated headers and digests, starts a new file when one has reached its compressed size, and renames a file from
its temporary name only when it is complete. A repeated task writes the same bytes under the same names. The files' names,
sizes and digests form the manifest, stored when all tasks are done; the reader checks the folder against it.

Files are written with pyarrow's file systems, so the folder may be of any kind they know (local or shared mount, S3, GCS,
HDFS with its native library); they are read with Spark's binary file source.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.llm.common import below, prefix_sums, shared_path

#: Payload bytes of a shard, more only where the table would need over MOST_SHARDS; compressed bytes of a file.
SHARD_BYTES, MOST_SHARDS, ROLL_BYTES = 16 << 20, 100_000, 32 << 20
#: Payloads below this size are never revisits.
LEAST_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "file string, bytes long, records long, sha256 string, first_page long, last_page long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}/{digest}'.encode()).digest()[:16], version=5)}>"


def _uri(url: str | None, page_id: int | None) -> str:
    """The url with control characters and spaces escaped; pages without one get a name."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record; a revisit of page `first` if that is given."""
    block = b"" if first is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url, page_id)}"]
    if first is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(first, digest)}", f"X-Refers-To-Page: {first}"]
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    head += [f"X-Page-Id: {'' if page_id is None else page_id}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str, roll_bytes: int):
    """Over rows sorted by (shard, page_id, digest, kind, url); a row of kind 0 names the page its followers revisit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        out = shard = name = stats = None
        number = 0
        revisit: tuple | None = None

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(f"{base}/_{name}.{attempt}", f"{base}/{name}")
            return pa.RecordBatch.from_pylist([{"file": name, "bytes": stats["bytes"], "records": stats["records"], "sha256": stats["sha"].hexdigest(), "first_page": stats["first"], "last_page": stats["last"]}], schema=manifest)

        manifest = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string()), ("first_page", pa.int64()), ("last_page", pa.int64())])
        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "page_id", "digest", "kind", "url", "payload", "first")]
            for i in range(batch.num_rows):
                of, page, digest, kind, url, payload, first = (c[i].as_py() for c in columns)
                if kind == 0:
                    revisit = (page, digest, first)
                    continue
                if out is not None and (of != shard or stats["bytes"] >= roll_bytes):
                    yield close()
                    out = None
                if out is None:
                    number = number + 1 if of == shard else 0
                    shard, name = of, f"part-{of:06d}-{number:05d}.warc.gz"
                    out = fs.open_output_stream(f"{base}/_{name}.{attempt}")
                    stats = {"bytes": 0, "records": 0, "sha": hashlib.sha256(), "first": page, "last": page}
                    info = f"format: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(None, name)}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    opening = _member(head.encode() + info + b"\r\n\r\n")
                    out.write(opening)
                    stats["sha"].update(opening)
                    stats["bytes"] += len(opening)
                data = _member(record(page, url, payload.encode("utf-8", "replace"), digest, revisit[2] if revisit and revisit[:2] == (page, digest) else None))
                out.write(data)
                stats["sha"].update(data)
                stats["bytes"] += len(data)
                stats["records"] += 1
                stats["last"] = page
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) under folder/files and returns the manifest, stored under folder/manifest.

    Of records with equal payloads of at least 100 bytes, those with the smallest page_id are responses, others revisit
    it. Null html is an empty payload; a null page_id never counts as smallest, sorts first, and is a response if no other
    page has its payload; an exactly repeated row is written again, as the row it repeats. An empty table gives no files
    and an empty manifest. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    sized = rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("size"))
    order = prefix_sums(sized, [F.col("page_id").asc_nulls_first(), F.col("digest")], "size", label="warc-order")
    total = order.agg(F.sum("size")).first()[0] or 0
    width = max(shard_bytes, -(-total // MOST_SHARDS))
    starts = order.where("page_id is not null").groupBy(F.floor(F.col("before") / width)).agg(F.min("page_id").alias("start"))
    # at most MOST_SHARDS numbers; a page is in the shard of the last start that is not above its id
    starts = sorted({r.start for r in starts.collect()})[1:]
    shard: Column = below(starts, F.col("page_id") + 1) if starts else F.lit(0)

    big = order.where(F.col("size") >= LEAST_REVISIT)
    firsts = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    revisits = big.select("page_id", "digest").join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()
    marks = revisits.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "first")
    records = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first"))
    ready = records.unionByName(marks).withColumn("shard", F.coalesce(shard, F.lit(0)))
    ready = ready.repartition(len(starts) + 1, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "kind", "url")
    manifest = ready.mapInArrow(_writer(f"{folder}/files", roll_bytes), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            data, at, rows = content.as_buffer(), 0, []
            name = path.as_py().rsplit("/", 1)[-1]
            view = memoryview(data)
            while at < len(view):
                unpack = zlib.decompressobj(31)
                # members are small beside the file; feed it in steps so that the rest is not copied each time
                whole, step, first = [], 1 << 16, at
                while not unpack.eof:
                    whole.append(unpack.decompress(view[at : at + step]))
                    at += step
                at = min(at, len(view)) - len(unpack.unused_data)
                head, _, body = b"".join(whole).partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                if fields["WARC-Type"] == "warcinfo":
                    continue
                block = body[: int(fields["Content-Length"])]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if fields["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
                    raise ValueError(f"{name}: payload at {first} does not have the digest of its header")
                page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page")
                rows.append((int(page) if page else None, int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], int(refers) if refers else None, name, first))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 7, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()])],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"],
            )


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset) of every record in the archives.

    Raises if the folder's files are not exactly those of the manifest, or a payload does not have its digest.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(f"{folder}/files")
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    odd = there.join(manifest, ["file", "bytes"], "full").where(F.col("records").isNull()).count() + manifest.join(there, ["file", "bytes"], "left_anti").count()
    if odd:
        raise ValueError(f"{folder}: {odd} files differ from the manifest")
    return files.select("path", "content").mapInArrow(_parsed, schema)


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share."""
    return shared_path(spark, "warc")
