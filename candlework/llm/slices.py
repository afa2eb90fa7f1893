"""Tables of texts cut into stored slices, whose tasks ask each other about keys without moving a text.

A slice is a stored row of some megabytes of text that is never divided, so every scan sees the same slices. In one scan
each slice sends its distinct 64-bit keys, sorted, as one compressed block for each bucket of keys; a bucket's task sees
each key once for each slice that has it, however often a slice holds it, and answers with one bit a key. Answers are
stored by shelf, the number of the task that wrote the slice; in the next scan a task reads the shelves of its own slices.
Blocks of keys take a few bytes a key where rows take over twenty, and the texts stay where they are.

Blocks grow with a slice's share of a bucket and buckets with the table, so neither grows with its square as long as a
block holds many keys; beyond that a block costs about as much as a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm.common import shared_path

#: Bytes of text of a slice; a longer text is a slice of its own.
SLICE = 8 << 20
_CODEC = pa.Codec("zstd", 1)
#: Stands for a null id: no id is above it.
NO_ID = np.iinfo(np.int64).max

#: columns of one slice: its number, ids (NO_ID for null) and texts in UTF-8
Slice = tuple[int, np.ndarray, list[bytes]]


def packed(docs: DataFrame, label: str, size: int = SLICE) -> DataFrame:
    """(slice long, ids array<long>, texts array<binary>), stored: the rows of docs (doc_id, text), null texts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.record_batch({"slice": pa.array([number], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "texts": pa.array([texts], pa.list_(pa.binary()))})

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if held and held + len(text) > size:
                    yield row()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                held += len(text) + 8
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    path = shared_path(docs.sparkSession, label)
    rows.mapInArrow(run, "slice long, ids array<long>, texts array<binary>").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, texts = batch.column("ids")[i].values, batch.column("texts")[i].values
            yield batch.column("slice")[i].as_py(), ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), texts.to_pylist()


def block(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte plane after byte plane, compressed: sorted numbers have long runs in their upper bytes."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return _CODEC.compress(planes, asbytes=True)


def opened(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    planes = np.frombuffer(_CODEC.decompress(data, n * sum(sizes), asbytes=True), np.uint8)
    out, at = [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(planes[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted distinct keys by bucket, and where each bucket begins."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


def asked(slices: DataFrame, ask: Callable[[Iterator[Slice]], Iterator[list[np.ndarray]]], kinds: list[type], answer: Callable[[list[np.ndarray]], np.ndarray], buckets: int, label: str) -> str:
    """Where the answers are stored: for every slice, in the order of its keys by bucket, what `answer` gives for each.

    ask: for each slice in turn, its distinct keys (uint64, ascending) and further columns of the given kinds. answer: of
    one bucket's rows of all slices, whether each row gets a 1.
    """

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: list[int] = []

        def noted() -> Iterator[Slice]:
            for own in each(batches):
                numbers.append(own[0])
                yield own

        for columns in ask(noted()):
            order, start = _by_bucket(columns[0], buckets)
            columns = [c[order] for c in columns]
            used = np.flatnonzero(np.diff(start))
            blocks = [block(*[c[start[b] : start[b + 1]] for c in columns]) for b in used]
            if len(used):
                yield pa.record_batch({"bucket": pa.array(used, pa.int32()), "slice": pa.array(np.full(len(used), numbers[-1])), "n": pa.array(np.diff(start)[used], pa.int32()), "keys": pa.array(blocks, pa.binary())})

    def answering(rows: pa.Table) -> pa.Table:
        n = rows["n"].to_pylist()
        parts = [opened(k.as_py(), m, np.uint64, *kinds) for k, m in zip(rows["keys"], n)]
        said = answer([np.concatenate(c) for c in zip(*parts)])
        ends = np.cumsum(n)
        bits = [np.packbits(said[e - m : e]).tobytes() for e, m in zip(ends, n)]
        number = rows["slice"].to_numpy()
        return pa.table({"shelf": pa.array(number >> 32, pa.int64()), "slice": number, "bucket": rows["bucket"], "n": rows["n"], "bits": pa.array(bits, pa.binary())})

    asks = slices.mapInArrow(asking, "bucket int, slice long, n int, keys binary")
    answers = asks.groupBy("bucket").applyInArrow(answering, "shelf long, slice long, bucket int, n int, bits binary")
    path = shared_path(slices.sparkSession, label)
    answers.repartition("shelf").write.partitionBy("shelf").option("compression", "zstd").parquet(path)
    return path


class Answers:
    """Answers as a task reads them, shelf by shelf."""

    def __init__(self, path: str):
        self.fs, self.base = pafs.FileSystem.from_uri(path)
        self.shelf, self.table = -1, None

    def of(self, number: int, keys: np.ndarray, buckets: int) -> np.ndarray:
        """The answer to each key of a slice, keys as they were asked."""
        out = np.zeros(len(keys), bool)
        if not len(keys):
            return out
        if self.shelf != number >> 32:
            self.shelf = number >> 32
            self.table = pq.ParquetDataset(f"{self.base}/shelf={self.shelf}", filesystem=self.fs, partitioning=None).read()
        rows = self.table.filter(pa.compute.equal(self.table["slice"], number)).sort_by("bucket")
        order, start = _by_bucket(keys, buckets)
        if rows["n"].to_numpy().sum() != len(keys):
            raise ValueError(f"slice {number}: {rows['n'].to_numpy().sum()} answers to {len(keys)} keys")
        said = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n) for b, n in zip(rows["bits"], rows["n"].to_pylist())]
        out[order] = np.concatenate(said).astype(bool)
        return out


def buckets_for(slices: DataFrame) -> int:
    """As many that a bucket holds about as many keys as half a slice to a few slices ask for, and two a shuffle partition."""
    return max(2 * int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions")), slices.count() // 2)
