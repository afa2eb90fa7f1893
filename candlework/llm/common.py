"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from candlework.session import shared_path, stored

__all__ = ["below", "carried", "documents_by_id", "held_out", "labelled", "logistic", "prefiltered", "prefix_sums", "shared_path", "slices", "stored", "table", "text_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(id_column).cast("string")) % parts


def held_out(id_column: str, parts: int, kept_back: int) -> Column:
    """True for rows no label may be learned from; a null id has no labels and is not held out."""
    return F.coalesce(remainder(id_column, parts) == kept_back, F.lit(False))


def labelled(labels: DataFrame, column: str, parts: int = 3, kept_back: int = 1) -> DataFrame:
    """(doc_id, y) of the rows that may be learned from: one row per id, the larger label where an id repeats."""
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id", parts, kept_back))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )


def text_of(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The named columns and the text, null read as empty; all other columns go, so none can clash."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def below(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are less than value, in two steps so that it costs the root of their number."""
    step = max(1, round(len(bounds) ** 0.5))
    whole = F.array(*[F.lit(int(b)) for b in bounds]).cast("array<bigint>")
    coarse = F.array(*[F.lit(int(b)) for b in bounds[step - 1 :: step]]).cast("array<bigint>")
    less = lambda values: F.size(F.filter(values, lambda b: b < value))
    return F.transform(F.array(less(coarse) * step), lambda n: n + less(F.slice(whole, n + 1, F.lit(step))))[0]


def prefiltered(df: DataFrame, ids: DataFrame, column: str, log2_words: int = 18) -> DataFrame:
    """Drops most rows of df whose id is not in ids before the rows are shuffled for the exact join.

    A bitmap of 2^(log2_words + 6) hashed ids, at most 2^log2_words rows of 64 bits, is broadcast. Where ids fill it, it
    no longer saves anything, and is never wrong.
    """
    h = F.pmod(F.xxhash64(column), F.lit(1 << (log2_words + 6)))
    word, bit = F.shiftright(h, 6).alias("bitmap_word"), F.expr("shiftleft(1L, cast(bitmap_bit as int))")
    bits = ids.select(word, h.bitwiseAND(63).alias("bitmap_bit")).groupBy("bitmap_word").agg(F.bit_or(bit).alias("bitmap"))
    marked = df.withColumns({"bitmap_word": F.shiftright(h, 6), "bitmap_bit": h.bitwiseAND(63)})
    return marked.join(F.broadcast(bits), "bitmap_word").where(F.col("bitmap").bitwiseAND(bit) != 0).select(df.columns)


def carried(docs: DataFrame, *columns: str | Column) -> tuple[DataFrame, T.StructType]:
    """The named columns, the text, and all of docs' columns as one struct `row`, with the schema of that struct.

    Carrying the row through an operator that works row by row needs no join back, and is exact for repeated and null ids.
    """
    df = text_of(docs, *columns, F.struct(*docs.columns).alias("row"))
    return df, df.select("row").schema["row"].dataType


def documents_by_id(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Whole texts of a bounded sample (doc_id, ...): the sample, whose size the caller bounds, is broadcast."""
    return text_of(docs, "doc_id").join(F.broadcast(sample), "doc_id")


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22):
    """Runs of rows with about `most` characters: (first row, texts). One long text is a run of its own."""
    texts = batch.column(column).to_pylist()
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text) + 8
    if start < len(texts):
        yield start, texts[start:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, the constant first. Works with one class as well."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def prefix_sums(df: DataFrame, order: list[Column], value: str, by: list[str] | None = None, label: str = "prefix") -> DataFrame:
    """Adds `before`, the sum of `value` over the rows ahead in `order`, within each combination of `by`.

    Built for groups of any size: rows are range-partitioned by (`by`, `order`) and stored with their range number;
    sums run within a range, and the total of earlier ranges, one row per range and group, is joined. `order` must be
    total for a reproducible result.
    """
    by = by or []
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_last() for c in by] + order
    cut = stored(df.repartitionByRange(ranges, *keys).withColumn("range_no", F.spark_partition_id()), label)
    # grouping treats null keys as equal; so must the join
    parts = cut.groupBy("range_no", *by).agg(F.sum(value).alias("part"))
    earlier = Window.partitionBy(*by).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("range_no", *[F.col(c).alias(f"of_{c}") for c in by], F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("range_no", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    match = cut["range_no"] == parts["range_no"]
    for c in by:
        match &= cut[c].eqNullSafe(parts[f"of_{c}"])
    return cut.join(parts, match, "left").select(*[cut[c] for c in cut.columns if c not in ("before", "range_no")], (F.col("before") + F.col("offset")).alias("before"))
