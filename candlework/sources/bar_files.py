"""Bar files: one headerless CSV per symbol, named after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.operators.features import dedupe_bars
from candlework.schema import ANALYSIS_NAMES, BAR_COLUMNS, BASE_COLUMNS, BASE_SCHEMA, LABELLED_SIGNALS_SCHEMA

FILE_TIME = "dd/MM/yyyy HH:mm"  # fixed value: the time format of the files


def _number(x: Column) -> Column:
    return F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))


def parse_bar_lines(lines: DataFrame) -> DataFrame:
    """Bars from (stockName, value). Lines without exactly seven fields, header lines and
    lines that do not parse are dropped. Trailing empty fields do not count as fields."""
    names = ["priceOpen", "high", "low", "lastPrice", "number", "volume"]
    # one row in, one row out: filters on what a generator gives are not moved into it, so each line is cut and parsed once
    fields = F.split(F.regexp_replace("value", ",+$", ""), ",")
    cut = lines.select("stockName", F.inline(F.array(F.struct(fields.alias("f")))))
    whole = cut.filter((F.size("f") == 7) & ~F.element_at("f", 1).contains("NAME"))
    time = F.try_to_timestamp(F.element_at("f", 1), F.lit(FILE_TIME)).alias("stockTime")
    numbers = [_number(F.element_at("f", i + 2)).alias(n) for i, n in enumerate(names)]
    return whole.select("stockName", F.inline(F.array(F.struct(time, *numbers)))).dropna("any").select(*BAR_COLUMNS)


def read_bar_files(spark: SparkSession, folder: str, unique: bool = False) -> DataFrame:
    """All files of a folder in one distributed scan; the symbol is the file name less its
    last four characters. Of bars with equal symbol and time one is kept (``dedupe_bars``),
    unless the files are said to hold ``unique`` bars."""
    # the metadata column gives the name URL-encoded, except for a plus sign
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(folder).select(F.regexp_extract(name, "^(.*).{4}$", 1).alias("stockName"), "value")
    bars = parse_bar_lines(lines)
    return bars if unique else dedupe_bars(bars)


def save_bars(bars: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Save bars as a table bucketed by symbol, so that later feature jobs need no shuffle.

    Meant for bars without hot symbols (see ``operators.history.measure``): a bucket holds
    whole symbols. Rows are shuffled to the buckets once, which gives one file per bucket.
    """
    writer = bars.repartition(buckets, "stockName").write.mode("overwrite").bucketBy(buckets, "stockName")
    writer = writer.sortBy("stockName", "stockTime")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def write_base_csv(table: DataFrame, path: str, single_file: bool = False) -> None:
    """Comma-separated with header, overwriting. One file only on request: it is one task."""
    out = table.coalesce(1) if single_file else table
    out.write.mode("overwrite").option("header", True).csv(path)


def read_base_csv(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """The base table back from CSV with a fixed schema, optionally renamed."""
    table = spark.read.option("header", True).schema(BASE_SCHEMA).csv(path)
    return table.toDF(*(names or BASE_COLUMNS))


def rename_for_analysis(table: DataFrame) -> DataFrame:
    """The base table under the names the analysis uses."""
    return table.withColumnsRenamed(ANALYSIS_NAMES)


def read_labelled_signals(spark: SparkSession, path: str) -> DataFrame:
    """Thirteen positional columns: time, name, two prices, eight signals, label."""
    return spark.read.schema(LABELLED_SIGNALS_SCHEMA).csv(path)


def write_sweep(results: DataFrame, path: str) -> None:
    """Sweep results, one folder per deployment period."""
    results.write.mode("overwrite").partitionBy("deployment").parquet(path)


def sort_all(table: DataFrame) -> DataFrame:
    """Sorted by every column in column order: a range-partitioned distributed sort."""
    return table.orderBy(*table.columns)
