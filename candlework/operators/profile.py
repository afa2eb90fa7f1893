"""Frequencies, null counts, scaling and confusion statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlework.operators import significance
from candlework.schema import CODE_COLUMNS


def code_frequencies(table: DataFrame, columns: Sequence[str] = CODE_COLUMNS) -> DataFrame:
    """How often each code occurs per column. All columns in one scan and one small shuffle."""
    long = table.select(
        F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("code")) for x in columns])).alias("v")
    )
    return long.groupBy(F.col("v.feature").alias("feature"), F.col("v.code").alias("code")).agg(
        F.count("*").alias("n")
    )


def null_counts(table: DataFrame) -> DataFrame:
    """One row: NULLs per column."""
    return table.agg(*[F.count_if(F.col(x).isNull()).alias(x) for x in table.columns])


def drop_incomplete(table: DataFrame) -> DataFrame:
    return table.dropna("any")


def min_max_scaled(table: DataFrame, column: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """(x - min) / (max - min). The bounds are one row per group, joined back.

    Without groups the bounds are one scalar subquery, read once.
    """
    x = F.col(column)
    if not by:
        bounds = table.select(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
        lowest, highest = bounds["lo"], bounds["hi"]
        return table.withColumn(name, F.try_divide(x - lowest, highest - lowest))
    bounds = table.groupBy(*by).agg(F.min(column).alias("_lowest"), F.max(column).alias("_highest"))
    scaled = F.try_divide(x - F.col("_lowest"), F.col("_highest") - F.col("_lowest"))
    return table.join(bounds, list(by)).withColumn(name, scaled).drop("_lowest", "_highest")


def confusion_counts(scored: DataFrame, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Rows per (label, prediction); a row stands for as many as the column ``count`` says."""
    n = F.count("*") if count is None else F.sum(count)
    return scored.groupBy(*by, "label", "prediction").agg(n.alias("n"))


def confusion_matrix(scored: DataFrame, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """One row per prediction, one column per true class."""
    pivoted = scored.groupBy(*by, "prediction").pivot("label", list(classes)).agg(F.count(F.lit(1)))
    return pivoted.select(
        *by, "prediction", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"label_{k}") for k in classes]
    )


def confusion_stats(scored: DataFrame, classes: Sequence[int], by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Accuracy, kappa, and recall and precision per class, from the counts alone; ``count`` as for ``confusion_counts``."""
    n = F.col("n")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0)).cast("double")

    is_label = {k: F.col("label") == k for k in classes}
    is_prediction = {k: F.col("prediction") == k for k in classes}
    all_rows = F.sum(n).cast("double")
    hits = total(F.col("label") == F.col("prediction"))
    chance = sum((total(is_label[k]) * total(is_prediction[k]) for k in classes), F.lit(0.0)) / (all_rows * all_rows)
    accuracy = hits / all_rows
    columns = [
        F.sum(n).alias("rows"),
        accuracy.alias("accuracy"),
        F.try_divide(accuracy - chance, F.lit(1.0) - chance).alias("kappa"),
    ]
    for k in classes:
        both = total(is_label[k] & is_prediction[k])
        columns.append(F.try_divide(both, total(is_label[k])).alias(f"recall_{k}"))
        columns.append(F.try_divide(both, total(is_prediction[k])).alias(f"precision_{k}"))
    counts = confusion_counts(scored, by, count)
    return counts.groupBy(*by).agg(*columns) if by else counts.agg(*columns)


def _count_of(n: Column, condition: Column) -> Column:
    return F.sum(F.when(condition, n).otherwise(0)).cast("double")


def confusion_tests(scored: DataFrame, classes: Sequence[int], by: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """Accuracy with its exact interval, the test against always naming the commonest class, and the test of symmetry.

    ``accuracy_null`` is the share of the commonest label and ``accuracy_p`` the chance of an accuracy as high by that share
    alone. ``symmetry_p`` is McNemar's test, with the correction for two classes; for more, all pairs of classes count, and
    pairs that never occur add no degree of freedom. Rows whose label or prediction is no class or NULL are left out; a
    group without rows has no row, an empty table without groups one row of NULLs.
    """
    n, all_classes = F.col("n"), list(classes)
    known = F.col("label").isin(all_classes) & F.col("prediction").isin(all_classes)
    counts = confusion_counts(scored.filter(known), by)
    cell = lambda i, j: _count_of(n, (F.col("label") == i) & (F.col("prediction") == j))
    columns = [F.sum(n).alias("rows"), _count_of(n, F.col("label") == F.col("prediction")).alias("hits")]
    columns.append(F.greatest(F.lit(0.0), *[_count_of(n, F.col("label") == k) for k in all_classes]).alias("commonest"))
    pairs = [(i, j) for a, i in enumerate(all_classes) for j in all_classes[a + 1 :]]
    columns += [c for i, j in pairs for c in (cell(i, j).alias(f"n_{i}_{j}"), cell(j, i).alias(f"n_{j}_{i}"))]
    table = counts.groupBy(*by).agg(*columns) if by else counts.agg(*columns)

    correction = 1.0 if len(all_classes) == 2 else 0.0
    statistic, degrees = F.lit(0.0), F.lit(0)
    for i, j in pairs:
        one, other = F.col(f"n_{i}_{j}"), F.col(f"n_{j}_{i}")
        apart = F.greatest(F.abs(one - other) - correction, F.lit(0.0))
        statistic = statistic + F.when(one + other > 0, apart * apart / (one + other)).otherwise(0.0)
        degrees = degrees + F.when(one + other > 0, 1).otherwise(0)
    rows, hits = F.col("rows").cast("double"), F.col("hits")
    lower, upper = significance.binomial_interval(hits, rows, confidence)
    return table.select(
        *by,
        "rows",
        F.try_divide(hits, rows).alias("accuracy"),
        lower.alias("accuracy_lower"),
        upper.alias("accuracy_upper"),
        F.try_divide(F.col("commonest"), rows).alias("accuracy_null"),
        significance.at_least(hits, rows, F.try_divide(F.col("commonest"), rows)).alias("accuracy_p"),
        statistic.alias("symmetry"),
        degrees.alias("symmetry_degrees"),
        significance.chi_square_tail(statistic, degrees).alias("symmetry_p"),
    )


def class_stats(scored: DataFrame, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """One row per class: sensitivity, specificity, predictive values, F1, prevalence, detection rate and prevalence, balanced
    accuracy. NULL where nothing is to be divided by; rows that are no class or NULL are left out."""
    known = F.col("label").isin(list(classes)) & F.col("prediction").isin(list(classes))
    n = F.col("n")
    exploded = confusion_counts(scored.filter(known), by).withColumn("class", F.explode(F.array(*[F.lit(k) for k in classes])))
    is_label, is_found = F.col("label") == F.col("class"), F.col("prediction") == F.col("class")
    cells = exploded.groupBy(*by, "class").agg(
        F.sum(n).cast("double").alias("rows"),
        _count_of(n, is_label & is_found).alias("hit"),
        _count_of(n, is_label).alias("of_class"),
        _count_of(n, is_found).alias("found"),
    )
    rows, hit, of_class, found = (F.col(c) for c in ("rows", "hit", "of_class", "found"))
    rejected = rows - of_class - found + hit  # neither label nor prediction
    sensitivity, specificity = F.try_divide(hit, of_class), F.try_divide(rejected, rows - of_class)
    return cells.select(
        *by,
        "class",
        sensitivity.alias("sensitivity"),
        specificity.alias("specificity"),
        F.try_divide(hit, found).alias("positive_value"),
        F.try_divide(rejected, rows - found).alias("negative_value"),
        F.try_divide(2 * hit, of_class + found).alias("f1"),
        F.try_divide(of_class, rows).alias("prevalence"),
        F.try_divide(hit, rows).alias("detection_rate"),
        F.try_divide(found, rows).alias("detection_prevalence"),
        ((sensitivity + specificity) / 2).alias("balanced_accuracy"),
    )
