"""Tail probabilities against sums of their terms and tabled values; confusion tests on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from candlework.operators import profile, significance


def _at_least(k, n, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))


def test_log_gamma(spark):
    values = [0.5, 1.0, 2.5, 10.0, 123.4, 1e6, 1e7, 3e9]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", significance.log_gamma(F.col("x")).alias("y"))
    for r in got.collect():
        assert r.y == pytest.approx(math.lgamma(r.x), rel=1e-13, abs=1e-12)


def test_binomial_tail(spark):
    cases = [(1, 1, 0.3), (5, 10, 0.5), (0, 7, 0.2), (7, 7, 0.9), (900, 3000, 0.31), (50_300, 100_000, 0.5), (10, 100_000, 0.0001)]
    table = spark.createDataFrame([(float(k), float(n), p) for k, n, p in cases], "k double, n double, p double")
    got = table.select(significance.at_least(F.col("k"), F.col("n"), F.col("p")).alias("x")).collect()
    for (k, n, p), r in zip(cases, got):
        assert r.x == pytest.approx(_at_least(k, n, p), rel=1e-7)


def test_interval_bounds_have_their_tails(spark):
    cases = [(5, 10), (1, 40), (39, 40), (730, 2000)]
    table = spark.createDataFrame([(float(k), float(n)) for k, n in cases] + [(0.0, 9.0), (9.0, 9.0), (0.0, 0.0)], "k double, n double")
    lower, upper = significance.binomial_interval(F.col("k"), F.col("n"))
    rows = table.select(lower.alias("lower"), upper.alias("upper")).collect()
    for (k, n), r in zip(cases, rows):
        assert _at_least(k, n, r.lower) == pytest.approx(0.025, rel=1e-7)
        assert 1 - _at_least(k + 1, n, r.upper) == pytest.approx(0.025, rel=1e-7)
    assert rows[0].lower == pytest.approx(0.187086, abs=1e-6)  # tabled
    assert rows[4].lower == 0 and rows[4].upper == pytest.approx(1 - 0.025 ** (1 / 9))
    assert rows[5].upper == 1 and rows[6].lower is None and rows[6].upper is None


def test_interval_of_many_rows(spark):
    lower, upper = significance.binomial_interval(F.lit(6e5), F.lit(1e6))
    row = spark.range(1).select(lower.alias("lower"), upper.alias("upper")).first()
    width = 1.959964 * math.sqrt(0.24 / 1e6)
    assert row.lower == pytest.approx(0.6 - width, abs=1e-6) and row.upper == pytest.approx(0.6 + width, abs=1e-6)


def test_chi_square_tail(spark):
    tabled = [(3.841459, 1, 0.05), (7.814728, 3, 0.05), (0.0157908, 1, 0.9), (6.0, 2, math.exp(-3)), (200.0, 2, math.exp(-100)), (0.0, 3, 1.0)]
    table = spark.createDataFrame([(x, d) for x, d, _ in tabled] + [(1.0, 0)], "x double, d int")
    got = [r.p for r in table.select(significance.chi_square_tail(F.col("x"), F.col("d")).alias("p")).collect()]
    assert got[-1] is None
    for p, (_, _, want) in zip(got, tabled):
        assert p == pytest.approx(want, rel=1e-5)


def _scored(spark, cells, extra=()):
    rows = [(label, found) for (label, found), n in cells.items() for _ in range(n)] + list(extra)
    return spark.createDataFrame(rows, "label int, prediction int")


def test_two_classes_with_correction(spark):
    """The approval ratings of the textbooks: 794 and 570 stay, 150 and 86 change, corrected statistic 16.82."""
    table = _scored(spark, {(1, 1): 794, (1, 0): 150, (0, 1): 86, (0, 0): 570}, [(None, 1), (1, None), (7, 1)])
    row = profile.confusion_tests(table, [0, 1]).first()
    assert row.rows == 1600 and row.accuracy == pytest.approx(0.8525) and row.accuracy_null == pytest.approx(944 / 1600)
    assert row.symmetry == pytest.approx(63 ** 2 / 236) and row.symmetry_degrees == 1
    assert row.symmetry_p == pytest.approx(math.erfc(math.sqrt(row.symmetry / 2)), rel=1e-9)
    one = {r["class"]: r for r in profile.class_stats(table, [0, 1]).collect()}
    assert one[1].sensitivity == one[0].specificity == pytest.approx(794 / 944)
    assert one[1].positive_value == pytest.approx(794 / 880) and one[1].negative_value == pytest.approx(570 / 720)
    assert one[1].balanced_accuracy == pytest.approx((794 / 944 + 570 / 656) / 2)


def test_missing_classes_and_empty_tables(spark):
    table = _scored(spark, {(0, 0): 5, (0, 1): 2})
    row = profile.confusion_tests(table, [0, 1, 2]).first()
    assert row.symmetry_degrees == 1 and row.accuracy_null == 1 and row.accuracy_p == 1
    stats = {r["class"]: r for r in profile.class_stats(table, [0, 1, 2]).collect()}
    assert stats[2].sensitivity is None and stats[2].specificity == 1 and stats[2].prevalence == 0 and stats[2].f1 is None
    none = profile.confusion_tests(table.limit(0), [0, 1, 2]).first()
    assert none.rows is None and none.accuracy is None and none.accuracy_lower is None and none.symmetry_p is None
    assert profile.class_stats(table.limit(0), [0, 1, 2]).count() == 0


def test_interval_is_computed_by_batches(spark):
    """Sixty tails of every row are numpy's work on a whole batch and no fold of folds in each row."""
    table = spark.range(400).select((F.col("id") * 2.0).alias("k"), F.lit(1000.0).alias("n"))
    lower, upper = significance.binomial_interval(F.col("k"), F.col("n"))
    found = table.select("k", lower.alias("lower"), upper.alias("upper"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    for r in found.where("k in (2, 90, 798)").collect():
        assert _at_least(int(r.k), 1000, r.lower) == pytest.approx(0.025, rel=1e-7)
        assert 1 - _at_least(int(r.k) + 1, 1000, r.upper) == pytest.approx(0.025, rel=1e-7)
    odd = spark.createDataFrame([(0.5, 0.0, 1.0), (None, 2.0, 3.0), (0.5, 2.0, None)], "p double, a double, b double")
    assert [r.x for r in odd.select(significance.inverse_beta(F.col("p"), F.col("a"), F.col("b")).alias("x")).collect()] == [None] * 3
