"""The dual SVM against a plain loop, its gap, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlework.operators import dual_svm

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    x = x[np.abs(x @ [2.0, -1.0, 0.5]) > 0.3]
    y = np.where(x @ [2.0, -1.0, 0.5] > 0, 1, -1)
    return x, y, spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, c double, label int")


def test_one_task_equals_a_plain_loop(separable):
    x, y, table = separable
    got = dual_svm.train(table.coalesce(1), FEATURES, rounds=3, regularisation=0.05)
    n, w, dual = len(y), [0.0] * 3, [0.0] * len(y)
    for round_no in range(3):
        for i in dual_svm.order_of(100, round_no, 0, n, 1):
            margin = y[i] * sum(a * b for a, b in zip(w, x[i]))
            new = min(1.0, max(0.0, dual[i] + (1 - margin) * 0.05 * n / sum(a * a for a in x[i])))
            w = [a + (new - dual[i]) * y[i] * b / (0.05 * n) for a, b in zip(w, x[i])]
            dual[i] = new
    assert got.weights == pytest.approx(w, rel=1e-9)
    fits = [sum(d * v * r[k] for d, v, r in zip(dual, y, x)) / (0.05 * n) for k in range(3)]
    assert got.weights == pytest.approx(fits, rel=1e-9)


def test_gap_falls_and_separator_is_found(separable):
    _, _, table = separable
    got = dual_svm.train(table.repartition(4), FEATURES, rounds=25, regularisation=0.001, passes=5)
    gaps = [r[3] for r in got.rounds]
    assert len(gaps) == 26 and all(g >= -1e-9 for g in gaps) and gaps[-1] < gaps[0] / 20
    assert all(b >= a - 1e-9 for a, b in zip([r[2] for r in got.rounds], [r[2] for r in got.rounds][1:]))
    wrong = table.where(dual_svm.predicted(got.weights, FEATURES) != F.col("label")).count()
    assert wrong <= 4
    early = dual_svm.train(table, FEATURES, rounds=25, regularisation=0.1, gap=0.5)
    assert len(early.rounds) < 26 and early.rounds[-1][3] <= 0.5


def test_odd_tables(spark, separable):
    _, _, table = separable
    assert dual_svm.train(table.limit(0), FEATURES) == ([0.0] * 3, [])
    holes = spark.createDataFrame([(None, 1.0, 1.0, 1), (1.0, float("nan"), 1.0, 1), (1.0, 1.0, 1.0, None), (0.0, 0.0, 0.0, 1)], table.schema)
    got = dual_svm.train(holes, FEATURES, rounds=2)
    assert got.weights == [0.0] * 3 and got.rounds[-1][3] == pytest.approx(0)
    assert [r.p for r in holes.select(dual_svm.predicted([1.0, 0.0, 0.0], FEATURES).alias("p")).collect()][0] is None


def test_copies_are_ascended_once(separable):
    _, _, table = separable
    once = table.coalesce(1)
    copies = once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("copy")
    chunks = dual_svm._chunked(copies, FEATURES, F.col("label")).agg(F.sum("n").alias("n"), F.sum("copies").alias("copies")).first()
    n = table.count()
    assert (chunks.n, chunks.copies) == (n, 30 * n)
    got, plain = (dual_svm.train(t, FEATURES, rounds=3, regularisation=0.05, passes=2) for t in (copies, once))
    assert got.weights == pytest.approx(plain.weights, rel=1e-9)
    assert [r[1:] for r in got.rounds] == [pytest.approx(r[1:], rel=1e-9) for r in plain.rounds]
