"""What is computed of bars given once against the same of rows multiplied into slices, and exits found by bits against a walk."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlework.operators import forest, models, profile
from candlework.operators.labels import Grid, deployment_slices, label
from candlework.operators.trades import SLICE_KEYS, mark_trades, summarise, summarise_grid

GRID = Grid((5, 8), (3, 6, 20), (0.5, 2.0))
SCHEMA = "stockName string, stockTime timestamp_ntz, bar_no long, day date, lastPrice double, eodPrice double, predictions binary"


@pytest.fixture(scope="module")
def bars(spark):
    """Bars of symbols of different lengths, one of them without a name, some without price, at price 0 or below, or without prediction."""
    rng = np.random.default_rng(11)
    rows = []
    for s, size in enumerate((40, 28, 12, 8, 5, 4, 33, 9)):
        for i in range(1, size + 1):
            time = datetime(2020, 1, 1) + timedelta(hours=7 * i)
            price = [float(rng.integers(1, 9)), None, 0.0, -2.0][rng.choice(4, p=[0.85, 0.05, 0.05, 0.05])]
            codes = rng.integers(-1, 3, 4) if s < 6 else rng.choice([0, 2], 4)
            rows.append((None if s == 1 else f"S{s}", time, i, time.date(), price, None if s == 6 else 4.0, codes.astype(np.int8).tobytes()))
    return spark.createDataFrame(rows, SCHEMA).where("bar_no >= 5").repartition(3).cache()


@pytest.fixture(scope="module")
def slices(bars):
    """The same as rows of slices, each with its prediction."""

    @F.udf("array<int>")
    def numbers(packed):
        return [x - 256 if x > 127 else x for x in packed]

    rows = label(deployment_slices(bars, GRID), GRID.thresholds).withColumn("numbers", numbers("predictions"))
    fit = F.when(F.col("training") == 5, 0).otherwise(2) + F.when(F.col("threshold") == 0.5, 0).otherwise(1)
    found = F.col("numbers")[fit]
    return rows.withColumn("prediction", F.when(found >= 0, found)).cache()


def rows_of(df, keys):
    """Rows by key, without their last bits."""
    rows = [r.asDict() for r in df.collect()]
    found = {tuple(r[k] for k in keys): {c: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) for c, v in r.items() if c not in keys} for r in rows}
    assert len(found) == len(rows)
    return found


def test_all_slices_are_traded_as_each_one(bars, slices):
    want = rows_of(summarise(mark_trades(slices, F.col("prediction"), sell_at_day_end=False)), SLICE_KEYS)
    got = summarise_grid(bars, GRID)
    assert got.dtypes == summarise(mark_trades(slices, F.col("prediction"), sell_at_day_end=False)).dtypes
    assert rows_of(got, SLICE_KEYS) == want
    assert rows_of(models.predicted_return(bars, GRID), SLICE_KEYS) == want
    assert sum(r["transactions"] for r in want.values()) > 20 and any(r["sdReturn"] for r in want.values())
    # in one partition as well, however many symbols a task trades at once
    assert rows_of(summarise_grid(bars.coalesce(1), GRID), SLICE_KEYS) == want


def test_tasks_hold_some_symbols_at_a_time(bars, slices, monkeypatch):
    from candlework.operators import trades

    monkeypatch.setattr(trades, "_SYMBOLS", 2)
    want = rows_of(summarise(mark_trades(slices, F.col("prediction"), sell_at_day_end=False)), SLICE_KEYS)
    assert rows_of(summarise_grid(bars.coalesce(1), GRID), SLICE_KEYS) == want


def test_confusion_of_all_slices(bars, slices):
    by = ["deployment", "training", "threshold"]
    each = slices.withColumnRenamed("responseVariable", "label").where("prediction is not null")
    counted = models.predicted_confusion(bars, GRID)
    assert rows_of(counted, [*by, "label", "prediction"]) == rows_of(profile.confusion_counts(each, by), [*by, "label", "prediction"])
    want = rows_of(profile.confusion_stats(each, [0, 1, 2], by), by)
    assert rows_of(profile.confusion_stats(counted, [0, 1, 2], by, count="n"), by) == want and len(want) == 12


def test_no_row_for_each_slice(bars):
    """Neither plan multiplies a bar."""
    for df in (models.predicted_return(bars, GRID), models.predicted_confusion(bars, GRID)):
        assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("depth", [1, 3, 5, 6, 7])
def test_bits_end_where_a_walk_ends(depth):
    rng = np.random.default_rng(depth)
    edges = [[0.0, 1.0, 2.0, 3.0], [0.0], list(map(float, range(9))), []]
    shape = (2, 5, 2 << depth)
    model = forest.Forests(["a", "b", "c", "d"], edges, 3, np.full(shape, -1, np.int8), np.zeros(shape, np.uint8), np.full(shape, -1, np.int8), np.zeros(shape))
    for fit, tree in np.ndindex(shape[:2]):
        if (fit, tree) == (1, 4):
            continue  # a tree without rows
        reached = [1]
        while reached:
            node = reached.pop()
            model.decision[fit, tree, node] = rng.integers(0, 3)
            if node < 1 << depth and rng.random() < 0.85:
                f = rng.integers(0, 3)
                model.feature[fit, tree, node], model.bin[fit, tree, node] = f, rng.integers(0, len(edges[f]))
                reached += [2 * node, 2 * node + 1]
    x = np.stack([rng.integers(0, len(e) + 1, 3000) for e in edges], 1).astype(np.uint8)
    h = rng.integers(1, 1 << 28, 3000)
    for fit in range(2):
        want = np.zeros((2, 3000, 3), int)
        for tree in range(5):
            node = model.walk(x, fit, tree, depth)
            drawn = forest.weights(h, fit, tree) > 0
            for c in range(3):
                hit = model.decision[fit, tree][node] == c
                want[0, :, c] += hit
                want[1, :, c] += hit & ~drawn
        assert (model.votes(x, fit) == want[0]).all() and (model.votes(x, fit, h) == want[1]).all()


def test_drawn_as_by_all_steps():
    """Looked up, a row is drawn as often as its place says, at the steps themselves as well."""
    h = np.concatenate([np.arange(1, 200_000) * 1337 % (1 << 28) + 1, np.arange(1, 4)])
    for fit, tree in ((0, 0), (3, 7), (39, 24)):
        place = np.array([int(x) * forest.factor(fit, tree) % forest.PRIME for x in h])
        assert (forest.weights(h, fit, tree) == sum((place >= s).astype(int) for s in forest.POISSON_STEPS)).all()


def test_a_fit_predicts_within_its_bars(spark):
    """Outside of them a fit predicts -1; packed predictions are the same numbers."""
    table = spark.createDataFrame([(i, float(i % 3), i) for i in range(30)], "id int, a double, bar_no int")
    edges = [[0.5]]
    model = forest.grow(forest.binned(table, ["a"], edges, [F.when(F.col("a") > 1, 2).otherwise(1)] * 2, [F.col("id").cast("string")]), ["a"], edges, 2, trees=3, depth=1)
    whole = {r.id: r.predictions for r in forest.predict(table, model).collect()}
    some = {r.id: r.predictions for r in forest.predict(table, model, within=("bar_no", [(5, 9), (0, 100)])).collect()}
    assert some == {i: [v[0] if 5 <= i <= 9 else -1, v[1]] for i, v in whole.items()}
    packed = {r.id: np.frombuffer(r.predictions, np.int8).tolist() for r in forest.predict(table, model, packed=True).collect()}
    assert packed == whole


def test_fits_by_last_row_are_labels_by_condition(spark):
    table = spark.createDataFrame([(i, float(i % 7), i) for i in range(60)], "id int, a double, bar_no int")
    key, edges = [F.col("id").cast("string")], [[1.0, 3.0]]
    labels = [F.when(F.col("a") > 2, 1).otherwise(0), F.when(F.col("a") > 4, 2)]
    each = [F.when(F.col("bar_no") <= n, y) for n in (10, 40) for y in labels]
    found = [forest.binned(table, ["a"], edges, *more) for more in ((each, key), (labels, key, ("bar_no", (10, 40))))]
    assert sorted(found[0].collect()) == sorted(found[1].collect()) and found[0].count() == 41
