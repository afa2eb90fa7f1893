"""Forests of many fits against a plain recursive loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlework.operators import forest, labels, models
from candlework.operators.features import base_table
from candlework.sources.tables import line_bars

FEATURES = ["a", "b", "stoch_direction", "SMA_direction"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        a, b, c, d = float(rng.normal()), float(rng.integers(0, 5)), int(rng.integers(-1, 2)), int(rng.integers(-1, 2))
        y = 2 if a > 0.3 and c == 1 else 1 if b >= 3 else 0
        rows.append((i, a, b, c, d, y if rng.random() < 0.95 else 0, i % 7))
    return spark.createDataFrame(rows, "id long, a double, b double, stoch_direction int, SMA_direction int, y int, part int").cache()


@pytest.fixture(scope="module")
def trained(table):
    edges = forest.bin_edges(table, FEATURES, bins=8)
    fits = [F.col("y"), F.when(F.col("part") < 3, F.col("y")), F.lit(None).cast("int"), F.when(F.col("part") == 1, 2 - F.col("y"))]
    rows = forest.binned(table, FEATURES, edges, fits, [F.col("id").cast("string")])
    return edges, rows, forest.grow(rows, FEATURES, edges, len(fits), trees=4, depth=3, tried=4)


def by_loop(x, y, w, edges, depth):
    """(node: feature, bin, decision) of one tree over weighted rows."""
    out = {}

    def purity(n):
        return float((n.astype(float) ** 2).sum() / n.sum()) if n.sum() else 0.0

    def split(node, rows, level):
        total = np.bincount(y[rows], w[rows], 3).astype(int)
        best = None
        if level < depth:
            for f in range(x.shape[1]):
                for b in range(len(edges[f])):
                    left = np.bincount(y[rows[x[rows, f] <= b]], w[rows[x[rows, f] <= b]], 3).astype(int)
                    gain = round(purity(left) + purity(total - left) - purity(total), 9)
                    present = (x[rows, f] == b).any()  # a bin without rows is no place to split
                    if present and gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, b)
        out[node] = (best[1] if best else -1, best[2] if best else 0, int(total.argmax()))
        if best:
            goes = x[rows, best[1]] <= best[2]
            split(2 * node, rows[goes], level + 1)
            split(2 * node + 1, rows[~goes], level + 1)

    rows = np.flatnonzero(w > 0)
    if len(rows):
        split(1, rows, 0)
    return out


def test_trees_equal_a_plain_loop(trained):
    edges, rows, model = trained
    got = rows.collect()
    x, y = np.array([list(r.x) for r in got]), np.array([np.frombuffer(r.y, np.int8) for r in got])
    h = np.array([r.hash for r in got])
    for fit in (0, 1, 3):
        mine = y[:, fit] >= 0
        for tree in range(4):
            want = by_loop(x[mine], y[mine, fit].astype(int), forest.weights(h[mine], fit, tree), edges, 3)
            nodes = np.flatnonzero(model.decision[fit, tree] >= 0)
            assert {int(n): (int(model.feature[fit, tree, n]), int(model.bin[fit, tree, n]), int(model.decision[fit, tree, n])) for n in nodes} == want
    assert (model.decision[2] == -1).all()


def test_weights_are_poisson_and_differ():
    h = np.arange(1, 200_001) * 1337 % (1 << 28) + 1
    a, b = forest.weights(h, 0, 0), forest.weights(h, 0, 1)
    assert a.mean() == pytest.approx(1, abs=0.02) and a.var() == pytest.approx(1, abs=0.05)
    assert (a == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.02


def test_predictions_missing_values_and_nodes(spark, table, trained, tmp_path):
    edges, rows, model = trained
    scored = forest.predict(table, model)
    accuracy = scored.agg(F.avg((F.col("predictions")[0] == F.col("y")).cast("int"))).first()[0]
    assert accuracy > 0.85
    assert scored.where("predictions[2] <> -1").count() == 0
    path = str(tmp_path / "nodes")
    forest.node_table(spark, model).write.parquet(path)
    again = forest.from_nodes(spark.read.parquet(path), FEATURES, edges, 3, model.feature.shape)
    assert forest.predict(table, again).exceptAll(scored).count() == 0
    holes = table.withColumn("a", F.when(F.col("id") % 2 == 0, F.col("a")))
    got = forest.predict(holes, model).where("id % 2 = 1")
    assert got.where("predictions[0] <> -1").count() == 0 and got.count() == 300
    zero = forest.predict(table.withColumn("a", F.when(F.col("id") % 2 == 0, F.col("a")).otherwise(0.0)), model)
    assert forest.predict(holes, model, missing=0.0).select("id", "predictions").exceptAll(zero.select("id", "predictions")).count() == 0
    assert forest.predict(table.limit(0), model).count() == 0


def test_importances(spark, trained):
    _, _, model = trained
    found = forest.importances(spark, model).where("fit = 0")
    assert found.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    assert found.orderBy("importance").first().feature == "SMA_direction"


def test_out_of_bag(trained):
    _, rows, model = trained
    found = forest.out_of_bag(rows, model).where("fit = 0").collect()
    h = {r.hash: r for r in found}
    want = {x: sum(int(forest.weights(np.array([x]), 0, t)[0] == 0) for t in range(4)) for x in h}
    assert {x: r.votes for x, r in h.items()} == want
    assert all((r.prediction == -1) == (r.votes == 0) for r in found)


def test_tuning_goes_down_and_up(trained):
    edges, rows, _ = trained
    found = forest.tune_tried(rows, FEATURES, edges, fits=4, trees=6, depth=3)
    assert found[0][1] <= found[-1][1] and 2 in dict(found) and set(dict(found)) <= {1, 2, 4}


def test_sweep_has_every_point(spark, data):
    grid = labels.Grid((50, 100), (50, 100), (5.0, 50.0))
    table = base_table(line_bars(spark, data)).cache()
    scored = models.predicted_sweep(table, grid, labels.day_of("month"), trees=3, depth=2).cache()
    symbols = table.select("stockName").distinct().count()
    sizes = {(r.training, r.deployment, r.threshold): r["count"] for r in scored.groupBy("training", "deployment", "threshold").count().collect()}
    assert sizes == {(t, d, x): (d + 1) * symbols for t in (50, 100) for d in (50, 100) for x in (5.0, 50.0)}
    assert scored.where("prediction not in (0, 1, 2)").count() == 0 and scored.where("prediction is not null").count() > 0
    assert models.predicted_return(scored).count() == 8 * symbols


def test_a_task_gives_each_cell_once(spark, monkeypatch):
    """However many rows a task reads, each cell of a level leaves it once, with the sum of all its rows."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    edges = [[0.0, 1.0, 2.0], [0.0], [0.0, 1.0]]
    x = np.stack([rng.integers(0, len(e) + 1, 3000) for e in edges], 1).astype(np.uint8)
    y, h = rng.integers(-1, 3, (3000, 2)).astype(np.int8), rng.integers(1, 1 << 28, 3000)
    shape = (2, 3, 4)
    model = forest.Forests(["a", "b", "c"], edges, 3, np.full(shape, -1, np.int8), np.zeros(shape, np.uint8), np.full(shape, -1, np.int8), np.zeros(shape))
    model.feature[:, :, 1], model.bin[:, :, 1] = 0, 1
    rows = pa.record_batch({"hash": h, "x": pa.array([r.tobytes() for r in x], pa.binary()), "y": pa.array([r.tobytes() for r in y], pa.binary())})
    batches = lambda: iter([rows.slice(i, 300) for i in range(0, 3000, 300)])
    key = ("fit", "tree", "node", "feature", "bin")

    def cells(level):
        found = pa.Table.from_batches(list(forest._histograms(model, level, 2, 100)(batches()))).to_pylist()
        summed = {}
        for r in found:
            old = summed.setdefault(tuple(r[k] for k in key), [0, 0, 0])
            summed[tuple(r[k] for k in key)] = [a + r[f"n{c}"] for c, a in enumerate(old)]
        return len(found), summed

    for level in (0, 1):
        whole = cells(level)[1]
        with monkeypatch.context() as m:
            m.setattr(forest, "_ROWS", 300)
            assert cells(level) == (len(whole), whole)  # ten portions of rows
            m.setattr(forest, "_CELLS", 1)  # too many to hold: portion by portion
            n, by_portion = cells(level)
            assert by_portion == whole and n > len(whole)


def test_rows_of_bytes_and_columns_to_keep(spark):
    """Matrices become binary values and come back, from slices as well; weights are those of the plain remainder; only the
    columns to keep go through the scoring tasks."""
    x = np.arange(30, dtype=np.uint8).reshape(10, 3)
    column = forest._binary(x)
    assert column.to_pylist() == [r.tobytes() for r in x]
    assert (forest._bytes(column.slice(4, 5), 3, np.uint8) == x[4:9]).all() and forest._bytes(column[:0], 3, np.int8).shape == (0, 3)
    h = np.array([1, 2, 3, (1 << 28) - 1, 1 << 28])
    for tree in range(50):
        place = [int(v) * forest.factor(1, tree) % forest.PRIME for v in h]
        assert forest.weights(h, 1, tree).tolist() == [sum(p >= step for step in forest.POISSON_STEPS) for p in place]
    empty = forest.Forests(["a"], [[0.0]], 3, *[np.full((1, 1, 4), -1, np.int8), np.zeros((1, 1, 4), np.uint8), np.full((1, 1, 4), -1, np.int8), np.zeros((1, 1, 4))])
    table = spark.createDataFrame([(1, 0.5, "b")], "id long, a double, more string")
    assert forest.predict(table, empty, keep=["id"]).collect() == [(1, [-1])]
    assert forest.predict(table, empty).columns == ["id", "a", "more", "predictions"]
