import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlework.operators import labels, models, profile
from candlework.operators.features import base_table
from candlework.schema import CODE_COLUMNS, MODEL_COLUMNS, SIGNAL_COLUMNS
from candlework.sources.tables import event_bars, line_bars


@pytest.fixture(scope="module")
def table(spark, data):
    t = labels.with_end_of_day(base_table(event_bars(spark, data)))
    t = t.withColumn("label", labels.response(F.lit(1.0))).cache()
    t.count()
    return t


def keys():
    return [F.col("stockName"), F.col("stockTime").cast("string")]


@pytest.mark.parametrize("share", [0.8, 0.5, 0.0])
def test_split_is_exact_and_whole(table, share):
    train, test = models.exact_split(table.select("stockName", "stockTime"), keys(), share)
    n = table.count()
    assert train.count() == int(share * n) and test.count() == n - int(share * n)
    assert train.unionByName(test).distinct().count() == n


def test_split_changes_with_the_seed(table):
    a = models.exact_split(table.select("stockName", "stockTime"), keys(), seed=1)[0]
    b = models.exact_split(table.select("stockName", "stockTime"), keys(), seed=2)[0]
    assert a.exceptAll(b).count() > 0


@pytest.mark.parametrize("ranked", [1, 10])
def test_full_hash_ranges_are_cut_again(table, monkeypatch, ranked):
    rows = table.select("stockName", "stockTime")
    want = models.exact_split(rows, keys(), 0.3)[0]
    monkeypatch.setattr(models, "_HEX_DIGITS", 1)
    monkeypatch.setattr(models, "_MAX_RANKED", ranked)
    got = models.exact_split(rows, keys(), 0.3)[0]
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_split_of_an_empty_table(table):
    train, test = models.exact_split(table.select("stockName", "stockTime").limit(0), keys())
    assert train.count() == test.count() == 0


def test_vectors(table):
    r = models.labelled_vectors(table, SIGNAL_COLUMNS, "label").select("label", "features", *SIGNAL_COLUMNS).first()
    assert list(r.features) == [float(r[c]) for c in SIGNAL_COLUMNS]


def test_svm(table):
    rows = table.select("stockName", "stockTime", *SIGNAL_COLUMNS, labels.label_binary("label").alias("label"))
    train, test = models.exact_split(rows, keys())
    model = models.train_svm(train, SIGNAL_COLUMNS)
    assert len(models.svm_weights(model)) == len(SIGNAL_COLUMNS) and model.stages[-1].intercept == 0
    counts = profile.confusion_counts(models.evaluate_svm(model, test)).collect()
    assert sum(r.n for r in counts) == test.count()
    assert {r.prediction for r in counts} <= {-1, 1} and {r.label for r in counts} <= {-1, 1}


def test_svm_passes_over_different_rows(spark, monkeypatch):
    """Copies are weighed, to the weights of a fit over every row."""
    rows = spark.range(0, 6000, 1, 1).selectExpr("id % 5 - 2 as a", "(id div 5) % 3 as b", "if(id % 5 - 2 + (id div 5) % 3 + id % 7 / 7 > 1, 1, -1) as label")
    target = F.when(F.col("label") > 0, 1.0).otherwise(0.0)
    plain = models.LinearSVC(labelCol="_target", fitIntercept=False, maxIter=30, regParam=0.01)
    vectors = models.VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows.withColumn("_target", target))
    want = list(plain.fit(vectors).coefficients)
    sizes = []

    class Recorded(models.Pipeline):
        def fit(self, data):
            sizes.append(data.count())
            return super().fit(data)

    monkeypatch.setattr(models, "Pipeline", Recorded)
    table = np.array([tuple(r) for r in rows.collect()], float)
    x, y = table[:, :2], table[:, 2]
    loss = lambda w: np.maximum(0, 1 - y * (x @ w)).mean() + 0.005 * ((w * x.std(0, ddof=1)) ** 2).sum()
    fits = []
    for weighed in (100, 6000):
        monkeypatch.setattr(models, "_WEIGHED", weighed, raising=False)
        fits.append(np.array(models.svm_weights(models.train_svm(rows, ["a", "b"], iterations=30))))
    # pieces of weight 1 are the rows; heavier ones take other steps and are not as near the least loss after 30
    assert list(fits[1]) == pytest.approx(want, rel=1e-3)
    assert loss(fits[0]) == pytest.approx(loss(np.array(want)), rel=0.05)
    different = rows.distinct().count()
    assert sizes[0] <= different + 100 and sizes[1] == 6000


def test_forest_scores_and_persistence(spark, table):
    model = models.train_forest(table, MODEL_COLUMNS, trees=5)
    top = models.importance(model, spark, top=12).collect()
    assert len(top) == 12 and top[0].importance >= top[-1].importance
    path = tempfile.mkdtemp(prefix="candlework-test-") + "/m"
    models.save_model(model, path)
    again = models.score(table, models.load_model(path), MODEL_COLUMNS)
    first = models.score(table, model, MODEL_COLUMNS)
    assert again.columns == [*table.columns, "prediction"]
    assert first.select("prediction").collect() == again.select("prediction").collect()
    hole = table.withColumn("RSI", F.lit(None).cast("double"))
    filled = table.withColumn("RSI", F.lit(0.0))
    assert models.score(hole, model, MODEL_COLUMNS).select("prediction").collect() == models.score(
        filled, model, MODEL_COLUMNS
    ).select("prediction").collect()


def test_tuning(table):
    best = models.tune_forest(table, CODE_COLUMNS, depths=[1, 3], trees=3, folds=2)
    assert len(best.avgMetrics) == 2


def test_predicted_sweep(spark, data):
    grid = labels.Grid((100,), (50, 100), (50.0,))
    table = base_table(line_bars(spark, data)).cache()
    scored = models.predicted_slices(table, grid, labels.day_of("month"), trees=3).cache()
    sizes = {(r.deployment): r["count"] for r in scored.groupBy("deployment").count().collect()}
    symbols = table.select("stockName").distinct().count()
    assert sizes == {50: 51 * symbols, 100: 101 * symbols}
    assert models.predicted_return(scored).count() == 2 * symbols


def test_confusion(spark):
    rows = [(0, 0)] * 5 + [(1, 1)] * 3 + [(2, 1)] * 2 + [(1, 0)]
    scored = spark.createDataFrame(rows, "label int, prediction int")
    s = profile.confusion_stats(scored, [0, 1, 2]).first()
    assert s.rows == 11 and s.accuracy == pytest.approx(8 / 11)
    assert (s.recall_1, s.precision_1, s.recall_2, s.precision_2) == (0.75, 0.6, 0.0, None)
    chance = (5 * 6 + 4 * 5) / 121
    assert s.kappa == pytest.approx((8 / 11 - chance) / (1 - chance))
    m = {r.prediction: r for r in profile.confusion_matrix(scored, [0, 1, 2]).collect()}
    assert tuple(m[1]) == (1, 0, 3, 2)


def test_profiles(spark, table):
    f = profile.code_frequencies(table, CODE_COLUMNS)
    assert f.agg(F.sum("n")).first()[0] == table.count() * len(CODE_COLUMNS)
    nulls = profile.null_counts(table).first()
    assert nulls.D == table.filter("D is null").count() and nulls.stockName == 0
    assert profile.drop_incomplete(table).filter("D is null or RSI is null").count() == 0
    scaled = profile.min_max_scaled(table, "lastPrice", "s", by=["stockName"])
    r = scaled.agg(F.min("s"), F.max("s")).first()
    assert tuple(r) == (0.0, 1.0)
