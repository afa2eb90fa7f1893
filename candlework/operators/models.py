"""Classifiers over the feature table, trained and applied by Spark's own ML library."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlework.operators import forest
from candlework.operators.history import BARS_PER_PARTITION, MEASURE, HotSymbols, dealt, parts_for
from candlework.operators.labels import Grid, deployment_slices, label, numbered_days, response, training_slices
from candlework.operators.trades import mark_trades, summarise, summarise_grid
from candlework.schema import CODE_COLUMNS, MODEL_COLUMNS, WARMUP_BARS
from candlework.session import stored

_HEX_DIGITS = 4  # a level of hash ranges: 2**16 of them
_WEIGHED = 100_000  # a row given to the SVM weighs no more than this part of all, or a single row
_MAX_RANKED = 1_000_000  # rows of a range that one task ranks; fuller ranges are cut again


def labelled_vectors(table: DataFrame, features: Sequence[str], label_column: str) -> DataFrame:
    """(label, features), the features in the given order."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(
        table.withColumn("label", F.col(label_column).cast("double"))
    )


def split_parts(table: DataFrame, keys: Sequence[Column], share: float = 0.8, seed: int = 100) -> DataFrame:
    """The table with ``part``: 'train' for exactly floor(share * n) rows, else 'test', by a seeded hash of the keys.

    The hash of the last training row is looked up first: rows are counted in 2**16 hash
    ranges, and only the range holding the cut is ranked, or counted again by further digits while
    it is too full. The part is then one comparison, the same whenever it is recomputed.
    ``keys`` must identify a row.
    """
    hash_of = F.md5(F.concat_ws("|", *keys, F.lit(str(seed))))
    hashes = table.select(hash_of.alias("hash"))
    prefix, wanted, cut = "", None, None
    while cut is None:
        inside = hashes.filter(F.col("hash").startswith(prefix))
        digits = F.substring("hash", len(prefix) + 1, _HEX_DIGITS)
        counts = inside.groupBy(digits.alias("range")).agg(F.count("*").alias("n")).orderBy("range").collect()
        if wanted is None:
            wanted = math.floor(share * sum(r.n for r in counts) + 1e-9)
            if not wanted:  # nothing to train on
                return table.withColumn("part", F.lit("test"))
        for r in counts:
            if r.n >= wanted:
                break
            wanted -= r.n
        prefix += r.range
        if r.n <= _MAX_RANKED or len(prefix) == 32:
            rank = F.row_number().over(Window.partitionBy(F.substring("hash", 1, len(prefix))).orderBy("hash"))
            ranked = hashes.filter(F.col("hash").startswith(prefix)).withColumn("rank", rank)
            cut = ranked.filter(F.col("rank") == wanted).first().hash
    return table.withColumn("part", F.when(hash_of <= cut, "train").otherwise("test"))


def exact_split(
    table: DataFrame, keys: Sequence[Column], share: float = 0.8, seed: int = 100
) -> tuple[DataFrame, DataFrame]:
    """The two parts of ``split_parts`` as plain filters."""
    parts = split_parts(table, keys, share, seed)
    return tuple(parts.filter(F.col("part") == part).drop("part") for part in ("train", "test"))


def train_svm(
    train: DataFrame, features: Sequence[str], label_column: str = "label", iterations: int = 100, regularisation: float = 0.01
) -> PipelineModel:
    """Linear SVM without intercept on labels 1 and -1.

    At most ``iterations`` passes over the data; ``regularisation`` weighs the L2 penalty. Equal rows are counted first, and
    the passes are over the different ones with their number as weight: of codes, there are no more than their combinations.
    """
    target = F.when(F.col(label_column) > 0, 1.0).otherwise(0.0).alias("_target")
    counted = train.select(*features, target).groupBy(*features, "_target").agg(F.count("*").cast("double").alias("_n"))
    counted = stored(counted, "svm-rows")
    total = counted.agg(F.sum("_n")).first()[0] or 0.0
    # heavy rows are passed over in pieces, _WEIGHED more rows at most: so features are scaled as without weights
    pieces = F.ceil(F.col("_n") / max(1.0, total / _WEIGHED)).cast("int")
    weighed = counted.withColumn("_pieces", pieces).withColumn("_rows", F.col("_n") / F.col("_pieces"))
    squares = weighed.agg(F.sum(F.col("_n") * F.col("_rows"))).first()[0]
    if total > 1:
        # what is left of a difference: weighted rows have their variance over total - squares / total, not total - 1
        regularisation *= (total - squares / total) / (total - 1)
    weighed = weighed.withColumn("_piece", F.explode(F.sequence(F.lit(1), F.col("_pieces"))))
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="features"),
        LinearSVC(labelCol="_target", weightCol="_rows", fitIntercept=False, maxIter=iterations, regParam=regularisation),
    ]
    return Pipeline(stages=stages).fit(weighed)


def svm_weights(model: PipelineModel) -> list[float]:
    return list(model.stages[-1].coefficients)


def evaluate_svm(model: PipelineModel, test: DataFrame) -> DataFrame:
    """(label, prediction), both 1 or -1."""
    scored = model.transform(test)
    return scored.select(
        F.col("label").cast("int").alias("label"),
        F.when(F.col("prediction") > 0, 1).otherwise(-1).alias("prediction"),
    )


def forest_pipeline(
    features: Sequence[str] = MODEL_COLUMNS, trees: int = 100, seed: int = 100, depth: int = 5, subset: str = "sqrt"
) -> Pipeline:
    """The pipeline keeps its own assembler, so training and scoring use the same columns.

    ``depth`` bounds the trees (Spark allows 30; memory and passes grow with the nodes); ``subset`` is the
    number of features tried at a node.
    """
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="features"),
            RandomForestClassifier(
                labelCol="label", numTrees=trees, seed=seed, maxDepth=depth, featureSubsetStrategy=subset
            ),
        ]
    )


def train_forest(train: DataFrame, features: Sequence[str] = MODEL_COLUMNS, trees: int = 100, seed: int = 100,
                 depth: int = 5, subset: str = "sqrt") -> PipelineModel:
    """Random forest on complete rows; ``label`` is 0, 1 or 2."""
    rows = train.select(*features, F.col("label").cast("double").alias("label")).dropna("any")
    return forest_pipeline(features, trees, seed, depth, subset).fit(rows)


def importance(model: PipelineModel, spark, features: Sequence[str] = MODEL_COLUMNS, top: int = 12) -> DataFrame:
    """The features with the largest Gini importance. One row per feature: model-sized."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    ).limit(top)


def score(table: DataFrame, model: PipelineModel, features: Sequence[str] = CODE_COLUMNS) -> DataFrame:
    """Missing features count as 0.0; a row without a result gets -1.0. Batch or streaming."""
    filled = table.withColumns({f"_in_{x}": F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in features})
    assembled = VectorAssembler(inputCols=[f"_in_{x}" for x in features], outputCol="features").transform(filled)
    prediction = F.coalesce(F.nanvl("prediction", F.lit(None).cast("double")), F.lit(-1.0))
    out = model.stages[-1].transform(assembled)
    return out.withColumn("prediction", prediction).select(*table.columns, "prediction")


def tune_forest(train: DataFrame, features: Sequence[str], depths: Sequence[int], trees: int = 20, folds: int = 3,
                seed: int = 100):
    """Cross-validated choice of the tree depth."""
    pipeline = forest_pipeline(features, trees, seed)
    grid = ParamGridBuilder().addGrid(pipeline.getStages()[-1].maxDepth, list(depths)).build()
    rows = train.select(*features, F.col("label").cast("double").alias("label")).dropna("any")
    return CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=grid,
        evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"),
        numFolds=folds,
        seed=seed,
        parallelism=2,
    ).fit(rows)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predicted_slices(
    table: DataFrame,
    grid: Grid,
    day: Column | None = None,
    hot: HotSymbols | str | None = MEASURE,
    features: Sequence[str] = MODEL_COLUMNS,
    trees: int = 100,
    seed: int = 100,
    depth: int = 5,
    warmup: int = WARMUP_BARS,
    fits_at_once: int = 4,
) -> DataFrame:
    """Deployment slices with the forest's ``prediction``, counted from the bar after the warm-up.

    A fit depends on the training length and threshold only, so deployment lengths share it.
    The loop is over those parameters, a few fits at once; each fit and each transform is a distributed job. The
    numbered bars, cut to what the grid can reach, are stored once and scanned by every fit.
    """
    keys = ["stockName", "stockTime"]
    wanted = table.select(*keys, *[x for x in features if x not in keys])
    reachable = numbered_days(wanted, day, hot, warmup).filter(F.col("bar_no") <= grid.last_bar)
    numbered = stored(reachable, "numbered")
    parts = parts_for(numbered.count())
    complete = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in features])

    def fitted_and_scored(point: tuple[int, float]) -> DataFrame:
        training, threshold = point
        first = Grid((training,), (grid.deployment[0],), (threshold,))
        train = label(training_slices(numbered, first), [threshold]).withColumnRenamed("responseVariable", "label")
        model = train_forest(train, features, trees, seed, depth)
        # each bar is scored once, and bars of a symbol are brought together before slices multiply them
        scored = score(numbered.filter(F.col("bar_no").between(training, training + max(grid.deployment))), model, features)
        scored = scored.withColumn("prediction", F.when(complete, F.col("prediction").cast("int")))
        return label(deployment_slices(dealt(scored, parts, "stockName"), Grid((training,), grid.deployment, (threshold,))), [threshold])

    points = [(training, threshold) for training in grid.training for threshold in grid.thresholds]
    with ThreadPoolExecutor(fits_at_once) as pool:
        return reduce(DataFrame.unionByName, pool.map(fitted_and_scored, points))


def predicted_bars(
    table: DataFrame,
    grid: Grid,
    day: Column | None = None,
    hot: HotSymbols | str | None = MEASURE,
    features: Sequence[str] = MODEL_COLUMNS,
    trees: int = 100,
    seed: int = 100,
    depth: int = 5,
    warmup: int = WARMUP_BARS,
    tried: int | None = None,
    target: Column | None = None,
    packed: bool = True,
    per_partition: int = BARS_PER_PARTITION,
) -> DataFrame:
    """The bars of the deployment slices, each once, with the ``predictions`` of the forests of all training lengths and thresholds.

    All forests grow together (``operators.forest``): a scan a level of the training bars, each with its labels under all
    fits, and one scan of the deployment bars, which brings those of a symbol together. The predictions are in the order of training lengths, then thresholds, a byte
    each or as an array: -1 where a forest is not deployed on the bar, or a feature is missing. ``target`` takes the place of
    the label against the end-of-day price.
    """
    keys = ["stockName", "stockTime"]
    wanted = table.select(*keys, *[x for x in dict.fromkeys(["lastPrice", *features]) if x not in keys])
    numbered = numbered_days(wanted, day, hot, warmup).filter(F.col("bar_no") <= grid.last_bar)
    numbered = stored(forest.evenly(numbered), "numbered")
    train = numbered.filter(F.col("bar_no") <= max(grid.training))
    edges = forest.bin_edges(train, features)
    labels = [response(F.lit(threshold)) if target is None else target for threshold in grid.thresholds]
    rows = forest.binned(train, features, edges, labels, [F.col("stockName"), F.col("stockTime").cast("string")], ("bar_no", grid.training))
    model = forest.grow(rows, features, edges, len(grid.training) * len(labels), trees=trees, depth=depth, tried=tried, seed=seed)
    deployed = [(training, training + max(grid.deployment)) for training in grid.training for _ in grid.thresholds]
    bars = numbered.filter(F.col("bar_no") >= min(grid.training))
    kept = [*keys, "lastPrice", "bar_no", "day", "eodPrice"] if packed else None
    scored = forest.predict(bars, model, keep=kept, within=("bar_no", deployed), packed=packed)
    return dealt(scored, parts_for(numbered.count(), per_partition), "stockName")


def predicted_sweep(
    table: DataFrame,
    grid: Grid,
    day: Column | None = None,
    hot: HotSymbols | str | None = MEASURE,
    features: Sequence[str] = MODEL_COLUMNS,
    trees: int = 100,
    seed: int = 100,
    depth: int = 5,
    warmup: int = WARMUP_BARS,
    tried: int | None = None,
    target: Column | None = None,
    sliced: bool = True,
) -> DataFrame:
    """Deployment slices with the ``prediction`` of the forest of their training length and threshold, as ``predicted_slices``.

    The predictions of ``predicted_bars`` are one array that the slices pick from; a bar with a missing feature has none.
    A bar lies in some 50 slices of a full grid: with ``sliced=False`` each is given once, as ``predicted_bars`` does, for
    what takes all slices of such bars (``predicted_return``, ``predicted_confusion``).
    """
    points = (table, grid, day, hot, features, trees, seed, depth, warmup, tried, target)
    if not sliced:
        return predicted_bars(*points)
    # a grid reaches a bounded number of bars of a symbol: they are brought together before they are multiplied
    scored = predicted_bars(*points, packed=False, per_partition=BARS_PER_PARTITION // 4)
    slices = label(deployment_slices(scored, grid), grid.thresholds)
    place = lambda values, c: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)) - 1
    fit = place(grid.training, "training") * len(grid.thresholds) + place([float(x) for x in grid.thresholds], "threshold")
    prediction = F.col("predictions")[fit.cast("int")]
    return slices.withColumn("prediction", F.when(prediction >= 0, prediction)).drop("predictions")


def predicted_return(scored: DataFrame, grid: Grid | None = None) -> DataFrame:
    """Backtest of predictions: as the optimal return but without selling at the day's end.

    ``scored`` are slices, or with a grid the bars of ``predicted_bars``, which trade in all slices of it.
    """
    if grid is not None:
        return summarise_grid(scored, grid)
    return summarise(mark_trades(scored, F.col("prediction"), sell_at_day_end=False))


def predicted_confusion(bars: DataFrame, grid: Grid, classes: int = 3) -> DataFrame:
    """(deployment, training, threshold, label, prediction, n): the rows with a prediction of each deployment slice of the grid,
    counted, from the bars of ``predicted_bars``.

    A task counts its bars by fit, place in the slice, label and prediction, and gives the sums up to each deployment length, so
    no bar is multiplied; what it gives is bounded by the grid.
    """
    labels = F.array(*[response(F.lit(float(t))).cast("byte") for t in grid.thresholds])
    thresholds, longest, cells = len(grid.thresholds), max(grid.deployment) + 1, classes * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(grid.training), thresholds, longest, cells), np.int64)
        for batch in batches:
            bar_no = batch.column("bar_no").to_numpy()
            y = forest._matrix(batch.column("labels"), thresholds)
            p = forest._bytes(batch.column("predictions"), thresholds * len(grid.training), np.int8)
            for i, training in enumerate(grid.training):
                inside = np.flatnonzero((bar_no >= training) & (bar_no < training + longest))
                at = (bar_no[inside] - training) * cells
                for j in range(thresholds):
                    found = p[inside, i * thresholds + j].astype(np.int64)
                    cell = (at + y[inside, j] * classes + found)[found >= 0]
                    n[i, j] += np.bincount(cell, minlength=longest * cells).reshape(longest, cells)
        upto = n.cumsum(axis=2)[:, :, list(grid.deployment)]
        i, j, d, cell = np.nonzero(upto)
        yield pa.record_batch(
            {
                "deployment": np.array(grid.deployment, np.int32)[d],
                "training": np.array(grid.training, np.int32)[i],
                "threshold": np.array(grid.thresholds, np.float64)[j],
                "label": (cell // classes).astype(np.int32),
                "prediction": (cell % classes).astype(np.int32),
                "n": upto[i, j, d, cell],
            }
        )

    schema = "deployment int, training int, threshold double, label int, prediction int, n long"
    counted = bars.select("bar_no", labels.alias("labels"), "predictions").mapInArrow(run, schema)
    return counted.groupBy("deployment", "training", "threshold", "label", "prediction").agg(F.sum("n").alias("n"))
