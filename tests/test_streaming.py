import tempfile
import time

import pytest
from pyspark.sql import functions as F

from candlework.operators import labels, models
from candlework.operators.features import base_table
from candlework.schema import BAR_COLUMNS, BASE_COLUMNS, CODE_COLUMNS, FEATURE_COLUMNS
from candlework.sources import wire
from candlework.sources.tables import event_bars
from candlework.streaming import live
from check_queries import differences


def fresh(name):
    return tempfile.mkdtemp(prefix=f"candlework-test-{name}-")


@pytest.fixture(scope="module")
def bars(spark, data):
    b = event_bars(spark, data).withColumn("stockTime", F.col("stockTime").cast("timestamp")).cache()
    b.count()
    return b


def add_file(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)


def drain(stream, out, checkpoint):
    live.start(stream, checkpoint, out, every=None).awaitTermination()


def test_stream_equals_batch_across_restarts(spark, bars):
    src, out, cp = fresh("src"), fresh("out"), fresh("cp")

    def stream():
        reader = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1)
        return live.live_base_table(reader.parquet(src), digits=6)

    cuts = [1, 4, 9, 16, 32]
    day = F.dayofmonth("stockTime")
    for low, high in zip(cuts[:2], cuts[1:3]):
        add_file(bars.filter((day >= low) & (day < high)), src)
    drain(stream(), out, cp)
    for low, high in zip(cuts[2:-1], cuts[3:]):
        add_file(bars.filter((day >= low) & (day < high)), src)
    drain(stream(), out, cp)  # a new query resumes from the checkpoint
    got = spark.read.parquet(out)
    assert differences(got.toPandas(), base_table(bars, digits=6).toPandas()) == ""

    add_file(bars.limit(7), src)  # old bars again
    drain(stream(), out, cp)
    assert spark.read.parquet(out).count() == bars.count()
    counted = live.late_bars(spark, cp).agg(F.sum("seen"), F.sum("late")).first()
    assert tuple(counted) == (bars.count(), 7)


def test_wire_stream_and_scoring(spark, bars):
    src, out, cp = fresh("wire"), fresh("out"), fresh("cp")
    wire.format_wire(bars).coalesce(1).write.mode("overwrite").text(src + "/records")
    table = base_table(bars)
    train = labels.with_end_of_day(table).withColumn("label", labels.response(F.lit(1.0)))
    model = models.train_forest(train, CODE_COLUMNS, trees=3)
    stream = wire.read_wire_files(spark, src + "/records")
    scored = live.live_scores(live.live_base_table(stream), model)
    drain(live.with_processing_time(scored).select("stockName", "prediction", "processedAt"), out, cp)
    got = spark.read.parquet(out)
    assert got.count() == bars.count() and got.filter("processedAt is null").count() == 0
    want = models.score(table, model, CODE_COLUMNS)
    counts = {r.prediction: r["count"] for r in got.groupBy("prediction").count().collect()}
    assert counts == {r.prediction: r["count"] for r in want.groupBy("prediction").count().collect()}


def test_stream_join_state_is_bounded(spark, bars):
    src, out, cp = fresh("join"), fresh("out"), fresh("cp")
    add_file(bars, src)
    stream = spark.readStream.schema(bars.schema).parquet(src)
    joined = live.join_live(stream.select("stockName", "stockTime", "high"), stream.select("stockName", "stockTime", "low"))
    assert joined.isStreaming
    drain(joined, out, cp)
    assert spark.read.parquet(out).count() == bars.count()


def test_live_features_columns(spark, bars):
    src = fresh("cols")
    add_file(bars, src)
    stream = spark.readStream.schema(bars.schema).parquet(src)
    assert live.live_features(stream).columns == FEATURE_COLUMNS
    assert live.live_base_table(live.with_event_time(stream)).columns == BASE_COLUMNS
    assert bars.columns == BAR_COLUMNS


def test_console_sink(spark, bars):
    src, cp = fresh("console"), fresh("cp")
    add_file(bars.limit(5), src)
    stream = spark.readStream.schema(bars.schema).parquet(src).select("lastPrice")
    live.start(stream, cp, sink="console", every=None).awaitTermination()


def test_spans_of_two_months_lose_no_bar(spark, data, tmp_path):
    """Months overlap in their days; several files a span and several micro-batches."""
    from pyspark.sql import functions as F

    from candlework.plans.queries import staged_spans

    bars = event_bars(spark, data).withColumn("stockTime", F.col("stockTime").cast("timestamp"))
    both = bars.union(bars.withColumn("stockTime", F.col("stockTime") + F.expr("interval 31 days")))
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    query = live.start(live.live_base_table(staged_spans(both, parts=8, files=3)), cp, out, every=None)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 4
    assert spark.read.parquet(out).count() == both.select("stockName", "stockTime").distinct().count()
