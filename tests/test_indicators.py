import pytest
from pyspark.sql import functions as F

from candlework.operators.features import (
    base_table,
    base_table_by_joins,
    dedupe_bars,
    drop_warmup,
    feature_table,
    indicator_table,
    sma_by_joins,
)
from candlework.operators.history import HotSymbols, measure, number_bars, overlap
from candlework.operators.indicators import ALL_INDICATORS, RELATIVE_STRENGTH, WMA
from candlework.operators.labels import Grid
from candlework.operators.trades import optimal_return
from candlework.schema import BASE_COLUMNS, CODE_COLUMNS, FEATURE_COLUMNS, SIGNAL_COLUMNS
from candlework.sources.tables import event_bars, line_bars
from check_queries import differences


def rows(df):
    return df.orderBy("stockTime").collect()


def test_first_bar(make_bars):
    r = base_table(make_bars([(11, 9, 10, 100)])).first()
    assert (r.SMA10, r.SMA100, r.SMA_signal, r.SMA_direction) == (10.0, 10.0, 0, 1)
    assert (r.BB_lowerBound, r.BB_upperBound, r.BB_signal, r.BB_direction) == (0.0, 0.0, 1, -1)
    assert (r.RSI, r.RSI_direction, r.moneyFlowIndex, r.MFI_signal) == (100.0, -1, 100.0, 2)
    assert (r.CCI, r.lastPriceLag) == (0.0, 0.0)


def test_all_up(make_bars):
    out = rows(base_table(make_bars([(p, p, p, 100) for p in range(1, 21)])))
    assert all(r.RSI == 100 and r.RSI_signal == 0 and r.RSI_direction == -1 for r in out)
    assert all(r.moneyFlowIndex == 100 for r in out)
    assert out[0].D is None and out[0].williamsR is None
    assert all(r.D == 100 and r.williamsR == 0 for r in out[1:])


def test_flat(make_bars):
    out = rows(base_table(make_bars([(10, 10, 10, 100)] * 20)))
    assert [r.RSI for r in out] == [100.0] * 14 + [None] * 6
    assert all(r.D is None and r.williamsR is None and r.CCI == 0 for r in out)
    assert all(r.chaikin == 0 and r.chaikin_direction == -1 for r in out)
    assert all(r.RSI_direction == 0 for r in out[14:])


def test_zero_volume(make_bars):
    out = rows(base_table(make_bars([(11, 9, 10 + i % 2, 0) for i in range(5)])))
    assert all(r.chaikin is None and r.chaikin_signal == 0 and r.chaikin_direction == 0 for r in out)
    assert all(r.moneyFlowIndex is None for r in out)


def test_wma_warmup(make_bars):
    out = rows(indicator_table(make_bars([(10, 10, 10, 1)] * 10), [WMA], ["stockTime", "WMA10"]))
    assert [r.WMA10 for r in out[:2]] == pytest.approx([100 / 55, 190 / 55])
    assert out[9].WMA10 == pytest.approx(10.0)


def test_relative_strength_is_capped(make_bars):
    bars = make_bars([(p, p, p, 1) for p in [10, 11, 12]])
    out = rows(indicator_table(bars, [RELATIVE_STRENGTH], ["stockTime", "RS", "RSlag"]))
    assert [r.RS for r in out] == [1.0, 1.0, 1.0]
    assert [r.RSlag for r in out] == [0.0, 1.0, 1.0]


def test_dedupe(make_bars):
    bars = make_bars([(11, 9, 10, 100), (12, 10, 11, 100)])
    assert dedupe_bars(bars.union(bars)).count() == 2
    assert dedupe_bars(bars.union(bars)).columns == bars.columns


@pytest.mark.parametrize("shift", [-1.0, 1.0])
def test_conflicting_copies_give_one_row_each_way(spark, data, shift):
    bars = line_bars(spark, data)
    shifted = bars.withColumns({c: F.col(c) + shift for c in ("high", "low", "lastPrice")})
    both = bars.unionByName(shifted).unionByName(bars).cache()
    kept = bars if shift > 0 else shifted
    want = base_table(kept, None, digits=6)
    same(want, base_table(dedupe_bars(both), None, digits=6))
    same(want, base_table(both, None, digits=6, unique=False))
    same(want, base_table(both, measure(both, 500), digits=6, unique=False))


def same(a, b):
    assert a.columns == b.columns
    assert differences(a.toPandas(), b.toPandas()) == ""


@pytest.mark.parametrize("source", [event_bars, line_bars])
def test_join_form_equals_one_pass(spark, data, source):
    bars = source(spark, data).cache()
    one_pass = base_table(bars, None, digits=6)
    assert one_pass.columns == BASE_COLUMNS
    assert one_pass.count() == bars.count()
    same(one_pass, base_table_by_joins(bars, None, digits=6))
    assert feature_table(bars).columns == FEATURE_COLUMNS


def test_sma_by_joins_has_every_bar(spark, data):
    bars = event_bars(spark, data)
    assert sma_by_joins(bars).count() == bars.count()


def test_one_shuffle_and_three_windows(spark, make_bars):
    plan = base_table(make_bars([(11, 9, 10, 100)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("+- Sort [") == 1
    assert plan.count("+- Window [") == 3


@pytest.mark.parametrize("source,limit", [(event_bars, 40), (line_bars, 200)])
def test_segments_equal_plain(spark, data, source, limit):
    bars = source(spark, data).cache()
    hot = measure(bars, limit)
    assert hot is not None
    columns = [*BASE_COLUMNS, "WMA10", "RS", "RSlag"]
    same(
        indicator_table(bars, ALL_INDICATORS, columns, None, digits=6),
        indicator_table(bars, ALL_INDICATORS, columns, hot, digits=6),
    )
    same(number_bars(bars, None), number_bars(bars, hot))
    same(drop_warmup(bars, hot=None), drop_warmup(bars, hot=hot))


def test_sparse_segments_reach_back_over_many(spark, make_bars):
    # one bar per day cut by hour: every segment needs bars from a hundred others
    bars = make_bars([(12 + i % 7, 8 + i % 3, 10 + i % 5, 100 + i) for i in range(300)])
    bars = bars.withColumn("stockTime", F.expr("stockTime + make_interval(0, 0, 0, int(minute(stockTime) + 60 * hour(stockTime)))"))
    hot = HotSymbols(spark.createDataFrame([("U", "hour")], "stockName string, period string"), True)
    same(base_table(bars, None, digits=6), base_table(bars, hot, digits=6))


def test_measure_picks_the_widest_period_that_fits(spark, make_bars):
    bars = make_bars([(11, 9, 10, 1)] * 300, "A").union(make_bars([(11, 9, 10, 1)] * 10, "B"))
    assert measure(bars, 1000) is None
    assert [tuple(r) for r in measure(bars, 299).table.collect()] == [("A", "hour")]
    assert [tuple(r) for r in measure(bars, 50).table.collect()] == [("A", "minute")]


def test_value_ranges(spark, data):
    t = base_table(line_bars(spark, data))
    bad = t.filter(
        ~F.coalesce(F.col("D").between(-1e-9, 100 + 1e-9), F.lit(True))
        | ~F.coalesce(F.col("RSI").between(-1e-9, 100 + 1e-9), F.lit(True))
        | ~F.coalesce(F.col("moneyFlowIndex").between(-1e-9, 100 + 1e-9), F.lit(True))
        | ~F.coalesce(F.col("williamsR").between(-100 - 1e-9, 1e-9), F.lit(True))
    )
    assert bad.count() == 0
    for name in CODE_COLUMNS:
        allowed = [0, 1, 2] if name in SIGNAL_COLUMNS else [-1, 0, 1]
        assert t.filter(~F.col(name).isin(allowed) | F.col(name).isNull()).count() == 0


def test_a_symbol_with_a_third_of_the_bars(spark, make_bars):
    """A hot symbol whose bars crowd into a few minutes is cut finely, others stay whole."""
    waves = [(12 + i % 7, 8 + i % 3, 10 + (i * i) % 5 / 4, 100 + i % 11) for i in range(1000)]
    crowded = make_bars(waves, "HOT").withColumn(
        "stockTime", F.expr("timestamp_micros(unix_micros(timestamp'2020-01-01') + (unix_micros(stockTime) - unix_micros(timestamp'2020-01-01 09:00:00')) div 60)")
    )
    bars = crowded
    for i in range(4):
        bars = bars.union(make_bars(waves[: 400 + i], f"COLD{i}"))
    bars = bars.cache()
    hot = measure(bars, 500)
    assert [tuple(r) for r in hot.table.collect()] == [("HOT", "minute")]
    cut = overlap(bars, hot, 101)
    sizes = {r["stockName"]: r["n"] for r in cut.groupBy("stockName", "segment").count().groupBy("stockName").agg(F.max("count").alias("n")).collect()}
    assert sizes["HOT"] <= 60 + 101 and sizes["COLD3"] == 403
    same(base_table(bars, None, digits=6), base_table(bars, hot, digits=6))
    same(number_bars(bars, None), number_bars(bars, hot))
    grid = Grid((50, 100), (100, 300), (0.25,))
    columns = ["stockName", "deployment", "training", "threshold", "days", "transactions"]
    same(optimal_return(bars, grid, hot=None).select(*columns), optimal_return(bars, grid, hot=hot).select(*columns))


def test_default_measures(spark, make_bars, monkeypatch):
    from candlework.operators import history

    bars = make_bars([(12 + i % 7, 8, 10 + i % 5, 100) for i in range(300)]).cache()
    plain = base_table(bars, None, digits=6)
    monkeypatch.setattr(history.measure, "__defaults__", (100,))
    split = base_table(bars, digits=6)
    assert "_before" in split._jdf.queryExecution().optimizedPlan().toString()
    same(plain, split)


def test_more_hot_symbols_than_are_broadcast(spark, make_bars, monkeypatch):
    from candlework.operators import history

    bars = make_bars([(12 + i % 7, 8, 10 + i % 5, 100) for i in range(150)], "A")
    bars = bars.union(make_bars([(12 + i % 5, 8, 10 + i % 3, 100) for i in range(150)], "B")).cache()
    monkeypatch.setattr(history, "MAX_BROADCAST_SYMBOLS", 1)
    hot = measure(bars, 70)
    assert not hot.broadcastable
    same(base_table(bars, None, digits=6), base_table(bars, hot, digits=6))


def test_views(spark, make_bars):
    base_table(make_bars([(11, 9, 10, 100)] * 3), None).createOrReplaceTempView("features")
    assert spark.sql("select stockName, count(*) n from features group by 1").collect()[0].n == 3
