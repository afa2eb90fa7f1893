from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candlework.operators import labels, trades
from candlework.operators.history import HotSymbols, number_bars
from candlework.schema import DEPLOYMENT_PERIODS, TRAINING_PERIODS


def test_sweep_lengths():
    assert DEPLOYMENT_PERIODS == [389, 1945, 3890, 8752, 17504, 26256]
    assert TRAINING_PERIODS == [1945, 3890, 5835, 8752, 9725, 11670, 13615, 17504, 19450, 26256]


def slice_of(spark, codes, prices, days=None):
    t0 = datetime(2020, 1, 1, 9)
    days = days or [date(2020, 1, 1)] * len(codes)
    rows = [
        ("U", 1, 1, 0.1, t0 + timedelta(minutes=i), d, float(p), c - 1)
        for i, (c, p, d) in enumerate(zip(codes, prices, days))
    ]
    return spark.createDataFrame(
        rows,
        "stockName string, deployment int, training int, threshold double, stockTime timestamp, day date, "
        "lastPrice double, code int",
    )


def test_trades(spark):
    slices = slice_of(spark, [2, 2, 3, 1, 2, 3], [10, 11, 12, 13, 14, 15])
    marked = trades.mark_trades(slices, F.col("code"), sell_at_day_end=False).cache()
    assert [(r.position, r.returnPrice) for r in trades.trades(marked).orderBy("stockTime").collect()] == [
        (3, 12.0), (2, 14.0),
    ]
    assert [r["return"] for r in trades.trade_returns(marked).collect()] == pytest.approx([-(14 - 12) / 12])
    r = trades.summarise(marked).first()
    assert (r.days, r.transactions, r.sdReturn) == (1, 2, None)
    assert r.averageDailyReturn == pytest.approx(-(14 - 12) / 12)


def test_open_position_is_closed_at_the_final_row(spark):
    marked = trades.mark_trades(slice_of(spark, [2, 3, 3, 3, 2], [10, 12, 13, 15, 1]), F.col("code"), False)
    assert [r.returnPrice for r in trades.trades(marked).orderBy("stockTime").collect()] == [12.0, 15.0]
    assert trades.summarise(marked).first().transactions == 1  # counted before closing


def test_nothing_traded(spark):
    marked = trades.mark_trades(slice_of(spark, [1, 2, 1, 2, 1], [10, 12, 13, 15, 1]), F.col("code"), False)
    r = trades.summarise(marked).first()
    assert (r.transactions, r.totalReturn, r.meanReturn, r.averageDailyReturn) == (0, 0.0, None, 0.0)


def test_day_end_forces_a_sale(spark):
    d1, d2 = date(2020, 1, 1), date(2020, 1, 2)
    slices = slice_of(spark, [2, 2, 1, 2, 2], [10, 11, 12, 13, 14], [d1, d1, d1, d2, d2])
    marked = trades.mark_trades(slices, F.col("code"), sell_at_day_end=True)
    assert [(r.position, r.returnPrice) for r in trades.trades(marked).orderBy("stockTime").collect()] == [
        (3, 12.0), (2, 13.0),
    ]
    assert trades.summarise(marked).first().days == 2


def reference_backtest(rows, sell_at_day_end):
    """Plain restatement over one slice: (code, price, day) in time order."""
    n = len(rows)
    kept = []
    for i, (code, price, day) in enumerate(rows):
        last = i == n - 1
        if last:
            kept.append((None, price))
        elif sell_at_day_end and rows[i + 1][2] != day:
            kept.append((3, price))
        elif code != 0:
            kept.append((code + 1, price))
    moves = [
        (kept[i][0], kept[i][1], kept[i][1] if kept[i][0] != kept[i - 1][0] else 0.0)
        for i in range(1, len(kept))
        if kept[i][0] is not None and kept[i - 1][0] is not None
    ]
    transactions = sum(m[2] > 0 for m in moves)
    if moves and moves[-1][2] == 0 and transactions:
        moves[-1] = (moves[-1][0], moves[-1][1], moves[-1][1])
    moves = [m for m in moves if m[2] != 0]
    returns = [
        (b[2] - a[2]) / a[2] * (1 if a[0] == 2 else -1) for a, b in zip(moves, moves[1:])
    ]
    return transactions, sum(returns), len({r[2] for r in rows})


@pytest.mark.parametrize("sell", [True, False])
def test_against_brute_force(spark, sell):
    import random

    rng = random.Random(7)
    frames, expected = [], {}
    for s in range(30):
        n = rng.randint(1, 40)
        rows = [(rng.choice([0, 0, 1, 2]), rng.randint(1, 9) / 2, date(2020, 1, 1 + i // 7)) for i in range(n)]
        expected[f"S{s}"] = reference_backtest(rows, sell)
        frames += [
            (f"S{s}", 1, 1, 0.1, datetime(2020, 1, 1) + timedelta(minutes=i), r[2], r[1], r[0]) for i, r in enumerate(rows)
        ]
    schema = (
        "stockName string, deployment int, training int, threshold double, stockTime timestamp, day date, "
        "lastPrice double, code int"
    )
    marked = trades.mark_trades(spark.createDataFrame(frames, schema), F.col("code"), sell)
    for r in trades.summarise(marked).collect():
        assert (r.transactions, r.totalReturn, r.days) == (
            expected[r.stockName][0], pytest.approx(expected[r.stockName][1]), expected[r.stockName][2],
        )


def test_labels_and_slices(spark, make_bars):
    bars = make_bars([(1, 1, p, 1) for p in [10, 12, 11, 10.05, 11]])
    eod = labels.with_end_of_day(bars)
    assert [r.eodPrice for r in eod.collect()] == [11.0] * 5
    got = labels.label(eod, [0.5]).orderBy("stockTime").collect()
    assert [r.responseVariable for r in got] == [1, 2, 0, 1, 0]
    assert labels.join_end_of_day(bars).count() == 5
    grid = labels.Grid((2,), (2,), (0.5,))
    numbered = number_bars(bars)
    assert [r.bar_no for r in labels.training_slices(numbered, grid).orderBy("bar_no").collect()] == [1, 2]
    assert [r.bar_no for r in labels.deployment_slices(numbered, grid).orderBy("bar_no").collect()] == [2, 3, 4]
    hot = HotSymbols(spark.createDataFrame([("U", "year")], "stockName string, period string"), True)
    assert labels.labelled_slices(bars, grid, hot=hot).count() == 3


def test_backtest_needs_one_row_shuffle(spark, make_bars):
    grid = labels.Grid((1, 2), (2, 3), (0.5, 1.0))
    plan = trades.optimal_return(make_bars([(1, 1, 1, 1)]), grid)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_sweep_report(spark):
    schema = "stockName string, deployment int, training int, threshold double, transactions long, averageDailyReturn double"
    rows = [
        ("U", 389, 1945, 0.01, 4, 0.1), ("U", 389, 1945, 0.1, 2, 0.2), ("U", 389, 3890, 0.01, 0, -0.1),
        ("U", 389, 3890, 0.1, 6, 0.4), ("U", 389, 5835, 0.01, 1, 0.0),
    ]
    results = spark.createDataFrame(rows, schema)
    wide = trades.sweep_wide(results, [0.01, 0.1]).orderBy("training").collect()
    assert [tuple(r)[3:] for r in wide] == [(1945, 0.1, 4, 1945, 0.2, 2, 5.0), (3890, -0.1, 0, 3890, 0.4, 6, 10.0)]
    stats = {r.threshold: r for r in trades.sweep_stats(results).collect()}
    assert stats[0.1].sumReturn == pytest.approx(0.6) and stats[0.01].minReturn == -0.1
    scaled = trades.scale_transactions(results).orderBy("transactions").collect()
    assert [r.scaled for r in scaled] == pytest.approx([0, 1 / 6, 2 / 6, 4 / 6, 1])


def test_slices_start_after_the_warm_up(make_bars):
    bars = make_bars([(p, p, p, 1) for p in range(1, 131)])  # bar n closes at n
    grid = labels.Grid((5,), (10,), (0.5,))
    prices = [r.lastPrice for r in labels.labelled_slices(bars, grid, warmup=100).orderBy("stockTime").collect()]
    assert prices == [float(p) for p in range(105, 116)]
    parts = labels.both_slices(labels.numbered_after_warmup(bars, warmup=100), grid)
    training = parts.filter("part = 'training'").orderBy("stockTime").collect()
    assert [(r.bar_no, r.lastPrice) for r in training] == [(n, 100.0 + n) for n in range(1, 6)]
    assert trades.optimal_return(bars, grid).count() == 1
    assert trades.optimal_return(make_bars([(1, 1, 1, 1)] * 100), grid).count() == 0


def test_full_sweep_by_day_length():
    assert labels.Grid.of_day_bars(389) == labels.Grid()
    small = labels.Grid.of_day_bars(4)
    assert len(small.training) * len(small.deployment) * len(small.thresholds) == 240
