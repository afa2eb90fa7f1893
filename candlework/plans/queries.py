"""Every registered query: a function of (spark, sf_dir), and the SQL that checks it.

The bars come from the given tables: ``line_bars`` (minute bars per supplier, the larger set)
and ``event_bars`` (hourly bars per event type). Queries round intermediate values to six
digits so that they do not depend on the order in which an engine sums a frame.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.functions.columns import rnd, typical_price
from candlework.operators import dual_svm, features, forest, labels, models, profile
from candlework.operators import trades as backtest
from candlework.operators.history import BARS_PER_PARTITION, MAX_BARS_PER_TASK, HotSymbols, measure, number_bars, parts_for
from candlework.operators.indicators import ALL_INDICATORS, BOLLINGER, CCI, STOCHASTIC, Indicator
from candlework.plans import oracles as o
from candlework.schema import BAR_COLUMNS, BASE_COLUMNS, CODE_COLUMNS, KEY, MODEL_COLUMNS, POSITION_HOLD, SIGNAL_COLUMNS, WARMUP_BARS
from candlework.session import joining_dealt, shared_path, stored
from candlework.sources import bar_files, tables, wire
from candlework.streaming import live, ordered

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 6
DAY_GRID = labels.Grid(training=(50, 100), deployment=(24, 48), thresholds=(0.01, 0.1, 0.2, 0.5, 5.0))
MONTH_GRID = labels.Grid(training=(100, 200), deployment=(100, 300), thresholds=(1.0, 100.0))
MODEL_GRID = labels.Grid(training=(300,), deployment=(100, 200), thresholds=(5.0,))
FULL_GRID = labels.Grid.of_day_bars(4)  # all 240 points, on days as sparse as the given tables'
FULL_GRID_BARS = 25_000  # a partition: a bar lies in some 50 slices of the full grid
TRAINING_BARS = 300  # a forest of the registered queries learns from so many bars of each symbol after the warm-up

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    _queries[name] = query
    if sql is not None:
        _oracles[name] = sql


def line_bars(spark: SparkSession, sf: str, per_partition: int = BARS_PER_PARTITION) -> tuple[DataFrame, HotSymbols | None]:
    """Bars, and the hot symbols among them by a count of trades. Where none is hot, bars of a symbol lie together, so many
    a partition."""
    symbols = tables.line_symbols(spark, sf)
    hot = measure(symbols, MAX_BARS_PER_TASK)
    if hot is not None:
        return tables.line_bars(spark, sf, hot.parts, ("stockName", "stockTime")), hot
    return tables.line_bars(spark, sf, parts_for(symbols.count(), per_partition)), hot


def shared_bars(spark: SparkSession, sf: str) -> tuple[DataFrame, HotSymbols | None]:
    """Bars for ``sma_join``: its branches read one shuffle of the aggregate, where dealt trades would be aggregated in each."""
    return line_bars(spark, sf, 1 << 62)


def segmented_bars(spark: SparkSession, sf: str) -> tuple[DataFrame, HotSymbols | None]:
    """Bars with every symbol of more than 500 trades treated as hot."""
    hot = measure(tables.line_symbols(spark, sf), 500)
    return tables.line_bars(spark, sf, hot=hot), hot


def order_bars(spark: SparkSession, sf: str) -> tuple[DataFrame, HotSymbols | None]:
    """Daily bars with flat, one-priced and volume-less stretches."""
    bars = tables.order_bars(spark, sf)
    return bars, measure(bars, MAX_BARS_PER_TASK)


def event_bars(spark: SparkSession, sf: str) -> tuple[DataFrame, None]:
    """Hourly bars: at most one per hour and type, so their number does not grow with the events."""
    return tables.event_bars(spark, sf), None


def month() -> Column:
    return labels.day_of("month")


def line_base(spark: SparkSession, sf: str) -> DataFrame:
    return features.base_table(*line_bars(spark, sf), DIGITS)


def event_base(spark: SparkSession, sf: str) -> DataFrame:
    return features.base_table(*event_bars(spark, sf), DIGITS)


def sql(*parts: str, final: str) -> str:
    return o.ctes(*parts) + "\n" + final


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: rnd(n, DIGITS) for n in names})


# --- indicators -----------------------------------------------------------------------------

for _indicator in ALL_INDICATORS:
    _parts, _last, _columns = o.INDICATORS[_indicator.name]
    for _suffix, _source, _bars_sql in (
        ("", line_bars, o.LINE_BARS), ("_hourly", event_bars, o.EVENT_BARS), ("_undefined", order_bars, o.ORDER_BARS)
    ):

        def _run(spark, sf, indicator=_indicator, source=_source, columns=_columns):
            bars, hot = source(spark, sf)
            return features.indicator_table(bars, [indicator], columns.split(", "), hot, DIGITS)

        register(
            _indicator.name + _suffix, _run, sql(_bars_sql, *_parts, final=f"SELECT {_columns} FROM {_last}")
        )

_BASE_SQL = sql(o.LINE_BARS, *o.BASE, final=f"SELECT {o.BASE_LIST} FROM base")
_BASE_HOURLY_SQL = sql(o.EVENT_BARS, *o.BASE, final=f"SELECT {o.BASE_LIST} FROM base")

register("base_table_batch", line_base, _BASE_SQL)
register("base_table_batch_hourly", event_base, _BASE_HOURLY_SQL)
register(
    "base_table_stream",
    lambda spark, sf: features.feature_table(*line_bars(spark, sf), DIGITS),
    sql(o.LINE_BARS, *o.BASE, final=f"SELECT {o.FEATURE_LIST} FROM base"),
)
register("base_table_join", lambda spark, sf: features.base_table_by_joins(*line_bars(joining_dealt(spark), sf), DIGITS), _BASE_SQL)


def conflicting_copies(bars: DataFrame) -> DataFrame:
    """Every bar twice, the second time at higher prices and half the volume."""
    higher = bars.withColumns({c: F.col(c) + 1 for c in ("high", "low", "lastPrice")})
    return bars.unionByName(higher.withColumn("volume", F.col("volume") / 2))


def base_table_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """The base table of bars that all have a conflicting copy."""
    bars, hot = line_bars(spark, sf)
    return features.base_table(conflicting_copies(bars), hot, DIGITS, unique=False)


register("base_table_duplicates", base_table_duplicates, _BASE_SQL)
_BASE_UNDEFINED_SQL = sql(o.ORDER_BARS, *o.BASE, final=f"SELECT {o.BASE_LIST} FROM base")


def undefined_base(spark: SparkSession, sf: str) -> DataFrame:
    return features.base_table(*order_bars(spark, sf), DIGITS)


register("base_table_undefined", undefined_base, _BASE_UNDEFINED_SQL)
register(
    "null_counts_undefined",
    lambda spark, sf: profile.null_counts(undefined_base(spark, sf)),
    sql(
        o.ORDER_BARS,
        *o.BASE,
        final="SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in BASE_COLUMNS) + " FROM base",
    ),
)
register(
    "complete_rows_undefined",
    lambda spark, sf: profile.drop_incomplete(undefined_base(spark, sf)).select(*KEY, "D", "RSI", "chaikin"),
    sql(
        o.ORDER_BARS,
        *o.BASE,
        final="SELECT stockTime, stockName, D, RSI, chaikin FROM base WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in BASE_COLUMNS),
    ),
)


def base_table_segmented(spark: SparkSession, sf: str) -> DataFrame:
    """The base table with every symbol of more than 500 trades treated as hot."""
    return features.base_table(*segmented_bars(spark, sf), DIGITS)


register("base_table_segmented", base_table_segmented, _BASE_SQL)

register(
    "sma_join",
    lambda spark, sf: features.sma_by_joins(*shared_bars(spark, sf)),
    sql(
        o.LINE_BARS, *o.SMA, final="SELECT stockTime, stockName, lastPrice, SMA10, SMA100, SMA10lag, SMA100lag FROM sma2"
    ),
)


def _debug(indicator, columns: dict[str, str], extra: list[str], digits: int | None = 2) -> Query:
    """Rounded values beside their lags, for reading by eye."""

    def run(spark, sf):
        bars, hot = line_bars(spark, sf)
        table = features.indicator_table(bars, [indicator], [*KEY, *columns, *extra], hot, DIGITS)
        shown = [F.col(c).alias(n) if digits is None else rnd(c, digits).alias(n) for c, n in columns.items()]
        return table.select(*KEY, *shown, *extra)

    return run


register(
    "debug_bollinger",
    _debug(
        BOLLINGER,
        {
            "BB_middleBand": "middle", "BB_upperBound": "upper", "BB_lowerBound": "lower",
            "lastPriceLag": "before", "_upper_before": "upperLag", "_lower_before": "lowerLag",
        },
        ["lastPrice", "BB_signal"],
    ),
    sql(
        o.LINE_BARS,
        *o.BOLLINGER,
        final=f"""SELECT stockTime, stockName, {o.R('BB_middleBand', 2)} AS middle, {o.R('BB_upperBound', 2)} AS upper,
        {o.R('BB_lowerBound', 2)} AS lower, lastPriceLag AS before, {o.R('upper0', 2)} AS upperLag,
        {o.R('lower0', 2)} AS lowerLag, lastPrice, BB_signal FROM bb""",
    ),
)
register(
    "debug_stochastic",
    _debug(STOCHASTIC, {"D": "D", "_D_before": "Dlag"}, ["lastPrice", "stoch_signal"]),
    sql(
        o.LINE_BARS,
        *o.STOCHASTIC,
        final=f"SELECT stockTime, stockName, {o.R('D', 2)} AS D, {o.R('Dlag', 2)} AS Dlag, lastPrice, stoch_signal FROM stoch",
    ),
)
register(
    "debug_cci",
    _debug(CCI, {"CCI": "CCI", "_CCI_before": "CCIlag"}, ["CCI_signal"], None),
    sql(o.LINE_BARS, *o.CCI, final="SELECT stockTime, stockName, CCI, CCIlag, CCI_signal FROM cci"),
)

# --- projections, filters, sources ----------------------------------------------------------


def typical_prices(spark, sf):
    bars = tables.line_bars(spark, sf).withColumn("typicalPrice", typical_price())
    out = bars.select(*KEY, "typicalPrice", (F.col("typicalPrice") * F.col("volume")).alias("moneyFlow"))
    return rounded(out, "typicalPrice", "moneyFlow")


register(
    "typical_price",
    typical_prices,
    sql(
        o.LINE_BARS,
        final=f"""SELECT stockTime, stockName, {o.R('(high + low + lastPrice) / 3', 6)} AS typicalPrice,
        {o.R('(high + low + lastPrice) / 3 * volume', 6)} AS moneyFlow FROM bars""",
    ),
)
register(
    "last_price",
    lambda spark, sf: tables.line_bars(spark, sf).select("lastPrice"),
    sql(o.LINE_BARS, final="SELECT lastPrice FROM bars"),
)
register(
    "symbol_filter",
    lambda spark, sf: event_base(spark, sf).filter(F.col("stockName") == "click").select(*KEY, "CCI", "CCI_signal"),
    sql(o.EVENT_BARS, *o.CCI, final="SELECT stockTime, stockName, CCI, CCI_signal FROM cci WHERE stockName = 'click'"),
)
register(
    "analysis_names",
    lambda spark, sf: bar_files.rename_for_analysis(line_base(spark, sf)).select(
        "dateTime", "name", "stoch", "MFI", "willR", "BB_lowerbound"
    ),
    sql(
        o.LINE_BARS,
        *o.BASE,
        final="""SELECT stockTime AS "dateTime", stockName AS name, D AS stoch, moneyFlowIndex AS MFI, williamsR AS "willR",
        BB_lowerBound AS "BB_lowerbound" FROM base""",
    ),
)


def dedupe(spark, sf):
    bars = tables.line_bars(spark, sf)
    return features.dedupe_bars(conflicting_copies(bars))


register(
    "dedupe_bars",
    dedupe,
    sql(o.LINE_BARS, final="SELECT stockName, stockTime, priceOpen, high, low, lastPrice, number, volume FROM bars"),
)


def warmup_drop(spark, sf):
    bars, hot = line_bars(spark, sf)
    return features.drop_warmup(bars, WARMUP_BARS, hot).select(*BAR_COLUMNS)


register(
    "warmup_drop",
    warmup_drop,
    sql(
        o.LINE_BARS,
        final="""SELECT stockName, stockTime, priceOpen, high, low, lastPrice, number, volume FROM bars
        QUALIFY row_number() OVER (PARTITION BY stockName ORDER BY stockTime) > 100""",
    ),
)
register(
    "replay_order",
    lambda spark, sf: wire.replay(tables.line_bars(spark, sf).select("stockName", "stockTime", "lastPrice")),
    sql(
        o.LINE_BARS,
        final="""SELECT stockName, stockTime, lastPrice FROM bars
        WHERE stockTime >= (SELECT min(stockTime) FROM bars WHERE stockName = (SELECT min(stockName) FROM bars))
          AND stockTime < (SELECT max(stockTime) FROM bars WHERE stockName = (SELECT min(stockName) FROM bars))
        ORDER BY stockTime, stockName""",
    ),
)
register(
    "wire_format",
    lambda spark, sf: wire.format_wire(tables.event_bars(spark, sf)),
    sql(
        o.EVENT_BARS,
        final="""SELECT stockName || ', ' || strftime(stockTime, '%Y-%m-%dT%H:%M') || ', ' || priceOpen::VARCHAR || ', '
        || high::VARCHAR || ', ' || low::VARCHAR || ', ' || lastPrice::VARCHAR || ', ' || number::VARCHAR || ', '
        || volume::VARCHAR || chr(10) AS value FROM bars""",
    ),
)
_BARS_SQL = "SELECT stockName, stockTime, priceOpen, high, low, lastPrice, number, volume FROM bars"


def _plain_time(df: DataFrame) -> DataFrame:
    return df.withColumn("stockTime", F.col("stockTime").cast("timestamp_ntz"))


register(
    "wire_parse",
    lambda spark, sf: _plain_time(wire.parse_wire(wire.format_wire(tables.line_bars(spark, sf)))),
    sql(o.LINE_BARS, final=_BARS_SQL),
)
register(
    "wire_parse_text_time",
    lambda spark, sf: wire.parse_wire(wire.format_wire(tables.event_bars(spark, sf)), parse_time=False).select(
        "stockName", "stockTime", "lastPrice"
    ),
    sql(
        o.EVENT_BARS,
        final="SELECT stockName, strftime(stockTime, '%Y-%m-%dT%H:%M') AS stockTime, lastPrice FROM bars",
    ),
)


def bar_lines(spark, sf):
    """Bars written as file lines, among header lines and lines cut short, and parsed again."""
    bars = tables.line_bars(spark, sf)
    time = F.date_format("stockTime", bar_files.FILE_TIME)
    bars = bars.select("stockName", time.alias("time"), *[F.col(c).cast("string").alias(c) for c in BAR_COLUMNS[2:]])
    time, numbers = F.col("time"), [F.col(c) for c in BAR_COLUMNS[2:]]
    good = F.concat_ws(",", time, *numbers)
    header = F.concat_ws(",", F.lit("NAME"), *numbers)
    short = F.concat_ws(",", time, *numbers[:-1], F.lit(""))
    lines = bars.select("stockName", F.explode(F.array(good, header, short)).alias("value"))
    return _plain_time(bar_files.parse_bar_lines(lines))


register("bar_file_lines", bar_lines, sql(o.LINE_BARS, final=_BARS_SQL))

def window_frames(spark, sf):
    """The raw moving frames over prices and volume, all in one window pass."""
    bars, hot = line_bars(spark, sf)
    out = features.indicator_table(bars, [FRAMES], [*KEY, *FRAMES.outputs], hot)
    return out.withColumns({n: rnd(n, 4) for n in FRAMES.outputs})


FRAMES = Indicator(
    "window_frames",
    101,
    (
        lambda f, q: {"typical": typical_price()},
        lambda f, q: {
            "avg11": f.avg("lastPrice", 10),
            "avg101": f.avg("lastPrice", 100),
            "avg21": f.avg("lastPrice", 20),
            "sd21": F.stddev_samp("lastPrice").over(f.last(20)),
            "typical21": f.avg("typical", 20),
            "low14": F.min("low").over(f.last(13)),
            "high14": F.max("high").over(f.last(13)),
            "low15": F.min("low").over(f.last(14)),
            "high15": F.max("high").over(f.last(14)),
            "volume22": F.sum("volume").over(f.last(21)),
        },
    ),
    ("avg11", "avg101", "avg21", "sd21", "typical21", "low14", "high14", "low15", "high15", "volume22"),
)
_FRAMES_SQL = {
    "avg11": f"avg(lastPrice) {o.over(10)}",
    "avg101": f"avg(lastPrice) {o.over(100)}",
    "avg21": f"avg(lastPrice) {o.over(20)}",
    "sd21": f"stddev_samp(lastPrice) {o.over(20)}",
    "typical21": f"avg((high + low + lastPrice) / 3) {o.over(20)}",
    "low14": f"min(low) {o.over(13)}",
    "high14": f"max(high) {o.over(13)}",
    "low15": f"min(low) {o.over(14)}",
    "high15": f"max(high) {o.over(14)}",
    "volume22": f"sum(volume) {o.over(21)}",
}
register(
    "window_frames",
    window_frames,
    sql(
        o.LINE_BARS,
        final="SELECT stockTime, stockName, " + ", ".join(f"{o.R(x, 4)} AS {n}" for n, x in _FRAMES_SQL.items()) + " FROM bars",
    ),
)

LAGS = Indicator(
    "price_lags",
    11,
    (
        lambda f, q: {},
        lambda f, q: {f"lag{k}": f.lag("lastPrice", k) for k in range(1, 12)},
        lambda f, q: {"difference": rnd(F.col("lastPrice") - F.col("lag1"), 6)},
    ),
    ("difference", *[f"lag{k}" for k in range(1, 12)]),
)


def price_lags(spark, sf):
    """The first difference and the eleven lags of the price; 0 before the first bar."""
    bars, hot = line_bars(spark, sf)
    return features.indicator_table(bars, [LAGS], [*KEY, *LAGS.outputs], hot)


register(
    "price_lags",
    price_lags,
    sql(
        o.LINE_BARS,
        final=f"SELECT stockTime, stockName, {o.R('lastPrice - ' + o.lag('lastPrice'), 6)} AS difference, "
        + ", ".join(f"{o.lag('lastPrice', k)} AS lag{k}" for k in range(1, 12))
        + " FROM bars",
    ),
)


def scalar_functions(spark, sf):
    """Rounding, arithmetic, strings, casts and times on every bar."""
    c = F.col
    move = c("lastPrice") - c("priceOpen") - F.lit(0.005)
    bars = tables.line_bars(spark, sf).withColumns({"move": move, "third": c("lastPrice") / 3})
    return bars.select(
        *KEY,
        *[rnd("third", n).alias(f"round{n}") for n in (2, 3, 4, 6)],
        rnd(F.abs("move"), 6).alias("distance"),
        rnd(-c("move"), 6).alias("reversed"),
        F.bround(c("volume") * 0.5, 0).alias("halfEven"),
        F.element_at(F.split(F.concat_ws(",", "stockName", c("volume").cast("string")), ","), 2).try_cast("double").alias("parsed"),
        F.substring("stockName", 1, 2).alias("head"),
        c("stockName").contains("S1").alias("isS1"),
        F.try_divide(c("volume"), c("priceOpen") - c("lastPrice")).isNull().alias("undefined"),
        c("number").cast("int").cast("double").alias("wholeNumber"),
        F.to_date("stockTime").alias("day"),
        (c("stockTime") + F.expr("interval 1 minute")).alias("nextMinute"),
    )


register(
    "scalar_functions",
    scalar_functions,
    sql(
        o.LINE_BARS,
        final="SELECT stockTime, stockName, "
        + ", ".join(f"{o.R('lastPrice / 3', n)} AS round{n}" for n in (2, 3, 4, 6))
        + f""", {o.R('abs(lastPrice - priceOpen - 0.005::DOUBLE)', 6)} AS distance,
        {o.R('-(lastPrice - priceOpen - 0.005::DOUBLE)', 6)} AS reversed,
        round_even(volume * 0.5::DOUBLE, 0) AS halfEven,
        split_part(stockName || ',' || volume::VARCHAR, ',', 2)::DOUBLE AS parsed,
        substr(stockName, 1, 2) AS head, contains(stockName, 'S1') AS isS1,
        priceOpen - lastPrice = 0 AS undefined, number::INT::DOUBLE AS wholeNumber,
        stockTime::DATE AS day, stockTime + INTERVAL 1 MINUTE AS nextMinute FROM bars""",
    ),
)


def time_formats(spark, sf):
    """Every bar's time written and parsed back in the three formats of files, records and tables."""
    bars = tables.line_bars(spark, sf)
    out = bars.select(*KEY)
    for name, pattern in (("fileTime", bar_files.FILE_TIME), ("wireTime", wire.WIRE_TIME), ("tableTime", "yyyy-MM-dd HH:mm:ss")):
        written = F.date_format("stockTime", pattern)
        out = out.withColumn(name, F.try_to_timestamp(written, F.lit(pattern)).cast("timestamp_ntz"))
    return out


register(
    "time_formats",
    time_formats,
    sql(
        o.LINE_BARS,
        final="""SELECT stockTime, stockName,
        strptime(strftime(stockTime, '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M') AS fileTime,
        strptime(strftime(stockTime, '%Y-%m-%dT%H:%M'), '%Y-%m-%dT%H:%M') AS wireTime,
        strptime(strftime(stockTime, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS tableTime FROM bars""",
    ),
)
register(
    "sorted_bars",
    lambda spark, sf: bar_files.sort_all(tables.event_bars(spark, sf)),
    sql(o.EVENT_BARS, final=f"{_BARS_SQL} ORDER BY ALL"),
)

# --- profiles -------------------------------------------------------------------------------

register(
    "code_frequencies",
    lambda spark, sf: profile.code_frequencies(line_base(spark, sf)),
    sql(o.LINE_BARS, *o.BASE, final=o.frequencies("base")),
)
register(
    "null_counts",
    lambda spark, sf: profile.null_counts(line_base(spark, sf)),
    sql(
        o.LINE_BARS,
        *o.BASE,
        final="SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in BASE_COLUMNS) + " FROM base",
    ),
)
register(
    "complete_rows",
    lambda spark, sf: profile.drop_incomplete(line_base(spark, sf)).select(*KEY, "D", "RSI", "chaikin"),
    sql(
        o.LINE_BARS,
        *o.BASE,
        final="SELECT stockTime, stockName, D, RSI, chaikin FROM base WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in BASE_COLUMNS),
    ),
)
register(
    "min_max_scaled",
    lambda spark, sf: rounded(
        profile.min_max_scaled(tables.line_bars(spark, sf).select(*KEY, "volume"), "volume", "scaled"), "scaled"
    ),
    sql(
        o.LINE_BARS,
        final=f"""SELECT stockTime, stockName, volume, {o.R('''(volume - (SELECT min(volume) FROM bars))
        / nullif((SELECT max(volume) FROM bars) - (SELECT min(volume) FROM bars), 0)''', 6)} AS scaled FROM bars""",
    ),
)

# --- labels ---------------------------------------------------------------------------------

register(
    "eod_price",
    lambda spark, sf: labels.end_of_day(tables.line_bars(spark, sf), month()),
    sql(
        o.LINE_BARS,
        final="""SELECT stockName, date_trunc('month', stockTime)::DATE AS day, arg_max(lastPrice, stockTime) AS eodPrice
        FROM bars GROUP BY 1, 2""",
    ),
)
_EOD = """eod AS (SELECT stockName, stockTime::DATE AS day, arg_max(lastPrice, stockTime) AS eodPrice FROM bars GROUP BY 1, 2)"""
register(
    "day_join",
    lambda spark, sf: labels.join_end_of_day(tables.line_bars(spark, sf).select(*KEY, "lastPrice")),
    sql(
        o.LINE_BARS,
        _EOD,
        final="""SELECT b.stockName, stockTime::DATE AS day, stockTime, lastPrice, eodPrice FROM bars b
        JOIN eod e ON b.stockName = e.stockName AND b.stockTime::DATE = e.day""",
    ),
)


def response_variable(spark, sf):
    bars = labels.with_end_of_day(tables.line_bars(spark, sf).select(*KEY, "lastPrice"), month())
    out = labels.label(bars, DAY_GRID.thresholds)
    return out.select(*KEY, "threshold", "lastPrice", "eodPrice", "responseVariable")


register(
    "response_variable",
    response_variable,
    sql(
        o.LINE_BARS,
        "eod AS (SELECT stockName, date_trunc('month', stockTime)::DATE AS day, arg_max(lastPrice, stockTime) AS eodPrice"
        " FROM bars GROUP BY 1, 2)",
        f"thresholds AS (SELECT * FROM (VALUES {', '.join(f'({t}::DOUBLE)' for t in DAY_GRID.thresholds)}) v(threshold))",
        final="""SELECT stockTime, b.stockName, threshold, lastPrice, eodPrice,
        CASE WHEN lastPrice - eodPrice >= threshold THEN 2 WHEN eodPrice - lastPrice >= threshold THEN 1 ELSE 0 END
        AS responseVariable
        FROM bars b JOIN eod e ON b.stockName = e.stockName AND date_trunc('month', b.stockTime)::DATE = e.day
        CROSS JOIN thresholds""",
    ),
)


def signals_with_label(spark, sf):
    bars, hot = line_bars(spark, sf)
    table = features.base_table(bars, hot, DIGITS).select(*KEY, "lastPrice", *SIGNAL_COLUMNS)
    label = labels.response(F.lit(1.0)).alias("label")
    return labels.numbered_days(table, month(), hot, WARMUP_BARS).select("*", label)


_LABELLED_SIGNALS = [
    *o.BASE,
    o.after_warmup("base"),
    """labelled AS (SELECT base.*, CASE WHEN lastPrice - eodPrice >= 1 THEN 2 WHEN eodPrice - lastPrice >= 1 THEN 1 ELSE 0 END
  AS label FROM (SELECT *, last_value(lastPrice) OVER (PARTITION BY stockName, date_trunc('month', stockTime)
  ORDER BY stockTime ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS eodPrice FROM warm) base)""",
]
register(
    "label_binarise",
    lambda spark, sf: signals_with_label(spark, sf).select(*SIGNAL_COLUMNS, labels.label_binary("label").alias("label")),
    sql(
        o.LINE_BARS,
        *_LABELLED_SIGNALS,
        final=f"SELECT {o.SIGNAL_LIST}, CASE WHEN label IN (1, 2) THEN 1 ELSE -1 END AS label FROM labelled",
    ),
)

register(
    "position_codes",
    lambda spark, sf: signals_with_label(spark, sf)
    .select(*KEY, "lastPrice", labels.position("label").alias("position"))
    .filter(F.col("position") != POSITION_HOLD),
    sql(
        o.LINE_BARS,
        *_LABELLED_SIGNALS,
        final="SELECT stockTime, stockName, lastPrice, label + 1 AS position FROM labelled WHERE label <> 0",
    ),
)


def model_columns(spark, sf):
    """Price, features and label: what a forest is trained on."""
    bars, hot = line_bars(spark, sf)
    table = labels.numbered_days(features.base_table(bars, hot, DIGITS), month(), hot, WARMUP_BARS)
    return table.select(*MODEL_COLUMNS, labels.response(F.lit(1.0)).alias("responseVariable"))


register(
    "model_columns",
    model_columns,
    sql(
        o.LINE_BARS,
        *_LABELLED_SIGNALS,
        final=f"SELECT lastPrice, {o.FEATURE_LIST}, label AS responseVariable FROM labelled",
    ),
)

# --- slices, trades, sweep ------------------------------------------------------------------


def param_grid(spark, sf):
    """Every point of the full sweep with the training and deployment bars it finds per symbol."""
    grid = labels.Grid()
    bars, hot = line_bars(spark, sf)
    sizes = bars.groupBy("stockName").agg(F.count("*").alias("bars"))
    points = F.explode(grid.slices()).alias("s")
    t, d = F.col("s.training"), F.col("s.deployment")
    found = F.greatest(F.lit(0), F.least(F.col("bars"), t + d) - t + 1)
    return sizes.select("stockName", "bars", points).select(
        "stockName",
        t.alias("training"),
        d.alias("deployment"),
        F.explode(F.array(*map(F.lit, grid.thresholds))).alias("threshold"),
        F.least(F.col("bars"), t).cast("long").alias("trainingBars"),
        found.cast("long").alias("deploymentBars"),
    )


_FULL = labels.Grid()
register(
    "param_grid",
    param_grid,
    sql(
        o.LINE_BARS,
        "sizes AS (SELECT stockName, count(*) AS bars FROM bars GROUP BY 1)",
        f"t AS (SELECT * FROM (VALUES {', '.join(f'({x})' for x in _FULL.training)}) v(training))",
        f"d AS (SELECT * FROM (VALUES {', '.join(f'({x})' for x in _FULL.deployment)}) v(deployment))",
        f"h AS (SELECT * FROM (VALUES {', '.join(f'({x}::DOUBLE)' for x in _FULL.thresholds)}) v(threshold))",
        final="""SELECT stockName, training, deployment, threshold, least(bars, training)::BIGINT AS trainingBars,
        greatest(0, least(bars, training + deployment) - training + 1)::BIGINT AS deploymentBars
        FROM sizes CROSS JOIN t CROSS JOIN d CROSS JOIN h""",
    ),
)


def slice_rows(spark, sf):
    bars, hot = line_bars(spark, sf)
    numbered = labels.numbered_after_warmup(bars.select(*KEY, "lastPrice"), hot, WARMUP_BARS)
    return labels.both_slices(numbered, MONTH_GRID).select("part", *KEY, "bar_no", "training", "deployment", "lastPrice")


_MONTH_SLICES = o.labelled(o.LINE_BARS, "month", MONTH_GRID.training, MONTH_GRID.deployment, MONTH_GRID.thresholds)
register(
    "slice_rows",
    slice_rows,
    sql(
        *_MONTH_SLICES[:2],
        _MONTH_SLICES[4],
        final="""SELECT 'training' AS part, stockTime, stockName, bar_no, training, deployment, lastPrice
        FROM numbered JOIN slices ON bar_no BETWEEN 1 AND training
        UNION ALL SELECT 'deployment', stockTime, stockName, bar_no, training, deployment, lastPrice
        FROM numbered JOIN slices ON bar_no BETWEEN training AND training + deployment""",
    ),
)


def line_slices(spark, sf):
    bars, hot = line_bars(spark, sf)
    return labels.labelled_slices(bars, MONTH_GRID, month(), hot, warmup=WARMUP_BARS)


def marked(spark, sf):
    return backtest.mark_trades(line_slices(spark, sf), F.col("responseVariable"), sell_at_day_end=True)


_TRADE_KEYS = ["stockName", "deployment", "training", "threshold", "stockTime"]
register(
    "trades",
    lambda spark, sf: backtest.trades(marked(spark, sf)).select(
        *_TRADE_KEYS, "position", "switchPrice", "returnPrice"
    ),
    sql(
        *_MONTH_SLICES,
        *o.TRADES,
        final=f"SELECT {', '.join(_TRADE_KEYS)}, position, switchPrice, returnPrice FROM t7",
    ),
)
register(
    "trade_returns",
    lambda spark, sf: rounded(
        backtest.trade_returns(marked(spark, sf)).select(*_TRADE_KEYS, "returnPrice", "nextPrice", "return"), "return"
    ),
    sql(
        *_MONTH_SLICES,
        *o.TRADES,
        final=f"""SELECT {', '.join(_TRADE_KEYS)}, returnPrice, nextPrice, {o.R('ret', 6)} AS "return"
        FROM t8 WHERE nextPrice IS NOT NULL""",
    ),
)

_SWEEP_DOUBLES = ["totalReturn", "meanReturn", "sdReturn", "averageDailyReturn"]


def _sweep_sql(table_sql: list[str], final: str) -> str:
    return sql(*table_sql, *o.TRADES, *o.SWEEP, final=final)


_SWEEP_SELECT = "SELECT stockName, deployment, training, threshold, days, transactions, " + ", ".join(
    f"{o.R(c, 6)} AS {c}" for c in _SWEEP_DOUBLES
) + " FROM sweep"
_DAY_SLICES = o.labelled(o.EVENT_BARS, "day", DAY_GRID.training, DAY_GRID.deployment, DAY_GRID.thresholds)


def optimal_return(spark, sf):
    bars, hot = line_bars(spark, sf)
    return backtest.optimal_return(bars, MONTH_GRID, month(), hot)


def optimal_return_hourly(spark, sf):
    return backtest.optimal_return(tables.event_bars(spark, sf), DAY_GRID, hot=None)


def optimal_return_segmented(spark, sf):
    """The same with every symbol of more than 500 trades treated as hot."""
    bars, hot = segmented_bars(spark, sf)
    return backtest.optimal_return(bars, MONTH_GRID, month(), hot)


register(
    "optimal_return_segmented",
    lambda spark, sf: rounded(optimal_return_segmented(spark, sf), *_SWEEP_DOUBLES),
    _sweep_sql(_MONTH_SLICES, _SWEEP_SELECT),
)
register(
    "optimal_return",
    lambda spark, sf: rounded(optimal_return(spark, sf), *_SWEEP_DOUBLES),
    _sweep_sql(_MONTH_SLICES, _SWEEP_SELECT),
)
register(
    "optimal_return_hourly",
    lambda spark, sf: rounded(optimal_return_hourly(spark, sf), *_SWEEP_DOUBLES),
    _sweep_sql(_DAY_SLICES, _SWEEP_SELECT),
)


def optimal_return_full_grid(spark, sf):
    """All 240 points: six deployment lengths, ten training lengths, four thresholds."""
    bars, hot = line_bars(spark, sf, FULL_GRID_BARS)
    return backtest.optimal_return(bars, FULL_GRID, month(), hot)


register(
    "optimal_return_full_grid",
    lambda spark, sf: rounded(optimal_return_full_grid(spark, sf), *_SWEEP_DOUBLES),
    _sweep_sql(
        o.labelled(o.LINE_BARS, "month", FULL_GRID.training, FULL_GRID.deployment, FULL_GRID.thresholds), _SWEEP_SELECT
    ),
)


def signal_slices(spark, sf):
    """Deployment slices with the stochastic signal in the place of a model's prediction."""
    bars, hot = line_bars(spark, sf)
    table = features.indicator_table(bars, [STOCHASTIC], [*KEY, "lastPrice", "stoch_signal"], hot, DIGITS)
    slices = labels.labelled_slices(table, MONTH_GRID, month(), hot, keep=["stoch_signal"], warmup=WARMUP_BARS)
    return slices.withColumn("prediction", F.col("stoch_signal"))


_SIGNAL_SLICES = [
    o.LINE_BARS,
    *o.STOCHASTIC,
    *o.labelled("", "month", MONTH_GRID.training, MONTH_GRID.deployment, MONTH_GRID.thresholds, "stoch", ", stoch_signal"),
]
register(
    "predicted_return_signal",
    lambda spark, sf: rounded(models.predicted_return(signal_slices(spark, sf)), *_SWEEP_DOUBLES),
    sql(*_SIGNAL_SLICES, *o.trades("stoch_signal", False), *o.SWEEP, final=_SWEEP_SELECT),
)


def sweep_confusion(spark, sf):
    """Accuracy, kappa, recall and precision at every point of the sweep."""
    scored = signal_slices(spark, sf).withColumnRenamed("responseVariable", "label")
    stats = profile.confusion_stats(scored, [0, 1, 2], by=backtest.SLICE_KEYS)
    return rounded(stats, *[c for c in stats.columns if c not in (*backtest.SLICE_KEYS, "rows")])


register(
    "sweep_confusion",
    sweep_confusion,
    sql(
        *_SIGNAL_SLICES,
        "scored AS (SELECT *, responseVariable AS label, stoch_signal AS prediction FROM marked)",
        final=o.confusion("scored", [0, 1, 2], ", ".join(backtest.SLICE_KEYS)),
    ),
)


def sweep_pivot(spark, sf):
    wide = backtest.sweep_wide(optimal_return(spark, sf), MONTH_GRID.thresholds)
    return rounded(wide, "Return", "Return2", "trainingDays")


register(
    "sweep_pivot",
    sweep_pivot,
    _sweep_sql(
        _MONTH_SLICES,
        f"""SELECT stockName, deployment, training,
        max(training) FILTER (threshold = 1.0) AS Period, {o.R('max(averageDailyReturn) FILTER (threshold = 1.0)', 6)} AS "Return",
        max(transactions) FILTER (threshold = 1.0) AS Transactions,
        max(training) FILTER (threshold = 100.0) AS Period2, {o.R('max(averageDailyReturn) FILTER (threshold = 100.0)', 6)} AS Return2,
        max(transactions) FILTER (threshold = 100.0) AS Transactions2, {o.R('training / 389::DOUBLE', 6)} AS trainingDays
        FROM sweep GROUP BY stockName, deployment, training HAVING count(*) = 2""",
    ),
)
register(
    "sweep_stats",
    lambda spark, sf: rounded(
        backtest.sweep_stats(optimal_return(spark, sf)), "sumReturn", "maxReturn", "minReturn"
    ),
    _sweep_sql(
        _MONTH_SLICES,
        f"""SELECT stockName, deployment, threshold, {o.R('sum(averageDailyReturn)', 6)} AS sumReturn,
        {o.R('max(averageDailyReturn)', 6)} AS maxReturn, {o.R('min(averageDailyReturn)', 6)} AS minReturn,
        sum(transactions)::BIGINT AS sumTransactions, sum(training)::BIGINT AS sumPeriod
        FROM sweep GROUP BY stockName, deployment, threshold""",
    ),
)
register(
    "scaled_transactions",
    lambda spark, sf: rounded(
        backtest.scale_transactions(optimal_return(spark, sf)), "scaled", "shareOfMost"
    ),
    _sweep_sql(
        _MONTH_SLICES,
        f"""SELECT stockName, deployment, training, threshold, transactions,
        {o.R('(transactions - lo)::DOUBLE / nullif(hi - lo, 0)', 6)} AS scaled,
        {o.R('transactions::DOUBLE / nullif(hi, 0)', 6)} AS shareOfMost
        FROM (SELECT *, min(transactions) OVER (PARTITION BY stockName, deployment) AS lo,
              max(transactions) OVER (PARTITION BY stockName, deployment) AS hi FROM sweep)""",
    ),
)

# --- confusion and models -------------------------------------------------------------------


def direction_against_label(spark, sf):
    """The crossover signal taken as a prediction of the label."""
    return signals_with_label(spark, sf).select("label", F.col("SMA_signal").alias("prediction"))


_SCORED = [*_LABELLED_SIGNALS, "scored AS (SELECT label, SMA_signal AS prediction FROM labelled)"]
register(
    "confusion_counts",
    lambda spark, sf: profile.confusion_counts(direction_against_label(spark, sf)),
    sql(o.LINE_BARS, *_SCORED, final="SELECT label, prediction, count(*) AS n FROM scored GROUP BY 1, 2"),
)
register(
    "confusion_matrix",
    lambda spark, sf: profile.confusion_matrix(direction_against_label(spark, sf), [0, 1, 2]),
    sql(
        o.LINE_BARS,
        *_SCORED,
        final="SELECT prediction, "
        + ", ".join(f"count(*) FILTER (label = {k}) AS label_{k}" for k in (0, 1, 2))
        + " FROM scored GROUP BY prediction",
    ),
)


def confusion_stats(spark, sf):
    stats = profile.confusion_stats(direction_against_label(spark, sf), [0, 1, 2])
    return rounded(stats, *[c for c in stats.columns if c != "rows"])


register("confusion_stats", confusion_stats, sql(o.LINE_BARS, *_SCORED, final=o.confusion("scored", [0, 1, 2])))


def signal_against_label(spark, sf):
    """The same per symbol."""
    return signals_with_label(spark, sf).select("stockName", "label", F.col("SMA_signal").alias("prediction"))


def confusion_tests(spark, sf):
    """The signal's accuracy of each symbol with its exact interval and tests."""
    stats = profile.confusion_tests(signal_against_label(spark, sf), [0, 1, 2], ["stockName"])
    return rounded(stats, *[c for c in stats.columns if c not in ("stockName", "rows", "symmetry_degrees")])


def confusion_by_class(spark, sf):
    stats = profile.class_stats(signal_against_label(spark, sf), [0, 1, 2], ["stockName"])
    return rounded(stats, *[c for c in stats.columns if c not in ("stockName", "class")])


_SYMBOL_SCORED = [*_LABELLED_SIGNALS, "scored AS (SELECT stockName, label, SMA_signal AS prediction FROM labelled)"]
register("confusion_tests", confusion_tests, o.confusion_tests([o.LINE_BARS, *_SYMBOL_SCORED], "scored", "stockName"))
register("confusion_by_class", confusion_by_class, sql(o.LINE_BARS, *_SYMBOL_SCORED, final=o.class_stats("scored", "stockName")))


def _row_key() -> list[Column]:
    return [F.col("stockName"), F.date_format("stockTime", "yyyy-MM-dd HH:mm:ss")]


def exact_split(spark, sf):
    bars = tables.line_bars(spark, sf).select(*KEY, "lastPrice")
    return models.split_parts(bars, _row_key())


register(
    "exact_split",
    exact_split,
    sql(
        o.LINE_BARS,
        """ranked AS (SELECT stockTime, stockName, lastPrice, row_number() OVER (ORDER BY
        md5(stockName || '|' || strftime(stockTime, '%Y-%m-%d %H:%M:%S') || '|100')) AS rank FROM bars)""",
        final="""SELECT stockTime, stockName, lastPrice,
        CASE WHEN rank <= floor(0.8 * (SELECT count(*) FROM bars)) THEN 'train' ELSE 'test' END AS part FROM ranked""",
    ),
)


def svm_confusion(spark, sf):
    """The linear SVM on eight signals, trained on four fifths and evaluated on the rest."""
    rows = stored(
        signals_with_label(spark, sf).select(*KEY, *SIGNAL_COLUMNS, labels.label_binary("label").alias("label")), "svm"
    )
    train, test = models.exact_split(rows, _row_key())
    model = models.train_svm(train, SIGNAL_COLUMNS)
    return profile.confusion_counts(models.evaluate_svm(model, test))


register("svm_confusion", svm_confusion)


def _forest(spark, sf, feature_columns):
    """A forest over every symbol's first TRAINING_BARS bars after the warm-up, and the table to apply it to."""
    bars, hot = line_bars(spark, sf)
    table = features.base_table(bars, hot, DIGITS)
    numbered = stored(labels.numbered_days(table, month(), hot, WARMUP_BARS), "forest")
    label = labels.response(F.lit(5.0)).alias("label")
    train = numbered.filter(F.col("bar_no") <= TRAINING_BARS).select(*feature_columns, label)
    return models.train_forest(train, feature_columns), numbered.select("*", label)


def rf_predict(spark, sf):
    """Confusion counts of the forest on the bars after its training slice."""
    model, table = _forest(spark, sf, MODEL_COLUMNS)
    rest = table.filter(F.col("bar_no") > TRAINING_BARS)
    return profile.confusion_counts(models.score(rest, model, MODEL_COLUMNS))


register("rf_predict", rf_predict)


def rf_importance(spark, sf):
    model, _ = _forest(spark, sf, MODEL_COLUMNS)
    return models.importance(model, spark)


register("rf_importance", rf_importance)


def predicted_return(spark, sf):
    """The sweep on the forest's predictions."""
    bars, hot = line_bars(spark, sf)
    table = features.base_table(bars, hot, DIGITS)
    return models.predicted_return(models.predicted_slices(table, MODEL_GRID, month(), hot))


register("predicted_return", predicted_return)


def batch_scoring(spark, sf):
    """Every bar scored by a forest stored and loaded again."""
    model, table = _forest(spark, sf, CODE_COLUMNS)
    path = shared_path(spark, "model")
    models.save_model(model, path)
    return models.score(table, models.load_model(path), CODE_COLUMNS).select(*KEY, "prediction")


register("batch_scoring", batch_scoring)

# Models that learn a rule: each row's right prediction is known, so SQL can state it. With all features tried at every
# node, a forest's first split is the rule itself.


def _rule() -> Column:
    return F.when(F.col("stoch_direction") == 1, 1).otherwise(2)


_RULE_SQL = "CASE WHEN stoch_direction = 1 THEN 1 ELSE 2 END"


def _rule_forest(spark, sf):
    """A forest stored after learning the rule from training bars and loaded again, and all bars after the warm-up."""
    bars, hot = line_bars(spark, sf)
    table = features.base_table(bars, hot, DIGITS).select(*KEY, *CODE_COLUMNS)
    numbered = stored(labels.numbered_after_warmup(table, hot, WARMUP_BARS), "rule")
    train = numbered.filter(F.col("bar_no") <= TRAINING_BARS).withColumn("label", _rule())
    path = shared_path(spark, "model")
    models.save_model(models.train_forest(train, CODE_COLUMNS, subset="all"), path)
    return models.load_model(path), numbered


def rf_learns_rule(spark, sf):
    model, numbered = _rule_forest(spark, sf)
    return models.score(numbered, model, CODE_COLUMNS).select(*KEY, "prediction")


register(
    "rf_learns_rule",
    rf_learns_rule,
    sql(
        o.LINE_BARS,
        *o.BASE,
        o.after_warmup("base"),
        final=f"SELECT stockTime, stockName, ({_RULE_SQL})::DOUBLE AS prediction FROM warm",
    ),
)


def rf_rule_importance(spark, sf):
    """All importance falls to the feature that is the rule."""
    model, _ = _rule_forest(spark, sf)
    return rounded(models.importance(model, spark, CODE_COLUMNS), "importance")


_OTHERS = sorted(c for c in CODE_COLUMNS if c != "stoch_direction")[:11]
register(
    "rf_rule_importance",
    rf_rule_importance,
    "SELECT * FROM (VALUES ('stoch_direction', 1.0::DOUBLE), "
    + ", ".join(f"('{c}', 0.0::DOUBLE)" for c in _OTHERS)
    + ") v(feature, importance)",
)


# Forests of all 40 fits of the full grid, grown and applied together.

SWEEP_TREES, SWEEP_DEPTH = 25, 6


def _full_sweep(spark, sf, **options):
    bars, hot = line_bars(spark, sf)
    table = features.base_table(bars, hot, DIGITS)
    return models.predicted_sweep(table, FULL_GRID, month(), hot, trees=SWEEP_TREES, depth=SWEEP_DEPTH, **options)


def predicted_return_full_grid(spark, sf):
    """The sweep on predictions at all 240 points, a forest for each of 40 training lengths and thresholds."""
    return models.predicted_return(_full_sweep(spark, sf, sliced=False), FULL_GRID)


register("predicted_return_full_grid", predicted_return_full_grid)


def predicted_confusion_full_grid(spark, sf):
    """The confusion statistics of the predictions at all 240 points."""
    counted = models.predicted_confusion(_full_sweep(spark, sf, sliced=False), FULL_GRID)
    return profile.confusion_stats(counted, [0, 1, 2], by=["deployment", "training", "threshold"], count="n")


register("predicted_confusion_full_grid", predicted_confusion_full_grid)


def _pair_rule() -> Column:
    """A rule of two features, which takes trees of two levels."""
    return F.when(F.col("stoch_direction") != 1, 0).when(F.col("SMA_direction") == 1, 1).otherwise(2)


_PAIR_RULE_SQL = "CASE WHEN stoch_direction <> 1 THEN 0 WHEN SMA_direction = 1 THEN 1 ELSE 2 END"


def predicted_return_rule(spark, sf):
    """All 240 points traded by forests that have learnt the rule of two features from each of their training slices."""
    bars, hot = line_bars(spark, sf)
    table = features.base_table(bars, hot, DIGITS).select(*KEY, "lastPrice", *CODE_COLUMNS)
    scored = models.predicted_sweep(
        table, FULL_GRID, month(), hot, CODE_COLUMNS, trees=5, depth=2, tried=len(CODE_COLUMNS), target=_pair_rule(), sliced=False
    )
    return rounded(models.predicted_return(scored, FULL_GRID), *_SWEEP_DOUBLES)


register(
    "predicted_return_rule",
    predicted_return_rule,
    sql(
        o.LINE_BARS,
        *o.BASE,
        *o.labelled("", "month", FULL_GRID.training, FULL_GRID.deployment, FULL_GRID.thresholds, "base", f", ({_PAIR_RULE_SQL}) AS rule"),
        *o.trades("rule", False),
        *o.SWEEP,
        final=_SWEEP_SELECT,
    ),
)


def _key_of_row() -> list[Column]:
    return [F.col("stockName"), F.col("stockTime").cast("string")]


def forest_out_of_bag(spark, sf):
    """How many trees have a training bar out of their bag, and what those vote, for a forest that learns the rule."""
    bars, hot = line_bars(spark, sf)
    table = features.base_table(bars, hot, DIGITS).select(*KEY, *CODE_COLUMNS)
    train = labels.numbered_after_warmup(table, hot, WARMUP_BARS).filter(F.col("bar_no") <= TRAINING_BARS)
    edges = forest.bin_edges(train, CODE_COLUMNS)
    rows = forest.binned(train, CODE_COLUMNS, edges, [_pair_rule()], _key_of_row())
    model = forest.grow(rows, CODE_COLUMNS, edges, 1, trees=10, depth=2, tried=len(CODE_COLUMNS))
    return forest.out_of_bag(rows, model).groupBy("label", "prediction", "votes").agg(F.count("*").alias("n"))


_DRAWN = " + ".join(f"(h * {forest.factor(0, t)} % {forest.PRIME} < {forest.POISSON_STEPS[0]})::BIGINT" for t in range(10))
register(
    "forest_out_of_bag",
    forest_out_of_bag,
    sql(
        o.LINE_BARS,
        *o.BASE,
        o.after_warmup("base"),
        f"""train AS (SELECT {_PAIR_RULE_SQL} AS label,
        ('0x' || left(md5(stockName || '|' || strftime(stockTime, '%Y-%m-%d %H:%M:%S')), 7))::BIGINT + 1 AS h FROM warm
        QUALIFY row_number() OVER (PARTITION BY stockName ORDER BY stockTime) <= {TRAINING_BARS})""",
        f"drawn AS (SELECT label, {_DRAWN} AS votes FROM train)",
        final="""SELECT label, CASE WHEN votes > 0 THEN label ELSE -1 END AS prediction, votes, count(*) AS n
        FROM drawn GROUP BY label, votes""",
    ),
)


def forests_score_missing(spark, sf):
    """Two forests stored as a node table and applied in one scan: one has learnt the rule and meets missing features, which
    count as 0.0; the other has no training bars, so its result is -1.0."""
    bars, hot = line_bars(spark, sf)
    table = features.base_table(bars, hot, DIGITS).select(*KEY, *CODE_COLUMNS)
    hidden = lambda value: F.when(F.col("CCI_direction") == 1, value).otherwise(F.col("stoch_direction"))
    numbered = stored(labels.numbered_after_warmup(table, hot, WARMUP_BARS), "missing")
    train = numbered.filter(F.col("bar_no") <= TRAINING_BARS).withColumn("stoch_direction", hidden(F.lit(0)))
    edges = forest.bin_edges(train, CODE_COLUMNS)
    rows = forest.binned(train, CODE_COLUMNS, edges, [_pair_rule(), F.lit(None).cast("int")], _key_of_row())
    model = forest.grow(rows, CODE_COLUMNS, edges, 2, trees=5, depth=2, tried=len(CODE_COLUMNS))
    nodes = stored(forest.node_table(spark, model), "nodes")
    model = forest.from_nodes(nodes, CODE_COLUMNS, edges, 3, model.feature.shape)
    scored = forest.predict(numbered.withColumn("stoch_direction", hidden(F.lit(None).cast("int"))), model, missing=0.0, keep=KEY)
    return scored.select(*KEY, F.col("predictions")[0].cast("double").alias("prediction"), F.col("predictions")[1].cast("double").alias("untrained"))


register(
    "forests_score_missing",
    forests_score_missing,
    sql(
        o.LINE_BARS,
        *o.BASE,
        o.after_warmup("base"),
        final=f"""SELECT stockTime, stockName, (CASE WHEN CCI_direction = 1 THEN 0 ELSE {_PAIR_RULE_SQL} END)::DOUBLE AS prediction,
        -1.0::DOUBLE AS untrained FROM warm""",
    ),
)


def svm_learns_rule(spark, sf):
    """Labels 1 and -1 by the rule, four fifths learnt, the model stored and loaded, the rest evaluated."""
    bars, hot = line_bars(spark, sf)
    columns = [c for c in CODE_COLUMNS if c.endswith("_direction")]
    table = labels.numbered_after_warmup(features.base_table(bars, hot, DIGITS), hot, WARMUP_BARS)
    rows = stored(table.select(*KEY, *columns, F.when(_rule() == 1, 1).otherwise(-1).alias("label")), "svm-rule")
    train, test = models.exact_split(rows, _row_key())
    path = shared_path(spark, "model")
    models.save_model(models.train_svm(train, columns), path)
    return profile.confusion_counts(models.evaluate_svm(models.load_model(path), test))


_SVM_RULE_SQL = sql(
    o.LINE_BARS,
    *o.BASE,
    o.after_warmup("base"),
    f"""ranked AS (SELECT CASE WHEN {_RULE_SQL} = 1 THEN 1 ELSE -1 END AS label, row_number() OVER (ORDER BY
    md5(stockName || '|' || strftime(stockTime, '%Y-%m-%d %H:%M:%S') || '|100')) AS rank FROM warm)""",
    final="""SELECT label, label AS prediction, count(*) AS n FROM ranked
    WHERE rank > floor(0.8 * (SELECT count(*) FROM warm)) GROUP BY label""",
)
register("svm_learns_rule", svm_learns_rule, _SVM_RULE_SQL)


def svm_dual_learns_rule(spark, sf):
    """The same rule learnt by dual coordinate ascent: what the weights say of the rest."""
    bars, hot = line_bars(spark, sf)
    columns = [c for c in CODE_COLUMNS if c.endswith("_direction")]
    table = labels.numbered_after_warmup(features.base_table(bars, hot, DIGITS), hot, WARMUP_BARS)
    rows = stored(table.select(*KEY, *columns, F.when(_rule() == 1, 1).otherwise(-1).alias("label")), "svm-dual-rule")
    train, test = models.exact_split(rows, _row_key())
    model = dual_svm.train(train, columns, rounds=10, regularisation=0.0001, passes=5)
    return profile.confusion_counts(test.select("label", dual_svm.predicted(model.weights, columns).alias("prediction")))


register("svm_dual_learns_rule", svm_dual_learns_rule, _SVM_RULE_SQL)

# --- streams --------------------------------------------------------------------------------


def _staged_stream(spark: SparkSession, sf: str, parts: int = 4) -> DataFrame:
    """Hourly bars as a stream: written in ``parts`` consecutive spans of real time, a symbol's bars of one span in one
    file. Files are read in the order they were written, at most as many a batch as a span has, so no batch brings a
    symbol bars older than an earlier batch did, whatever months the bars cover."""
    bars = stored(tables.event_bars(spark, sf).withColumn("stockTime", F.col("stockTime").cast("timestamp")), "stream-source")
    return staged_spans(bars, parts)


def staged_spans(bars: DataFrame, parts: int = 4, files: int = 3) -> DataFrame:
    """Bars as a stream of ``parts`` spans of equal length between the first and the last time."""
    spark = bars.sparkSession
    path = shared_path(spark, "bars")
    low, high = bars.agg(F.min(F.unix_micros("stockTime")), F.max(F.unix_micros("stockTime"))).first()
    width = (high - low) // parts + 1 if low is not None else 1
    span = F.floor((F.unix_micros("stockTime") - F.lit(low or 0)) / width)
    for i in range(parts):
        bars.filter(span == i).repartition(files, "stockName").write.mode("append").parquet(path)
    return spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", files).parquet(path)


def _drained(stream: DataFrame, label: str) -> DataFrame:
    spark = stream.sparkSession
    path = shared_path(spark, label)
    live.start(stream, path + "/checkpoint", path + "/out", every=None).awaitTermination()
    return spark.read.parquet(path + "/out")


def stream_features(spark, sf):
    """The base table by the live path: state per symbol, over several micro-batches."""
    return _plain_time(_drained(live.live_base_table(_staged_stream(spark, sf), DIGITS), "live"))


register("stream_features", stream_features, _BASE_HOURLY_SQL)


def stream_scoring(spark, sf):
    """The live base table scored by a stored forest."""
    train = event_base(spark, sf)
    train = labels.with_end_of_day(train).withColumn("label", labels.response(F.lit(1.0)))
    path = shared_path(spark, "model")
    models.save_model(models.train_forest(train, CODE_COLUMNS), path)
    live_table = live.live_base_table(_staged_stream(spark, sf), DIGITS)
    scored = live.live_scores(live_table, models.load_model(path)).select(*KEY, "lastPrice", "prediction")
    return _drained(scored, "scores")


register("stream_scoring", stream_scoring)


def stream_learns_rule(spark, sf):
    """The live base table scored by a stored forest that has learnt the rule."""
    path = shared_path(spark, "model")
    train = event_base(spark, sf).withColumn("label", _rule())
    models.save_model(models.train_forest(train, CODE_COLUMNS, subset="all"), path)
    live_table = live.live_base_table(_staged_stream(spark, sf), DIGITS)
    scored = live.live_scores(live_table, models.load_model(path)).select(*KEY, "lastPrice", "prediction")
    return _plain_time(_drained(scored, "rule-scores"))


register(
    "stream_learns_rule",
    stream_learns_rule,
    sql(
        o.EVENT_BARS,
        *o.BASE,
        final=f"SELECT stockTime, stockName, lastPrice, ({_RULE_SQL})::DOUBLE AS prediction FROM base",
    ),
)


def stream_join(spark, sf):
    """Two live indicator streams joined on their key under a watermark."""
    bars = _staged_stream(spark, sf)
    table = bars.select(*KEY, "lastPrice", "high")
    other = bars.select(*KEY, "low", "volume")
    return _plain_time(_drained(live.join_live(table, other, "40 days"), "joined"))


register(
    "stream_join",
    stream_join,
    sql(o.EVENT_BARS, final="SELECT stockTime, stockName, lastPrice, high, low, volume FROM bars"),
)


# Event time: bars out of order within the tolerance, others late, a marker at the end that moves the watermark past all.

_TOLERANCE, _JITTER_HOURS, _LATE_EVERY, _LATE_REST = "3 days", 48, 97, 5


def _hour() -> Column:
    return F.floor(F.unix_micros("stockTime") / 3_600_000_000)


def _is_late(bars: DataFrame) -> Column:
    """Some bars of the first quarter of the time, which the fixture brings last."""
    low, high = bars.agg(F.min(F.unix_micros("stockTime")), F.max(F.unix_micros("stockTime"))).first()
    return (F.unix_micros("stockTime") < low + (high - low) // 4) & (_hour() % _LATE_EVERY == _LATE_REST)


_LATE_SQL = f"""(epoch_us(stockTime) < (SELECT min(epoch_us(stockTime)) + (max(epoch_us(stockTime)) - min(epoch_us(stockTime))) // 4 FROM bars)
  AND epoch_us(stockTime) // 3600000000 % {_LATE_EVERY} = {_LATE_REST})"""


def _disordered_stream(spark: SparkSession, sf: str, late: bool, parts: int = 2) -> DataFrame:
    """Hourly bars in micro-batches: each comes up to two days after newer ones, late ones after all others."""
    bars = stored(tables.event_bars(spark, sf).withColumn("stockTime", F.col("stockTime").cast("timestamp")), "stream-source")
    path = shared_path(spark, "bars")
    low, high = bars.agg(F.min(_hour()), F.max(_hour())).first()
    arrives = _hour() - F.lit(low or 0) + F.pmod(F.xxhash64("stockName", "stockTime"), F.lit(_JITTER_HOURS))
    width = ((high - low if low is not None else 0) + _JITTER_HOURS) // parts + 1
    held = _is_late(bars) if late and low is not None else F.lit(False)
    batches = [bars.where(~held & (F.floor(arrives / width) == i)) for i in range(parts)] + ([bars.where(held)] if late else [])
    last = bars.orderBy(F.desc("stockTime"), "stockName").limit(1).withColumn("stockName", F.lit("~end"))
    batches.append(last.withColumn("stockTime", F.col("stockTime") + F.expr("interval 60 days")))
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _ordered_outputs(spark, sf):
    path = shared_path(spark, "ordered")
    with ordered.rocksdb(spark):
        stream = ordered.ordered_base_table(_disordered_stream(spark, sf, True), _TOLERANCE, digits=DIGITS)
        ordered.start_with_side_table(stream, path + "/checkpoint", path + "/out", path + "/late").awaitTermination()
    return path


def stream_ordered(spark, sf):
    """The base table of bars that come out of order: those within the tolerance, in time order."""
    path = _ordered_outputs(spark, sf) + "/out"
    return _plain_time(spark.read.option("basePath", path).parquet(path + "/batch=*").select(*BASE_COLUMNS))


register(
    "stream_ordered",
    stream_ordered,
    sql(
        o.EVENT_BARS,
        f"kept AS (SELECT * FROM bars WHERE NOT {_LATE_SQL})",
        *[part.replace("FROM bars", "FROM kept") for part in o.BASE],
        final=f"SELECT {', '.join(BASE_COLUMNS)} FROM base",
    ),
)


def stream_late_bars(spark, sf):
    """The bars that came when the watermark had passed them, from the side table."""
    path = _ordered_outputs(spark, sf) + "/late"
    return _plain_time(spark.read.option("basePath", path).parquet(path + "/batch=*").drop("batch"))


register(
    "stream_late_bars",
    stream_late_bars,
    sql(o.EVENT_BARS, final=f"SELECT stockTime, stockName, high, low, lastPrice, volume FROM bars WHERE {_LATE_SQL}"),
)


def stream_indicator_join(spark, sf):
    """Eight live indicator streams, each with state of its own, joined on time and symbol."""
    path = shared_path(spark, "joined-indicators")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    with ordered.rocksdb(spark):
        spark.conf.set("spark.sql.shuffle.partitions", "2")  # fifteen stateful operators over a few symbols
        try:
            joined = ordered.joined_indicators(_disordered_stream(spark, sf, False), _TOLERANCE, digits=DIGITS)
            live.start(joined, path + "/checkpoint", path + "/out", every=None).awaitTermination()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return _plain_time(spark.read.parquet(path + "/out"))


register("stream_indicator_join", stream_indicator_join, _BASE_HOURLY_SQL)


@cache
def queries() -> dict[str, Query]:
    return dict(_queries)


@cache
def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
