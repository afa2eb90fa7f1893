"""DuckDB SQL for the registered queries, written independently of the DataFrame code."""

from __future__ import annotations

from candlework.schema import BASE_COLUMNS, CODE_COLUMNS, FEATURE_COLUMNS, SIGNAL_COLUMNS, WARMUP_BARS


def R(x: str, digits: int) -> str:
    if digits == 9:
        return f"(({x})::DECIMAL(28,9))::DOUBLE"
    return f"round(({x})::DECIMAL(28,9), {digits})::DOUBLE"


def over(n: int) -> str:
    return f"OVER (PARTITION BY stockName ORDER BY stockTime ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}, 0::DOUBLE) OVER (PARTITION BY stockName ORDER BY stockTime)"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p for p in parts if p)


LINE_BARS = f"""trades_in AS (
  SELECT 'S' || l_suppkey::VARCHAR AS stockName,
         l_shipdate + to_minutes(((l_orderkey * 7 + l_linenumber) % 390)::BIGINT) AS stockTime,
         {R('l_extendedprice / nullif(l_quantity, 0)', 2)} AS price, l_tax, l_discount, l_quantity,
         (l_orderkey * 8 + l_linenumber) * 1000 + l_partkey % 1000 AS seq
  FROM lineitem),
bars AS (
  SELECT stockName, stockTime, arg_min(price, seq) AS priceOpen,
         max({R('price * (1 + l_tax)', 2)}) AS high, min({R('price * (1 - l_discount)', 2)}) AS low,
         arg_max(price, seq) AS lastPrice, count(*)::DOUBLE AS number, sum(l_quantity) AS volume
  FROM trades_in GROUP BY stockName, stockTime)"""

EVENT_BARS = f"""bars AS (
  SELECT event_type AS stockName, date_trunc('hour', ts) AS stockTime, arg_min(value, ts) AS priceOpen,
         max(value) AS high, min(value) AS low, arg_max(value, ts) AS lastPrice,
         count(*)::DOUBLE AS number, {R('sum(value)', 2)} AS volume
  FROM events GROUP BY event_type, date_trunc('hour', ts))"""

SMA = [
    f"sma1 AS (SELECT *, {R(f'avg(lastPrice) {over(10)}', 4)} AS SMA10, {R(f'avg(lastPrice) {over(100)}', 4)} AS SMA100 FROM bars)",
    f"sma2 AS (SELECT *, {lag('SMA10')} AS SMA10lag, {lag('SMA100')} AS SMA100lag FROM sma1)",
    """sma AS (SELECT stockTime, stockName, lastPrice, SMA10, SMA100,
  CASE WHEN SMA10lag < SMA100lag AND SMA10 > SMA100 THEN 1
       WHEN SMA10lag >= SMA100lag AND SMA10 < SMA100 THEN 2 ELSE 0 END AS SMA_signal,
  CASE WHEN SMA10lag < lastPrice THEN 1 WHEN SMA10lag >= lastPrice THEN -1 ELSE 0 END AS SMA_direction
  FROM sma2)""",
]

BOLLINGER = [
    f"""bb1 AS (SELECT *, {R(f'avg(lastPrice) {over(20)}', 3)} AS mid, stddev_samp(lastPrice) {over(20)} AS sd,
  {lag('lastPrice')} AS before FROM bars)""",
    f"""bb2 AS (SELECT *, coalesce(mid, 0) AS BB_middleBand,
  {R('coalesce(mid + 2 * sd, 0)', 6)} AS BB_upperBound, {R('coalesce(mid - 2 * sd, 0)', 6)} AS BB_lowerBound FROM bb1)""",
    f"bb3 AS (SELECT *, {lag('BB_upperBound')} AS upper0, {lag('BB_lowerBound')} AS lower0 FROM bb2)",
    f"""bb AS (SELECT stockTime, stockName, lastPrice, {R('before', 2)} AS lastPriceLag,
  BB_lowerBound, BB_upperBound, BB_middleBand,
  CASE WHEN before <= upper0 AND lastPrice > BB_upperBound THEN 1
       WHEN before >= lower0 AND lastPrice < BB_lowerBound THEN 2 ELSE 0 END AS BB_signal,
  CASE WHEN lastPrice < BB_lowerBound THEN 1
       WHEN lastPrice < BB_upperBound AND lastPrice > BB_middleBand THEN 1
       WHEN lastPrice >= BB_upperBound THEN -1
       WHEN lastPrice <= BB_middleBand AND lastPrice >= BB_lowerBound THEN -1 ELSE 0 END AS BB_direction,
  upper0, lower0
  FROM bb3)""",
]

CCI = [
    "cci0 AS (SELECT *, (high + low + lastPrice) / 3 AS tp FROM bars)",
    f"cci1 AS (SELECT *, {R(f'tp - avg(tp) {over(20)}', 6)} AS off FROM cci0)",
    f"cci2 AS (SELECT *, avg(abs(off)) {over(5)} AS mad FROM cci1)",
    f"cci3 AS (SELECT *, coalesce({R('66.6666666667::DOUBLE * (off / nullif(mad, 0))', 6)}, 0) AS CCI FROM cci2)",
    f"cci4 AS (SELECT *, {lag('CCI')} AS CCIlag FROM cci3)",
    """cci AS (SELECT stockTime, stockName, CCI,
  CASE WHEN CCIlag >= -100 AND CCI < -100 THEN 1 WHEN CCIlag <= 100 AND CCI > 100 THEN 2 ELSE 0 END AS CCI_signal,
  CASE WHEN CCI <= -200 THEN 1 WHEN CCI > CCIlag AND CCI < 200 AND CCI > -200 THEN 1
       WHEN CCI >= 200 THEN -1 WHEN CCI <= CCIlag AND CCI < 200 AND CCI > -200 THEN -1 ELSE 0 END AS CCI_direction,
  CCIlag FROM cci4)""",
]

STOCHASTIC = [
    f"""st1 AS (SELECT *, {R(f'100 * ((lastPrice - min(low) {over(13)}) / nullif(max(high) {over(13)} - min(low) {over(13)}, 0))', 6)} AS K
  FROM bars)""",
    f"st2 AS (SELECT *, {R(f'avg(K) {over(2)}', 6)} AS D FROM st1)",
    f"st3 AS (SELECT *, {lag('D')} AS Dlag FROM st2)",
    """stoch AS (SELECT stockTime, stockName, lastPrice, D,
  CASE WHEN Dlag >= 20 AND D < 20 THEN 1 WHEN Dlag <= 80 AND D > 80 THEN 2 ELSE 0 END AS stoch_signal,
  CASE WHEN Dlag < D THEN 1 WHEN Dlag >= D THEN -1 ELSE 0 END AS stoch_direction, Dlag FROM st3)""",
]

_STRENGTH = [
    f"rs1 AS (SELECT *, {R('lastPrice - ' + lag('lastPrice'), 6)} AS diff FROM bars)",
    f"""rs2 AS (SELECT *, avg(CASE WHEN diff > 0 THEN diff ELSE 0 END) {over(13)} AS gain,
  avg(CASE WHEN diff < 0 THEN -diff ELSE 0 END) {over(13)} AS loss FROM rs1)""",
]

RSI = [
    *_STRENGTH,
    f"rs3 AS (SELECT *, {R('100 * gain / nullif(gain + loss, 0)', 6)} AS x FROM rs2)",
    f"rs4 AS (SELECT *, {lag('x')} AS x0 FROM rs3)",
    f"""rsi AS (SELECT stockTime, stockName, lastPrice, {R('x', 2)} AS RSI,
  CASE WHEN x < 20 AND x > 0 AND x < x0 THEN 1 WHEN x > 80 AND x < 100 AND x > x0 THEN 2 ELSE 0 END AS RSI_signal,
  CASE WHEN x <= 30 THEN 1 WHEN x >= x0 AND x > 30 AND x < 70 THEN 1
       WHEN x >= 70 THEN -1 WHEN x <= x0 AND x > 30 AND x < 70 THEN -1 ELSE 0 END AS RSI_direction FROM rs4)""",
]

RELATIVE_STRENGTH = [
    *_STRENGTH,
    f"""rs5 AS (SELECT *, CASE WHEN loss = 0 AND gain > 0 THEN 1 WHEN gain / nullif(loss, 0) > 100 THEN 1
  ELSE {R('gain / nullif(loss, 0)', 6)} END AS RS FROM rs2)""",
    f"strength AS (SELECT stockTime, stockName, RS, {lag('RS')} AS RSlag FROM rs5)",
]

MFI = [
    f"mf1 AS (SELECT *, (high + low + lastPrice) / 3 AS tp, {R('(high + low + lastPrice) / 3 * volume', 6)} AS flow FROM bars)",
    f"mf2 AS (SELECT *, {R('tp - ' + lag('tp'), 6)} AS diff FROM mf1)",
    f"""mf3 AS (SELECT *, avg(CASE WHEN diff > 0 THEN flow ELSE 0 END) {over(13)} AS inflow,
  avg(CASE WHEN diff < 0 THEN flow ELSE 0 END) {over(13)} AS outflow FROM mf2)""",
    f"mf4 AS (SELECT *, {R('100 * inflow / nullif(inflow + outflow, 0)', 6)} AS m FROM mf3)",
    f"mf5 AS (SELECT *, {lag('m')} AS m0 FROM mf4)",
    """mfi AS (SELECT stockTime, stockName, lastPrice, m AS moneyFlowIndex,
  CASE WHEN m < 20 THEN 1 WHEN m > 80 THEN 2 ELSE 0 END AS MFI_signal,
  CASE WHEN m <= 20 THEN 1 WHEN m > m0 AND m > 20 AND m < 80 THEN 1
       WHEN m >= 80 THEN -1 WHEN m <= m0 AND m > 20 AND m < 80 THEN -1 ELSE 0 END AS moneyFlowIndex_direction FROM mf5)""",
]

CHAIKIN = [
    """ch1 AS (SELECT *, CASE WHEN high - low > 0
  THEN (((lastPrice - low) - (high - lastPrice)) / nullif(high - low, 0)) * volume ELSE 0 END AS mfv FROM bars)""",
    f"ch2 AS (SELECT *, {R(f'sum(mfv) {over(21)} / nullif(sum(volume) {over(21)}, 0)', 9)} AS cmf FROM ch1)",
    f"ch3 AS (SELECT *, {R(f'avg(cmf) {over(3)} - avg(cmf) {over(10)}', 6)} AS chaikin FROM ch2)",
    f"ch4 AS (SELECT *, {lag('chaikin')} AS chaikin0 FROM ch3)",
    """chai AS (SELECT stockTime, stockName, lastPrice, chaikin,
  CASE WHEN chaikin0 <= 0 AND chaikin > 0 THEN 1 WHEN chaikin0 >= 0 AND chaikin < 0 THEN 2 ELSE 0 END AS chaikin_signal,
  CASE WHEN chaikin > 0 THEN 1 WHEN chaikin <= 0 THEN -1 ELSE 0 END AS chaikin_direction FROM ch4)""",
]

WILLIAMS_R = [
    f"""wr1 AS (SELECT *, {R(f'-100 * (max(high) {over(14)} - lastPrice) / nullif(max(high) {over(14)} - min(low) {over(14)}, 0)', 6)}
  AS williamsR FROM bars)""",
    f"wr2 AS (SELECT *, {lag('williamsR')} AS r0 FROM wr1)",
    """willr AS (SELECT stockTime, stockName, lastPrice, williamsR,
  CASE WHEN r0 >= -80 AND williamsR < -80 THEN 1 WHEN r0 <= -20 AND williamsR > -20 THEN 2 ELSE 0 END AS willR_signal,
  CASE WHEN r0 < williamsR THEN 1 WHEN r0 >= williamsR THEN -1 ELSE 0 END AS williamsR_direction FROM wr2)""",
]

_WEIGHTED = " + ".join(["10 * lastPrice", *[f"{10 - k} * {R(lag('lastPrice', k), 4)}" for k in range(1, 10)]])
WMA = [f"wma AS (SELECT stockTime, stockName, lastPrice, {R(f'({_WEIGHTED}) / 55', 6)} AS WMA10 FROM bars)"]

# query name -> (CTEs, final CTE, output columns)
INDICATORS = {
    "sma_crossover": (SMA, "sma", "stockTime, stockName, lastPrice, SMA10, SMA100, SMA_signal, SMA_direction"),
    "bollinger": (
        BOLLINGER,
        "bb",
        "stockTime, stockName, lastPrice, lastPriceLag, BB_lowerBound, BB_upperBound, BB_middleBand, BB_signal, BB_direction",
    ),
    "cci": (CCI, "cci", "stockTime, stockName, CCI, CCI_signal, CCI_direction"),
    "stochastic": (STOCHASTIC, "stoch", "stockTime, stockName, D, stoch_signal, stoch_direction"),
    "rsi": (RSI, "rsi", "stockTime, stockName, lastPrice, RSI, RSI_signal, RSI_direction"),
    "relative_strength_capped": (RELATIVE_STRENGTH, "strength", "stockTime, stockName, RS, RSlag"),
    "mfi": (MFI, "mfi", "stockTime, stockName, lastPrice, moneyFlowIndex, MFI_signal, moneyFlowIndex_direction"),
    "chaikin": (CHAIKIN, "chai", "stockTime, stockName, lastPrice, chaikin, chaikin_signal, chaikin_direction"),
    "williams_r": (WILLIAMS_R, "willr", "stockTime, stockName, lastPrice, williamsR, willR_signal, williamsR_direction"),
    "wma10": (WMA, "wma", "stockTime, stockName, lastPrice, WMA10"),
}

_JOIN = " ".join(f"JOIN {t} USING (stockTime, stockName)" for t in ("bb", "cci", "stoch", "rsi", "mfi", "chai", "willr"))
_PICK = ", ".join("sma.lastPrice" if c == "lastPrice" else c for c in BASE_COLUMNS)
BASE = [*SMA, *BOLLINGER, *CCI, *STOCHASTIC, *RSI, *MFI, *CHAIKIN, *WILLIAMS_R, f"base AS (SELECT {_PICK} FROM sma {_JOIN})"]

# --- labels and backtest ------------------------------------------------------------------


ORDER_BARS = """trades_in AS (
  SELECT o_orderpriority AS stockName, date_trunc('day', o_orderdate)::TIMESTAMP AS stockTime, o_orderkey,
         CASE WHEN month(o_orderdate) <= 3 THEN 100 ELSE floor(o_totalprice / 1000) END::DOUBLE AS price,
         CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 0 ELSE o_orderkey % 100 + 1 END::DOUBLE AS size
  FROM orders),
bars AS (
  SELECT stockName, stockTime, arg_min(price, o_orderkey) AS priceOpen, max(price) AS high, min(price) AS low,
         arg_max(price, o_orderkey) AS lastPrice, count(*)::DOUBLE AS number, sum(size) AS volume
  FROM trades_in GROUP BY stockName, stockTime)"""


def after_warmup(table: str, name: str = "warm") -> str:
    return f"""{name} AS (SELECT * FROM {table}
  QUALIFY row_number() OVER (PARTITION BY stockName ORDER BY stockTime) > {WARMUP_BARS})"""


def labelled(bars: str, day: str, training, deployment, thresholds, table: str = "bars", extra: str = "") -> list[str]:
    values = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    slices = ", ".join(f"({t}, {d})" for t in training for d in deployment)
    return [
        bars,
        f"""numbered AS (SELECT stockName, stockTime, lastPrice, date_trunc('{day}', stockTime)::DATE AS day{extra},
  row_number() OVER (PARTITION BY stockName ORDER BY stockTime) - {WARMUP_BARS} AS bar_no FROM {table}
  QUALIFY bar_no >= 1)""",
        "eod AS (SELECT stockName, day, arg_max(lastPrice, stockTime) AS eodPrice FROM numbered GROUP BY 1, 2)",
        f"thresholds AS (SELECT * FROM (VALUES {values}) v(threshold))",
        f"slices AS (SELECT * FROM (VALUES {slices}) v(training, deployment))",
        """marked AS (SELECT n.*, e.eodPrice, s.training, s.deployment, t.threshold,
  CASE WHEN n.lastPrice - e.eodPrice >= t.threshold THEN 2
       WHEN e.eodPrice - n.lastPrice >= t.threshold THEN 1 ELSE 0 END AS responseVariable
  FROM numbered n JOIN eod e USING (stockName, day)
  JOIN slices s ON n.bar_no BETWEEN s.training AND s.training + s.deployment CROSS JOIN thresholds t)""",
    ]


_K = "PARTITION BY stockName, deployment, training, threshold"
_TRADES = [
    f"t1 AS (SELECT *, lead(day) OVER ({_K} ORDER BY stockTime) AS day1 FROM marked)",
    "t2 AS (SELECT *, CASE WHEN day1 IS NULL THEN NULL {day_end} ELSE {code} + 1 END AS position FROM t1)",
    f"t3 AS (SELECT *, lag(position) OVER ({_K} ORDER BY stockTime) AS position0 FROM t2 WHERE position IS NULL OR position <> 1)",
    """t4 AS (SELECT *, CASE WHEN position <> position0 THEN lastPrice ELSE 0 END AS switchPrice FROM t3
  WHERE position IS NOT NULL AND position0 IS NOT NULL)""",
    f"""t5 AS (SELECT *, row_number() OVER ({_K} ORDER BY stockTime DESC) AS from_end,
  max(switchPrice) OVER ({_K}) AS highest FROM t4)""",
    """t6 AS (SELECT *, CASE WHEN from_end = 1 AND switchPrice = 0 AND highest > 0 THEN lastPrice ELSE switchPrice END
  AS returnPrice FROM t5)""",
    f"t7 AS (SELECT *, lead(returnPrice) OVER ({_K} ORDER BY stockTime) AS nextPrice FROM t6 WHERE returnPrice <> 0)",
    """t8 AS (SELECT *, (CASE WHEN position = 2 THEN 1 ELSE -1 END) * ((nextPrice - returnPrice) / abs(returnPrice)) AS ret FROM t7)""",
]


def trades(code: str, sell_at_day_end: bool) -> list[str]:
    day_end = "WHEN day <> day1 THEN 3" if sell_at_day_end else ""
    return [part.replace("{day_end}", day_end).replace("{code}", code) for part in _TRADES]


TRADES = trades("responseVariable", True)
SWEEP = [
    "days AS (SELECT stockName, deployment, training, threshold, count(DISTINCT day) AS days FROM marked GROUP BY ALL)",
    """counts AS (SELECT stockName, deployment, training, threshold, count(*) FILTER (switchPrice > 0) AS transactions
  FROM t4 GROUP BY ALL)""",
    """returns AS (SELECT stockName, deployment, training, threshold, sum(ret) AS total, avg(ret) AS mean,
  stddev_samp(ret) AS sd FROM t8 WHERE nextPrice IS NOT NULL GROUP BY ALL)""",
    """sweep AS (SELECT stockName, deployment, training, threshold, days, coalesce(transactions, 0) AS transactions,
  coalesce(total, 0) AS totalReturn, mean AS meanReturn, sd AS sdReturn, coalesce(total, 0) / days AS averageDailyReturn
  FROM days LEFT JOIN counts USING (stockName, deployment, training, threshold)
  LEFT JOIN returns USING (stockName, deployment, training, threshold))""",
]


def confusion(table: str, classes, by: str = "") -> str:
    rows = "count(*)::DOUBLE"

    def both(k):
        return f"count(*) FILTER (label = {k} AND prediction = {k})::DOUBLE"

    def truth(k):
        return f"count(*) FILTER (label = {k})::DOUBLE"

    def said(k):
        return f"count(*) FILTER (prediction = {k})::DOUBLE"

    chance = "(" + " + ".join(f"{truth(k)} * {said(k)}" for k in classes) + f") / ({rows} * {rows})"
    accuracy = f"count(*) FILTER (label = prediction)::DOUBLE / {rows}"
    columns = [
        "count(*) AS rows",
        f"{R(accuracy, 6)} AS accuracy",
        f"{R(f'({accuracy} - {chance}) / nullif(1 - {chance}, 0)', 6)} AS kappa",
    ]
    for k in classes:
        columns.append(f"{R(f'{both(k)} / nullif({truth(k)}, 0)', 6)} AS recall_{k}")
        columns.append(f"{R(f'{both(k)} / nullif({said(k)}, 0)', 6)} AS precision_{k}")
    if by:
        return f"SELECT {by}, {', '.join(columns)} FROM {table} GROUP BY {by}"
    return f"SELECT {', '.join(columns)} FROM {table}"


def frequencies(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS code, count(*) AS n FROM {table} GROUP BY {c}" for c in CODE_COLUMNS
    )


FEATURE_LIST = ", ".join(FEATURE_COLUMNS)
BASE_LIST = ", ".join(BASE_COLUMNS)
SIGNAL_LIST = ", ".join(SIGNAL_COLUMNS)


def class_stats(table: str, by: str) -> str:
    """Per class, from indicator columns of the single rows."""
    ratio = lambda a, b: f"sum(({a})::INT)::DOUBLE / nullif(sum(({b})::INT), 0)"
    shares = {
        "sensitivity": ratio("l AND p", "l"),
        "specificity": ratio("NOT l AND NOT p", "NOT l"),
        "positive_value": ratio("l AND p", "p"),
        "negative_value": ratio("NOT l AND NOT p", "NOT p"),
        "f1": "2 * sum((l AND p)::INT)::DOUBLE / nullif(sum(l::INT) + sum(p::INT), 0)",
        "prevalence": ratio("l", "true"),
        "detection_rate": ratio("l AND p", "true"),
        "detection_prevalence": ratio("p", "true"),
        "balanced_accuracy": f"({ratio('l AND p', 'l')} + {ratio('NOT l AND NOT p', 'NOT l')}) / 2",
    }
    columns = ", ".join(f"{R(expression, 6)} AS {name}" for name, expression in shares.items())
    return f"""SELECT {by}, class, {columns} FROM (SELECT {by}, class, label = class AS l, prediction = class AS p
        FROM {table}, (SELECT unnest([0, 1, 2])::INT AS class) WHERE label IN (0, 1, 2) AND prediction IN (0, 1, 2)) GROUP BY {by}, class"""


def confusion_tests(parts: list[str], table: str, by: str) -> str:
    """Binomial tails as sums of their terms, bounds by halving over these sums, the chi-square tail as an area of thin strips."""

    def tail(p: str) -> str:
        term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))"
        return f"list_sum(list_transform(range(k, n + 1), lambda i: {term}))"

    cell = lambda i, j: f"count(*) FILTER (label = {i} AND prediction = {j})"
    pairs = [(0, 1), (0, 2), (1, 2)]
    statistic = " + ".join(f"coalesce(({cell(i, j)} - {cell(j, i)})::DOUBLE ** 2 / nullif({cell(i, j)} + {cell(j, i)}, 0), 0)" for i, j in pairs)
    degrees = " + ".join(f"({cell(i, j)} + {cell(j, i)} > 0)::INT" for i, j in pairs)
    commonest = ", ".join(f"count(*) FILTER (label = {k})" for k in (0, 1, 2))
    strip = "exp(-t * t / 2) * t ** (degrees - 1)"
    strips = f"list_sum(list_transform(range(0, 20000), lambda i: list_transform([sqrt(symmetry) + (i + 0.5) / 2000], lambda t: {strip})[1])) / 2000"
    own = [
        f"""facts AS (SELECT {by}, count(*) AS n, count(*) FILTER (label = prediction) AS hits, greatest({commonest}) AS most,
        {statistic} AS symmetry, {degrees} AS degrees FROM {table} WHERE label IN (0, 1, 2) AND prediction IN (0, 1, 2) GROUP BY {by})""",
        # the upper bound has 97.5 % of at least hits + 1
        f"""halved AS (SELECT {by}, 'lower' AS bound, n, hits AS k, 0.025 AS p, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM facts
        UNION ALL SELECT {by}, 'upper', n, hits + 1, 0.975, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM facts
        UNION ALL SELECT {by}, bound, n, k, p, CASE WHEN less THEN m ELSE lo END, CASE WHEN less THEN hi ELSE m END, step + 1
        FROM (SELECT *, coalesce({tail('m')}, 0) < p AS less FROM (SELECT *, (lo + hi) / 2 AS m FROM halved WHERE step < 34)))""",
        f"bounds AS (SELECT {by}, max((lo + hi) / 2) FILTER (bound = 'lower') AS lower, max((lo + hi) / 2) FILTER (bound = 'upper') AS upper FROM halved WHERE step = 34 GROUP BY {by})",
    ]
    final = f"""SELECT {by}, n AS rows, {R('hits::DOUBLE / n', 6)} AS accuracy,
        CASE WHEN hits = 0 THEN 0 ELSE {R('lower', 6)} END AS accuracy_lower, CASE WHEN hits = n THEN 1 ELSE {R('upper', 6)} END AS accuracy_upper,
        {R('share', 6)} AS accuracy_null,
        CASE WHEN hits = 0 OR share = 1 THEN 1.0 ELSE {R('chance', 6)} END AS accuracy_p, {R('symmetry', 6)} AS symmetry, degrees AS symmetry_degrees,
        CASE WHEN degrees > 0 THEN CASE WHEN symmetry = 0 THEN 1.0 ELSE {R('area', 6)} END END AS symmetry_p
        FROM (SELECT *, CASE WHEN share < 1 THEN {tail('share')} END AS chance, CASE WHEN degrees > 0 THEN 2 ** (1 - degrees / 2) / gamma(degrees / 2) * {strips} END AS area
        FROM (SELECT *, hits AS k, most::DOUBLE / n AS share FROM facts JOIN bounds USING ({by})))"""
    return ctes(*parts, *own).replace("WITH ", "WITH RECURSIVE ", 1) + "\n" + final
