"""DuckDB SQL for the queries of queries.py, written from the formulas and not from the plans."""

from __future__ import annotations

from datetime import datetime

BARS = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*) AS volume
  FROM events GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)"""
USER_BARS = BARS.replace("event_type AS symbol", "CAST(user_id AS VARCHAR) AS symbol").replace("'hour'", "'day'")
ORDER_BARS = """bars AS (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS ts, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open,
         max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*) AS volume
  FROM orders GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)"""

W = "OVER (PARTITION BY symbol ORDER BY ts)"


def last(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def div(a: str, b: str, guard: float) -> str:
    return f"CASE WHEN ({b}) = 0 THEN {guard} ELSE ({a}) / ({b}) END"


def r6(x: str, name: str) -> str:
    # The tiny addition makes exact halves go up in both engines, whatever their last bit is.
    return f"round(CAST({x} AS DOUBLE) + 2.3e-10, 6) + 0.0 AS {name}"


def zone(x: str, over: float, under: float, name: str) -> str:
    return f"CASE WHEN {x} > {over} THEN 'overbought' WHEN {x} < {under} THEN 'oversold' ELSE 'neutral' END AS {name}"


def sign(x: str, name: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 'bullish' WHEN {x} < 0 THEN 'bearish' ELSE 'neutral' END AS {name}"


def levels(steps: list[str], where: str, outs: list[str], base: str = BARS) -> str:
    """A chain of selects over b, each adding columns, and the result."""
    text, before = "WITH RECURSIVE " + base, "b"
    for i, step in enumerate(steps):
        text += f",\nl{i} AS (SELECT *, {step} FROM {before})"
        before = f"l{i}"
    return f"{text}\nSELECT symbol, ts, {', '.join(outs)} FROM {before} WHERE {where}"


def smooth(name: str, table: str, x: str, step: str, seed_at: int, seed: str) -> str:
    """A recursive table name(symbol, rn, y): seeded at row seed_at with an aggregate over the rows up to it, then y := step."""
    return f"""{name} AS (
  SELECT symbol, CAST({seed_at} AS BIGINT) AS rn, CAST({seed} AS DOUBLE) AS y FROM {table} WHERE rn <= {seed_at} GROUP BY symbol HAVING max(rn) = {seed_at}
  UNION ALL
  SELECT n.symbol, n.rn, {step.replace("$x", "n." + x)} FROM {name} p JOIN {table} n ON n.symbol = p.symbol AND n.rn = p.rn + 1)"""


def ema_step(a: str) -> str:
    return f"$x * ({a}) + p.y * (1 - ({a}))"


def joined(tables: str, select: str, frm: str) -> str:
    return f"WITH RECURSIVE {BARS},\n{tables}\nSELECT {select} FROM {frm}"


def wma(x: str, n: int) -> str:
    terms = " + ".join(f"lag({x}, {j}) {W} * {n - j}" if j else f"{x} * {n}" for j in range(n))
    return f"({terms}) / {n * (n + 1) / 2}"


def ema(n: int, x: str = "close", first: bool = False) -> str:
    seed = f"max(CASE WHEN rn = 1 THEN {x} END)" if first else f"avg({x})"
    return joined(smooth("e", "b", x, ema_step(f"2.0 / {n + 1}"), 1 if first else n, seed), "e.symbol, b.ts, " + r6("e.y", "value"), "e JOIN b USING (symbol, rn)")


MOVE = f"close - lag(close) {W} AS mv"
GAIN = "greatest(mv, 0) AS gain, greatest(-mv, 0) AS loss"
RSI_OUT = "CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS v"
TR = f"greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS tr"
FLOW = f"CAST(({div('(close - low) - (high - close)', 'high - low', 0)}) * volume AS DECIMAL(28,10)) AS flow"
TP = "(high + low + close) / 3"


def rsi(smoothing: str, n: int = 14) -> str:
    outs = [r6("v", "value"), zone("v", 70, 30, "signal")]
    if smoothing == "sma":
        return levels([MOVE, GAIN, f"avg(gain) {last(n)} AS g, avg(loss) {last(n)} AS l", RSI_OUT], f"rn > {n}", outs)
    if smoothing == "wilder":
        back = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {2 * n - 2} PRECEDING AND {n - 1} PRECEDING)"
        own = [f"CASE WHEN rn >= {2 * n} THEN avg({k}) {back} ELSE avg(CASE WHEN rn <= {n + 1} THEN {k} END) OVER (PARTITION BY symbol) END AS {k[0]}" for k in ("gain", "loss")]
        return levels([MOVE, GAIN, ", ".join(own), RSI_OUT], f"rn > {n}", outs)
    moves = f"m AS (SELECT *, greatest(mv, 0) AS gain, greatest(-mv, 0) AS loss FROM (SELECT *, {MOVE} FROM b))"
    tables = [smooth(k[0], "m", k, f"(({n} - 1) * p.y + $x) / {n}", n + 1, f"sum({k}) / {n}") for k in ("gain", "loss")]
    inner = "(SELECT g.symbol, b.ts, CASE WHEN l.y = 0 THEN 100 ELSE 100 - 100 / (1 + g.y / l.y) END AS v FROM g JOIN l USING (symbol, rn) JOIN b USING (symbol, rn))"
    return joined(",\n".join([moves, *tables]), f"symbol, ts, {', '.join(outs)}", inner)


def stochastic(k: int = 14, d: int = 3, s: int = 1) -> str:
    raw = f"CASE WHEN rn >= {k} THEN {div(f'100 * (close - min(low) {last(k)})', f'max(high) {last(k)} - min(low) {last(k)}', 50)} END AS raw"
    outs = [r6("k", "k"), r6("d", "d"), zone("k", 80, 20, "k_signal"), zone("d", 80, 20, "d_signal"), "CASE WHEN k > d THEN 'bullish' WHEN k < d THEN 'bearish' ELSE 'neutral' END AS crossover"]
    return levels([raw, f"avg(raw) {last(s)} AS k", f"avg(k) {last(d)} AS d"], f"rn >= {k + d + s - 2}", outs)


def exact(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,4))"


def vwap(variant: str = "close", reset: str = "none") -> str:
    price, by = {"close": (exact("close"), 1), "typical": (f"({exact('high')} + {exact('low')} + {exact('close')})", 3), "weighted": (f"({exact('high')} + {exact('low')} + {exact('close')} + {exact('close')})", 4)}[variant]
    session = {"none": "CAST(NULL AS TIMESTAMP)", "daily": "date_trunc('day', ts)", "weekly": "date_trunc('week', ts)", "monthly": "date_trunc('month', ts)"}[reset]
    over = "OVER (PARTITION BY symbol, session ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    steps = [f"{session} AS session, {price} AS price", f"sum(price * volume) {over} AS pv, CAST(sum(volume) {over} AS BIGINT) AS cumulative_volume, coalesce(session <> lag(session) {W}, false) AS session_reset_occurred"]
    return levels(steps, "volume > 0", [r6(f"CAST(pv AS DOUBLE) / {by} / cumulative_volume", "value"), r6(f"CAST(price AS DOUBLE) / {by}", "price_used"), "cumulative_volume", "session_reset_occurred"])


def volatility(method: str, n: int = 20, year: int = 252) -> str:
    def log(a: str, b: str) -> str:
        return f"CASE WHEN {a} > 0 AND {b} > 0 THEN ln({a} / {b}) END"

    hl = f"pow({log('high', 'low')}, 2)"
    each = {"historical": log("close", "before"), "parkinson": f"{hl} / (4 * ln(2))", "garman_klass": f"{hl} - (2 * ln(2) - 1) * pow({log('close', 'open')}, 2)"}[method]
    value = f"stddev_samp(e) {last(n)} * sqrt({year}) * 100" if method == "historical" else f"sqrt(greatest(avg(e) {last(n)}, 0) * {year}) * 100"
    steps = [f"lag(close) {W} AS before", f"{each} AS e", f"CASE WHEN count(e) {last(n)} = {n} THEN {value} END AS v"]
    return levels(steps, f"rn >= {n + (method == 'historical')}", [r6("v", "value")])


def atr(smoothing: str, n: int = 14) -> str:
    outs = [r6("v", "value"), r6("tr", "true_range")]
    if smoothing == "sma":
        return levels([TR, f"avg(tr) {last(n)} AS v"], f"rn >= {n}", outs)
    step = ema_step(f"2.0 / {n + 1}") if smoothing == "ema" else f"(({n} - 1) * p.y + $x) / {n}"
    tables = f"t AS (SELECT *, {TR} FROM b),\n" + smooth("e", "t", "tr", step, 1, "max(CASE WHEN rn = 1 THEN tr END)")
    return joined(tables, f"e.symbol, t.ts, {r6('e.y', 'value')}, {r6('t.tr', 'true_range')}", f"e JOIN t USING (symbol, rn) WHERE e.rn >= {n}")


def kama(n: int = 10, fast: int = 2, slow: int = 30) -> str:
    f, s = 2 / (fast + 1), 2 / (slow + 1)
    moves = f"m AS (SELECT *, abs(close - lag(close) {W}) AS mv, abs(close - lag(close, {n}) {W}) AS ch FROM b)"
    er = f"r AS (SELECT *, {div('ch', f'sum(mv) {last(n)}', 1)} AS er FROM m),\nx AS (SELECT *, pow(least(er, 1) * ({f} - {s}) + {s}, 2) AS sc FROM r)"
    rec = smooth("e", "x", "close", "$x * n.sc + p.y * (1 - n.sc)", n + 1, f"max(CASE WHEN rn = {n + 1} THEN close END)")
    return joined(f"{moves},\n{er},\n{rec}", f"e.symbol, x.ts, {r6('e.y', 'value')}, round(least(x.er, 1), 4) + 0.0 AS efficiency_ratio", "e JOIN x USING (symbol, rn)")


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> str:
    tables = [smooth("f", "b", "close", ema_step(f"2.0 / {fast + 1}"), fast, "avg(close)"), smooth("s", "b", "close", ema_step(f"2.0 / {slow + 1}"), slow, "avg(close)")]
    tables.append(f"m AS (SELECT f.symbol, f.rn - {slow - 1} AS rn, b.ts, f.y - s.y AS macd FROM f JOIN s USING (symbol, rn) JOIN b USING (symbol, rn))")
    tables.append(smooth("g", "m", "macd", ema_step(f"2.0 / {signal + 1}"), signal, "avg(macd)"))
    outs = ", ".join([r6("m.macd", "macd"), r6("g.y", "signal"), r6("m.macd - g.y", "histogram")])
    return joined(",\n".join(tables), f"m.symbol, m.ts, {outs}", "m LEFT JOIN g USING (symbol, rn)")


# Bars with flaws, for the data-quality operators: every so many rows something is missing, negative or out of order.
FLAWED = f"""WITH {BARS},
d AS (SELECT symbol, rn AS seq, CASE WHEN rn % 89 = 0 THEN NULL WHEN rn % 61 = 0 THEN ts - INTERVAL 3 HOUR ELSE ts END AS ts, CASE WHEN rn % 53 = 0 THEN NULL ELSE open END AS open,
             CASE WHEN rn % 47 = 0 THEN low - 1 ELSE high END AS high, low, CASE WHEN rn % 97 = 0 THEN close * 9 ELSE close END AS close,
             CASE WHEN rn % 71 = 0 THEN -volume ELSE volume END AS volume FROM b)"""
VALID = "(open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND ts IS NOT NULL AND coalesce(volume >= 0, false))"
QUARTILES = """q AS (SELECT symbol, max(CASE WHEN i = floor(n * 0.25) + 1 THEN x END) AS q1, max(CASE WHEN i = floor(n * 0.75) + 1 THEN x END) AS q3, max(n) AS n
  FROM (SELECT symbol, close AS x, row_number() OVER (PARTITION BY symbol ORDER BY close) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM d WHERE close IS NOT NULL) GROUP BY symbol)"""
FLAGS = f"""{QUARTILES},
f AS (SELECT d.*, {VALID} AS valid, ts IS NULL AS missing_ts, row_number() OVER (PARTITION BY d.symbol, ts ORDER BY seq) > 1 AS repeat,
        coalesce(lag(ts) OVER (PARTITION BY d.symbol ORDER BY seq) > ts, false) AS backwards,
        CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'Missing OHLC data' WHEN high < low THEN 'High price is less than low price'
             WHEN high < open THEN 'High price is less than open price' WHEN high < close THEN 'High price is less than close price'
             WHEN low > open THEN 'Low price is greater than open price' WHEN low > close THEN 'Low price is greater than close price' END AS rule,
        coalesce(volume < 0, false) AS bad_volume,
        coalesce(n >= 4 AND (close < q1 - (q3 - q1) * 1.5 OR close > q3 + (q3 - q1) * 1.5), false) AS outlier
      FROM d LEFT JOIN q ON q.symbol = d.symbol)"""
ISSUES = f"""{FLAWED}, {FLAGS},
i AS (SELECT symbol, seq, 'invalid_data' AS type, 'Invalid OHLCV data point' AS description, 'high' AS severity FROM f WHERE NOT valid
  UNION ALL SELECT symbol, seq, 'missing_data', 'Missing timestamp', 'critical' FROM f WHERE missing_ts
  UNION ALL SELECT symbol, seq, 'duplicate', 'Duplicate timestamp', 'medium' FROM f WHERE repeat
  UNION ALL SELECT symbol, seq, 'chronological_error', 'Timestamp out of chronological order', 'high' FROM f WHERE backwards
  UNION ALL SELECT symbol, seq, 'invalid_data', rule, 'high' FROM f WHERE rule IS NOT NULL
  UNION ALL SELECT symbol, seq, 'invalid_data', 'Negative volume', 'high' FROM f WHERE bad_volume
  UNION ALL SELECT symbol, seq, 'outlier', 'Statistical outlier detected in close price', 'medium' FROM f WHERE outlier)"""


def zscore(threshold: float) -> str:
    return f"""{FLAWED}, z AS (SELECT *, avg(close) OVER (PARTITION BY symbol) AS m, stddev_pop(close) OVER (PARTITION BY symbol) AS s, count(close) OVER (PARTITION BY symbol) AS n FROM d)
SELECT symbol, seq, 'close' AS field, round(CAST(close AS DOUBLE) + 2.3e-10, 6) + 0.0 AS value, '{"modified_zscore" if threshold == 3.5 else "zscore"}' AS method FROM z WHERE n >= 3 AND s > 0 AND abs(close - m) > {threshold} * s"""


def filled(backward: bool) -> str:
    frame = "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING" if backward else "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    near = f"{'first' if backward else 'last'}_value(CASE WHEN {VALID} THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq {frame})"
    prices = ", ".join(f"round(CASE WHEN ok THEN {c} ELSE near END + 2.3e-10, 6) + 0.0 AS {c}" for c in ("open", "high", "low", "close"))
    return f"{FLAWED}, n AS (SELECT *, {VALID} AS ok, {near} AS near FROM d) SELECT symbol, ts, seq, {prices}, volume FROM n WHERE ok OR near IS NOT NULL"


def normalized(method: str) -> str:
    part = "OVER (PARTITION BY symbol)"
    if method == "minmax":
        inner = f"SELECT *, min(close) {part} AS a, max(close) {part} - min(close) {part} AS s FROM d"
    elif method == "zscore":
        inner = f"SELECT *, avg(close) {part} AS a, stddev_pop(close) {part} AS s FROM d"
    else:
        inner = "SELECT d.*, m.a, m.s FROM d JOIN (SELECT d.symbol, any_value(k.med) AS a, median(abs(close - k.med)) AS s FROM d JOIN (SELECT symbol, median(close) AS med FROM d GROUP BY 1) k ON k.symbol = d.symbol GROUP BY 1) m ON m.symbol = d.symbol"
    return f"{FLAWED}, n AS ({inner}) SELECT symbol, ts, seq, round(CAST(CASE WHEN s > 0 THEN (close - a) / s ELSE close END AS DOUBLE) + 2.3e-10, 6) + 0.0 AS close FROM n"


PIPELINE_PARTS = {
    "sma_value": f"CASE WHEN rn >= 20 THEN avg(close) {last(20)} END",
    "bands_upper_band": f"CASE WHEN rn >= 20 THEN avg(close) {last(20)} + 2 * stddev_samp(close) {last(20)} END",
    "willr_value": f"CASE WHEN rn >= 14 THEN {div(f'-100 * (max(high) {last(14)} - close)', f'max(high) {last(14)} - min(low) {last(14)}', -50)} END",
}

NOW = datetime(2024, 7, 1)
TICKS = """b AS (SELECT event_type AS symbol, ts, value AS close, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)"""
TICK_PARTS = f"""WITH {TICKS},
l AS (SELECT *, CASE WHEN rn >= 14 THEN avg(close) OVER w14 END AS sma, CASE WHEN rn >= 20 THEN stddev_samp(close) OVER w20 END AS sd FROM b
  WINDOW w14 AS (PARTITION BY symbol ORDER BY rn ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY rn ROWS 19 PRECEDING)),
m AS (SELECT *, CASE WHEN rn >= 18 THEN avg(sma) OVER (PARTITION BY symbol ORDER BY rn ROWS 4 PRECEDING) END AS slow FROM l)"""

# What the registry says of each indicator.
REGISTERED = (
    ("accumulation_distribution", "volume", 1, "", "value", "accumulation_distribution > 0"),
    ("atr", "volatility", 14, "period,smoothing", "value,true_range", "atr > 2"),
    ("bollinger_bands", "volatility", 20, "period,source,multiplier", "upper_band,middle_band,lower_band,percent_b,bandwidth", "bollinger_bands_percent_b > 100"),
    ("cci", "momentum", 20, "period,constant", "value,signal", "cci > 100 or cci < -100"),
    ("chaikin_money_flow", "volume", 20, "period", "value,sum_money_flow,sum_volume", "chaikin_money_flow > 0"),
    ("ema", "trend", 12, "period,source,smoothing,initialization", "value", "ema > close"),
    ("hma", "trend", 17, "period,source", "value", "hma > close"),
    ("kama", "trend", 11, "period,fast_period,slow_period,source", "value,efficiency_ratio", "kama > close"),
    ("macd", "trend", 26, "fast_period,slow_period,signal_period,source", "macd,signal,histogram", "macd_histogram > 0"),
    ("momentum", "momentum", 11, "period,source,smoothing,normalized", "value,signal", "momentum > 0"),
    ("obv", "volume", 1, "", "value,volume_direction", "obv > 0"),
    ("roc", "momentum", 13, "period,source,variant", "value,signal", "roc > 0"),
    ("rsi", "momentum", 15, "period,source,overbought,oversold,smoothing", "value,signal", "rsi > 70 or rsi < 30"),
    ("sma", "trend", 20, "period,source", "value", "sma > close"),
    ("standard_deviation", "volatility", 20, "period,source,calculation", "value", "standard_deviation > 2"),
    ("stochastic", "momentum", 16, "k_period,d_period,k_smoothing,overbought,oversold", "k,d,k_signal,d_signal,crossover", "stochastic_k > 80"),
    ("volatility_index", "volatility", 21, "period,source,method,periods_per_year,textbook", "value", "volatility_index > 20"),
    ("vwap", "volume", 1, "variant,session_reset", "value,price_used,cumulative_volume,session_reset_occurred", "close > vwap"),
    ("williams_r", "momentum", 14, "period,overbought,oversold", "value,signal", "williams_r > -20"),
    ("wma", "trend", 20, "period,source", "value", "wma > close"),
)


def registry() -> str:
    rows = ", ".join(f"('{n}', '{c}', {p}, '{params}', '{fields}', '{example}')" for n, c, p, params, fields, example in REGISTERED)
    return f"SELECT name, category, CAST(required_periods AS INTEGER) AS required_periods, params, fields, example FROM (VALUES {rows}) t(name, category, required_periods, params, fields, example)"


#: Which SQL has an indicator with its default parameters.
DEFAULTS = {
    "ema": "ema_sma", "wma": "wma", "hma": "hma", "kama": "kama", "macd": "macd", "rsi": "rsi_wilder", "stochastic": "stochastic", "williams_r": "williams_r", "cci": "cci", "roc": "roc_pct", "momentum": "momentum",
    "standard_deviation": "stddev_sample", "atr": "atr_rma", "bollinger_bands": "bollinger", "volatility_index": "vol_hist", "obv": "obv", "vwap": "vwap_none", "accumulation_distribution": "ad_line", "chaikin_money_flow": "cmf",
}


def every_indicator(oracles: dict[str, str]) -> str:
    """All twenty side by side, each from its own SQL."""
    own = {"sma": levels([f"avg(close) {last(20)} AS v"], "rn >= 20", [r6("v", "value")])} | {n: oracles[o] for n, o in DEFAULTS.items()}
    cols = ", ".join(f"t_{n}.{f} AS {n}_{f}" for n, _, _, _, fields, _ in REGISTERED for f in fields.split(","))
    tables = " ".join(f"LEFT JOIN ({sql}) t_{n} ON t_{n}.symbol = bars.symbol AND t_{n}.ts = bars.ts" for n, sql in own.items())
    return f"WITH {BARS} SELECT bars.symbol, bars.ts, {cols} FROM bars {tables}"


def quality_report(report: str) -> str:
    head = report[: report.index("\nSELECT symbol, count(*)")]
    score = "greatest(0, (total_points - n_issues) / total_points * 100)"
    advice = f"""concat_ws('; ', CASE WHEN chronological_errors > 0 THEN 'Sort data by timestamp to fix chronological order' END,
    CASE WHEN outliers_detected > 0 THEN 'Review detected outliers for data integrity' END, CASE WHEN {score} < 80 THEN 'Consider data cleaning to improve overall quality' END)"""
    return f"""{head},
r AS ({report[len(head):]}),
g AS (SELECT symbol, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS gap FROM d WHERE ts IS NOT NULL),
u AS (SELECT symbol, min(gap) AS step, sum(gap) AS span, count(*) AS n_gaps FROM g WHERE gap > 0 GROUP BY symbol),
i AS (SELECT u.symbol, count(*) FILTER (gap > step) AS irregular FROM u JOIN g ON g.symbol = u.symbol WHERE gap > 0 GROUP BY u.symbol)
SELECT r.*, {r6("coalesce((n_gaps + 1) / (span / step + 1) * 100, 100)", "coverage_percentage")}, coalesce(irregular, 0) AS irregular_intervals,
  {r6("coalesce((n_gaps - coalesce(irregular, 0)) / n_gaps * 100, 100)", "regularity_score")}, {r6("(total_points - ohlc_violations) / total_points * 100", "consistency_score")}, {advice} AS recommendations
FROM r LEFT JOIN u ON u.symbol = r.symbol LEFT JOIN i ON i.symbol = r.symbol"""


STRIPPED = ("[<>\"''`]", r"\$\{.*\}", "(?i)javascript:", "(?i)data:")
DANGEROUS = (r"\.\.", "[<>''\"]", r"\$\{", "(?i)javascript:", "(?i)data:", r"(?i)eval\(", r"(?i)exec\(", "__.*__")


def sanitized() -> str:
    clean = "trim(name)"
    for p in STRIPPED:
        clean = f"regexp_replace({clean}, '{p}', '', 'g')"

    def dangerous(x: str) -> str:
        return " OR ".join([f"length({x}) > 1000", *[f"regexp_matches({x}, '{p}')" for p in DANGEROUS]])

    return f"SELECT p_partkey, substr({clean}, 1, 100) AS clean, {dangerous('name')} AS dangerous, {dangerous('p_name')} AS plain_dangerous FROM (SELECT *, ' <b>' || p_name || '</b> javascript:x' AS name FROM part)"


UNSAFE = f"""{FLAWED} SELECT symbol, seq, CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'missing price'
  WHEN least(open, high, low, close) <= 0 OR greatest(open, high, low, close) >= 1000000 THEN 'price' WHEN volume IS NULL OR volume < 0 OR volume > 1000000000 THEN 'volume'
  WHEN high < greatest(open, close) OR low > least(open, close) THEN 'range'
  WHEN ts IS NULL OR ts < TIMESTAMP '{NOW}' - INTERVAL 365 DAY OR ts > TIMESTAMP '{NOW}' + INTERVAL 1 DAY THEN 'timestamp' END AS unsafe FROM d"""

ITEMS = """items AS (
  SELECT 'items' AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts, (l_orderkey * 10 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS item, CAST(l_extendedprice AS DECIMAL(18, 4)) AS x,
         row_number() OVER (ORDER BY l_shipdate, (l_orderkey * 10 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT)) AS rn
  FROM lineitem)"""


def items_sma(n: int) -> str:
    total = f"sum(x) OVER (ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"WITH {ITEMS}\nSELECT symbol, ts, item, round(CAST({total} AS DOUBLE) / {n} + 2.3e-7, 3) + 0.0 AS value FROM items QUALIFY rn >= {n}"


def items_ema(n: int) -> str:
    """The recurrence written out as a weighted sum of the last 400 values, and the first mean with what weight it has left."""
    a, kept = f"(2.0::DOUBLE / {n + 1})", f"({n - 1}.0::DOUBLE / {n + 1})"
    return f"""WITH {ITEMS},
seed AS (SELECT CAST(sum(x) AS DOUBLE) / {n} AS y FROM items WHERE rn <= {n}),
terms AS (
  SELECT t.rn, sum({a} * pow({kept}, j.j) * CAST(p.x AS DOUBLE)) AS y
  FROM items t, (SELECT unnest(range(400)) AS j) j, items p WHERE p.rn = t.rn - j.j AND p.rn > {n} GROUP BY t.rn)
SELECT symbol, ts, item, round(coalesce(terms.y, 0) + pow({kept}, rn - {n}) * seed.y + 2.3e-7, 3) + 0.0 AS value
FROM items LEFT JOIN terms USING (rn), seed WHERE rn >= {n}"""


ORACLES: dict[str, str] = {
    "bars_hourly": f"WITH {BARS} SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars",
    "bars_user_daily": f"WITH {USER_BARS} SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars",
    "bars_orders_daily": f"WITH {ORDER_BARS} SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars",
    "sma": levels([f"avg(close) {last(14)} AS v"], "rn >= 14", [r6("v", "value")]),
    "sma_volume": levels([f"avg(volume) {last(20)} AS v"], "rn >= 20", [r6("v", "value")]),
    "sma_users": levels([f"avg(close) {last(5)} AS v"], "rn >= 5", [r6("v", "value")], USER_BARS),
    "sma_orders": levels([f"avg(close) {last(20)} AS v"], "rn >= 20", [r6("v", "value")], ORDER_BARS),
    "ema_sma": ema(12),
    "sma_items": items_sma(20),
    "ema_items": items_ema(12),
    "ema_first": ema(12, first=True),
    "wma": levels([f"{wma('close', 20)} AS v"], "rn >= 20", [r6("v", "value")]),
    "hma": levels([f"CASE WHEN rn >= 14 THEN 2 * {wma('close', 7)} - {wma('close', 14)} END AS raw", f"{wma('raw', 4)} AS v"], "rn >= 17", [r6("v", "value")]),
    "kama": kama(),
    "macd": macd(),
    "rsi_wilder": rsi("wilder"),
    "rsi_sma": rsi("sma"),
    "rsi_wilder_recursive": rsi("wilder_recursive"),
    "stochastic": stochastic(),
    "stochastic_slow": stochastic(14, 3, 3),
    "williams_r": levels([f"{div(f'-100 * (max(high) {last(14)} - close)', f'max(high) {last(14)} - min(low) {last(14)}', -50)} AS v"], "rn >= 14", [r6("v", "value"), zone("v", -20, -80, "signal")]),
    "cci": levels(
        [f"{TP} AS tp", f"avg(tp) {last(20)} AS m, list(tp) {last(20)} AS ws", "list_sum(list_transform(ws, lambda x: abs(x - m))) / 20 AS off", "CASE WHEN off <= abs(m) * 1e-14 THEN 0 ELSE (tp - m) / (off * 0.015) END AS v"],
        "rn >= 20", [r6("v", "value"), zone("v", 100, -100, "signal")],
    ),
    "roc_pct": levels([f"{exact('close')} AS x, lag({exact('close')}, 12) {W} AS c0", f"{div('CAST(100 * (x - c0) AS DOUBLE)', 'CAST(c0 AS DOUBLE)', 0)} AS v"], "rn > 12", [r6("v", "value"), sign("v", "signal")]),
    "roc_price": levels([f"CAST(close AS DECIMAL(18,4)) - lag(CAST(close AS DECIMAL(18,4)), 12) {W} AS v"], "rn > 12", [r6("v", "value"), sign("v", "signal")]),
    "momentum": levels([f"CAST(close AS DECIMAL(18,4)) - lag(CAST(close AS DECIMAL(18,4)), 10) {W} AS v"], "rn > 10", [r6("v", "value"), sign("v", "signal")]),
    "momentum_norm": levels([f"lag(close, 10) {W} AS c0", f"{div('close - c0', 'c0', 0)} AS raw0", "CASE WHEN rn > 10 THEN raw0 END AS raw", f"avg(raw) {last(3)} AS v"], "rn >= 13", [r6("v", "value"), sign("v", "signal")]),
    "stddev_sample": levels([f"stddev_samp(close) {last(20)} AS v"], "rn >= 20", [r6("v", "value")]),
    "stddev_pop": levels([f"stddev_pop(close) {last(20)} AS v"], "rn >= 20", [r6("v", "value")]),
    "atr_sma": atr("sma"),
    "atr_ema": atr("ema"),
    "atr_rma": atr("rma"),
    "bollinger": levels(
        [f"avg(close) {last(20)} AS mid, 2 * stddev_samp(close) {last(20)} AS sd"],
        "rn >= 20", [r6("mid + sd", "upper_band"), r6("mid", "middle_band"), r6("mid - sd", "lower_band"), r6(div("100 * (close - mid + sd)", "2 * sd", 50), "percent_b"), r6(div("200 * sd", "mid", 0), "bandwidth")],
    ),
    "vol_hist": volatility("historical"),
    "vol_gk": volatility("garman_klass"),
    "vol_parkinson": volatility("parkinson"),
    "obv": levels([MOVE, "CASE WHEN mv IS NULL OR mv > 0 THEN volume WHEN mv < 0 THEN -volume ELSE 0 END AS s", f"CAST(sum(s) {W} AS BIGINT) AS value"], "true", ["value", "CASE WHEN mv IS NULL THEN 'initial' WHEN mv > 0 THEN 'positive' WHEN mv < 0 THEN 'negative' ELSE 'neutral' END AS volume_direction"]),
    "vwap_none": vwap(),
    "vwap_daily": vwap(reset="daily"),
    "vwap_weekly": vwap(reset="weekly"),
    "vwap_monthly": vwap(reset="monthly"),
    "vwap_typical": vwap("typical", "daily"),
    "vwap_weighted": vwap("weighted", "daily"),
    "ad_line": levels([FLOW, f"sum(flow) {W} AS v"], "true", [r6("v", "value")]),
    "cmf": levels([FLOW, f"sum(flow) {last(20)} AS f, CAST(sum(volume) {last(20)} AS BIGINT) AS sum_volume"], "rn >= 20", [r6(div("CAST(f AS DOUBLE)", "sum_volume", 0), "value"), r6("f", "sum_money_flow"), "sum_volume"]),
    "true_range": levels([TR], "true", [r6("tr", "value")]),
    "typical_price": levels([f"{TP} AS tp"], "true", [r6("tp", "value")]),
    "pct_change": levels([f"lag(close) {W} AS c0", f"{div('100 * (close - c0)', 'c0', 0)} AS v"], "rn > 1", [r6("v", "value")]),
    "volume_price": levels(["(high + low + close) / 3 * volume AS v"], "true", [r6("v", "value")]),
    "statistics": f"WITH {BARS}, m AS (SELECT symbol, median(close) AS med FROM bars GROUP BY 1) SELECT bars.symbol, {r6('avg(close)', 'mean')}, {r6('var_samp(close)', 'variance')}, {r6('stddev_samp(close)', 'standard_deviation')}, {r6('any_value(med)', 'median')}, {r6('median(abs(close - med))', 'mad')} FROM bars JOIN m ON m.symbol = bars.symbol GROUP BY 1",
    "volume_decimal": f"WITH {BARS} SELECT symbol, ts, {r6('volume', 'value')} FROM bars",
    "round_to": f"WITH {BARS} SELECT symbol, ts, {r6('round(CAST(close AS DECIMAL(18,4)), 2)', 'value')} FROM bars",
    "correlation": f"WITH {BARS} SELECT symbol, {r6('corr(close, volume)', 'correlation')} FROM bars GROUP BY symbol",
    "filter_zero_volume": f"{FLAWED} SELECT symbol, seq, volume FROM d WHERE volume > 0",
    "has_volume": f"{FLAWED} SELECT symbol, bool_or(volume > 0) AS has_volume FROM d GROUP BY symbol",
    "valid_ohlcv": f"{FLAWED} SELECT symbol, seq, {VALID} AS valid FROM d",
    "valid_result": levels([], "rn >= 14", ["true AS valid"]),
    "canonical_ticks": f"SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq, {r6('value', 'close')} FROM events",
    "list_source": "SELECT 'series' AS symbol, value FROM (VALUES (1.75::DOUBLE), (3.25), (6.0)) t(value)",
    "dq_fill_interp": filled(False),
    "dq_norm_none": f"{FLAWED} SELECT symbol, ts, seq, {r6('close', 'close')} FROM d",
    "dq_outliers_forest": f"{FLAWED} SELECT symbol, seq, 'close' AS field, CAST(close AS DOUBLE) AS value, 'isolation_forest' AS method FROM d WHERE false",
    "unsafe_bars": UNSAFE,
    "sanitized": sanitized(),
    "registry": registry(),
    "pipeline_tolerant": levels([f"avg(close) {last(20)} AS v"], "rn >= 20", [r6("v", "value"), "'flow,more' AS failed"]),
    "pipeline_separate": levels([], "true", [r6(x, n) for n, x in PIPELINE_PARTS.items()]),
    "stream_hourly": f"WITH {BARS} SELECT symbol, ts, {', '.join(r6(c, c) for c in ('open', 'high', 'low', 'close'))}, volume FROM bars",
    "stream_averages": f"{TICK_PARTS} SELECT symbol, ts, 'sma' AS stage, 'value' AS field, {r6('sma', 'number')} FROM m WHERE sma IS NOT NULL UNION ALL SELECT symbol, ts, 'sd', 'value', {r6('sd', 'number')} FROM m WHERE sd IS NOT NULL UNION ALL SELECT symbol, ts, 'slow', 'value', {r6('slow', 'number')} FROM m WHERE slow IS NOT NULL",
    "dq_report": f"""{FLAWED}, {FLAGS}
SELECT symbol, count(*) AS total_points, count(*) FILTER (valid) AS valid_points, count(*) FILTER (NOT valid) AS invalid_points, count(*) FILTER (missing_ts) AS missing_timestamps,
  count(*) FILTER (repeat) AS duplicate_timestamps, count(*) FILTER (backwards) AS chronological_errors, count(*) FILTER (outlier) AS outliers_detected, count(*) FILTER (rule IS NOT NULL) AS ohlc_violations,
  count(*) FILTER (volume = 0) AS zero_volume_count, CAST(sum(CAST(NOT valid AS INT) + missing_ts::INT + repeat::INT + backwards::INT + (rule IS NOT NULL)::INT + bad_volume::INT + outlier::INT) AS BIGINT) AS n_issues,
  round(greatest(0, (count(*) - sum(CAST(NOT valid AS INT) + missing_ts::INT + repeat::INT + backwards::INT + (rule IS NOT NULL)::INT + bad_volume::INT + outlier::INT)) / count(*) * 100) + 2.3e-10, 6) + 0.0 AS quality_score
FROM f GROUP BY symbol""",
    "dq_issues": f"{ISSUES} SELECT * FROM i",
    "dq_outliers_iqr": f"{FLAWED}, {FLAGS} SELECT symbol, seq, 'close' AS field, round(CAST(close AS DOUBLE) + 2.3e-10, 6) + 0.0 AS value, 'iqr' AS method FROM f WHERE outlier",
    "dq_outliers_z": zscore(3.0),
    "dq_outliers_modz": zscore(3.5),
    "dq_fill_fwd": filled(False),
    "dq_fill_bwd": filled(True),
    "dq_remove": f"{FLAWED} SELECT symbol, ts, seq, {', '.join(f'round({c} + 2.3e-10, 6) + 0.0 AS {c}' for c in ('open', 'high', 'low', 'close'))}, volume FROM d WHERE {VALID}",
    "dq_norm_minmax": normalized("minmax"),
    "dq_norm_z": normalized("zscore"),
    "dq_norm_robust": normalized("robust"),
    "ffill": f"{FLAWED} SELECT symbol, seq, round(coalesce(last_value(open IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) + 2.3e-10, 6) + 0.0 AS value FROM d",
    "pipeline_wide": levels([], "true", [r6(x, n) for n, x in PIPELINE_PARTS.items()]),
    "pipeline_long": f"WITH {BARS}, w AS (SELECT symbol, ts, {', '.join(f'{x} AS {n}' for n, x in PIPELINE_PARTS.items() if n != 'bands_upper_band')} FROM b) "
    "SELECT symbol, ts, 'sma' AS stage, 'value' AS field, round(sma_value + 2.3e-10, 6) + 0.0 AS value FROM w WHERE sma_value IS NOT NULL UNION ALL SELECT symbol, ts, 'willr', 'value', round(willr_value + 2.3e-10, 6) + 0.0 FROM w WHERE willr_value IS NOT NULL",
    "pipeline_latest": f"WITH {BARS}, l AS (SELECT symbol, ts, rn, avg(close) {last(14)} AS v FROM b) SELECT symbol, max(ts) AS ts, round(arg_max(v, ts) + 2.3e-10, 6) + 0.0 AS value FROM l WHERE rn >= 14 GROUP BY symbol",
}
ORACLES["pipeline_merge"] = f"SELECT symbol, ts, value FROM ({ORACLES['sma']}) UNION ALL SELECT symbol, ts, value FROM ({ORACLES['wma']})"
ORACLES["pipeline_all"] = every_indicator(ORACLES)
ORACLES["dq_quality_report"] = quality_report(ORACLES["dq_report"])
