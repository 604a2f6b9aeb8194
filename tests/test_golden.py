"""Hand-computed values of the indicators."""

import pytest

from helpers import T0, bars, values
from tickframe.errors import InsufficientData, InvalidDataFormat, InvalidParams
from tickframe.operators import REGISTRY, calculate

FIVE = [("100", "105", "98", "103", 1000), ("103", "107", "101", "105", 1200), ("105", "108", "103", "107", 1100), ("107", "109", "105", "106", 950), ("106", "110", "104", "108", 1300)]
RSI_CLOSES = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.85, 46.08, 45.89, 46.03, 46.83, 47.69, 46.55, 46.50, 46.75]
FLAT = [("100", "100", "100", "100", 10)] * 3

CASES = [
    ("sma", FIVE, dict(period=2, source="high"), "value", [106, 107.5, 108.5, 109.5]),
    ("sma", FIVE, dict(period=2, source="low"), "value", [99.5, 102, 104, 104.5]),
    ("sma", FIVE, dict(period=2, source="volume"), "value", [1100, 1150, 1025, 1125]),
    ("sma", FIVE, dict(period=3), "value", [105, 106, 107]),
    ("ema", [100, 102, 104, 106, 108], dict(period=3), "value", [102, 104, 106]),
    ("ema", [100, 102, 104, 106, 108], dict(period=3, initialization="first_value"), "value", [100, 101, 102.5, 104.25, 106.125]),
    ("wma", [10, 20, 30], dict(period=3), "value", [140 / 6]),
    ("wma", [100, 102, 104], dict(period=2), "value", [304 / 3, 310 / 3]),
    ("roc", [100, 102, 110], dict(period=2), "value", [10]),
    ("roc", [100, 102, 110], dict(period=2, variant="price"), "value", [10]),
    ("roc", [0, 100], dict(period=1), "value", [0]),
    ("momentum", [100, 102, 110], dict(period=2), "value", [10]),
    ("momentum", [100, 102, 110], dict(period=2, normalized=True), "value", [0.1]),
    ("momentum", [100, 102, 106, 108], dict(period=2, smoothing=2), "value", [6]),
    ("standard_deviation", [100, 102, 104, 103, 101, 105], dict(period=3), "value", [2, 1, 1.5275252, 2]),
    ("stochastic", FLAT, dict(k_period=3, d_period=1), "k", [50]),
    ("stochastic", [("100", "115", "90", "100", 1), ("100", "112", "90", "100", 1), ("100", "112", "92", "102", 1)], dict(k_period=3, d_period=1), "k", [48]),
    ("williams_r", [("95", "110", "90", "95", 1), ("90", "115", "85", "90", 1), ("92", "112", "88", "92", 1)], dict(period=3), "value", [-76.6666667]),
    ("williams_r", FLAT, dict(period=3), "value", [-50]),
    ("cci", FLAT, dict(period=3), "value", [0]),
    ("rsi", [5] * 6, dict(period=3), "value", [100, 100, 100]),
    ("rsi", [1, 2, 3, 4, 5], dict(period=3), "signal", ["overbought", "overbought"]),
    ("atr", [("100", "105", "95", "102", 1), ("102", "108", "100", "106", 1), ("106", "110", "103", "107", 1)], dict(period=2, smoothing="sma"), "value", [9, 7.5]),
    ("atr", [("100", "105", "95", "102", 1), ("102", "108", "100", "106", 1), ("106", "110", "103", "107", 1)], dict(period=2), "value", [9, 8]),
    ("bollinger_bands", [95, 100, 105], dict(period=3, multiplier=1), "bandwidth", [10]),
    ("bollinger_bands", [90, 100, 110], dict(period=3, multiplier=1), "percent_b", [100]),
    ("bollinger_bands", [5, 5, 5], dict(period=3), "percent_b", [50]),
    ("obv", [(100, 100, 100, 100, 1000), (105, 105, 105, 105, 1500), (103, 103, 103, 103, 800)], {}, "value", [1000, 2500, 1700]),
    ("obv", [(100, 100, 100, 100, v) for v in (1000, 500, 300)], {}, "value", [1000, 1000, 1000]),
    ("vwap", [(100, 100, 100, 100, 1000), (102, 102, 102, 102, 1500)], {}, "value", [100, 101.2]),
    ("vwap", [(100, 105, 99, 103, 1000), (103, 107, 102, 106, 1500)], dict(variant="typical"), "value", [307 / 3, 103.9333333]),
    ("vwap", [(100, 105, 99, 103, 1000)], dict(variant="weighted"), "value", [102.5]),
    ("vwap", [(100, 100, 100, 100, 1000), (102, 102, 102, 102, 0), (104, 104, 104, 104, 1500)], {}, "value", [100, 102.4]),
    ("accumulation_distribution", [(100, 105, 99, 103, 1000), (103, 107, 102, 106, 1500)], {}, "value", [1000 / 3, 1000 / 3 + 900]),
    ("chaikin_money_flow", [(100, 105, 99, 103, 1000), (103, 107, 102, 106, 1500), (106, 108, 104, 105, 800)], dict(period=2), "value", [0.4933333, 0.2173913]),
    ("chaikin_money_flow", [(100, 100, 100, 100, 1000), (101, 102, 101, 101, 1500)], dict(period=2), "value", [-0.6]),
]


@pytest.mark.parametrize("name, rows, params, field, wanted", CASES)
def test_golden(spark, name, rows, params, field, wanted):
    got = values(calculate(name, bars(spark, rows), **params), field)
    assert got == (wanted if isinstance(wanted[0], str) else pytest.approx(wanted, abs=1e-6))


def test_first_row_is_where_the_window_is_full(spark):
    got = calculate("ema", bars(spark, [100, 102, 104, 106, 108]), period=3).orderBy("ts").first()
    assert got.ts == T0.replace(minute=32)


def test_rsi_shape(spark):
    got = values(calculate("rsi", bars(spark, RSI_CLOSES)))
    assert len(got) == 1 and 0 < got[0] < 100


@pytest.mark.parametrize("reset, days, wanted", [("daily", [(1, 9), (1, 15), (2, 9)], [100, None, 104]), ("weekly", [(1, 9), (2, 9), (8, 9)], [100, None, 104])])
def test_vwap_sessions(spark, reset, days, wanted):
    times = [T0.replace(day=d, hour=h) for d, h in days]
    rows = [(p, p, p, p, v) for p, v in ((100, 1000), (102, 1500), (104, 800))]
    got = calculate("vwap", bars(spark, rows, times=times), session_reset=reset).orderBy("ts").collect()
    assert got[0].value == 100 and got[2].value == 104 and [r.session_reset_occurred for r in got] == [False, False, True]


def test_short_series(spark):
    five = bars(spark, [1, 2, 3, 4, 5])
    assert calculate("rsi", five).count() == 0
    with pytest.raises(InsufficientData) as e:
        calculate("rsi", five, strict=True)
    assert (e.value.required, e.value.provided) == (15, 5)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_every_indicator_on_few_and_no_rows(spark, name):
    indicator = REGISTRY[name]
    n = indicator.required_periods()
    rows = [(100 + i % 7, 103 + i % 7, 98 + i % 5, 101 + i % 6, 1000 + i) for i in range(n + 5)]
    df = bars(spark, rows)
    got = calculate(name, df).collect()
    assert got[0].asDict().keys() == {"symbol", "ts", "seq", *indicator.fields}
    assert len(got) == len(rows) - n + 1
    assert calculate(name, df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "name, params",
    [("sma", dict(period=0)), ("sma", dict(period=2.5)), ("sma", dict(source="x")), ("hma", dict(period=1)), ("rsi", dict(source="volume")), ("macd", dict(fast_period=30)), ("obv", dict(period=3)), ("rsi", dict(oversold=80)), ("ema", dict(smoothing=2)), ("nothing", {})],
)
def test_refused_parameters(spark, name, params):
    with pytest.raises(InvalidParams):
        calculate(name, bars(spark, [1, 2, 3]), **params)


def test_unknown_parameters_are_ignored_but_missing_columns_are_not(spark):
    df = bars(spark, [1, 2, 3])
    assert values(calculate("sma", df, period=2, colour="red")) == [1.5, 2.5]
    with pytest.raises(InvalidDataFormat):
        calculate("obv", df.drop("volume"))


def test_series_do_not_mix(spark):
    both = bars(spark, [1, 2, 3], "a").unionByName(bars(spark, [10, 20, 30], "b"))
    assert values(calculate("sma", both, period=2)) == [1.5, 2.5, 15, 25]
    assert values(calculate("ema", both, period=2)) == [1.5, 2.5, 15, 25]
