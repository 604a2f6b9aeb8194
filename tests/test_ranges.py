"""Indicators in ranges give what they give over whole series, wherever the cuts fall."""

import random

import pytest
from helpers import bars

from tickframe.errors import InvalidParams
from tickframe.operators import REGISTRY, calculate, calculate_in_ranges
from tickframe.operators.ranges import context, numbered

SMALL = {
    "ema": dict(period=2), "kama": dict(period=3, fast_period=1, slow_period=2), "macd": dict(fast_period=2, slow_period=3, signal_period=2), "atr": dict(period=2),
}
CASES = [(n, SMALL.get(n, {})) for n in REGISTRY] + [
    ("ema", dict(period=3, initialization="first_value")), ("rsi", dict(smoothing="sma", period=3)), ("rsi", dict(smoothing="wilder_recursive", period=2)),
    ("atr", dict(smoothing="ema", period=2)), ("atr", dict(smoothing="sma")), ("stochastic", dict(k_smoothing=3)), ("volatility_index", dict(method="parkinson")),
    ("momentum", dict(normalized=True, smoothing=3)),
]


@pytest.fixture(scope="module")
def long_series(spark):
    rng = random.Random(5)

    def walk(n, start):
        rows, price = [], start
        for _ in range(n):
            before, price = price, max(1.0, price + rng.choice((-1.5, -0.25, 0, 0.5, 1.25)))
            rows.append((before, max(before, price) + rng.random(), min(before, price) - rng.random() / 2, price, rng.randrange(0, 50)))
        return rows

    three = bars(spark, walk(1500, 100.0), "a").unionByName(bars(spark, walk(37, 20.0), "b")).unionByName(bars(spark, walk(900, 55.0), None))
    return three.persist()


def plain_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1], r[2]))


@pytest.mark.parametrize(("name", "params"), CASES, ids=lambda x: x if isinstance(x, str) else "-".join(map(str, x.values())))
def test_ranges_equal_whole_series(long_series, name, params):
    got, wanted = plain_rows(calculate_in_ranges(name, long_series, rows=100, bucket=3000, **params)), plain_rows(calculate(name, long_series, **params))
    assert len(got) == len(wanted) > 1000
    for a, b in zip(got, wanted, strict=True):
        assert a[:3] == b[:3]
        for x, y in zip(a[3:], b[3:], strict=True):
            assert x == y if isinstance(x, str) or x is None or y is None else x == pytest.approx(y, rel=1e-9, abs=1e-9)


def test_cuts_do_happen(long_series):
    assert 4 * context("sma", period=20) < 500 and 4 * context("ema", period=2) < 500


def test_missing_values_do_not_shorten_the_context(spark, long_series):
    from pyspark.sql import functions as F

    holes = long_series.withColumn("close", F.when((F.col("seq") < 650) | (F.col("seq") > 1150), F.col("close")))
    got, wanted = plain_rows(calculate_in_ranges("ema", holes, rows=100, period=2)), plain_rows(calculate("ema", holes, period=2))
    assert [r[:3] for r in got] == [r[:3] for r in wanted]
    assert all(a[3] == pytest.approx(b[3], rel=1e-12) for a, b in zip(got, wanted, strict=True) if b[3] is not None)


def test_rows_without_times_and_empty_series(spark, long_series):
    from pyspark.sql import functions as F

    timeless = long_series.filter("symbol = 'a'").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    got = sorted((r["seq"], r["value"]) for r in calculate_in_ranges("sma", timeless, rows=50, period=4).collect())
    assert got == sorted((r["seq"], r["value"]) for r in calculate("sma", timeless, period=4).collect())
    assert calculate_in_ranges("ema", long_series.limit(0)).count() == 0
    with pytest.raises(InvalidParams):
        calculate_in_ranges("ema", long_series, rows=0)


def test_numbers_run_on_over_buckets(long_series):
    from pyspark.sql import functions as F

    told = numbered(long_series, F.lit(True), bucket=600)
    assert told.filter("symbol is not null and __n != seq + 1").count() == 0 and told.count() == long_series.count()
