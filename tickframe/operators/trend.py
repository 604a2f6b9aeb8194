"""Trend: SMA, EMA, WMA, HMA, KAMA, MACD."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParams
from ..functions.exprs import mean, ratio, series, trailing
from ..params import ParamMeta
from .base import ANY_SOURCE, Indicator, Steps, of_source, outputs, period, register, row, source
from .kernels import Smooth


def weighted(value: Column, n: int) -> Column:
    """Mean of the trailing n values with weights 1 to n, the newest heaviest: from two exact decimal sums."""
    w = trailing(n)
    placed = F.sum(value * row().cast("decimal(10,0)")).over(w).cast("double")
    plain = F.sum(value).over(w).cast("double")
    return (placed - (row() - n).cast("double") * plain) / F.lit(n * (n + 1) / 2)


def _decimal(p: dict) -> Column:
    return F.col(p["source"]).cast("decimal(18,4)")


register(
    Indicator(
        "sma", "trend", of_source, lambda p: p["period"],
        lambda p, t: Steps(row() >= p["period"], {"value": F.col(t("v"))}, [{t("v"): mean(_decimal(p), p["period"])}]),
        (period(20), source(ANY_SOURCE)), outputs("single_value", "value", example="sma > close", unit="price"),
    )
)


def _ema(p: dict, t) -> Steps:
    a = p["smoothing"] if p["smoothing"] is not None else 2 / (p["period"] + 1)
    start = p["period"] if p["initialization"] == "sma_bootstrap" else 0
    return Steps(F.col(t("y")).isNotNull(), {"value": F.col(t("y"))}, [{t("x"): F.col(p["source"]).cast("double")}], [Smooth(t("y"), t("x"), a, start)])


register(
    Indicator(
        "ema", "trend", of_source, lambda p: p["period"] if p["initialization"] == "sma_bootstrap" else 1, _ema,
        (
            period(12), source(ANY_SOURCE), ParamMeta("smoothing", "float", None, min=1e-12, max=1, description="weight of the newest value instead of 2 / (period + 1)"),
            ParamMeta("initialization", "string", "sma_bootstrap", options=("sma_bootstrap", "first_value"), description="first value: mean of the first period rows, or the first row"),
        ),
        outputs("single_value", "value", example="ema > close", unit="price"),
    )
)

register(
    Indicator(
        "wma", "trend", of_source, lambda p: p["period"],
        lambda p, t: Steps(row() >= p["period"], {"value": F.col(t("v"))}, [{t("v"): weighted(_decimal(p), p["period"])}]),
        (period(20), source(ANY_SOURCE)), outputs("single_value", "value", example="wma > close", unit="price"),
    )
)


def _hma(p: dict, t) -> Steps:
    n, half = p["period"], p["period"] // 2
    s = _root(n)
    raw = F.lit(2.0) * weighted(_decimal(p), half) - weighted(_decimal(p), n)
    terms = [F.lag(t("raw"), j).over(series()) * F.lit(float(s - j)) if j else F.col(t("raw")) * F.lit(float(s)) for j in range(s)]
    smooth = reduce(lambda a, b: a + b, terms) / F.lit(s * (s + 1) / 2)
    return Steps(row() >= n + s - 1, {"value": F.col(t("v"))}, [{t("raw"): F.when(row() >= n, raw)}, {t("v"): smooth}])


def _root(n: int) -> int:
    return math.floor(math.sqrt(n) + 0.5)


register(
    Indicator(
        "hma", "trend", of_source, lambda p: p["period"] + _root(p["period"]) - 1, _hma,
        (period(14, 2), source(ANY_SOURCE)), outputs("single_value", "value", example="hma > close", unit="price"),
    )
)


def _ordered(fast: str, slow: str):
    def check(p: dict) -> None:
        if p[fast] >= p[slow]:
            raise InvalidParams(f"{fast} must be less than {slow}", param=fast, value=p[fast], expected=f"less than {p[slow]}")

    return check


def _kama(p: dict, t) -> Steps:
    n, x = p["period"], F.col(p["source"])
    fast, slow = 2 / (p["fast_period"] + 1), 2 / (p["slow_period"] + 1)
    change = F.abs(x - F.lag(x, n).over(series()))
    er = F.least(ratio(change, F.sum(t("move")).over(trailing(n)), 1.0), F.lit(1.0))
    sc = F.pow(F.col(t("er")) * F.lit(fast - slow) + F.lit(slow), F.lit(2.0))
    pre = [{t("move"): F.abs(x - F.lag(x, 1).over(series()))}, {t("er"): er}, {t("x"): F.when(row() > n, x.cast("double")), t("a"): sc}]
    return Steps(row() > n, {"value": F.col(t("y")), "efficiency_ratio": F.round(F.col(t("er")), 4)}, pre, [Smooth(t("y"), t("x"), t("a"), 0, least=slow**2)])


register(
    Indicator(
        "kama", "trend", of_source, lambda p: p["period"] + 1, _kama,
        (period(10), period(2, name="fast_period"), period(30, name="slow_period"), source(ANY_SOURCE)),
        outputs("single_value", "value", "efficiency_ratio", example="kama > close", unit="price"), check=_ordered("fast_period", "slow_period"),
    )
)


def _macd(p: dict, t) -> Steps:
    fast, slow, signal = (p[f"{k}_period"] for k in ("fast", "slow", "signal"))
    kernels = [
        Smooth(t("f"), t("x"), 2 / (fast + 1), fast), Smooth(t("s"), t("x"), 2 / (slow + 1), slow),
        Smooth(t("g"), (t("f"), t("s")), 2 / (signal + 1), signal),
    ]
    line = F.col(t("f")) - F.col(t("s"))
    out = {"macd": line, "signal": F.col(t("g")), "histogram": line - F.col(t("g"))}
    return Steps(row() >= slow, out, [{t("x"): F.col(p["source"]).cast("double")}], kernels)


register(
    Indicator(
        "macd", "trend", of_source, lambda p: p["slow_period"], _macd,
        (period(12, name="fast_period"), period(26, name="slow_period"), period(9, name="signal_period"), source(ANY_SOURCE)),
        outputs("multi_value", "macd", "signal", "histogram", example="macd_histogram > 0", unit="price"), check=_ordered("fast_period", "slow_period"),
    )
)
