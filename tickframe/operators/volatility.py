"""Volatility: standard deviation, ATR, Bollinger bands, volatility index."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import mean, ratio, series, trailing, true_range
from ..params import ParamMeta
from .base import PRICE_SOURCE, Indicator, Steps, fixed, of_source, outputs, period, register, row, source
from .kernels import Smooth


def deviation(value: Column, n: int, population: bool = False) -> Column:
    """Standard deviation of the trailing n values."""
    return (F.stddev_pop if population else F.stddev_samp)(value.cast("double")).over(trailing(n))


register(
    Indicator(
        "standard_deviation", "volatility", of_source, lambda p: p["period"],
        lambda p, t: Steps(row() >= p["period"], {"value": F.col(t("v"))}, [{t("v"): deviation(F.col(p["source"]), p["period"], p["calculation"] == "population")}]),
        (period(20, 2), source(PRICE_SOURCE), ParamMeta("calculation", "string", "sample", options=("sample", "population"), description="divide by n - 1 or by n")),
        outputs("single_value", "value", example="standard_deviation > 2", unit="price"),
    )
)


def _atr(p: dict, t) -> Steps:
    """sma: mean of n true ranges. ema, rma: recurrences from the first row on, shown from the n-th."""
    n = p["period"]
    pre: list[dict] = [{t("tr"): true_range()}]
    kernels = []
    if p["smoothing"] == "sma":
        pre.append({t("v"): mean(F.col(t("tr")), n)})
    else:
        pre.append({t("x"): F.col(t("tr")).cast("double")})
        kernels = [Smooth(t("v"), t("x"), 2 / (n + 1), 0, n if p["smoothing"] == "rma" else None)]
    return Steps(row() >= n, {"value": F.col(t("v")), "true_range": F.col(t("tr")).cast("double")}, pre, kernels)


register(
    Indicator(
        "atr", "volatility", fixed("high", "low", "close"), lambda p: p["period"], _atr,
        (period(14), ParamMeta("smoothing", "string", "rma", options=("rma", "ema", "sma"), description="how true ranges are averaged")),
        outputs("single_value", "value", "true_range", example="atr > 2", unit="price"),
    )
)


def _bollinger(p: dict, t) -> Steps:
    n, m, x = p["period"], float(p["multiplier"]), F.col(p["source"])
    mid = F.col(t("mid"))
    width = F.col(t("sd")) * F.lit(m)
    upper, lower = mid + width, mid - width
    place = ratio((x.cast("double") - lower) * 100, upper - lower, 50.0)
    out = {"upper_band": upper, "middle_band": mid, "lower_band": lower, "percent_b": place, "bandwidth": ratio((upper - lower) * 100, mid, 0)}
    return Steps(row() >= n, out, [{t("mid"): mean(x, n), t("sd"): deviation(x, n)}])


register(
    Indicator(
        "bollinger_bands", "volatility", of_source, lambda p: p["period"], _bollinger,
        (period(20, 2), source(PRICE_SOURCE), ParamMeta("multiplier", "float", 2.0, min=1e-12, description="standard deviations from the middle to a band")),
        outputs("multi_value", "upper_band", "middle_band", "lower_band", "percent_b", "bandwidth", example="bollinger_bands_percent_b > 100", unit="price"),
    )
)

LN2 = math.log(2.0)


def _log(top: Column, bottom: Column) -> Column:
    """ln(top / bottom); null unless both are positive."""
    t, b = top.cast("double"), bottom.cast("double")
    return F.when((t > 0) & (b > 0), F.ln(t / F.nullif(b, F.lit(0.0))))


def _volatility(p: dict, t) -> Steps:
    """Yearly volatility in percent; null where a window holds a price that is not positive.

    historical: sample deviation of n log returns. garman_klass: mean of ln(H/L)^2 - (2 ln 2 - 1) ln(C/O)^2, the first
    term halved with textbook=True. parkinson: mean of ln(H/L)^2 / (4 ln 2).
    """
    n, year = p["period"], float(p["periods_per_year"])
    if p["method"] == "historical":
        x = F.col(p["source"])
        each = _log(x, F.lag(x, 1).over(series()))
    else:
        spread = F.pow(_log(F.col("high"), F.col("low")), F.lit(2.0))
        if p["method"] == "parkinson":
            each = spread / F.lit(4 * LN2)
        else:
            each = spread * F.lit(0.5 if p["textbook"] else 1.0) - F.lit(2 * LN2 - 1) * F.pow(_log(F.col("close"), F.col("open")), F.lit(2.0))
    full = F.count(t("e")).over(trailing(n)) == n
    if p["method"] == "historical":
        value = F.stddev_samp(t("e")).over(trailing(n)) * F.lit(math.sqrt(year) * 100)
    else:
        value = F.sqrt(F.greatest(F.avg(t("e")).over(trailing(n)), F.lit(0.0)) * F.lit(year)) * F.lit(100.0)
    ready = row() > n if p["method"] == "historical" else row() >= n
    return Steps(ready, {"value": F.col(t("v"))}, [{t("e"): each}, {t("v"): F.when(full, value)}])


register(
    Indicator(
        "volatility_index", "volatility", lambda p: (p["source"],) if p["method"] == "historical" else ("open", "high", "low", "close") if p["method"] == "garman_klass" else ("high", "low"),
        lambda p: p["period"] + (p["method"] == "historical"), _volatility,
        (
            period(20, 2), source(PRICE_SOURCE), ParamMeta("method", "string", "historical", options=("historical", "garman_klass", "parkinson"), description="estimator"),
            ParamMeta("periods_per_year", "integer", 252, min=1, description="rows in a year"), ParamMeta("textbook", "boolean", False, description="halve the range term of garman_klass"),
        ),
        outputs("single_value", "value", example="volatility_index > 20", unit="percent a year"),
    )
)
