"""Momentum: RSI, Stochastic, Williams %R, CCI, ROC, Momentum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParams
from ..functions.exprs import direction, percentage_change, ratio, running, series, trailing, typical_price, zone
from ..params import ParamMeta
from .base import PRICE_SOURCE, Indicator, Steps, fixed, of_source, outputs, period, register, row, source
from .kernels import Smooth


def level(name: str, default: float, least: float, most: float) -> ParamMeta:
    return ParamMeta(name, "float", default, min=least, max=most, description="threshold of the signal")


def _levels(p: dict) -> None:
    if p["oversold"] >= p["overbought"]:
        raise InvalidParams("oversold must be less than overbought", param="oversold", value=p["oversold"], expected=f"less than {p['overbought']}")


def _rsi(p: dict, t) -> Steps:
    """smoothing sma: means of the last n gains and losses. wilder: means of n gains and losses that end n - 1 rows back,
    and of the first n up to there. wilder_recursive: Wilder's own recurrence."""
    n, x = p["period"], F.col(p["source"])
    move = x - F.lag(x, 1).over(series())
    pre = [{t("gain"): F.when(move.isNotNull(), F.greatest(move, F.lit(0))), t("loss"): F.when(move.isNotNull(), F.greatest(-move, F.lit(0)))}]
    kernels = []
    if p["smoothing"] == "wilder_recursive":
        pre.append({t("gd"): F.col(t("gain")).cast("double"), t("ld"): F.col(t("loss")).cast("double")})
        kernels = [Smooth(t("g"), t("gd"), None, n, n), Smooth(t("l"), t("ld"), None, n, n)]
    else:
        last = {k: F.sum(t(k)).over(trailing(n)) for k in ("gain", "loss")}
        if p["smoothing"] == "wilder":
            pre.append({t(f"{k}_n"): c for k, c in last.items()})
            back = series().rowsBetween(-(2 * n - 2), -(n - 1))
            first = {k: F.max(F.when(row() == n + 1, F.col(t(f"{k}_n")))).over(running()) for k in last}
            last = {k: F.when(row() >= 2 * n, F.sum(t(k)).over(back)).otherwise(first[k]) for k in last}
        pre.append({t(k[0]): c.cast("double") / F.lit(float(n)) for k, c in last.items()})
    gain, loss = F.col(t("g")), F.col(t("l"))
    value = F.when(loss == 0, F.lit(100.0)).otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + ratio(gain, loss, 0)))
    return Steps(row() > n, {"value": value, "signal": zone(value, p["overbought"], p["oversold"])}, pre, kernels)


register(
    Indicator(
        "rsi", "momentum", of_source, lambda p: p["period"] + 1, _rsi,
        (period(14), source(PRICE_SOURCE), level("overbought", 70, 0, 100), level("oversold", 30, 0, 100), ParamMeta("smoothing", "string", "wilder", options=("wilder", "sma", "wilder_recursive"), description="how gains and losses are averaged")),
        outputs("single_value", "value", "signal", strings=("signal",), example="rsi > 70 or rsi < 30", unit="0 to 100"), check=_levels,
    )
)


def _place(close: Column, n: int, of_top: bool, guard: float) -> tuple[Column, Column, Column]:
    """100 times the place of close in the trailing range, from its bottom or (negative) from its top."""
    top, bottom = F.max("high").over(trailing(n)), F.min("low").over(trailing(n))
    return top, bottom, ratio(((close - top) if of_top else (close - bottom)) * 100, top - bottom, guard)


def _stochastic(p: dict, t) -> Steps:
    k, d, s = p["k_period"], p["d_period"], p["k_smoothing"]
    pre = [{t("raw"): F.when(row() >= k, _place(F.col("close"), k, False, 50.0)[2])}]
    pre.append({t("k"): F.col(t("raw")) if s == 1 else F.when(row() >= k + s - 1, F.avg(t("raw")).over(trailing(s)))})
    pre.append({t("d"): F.avg(t("k")).over(trailing(d))})
    kk, dd = F.col(t("k")), F.col(t("d"))
    cross = F.when(kk > dd, "bullish").when(kk < dd, "bearish").otherwise("neutral")
    out = {"k": kk, "d": dd, "k_signal": zone(kk, p["overbought"], p["oversold"]), "d_signal": zone(dd, p["overbought"], p["oversold"]), "crossover": cross}
    return Steps(row() >= k + d + s - 2, out, pre)


register(
    Indicator(
        "stochastic", "momentum", fixed("high", "low", "close"), lambda p: p["k_period"] + p["d_period"] + p["k_smoothing"] - 2, _stochastic,
        (period(14, name="k_period"), period(3, name="d_period"), period(1, name="k_smoothing"), level("overbought", 80, 0, 100), level("oversold", 20, 0, 100)),
        outputs("multi_value", "k", "d", "k_signal", "d_signal", "crossover", strings=("k_signal", "d_signal", "crossover"), example="stochastic_k > 80", unit="0 to 100"), check=_levels,
    )
)


def _williams(p: dict, t) -> Steps:
    value = F.col(t("v"))
    return Steps(row() >= p["period"], {"value": value, "signal": zone(value, p["overbought"], p["oversold"])}, [{t("v"): _place(F.col("close"), p["period"], True, -50.0)[2]}])


register(
    Indicator(
        "williams_r", "momentum", fixed("high", "low", "close"), lambda p: p["period"], _williams,
        (period(14), level("overbought", -20, -100, 0), level("oversold", -80, -100, 0)),
        outputs("single_value", "value", "signal", strings=("signal",), example="williams_r > -20", unit="-100 to 0"), check=_levels,
    )
)


def _cci(p: dict, t) -> Steps:
    n = p["period"]
    total = F.col("high") + F.col("low") + F.col("close")
    centre = F.sum(total).over(trailing(n)).cast("double") / F.lit(3.0 * n)
    pre = [{t("tp"): typical_price(), t("m"): centre}, {t("w"): F.collect_list(t("tp")).over(trailing(n))}]
    off = F.aggregate(F.col(t("w")), F.lit(0.0), lambda a, x: a + F.abs(x - F.col(t("m")))) / F.lit(float(n))
    scale = off * F.lit(float(p["constant"]))
    # Equal prices may miss their own mean by a rounding error: that is no deviation.
    flat = off <= F.abs(F.col(t("m"))) * F.lit(1e-14)
    value = F.when(flat, F.lit(0.0)).otherwise(ratio(F.col(t("tp")) - F.col(t("m")), scale, 0))
    pre.append({t("v"): value})
    return Steps(row() >= n, {"value": F.col(t("v")), "signal": zone(F.col(t("v")), 100, -100)}, pre)


register(
    Indicator(
        "cci", "momentum", fixed("high", "low", "close"), lambda p: p["period"], _cci,
        (period(20), ParamMeta("constant", "float", 0.015, min=1e-12, description="divisor of the mean deviation")),
        outputs("single_value", "value", "signal", strings=("signal",), example="cci > 100 or cci < -100"),
    )
)


def _roc(p: dict, t) -> Steps:
    x = F.col(p["source"])
    before = F.lag(x, p["period"]).over(series())
    value = percentage_change(x, before) if p["variant"] == "percentage" else (x - before).cast("double")
    return Steps(row() > p["period"], {"value": F.col(t("v")), "signal": direction(F.col(t("v")))}, [{t("v"): value}])


register(
    Indicator(
        "roc", "momentum", of_source, lambda p: p["period"] + 1, _roc,
        (period(12), source(PRICE_SOURCE), ParamMeta("variant", "string", "percentage", options=("percentage", "price"), description="change in percent or in price")),
        outputs("single_value", "value", "signal", strings=("signal",), example="roc > 0", unit="percent or price"),
    )
)


def _momentum(p: dict, t) -> Steps:
    x, s = F.col(p["source"]), p["smoothing"]
    before = F.lag(x, p["period"]).over(series())
    raw = ratio(x - before, before, 0) if p["normalized"] else (x - before).cast("double")
    pre = [{t("raw"): F.when(row() > p["period"], raw)}]
    pre.append({t("v"): F.col(t("raw")) if s == 1 else F.avg(t("raw")).over(trailing(s))})
    return Steps(row() >= p["period"] + s, {"value": F.col(t("v")), "signal": direction(F.col(t("v")))}, pre)


register(
    Indicator(
        "momentum", "momentum", of_source, lambda p: p["period"] + p["smoothing"], _momentum,
        (period(10), source(PRICE_SOURCE), period(1, name="smoothing"), ParamMeta("normalized", "boolean", False, description="as a share of the earlier price")),
        outputs("single_value", "value", "signal", strings=("signal",), example="momentum > 0", unit="price"),
    )
)

