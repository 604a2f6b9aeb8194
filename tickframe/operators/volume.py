"""Volume: OBV, VWAP, accumulation/distribution line, Chaikin money flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import PRICE_VARIANTS, money_flow, ratio, running, series, trailing
from ..params import ParamMeta
from .base import Indicator, Steps, fixed, outputs, period, register, row


def _obv(p: dict, t) -> Steps:
    move = F.col("close") - F.lag("close", 1).over(series())
    signed = F.when(move.isNull() | (move > 0), F.col("volume")).when(move < 0, -F.col("volume")).otherwise(0)
    where = F.when(F.col(t("move")).isNull(), "initial").when(F.col(t("move")) > 0, "positive").when(F.col(t("move")) < 0, "negative").otherwise("neutral")
    return Steps(row() >= 1, {"value": F.col(t("v")), "volume_direction": where}, [{t("move"): move, t("s"): signed}, {t("v"): F.sum(t("s")).over(running())}])


register(
    Indicator(
        "obv", "volume", fixed("close", "volume"), lambda p: 1, _obv, (),
        outputs("single_value", "value", "volume_direction", strings=("volume_direction",), example="obv > 0", unit="volume"), strict_params=True,
    )
)

SESSIONS = {"none": None, "daily": "day", "weekly": "week", "monthly": "month"}


def _vwap(p: dict, t) -> Steps:
    """Rows without volume give nothing, but a session may begin with one."""
    price, by = PRICE_VARIANTS[p["variant"]]
    unit = SESSIONS[p["session_reset"]]
    session = F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz") if unit else F.lit(None).cast("timestamp_ntz")
    over = running(t("session"))
    pre = [
        {t("session"): session, t("pv"): price() * F.col("volume")},
        {t("sum"): F.sum(t("pv")).over(over), t("vol"): F.sum("volume").over(over), t("reset"): F.col(t("session")) != F.lag(t("session"), 1).over(series())},
    ]
    out = {
        "value": ratio(F.col(t("sum")).cast("double") / F.lit(by), F.col(t("vol")), 0), "price_used": price().cast("double") / F.lit(by),
        "cumulative_volume": F.col(t("vol")), "session_reset_occurred": F.coalesce(F.col(t("reset")), F.lit(False)),
    }
    return Steps(F.col("volume") > 0, out, pre)


register(
    Indicator(
        "vwap", "volume", lambda p: ("close", "volume") if p["variant"] == "close" else ("high", "low", "close", "volume"), lambda p: 1, _vwap,
        (ParamMeta("variant", "string", "close", options=("close", "typical", "weighted"), description="price of a bar"), ParamMeta("session_reset", "string", "none", options=tuple(SESSIONS), description="when sums begin anew")),
        outputs("single_value", "value", "price_used", "cumulative_volume", "session_reset_occurred", example="close > vwap", unit="price"),
    )
)

register(
    Indicator(
        "accumulation_distribution", "volume", fixed("high", "low", "close", "volume"), lambda p: 1,
        lambda p, t: Steps(row() >= 1, {"value": F.col(t("v")).cast("double")}, [{t("flow"): money_flow()}, {t("v"): F.sum(t("flow")).over(running())}]), (),
        outputs("single_value", "value", example="accumulation_distribution > 0", unit="volume"), strict_params=True,
    )
)


def _cmf(p: dict, t) -> Steps:
    n = p["period"]
    pre = [{t("flow"): money_flow()}, {t("f"): F.sum(t("flow")).over(trailing(n)), t("vol"): F.sum("volume").over(trailing(n))}]
    return Steps(row() >= n, {"value": ratio(F.col(t("f")), F.col(t("vol")), 0), "sum_money_flow": F.col(t("f")).cast("double"), "sum_volume": F.col(t("vol"))}, pre)


register(
    Indicator(
        "chaikin_money_flow", "volume", fixed("high", "low", "close", "volume"), lambda p: p["period"], _cmf, (period(20),),
        outputs("single_value", "value", "sum_money_flow", "sum_volume", example="chaikin_money_flow > 0"),
    )
)
