"""One function per indicator, for DataFrame.transform: ``bars.transform(rsi(period=14))``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .operators import CATEGORIES, REGISTRY, available, calculate, info

Transform = Callable[[DataFrame], DataFrame]


def _function(name: str) -> Callable[..., Transform]:
    def indicator(strict: bool = False, **params) -> Transform:
        return lambda bars: calculate(name, bars, strict, **params)

    indicator.__name__ = indicator.__qualname__ = name
    indicator.__doc__ = f"{name} ({REGISTRY[name].category}): {', '.join(REGISTRY[name].fields)}. Parameters: {', '.join(p.name for p in REGISTRY[name].params) or 'none'}."
    return indicator


sma, ema, wma, hma, kama, macd = (_function(n) for n in ("sma", "ema", "wma", "hma", "kama", "macd"))
rsi, stochastic, williams_r, cci, roc, momentum = (_function(n) for n in ("rsi", "stochastic", "williams_r", "cci", "roc", "momentum"))
standard_deviation, atr, bollinger_bands, volatility_index = (_function(n) for n in ("standard_deviation", "atr", "bollinger_bands", "volatility_index"))
obv, vwap, accumulation_distribution, chaikin_money_flow = (_function(n) for n in ("obv", "vwap", "accumulation_distribution", "chaikin_money_flow"))


def categories() -> tuple[str, ...]:
    return CATEGORIES


def all_info(category: str | None = None) -> list[dict]:
    """info of every indicator, or of those of a category."""
    return [info(n) for n in available(category)]
