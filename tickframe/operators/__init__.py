"""Indicators and data-quality operators over bars."""

from . import momentum, trend, volatility, volume  # noqa: F401 - they register the indicators
from .base import CATEGORIES, REGISTRY, Indicator, available, calculate, check_length, find, info, plan
from .ranges import calculate_in_ranges

__all__ = ["CATEGORIES", "REGISTRY", "Indicator", "available", "calculate", "calculate_in_ranges", "check_length", "find", "info", "plan"]
