"""Limits on parameters, strings and bars, as options for untrusted input."""

from __future__ import annotations

import math
import re
import sys
import time
from collections import defaultdict, deque
from datetime import datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import ValidationError

# Limits, and what strings and keys must not hold.
MAX_PERIOD, MIN_FACTOR, MAX_FACTOR = 1000, 0.1, 10
MAX_STRING, MAX_SANITIZED, MAX_NUMBER = 1000, 100, 1e20
MAX_BYTES = 50_000_000
MAX_ROWS, MAX_BARS, MAX_PRICE, MAX_VOLUME = 100_000, 50_000, 1_000_000, 1_000_000_000
FACTORS = ("multiplier", "std_dev", "factor")
DANGEROUS = (r"\.\.", r"[<>'\"]", r"\$\{", r"(?i)javascript:", r"(?i)data:", r"(?i)eval\(", r"(?i)exec\(", r"__.*__")
STRIPPED = (r"[<>\"'`]", r"\$\{.*\}", r"(?i)javascript:", r"(?i)data:")
BAD_KEYS = {"__proto__", "__defineGetter__", "__defineSetter__", "__lookupGetter__", "__lookupSetter__", "constructor", "prototype"}
BAD_PARTS = ("../", "..\\", "eval(", "exec(")


def sanitize_string(text: str) -> str:
    """text without the dangerous parts and outer blanks, cut to 100 characters."""
    text = text.strip()
    for pattern in STRIPPED:
        text = re.sub(pattern, "", text)
    return text[:MAX_SANITIZED]


def sanitize_column(text: Column) -> Column:
    """sanitize_string as a column."""
    text = F.trim(text)
    for pattern in STRIPPED:
        text = F.regexp_replace(text, pattern, "")
    return F.substring(text, 1, MAX_SANITIZED)


def dangerous_column(text: Column) -> Column:
    """Whether a string is too long or holds something dangerous."""
    out = F.length(text) > MAX_STRING
    for pattern in DANGEROUS:
        out = out | text.rlike(pattern)
    return out


def dangerous_key(key: str) -> bool:
    return key in BAD_KEYS or any(x in key for x in BAD_PARTS)


def _size(value: Any) -> int:
    """Bytes of a value with all that it holds, about."""
    if isinstance(value, dict):
        return sys.getsizeof(value) + sum(_size(k) + _size(v) for k, v in value.items())
    return sys.getsizeof(value) + (sum(map(_size, value)) if isinstance(value, (list, tuple, set)) else 0)


def validate_input(value: Any) -> None:
    """Raise ValidationError for strings, numbers, keys or collections beyond the limits, and for numbers that are not finite."""
    if isinstance(value, (dict, list, tuple)) and _size(value) > MAX_BYTES:
        raise ValidationError("Too much data", field="size", value=_size(value), constraint=f"at most {MAX_BYTES} bytes")
    _check(value)


def _check(value: Any) -> None:
    if isinstance(value, str):
        if len(value) > MAX_STRING or any(re.search(p, value) for p in DANGEROUS):
            raise ValidationError("Dangerous or overlong string", field="string", value=value[:50], constraint="plain text")
    elif isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        if not (value.is_finite() if isinstance(value, Decimal) else math.isfinite(value)):
            raise ValidationError("Number is not finite", field="number", value=value, constraint="finite")
        if abs(value) > MAX_NUMBER:
            raise ValidationError("Number out of range", field="number", value=value, constraint=f"within {MAX_NUMBER:g}")
    elif isinstance(value, dict):
        for k, v in value.items():
            if dangerous_key(str(k)):
                raise ValidationError(f"Dangerous key {k}", field="key", value=k, constraint="plain name")
            _check(v)
    elif isinstance(value, (list, tuple)):
        if len(value) > MAX_ROWS:
            raise ValidationError("Too many rows", field="rows", value=len(value), constraint=f"at most {MAX_ROWS}")
        for v in value:
            _check(v)


def validate_parameters(params: dict[str, Any]) -> None:
    """Raise ValidationError for periods, factors or keys beyond the limits."""
    for key, value in params.items():
        if dangerous_key(key):
            raise ValidationError(f"Dangerous key {key}", field="key", value=key, constraint="plain name")
        if key == "period" and not (isinstance(value, int) and 1 <= value <= MAX_PERIOD):
            raise ValidationError("Period out of range", field=key, value=value, constraint=f"1 to {MAX_PERIOD}")
        if key in FACTORS and not (isinstance(value, (int, float, Decimal)) and MIN_FACTOR <= value <= MAX_FACTOR):
            raise ValidationError("Factor out of range", field=key, value=value, constraint=f"{MIN_FACTOR} to {MAX_FACTOR}")


def flag_bars(bars: DataFrame, now: datetime) -> DataFrame:
    """bars with unsafe: the first limit that a bar breaks, or null. now: the clock, for timestamps from a year back to a day ahead."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    bad_price, missing = F.lit(False), F.lit(False)
    for p in prices:
        missing = missing | p.isNull()
        bad_price = bad_price | (p <= 0) | (p >= MAX_PRICE)
    high_low = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    clock = F.lit(now).cast("timestamp_ntz")
    bad_time = F.col("ts").isNull() | (F.col("ts") < clock - F.expr("interval 365 days")) | (F.col("ts") > clock + F.expr("interval 1 day"))
    return bars.withColumn("unsafe", F.when(missing, "missing price").when(bad_price, "price").when((F.col("volume") < 0) | (F.col("volume") > MAX_VOLUME) | F.col("volume").isNull(), "volume").when(high_low, "range").when(bad_time, "timestamp"))


def check_bars(bars: DataFrame, now: datetime, most: int = MAX_BARS) -> None:
    """Raise ValidationError for bars from outside that are more than `most`, or for the first that flag_bars flags."""
    n = bars.limit(most + 1).count()
    if n > most:
        raise ValidationError(f"More than {most} bars", field="rows", value=n, constraint=f"at most {most}")
    found = flag_bars(bars, now).filter("unsafe is not null").agg(F.min(F.struct("symbol", "ts", "seq", "unsafe"))).first()[0]
    if found is not None:
        raise ValidationError(f"Unsafe bar: {found.unsafe}", field=found.unsafe, value=found.seq, constraint="within the limits")


class RateLimit:
    """At most `most` calls per identifier in `seconds`; on the driver only."""

    def __init__(self, most: int = 100, seconds: float = 60, clock=time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self.calls: dict[str, deque] = defaultdict(deque)

    def allow(self, identifier: str) -> bool:
        now, calls = self.clock(), self.calls[identifier]
        while calls and now - calls[0] >= self.seconds:
            calls.popleft()
        if len(calls) >= self.most:
            return False
        calls.append(now)
        return True
