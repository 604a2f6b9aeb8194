"""Indicators over series that are too long for one task: each series is cut into ranges, and each range reads some rows before it.

Rows are numbered per series without a task per series: within buckets of time, plus the rows of the buckets before. A
range is a fixed number of rows; the last rows of one are copied to the next as its context, and what they give is
dropped. A window indicator needs as many rows as it looks back. A recurrence forgets: its context is so long that what
came before has a weight under 2**-60, less than a double can tell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParams
from .base import calculate, find, plan
from .kernels import Smooth

RANGE_ROWS = 100_000
BUCKET_SECONDS = 86_400
FORGOTTEN = 2.0**-60
#: Sums over all rows before: no context stands for them.
RUNNING = ("obv", "vwap", "accumulation_distribution")

KEYS = ("__name", "__day", "__part")


def named(symbol: Column) -> Column:
    """A symbol as a text that is never null."""
    return F.concat_ws(":", symbol.isNull().cast("int"), symbol)


def forgets(spec: Smooth) -> int:
    """Rows after which a recurrence's state has a weight under FORGOTTEN, its seed's rows included."""
    kept = 1 - (1 / spec.divide if spec.divide else spec.least if isinstance(spec.a, str) else spec.a)
    return spec.start + (math.ceil(math.log(FORGOTTEN) / math.log(kept)) if kept > 0 else 1)


def context(name: str, **params) -> int:
    """Rows before a range that it must read, of those which have all the values the indicator needs."""
    indicator = find(name)
    p = indicator.options(params)
    kernels = indicator.build(p, lambda part: part).kernels
    return 2 * indicator.periods(p) + sum(forgets(k) for k in kernels)


def numbered(bars: DataFrame, counts: Column, bucket: int = BUCKET_SECONDS) -> DataFrame:
    """bars with __n: how many rows of the series up to and with this one fulfil a condition.

    One task sees the rows of a bucket of time, and one row per bucket of a series. Rows without ts are cut by seq.
    """
    first = F.lit(-(2**62))
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(bucket * 1_000_000))
    part = F.when(F.col("ts").isNotNull(), F.lit(0)).otherwise(F.coalesce(F.floor(F.col("seq") / F.lit(RANGE_ROWS)), first))
    # Keys without nulls: the join below then finds the rows dealt as the window has dealt them.
    cut = bars.withColumns({"__name": named(F.col("symbol")), "__day": F.coalesce(day, first), "__part": part, "__one": counts.cast("long")})
    inside = Window.partitionBy(*KEYS).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("__name").orderBy(*KEYS[1:]).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*KEYS).agg(F.sum("__one").alias("__all")).select(*KEYS, F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__before"))
    told = cut.withColumn("__in", F.sum("__one").over(inside)).join(totals, list(KEYS))
    return told.withColumn("__n", F.col("__in") + F.col("__before")).drop(*KEYS, "__one", "__in", "__before")


def calculate_in_ranges(name: str, bars: DataFrame, rows: int = RANGE_ROWS, bucket: int = BUCKET_SECONDS, **params) -> DataFrame:
    """What calculate gives, with a series of any length spread over many tasks of about `rows` rows each.

    bucket: seconds that a task numbers at once; choose it so that they hold well under a task's memory. Rows with nulls
    among the values read count for no context and go with the range of the row before. Rows that share symbol, ts and
    seq have no order, here as there. Running sums (RUNNING) depend on all rows before and go the plain way.
    """
    if rows < 1 or bucket < 1:
        raise InvalidParams("rows and bucket must be positive", param="rows", value=(rows, bucket), expected="positive numbers")
    if name in RUNNING:
        return calculate(name, bars, **params)
    indicator, before = find(name), context(name, **params)
    needs = [c for c in indicator.needs(indicator.options(params)) if c in bars.columns]
    rows = max(rows, 4 * before)
    whole = F.lit(True)
    for c in needs:
        whole = whole & F.col(c).isNotNull()
    own = F.greatest(F.floor((F.col("__n") - 1) / F.lit(rows)), F.lit(0))
    told = numbered(bars.select("symbol", "ts", "seq", *needs), whole, bucket).withColumn("__own", own)
    late = F.col("__n") > (F.col("__own") + 1) * rows - before
    told = told.withColumn("__range", F.explode(F.when(late, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    kept = (F.col("__own") == F.col("__range")).alias("__kept")
    told = told.select(F.concat_ws(":", "__range", named(F.col("symbol"))).alias("symbol"), "ts", "seq", *needs, F.col("symbol").alias("__series"), kept)
    df, found = plan(told, [("x", name, params)])
    ready, columns = found["x"]
    shown = df.filter(ready & F.col("__kept"))
    return shown.select(F.col("__series").alias("symbol"), "ts", "seq", *[F.col(f"`{c}`").alias(c.split(".", 1)[1]) for c in columns])
