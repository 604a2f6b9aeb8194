"""Bars: the canonical columns, and bars built from ticks.

Canonical bars: symbol STRING, ts TIMESTAMP_NTZ, seq BIGINT (order of rows that share a ts, or of rows without any),
open, high, low, close DECIMAL(18, 4), volume BIGINT. Indicators need the columns they read only.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidDataFormat, ValidationError, insufficient_data

PRICE = "decimal(18,4)"
PRICES = ("open", "high", "low", "close")


def canonicalize(df: DataFrame, mapping: dict[str, str] | None = None, symbol: str = "series") -> DataFrame:
    """df with canonical columns, taken under the same names or by mapping (canonical name -> own name).

    Without a symbol column all rows are the one series `symbol`; without ts the order is seq alone; without seq it is 0.
    Price columns that are missing stay missing. A bare price list is a frame of seq and close.
    """
    mapping = mapping or {}
    names = {c: mapping.get(c, c) for c in ("symbol", "ts", "seq", *PRICES, "volume")}
    have = {c: n for c, n in names.items() if n in df.columns}
    if not any(c in have for c in PRICES):
        raise InvalidDataFormat("No price column", expected=PRICES, received=tuple(df.columns))
    cols = [(F.col(have["symbol"]).cast("string") if "symbol" in have else F.lit(symbol)).alias("symbol")]
    cols.append((F.col(have["ts"]) if "ts" in have else F.lit(None)).cast("timestamp_ntz").alias("ts"))
    cols.append((F.col(have["seq"]) if "seq" in have else F.lit(0)).cast("long").alias("seq"))
    cols += [F.col(have[c]).cast(PRICE).alias(c) for c in PRICES if c in have]
    if "volume" in have:
        cols.append(F.col(have["volume"]).cast("long").alias("volume"))
    return df.select(*cols)


def from_rows(spark: SparkSession, rows: list, symbol: str = "series") -> DataFrame:
    """Canonical bars from Python values in their order: closes as numbers, (open, high, low, close, volume) tuples, or mappings with those names and ts."""
    if not rows:
        raise insufficient_data(1, 0)
    told = []
    for i, row in enumerate(rows):
        if isinstance(row, (int, float, Decimal)) and not isinstance(row, bool):
            row = {"close": row}
        elif isinstance(row, (tuple, list)) and len(row) == 5:
            row = dict(zip((*PRICES, "volume"), row, strict=True))
        elif not isinstance(row, dict) or "close" not in row:
            raise InvalidDataFormat(f"Row {i} is no bar", expected="a number, five values or a mapping with close", received=repr(row)[:80])
        told.append((row.get("symbol", symbol), row.get("ts"), i, *(None if row.get(c) is None else str(row[c]) for c in PRICES), row.get("volume")))
    kept = [c for k, c in enumerate(PRICES) if any(r[3 + k] is not None for r in told)]
    df = spark.createDataFrame(told, "symbol string, ts timestamp_ntz, seq long, open string, high string, low string, close string, volume long")
    return canonicalize(df.select("symbol", "ts", "seq", *kept, *(("volume",) if any(r[-1] is not None for r in told) else ())))


def all_decimals(df: DataFrame, *columns: str) -> bool:
    """Whether all these columns (all of df's, if none is named) hold decimals."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return all(isinstance(kinds.get(c), T.DecimalType) for c in columns or df.columns)


def all_numbers(df: DataFrame, *columns: str) -> bool:
    """Whether all these columns (all of df's, if none is named) hold numbers."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return all(isinstance(kinds.get(c), T.NumericType) for c in columns or df.columns)


def validate_volumes(bars: DataFrame) -> None:
    """Raise InvalidDataFormat without a volume column, ValidationError for the first volume that is null, negative or no whole number. No rows are fine."""
    if "volume" not in bars.columns:
        raise InvalidDataFormat("No volume column", expected="volume", received=tuple(bars.columns))
    told = F.col("volume").cast("string")
    whole = F.coalesce(told.rlike(r"^[0-9]+(\.0+)?([eE][0-9]+)?$"), F.lit(False))
    keys = [c for c in ("symbol", "ts", "seq") if c in bars.columns]
    found = bars.agg(F.min(F.when(~whole, F.struct(*keys, told.alias("volume")))).alias("first")).first()
    if found.first is not None:
        raise ValidationError(f"Volume must be a non-negative integer, got {found.first.volume}", field="volume", value=found.first.volume, constraint="non-negative integer")


def valid_result(fields: tuple[str, ...] = ("value",)) -> Column:
    """Whether a row is an indicator's result: it has a time and a value in one of its fields."""
    out = F.lit(False)
    for c in fields:
        out = out | F.col(c).isNotNull()
    return F.col("ts").isNotNull() & out


def bars_from_ticks(ticks: DataFrame, symbol: str, ts: str, price: str, unit: str, tiebreak: str) -> DataFrame:
    """One bar per symbol and calendar unit (hour, day, ...): first and last price by (ts, tiebreak), extremes, number of ticks.

    One partial and one final aggregation: a symbol that holds a third of all ticks sends one row per bar and task.
    """
    order = F.struct(F.col(ts), F.col(tiebreak))
    value = F.col(price).cast(PRICE)
    bucket = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("ts")
    return ticks.groupBy(F.col(symbol).cast("string").alias("symbol"), bucket).agg(
        F.lit(0).cast("long").alias("seq"), F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.max_by(value, order).alias("close"), F.count("*").alias("volume"),
    )


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events.value per event type."""
    return bars_from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", "hour", "event_id")


def bars_user_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of events.value per user: many short series."""
    return bars_from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "value", "day", "event_id")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as one long series of closes, by shipping date, order, line and price (lines repeat in an order)."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")
    return canonicalize(items.select("l_shipdate", F.col("l_extendedprice").alias("close"), seq.cast("long").alias("seq")), {"ts": "l_shipdate"}, "items")


def bars_orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals per priority; orders of a day go by their key."""
    return bars_from_ticks(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", "day", "o_orderkey")


def stream_bars(ticks: DataFrame, symbol: str, ts: str, price: str, width: str, late: str, tiebreak: str) -> DataFrame:
    """Bars of a tick stream: tumbling windows of `width`, final once the watermark `late` has passed."""
    order = F.struct(F.col(ts), F.col(tiebreak))
    value = F.col(price).cast(PRICE)
    grouped = ticks.withWatermark(ts, late).groupBy(F.window(ts, width), F.col(symbol).cast("string").alias("symbol"))
    bars = grouped.agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").alias("volume"))
    return bars.select("symbol", F.col("window.start").alias("ts"), F.lit(0).cast("long").alias("seq"), "open", "high", "low", "close", "volume")


def valid_bar(columns: list[str]) -> Column:
    """Whether a row is a usable bar: every price and the ts present, volume not negative. High and low are not compared."""
    parts = [F.col(c).isNotNull() for c in (*PRICES, "ts", "volume") if c in columns or c == "ts"]
    if "volume" in columns:
        parts.append(F.coalesce(F.col("volume") >= 0, F.lit(False)))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def validate_bars(bars: DataFrame) -> None:
    """Raise InsufficientData if there are no bars, InvalidDataFormat for the first unusable one in (symbol, ts, seq) order."""
    bad = F.coalesce(~valid_bar(bars.columns), F.lit(True))
    found = bars.agg(F.count("*").alias("n"), F.min(F.when(bad, F.struct("symbol", "ts", "seq"))).alias("first")).first()
    if not found.n:
        raise insufficient_data(1, 0)
    if found.first is not None:
        raise InvalidDataFormat("Unusable bar", expected="prices, ts, volume of 0 or more", received=found.first.asDict())
