"""Row-level expressions over bars, and plain aggregates with the guards the indicators rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "seq")


def series(*keys: str) -> Window:
    """Rows of a symbol (and further keys) in time order."""
    return Window.partitionBy("symbol", *keys).orderBy(*ORDER)


def trailing(n: int) -> Window:
    """The current row and the n - 1 before it."""
    return series().rowsBetween(-(n - 1), 0)


def running(*keys: str) -> Window:
    return series(*keys).rowsBetween(Window.unboundedPreceding, 0)


def number() -> Column:
    """1-based place of a row in its series."""
    return F.row_number().over(series())


def mean(value: Column, n: int) -> Column:
    """Mean of the trailing n values: an exact decimal sum, divided in double."""
    return F.sum(value).over(trailing(n)).cast("double") / F.lit(float(n))


def ratio(top: Column, bottom: Column, guard: float) -> Column:
    """top / bottom in double; guard where bottom is 0."""
    return F.when(bottom == 0, F.lit(float(guard))).otherwise(top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0)))


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")).cast("double") / 3.0


def true_range() -> Column:
    """high - low on a series' first row; else the largest of it and the distances from the close before."""
    before = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


#: Price of a bar times its factor: the sum that each variant stands for, and what it is divided by.
PRICE_VARIANTS = {
    "close": (lambda: F.col("close"), 1.0),
    "open": (lambda: F.col("open"), 1.0),
    "typical": (lambda: F.col("high") + F.col("low") + F.col("close"), 3.0),
    "weighted": (lambda: F.col("high") + F.col("low") + F.col("close") + F.col("close"), 4.0),
}


def volume_weighted_price(variant: str = "close") -> Column:
    """Price times volume of one bar."""
    price, by = PRICE_VARIANTS[variant]
    return (price() * F.col("volume")).cast("double") / by


def money_flow() -> Column:
    """Volume times the place of the close between low and high (-1 to 1); 0 where high equals low. Kept to 10 decimals, so sums do not depend on their order."""
    place = (F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))
    flow = ratio(place, F.col("high") - F.col("low"), 0) * F.col("volume")
    return flow.cast("decimal(28,10)")


def percentage_change(new: Column, old: Column) -> Column:
    """100 * (new - old) / old; 0 where old is 0."""
    return ratio((new - old) * 100, old, 0)


def zone(value: Column, over: float, under: float) -> Column:
    return F.when(value > over, "overbought").when(value < under, "oversold").otherwise("neutral")


def direction(value: Column) -> Column:
    return F.when(value > 0, "bullish").when(value < 0, "bearish").otherwise("neutral")


def forward_fill(value: Column, default: float = 0, order: tuple[str, ...] = ORDER) -> Column:
    """The last value that is not null, in the order of some columns; before the first one, the default."""
    rows = Window.partitionBy("symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(value, ignorenulls=True).over(rows), F.lit(default))


def volume_as_decimal() -> Column:
    return F.col("volume").cast("decimal(20,0)")


def round_to(value: Column, places: int = 2) -> Column:
    """value rounded half up."""
    return F.round(value, places)


def correlation(bars: DataFrame, a: str, b: str) -> DataFrame:
    """symbol, correlation: Pearson's coefficient of two columns; null for fewer than two rows or a column without spread."""
    return bars.groupBy("symbol").agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("correlation"))


def filter_zero_volume(bars: DataFrame) -> DataFrame:
    return bars.filter("volume > 0")


def has_volume(bars: DataFrame) -> DataFrame:
    """symbol, has_volume."""
    return bars.groupBy("symbol").agg(F.coalesce(F.bool_or(F.col("volume") > 0), F.lit(False)).alias("has_volume"))
