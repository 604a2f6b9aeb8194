"""Data quality of bars, per symbol in order of arrival (seq): report, issues, outliers, gap filling, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParams
from ..sources.bars import PRICES, valid_bar

# What an issue is called, in order of precedence of the price rules.
PRICE_RULES = (
    ("high", "<", "low", "High price is less than low price"),
    ("high", "<", "open", "High price is less than open price"),
    ("high", "<", "close", "High price is less than close price"),
    ("low", ">", "open", "Low price is greater than open price"),
    ("low", ">", "close", "Low price is greater than close price"),
)
Z_THRESHOLD = 3.0
MODIFIED_Z_THRESHOLD = 3.5


def arrival() -> Window:
    return Window.partitionBy("symbol").orderBy("seq")


def _whole() -> Window:
    return Window.partitionBy("symbol")


def price_rule() -> Column:
    """Description of the first rule that a bar's prices break; null if none."""
    missing = F.lit(False)
    for c in PRICES:
        missing = missing | F.col(c).isNull()
    out = F.when(missing, F.lit("Missing OHLC data"))
    for a, sign, b, text in PRICE_RULES:
        out = out.when(F.col(a) < F.col(b) if sign == "<" else F.col(a) > F.col(b), F.lit(text))
    return out


def _beside(bars: DataFrame, told: DataFrame) -> DataFrame:
    """bars with the columns of told (one row per symbol) beside them; Spark decides from its size how to join."""
    told = told.withColumnRenamed("symbol", "__s")
    return bars.join(told, F.col("symbol").eqNullSafe(F.col("__s")), "left").drop("__s")


def middle(values: DataFrame, name: str) -> DataFrame:
    """symbol and the median of x, by rank: a long series is sorted with spilling and never held in one row."""
    counted = _beside(values.filter("x is not null"), values.groupBy("symbol").agg(F.count("x").alias("__n")))
    ranked = counted.withColumn("i", F.row_number().over(_whole().orderBy("x")))
    half = (F.col("__n") + 1) / 2
    return ranked.groupBy("symbol").agg(F.avg(F.when((F.col("i") == F.floor(half)) | (F.col("i") == F.ceil(half)), F.col("x"))).alias(name))


def quartile_bounds(bars: DataFrame, field: str = "close") -> DataFrame:
    """symbol, q1, q3, n: the values at the places trunc(n / 4) and trunc(3 n / 4) of the sorted ones, counted from 0.

    By rank, not by a list: a long series is sorted with spilling and never held in one row.
    """
    x = F.col(field).cast("double")
    ranked = bars.select("symbol", x.alias("x")).filter("x is not null")
    ranked = _beside(ranked, ranked.groupBy("symbol").agg(F.count("*").alias("n"))).withColumn("i", F.row_number().over(_whole().orderBy("x")))
    places = [F.max(F.when(F.col("i") == F.floor(F.col("n") * q) + 1, F.col("x"))).alias(name) for q, name in ((0.25, "q1"), (0.75, "q3"))]
    return ranked.groupBy("symbol").agg(*places, F.max("n").alias("n"))


def with_outlier_flag(bars: DataFrame, method: str = "iqr", field: str = "close", threshold: float | None = None, flag: str = "outlier") -> DataFrame:
    """bars with a boolean: whether the field is an outlier of its symbol.

    iqr: beyond 1.5 interquartile ranges from the quartiles, from four values on. zscore: more than threshold (3)
    population deviations from the mean, from three values on. modified_zscore: the same with 3.5. isolation_forest: none.
    """
    x = F.col(field).cast("double")
    if method == "iqr":
        # The bounds are one row per symbol; Spark decides from their size how to join.
        bounds = quartile_bounds(bars, field).select(F.col("symbol").alias("__s"), "q1", "q3", F.col("n").alias("__n"))
        joined = bars.join(bounds, F.col("symbol").eqNullSafe(F.col("__s")), "left")
        reach = (F.col("q3") - F.col("q1")) * 1.5
        out = (F.col("__n") >= 4) & ((x < F.col("q1") - reach) | (x > F.col("q3") + reach))
        return joined.withColumn(flag, F.coalesce(out, F.lit(False))).drop("__s", "q1", "q3", "__n")
    if method in ("zscore", "modified_zscore"):
        limit = MODIFIED_Z_THRESHOLD if method == "modified_zscore" else Z_THRESHOLD if threshold is None else threshold
        told = bars.groupBy("symbol").agg(F.avg(x).alias("__m"), F.stddev_pop(x).alias("__sd"), F.count(x).alias("__n"))
        far = (F.col("__n") >= 3) & (F.col("__sd") > 0) & (F.abs(x - F.col("__m")) > F.lit(float(limit)) * F.col("__sd"))
        return _beside(bars, told).withColumn(flag, F.coalesce(far, F.lit(False))).drop("__m", "__sd", "__n")
    if method == "isolation_forest":
        return bars.withColumn(flag, F.lit(False))
    raise InvalidParams(f"Unknown outlier method {method!r}", param="method", value=method, expected="iqr, zscore, modified_zscore or isolation_forest")


def outliers(bars: DataFrame, method: str = "iqr", field: str = "close", threshold: float | None = None) -> DataFrame:
    """symbol, seq, field, value, method of the outliers."""
    found = with_outlier_flag(bars, method, field, threshold).filter("outlier")
    return found.select("symbol", "seq", F.lit(field).alias("field"), F.col(field).cast("double").alias("value"), F.lit(method).alias("method"))


def _flagged(bars: DataFrame) -> DataFrame:
    same = Window.partitionBy("symbol", "ts").orderBy("seq")
    flagged = with_outlier_flag(bars).withColumns(
        {
            "valid": F.coalesce(valid_bar(bars.columns), F.lit(False)), "missing_ts": F.col("ts").isNull(), "repeat": F.row_number().over(same) > 1,
            "backwards": F.coalesce(F.lag("ts").over(arrival()) > F.col("ts"), F.lit(False)), "rule": price_rule(), "bad_volume": F.coalesce(F.col("volume") < 0, F.lit(False)),
        }
    )
    return flagged


def _kinds() -> list[tuple[Column, str, Column, str]]:
    """(condition, type, description, severity) of every kind of issue."""
    return [
        (~F.col("valid"), "invalid_data", F.lit("Invalid OHLCV data point"), "high"),
        (F.col("missing_ts"), "missing_data", F.lit("Missing timestamp"), "critical"),
        (F.col("repeat"), "duplicate", F.lit("Duplicate timestamp"), "medium"),
        (F.col("backwards"), "chronological_error", F.lit("Timestamp out of chronological order"), "high"),
        (F.col("rule").isNotNull(), "invalid_data", F.col("rule"), "high"),
        (F.col("bad_volume"), "invalid_data", F.lit("Negative volume"), "high"),
        (F.col("outlier"), "outlier", F.lit("Statistical outlier detected in close price"), "medium"),
    ]


def issues(bars: DataFrame) -> DataFrame:
    """symbol, seq, type, description, severity: a row for each issue of each bar. Rows without a timestamp count as repeats of one another."""
    found = [F.when(c, F.struct(F.lit(kind).alias("type"), text.alias("description"), F.lit(severity).alias("severity"))) for c, kind, text, severity in _kinds()]
    listed = _flagged(bars).select("symbol", "seq", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i"))
    return listed.select("symbol", "seq", "i.type", "i.description", "i.severity")


def report(bars: DataFrame) -> DataFrame:
    """One row per symbol: points, valid and invalid ones, counts of issues, quality_score = max(0, 100 (points - issues) / points)."""
    each = F.lit(0)
    for condition, *_ in _kinds():
        each = each + condition.cast("int")
    total = _flagged(bars).withColumn("n_issues", each).groupBy("symbol").agg(
        F.count("*").alias("total_points"), F.count_if("valid").alias("valid_points"), F.count_if(~F.col("valid")).alias("invalid_points"),
        F.count_if("missing_ts").alias("missing_timestamps"), F.count_if("repeat").alias("duplicate_timestamps"), F.count_if("backwards").alias("chronological_errors"),
        F.count_if("outlier").alias("outliers_detected"), F.count_if(F.col("rule").isNotNull()).alias("ohlc_violations"), F.count_if(F.col("volume") == 0).alias("zero_volume_count"), F.sum("n_issues").cast("long").alias("n_issues"),
    )
    return total.withColumn("quality_score", F.greatest(F.lit(0.0), (F.col("total_points") - F.col("n_issues")) / F.col("total_points") * 100.0))


def quality_report(bars: DataFrame) -> DataFrame:
    """report with sections computed from the data (coverage, consistency, regularity) and recommendations."""
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts", "seq")).cast("timestamp"))
    steps = bars.filter("ts is not null").withColumn("gap", gap).filter("gap > 0")
    usual = steps.groupBy("symbol").agg(F.min("gap").alias("step"), F.sum("gap").alias("span"), F.count("*").alias("n_gaps"))
    wide = steps.join(usual.select("symbol", "step"), "symbol").groupBy("symbol").agg(F.count_if(F.col("gap") > F.col("step")).alias("irregular_intervals"))
    told = report(bars).join(usual, "symbol", "left").join(wide, "symbol", "left")
    advice = F.array_compact(
        F.array(
            F.when(F.col("chronological_errors") > 0, "Sort data by timestamp to fix chronological order"),
            F.when(F.col("outliers_detected") > 0, "Review detected outliers for data integrity"),
            F.when(F.col("quality_score") < 80, "Consider data cleaning to improve overall quality"),
        )
    )
    irregular = F.coalesce("irregular_intervals", F.lit(0))
    return told.select(
        *[c for c in report(bars).columns], F.coalesce((F.col("n_gaps") + 1) / (F.col("span") / F.col("step") + 1) * 100.0, F.lit(100.0)).alias("coverage_percentage"),
        irregular.alias("irregular_intervals"), F.coalesce((F.col("n_gaps") - irregular) / F.col("n_gaps") * 100.0, F.lit(100.0)).alias("regularity_score"),
        ((F.col("total_points") - F.col("ohlc_violations")) / F.col("total_points") * 100.0).alias("consistency_score"), advice.alias("recommendations"),
    )


def fill_gaps(bars: DataFrame, method: str = "forward_fill") -> DataFrame:
    """bars whose unusable rows take the close of the last usable one (of the next one: backward_fill) for all four prices.

    Rows with no such neighbour go; ts and volume stay as they are. interpolate is forward_fill; remove drops unusable rows.
    """
    ok = F.coalesce(valid_bar(bars.columns), F.lit(False))
    if method == "remove":
        return bars.filter(ok)
    if method not in ("forward_fill", "interpolate", "backward_fill"):
        raise InvalidParams(f"Unknown fill method {method!r}", param="method", value=method, expected="forward_fill, backward_fill, interpolate or remove")
    close = F.when(ok, F.col("close"))
    if method == "backward_fill":
        near = F.first(close, ignorenulls=True).over(arrival().rowsBetween(1, Window.unboundedFollowing))
    else:
        near = F.last(close, ignorenulls=True).over(arrival().rowsBetween(Window.unboundedPreceding, -1))
    marked = bars.withColumns({"__ok": ok, "__near": near}).filter(F.col("__ok") | F.col("__near").isNotNull())
    return marked.withColumns({c: F.when(F.col("__ok"), F.col(c)).otherwise(F.col("__near")) for c in PRICES}).select(*bars.columns)


def normalize(bars: DataFrame, method: str = "minmax", field: str = "close") -> DataFrame:
    """bars with the field as a double on a common scale: minmax (0 to 1), zscore, robust (median and median absolute deviation), none.

    Where the scale is 0 or a symbol has too few values, the field keeps its values.
    """
    x = F.col(field).cast("double")
    if method == "none":
        return bars.withColumn(field, x)
    values = bars.select("symbol", x.alias("x"))
    if method == "minmax":
        told = values.groupBy("symbol").agg(F.min("x").alias("__from"), (F.max("x") - F.min("x")).alias("__by"), F.lit(2).alias("__n"))
    elif method == "zscore":
        told = values.groupBy("symbol").agg(F.avg("x").alias("__from"), F.stddev_pop("x").alias("__by"), F.count("x").alias("__n"))
    elif method == "robust":
        med = middle(values, "__from")
        spread = middle(_beside(values, med).select("symbol", F.abs(F.col("x") - F.col("__from")).alias("x")), "__by")
        told = med.join(spread, "symbol").join(values.groupBy("symbol").agg(F.count("x").alias("__n")), "symbol")
    else:
        raise InvalidParams(f"Unknown normalisation {method!r}", param="method", value=method, expected="minmax, zscore, robust or none")
    scaled = F.when((F.col("__n") >= 2) & (F.col("__by") > 0), (x - F.col("__from")) / F.nullif(F.col("__by"), F.lit(0.0))).otherwise(x)
    return _beside(bars, told).withColumn(field, scaled).drop("__from", "__by", "__n")


def statistics(bars: DataFrame, field: str = "close") -> DataFrame:
    """Per symbol: mean, sample variance and standard deviation (0 for fewer than two values), median, median absolute deviation."""
    values = bars.select("symbol", F.col(field).cast("double").alias("x"))
    plain = values.groupBy("symbol").agg(F.avg("x").alias("mean"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("variance"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("standard_deviation"))
    med = middle(values, "median")
    mad = middle(_beside(values, med).select("symbol", F.abs(F.col("x") - F.col("median")).alias("x")), "mad")
    return plain.join(med, "symbol", "left").join(mad, "symbol", "left")
