"""Named queries over the driver's tables, with the DuckDB SQL that each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import security
from .functions import exprs
from .operators import REGISTRY, calculate, calculate_in_ranges, quality
from .oracles import NOW, ORACLES
from .plans.pipeline import Pipeline, latest, merge
from .session import work_dir
from .sources.bars import bars_hourly, bars_orders_daily, bars_user_daily, canonicalize, from_rows, line_items, stream_bars, valid_bar, valid_result
from .streaming.incremental import ROCKSDB, stream_pipeline

Source = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, drop: tuple[str, ...] = ("seq",)) -> DataFrame:
    """df as queries return it for comparison with SQL: numbers that are not whole as doubles with 6 decimals, without a negative zero.

    2.3e-10 is added before rounding, here and in the SQL, so that exact halves go up in both: results of queries are
    shifted by that much. The library itself never rounds so.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.select(*[(F.round(F.col(c).cast("double") + F.lit(2.3e-10), 6) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "decimal") else F.col(c) for c in df.columns if c not in drop])


def indicator(name: str, bars: Source = bars_hourly, **params) -> Source:
    return lambda spark, sf_dir: rounded(calculate(name, bars(spark, sf_dir), **params))


def long_series(name: str, **params) -> Source:
    """An indicator over all line items as one series, in ranges; to 3 decimals, since sums of many terms differ in their last bits."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = calculate_in_ranges(name, line_items(spark, sf_dir), **params)
        return got.select("symbol", "ts", F.col("seq").alias("item"), (F.round(F.col("value") + F.lit(2.3e-7), 3) + F.lit(0.0)).alias("value"))

    return run


def per_row(value: Callable[[], F.Column], least: int = 1) -> Source:
    """A row-level expression over hourly bars, from the least-th row of each series."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        told = bars_hourly(spark, sf_dir).withColumns({"value": value(), "rn": exprs.number()}).filter(F.col("rn") >= least)
        return rounded(told.select("symbol", "ts", "value"))

    return run


def flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with flaws at fixed places, in order of arrival."""
    b = bars_hourly(spark, sf_dir).withColumn("seq", exprs.number().cast("long"))

    def every(n: int) -> F.Column:
        return F.col("seq") % n == 0

    return b.select(
        "symbol", F.when(every(89), None).when(every(61), F.col("ts") - F.expr("interval 3 hours")).otherwise(F.col("ts")).alias("ts"), "seq",
        F.when(~every(53), F.col("open")).alias("open"), F.when(every(47), (F.col("low") - 1).cast("decimal(18,4)")).otherwise(F.col("high")).alias("high"), "low",
        F.when(every(97), (F.col("close") * 9).cast("decimal(18,4)")).otherwise(F.col("close")).alias("close"), F.when(every(71), -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
    )


def on_flawed(operator: Callable[[DataFrame], DataFrame], drop: tuple[str, ...] = ()) -> Source:
    return lambda spark, sf_dir: rounded(operator(flawed(spark, sf_dir)), drop)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every indicator with its category, parameters and outputs."""
    rows = [(n, i.category, i.required_periods(), ",".join(p.name for p in i.params), ",".join(i.fields), i.output.example) for n, i in sorted(REGISTRY.items())]
    return spark.createDataFrame(rows, "name string, category string, required_periods int, params string, fields string, example string")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality.quality_report(flawed(spark, sf_dir))
    return rounded(told.withColumn("recommendations", F.array_join("recommendations", "; ")))


def ticks(events: DataFrame) -> DataFrame:
    """Every event as a bar that has a close alone."""
    return canonicalize(events, {"symbol": "event_type", "seq": "event_id", "close": "value"})


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two results of one shape as one, without its order, which a comparison cannot see."""
    bars = bars_hourly(spark, sf_dir)
    return rounded(merge([calculate("sma", bars, period=14), calculate("wma", bars)]))


def tolerant_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline that leaves out a stage for which bars have no column, and one that reads it."""
    bars = bars_hourly(spark, sf_dir).drop("volume")
    p = Pipeline().add_stage("sma", "sma", period=20).add_stage("flow", "chaikin_money_flow").add_stage("more", "sma", reads="flow").configure(error_handling="continue_on_error")
    done = p.execute(bars)
    return rounded(done.result("sma").withColumn("failed", F.lit(",".join(sorted(done.errors)))))


def separate_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(THREE.configure(execution_mode="separate").run_wide(bars_hourly(spark, sf_dir))).select("symbol", "ts", "sma_value", "bands_upper_band", "willr_value")


def streamed(spark: SparkSession, name: str, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream leaves when it has read all that is there."""
    folder = work_dir(spark, name)
    key, value = next(iter(ROCKSDB.items()))
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

        query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars by Structured Streaming."""
    events = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    told = stream_bars(events, "event_type", "ts", "value", "1 hour", "1 hour", "event_id")
    return rounded(streamed(spark, "bars", told.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "complete"))


def stream_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline over a stream of ticks: two indicators, and one that reads the first."""
    p = Pipeline().add_stage("sma", "sma", period=14).add_stage("sd", "standard_deviation").add_stage("slow", "sma", reads="sma", period=5)
    return rounded(streamed(spark, "averages", stream_pipeline(ticks(_event_stream(spark, sf_dir)), p), "append").drop("word"))


def sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit(" <b>"), "p_name", F.lit("</b> javascript:x"))
    told = spark.read.parquet(f"{sf_dir}/part.parquet")
    return told.select("p_partkey", security.sanitize_column(name).alias("clean"), security.dangerous_column(name).alias("dangerous"), security.dangerous_column(F.col("p_name")).alias("plain_dangerous"))


THREE = Pipeline().add_stage("sma", "sma", period=20).add_stage("bands", "bollinger_bands").add_stage("willr", "williams_r").build()
ALL = Pipeline()
for _name in REGISTRY:
    ALL = ALL.add_stage(_name, _name)


def pipeline_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(THREE.run_wide(bars_hourly(spark, sf_dir))).select("symbol", "ts", "sma_value", "bands_upper_band", "willr_value")


def pipeline_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = Pipeline().add_stage("sma", "sma", period=20).add_stage("willr", "williams_r").build()
    return rounded(two.run_long(bars_hourly(spark, sf_dir)))


def pipeline_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twenty indicators in one plan."""
    return rounded(ALL.build().run_wide(bars_hourly(spark, sf_dir)))


def previous_close() -> F.Column:
    return F.lag("close").over(exprs.series())


QUERIES: dict[str, Source] = {
    "bars_hourly": lambda s, d: rounded(bars_hourly(s, d)),
    "bars_user_daily": lambda s, d: rounded(bars_user_daily(s, d)),
    "bars_orders_daily": lambda s, d: rounded(bars_orders_daily(s, d)),
    "sma": indicator("sma", period=14),
    "sma_volume": indicator("sma", source="volume"),
    "sma_users": indicator("sma", bars_user_daily, period=5),
    "sma_orders": indicator("sma", bars_orders_daily),
    "ema_sma": indicator("ema"),
    "ema_first": indicator("ema", initialization="first_value"),
    "sma_items": long_series("sma"),
    "ema_items": long_series("ema"),
    "wma": indicator("wma"),
    "hma": indicator("hma"),
    "kama": indicator("kama"),
    "macd": indicator("macd"),
    "rsi_wilder": indicator("rsi"),
    "rsi_sma": indicator("rsi", smoothing="sma"),
    "rsi_wilder_recursive": indicator("rsi", smoothing="wilder_recursive"),
    "stochastic": indicator("stochastic"),
    "stochastic_slow": indicator("stochastic", k_smoothing=3),
    "williams_r": indicator("williams_r"),
    "cci": indicator("cci"),
    "roc_pct": indicator("roc"),
    "roc_price": indicator("roc", variant="price"),
    "momentum": indicator("momentum"),
    "momentum_norm": indicator("momentum", normalized=True, smoothing=3),
    "stddev_sample": indicator("standard_deviation"),
    "stddev_pop": indicator("standard_deviation", calculation="population"),
    "atr_sma": indicator("atr", smoothing="sma"),
    "atr_ema": indicator("atr", smoothing="ema"),
    "atr_rma": indicator("atr"),
    "bollinger": indicator("bollinger_bands"),
    "vol_hist": indicator("volatility_index"),
    "vol_gk": indicator("volatility_index", method="garman_klass"),
    "vol_parkinson": indicator("volatility_index", method="parkinson"),
    "obv": indicator("obv"),
    "vwap_none": indicator("vwap"),
    "vwap_daily": indicator("vwap", session_reset="daily"),
    "vwap_weekly": indicator("vwap", session_reset="weekly"),
    "vwap_monthly": indicator("vwap", session_reset="monthly"),
    "vwap_typical": indicator("vwap", variant="typical", session_reset="daily"),
    "vwap_weighted": indicator("vwap", variant="weighted", session_reset="daily"),
    "ad_line": indicator("accumulation_distribution"),
    "cmf": indicator("chaikin_money_flow"),
    "true_range": per_row(exprs.true_range),
    "typical_price": per_row(exprs.typical_price),
    "pct_change": per_row(lambda: exprs.percentage_change(F.col("close"), previous_close()), 2),
    "volume_price": per_row(lambda: exprs.volume_weighted_price("typical")),
    "statistics": lambda s, d: rounded(quality.statistics(bars_hourly(s, d))),
    "volume_decimal": lambda s, d: rounded(bars_hourly(s, d).select("symbol", "ts", exprs.volume_as_decimal().alias("value"))),
    "round_to": lambda s, d: rounded(bars_hourly(s, d).select("symbol", "ts", exprs.round_to(F.col("close")).alias("value"))),
    "correlation": lambda s, d: rounded(exprs.correlation(bars_hourly(s, d), "close", "volume")),
    "filter_zero_volume": on_flawed(lambda b: exprs.filter_zero_volume(b).select("symbol", "seq", "volume")),
    "has_volume": on_flawed(exprs.has_volume),
    "valid_ohlcv": on_flawed(lambda b: b.select("symbol", "seq", F.coalesce(valid_bar(b.columns), F.lit(False)).alias("valid"))),
    "valid_result": lambda s, d: calculate("sma", bars_hourly(s, d), period=14).select("symbol", "ts", valid_result().alias("valid")),
    "canonical_ticks": lambda s, d: rounded(ticks(s.read.parquet(f"{d}/events.parquet")), ()),
    "list_source": lambda s, d: rounded(calculate("sma", from_rows(s, [1, 2.5, 4, 8]), period=2).select("symbol", "value")),
    "dq_report": on_flawed(quality.report),
    "dq_issues": on_flawed(quality.issues),
    "dq_outliers_iqr": on_flawed(lambda b: quality.outliers(b, "iqr")),
    "dq_outliers_z": on_flawed(lambda b: quality.outliers(b, "zscore")),
    "dq_outliers_modz": on_flawed(lambda b: quality.outliers(b, "modified_zscore")),
    "dq_fill_fwd": on_flawed(lambda b: quality.fill_gaps(b, "forward_fill")),
    "dq_fill_bwd": on_flawed(lambda b: quality.fill_gaps(b, "backward_fill")),
    "dq_remove": on_flawed(lambda b: quality.fill_gaps(b, "remove")),
    "dq_norm_minmax": on_flawed(lambda b: quality.normalize(b, "minmax").select("symbol", "ts", "seq", "close")),
    "dq_norm_z": on_flawed(lambda b: quality.normalize(b, "zscore").select("symbol", "ts", "seq", "close")),
    "dq_norm_robust": on_flawed(lambda b: quality.normalize(b, "robust").select("symbol", "ts", "seq", "close")),
    "dq_quality_report": quality_report,
    "dq_fill_interp": on_flawed(lambda b: quality.fill_gaps(b, "interpolate")),
    "dq_norm_none": on_flawed(lambda b: quality.normalize(b, "none").select("symbol", "ts", "seq", "close")),
    "dq_outliers_forest": on_flawed(lambda b: quality.outliers(b, "isolation_forest")),
    "unsafe_bars": on_flawed(lambda b: security.flag_bars(b, NOW).select("symbol", "seq", "unsafe")),
    "sanitized": sanitized,
    "ffill": on_flawed(lambda b: b.select("symbol", "seq", exprs.forward_fill(F.col("open"), 0, ("seq",)).alias("value"))),
    "pipeline_wide": pipeline_wide,
    "pipeline_long": pipeline_long,
    "pipeline_latest": lambda s, d: rounded(latest(calculate("sma", bars_hourly(s, d), period=14))),
    "pipeline_all": pipeline_all,
    "pipeline_merge": merged,
    "pipeline_tolerant": tolerant_pipeline,
    "pipeline_separate": separate_pipeline,
    "stream_hourly": stream_hourly,
    "stream_averages": stream_averages,
    "registry": registry,
}

__all__ = ["ORACLES", "QUERIES"]
