"""Parameters, pipelines, quality, streaming, limits."""

import random
from datetime import timedelta
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import T0, bars, values
from tickframe import performance, security
from tickframe.errors import InsufficientData, InvalidDataFormat, InvalidParams, StreamStateError, ValidationError
from tickframe.operators import REGISTRY, available, calculate, info, quality
from tickframe.params import ParamMeta, resolve_period, validate_params
from tickframe.plans.pipeline import Pipeline, aggregate_metrics, latest, merge
from tickframe.sources.bars import all_decimals, all_numbers, canonicalize, from_rows, stream_bars, validate_volumes
from tickframe.streaming.incremental import PipelineStream, Stream, compose_streams, init_stream, stream_indicators, stream_metrics, update_stream


def walk(n, seed=1):
    r = random.Random(seed)
    price, out = 100.0, []
    for _ in range(n):
        o = price
        price = max(1.0, round(price + r.uniform(-3, 3), 2))
        high, low = round(max(o, price) + r.random(), 2), round(min(o, price) - r.random() * 0.5, 2)
        out.append((round(o, 2), high, low, price, r.randrange(0, 500)))
    return out


def test_registry():
    assert [len(available(c)) for c in ("trend", "momentum", "volatility", "volume")] == [6, 6, 4, 4]
    assert info("rsi")["required_periods"] == 15
    with pytest.raises(InvalidParams):
        info("nothing")


def test_parameters():
    meta = (ParamMeta("n", "integer", 3, min=1, max=9), ParamMeta("kind", "string", "a", options=("a", "b")), ParamMeta("must", "float", required=True))
    assert validate_params({"must": 1, "other": 2}, meta) == {"n": 3, "kind": "a", "must": 1}
    for bad in ({}, {"must": 1, "n": 10}, {"must": 1, "n": True}, {"must": 1, "kind": "c"}, {"must": "x"}):
        with pytest.raises(InvalidParams):
            validate_params(bad, meta)
    assert [resolve_period(x) for x in ("short", "medium", "long", 7)] == [14, 21, 50, 7]
    with pytest.raises(InvalidParams):
        resolve_period(0)


@given(st.lists(st.floats(1, 1000).map(lambda x: round(x, 2)), min_size=1, max_size=60), st.integers(1, 8))
@settings(max_examples=50, deadline=None)
def test_streams_of_averages_stay_within_their_window(closes, n):
    for name in ("sma", "wma"):
        stream, out = Stream(name, period=n), []
        for i, c in enumerate(closes):
            r = stream.update({"close": c})
            if r:
                out.append(r["value"])
                window = closes[max(0, i - n + 1) : i + 1]
                assert min(window) - 1e-9 <= r["value"] <= max(window) + 1e-9
        assert len(out) == max(0, len(closes) - n + 1)


@given(st.lists(st.floats(1, 1000).map(lambda x: round(x, 2)), min_size=16, max_size=60))
@settings(max_examples=50, deadline=None)
def test_stream_of_rsi_stays_in_range(closes):
    stream = Stream("rsi")
    assert all(0 <= r["value"] <= 100 for r in (stream.update({"close": c}) for c in closes) if r)


SAME_IN_BATCH = {n: {} for n in REGISTRY} | {"rsi": dict(smoothing="wilder_recursive"), "atr": dict(smoothing="sma")}


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_stream_equals_batch(spark, name):
    rows, params = walk(60), SAME_IN_BATCH[name]
    batch = calculate(name, bars(spark, rows), **params).orderBy("ts").collect()
    stream, out = Stream(name, **params), []
    for i, (o, h, lo, c, v) in enumerate(rows):
        if i == 30:
            stream = Stream.restore(stream.snapshot())
        r = stream.update({"ts": T0 + i * timedelta(minutes=1), "open": o, "high": h, "low": lo, "close": c, "volume": v})
        if r:
            out.append(r)
    assert len(out) == len(batch)
    for a, b in zip(out, batch, strict=True):
        for k, v in a.items():
            assert v == b[k] if isinstance(v, (str, bool)) or v is None else v == pytest.approx(float(b[k]), abs=1e-5), k


def test_stream_of_atr_starts_anew_at_the_nth_bar():
    stream = Stream("atr", period=2)
    rows = [(105, 95, 102), (108, 100, 106), (110, 103, 107)]
    got = [stream.update({"high": h, "low": lo, "close": c}) for h, lo, c in rows]
    assert got[0] is None and got[1]["value"] == 8 and got[2]["value"] == 7.5


def test_foreign_state():
    with pytest.raises(StreamStateError):
        Stream.restore("{}")


def test_structured_streaming(spark, tmp_path):
    rows = walk(40)
    df = bars(spark, rows, "a").unionByName(bars(spark, walk(40, 2), "b"))
    source = str(tmp_path / "in")
    df.filter("seq < 25").coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema(df.schema).parquet(source)
        q = stream_indicators(stream, [("fast", "sma", {"period": 5}), ("bands", "bollinger_bands", {"period": 10})]).writeStream.format("parquet")
        q = q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        told = stream_metrics(q)
        assert told["rows"] > 0 and told["batches"] >= 1 and told["rows_a_second"] > 0

    run()
    df.filter("seq >= 25").coalesce(1).write.mode("append").parquet(source)
    run()  # goes on from its state
    got = spark.read.parquet(str(tmp_path / "out"))
    fast = [r.number for r in got.filter("stage = 'fast' and symbol = 'a'").orderBy("ts").collect()]
    assert fast == pytest.approx(values(calculate("sma", df.filter("symbol = 'a'"), period=5)), abs=1e-9)
    assert got.filter("stage = 'bands' and field = 'upper_band'").count() == 62


def test_bars_of_a_tick_stream(spark, tmp_path):
    ticks = spark.createDataFrame([("x", T0 + timedelta(seconds=20 * i), float(i), i) for i in range(12)], "k string, at timestamp_ntz, price double, id long").withColumn("at", F.col("at").cast("timestamp"))
    ticks.coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = stream_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "t")), "k", "at", "price", "1 minute", "10 seconds", "id")
    q = stream.writeStream.format("memory").queryName("ticks").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = [(float(r.open), float(r.close), r.volume) for r in spark.sql("select * from ticks order by ts").collect()]
    assert got[:3] == [(0, 2, 3), (3, 5, 3), (6, 8, 3)]


def test_pipeline(spark):
    df = bars(spark, walk(60))
    p = Pipeline().add_stage("fast", "sma", period=5).add_stage("trend", "macd").add_stage("smooth", "ema", reads="fast", period=3).add_dependency("trend", "fast").build()
    wide = p.run_wide(df)
    assert {"fast_value", "trend_macd", "trend_signal", "trend_histogram", "smooth_value"} <= set(wide.columns)
    assert wide.filter("fast_value is not null").count() == 56 and wide.filter("smooth_value is not null").count() == 54
    long = p.run_long(df)
    assert long.filter("stage = 'fast'").count() == 56
    assert [s.label for s in Pipeline().add_stage("a", "sma").add_stage("b", "ema").add_dependency("a", "b").order()] == ["b", "a"]
    for bad in (Pipeline(), Pipeline().add_stage("a", "sma").add_dependency("a", "x"), Pipeline().add_stage("a", "sma").add_dependency("a", "a"), Pipeline().add_stage("a", "sma").add_stage("b", "sma").add_dependency("a", "b").add_dependency("b", "a")):
        with pytest.raises((ValidationError, InvalidParams)):
            bad.build()
    one = calculate("sma", df, period=5)
    assert merge([one, one]).count() == 112 and latest(one).count() == 1


def test_wide_pipeline_equals_single_indicators(spark):
    df = bars(spark, walk(60))
    p = Pipeline()
    for name in REGISTRY:
        p = p.add_stage(name, name)
    wide = {r.ts: r for r in p.run_wide(df).collect()}
    for name, indicator in REGISTRY.items():
        single = {r.ts: r for r in calculate(name, df).collect()}
        for field in indicator.fields:
            assert {t: wide[t][f"{name}_{field}"] for t in single} == {t: r[field] for t, r in single.items()}, (name, field)
            assert all(r[f"{name}_{field}"] is None for t, r in wide.items() if t not in single)


def test_execution_of_a_pipeline(spark):
    df = bars(spark, walk(40)).drop("volume")
    p = Pipeline().add_stage("fast", "sma", period=5).add_stage("flow", "obv").add_stage("on_flow", "ema", reads="flow", period=3).add_dependency("on_flow", "flow")
    with pytest.raises(InvalidDataFormat):
        p.execute(df)
    done = p.configure(error_handling="continue_on_error").execute(df)
    assert set(done.errors) == {"flow", "on_flow"} and done.result("fast").count() == 36
    told = done.metrics()
    assert told["rows"] == 40 and told["stage_rows"] == {"fast": 36} and told["error_count"] == 2 and told["processing_seconds"] > 0
    assert aggregate_metrics([told, told])["rows"] == 80 and aggregate_metrics([told, told])["error_count"] == 4
    with pytest.raises(InvalidParams):
        done.result("flow")
    with pytest.raises(InsufficientData):
        Pipeline().add_stage("long", "sma", period=50).execute(df, strict=True)
    assert Pipeline().add_stage("long", "sma", period=50).configure(error_handling="continue_on_error").execute(df, strict=True).wide.count() == 40
    for bad in ({"error_handling": "hope"}, {"speed": "high"}):
        with pytest.raises(InvalidParams):
            p.configure(**bad)


def test_a_pipeline_over_a_stream(spark):
    rows = walk(60)
    p = Pipeline().add_stage("fast", "sma", period=5).add_stage("slow", "sma", reads="fast", period=4).add_stage("bands", "bollinger_bands").build()
    wide = {r.ts: r for r in p.run_wide(bars(spark, rows)).collect()}
    stream = PipelineStream(p)
    for i, (o, h, lo, c, v) in enumerate(rows):
        at = T0 + i * timedelta(minutes=1)
        if i == 30:
            stream = PipelineStream(p).load(stream.snapshot())
        found = stream.update({"ts": at, "open": o, "high": h, "low": lo, "close": c, "volume": v})
        for column, value in (("fast_value", found.get("fast", {}).get("value")), ("slow_value", found.get("slow", {}).get("value")), ("bands_upper_band", found.get("bands", {}).get("upper_band"))):
            assert (value is None and wide[at][column] is None) or value == pytest.approx(wide[at][column], abs=1e-4)  # a read result has four decimals in batch
    assert stream.metrics["executions"] == 30 and stream.metrics["error_count"] == 0
    with pytest.raises(StreamStateError):
        stream.load(PipelineStream(Pipeline().add_stage("other", "sma")).snapshot())


def test_failing_stages_of_a_stream():
    p = Pipeline().add_stage("fast", "sma", period=2).add_stage("flow", "obv")
    strict, lenient = PipelineStream(p), PipelineStream(p.configure(error_handling="continue_on_error"))
    before = strict.snapshot()
    with pytest.raises(StreamStateError):
        strict.update({"close": 1})
    assert strict.snapshot() == before and strict.metrics["error_count"] == 1
    assert lenient.update({"close": 1}) == {} and lenient.update({"close": 3}) == {"fast": {"value": 2.0}} and lenient.metrics["error_count"] == 2


def test_composed_streams_and_streams_of_a_category():
    both = compose_streams(("sma", {"period": 2}), [("sma", {"period": 2}), ("roc", {"period": 1})])
    got = [both.update({"close": c}) for c in (1, 3, 5, 7)]
    assert got[0] == {} and got[1] == {"primary": {"value": 2.0}} and got[2]["dependent_0"]["value"] == 3.0 and got[2]["dependent_1"]["value"] == 100.0
    same = compose_streams(("sma", {"period": 2}), [("ema", {"period": 1})], reads=False)
    assert same.update({"close": 4}) == {"dependent_0": {"value": 4.0}}
    stream = init_stream("trend", "sma", period=2)
    after, found = update_stream(stream, {"close": 1})
    assert found is None and update_stream(after, {"close": 3})[1] == {"value": 2.0} and stream.s == {}
    with pytest.raises(InvalidParams):
        init_stream("volume", "sma")


def test_bars_from_python_values(spark):
    assert values(calculate("sma", from_rows(spark, [1, 2, 3]), period=2)) == [1.5, 2.5]
    told = from_rows(spark, [(1, 3, 1, 2, 10), {"ts": T0, "open": 1, "high": 2, "low": 1, "close": 2, "volume": 5, "symbol": "x"}])
    assert told.columns == ["symbol", "ts", "seq", "open", "high", "low", "close", "volume"] and told.count() == 2
    with pytest.raises(InsufficientData):
        from_rows(spark, [])
    for bad in (["x"], [{"open": 1}], [(1, 2)]):
        with pytest.raises(InvalidDataFormat):
            from_rows(spark, bad)
    assert all_decimals(told, "open", "close") and not all_decimals(told, "volume") and all_numbers(told, "open", "volume") and not all_numbers(told)
    validate_volumes(told)
    validate_volumes(told.limit(0))
    with pytest.raises(InvalidDataFormat):
        validate_volumes(told.drop("volume"))
    for bad in (F.lit(-1), F.lit(None).cast("long"), F.lit(1.5), F.lit("many")):
        with pytest.raises(ValidationError):
            validate_volumes(told.withColumn("volume", bad))


def test_quality(spark):
    good = [("100", "105", "98", "103", 1000), ("103", "107", "101", "105", 1200), ("105", "108", "103", "107", 1100)]
    clean = quality.report(bars(spark, good)).first()
    assert (clean.total_points, clean.valid_points, clean.n_issues, clean.quality_score) == (3, 3, 0, 100.0)
    twice = quality.issues(bars(spark, good, times=[T0, T0, T0 + timedelta(minutes=1)])).collect()
    assert [(r.seq, r.type, r.severity) for r in twice] == [(1, "duplicate", "medium")]
    back = quality.issues(bars(spark, good, times=[T0 + timedelta(minutes=1), T0, T0 + timedelta(minutes=2)])).collect()
    assert [(r.seq, r.type) for r in back] == [(1, "chronological_error")]
    lost = quality.issues(bars(spark, good, times=[T0, None, T0 + timedelta(minutes=2)])).collect()
    assert {(r.type, r.severity) for r in lost} == {("invalid_data", "high"), ("missing_data", "critical")}
    wrong = quality.issues(bars(spark, [("100", "90", "95", "92", -5)])).collect()
    assert {r.description for r in wrong} == {"Invalid OHLCV data point", "High price is less than low price", "Negative volume"}
    assert quality.report(bars(spark, good).limit(0)).count() == 0
    assert quality.quality_report(bars(spark, good)).first().coverage_percentage == 100.0
    assert quality.outliers(bars(spark, [1, 2, 3, 2, 1, 2, 3, 500])).first().seq == 7
    assert quality.outliers(bars(spark, [1, 2, 500]), "isolation_forest").count() == 0
    with pytest.raises(InvalidParams):
        quality.outliers(bars(spark, [1]), "guess")


def test_filling_and_scaling(spark):
    df = bars(spark, [1, 2, 3, 4]).withColumn("close", F.when(~F.col("seq").isin(0, 2), F.col("close")))
    assert values(quality.fill_gaps(df), "close") == [2, 2, 4]
    assert values(quality.fill_gaps(df, "backward_fill"), "close") == [2, 2, 4, 4]
    assert values(quality.fill_gaps(df, "remove"), "close") == [2, 4]
    assert values(quality.normalize(bars(spark, [1, 2, 3])), "close") == [0, 0.5, 1]
    assert values(quality.normalize(bars(spark, [1, 2, 3]), "robust"), "close") == [-1, 0, 1]
    assert values(quality.normalize(bars(spark, [4, 4]), "zscore"), "close") == [4, 4]


def test_canonical_columns(spark):
    df = spark.createDataFrame([(0, 1.5), (1, 2.5)], "n long, price double")
    got = canonicalize(df, {"seq": "n", "close": "price"})
    assert got.columns == ["symbol", "ts", "seq", "close"] and values(calculate("sma", got, period=2)) == [2.0]
    with pytest.raises(InvalidDataFormat):
        canonicalize(df)


def test_limits(spark):
    assert security.sanitize_string("  <b>javascript:x${y}</b> ") == "bx/b"
    got = spark.createDataFrame([("  <b>javascript:x${y}</b> ",)], "t string").select(security.sanitize_column(F.col("t")).alias("s"), security.dangerous_column(F.col("t")).alias("d")).first()
    assert (got.s, got.d) == ("bx/b", True)
    for bad in ("../x", 1e21, {"__proto__": 1}, ["eval(1)"], float("nan"), float("-inf"), Decimal("NaN"), Decimal("Infinity"), Decimal("1e30"), {"a": [float("nan")]}, ["x" * 900] * 70_000):
        with pytest.raises(ValidationError):
            security.validate_input(bad)
    for bad in ({"period": 1001}, {"multiplier": 11}, {"constructor": 1}):
        with pytest.raises(ValidationError):
            security.validate_parameters(bad)
    flagged = security.flag_bars(bars(spark, [("1", "2", "1", "2", 5), ("1", "1", "1", "2", 5), ("0", "1", "0", "1", 5)]), T0).orderBy("seq").collect()
    assert [r.unsafe for r in flagged] == [None, "range", "price"]
    security.validate_input({"a": [1, 2.5, Decimal("3")], "b": True, "c": "plain"})
    security.check_bars(bars(spark, [("1", "2", "1", "2", 5)] * 3), T0, 3)
    for bad, most in (([("1", "2", "1", "2", 5)] * 4, 3), ([("1", "1", "1", "2", 5)], 3)):
        with pytest.raises(ValidationError):
            security.check_bars(bars(spark, bad), T0, most)
    clock = iter([0, 1, 2, 70]).__next__
    limit = security.RateLimit(2, 60, clock)
    assert [limit.allow("a") for _ in range(4)] == [True, True, False, True]


def test_advice(spark):
    result = performance.benchmark_indicator("sma", bars(spark, [1, 2, 3]), 1, period=2)
    assert result.rows == 3 and result.average_us > 0 and result.memory_bytes > 0
    told = performance.benchmark_pipeline(Pipeline().add_stage("a", "sma", period=2), [bars(spark, [1, 2, 3]), bars(spark, [1, 2])], 1, memory=True)
    assert told.dataset_sizes == (3, 2) and told.stages == 1 and len(told.runs) == 2 and told.rows_a_second > 0 and told.memory_bytes >= 0
    profile = performance.memory_profile(spark, lambda: 7)
    assert profile.result == 7 and profile.peak >= profile.initial > 0 and profile.collections >= 1 and profile.delta == profile.final - profile.initial
    with pytest.raises(InvalidParams):
        performance.memory_profile(spark, 7)
    kept = performance.enable_caching(bars(spark, [1, 2]))
    assert performance.cache_stats(kept)["cached"]
    performance.clear_caches(spark)
    assert not performance.cache_stats(performance.disable_caching(kept))["cached"]
    slow = performance.Benchmark("x", 10, 1, 2e5, 1, 1, 10**6)
    assert [a["type"] for a in performance.advise([slow, slow])] == ["memory", "cpu", "caching"]
