"""Streaming: one bar at a time in, one result out, with bounded state.

Stream gives the incremental form of an indicator as plain Python, with a state that can be saved; stream_indicators
runs any number of them over a stream of bars, keyed by symbol, in Structured Streaming's state store.

Where batch and streaming differ: RSI is Wilder's recurrence; ATR by ema or rma starts from the true range of the n-th
bar. Volatility index and smoothed Stochastic follow the batch definition.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import InvalidParams, StreamStateError
from ..operators import REGISTRY, available, find
from ..plans.pipeline import Pipeline
from .ordered import in_order


def _mean(x: list[float]) -> float:
    return math.fsum(x) / len(x)


def _std(x: list[float], population: bool = False) -> float:
    m = _mean(x)
    return math.sqrt(math.fsum((v - m) ** 2 for v in x) / (len(x) - (not population)))


def _weighted(x: list[float]) -> float:
    return math.fsum(v * (i + 1) for i, v in enumerate(x)) / (len(x) * (len(x) + 1) / 2)


def _zone(v: float, over: float, under: float) -> str:
    return "overbought" if v > over else "oversold" if v < under else "neutral"


def _sign(v: float) -> str:
    return "bullish" if v > 0 else "bearish" if v < 0 else "neutral"


def _div(a: float, b: float, guard: float) -> float:
    return guard if b == 0 else a / b


def _session(ts: datetime, unit: str) -> str:
    if unit == "daily":
        return ts.date().isoformat()
    if unit == "weekly":
        return (ts - timedelta(days=ts.weekday())).date().isoformat()
    return f"{ts.year}-{ts.month}" if unit == "monthly" else ""


class Stream:
    """The incremental form of one indicator. update(bar) gives its fields, or None while it warms up."""

    def __init__(self, indicator: str, **params):
        self.indicator, self.given = indicator, params
        self.p = find(indicator).options(params)
        self.s: dict[str, Any] = {}

    def snapshot(self) -> str:
        return json.dumps({"indicator": self.indicator, "params": self.given, "state": self.s})

    @classmethod
    def restore(cls, text: str) -> Stream:
        try:
            told = json.loads(text)
            out = cls(told["indicator"], **told["params"])
            out.s = told["state"]
        except (ValueError, KeyError, TypeError) as e:
            raise StreamStateError(f"Not a stream state: {e}", operation="restore", reason=str(e)) from None
        return out

    def update(self, bar: dict[str, Any]) -> dict[str, Any] | None:
        return getattr(self, "_" + self.indicator)(bar)

    def process(self, bars: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """The results of several bars; if one of them fails, the state is as it was before all of them."""
        before = json.dumps(self.s)
        try:
            return [r for r in map(self.update, bars) if r]
        except Exception as e:
            self.s = json.loads(before)
            raise StreamStateError(f"Batch refused: {e}", operation="process", reason=str(e)) from e

    def _ring(self, name: str, value: Any, n: int) -> list | None:
        """The last n values with this one, once there are n."""
        ring = self.s.setdefault(name, [])
        ring.append(value)
        del ring[:-n]
        return ring if len(ring) == n else None

    def _source(self, bar: dict) -> float:
        return float(bar[self.p.get("source", "close")])

    def _smooth(self, name: str, x: float, n: int, a: float, start: int) -> float | None:
        """The recurrence with a seed of the first `start` values (0: the first value)."""
        y = self.s.get(name)
        if y is None:
            count, total = self.s.get(name + "#", (0, 0.0))
            count, total = count + 1, total + x
            self.s[name + "#"] = (count, total)
            y = None if count < start else total / count
        else:
            y = x * a + y * (1 - a)
        self.s[name] = y
        return y

    def _sma(self, bar):
        ring = self._ring("x", self._source(bar), self.p["period"])
        return ring and {"value": _mean(ring)}

    def _ema(self, bar):
        n = self.p["period"]
        a = self.p["smoothing"] if self.p["smoothing"] is not None else 2 / (n + 1)
        y = self._smooth("y", self._source(bar), n, a, n if self.p["initialization"] == "sma_bootstrap" else 0)
        return None if y is None else {"value": y}

    def _wma(self, bar):
        ring = self._ring("x", self._source(bar), self.p["period"])
        return ring and {"value": _weighted(ring)}

    def _hma(self, bar):
        n = self.p["period"]
        ring = self._ring("x", self._source(bar), n)
        if not ring:
            return None
        raw = self._ring("raw", 2 * _weighted(ring[-(n // 2) :]) - _weighted(ring), math.floor(math.sqrt(n) + 0.5))
        return raw and {"value": _weighted(raw)}

    def _kama(self, bar):
        n = self.p["period"]
        ring = self._ring("x", self._source(bar), n + 1)
        if not ring:
            return None
        moves = math.fsum(abs(b - a) for a, b in zip(ring, ring[1:], strict=False))
        er = min(1.0, _div(abs(ring[-1] - ring[0]), moves, 1.0))
        fast, slow = 2 / (self.p["fast_period"] + 1), 2 / (self.p["slow_period"] + 1)
        return {"value": self._smooth("y", ring[-1], n, (er * (fast - slow) + slow) ** 2, 0), "efficiency_ratio": round(er, 4)}

    def _macd(self, bar):
        fast, slow, signal = (self.p[f"{k}_period"] for k in ("fast", "slow", "signal"))
        x = self._source(bar)
        f, s = self._smooth("f", x, fast, 2 / (fast + 1), fast), self._smooth("s", x, slow, 2 / (slow + 1), slow)
        if s is None:
            return None
        g = self._smooth("g", f - s, signal, 2 / (signal + 1), signal)
        return {"macd": f - s, "signal": g, "histogram": None if g is None else f - s - g}

    def _rsi(self, bar):
        n, x, before = self.p["period"], self._source(bar), self.s.get("before")
        self.s["before"] = x
        if before is None:
            return None
        if self.p["smoothing"] == "sma":
            rings = [self._ring(k, v, n) for k, v in (("g", max(x - before, 0)), ("l", max(before - x, 0)))]
            means = [r and _mean(r) for r in rings]
        else:
            means = [self._smooth(k, v, n, 1 / n, n) for k, v in (("g", max(x - before, 0)), ("l", max(before - x, 0)))]
        if means[0] is None:
            return None
        value = 100.0 if means[1] == 0 else 100 - 100 / (1 + means[0] / means[1])
        return {"value": value, "signal": _zone(value, self.p["overbought"], self.p["oversold"])}

    def _range(self, bar, n: int) -> tuple[float, float] | None:
        high, low = self._ring("h", float(bar["high"]), n), self._ring("lo", float(bar["low"]), n)
        return (max(high), min(low)) if high else None

    def _stochastic(self, bar):
        found = self._range(bar, self.p["k_period"])
        if not found:
            return None
        raw = _div(100 * (float(bar["close"]) - found[1]), found[0] - found[1], 50.0)
        smooth = self._ring("raw", raw, self.p["k_smoothing"])
        ring = smooth and self._ring("k", _mean(smooth), self.p["d_period"])
        if not ring:
            return None
        k, d, over, under = ring[-1], _mean(ring), self.p["overbought"], self.p["oversold"]
        return {"k": k, "d": d, "k_signal": _zone(k, over, under), "d_signal": _zone(d, over, under), "crossover": _sign(k - d)}

    def _williams_r(self, bar):
        found = self._range(bar, self.p["period"])
        if not found:
            return None
        value = _div(-100 * (found[0] - float(bar["close"])), found[0] - found[1], -50.0)
        return {"value": value, "signal": _zone(value, self.p["overbought"], self.p["oversold"])}

    def _cci(self, bar):
        tp = (float(bar["high"]) + float(bar["low"]) + float(bar["close"])) / 3
        ring = self._ring("tp", tp, self.p["period"])
        if not ring:
            return None
        m = _mean(ring)
        off = math.fsum(abs(v - m) for v in ring) / len(ring)
        value = 0.0 if off <= abs(m) * 1e-14 else _div(tp - m, off * self.p["constant"], 0.0)
        return {"value": value, "signal": _zone(value, 100, -100)}

    def _roc(self, bar):
        ring = self._ring("x", self._source(bar), self.p["period"] + 1)
        if not ring:
            return None
        value = ring[-1] - ring[0] if self.p["variant"] == "price" else _div(100 * (ring[-1] - ring[0]), ring[0], 0.0)
        return {"value": value, "signal": _sign(value)}

    def _momentum(self, bar):
        ring = self._ring("x", self._source(bar), self.p["period"] + 1)
        if not ring:
            return None
        raw = ring[-1] - ring[0]
        smooth = self._ring("raw", _div(raw, ring[0], 0.0) if self.p["normalized"] else raw, self.p["smoothing"])
        return smooth and {"value": _mean(smooth), "signal": _sign(_mean(smooth))}

    def _standard_deviation(self, bar):
        ring = self._ring("x", self._source(bar), self.p["period"])
        return ring and {"value": _std(ring, self.p["calculation"] == "population")}

    def _atr(self, bar):
        n, before = self.p["period"], self.s.get("before")
        high, low = float(bar["high"]), float(bar["low"])
        tr = high - low if before is None else max(high - low, abs(high - before), abs(low - before))
        self.s["before"] = float(bar["close"])
        ring = self._ring("tr", tr, n)
        if not ring:
            return None
        a = 1 / n if self.p["smoothing"] == "rma" else 2 / (n + 1)
        return {"value": _mean(ring) if self.p["smoothing"] == "sma" else self._smooth("y", tr, n, a, 0), "true_range": tr}

    def _bollinger_bands(self, bar):
        x = self._source(bar)
        ring = self._ring("x", x, self.p["period"])
        if not ring:
            return None
        mid, width = _mean(ring), _std(ring) * self.p["multiplier"]
        up, low = mid + width, mid - width
        return {"upper_band": up, "middle_band": mid, "lower_band": low, "percent_b": _div(100 * (x - low), up - low, 50.0), "bandwidth": _div(100 * (up - low), mid, 0.0)}

    def _volatility_index(self, bar):
        n, method = self.p["period"], self.p["method"]

        def log(a, b):
            return math.log(a / b) if a > 0 and b > 0 else None

        if method == "historical":
            x, before = self._source(bar), self.s.get("before")
            self.s["before"] = x
            if before is None:
                return None
            each = log(x, before)
        else:
            spread = log(float(bar["high"]), float(bar["low"]))
            each = None if spread is None else spread**2
            if method == "parkinson":
                each = None if each is None else each / (4 * math.log(2))
            else:
                body = log(float(bar["close"]), float(bar["open"]))
                each = None if each is None or body is None else each * (0.5 if self.p["textbook"] else 1) - (2 * math.log(2) - 1) * body**2
        ring = self._ring("e", each, n)
        if not ring:
            return None
        if any(v is None for v in ring):
            return {"value": None}
        year = self.p["periods_per_year"]
        return {"value": _std(ring) * math.sqrt(year) * 100 if method == "historical" else math.sqrt(max(_mean(ring), 0) * year) * 100}

    def _obv(self, bar):
        close, volume, before = float(bar["close"]), int(bar["volume"]), self.s.get("before")
        move = None if before is None else close - before
        self.s["before"] = close
        self.s["y"] = self.s.get("y", 0) + (volume if move is None or move > 0 else -volume if move < 0 else 0)
        return {"value": float(self.s["y"]), "volume_direction": "initial" if move is None else "positive" if move > 0 else "negative" if move < 0 else "neutral"}

    def _vwap(self, bar):
        unit, volume = self.p["session_reset"], int(bar["volume"])
        price = {"close": lambda: float(bar["close"]), "typical": lambda: (float(bar["high"]) + float(bar["low"]) + float(bar["close"])) / 3, "weighted": lambda: (float(bar["high"]) + float(bar["low"]) + 2 * float(bar["close"])) / 4}[self.p["variant"]]()
        session = _session(bar["ts"], unit) if unit != "none" else ""
        reset = "session" in self.s and self.s["session"] != session
        if reset or "session" not in self.s:
            self.s.update(session=session, pv=0.0, v=0)
        self.s["pv"] += price * volume
        self.s["v"] += volume
        if volume <= 0:
            return None
        return {"value": _div(self.s["pv"], self.s["v"], 0.0), "price_used": price, "cumulative_volume": float(self.s["v"]), "session_reset_occurred": reset}

    def _flow(self, bar) -> float:
        high, low, close = (float(bar[k]) for k in ("high", "low", "close"))
        return _div((close - low) - (high - close), high - low, 0.0) * int(bar["volume"])

    def _accumulation_distribution(self, bar):
        self.s["y"] = self.s.get("y", 0.0) + self._flow(bar)
        return {"value": self.s["y"]}

    def _chaikin_money_flow(self, bar):
        flows, volumes = self._ring("f", self._flow(bar), self.p["period"]), self._ring("v", int(bar["volume"]), self.p["period"])
        return flows and {"value": _div(math.fsum(flows), sum(volumes), 0.0), "sum_money_flow": math.fsum(flows), "sum_volume": float(sum(volumes))}


class PipelineStream:
    """The incremental form of a Pipeline: each bar goes through all stages in their order.

    A stage that reads another gets that one's first field as its close, from the first bar that has one. If a stage
    fails, fail_fast puts every state back and raises; continue_on_error puts that stage's state back and goes on.
    """

    def __init__(self, pipeline: Pipeline):
        self.pipeline, self.stages = pipeline, pipeline.order()
        self.streams = {s.label: Stream(s.indicator, **s.params) for s in self.stages}
        self.metrics = {"executions": 0, "seconds": 0.0, "last_seconds": 0.0, "error_count": 0}

    def update(self, bar: dict[str, Any]) -> dict[str, dict[str, Any]]:
        """The results of the stages that have one, by label."""
        began, out = time.perf_counter(), {}
        before = {k: json.dumps(s.s) for k, s in self.streams.items()}
        for s in self.stages:
            given = bar
            if s.reads is not None:
                value = out.get(s.reads, {}).get(find(next(x.indicator for x in self.stages if x.label == s.reads)).fields[0])
                if value is None:
                    continue
                given = {**bar, "close": value}
            try:
                found = self.streams[s.label].update(given)
            except Exception as e:
                self.metrics["error_count"] += 1
                if self.pipeline.config["error_handling"] == "fail_fast":
                    for k, stream in self.streams.items():
                        stream.s = json.loads(before[k])
                    raise StreamStateError(f"Stage {s.label} failed: {e}", operation=s.label, reason=str(e)) from e
                self.streams[s.label].s = json.loads(before[s.label])
                continue
            if found:
                out[s.label] = found
        took = time.perf_counter() - began
        self.metrics = {**self.metrics, "executions": self.metrics["executions"] + 1, "seconds": self.metrics["seconds"] + took, "last_seconds": took}
        return out

    def snapshot(self) -> str:
        return json.dumps({k: s.snapshot() for k, s in self.streams.items()})

    def load(self, text: str) -> PipelineStream:
        """Go on from a snapshot of a pipeline with the same stages."""
        try:
            told = json.loads(text)
            if told.keys() != self.streams.keys():
                raise KeyError(f"stages {sorted(told)}")
            self.streams = {k: Stream.restore(v) for k, v in told.items()}
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise StreamStateError(f"Not a state of this pipeline: {e}", operation="restore", reason=str(e)) from None
        return self


def compose_streams(primary: tuple[str, dict], dependents: list[tuple[str, dict]] = (), reads: bool = True) -> PipelineStream:
    """A primary stream and streams that follow it, as (indicator, params): with reads=True they read its results, else the same bars."""
    pipeline = Pipeline().add_stage("primary", primary[0], **primary[1])
    for i, (name, params) in enumerate(dependents):
        label = f"dependent_{i}"
        pipeline = pipeline.add_stage(label, name, reads="primary" if reads else None, **params).add_dependency(label, "primary")
    return PipelineStream(pipeline)


def init_stream(category: str, indicator: str, **params) -> Stream:
    """The stream of an indicator of a category; InvalidParams if the category has no such one."""
    if indicator not in available(category):
        raise InvalidParams(f"Unknown {category} indicator {indicator!r}", param="indicator", value=indicator, expected=f"one of {available(category)}")
    return Stream(indicator, **params)


def update_stream(stream: Stream, bar: dict[str, Any]) -> tuple[Stream, dict[str, Any] | None]:
    """The stream after one more bar, and its result; the one that is given stays as it is."""
    after = Stream.restore(stream.snapshot())
    return after, after.update(bar)


OUTPUT = "symbol string, ts timestamp_ntz, stage string, field string, number double, word string"


class _Processor(StatefulProcessor):
    """Keeps the snapshots of all stages of one symbol, and its last time."""

    def __init__(self, pipeline: Pipeline):
        self.pipeline = pipeline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streams", T.StructType([T.StructField("snapshot", T.StringType()), T.StructField("last", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streams, last = PipelineStream(self.pipeline), ""
        if self.state.exists():
            snapshot, last = self.state.get()
            streams.load(snapshot)
        # Bars of a micro-batch may come in any order; those not after what was already seen are late and are left out.
        for some in in_order(rows):
            out = []
            for bar in some.to_dict("records"):
                at = f"{pd.Timestamp(bar['ts']).isoformat()} {int(bar['seq']):020d}"
                if at <= last:
                    continue
                last = at
                for label, found in streams.update(bar).items():
                    for name, value in found.items():
                        word = isinstance(value, str)
                        out.append((key[0], bar["ts"], label, name, None if word or value is None else float(value), value if word else None))
            yield pd.DataFrame(out, columns=["symbol", "ts", "stage", "field", "number", "word"])
        self.state.update((streams.snapshot(), last))

    def close(self) -> None:
        pass


def stream_indicators(bars: DataFrame, stages: list[tuple[str, str, dict]]) -> DataFrame:
    """Results of (label, indicator, params) stages over a stream of canonical bars, in long form.

    Needs the RocksDB state store. Within a micro-batch bars are put in order, on the executor's disk if they are many; a bar that is not after its symbol's last one is ignored.
    """
    pipeline = Pipeline()
    for label, name, params in stages:
        pipeline = pipeline.add_stage(label, name, **params)
    return stream_pipeline(bars, pipeline)


def stream_pipeline(bars: DataFrame, pipeline: Pipeline) -> DataFrame:
    """stream_indicators for a Pipeline, with its dependencies, stages that read others, and error handling."""
    return bars.groupBy("symbol").transformWithStateInPandas(_Processor(pipeline.build()), outputStructType=T._parse_datatype_string(OUTPUT), outputMode="append", timeMode="none")


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
STREAMABLE = tuple(REGISTRY)


def stream_metrics(query) -> dict[str, float]:
    """Totals of a running or finished streaming query: batches, rows, seconds, rows a second."""
    told = query.recentProgress
    rows = sum(p["numInputRows"] for p in told)
    seconds = sum(p["durationMs"].get("triggerExecution", 0) for p in told) / 1000
    return {"batches": len(told), "rows": rows, "seconds": seconds, "rows_a_second": rows / seconds if seconds else 0.0}
