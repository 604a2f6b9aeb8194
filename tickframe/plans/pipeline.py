"""A pipeline of indicators over the same bars, compiled into one plan: one exchange, one sort, one pass of recurrences."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CalculationError, InvalidDataFormat, InvalidParams, TickframeError, ValidationError
from ..operators.base import calculate, check_length, find, plan

MODES = {"execution_mode": ("fused", "separate"), "error_handling": ("fail_fast", "continue_on_error")}


@dataclass(frozen=True)
class Stage:
    """One indicator with its parameters. reads: a stage whose result replaces the close that this one reads."""

    label: str
    indicator: str
    params: dict[str, Any] = field(default_factory=dict)
    reads: str | None = None


@dataclass(frozen=True)
class Pipeline:
    """An immutable builder; every method returns a new one."""

    stages: tuple[Stage, ...] = ()
    dependencies: tuple[tuple[str, str], ...] = ()
    config: dict[str, Any] = field(default_factory=lambda: {"execution_mode": "fused", "error_handling": "fail_fast"})

    def add_stage(self, label: str, indicator: str, reads: str | None = None, **params) -> Pipeline:
        if any(s.label == label for s in self.stages):
            raise ValidationError(f"Stage {label} exists", field="label", value=label, constraint="unique")
        find(indicator).options(params)
        return replace(self, stages=(*self.stages, Stage(label, indicator, params, reads)))

    def add_dependency(self, label: str, on: str) -> Pipeline:
        """label comes after on."""
        return replace(self, dependencies=tuple(dict.fromkeys((*self.dependencies, (label, on)))))

    def configure(self, **config) -> Pipeline:
        """Set execution_mode (fused: one plan for all stages that read bars; separate: a plan each) or error_handling (fail_fast, continue_on_error)."""
        for key, value in config.items():
            if key not in MODES or value not in MODES[key]:
                raise InvalidParams(f"Unknown setting {key}={value!r}", param=key, value=value, expected=f"one of {MODES.get(key, tuple(MODES))}")
        return replace(self, config={**self.config, **config})

    def order(self) -> list[Stage]:
        """The stages so that each comes after what it needs, else as added; raises if there are none, on unknown labels and on cycles."""
        if not self.stages:
            raise ValidationError("A pipeline needs a stage", field="stages", value=0, constraint="at least 1")
        by = {s.label: s for s in self.stages}
        needs = {s.label: ({s.reads} if s.reads else set()) for s in self.stages}
        for label, on in self.dependencies:
            needs.setdefault(label, set()).add(on)
        if unknown := sorted({x for k, v in needs.items() for x in (k, *v)} - by.keys()):
            raise InvalidParams(f"Unknown stage {unknown[0]}", param="dependency", value=unknown[0], expected=f"one of {sorted(by)}")
        done: list[Stage] = []
        left = dict(needs)
        while left:
            free = [k for k in by if k in left and not left[k] & left.keys()]
            if not free:
                raise ValidationError("Stages depend on each other in a circle", field="dependencies", value=sorted(left), constraint="no cycle")
            done.append(by[free[0]])
            del left[free[0]]
        return done

    def build(self) -> Pipeline:
        self.order()
        return self

    def execute(self, bars: DataFrame, strict: bool = False) -> Execution:
        """Plan all stages over bars, one after the other, and say which cannot run.

        A stage fails if bars lack its columns, if it reads a stage that failed, or with strict=True if a symbol has
        fewer rows than it needs. fail_fast raises the first failure; continue_on_error leaves out the stages that fail.
        """
        began, errors = time.perf_counter(), {}
        for s in self.order():
            try:
                if s.reads in errors:
                    raise CalculationError(f"Stage {s.reads} failed", operation=s.label, reason=errors[s.reads])
                names = bars.columns if s.reads is None else ("close",)
                p = find(s.indicator).options(s.params)
                if missing := [c for c in find(s.indicator).needs(p) if c not in names]:
                    raise InvalidDataFormat(f"{s.indicator} needs columns {missing}", expected=find(s.indicator).needs(p), received=tuple(names))
                if strict and s.reads is None:
                    check_length(bars, find(s.indicator).required_periods(**s.params))
            except TickframeError as e:
                if self.config["error_handling"] == "fail_fast":
                    raise
                errors[s.label] = str(e)
        kept = replace(self, stages=tuple(s for s in self.stages if s.label not in errors), dependencies=tuple(d for d in self.dependencies if not set(d) & errors.keys()))
        wide = kept.run_wide(bars) if kept.stages else bars.select("symbol", "ts", "seq")
        return Execution(wide, kept.stages, errors, time.perf_counter() - began)

    def run_wide(self, bars: DataFrame) -> DataFrame:
        """bars' symbol, ts, seq with a column label_field for every output; null where a stage has no result.

        Stages over the bars share one plan. A stage that reads another's first output gets it as its close, in a plan of its own, joined by row.
        """
        direct = [s for s in self.order() if s.reads is None]
        if self.config["execution_mode"] == "fused":
            out = _planned(bars, direct)
        else:
            out = bars.select("symbol", "ts", "seq")
            for s in direct:
                out = out.join(_planned(bars, [s]), ["symbol", "ts", "seq"], "left")
        for s in self.order():
            if s.reads is not None:
                first = find(next(x for x in self.stages if x.label == s.reads).indicator).fields[0]
                inner = out.filter(F.col(f"{s.reads}_{first}").isNotNull()).select("symbol", "ts", "seq", F.col(f"{s.reads}_{first}").cast("decimal(18,4)").alias("close"))
                more = calculate(s.indicator, inner, **s.params)
                out = out.join(more.select("symbol", "ts", "seq", *[F.col(f).alias(f"{s.label}_{f}") for f in find(s.indicator).fields]), ["symbol", "ts", "seq"], "left")
        return out

    def run_long(self, bars: DataFrame) -> DataFrame:
        """symbol, ts, seq, stage, field, value (double; fields that are not numbers are left out): the union of all stages' results."""
        wide = self.run_wide(bars)
        number = {f.name for f in wide.schema.fields if f.dataType.typeName() in ("double", "long", "decimal")}
        pairs = [(s.label, f) for s in self.stages for f in find(s.indicator).fields if f"{s.label}_{f}" in number]
        items = F.array(*[F.struct(F.lit(a).alias("stage"), F.lit(b).alias("field"), F.col(f"{a}_{b}").cast("double").alias("value")) for a, b in pairs])
        return wide.select("symbol", "ts", "seq", F.explode(items).alias("i")).select("symbol", "ts", "seq", "i.*").filter("value is not null")


def _planned(bars: DataFrame, stages: list[Stage]) -> DataFrame:
    df, found = plan(bars, [(s.label, s.indicator, s.params) for s in stages])
    cols = [F.col(f"`{c}`").alias(c.replace(".", "_", 1)) for _, names in found.values() for c in names]
    return df.select("symbol", "ts", "seq", *cols)


@dataclass(frozen=True)
class Execution:
    """A planned run: the wide result, the stages in it, why others are left out, and the seconds planning took."""

    wide: DataFrame
    stages: tuple[Stage, ...]
    errors: dict[str, str]
    planning_seconds: float

    def result(self, label: str) -> DataFrame:
        """symbol, ts, seq and the fields of one stage, for the rows that have a result."""
        stage = next((s for s in self.stages if s.label == label), None)
        if stage is None:
            raise InvalidParams(f"No result of stage {label}", param="label", value=label, expected=f"one of {[s.label for s in self.stages]}")
        fields = find(stage.indicator).fields
        some = reduce(lambda a, b: a | b, [F.col(f"{label}_{f}").isNotNull() for f in fields])
        return self.wide.filter(some).select("symbol", "ts", "seq", *[F.col(f"{label}_{f}").alias(f) for f in fields])

    def metrics(self) -> dict[str, Any]:
        """Run everything once: rows read, rows with a result of each stage, seconds, failed stages."""
        began = time.perf_counter()
        first = {s.label: f"{s.label}_{find(s.indicator).fields[0]}" for s in self.stages}
        row = self.wide.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(first.values())]).first()
        seconds = time.perf_counter() - began
        return {"rows": row["rows"], "stage_rows": {k: row[f"n{i}"] for i, k in enumerate(first)}, "planning_seconds": self.planning_seconds, "processing_seconds": seconds, "error_count": len(self.errors)}


def aggregate_metrics(runs: list[dict[str, Any]]) -> dict[str, Any]:
    """Totals of several runs' metrics."""
    return {"executions": len(runs), "rows": sum(r["rows"] for r in runs), "processing_seconds": sum(r["processing_seconds"] for r in runs), "error_count": sum(r["error_count"] for r in runs)}


def merge(results: list[DataFrame]) -> DataFrame:
    """The union of results of one shape, in time order."""
    return reduce(lambda a, b: a.unionByName(b), results).orderBy("ts", "symbol", "seq")


def latest(result: DataFrame) -> DataFrame:
    """The last row of each symbol."""
    names = [c for c in result.columns if c != "symbol"]
    return result.groupBy("symbol").agg(F.max_by(F.struct(*names), F.struct("ts", "seq")).alias("r")).select("symbol", "r.*")


