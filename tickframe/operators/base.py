"""What an indicator is, and how one or many are turned into a plan over bars.

An indicator adds columns to a frame of bars in up to three steps: window columns, recurrences, and row-level columns
over both. A plan deals the bars by symbol once, adds the window columns of all its indicators (which share that
exchange and its sort), runs all recurrences in one pass, and adds the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidDataFormat, InvalidParams, ValidationError, insufficient_data
from ..functions.exprs import number
from ..params import FieldMeta, OutputMeta, ParamMeta, validate_params
from .kernels import Smooth, run_kernels

ROW = "__row"


@dataclass
class Steps:
    """One indicator in a plan. pre: window columns, in levels, where a level may read the ones before; outputs: name -> column."""

    ready: Column
    outputs: dict[str, Column]
    pre: list[dict[str, Column]] = field(default_factory=list)
    kernels: list[Smooth] = field(default_factory=list)


@dataclass(frozen=True)
class Indicator:
    """build(p, name) gives the steps; name returns a temporary column name of this indicator's own."""

    name: str
    category: str
    needs: Callable[[dict], tuple[str, ...]]
    periods: Callable[[dict], int]
    build: Callable[[dict, Callable[[str], str]], Steps]
    params: tuple[ParamMeta, ...]
    output: OutputMeta
    strict_params: bool = False
    check: Callable[[dict], None] | None = None

    def options(self, params: dict[str, Any]) -> dict[str, Any]:
        """params with defaults, checked; raises InvalidParams."""
        out = validate_params(params, self.params, self.strict_params)
        if self.check:
            self.check(out)
        return out

    def required_periods(self, **params) -> int:
        """Rows a series needs for its first result."""
        return self.periods(self.options(params))

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.output.fields)


REGISTRY: dict[str, Indicator] = {}
CATEGORIES = ("trend", "momentum", "volatility", "volume")


def register(indicator: Indicator) -> Indicator:
    REGISTRY[indicator.name] = indicator
    return indicator


def find(name: str) -> Indicator:
    if name not in REGISTRY:
        raise InvalidParams(f"Unknown indicator {name!r}", param="indicator", value=name, expected=f"one of {sorted(REGISTRY)}")
    return REGISTRY[name]


def prepare(bars: DataFrame) -> DataFrame:
    """Bars dealt by symbol, each row with its place in the series."""
    return bars.repartition("symbol").withColumn(ROW, number())


def plan(bars: DataFrame, wanted: list[tuple[str, str, dict[str, Any]]]) -> tuple[DataFrame, dict[str, tuple[Column, list[str]]]]:
    """bars with the outputs of all wanted (label, indicator, params) as columns label.field, and per label its ready condition and columns."""
    built: list[tuple[str, Steps]] = []
    for label, name, params in wanted:
        indicator = find(name)
        p = indicator.options(params)
        if missing := [c for c in indicator.needs(p) if c not in bars.columns]:
            raise InvalidDataFormat(f"{name} needs columns {missing}", expected=indicator.needs(p), received=tuple(bars.columns))
        built.append((label, indicator.build(p, lambda part, label=label: f"__{label}_{part}")))
    df = prepare(bars)
    for level in range(max([0, *(len(s.pre) for _, s in built)])):
        df = df.withColumns({k: c for _, s in built if level < len(s.pre) for k, c in s.pre[level].items()})
    df = run_kernels(df, [k for _, s in built for k in s.kernels])
    df = df.withColumns({f"{label}.{f}": F.when(s.ready, c) for label, s in built for f, c in s.outputs.items()})
    return df, {label: (s.ready, [f"{label}.{f}" for f in s.outputs]) for label, s in built}


def calculate(name: str, bars: DataFrame, strict: bool = False, **params) -> DataFrame:
    """symbol, ts, seq and the indicator's fields, for the rows that have a result.

    A series shorter than required_periods gives no rows; with strict=True it raises InsufficientData instead, and
    ValidationError where a volume indicator meets negative prices or volumes, or a low above its high.
    """
    if strict:
        check_length(bars, find(name).required_periods(**params))
        if find(name).category == "volume":
            check_values(bars)
    df, found = plan(bars, [("x", name, params)])
    ready, columns = found["x"]
    return df.filter(ready).select("symbol", "ts", "seq", *[F.col(f"`{c}`").alias(c.split(".", 1)[1]) for c in columns])


def check_length(bars: DataFrame, required: int) -> None:
    """Raise InsufficientData if there are no bars or some symbol has fewer than required."""
    least = bars.groupBy("symbol").count().agg(F.min("count")).first()[0]
    if least is None or least < required:
        raise insufficient_data(required, least or 0)


def check_values(bars: DataFrame) -> None:
    """Raise ValidationError for the first kind of impossible value among the columns that bars has."""
    wrong = {c: F.count_if(F.col(c) < 0) for c in ("open", "high", "low", "close", "volume") if c in bars.columns}
    if {"high", "low"} <= set(bars.columns):
        wrong["low above high"] = F.count_if(F.col("low") > F.col("high"))
    found = bars.agg(*[c.alias(k) for k, c in wrong.items()]).first().asDict()
    for field_, n in found.items():
        if n:
            raise ValidationError(f"{n} rows: {field_}" + (" is negative" if field_ in bars.columns else ""), field=field_, value=n, constraint="non-negative prices and volumes, low not above high")


def info(name: str) -> dict[str, Any]:
    """Name, category, parameters and outputs of an indicator."""
    i = find(name)
    return {"name": name, "category": i.category, "params": i.params, "output": i.output, "required_periods": i.required_periods()}


def available(category: str | None = None) -> list[str]:
    return [n for n, i in REGISTRY.items() if category in (None, i.category)]


# What the indicators' descriptions share

ANY_SOURCE = ("open", "high", "low", "close", "volume")
PRICE_SOURCE = ("open", "high", "low", "close")


def period(default: int, least: int = 1, name: str = "period") -> ParamMeta:
    return ParamMeta(name, "integer", default, min=least, description="rows in the window")


def source(options: tuple[str, ...]) -> ParamMeta:
    return ParamMeta("source", "string", "close", options=options, description="bar column to read")


def outputs(kind: str, *names: str, example: str, unit: str = "", strings: tuple[str, ...] = (), description: str = "") -> OutputMeta:
    return OutputMeta(kind, tuple(FieldMeta(n, "string" if n in strings else "double") for n in names), description, example, unit)


def of_source(p: dict) -> tuple[str, ...]:
    return (p["source"],)


def fixed(*names: str) -> Callable[[dict], tuple[str, ...]]:
    return lambda p: names


def row() -> Column:
    return F.col(ROW)
