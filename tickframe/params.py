"""Parameter and output descriptions, and the one validator that every indicator uses."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .errors import InvalidParams

PERIODS = {"short": 14, "medium": 21, "long": 50}


@dataclass(frozen=True)
class ParamMeta:
    """One option of an indicator. kind: integer, float, string or boolean."""

    name: str
    kind: str
    default: Any = None
    required: bool = False
    min: float | None = None
    max: float | None = None
    options: tuple | None = None
    description: str = ""


@dataclass(frozen=True)
class FieldMeta:
    """One output column."""

    name: str
    kind: str
    description: str = ""
    unit: str = ""


@dataclass(frozen=True)
class OutputMeta:
    """What an indicator returns; example is a Spark SQL predicate over its columns, each prefixed with its name."""

    kind: str
    fields: tuple[FieldMeta, ...] = field(default_factory=tuple)
    description: str = ""
    example: str = ""
    unit: str = ""


def resolve_period(spec: str | int) -> int:
    """A named period (short, medium, long) or a positive number as a number of rows."""
    if isinstance(spec, str) and spec in PERIODS:
        return PERIODS[spec]
    if isinstance(spec, int) and not isinstance(spec, bool) and spec > 0:
        return spec
    raise InvalidParams(f"Unknown period {spec!r}", param="period", value=spec, expected="short, medium, long or a positive integer")


def _has_kind(value: Any, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "float":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "boolean":
        return isinstance(value, bool)
    return isinstance(value, str)


def validate_params(params: dict[str, Any], metadata: tuple[ParamMeta, ...], strict: bool = False) -> dict[str, Any]:
    """params with defaults filled in, checked against metadata. Unknown names are ignored, or refused if strict."""
    if not isinstance(params, dict):
        raise InvalidParams("Parameters must be a mapping", param=None, value=params, expected="mapping")
    known = {m.name: m for m in metadata}
    if strict and (extra := sorted(params.keys() - known.keys())):
        raise InvalidParams(f"Unknown parameter {extra[0]}", param=extra[0], value=params[extra[0]], expected="no parameters" if not known else f"one of {sorted(known)}")
    out = {}
    for name, meta in known.items():
        if name not in params or params[name] is None:
            if meta.required:
                raise InvalidParams(f"Missing parameter {name}", param=name, value=None, expected=meta.kind)
            out[name] = meta.default
            continue
        value = params[name]
        if not _has_kind(value, meta.kind):
            raise InvalidParams(f"{name} must be of type {meta.kind}, got {value!r}", param=name, value=value, expected=meta.kind)
        if meta.kind in ("integer", "float") and ((meta.min is not None and value < meta.min) or (meta.max is not None and value > meta.max)):
            raise InvalidParams(f"{name} must lie between {meta.min} and {meta.max}, got {value}", param=name, value=value, expected=f"{meta.min} to {meta.max}")
        if meta.options is not None and value not in meta.options:
            raise InvalidParams(f"{name} must be one of {meta.options}, got {value!r}", param=name, value=value, expected=f"one of {meta.options}")
        out[name] = value
    return out
