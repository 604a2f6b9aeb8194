"""Recurrences over a series, in one Arrow pass over rows that are already grouped and sorted.

The state of a series is a few numbers, carried from batch to batch, so a series of any length needs one batch of
memory. All recurrences that a plan asks for are computed in the same pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import ORDER


@dataclass(frozen=True)
class Smooth:
    """y = x * a + y * (1 - a) in column out.

    x: a column, or a pair of columns whose difference counts, once both have values. a: a number or a column.
    seed: the mean of the first `start` values (x null before that is skipped), or with start = 0 the first value
    itself. divide: the step is ((n - 1) * y + x) / n instead, with n = divide. least: the least value of a column a.
    """

    out: str
    x: str | tuple[str, str]
    a: float | str | None = None
    start: int = 0
    divide: int | None = None
    least: float = 0.0


def _step(spec: Smooth, x: np.ndarray, a, state: list) -> np.ndarray:
    """Values of one run of rows of a series; state is [count, sum, y] and carries on."""
    out = np.full(len(x), np.nan)
    count, total, y = state
    n = float(spec.divide) if spec.divide else 0.0
    steps = a if isinstance(a, np.ndarray) else None
    for i, value in enumerate(x.tolist()):
        if value != value:
            continue
        if y is None:
            count, total = count + 1, total + value
            if count >= max(1, spec.start):
                y = total / count if spec.start else value
        elif spec.divide:
            y = ((n - 1.0) * y + value) / n
        else:
            k = steps[i] if steps is not None else a
            y = value * k + y * (1.0 - k)
        if y is not None:
            out[i] = y
    state[:] = count, total, y
    return out


def run_kernels(df: DataFrame, specs: list[Smooth]) -> DataFrame:
    """df with the columns of specs; null where a recurrence has not started. Needs symbol, ts and seq, and the rows of a symbol in one partition."""
    if not specs:
        return df
    made = {s.out for s in specs}
    reads = list(dict.fromkeys(c for s in specs for c in ((s.x,) if isinstance(s.x, str) else s.x) + ((s.a,) if isinstance(s.a, str) else ()) if c not in made))
    names = df.columns
    schema = T.StructType([*df.schema.fields, *[T.StructField(s.out, T.DoubleType()) for s in specs]])

    def run(batches):
        symbol, states = None, []
        for batch in batches:
            told = batch.column(names.index("symbol")).dictionary_encode(null_encoding="encode")
            keys, found = told.indices.to_numpy(zero_copy_only=False), told.dictionary.to_pylist()
            values = {c: np.array(batch.column(names.index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64) for c in reads}
            for s in specs:
                values[s.out] = np.full(len(keys), np.nan)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if not states or found[keys[lo]] != symbol:
                    symbol, states = found[keys[lo]], [[0, 0.0, None] for _ in specs]
                for s, state in zip(specs, states, strict=True):
                    x = values[s.x][lo:hi] if isinstance(s.x, str) else values[s.x[0]][lo:hi] - values[s.x[1]][lo:hi]
                    a = values[s.a][lo:hi] if isinstance(s.a, str) else s.a
                    values[s.out][lo:hi] = _step(s, x, a, state)
            cols = [pa.array(values[s.out], pa.float64(), mask=np.isnan(values[s.out])) for s in specs]
            yield pa.record_batch([*batch.columns, *cols], [*names, *[s.out for s in specs]])

    # The plan has dealt the rows by symbol; after a window over the same order this sort costs nothing.
    return df.sortWithinPartitions("symbol", *[F.col(c) for c in ORDER]).mapInArrow(run, schema)
