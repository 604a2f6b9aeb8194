"""Small bar frames for tests, and comparison of frames."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

T0 = datetime(2024, 1, 1, 9, 30)


def bars(spark, rows, symbol="s", step=timedelta(minutes=1), times=None):
    """rows: (open, high, low, close, volume), or closes alone."""
    from tickframe.sources.bars import canonicalize

    full = [r if isinstance(r, tuple) else (r, r, r, r, 1) for r in rows]
    data = [(symbol, times[i] if times else T0 + i * step, i, *map(str, r[:4]), r[4]) for i, r in enumerate(full)]
    df = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, seq long, open string, high string, low string, close string, volume long")
    return canonicalize(df)


def values(df, field="value"):
    return [None if r[field] is None else float(r[field]) if not isinstance(r[field], str) else r[field] for r in df.orderBy("symbol", "ts", "seq").collect()]


def plain(frame):
    """Sorted rows of text, with numbers to 6 decimals."""
    frame = frame[sorted(frame.columns)].copy()
    for name in frame:
        frame[name] = frame[name].map(
            lambda x: "null" if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)) else f"{x:.6f}" if isinstance(x, (float, np.floating)) else str(pd.Timestamp(x)) if hasattr(x, "year") else str(x)
        )
    return sorted(map(tuple, frame.values.tolist()))
