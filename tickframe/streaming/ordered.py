"""A symbol's rows of a micro-batch in order of (ts, seq), with bounded memory.

Spark does not sort streams, and one symbol may have all rows of a micro-batch. Rows are sorted HELD at a time; sorted
runs go to files without a name in the executor's local folder and are merged block by block.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

#: Rows that are sorted in memory, rows of a block in a run's file, and runs of a level that become one of the next.
HELD, BLOCK, FAN = 100_000, 2_000, 64


def in_order(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of all frames by ts (nulls last) and seq, in frames of up to BLOCK rows; of equal ones the one that came first is first."""
    levels: list[list[Iterator[pd.DataFrame]]] = [[]]
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= HELD:
            _keep(levels, _written(_sorted(held)))
            held, n = [], 0
    # Runs of higher levels came before those of lower ones.
    runs = [run for level in reversed(levels) for run in level]
    return _merged(runs + [_sorted(held)] if held else runs)


def _keep(levels: list[list[Iterator[pd.DataFrame]]], run: Iterator[pd.DataFrame]) -> None:
    levels[0].append(run)
    for i in range(len(levels)):
        if len(levels[i]) == FAN:
            if i + 1 == len(levels):
                levels.append([])
            levels[i + 1].append(_written(_merged(levels[i])))
            levels[i] = []


def _keys(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ts = frame["ts"].to_numpy("datetime64[ns]")
    return np.where(np.isnat(ts), np.iinfo(np.int64).max, ts.view(np.int64)), frame["seq"].to_numpy(np.int64)


def _blocks(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    return (frame.iloc[i : i + BLOCK] for i in range(0, len(frame), BLOCK))


def _sorted(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frame = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    ts, seq = _keys(frame)
    return _blocks(frame.iloc[np.lexsort((seq, ts))])


def _written(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same blocks, from a file that is gone when it is closed."""
    file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
    count = 0
    for block in blocks:
        pickle.dump(block, file, pickle.HIGHEST_PROTOCOL)
        count += 1
    file.seek(0)

    def read() -> Iterator[pd.DataFrame]:
        with file:
            for _ in range(count):
                yield pickle.load(file)

    return read()


def _merged(runs: list[Iterator[pd.DataFrame]]) -> Iterator[pd.DataFrame]:
    """The rows of sorted runs in order; one block of each run is in memory."""
    heads = []  # run, its block's keys, its block

    def pull(run: Iterator[pd.DataFrame]) -> tuple | None:
        block = next(run, None)
        return None if block is None else (run, *_keys(block), block)

    heads = [h for h in map(pull, runs) if h]
    while heads:
        # Up to the least of the blocks' last keys, nothing is to come from any run but rows that equal it.
        t, q = min((ts[-1], seq[-1]) for _, ts, seq, _ in heads)
        parts, left = [], []
        for run, ts, seq, block in heads:
            lo, hi = np.searchsorted(ts, t, "left"), np.searchsorted(ts, t, "right")
            n = lo + np.searchsorted(seq[lo:hi], q, "right")
            if n:
                parts.append(block.iloc[:n])
            head = (run, ts[n:], seq[n:], block.iloc[n:]) if n < len(ts) else pull(run)
            if head:
                left.append(head)
        heads = left
        yield from _sorted(parts)
