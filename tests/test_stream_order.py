"""A symbol's rows of a micro-batch are put in order with bounded memory."""

import tracemalloc
from datetime import timedelta
from decimal import Decimal
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from helpers import T0
from tickframe.plans.pipeline import Pipeline
from tickframe.streaming import incremental, ordered


def small(monkeypatch, **sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ordered, name, value)


def scrambled(n, size=500):
    """n bars, one a minute, in frames whose rows and which themselves are in no order."""
    order = np.random.default_rng(n).permutation(n)
    for i in range(0, n, size):
        yield pd.DataFrame([("a", T0 + timedelta(minutes=int(k)), int(k), Decimal(int(k) % 97).scaleb(-4)) for k in order[i : i + size]], columns=["symbol", "ts", "seq", "close"])


def through(n, take):
    """What a processor leaves in its state when all n bars come in one micro-batch; take gets each of its frames."""
    left = []
    processor = incremental._Processor(Pipeline().add_stage("fast", "sma", period=3).build())
    processor.state = SimpleNamespace(exists=lambda: False, update=left.append)
    for frame in processor.handleInputRows(("a",), scrambled(n), None):
        take(frame)
    return left


def test_memory_of_a_micro_batch_does_not_grow_with_it(monkeypatch):
    small(monkeypatch, HELD=400, BLOCK=50, FAN=3)
    through(500, len)  # what is loaded once
    peaks = []
    for n in (2000, 10_000):
        sizes = []
        tracemalloc.start()
        through(n, lambda frame: sizes.append(len(frame)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert sum(sizes) == n - 2
    assert peaks[1] < 2 * peaks[0], peaks


def test_results_of_a_micro_batch_in_many_runs(monkeypatch):
    small(monkeypatch, HELD=700, BLOCK=30, FAN=3)
    got = []
    (snapshot, last), = through(9000, got.append)
    assert max(map(len, got)) <= 30
    got = pd.concat(got)
    closes = pd.Series([k % 97 / 1e4 for k in range(9000)])
    assert got["number"].to_numpy() == pytest.approx(closes.rolling(3).mean()[2:].to_numpy(), abs=1e-12)
    assert list(got["ts"]) == [T0 + timedelta(minutes=k) for k in range(2, 9000)]
    assert last.endswith(f" {8999:020d}") and "fast" in snapshot


def test_order_of_equal_rows_and_of_rows_without_time(monkeypatch):
    small(monkeypatch, HELD=40, BLOCK=7, FAN=3)
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"ts": pd.to_datetime(rng.integers(0, 30, 2000), unit="us"), "seq": rng.integers(-3, 3, 2000), "arrival": range(2000)})
    rows.loc[rng.random(2000) < 0.1, "ts"] = pd.NaT
    got = pd.concat(ordered.in_order(rows.iloc[i : i + 13] for i in range(0, 2000, 13)))
    wanted = rows.sort_values(["ts", "seq"], kind="stable")
    assert got[["ts", "seq"]].reset_index(drop=True).equals(wanted[["ts", "seq"]].reset_index(drop=True)) and sorted(got["arrival"]) == list(range(2000))
    assert got.drop_duplicates(["ts", "seq"])["arrival"].tolist() == wanted.drop_duplicates(["ts", "seq"])["arrival"].tolist()
    assert list(ordered.in_order([])) == []
