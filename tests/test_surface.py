"""Functions per indicator, checks of whole inputs, batches of streams."""

import pytest

from helpers import bars, values
from tickframe import indicators
from tickframe.errors import InsufficientData, InvalidDataFormat, StreamStateError, ValidationError
from tickframe.operators import REGISTRY, calculate
from tickframe.sources.bars import validate_bars
from tickframe.streaming.incremental import Stream


def test_a_function_for_each_indicator(spark):
    assert values(bars(spark, [1, 2, 3]).transform(indicators.sma(period=2))) == [1.5, 2.5]
    assert all(getattr(indicators, n).__name__ == n for n in REGISTRY)
    assert indicators.categories() == ("trend", "momentum", "volatility", "volume") and len(indicators.all_info()) == 20 and len(indicators.all_info("volume")) == 4


def test_strict_checks(spark):
    for row in ((1, 2, 1, -1, 5), (1, 2, 1, 1, -5), (1, 1, 2, 1, 5)):
        with pytest.raises(ValidationError):
            calculate("obv", bars(spark, [row]), strict=True)
    assert calculate("obv", bars(spark, [(1, 2, 1, 1, 5)]), strict=True).count() == 1


def test_whole_inputs(spark):
    validate_bars(bars(spark, [1, 2]))
    with pytest.raises(InsufficientData):
        validate_bars(bars(spark, [1]).limit(0))
    with pytest.raises(InvalidDataFormat) as e:
        validate_bars(bars(spark, [1, (1, 1, 1, 1, -3)]))
    assert e.value.received["seq"] == 1


def test_a_refused_batch_leaves_the_state(spark):
    stream = Stream("sma", period=2)
    assert stream.process([{"close": 1}, {"close": 2}]) == [{"value": 1.5}]
    with pytest.raises(StreamStateError):
        stream.process([{"close": 9}, {}])
    assert stream.process([{"close": 4}]) == [{"value": 3.0}]
