"""The stream's operator on states in memory: what it holds and hands on at a time, whatever a key has."""

import random

import pandas as pd
import pytest

from tapeline.streaming import stateful


class Kept:
    """A value, list or map state in memory."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.value, self.items, self.map = None, [], {}

    def get(self):
        return iter(self.items) if self.items else self.value

    def update(self, value):
        self.value = value

    def appendList(self, rows):
        self.items += rows

    def put(self, rows):
        self.items = list(rows)

    def keys(self):
        return iter(list(self.map))

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        self.map.pop(key, None)


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Kept())

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Times:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_a_long_series_goes_through_in_parts():
    """30,000 ticks that came in any order, up to two watermarks, one of them inside a bucket: the indicator over the whole
    series, in frames of some thousand rows; then the state is cleared."""
    n, start = 30_000, stateful.START_MS
    stamps = [100 * i for i in range(n)]
    random.Random(3).shuffle(stamps)
    handle, got = Handle(), []
    tool = stateful.Ordered(lambda: stateful.Rolling(50), stateful.DAY_MS)
    tool.init(handle)
    frames = (pd.DataFrame({"ms": [start + s for s in part], "side": 1, "timestamp": part, "value": [float(s % 7_300) for s in part]}) for part in (stamps[k : k + 10_000] for k in range(0, n, 10_000)))
    assert not list(tool.handleInputRows((0, "A"), frames, Times(0)))
    for mark in (start + 1_234_567, start + 100 * n, start + 100 * n + stateful.DAY_MS):
        while handle.timers and handle.timers[0] <= mark:
            handle.timers.pop(0)
            for frame in tool.handleExpiredTimer((0, "A"), Times(mark), None):
                assert len(frame) <= 5_000 and frame["timestamp"].max() <= mark - start
                got += list(zip(frame["timestamp"], frame["mean"]))
    whole, ring = stateful.Rolling(50), stateful.Ring(Kept())
    assert got == [(100 * i, whole.update(float(100 * i % 7_300), 0, ring)[1]) for i in range(n)]
    assert not handle.timers and not any(s.value or s.items or s.map for s in handle.states.values())


@pytest.mark.parametrize("make", [lambda: stateful.Drift(50, 5.0), lambda: stateful.Guard(60.0, 0.001), lambda: stateful.LagAcf(20, 3), lambda: stateful.Rolling(1000), lambda: stateful.LastEvent(500)])
def test_every_indicator_comes_in_parts(make):
    """20,000 ticks of a key, due at once: each comes out once, in order, in frames of some thousand rows."""
    n, start, handle, got = 20_000, stateful.START_MS, Handle(), []
    stamps = [100 * i for i in range(n)]
    tool = stateful.Ordered(make, stateful.DAY_MS)
    tool.init(handle)
    assert not list(tool.handleInputRows((0, "A"), iter([pd.DataFrame({"ms": [start + s for s in stamps], "side": 1, "timestamp": stamps, "value": [float(s % 7_300) for s in stamps]})]), Times(0)))
    handle.timers.clear()
    for frame in tool.handleExpiredTimer((0, "A"), Times(start + 100 * n), None):
        assert len(frame) <= 5_000
        got += frame["timestamp"].tolist()
    assert got == stamps
