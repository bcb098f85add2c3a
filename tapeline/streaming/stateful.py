"""Keyed stateful indicators over tick streams.

Ordering contract: rows of a key are taken in the order of their event time. They wait in the key's state until
the watermark has passed them, so a file or partition out of order changes nothing. Rows that come when the watermark has
passed them already are late: they change no indicator, and come out at once with `late` set, each of
them. (Spark itself drops late rows before a stateful operator sees them, if their event time is a watermark's own column;
here it is handed on as a number, so that none is lost.) The day is part of the key: a new day starts from
nothing, and a timer clears a key's state once the watermark is `keep_ms` beyond its last row.

State is kept by transformWithStateInPandas in RocksDB (see session). An indicator's window is a ring of chunks in a map
state, of which a batch reads and writes those that its rows touch; its sums are compensated and updated by the row
that comes and the row that goes, so a tick costs the same for any window.

An indicator is a small object with update(value, time, ring) -> list of numbers (None for undefined), a flat list of
numbers as its scalars (dump, load), and reach: how many rows back it reads its ring.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeline.functions.stats import RESIDUE

#: Event time of a tick: days are far apart, so that a day's end is known once the next has begun. Day 0
#: begins long after the epoch, at which watermarks start: days may be negative.
DAY_MS, START_MS = 10_000_000, 1_000_000_000_000
#: Rows of a chunk of a ring.
CHUNK = 64
#: Event time of a bucket of waiting rows: some thousand ticks (a tick is 100).
BUCKET_MS = 200_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(spark: SparkSession) -> SparkSession:
    """A session for streams with these indicators: as spark, with state in RocksDB; spark's own settings stay."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return own


# ---------------------------------------------------------------- state of one key


class Total:
    """A sum from which terms may be taken again: what rounding loses is kept and added at the end."""

    def __init__(self, high: float = 0.0, low: float = 0.0):
        self.high, self.low = high, low

    def add(self, x: float) -> None:
        now = self.high + x
        self.low += (self.high - now) + x if abs(self.high) >= abs(x) else (x - now) + self.high
        self.high = now

    @property
    def value(self) -> float:
        return self.high + self.low


class Ring:
    """Values of the last rows of a key by their number, in chunks of a map state."""

    def __init__(self, store: Any):
        self.store, self.chunks, self.changed = store, {}, set()

    def _chunk(self, k: int) -> list[float]:
        if k not in self.chunks:
            found = self.store.getValue((k,))
            self.chunks[k] = [] if found is None else list(found[0])
        return self.chunks[k]

    def __getitem__(self, i: int) -> float:
        return self._chunk(i // CHUNK)[i % CHUNK]

    def append(self, i: int, x: float, reach: int) -> None:
        """Row i; rows before i - reach are not read again."""
        self._chunk(i // CHUNK).append(x)
        self.changed.add(i // CHUNK)
        gone = (i - reach) // CHUNK - 1
        if i % CHUNK == 0 and gone >= 0:
            self.chunks.pop(gone, None)
            self.changed.discard(gone)
            self.store.removeKey((gone,))

    def flush(self) -> None:
        for k in sorted(self.changed):
            self.store.updateValue((k,), (self.chunks[k],))
        self.chunks, self.changed = {}, set()


class Rolling:
    """n, mean, std (null below two), z (null until full or without variance) of the last values."""

    names = ("n", "mean", "std", "z")

    def __init__(self, window: int):
        self.window = self.reach = window
        self.load([0.0] * 8)

    def update(self, x: float, time: int, ring: Ring) -> list:
        if not self.rows:
            self.centre = x
        self.equal = self.equal + 1 if self.rows and x == self.last else 1
        self.first.add(x - self.centre)
        self.second.add((x - self.centre) ** 2)
        if self.rows >= self.window:
            old = ring[self.rows - self.window] - self.centre
            self.first.add(-old)
            self.second.add(-old * old)
        ring.append(self.rows, x, self.reach)
        self.rows, self.last = self.rows + 1, x
        n = min(self.rows, self.window)
        mean = self.first.value / n
        # a window of equal values has no variance, whatever its sums have rounded to
        variance = 0.0 if self.equal >= n else max(0.0, self.second.value / n - mean * mean)
        std = math.sqrt(variance) if n >= 2 else None
        mean += self.centre
        return [float(n), mean, std, (x - mean) / std if n == self.window and std else None]

    def dump(self) -> list[float]:
        return [float(self.rows), self.centre, float(self.equal), self.last, self.first.high, self.first.low, self.second.high, self.second.low]

    def load(self, state: list[float]) -> None:
        self.rows, self.centre, self.equal, self.last = int(state[0]), state[1], int(state[2]), state[3]
        self.first, self.second = Total(*state[4:6]), Total(*state[6:8])


class Ema:
    names, reach = ("ema",), 0

    def __init__(self, span: float):
        self.alpha, self.value = 2 / (span + 1), None

    def update(self, x: float, time: int, ring: Ring) -> list:
        self.value = x if self.value is None else self.alpha * x + (1 - self.alpha) * self.value
        return [self.value]

    def dump(self) -> list[float]:
        return [] if self.value is None else [self.value]

    def load(self, state: list[float]) -> None:
        self.value = state[0] if len(state) else None


class LagAcf:
    """Correlation of the last `window` pairs (x, x `lag` rows before)."""

    names = ("acf",)

    def __init__(self, window: int, lag: int):
        self.window, self.lag, self.reach = window, lag, window + lag
        self.load([0.0] * 12)

    def _pair(self, a: float, b: float, sign: float) -> None:
        a, b = a - self.centre, b - self.centre
        for total, term in zip(self.totals, (a, b, a * a, b * b, a * b)):
            total.add(sign * term)

    def update(self, x: float, time: int, ring: Ring) -> list:
        i = self.rows
        if not i:
            self.centre = x
        ring.append(i, x, self.reach)
        if i >= self.lag:
            self._pair(x, ring[i - self.lag], 1.0)
        if i - self.lag >= self.window:
            self._pair(ring[i - self.window], ring[i - self.lag - self.window], -1.0)
        self.rows = i + 1
        n = max(0, min(self.rows - self.lag, self.window))
        if n < 2:
            return [None]
        sa, sb, saa, sbb, sab = (t.value for t in self.totals)
        va, vb = n * saa - sa * sa, n * sbb - sb * sb
        flat = va <= RESIDUE * n * saa or vb <= RESIDUE * n * sbb
        return [None if flat else max(-1.0, min(1.0, (n * sab - sa * sb) / (math.sqrt(va) * math.sqrt(vb))))]

    def dump(self) -> list[float]:
        return [float(self.rows), self.centre, *(x for t in self.totals for x in (t.high, t.low))]

    def load(self, state: list[float]) -> None:
        self.rows, self.centre = int(state[0]), state[1]
        self.totals = [Total(*state[k : k + 2]) for k in range(2, 12, 2)]


class Drift:
    """drifting (0 or 1): the rolling mean is over `threshold` away from that of the first full window."""

    names = ("drifting",)

    def __init__(self, window: int, threshold: float):
        self.window = self.reach = window
        self.threshold = threshold
        self.load([0.0, 0.0, 0.0, 0.0, math.nan])

    def update(self, x: float, time: int, ring: Ring) -> list:
        if not self.rows:
            self.centre = x
        self.total.add(x - self.centre)
        if self.rows >= self.window:
            self.total.add(self.centre - ring[self.rows - self.window])
        ring.append(self.rows, x, self.reach)
        self.rows += 1
        if self.rows < self.window:
            return [0.0]
        mean = self.total.value / self.window
        self.reference = mean if math.isnan(self.reference) else self.reference
        return [float(abs(mean - self.reference) > self.threshold)]

    def dump(self) -> list[float]:
        return [float(self.rows), self.centre, self.total.high, self.total.low, self.reference]

    def load(self, state: list[float]) -> None:
        self.rows, self.centre, self.total, self.reference = int(state[0]), state[1], Total(*state[2:4]), state[4]


class Guard:
    """fair (the first value plus `slope` times the time since), and halted (0 or 1): once a value was
    over `limit` away from fair, the key stays halted."""

    names, reach = ("fair", "halted"), 0

    def __init__(self, limit: float, slope: float = 0.0):
        self.limit, self.slope, self.start, self.since, self.tripped = limit, slope, None, 0, False

    def update(self, x: float, time: int, ring: Ring) -> list:
        if self.start is None:
            self.start, self.since = x, time
        fair = self.start + self.slope * (time - self.since)
        self.tripped = self.tripped or abs(x - fair) > self.limit
        return [fair, float(self.tripped)]

    def dump(self) -> list[float]:
        return [] if self.start is None else [self.start, float(self.since), float(self.tripped)]

    def load(self, state: list[float]) -> None:
        if len(state):
            self.start, self.since, self.tripped = state[0], int(state[1]), bool(state[2])


class LastEvent:
    """way and age of the latest event at or before a tick: one more than `lookback` before is none."""

    names, reach = ("way", "age"), 0

    def __init__(self, lookback: int):
        self.lookback, self.at, self.way = lookback, None, None

    def event(self, way: float, time: int) -> None:
        self.at, self.way = time, way

    def update(self, x: float, time: int, ring: Ring) -> list:
        fresh = self.at is not None and time - self.at <= self.lookback
        return [self.way, float(time - self.at)] if fresh else [None, None]

    def dump(self) -> list[float]:
        return [] if self.at is None else [float(self.at), self.way]

    def load(self, state: list[float]) -> None:
        if len(state):
            self.at, self.way = int(state[0]), state[1]


# ---------------------------------------------------------------- the operator


class Ordered(StatefulProcessor):
    """Feeds a key's rows to an indicator in the order of their event time, as the watermark passes them.

    States: waiting (rows beyond the watermark, by buckets of event time; what one frame brings to a bucket is a piece),
    pieces (how many came), scalars and ring (the indicator's), timer (when it is asked next). A task holds one frame or
    one bucket at a time, however many rows a key has.
    Rows have a side: 0 for events, which stand before ticks (1) of the same time and give no output.
    """

    def __init__(self, make: Callable[[], Any], keep_ms: int):
        self.make, self.keep_ms = make, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint, piece bigint", "ms array<bigint>, side array<int>, stamp array<bigint>, value array<double>")
        self.pieces = handle.getValueState("pieces", "n bigint")
        self.scalars = handle.getValueState("scalars", "v array<double>, last bigint")
        self.ring = handle.getMapState("ring", "chunk bigint", "v array<double>")
        self.timer = handle.getValueState("timer", "at bigint")

    def _ask(self, at: int) -> None:
        """One timer a key: the earliest time that something is due."""
        found = self.timer.get()
        if found is not None:
            if found[0] <= at:
                return
            self.handle.deleteTimer(found[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = self.make().names
        frame = pd.DataFrame([(int(key[0]), key[1], *r) for r in rows], columns=["day", "product", "timestamp", "value", *names, "late"])
        return frame.astype({n: "float64" for n in ("value", *names)})

    def _wait(self, rows: list[tuple]) -> None:
        """Rows (ms, side, stamp, value) to their buckets."""
        found, buckets = self.pieces.get(), {}
        piece = found[0] if found is not None else 0
        for row in rows:
            buckets.setdefault(row[0] // BUCKET_MS, []).append(row)
        for bucket, part in buckets.items():
            self.waiting.updateValue((bucket, piece), tuple(list(c) for c in zip(*part)))
        self.pieces.update((piece + 1,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark, missing, first = timerValues.getCurrentWatermarkInMs(), [None] * len(self.make().names), None
        for frame in rows:
            fresh, late = [], []
            for ms, side, stamp, value in zip(*(frame[c].tolist() for c in ("ms", "side", "timestamp", "value"))):
                if ms > mark:
                    fresh.append((ms, side, stamp, value))
                else:
                    late.append((stamp, value, *missing, True))
            if fresh:
                self._wait(fresh)
                least = min(r[0] for r in fresh)
                first = least if first is None else min(first, least)
            if late:
                yield self._frame(key, sorted(late))
        if first is not None:
            self._ask(first)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        pieces: dict[int, list[int]] = {}
        for bucket, piece in self.waiting.keys():
            pieces.setdefault(bucket, []).append(piece)
        found = self.scalars.get()
        last = found[1] if found is not None else 0
        tool, ring, due = self.make(), Ring(self.ring), None
        if found is not None:
            tool.load(list(found[0]))
        for bucket in sorted(pieces):
            if bucket * BUCKET_MS > mark:
                due = bucket * BUCKET_MS
                break
            rows = [r for piece in pieces[bucket] for r in zip(*self.waiting.getValue((bucket, piece)))]
            rows.sort(key=lambda r: r[:3])
            out, taken = [], 0
            for ms, side, stamp, value in rows:
                if ms > mark:
                    break
                last, taken = ms, taken + 1
                if side:
                    out.append((stamp, value, *tool.update(value, stamp, ring), False))
                else:
                    tool.event(value, stamp)
            if taken:
                ring.flush()
                self.scalars.update(([float(x) for x in tool.dump()], last))
                for piece in pieces[bucket]:
                    self.waiting.removeKey((bucket, piece))
                if left := rows[taken:]:
                    self._wait(left)
            if out:
                yield self._frame(key, out)
            if taken < len(rows):
                due = rows[taken][0]
                break
        if due is not None:
            self._ask(due)
        elif mark >= last + self.keep_ms:
            for state in (self.waiting, self.pieces, self.scalars, self.ring):
                state.clear()
        else:
            self._ask(last + self.keep_ms)

    def close(self) -> None:
        pass


def with_event_time(df: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Adds event_time and its watermark; timestamps of a day become milliseconds of it."""
    return df.withColumn("event_time", F.timestamp_millis(F.lit(START_MS) + F.col("day").cast("long") * DAY_MS + F.col("timestamp"))).withWatermark("event_time", delay)


def _rows(df: DataFrame, value: str, side: int) -> DataFrame:
    return df.select(
        "day", F.col("product").cast("string").alias("product"), "timestamp", F.col(value).cast("double").alias("value"),
        F.unix_millis("event_time").alias("ms"), F.lit(side).alias("side"),
    )


def _run(rows: DataFrame, make: Callable[[], Any], keep_ms: int) -> DataFrame:
    outputs = "day int, product string, timestamp long, value double, " + ", ".join(f"`{n}` double" for n in make().names) + ", late boolean"
    return rows.groupBy("day", "product").transformWithStateInPandas(Ordered(make, keep_ms), outputs, "append", "EventTime")


def indicators(df: DataFrame, value: str, make: Callable[[], Any], keep_ms: int = DAY_MS) -> DataFrame:
    """day, product, timestamp, value, the indicator's columns, late. df: from with_event_time, in a session().

    value has no nulls. Late rows come out with nulls for the indicator; every other row comes once, with its.
    """
    return _run(_rows(df, value, 1), make, keep_ms)


def last_events(ticks: DataFrame, events: DataFrame, way: str, lookback: int, keep_ms: int = DAY_MS) -> DataFrame:
    """ticks with way and age of the key's latest event within the lookback: two streams, both from with_event_time.

    ticks: day, product, timestamp; events: these and way, a number. Events of a tick's own time count. Late rows of
    either come out with late set; late events have their way as value, late ticks none.
    """
    ticks = ticks.withColumn("_none", F.lit(None).cast("double"))
    return _run(_rows(ticks, "_none", 1).unionByName(_rows(events, way, 0)), lambda: LastEvent(lookback), keep_ms)
