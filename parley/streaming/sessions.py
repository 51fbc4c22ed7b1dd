"""Recordings as sessions of events: level samples and controls (pause, resume, snooze) in one order.

A machine goes through the events of one recording. Stored events are sorted and folded; a stream holds each event back
until the watermark has passed it, so late rows take their place whatever batch they come in, and both give the same.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators.folds import Fold, in_order

#: Kinds of event, in the order in which those of one time count.
KINDS = ("pause", "resume", "snooze", "level")
EVENTS = "key long, ts_ms long, kind int, value double"
#: Columns of a stream's held events and how they are packed, and rows of a pack at most.
HELD = {"key": "int64", "ts_ms": "int64", "kind": "int32", "value": "float64"}
PART = 10_000
#: Keys of a stream are dealt to this many lanes, as Spark calls a processor, with several messages, per group and batch.
#: Null keys have one of their own. A stream that goes on from a checkpoint must keep the number.
LANES = 4096


@dataclass(frozen=True)
class WatchRules:
    """Silence is a level below `quiet`; a voice of voice_ms ends it. None switches a threshold off."""

    quiet: float = 0.01
    voice_ms: int = 800
    suggest_ms: int | None = 15 * 60_000
    stop_ms: int | None = None
    tail_ms: int = 5_000


@dataclass
class Watch:
    """suggest once in a silence, stop at its end; what a control says begins the count anew. After a stop nothing comes."""

    rules: WatchRules
    silence: int | None = None
    voice: int | None = None
    suggested: bool = False
    paused: bool = False
    done: bool = False
    last: int | None = None

    SCHEMA = "ts_ms long, signal string, silent_ms long, at_ms long"

    def event(self, ts: int, kind: int, value: float | None) -> list[tuple]:
        self.last = ts
        if self.done or self.rules.suggest_ms is None and self.rules.stop_ms is None:
            return []
        if KINDS[kind] != "level":
            self.paused = KINDS[kind] == "pause" or self.paused and KINDS[kind] == "snooze"
            self.silence, self.voice, self.suggested = None, None, False
            return []
        if self.paused or value is None:
            return []
        if value >= self.rules.quiet:
            self.voice = ts if self.voice is None else self.voice
            if ts - self.voice >= self.rules.voice_ms:
                self.silence, self.voice, self.suggested = None, None, False
            return []
        self.voice = None
        self.silence = ts if self.silence is None else self.silence
        silent = ts - self.silence
        if self.rules.stop_ms is not None and silent >= self.rules.stop_ms:
            self.done = True
            return [(ts, "stop", silent, min(self.silence + self.rules.tail_ms, ts))]
        if self.rules.suggest_ms is not None and not self.suggested and silent >= self.rules.suggest_ms:
            self.suggested = True
            return [(ts, "suggest", silent, None if self.rules.stop_ms is None else self.silence + self.rules.stop_ms)]
        return []

    def end(self) -> list[tuple]:
        return []


@dataclass(frozen=True)
class CutRules:
    """A chunk is cut from_ms to to_ms after its start, pauses not counted; silence is a level below `quiet` for least_ms.
    A recording without events for idle_ms is over."""

    from_ms: int = 540_000
    to_ms: int = 660_000
    quiet: float = 0.01
    least_ms: int = 300
    idle_ms: int = 24 * 3_600_000


@dataclass
class Cutter:
    """Chunks of a recording, cut in the middle of the longest silence of the window (the first of equals), else at its
    quietest sample, else, without samples, at its end. Samples are held from the next window's start on only."""

    rules: CutRules
    start: int | None = None  # of the chunk, on the clock without pauses
    wall: int | None = None
    session: int | None = None
    number: int = 0
    shift: int = 0  # pauses so far
    shift_at_start: int = 0
    paused_at: int | None = None
    last: int | None = None
    held: list = field(default_factory=list)  # (time without pauses, value, pauses before it)

    SCHEMA = "session_ms long, chunk long, start_ms long, end_ms long, paused_ms long"

    def event(self, ts: int, kind: int, value: float | None) -> list[tuple]:
        out = []
        if self.last is not None and ts - self.last > self.rules.idle_ms:
            out = self.end()
        if self.session is None:
            self.session = self.wall = self.start = ts
        self.last = ts
        if KINDS[kind] == "pause" and self.paused_at is None:
            self.paused_at = ts
        elif KINDS[kind] == "resume" and self.paused_at is not None:
            self.shift, self.paused_at = self.shift + ts - self.paused_at, None
        elif KINDS[kind] == "level" and self.paused_at is None:
            own = ts - self.shift
            while own - self.start > self.rules.to_ms:
                out.append(self.cut())
            if value is not None and own - self.start >= self.rules.from_ms:
                self.held.append((own, value, self.shift))
        return out

    def cut(self) -> tuple:
        first, last = self.start + self.rules.from_ms, self.start + self.rules.to_ms
        window, run, best = [h for h in self.held if first <= h[0] <= last], None, None
        for own, value, _ in window:
            if value < self.rules.quiet:
                run = (run[0], own) if run else (own, own)
                if run[1] - run[0] >= self.rules.least_ms and (best is None or run[1] - run[0] > best[1] - best[0]):
                    best = run
            else:
                run = None
        at = (best[0] + best[1]) // 2 if best else min(window, key=lambda h: h[1])[0] if window else last
        shift = max((h[2] for h in self.held if h[0] <= at), default=self.shift_at_start if window else self.shift)
        row = (self.session, self.number, self.wall, at + shift, shift - self.shift_at_start)
        self.number, self.start, self.wall, self.shift_at_start = self.number + 1, at, at + shift, shift
        self.held = [h for h in self.held if h[0] >= at + self.rules.from_ms]
        return row

    def end(self) -> list[tuple]:
        if self.session is None:
            return []
        now = self.shift + (self.last - self.paused_at if self.paused_at is not None else 0)
        row = (self.session, self.number, self.wall, self.last, now - self.shift_at_start)
        self.__init__(self.rules)
        return [row]


class _Stored(Fold):
    def __init__(self, machine, rules):
        self.machine = machine(rules)

    def row(self, ts, kind, value):
        return self.machine.event(ts, kind, value)

    def end(self):
        return self.machine.end()


class _Streamed(StatefulProcessor):
    """The machines of a lane of keys: events are held, packed, until the watermark has passed them; the state of each
    machine is JSON under its key. A lane has one timer, for its next event or the end of its next idle recording."""

    def __init__(self, machine, rules, idle_ms):
        self.machine, self.rules, self.idle_ms = machine, rules, idle_ms
        self.columns = [x.split()[0] for x in f"key long, {machine.SCHEMA}".split(", ")]

    def init(self, handle):
        self.handle = handle
        self.held = handle.getListState("held", ", ".join(f"{c} binary" for c in HELD))
        self.state = handle.getMapState("state", "key long", "json string")
        self.open = handle.getValueState("open", "key binary, last binary")  # the last events, where recordings end by being idle

    def hold(self, events: pd.DataFrame) -> None:
        self.held.appendList([tuple(events[c].astype(kind).to_numpy().tobytes() for c, kind in HELD.items())])

    def handleInputRows(self, key, rows, timerValues):
        least = None
        for part in rows:
            if len(part):
                self.hold(part)
                first = int(part["ts_ms"].min())
                least = first if least is None else min(least, first)
        timers = list(self.handle.listTimers())
        if least is not None and (not timers or least < min(timers)):
            for at in timers:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, out = timerValues.getCurrentWatermarkInMs(), []
        last = {}
        if self.idle_ms is not None and self.open.exists():
            last = dict(zip(*(np.frombuffer(x, "int64").tolist() for x in self.open.get()), strict=True))
        parts = [pd.DataFrame({c: np.frombuffer(x, kind) for (c, kind), x in zip(HELD.items(), part, strict=True)}) for part in self.held.get()] if self.held.exists() else []
        held = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=list(HELD))
        ready, later = held[held["ts_ms"] <= now], held[held["ts_ms"] > now]
        ready = ready.sort_values(["key", "ts_ms", "kind", "value"], na_position="first")
        values = (None if v != v else v for v in ready["value"].tolist())
        events = zip(ready["key"].tolist(), ready["ts_ms"].tolist(), ready["kind"].tolist(), values, strict=True)
        known = self.state.exists()

        def passed(own, told):
            state = self.state.getValue((own,)) if known else None
            machine = self.machine(self.rules, **json.loads(state[0])) if state else self.machine(self.rules)
            rows = [row for e in told for row in machine.event(*e[1:])]
            if self.idle_ms is not None and machine.last is not None and now - machine.last > self.idle_ms:
                rows += machine.end()
            if machine.last is None:
                self.state.removeKey((own,))
                last.pop(own, None)
            else:
                self.state.updateValue((own,), (json.dumps({k: v for k, v in vars(machine).items() if k != "rules"}),))
                last[own] = machine.last
            out.extend((own if key[0] >= 0 else None, *row) for row in rows)

        for own, told in groupby(events, itemgetter(0)):
            passed(own, told)
        self.held.clear()
        for i in range(0, len(later), PART):
            self.hold(later[i : i + PART])
        due = [int(later["ts_ms"].min())] if len(later) else []
        if self.idle_ms is not None:
            for own in [k for k, at in last.items() if now - at > self.idle_ms]:
                passed(own, ())
            self.open.update(tuple(np.array(x, "int64").tobytes() for x in (list(last), list(last.values()))))
            due += [at + self.idle_ms + 1 for at in last.values()]
        if due:
            self.handle.registerTimer(min(due))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self):
        pass


def _signals(events: DataFrame, machine, rules, idle_ms=None) -> DataFrame:
    schema = f"key long, {machine.SCHEMA}"
    if not events.isStreaming:
        return in_order(events.select("key", "ts_ms", "kind", "value"), ["ts_ms", "kind", "value"], _Stored, schema, machine, rules)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    lane = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(LANES))).alias("lane")
    dealt = events.select(lane, F.coalesce("key", F.lit(0)).alias("key"), "ts_ms", "kind", "value", "ts")
    return dealt.groupBy("lane").transformWithStateInPandas(_Streamed(machine, rules, idle_ms), StructType.fromDDL(schema), "Append", "EventTime")


def events_of(levels: DataFrame, controls: DataFrame, late: str = "1 hour") -> DataFrame:
    """One table or stream of events (key, ts_ms, kind, value and, of streams, ts with a watermark): levels (key, ts_ms,
    value) and controls (key, ts_ms, control); controls of another name are passed over."""
    number = F.lit(None).cast("int")
    for i, name in enumerate(KINDS[:3]):
        number = F.when(F.col("control") == name, i).otherwise(number)
    own = levels.select(F.col("key").cast("long").alias("key"), F.col("ts_ms").cast("long").alias("ts_ms"), F.lit(3).alias("kind"), F.col("value").cast("double").alias("value"))
    told = controls.select(F.col("key").cast("long").alias("key"), F.col("ts_ms").cast("long").alias("ts_ms"), number.alias("kind"), F.lit(None).cast("double").alias("value")).where("kind is not null")
    both = own.unionByName(told)
    return both.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late) if both.isStreaming else both


def watched(events: DataFrame, rules: WatchRules = WatchRules()) -> DataFrame:
    """key, ts_ms, signal (suggest or stop), silent_ms, at_ms (when it would stop, and where to trim) of events."""
    return _signals(events, Watch, rules)


def recording_chunks(events: DataFrame, rules: CutRules = CutRules()) -> DataFrame:
    """key, session_ms, chunk, start_ms, end_ms, paused_ms: the chunks of each recording; the last one ends with its last
    event. In a stream a chunk comes once its window has passed, the last one after idle_ms."""
    return _signals(events, Cutter, rules, rules.idle_ms)
