"""Ordered folds that no window expresses.

Rows are dealt by key and sorted; a task then goes through them once and holds one small state, never a key's rows. So a
key may have any number of rows: Spark's sort spills, and Python sees one batch at a time.
"""

from __future__ import annotations

import bisect
import math
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


class Fold:
    """The state of one key. row() takes the columns of a row after the key and returns finished rows, end() the last ones."""

    def row(self, *values) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def in_order(rows: DataFrame, order: list, fold: type[Fold], schema: str, *settings) -> DataFrame:
    """What a fold makes of the rows of each key (the first column) in order; key comes first in the output too."""
    key, columns = rows.columns[0], rows.columns
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        now, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for values in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if state is None or values[0] != now:
                    if state is not None:
                        out += [(now, *x) for x in state.end()]
                    now, state = values[0], fold(*settings)
                out += [(now, *x) for x in state.row(*values[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)
        if state is not None:
            out = [(now, *x) for x in state.end()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kind)


class _TokenWindows(Fold):
    def __init__(self, budget: int):
        self.budget, self.number, self.n, self.total = budget, 0, 0, 0
        self.first = self.last = self.size = None

    def row(self, order, size):
        done = []
        if self.n and self.total + size <= self.budget:
            self.n, self.total = self.n + 1, self.total + size
        else:
            if self.n:
                done = self.end()
                self.number += 1
            if self.n > 1 and self.size + size <= self.budget:
                self.first, self.n, self.total = self.last, 2, self.size + size
            else:
                self.first, self.n, self.total = order, 1, size
        self.last, self.size = order, size
        return done

    def end(self):
        return [(self.number, self.first, self.last, self.n, self.total)]


def token_windows(rows: DataFrame, key: str, order: str, tokens: str, budget: int = 350) -> DataFrame:
    """key, window, first, last, n, tokens: greedy windows of at most `budget` tokens. A window of several rows lends
    its last row to the next one; a row over the budget stands alone. Rows of equal order go by their tokens."""
    kind = rows.schema[key].dataType.simpleString()
    slim = rows.select(key, F.col(order).cast("long").alias(order), F.col(tokens).cast("long").alias(tokens))
    return in_order(slim, [order, tokens], _TokenWindows, f"{key} {kind}, window long, first long, last long, n long, tokens long", budget)


class _Budget(Fold):
    def __init__(self, budget: int, per_source: int):
        self.left, self.per_source, self.texts, self.sources, self.place = budget, per_source, set(), {}, 0

    def row(self, rank, passage_id, source, text, tokens):
        if tokens > self.left or text in self.texts or self.sources.get(source, 0) >= self.per_source:
            return []
        self.texts.add(text)
        self.sources[source] = self.sources.get(source, 0) + 1
        self.left -= tokens
        self.place += 1
        return [(passage_id, self.place)]


def budget_selection(hits: DataFrame, key: str, budget: int = 5500, per_source: int = 3) -> DataFrame:
    """key, passage_id, place of hits (key, passage_id, source, text, tokens, rank) taken in rank order: no text twice,
    at most per_source of a source, and none that would exceed the budget (later, smaller ones may still fit).

    What can't be taken goes before the fold: the budget left only falls, so of the rows of a source with t tokens (t > 0)
    and texts of their own at most per_source + budget / t come into question, the best ranked.
    """
    kind = hits.schema[key].dataType.simpleString()
    fit = hits.where(F.col("tokens") <= budget).groupBy(key, "source", "tokens", "text").agg(F.min(F.struct("rank", "passage_id")).alias("best")).select(key, "source", "tokens", "text", "best.rank", "best.passage_id")
    place = F.row_number().over(Window.partitionBy(key, "source", "tokens").orderBy("rank", "passage_id"))
    few = fit.where("tokens > 0").withColumn("place", place).where(F.col("place") <= per_source + F.floor(F.lit(budget) / F.col("tokens"))).drop("place")
    rows = few.unionByName(fit.where("tokens <= 0")).select(key, F.col("rank").cast("long"), F.col("passage_id").cast("long"), "source", "text", F.col("tokens").cast("long"))
    return in_order(rows, ["rank", "passage_id"], _Budget, f"{key} {kind}, passage_id long, place long", budget, per_source)


class _Lanes(Fold):
    def __init__(self):
        self.ends, self.reach, self.cluster = [], None, -1

    def row(self, start, end, item):
        if self.reach is None or start >= self.reach:
            self.ends, self.reach, self.cluster = [], end, self.cluster + 1
        lane = next((i for i, e in enumerate(self.ends) if e <= start), len(self.ends))
        self.ends[lane : lane + 1] = [end]
        self.reach = max(self.reach, end)
        return [(item, start, end, lane, self.cluster)]


def lanes(rows: DataFrame, key: str, item: str, start: str, end: str) -> DataFrame:
    """key, item, start, end with lane (the first that is free at their start) and width (lanes of their cluster of
    overlapping rows). The state is the ends of the lanes in use."""
    kind, own = rows.schema[key].dataType.simpleString(), rows.schema[item].dataType.simpleString()
    slim = rows.select(key, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end), item)
    laid = in_order(slim, [start, F.desc(end), item], _Lanes, f"{key} {kind}, {item} {own}, {start} long, {end} long, lane long, cluster long")
    return laid.withColumn("width", F.max(F.col("lane") + 1).over(Window.partitionBy(key, "cluster"))).drop("cluster")


class _Cooldown(Fold):
    def __init__(self, pause: float):
        self.pause, self.last = pause, None

    def row(self, t, item):
        emitted = self.last is None or t - self.last >= self.pause
        self.last = t if emitted else self.last
        return [(item, t, emitted)]


def cooled_down(rows: DataFrame, key: str, item: str, seconds_col: str, pause: float) -> DataFrame:
    """key, item, seconds with emitted: false within `pause` seconds of the last emitted row of the key.

    A row that comes `pause` or more after the one before is always emitted, so stretches between such gaps are folded
    apart from each other.
    """
    kind, own, number = (rows.schema[c].dataType.simpleString() for c in (key, item, seconds_col))
    w = Window.partitionBy(key).orderBy(seconds_col, item)
    fresh = F.coalesce(F.col(seconds_col) - F.lag(seconds_col).over(w) >= pause, F.lit(True)).cast("long")
    cut = rows.select(key, item, seconds_col).withColumn("_fresh", fresh).withColumn("_part", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    slim = cut.select(F.struct(key, "_part").alias("_key"), seconds_col, item)
    folded = in_order(slim, [seconds_col, item], _Cooldown, f"_key struct<{key}:{kind},_part:bigint>, {item} {own}, {seconds_col} {number}, emitted boolean", pause)
    return folded.select(f"_key.{key}", item, seconds_col, "emitted")


class _Quietest(Fold):
    def __init__(self, target: int, slack: int):
        self.target, self.slack, self.start, self.number, self.last = target, slack, None, 0, None
        self.held: deque = deque()  # samples from the earliest place of the next cut on

    def row(self, ts, value):
        self.start = ts if self.start is None else self.start
        done = []
        while ts - self.start > self.target + self.slack:
            low, high = self.start + self.target - self.slack, self.start + self.target + self.slack
            inside = [(v, t) for t, v in self.held if low <= t <= high]
            cut = min(inside)[1] if inside else self.start + self.target
            done.append((self.number, self.start, cut))
            self.start, self.number = cut, self.number + 1
            while self.held and self.held[0][0] < cut + self.target - self.slack:
                self.held.popleft()
        if ts >= self.start + self.target - self.slack:
            self.held.append((ts, value))
        self.last = ts
        return done

    def end(self):
        return [(self.number, self.start, self.last)]


def adaptive_windows(samples: DataFrame, target_ms: int, slack_ms: int) -> DataFrame:
    """key, window, start_ms, end_ms: consecutive windows of about target_ms per key of samples (key, ts_ms, value), cut
    at the quietest sample within slack_ms of the target. The state is the samples of one such stretch."""
    rows = samples.select("key", F.col("ts_ms").cast("long").alias("ts_ms"), "value")
    return in_order(rows, ["ts_ms", "value"], _Quietest, "key long, window long, start_ms long, end_ms long", target_ms, slack_ms)


class _Blocks(Fold):
    def __init__(self, most: int, overlap: int):
        self.most, self.overlap, self.number, self.text = most, overlap, 0, ""

    def row(self, order, block, whole):
        done = []
        if self.text and whole > self.most and len(self.text.encode()) // 4 + len(block.encode()) // 4 + 1 > self.most:
            done = self.end()
            self.number += 1
            self.text = tail_at_header(self.text, self.overlap) + "\n"
        self.text = f"{self.text}\n{block}" if self.text else block
        return done

    def end(self):
        return [(self.number, self.text)] if self.text else []


def tail_at_header(chunk: str, least: int) -> str:
    """The shortest end of a chunk that begins at a turn's header and has `least` characters, else all from the first
    header on; without headers the last `least` characters."""
    starts, at = [], 0
    for line in chunk.split("\n"):
        if line.startswith("**") and "]:" in line:
            starts.append(at)
        at += len(line) + 1
    if not starts:
        return chunk[-least:] if least else ""
    return chunk[max((s for s in starts if len(chunk) - s >= least), default=starts[0]) :]


def block_chunks(blocks: DataFrame, key: str, order: str, text: str, most: int, overlap: int) -> DataFrame:
    """key, chunk, text: the turns of a transcript packed into chunks of about `most` tokens (a quarter of the bytes); a
    chunk begins with the end of the one before, from a turn's header on. A transcript within `most` is one chunk."""
    kind = blocks.schema[key].dataType.simpleString()
    size = F.floor((F.sum(F.octet_length(text) + 1).over(Window.partitionBy(key)) - 1) / 4)
    rows = blocks.select(key, F.col(order).cast("long").alias(order), text, size.cast("long").alias("whole"))
    return in_order(rows, [order, text], _Blocks, f"{key} {kind}, chunk long, text string", most, overlap)


class Spans:
    """Whole numbers covered by half-open spans; spans that meet are kept as one, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[float] = []

    def add(self, start: int, end: float) -> None:
        if end <= start:
            return
        a, b = bisect.bisect_left(self.ends, start), bisect.bisect_right(self.starts, end)
        if a < b:
            start, end = min(start, self.starts[a]), max(end, self.ends[b - 1])
        self.starts[a:b], self.ends[a:b] = [start], [end]

    def __contains__(self, at: int) -> bool:
        i = bisect.bisect_right(self.starts, at) - 1
        return i >= 0 and at < self.ends[i]


class _Untaken(Fold):
    def __init__(self):
        self.taken = Spans()

    def row(self, rank, item, kind, start, end):
        if kind and start is not None and start in self.taken:
            return []
        if start is not None:
            self.taken.add(start, math.inf if end is None else end)
        return [(item,)]


def without_overlaps(hits: DataFrame, key: str) -> DataFrame:
    """key, item of hits (rank, item, is_transcript, start, end) in rank order: a transcript's hit goes if it starts within
    the span of one taken before (an open end reaches on). The state is the spans taken of one call, joined where they meet."""
    kind, own = hits.schema[key].dataType.simpleString(), hits.schema["item"].dataType.simpleString()
    rows = hits.select(key, F.col("rank").cast("long").alias("rank"), "item", "is_transcript", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return in_order(rows, ["rank", "item"], _Untaken, f"{key} {kind}, item {own}")


class _Assembly(Fold):
    def __init__(self, budget: int, per_call: int):
        self.budget, self.per_call, self.total, self.place = budget, per_call, 0, 0
        self.texts: set[bytes] = set()
        self.calls: dict = {}
        self.spans: dict = {}

    def row(self, rank, passage_id, call, digest, spoken, start, end, tokens, scoped):
        outcome = "taken"
        if digest in self.texts or spoken and start is not None and start in self.spans.get(call, ()):
            outcome = "duplicate"
        elif not scoped and self.calls.get(call, 0) >= self.per_call:
            outcome = "call_full"
        elif self.total + tokens > self.budget:
            outcome = "over_budget"
        if outcome != "taken":
            return [(passage_id, outcome, None, self.total)]
        self.total, self.place = self.total + tokens, self.place + 1
        self.texts.add(digest)
        self.calls[call] = self.calls.get(call, 0) + 1
        if start is not None:
            self.spans.setdefault(call, Spans()).add(start, math.inf if end is None else end)
        return [(passage_id, "taken", self.place, self.total)]


def assembled(hits: DataFrame, key: str, budget: int = 5500, per_call: int = 3) -> DataFrame:
    """key, passage_id, outcome, place, total of hits (key, rank, passage_id, call_id, text, is_transcript, start, end,
    tokens, scoped) gone through once in rank order. A hit is taken, with its place from 1, unless it is a duplicate (its
    text was taken, or it is a transcript's and starts within a span taken of its call; an open end reaches on), its call
    has given per_call already (call_full; not for questions in the scope of a call) or it would exceed the budget
    (over_budget; a smaller one may still fit). total is the tokens taken so far. The state is what was taken.
    """
    kind = hits.schema[key].dataType.simpleString()
    long = lambda c: F.col(c).cast("long").alias(c)
    rows = hits.select(key, long("rank"), long("passage_id"), "call_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "is_transcript", long("start"), long("end"), long("tokens"), "scoped")
    return in_order(rows, ["rank", "passage_id"], _Assembly, f"{key} {kind}, passage_id long, outcome string, place long, total long", budget, per_call)


class _NearestKnown(Fold):
    """Events in order of time: 0 a known row starts, 1 an unknown one, 2 an unknown one ends, 3 a known one does."""

    def __init__(self, window: float):
        self.window = window
        self.active: list[tuple] = []  # (place, end, tag) of known rows, places and ends rising: the first is the best
        self.begun: list[tuple] = []  # (start, place, tag) since the oldest open unknown row began, places rising
        self.before = None  # (end, place, tag)
        self.open: dict = {}
        self.waiting: deque = deque()  # ended, and still without what comes after

    def row(self, time, kind, place, other, tag):
        if kind == 0:
            done = []
            while self.waiting:
                first = self.waiting[0]
                if first["end"] < time or time - first["end"] > self.window:
                    done.append(self.settled(self.waiting.popleft(), (time, place, tag)))
                else:
                    break
            i = bisect.bisect_left(self.active, (place,))
            if i == 0 or self.active[i - 1][1] < other:  # else an earlier place reaches as far
                j = i
                while j < len(self.active) and self.active[j][1] <= other:
                    j += 1
                self.active[i:j] = [(place, other, tag)]
            if self.open:
                while self.begun and self.begun[-1][1] > place:
                    self.begun.pop()
                self.begun.append((time, place, tag))
            return done
        if kind == 1:
            while self.active and self.active[0][1] < time:
                self.active.pop(0)
            self.open[place] = {"place": place, "end": other, "start": time, "own": tag, "met": self.active[0] if self.active else None, "before": self.before}
            return []
        if kind == 3:
            if self.before is None or time > self.before[0] or place < self.before[1]:
                self.before = (time, place, tag)
            return []
        row = self.open.pop(place)
        i = bisect.bisect_left(self.begun, (row["start"],))
        if i < len(self.begun) and (row["met"] is None or self.begun[i][1] < row["met"][0]):
            row["met"] = (self.begun[i][1], None, self.begun[i][2])
        if not self.open:
            self.begun.clear()
        if row["met"] is not None:
            return [(place, row["met"][2])]
        self.waiting.append(row)
        return []

    def settled(self, row, after):
        near = []
        if row["before"] is not None:
            near.append((row["start"] - row["before"][0], row["before"][1], row["before"][2]))
        if after is not None:
            near.append((after[0] - row["end"], after[1], after[2]))
        best = min((n for n in near if n[0] <= self.window), default=(0, 0, row["own"]))
        return (row["place"], best[2])

    def end(self):
        return [self.settled(row, None) for row in self.waiting]


def nearest_known_intervals(rows: DataFrame, key: str, place: str, start: str, end: str, tag: str, unknown: str, window: float) -> DataFrame:
    """key, place, resolved for the rows of the unknown tag: the tag of the known row of the key at the least distance, if
    within window, else their own. Rows that overlap or touch have the distance 0; of equals the first place counts.
    Known rows change nothing, and unknown ones don't lend each other. start is at most end.

    One pass over starts and ends; the state is the rows open at a time, and what ended within the window.
    """
    kind = rows.schema[key].dataType.simpleString()
    known = F.col(tag) != unknown
    event = lambda at, kind, other: F.struct(F.col(at).cast("double").alias("time"), kind.alias("kind"), F.col(place).cast("long").alias("place"), F.col(other).cast("double").alias("other"), F.col(tag).alias("tag"))
    both = F.array(event(start, F.when(known, 0).otherwise(1), end), event(end, F.when(known, 3).otherwise(2), start))
    events = rows.select(key, F.inline(both))
    return in_order(events, ["time", "kind", "place"], _NearestKnown, f"{key} {kind}, {place} long, resolved string", window)


def first_distinct(rows: DataFrame, key: str, item: str, order: str, n: int) -> DataFrame:
    """key, item, place: the n distinct items of each key that come first by order (and then by item).

    Each task keeps one row for an item, so a hot key sorts its items and not its rows.
    """
    first = rows.groupBy(key, item).agg(F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_first", item))
    return first.select(key, item, place.alias("place")).where(F.col("place") <= n)


def with_priority(fragments: DataFrame, extras: DataFrame, key: str, budget: int) -> DataFrame:
    """key, place, item, tokens: the ranked fragments (place, item, tokens) that fit a budget beside the extras, and these
    after them. The lowest ranked give way first, all at once."""
    need = extras.groupBy(key).agg(F.sum("tokens").alias("_need"))
    running = F.sum("tokens").over(Window.partitionBy(key).orderBy("place", "item").rowsBetween(Window.unboundedPreceding, 0))
    kept = fragments.withColumn("_run", running).join(need, key, "left").where(F.col("_need").isNull() | (F.col("_run") + F.col("_need") <= budget))
    added = extras.select(key, (F.col("place") + (1 << 40)).alias("place"), "item", "tokens")
    both = kept.select(key, F.col("place").cast("long").alias("place"), "item", "tokens").unionByName(added)
    return both.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("place", "item")).cast("long"))
