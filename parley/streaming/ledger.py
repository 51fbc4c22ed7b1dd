"""Tables that a stream changes batch by batch, each batch once, and backfills that go on until nothing is missing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexical import Index, changed_index
from .chunks import TRANSITIONS


class VersionedTable:
    """Versions of a table under a folder, one for each batch that changed it; the folder itself is the ledger.

    A version counts once its files are complete. A batch that comes again finds its version there and changes nothing;
    one that died half-way is written anew from the version before it.
    """

    def __init__(self, spark: SparkSession, folder: str, kept: int = 2):
        self.spark, self.folder, self.kept = spark, folder.rstrip("/"), kept

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """The numbers of the complete versions, rising."""
        files, path = self._files()
        if not files.exists(path):
            return []
        done = [s.getPath() for s in files.listStatus(path)]
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()[1:]) for p in done if p.getName()[:1] == "v" and p.getName()[1:].isdigit() and files.exists(make(p, "_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame | None:
        found = self.versions()
        if not found:
            return None
        return self.spark.read.parquet(f"{self.folder}/v{found[-1] if version is None else version}")

    def apply(self, batch: int, change: Callable[[DataFrame | None], DataFrame]) -> bool:
        """Writes change(the version before) as the version of a batch, unless it is there; batches come in order."""
        found = self.versions()
        if found and found[-1] >= batch:
            return False
        change(self.read()).write.mode("overwrite").parquet(f"{self.folder}/v{batch}")
        files, _ = self._files()
        for old in found[: -self.kept + 1] if self.kept > 1 else found:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v{old}"), True)
        return True


#: States by number; then a status that no table has (null or empty: it counts as pending) and one that allows nothing.
STATES = ("pending", "processing", "done", "failed")
_NO_STATUS, _OTHER = len(STATES), len(STATES) + 1
#: Codes of rows: events by number, an unknown one, then statuses.
_EVENTS = (*TRANSITIONS, None)
_FIRST_STATUS = len(_EVENTS)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The state after each code in each state, and whether an event was accepted."""
    after = np.empty((_FIRST_STATUS + _OTHER + 1, _OTHER + 1), dtype=np.int8)
    accepted = np.zeros(after.shape, dtype=np.int64)
    for code, name in enumerate(_EVENTS):
        sources, target = TRANSITIONS.get(name, ((), None))
        for state in range(_OTHER + 1):
            own = 0 if state == _NO_STATUS else state
            good = own < len(STATES) and STATES[own] in sources
            after[code, state], accepted[code, state] = (STATES.index(target), 1) if good else (own, 0)
    for state in range(_OTHER + 1):
        after[_FIRST_STATUS + state] = state
    return after, accepted


_AFTER, _ACCEPTED = _tables()
_FOLDED = "call_id long, chunk_idx long, status string, accepted long, refused long"


def _folded(batches):
    """Rows (call_id, chunk_idx, code, told) sorted by chunk and order, folded a batch at a time.

    An event is a function of states, so the state before each row comes from composing those of its chunk; between
    batches only the last chunk's state is carried.
    """
    held = None  # (call_id, chunk_idx), state, accepted, refused, told
    row = lambda key, state, good, bad, told: (*key, STATES[state] if state < len(STATES) else told, good, bad)
    kind = pa.schema([("call_id", pa.int64()), ("chunk_idx", pa.int64()), ("status", pa.string()), ("accepted", pa.int64()), ("refused", pa.int64())])
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, dtype=bool)
        for name in ("call_id", "chunk_idx"):
            column = batch.column(name)
            for values in (column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)):
                new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new | (np.arange(n) == 0))
        lengths = np.diff(np.append(starts, n))
        at = np.arange(n) - np.repeat(starts, lengths)
        key_of = lambda i: (batch.column("call_id")[int(i)].as_py(), batch.column("chunk_idx")[int(i)].as_py())
        out = []
        begin = np.full(len(starts), _NO_STATUS)
        carried = held is not None and held[0] == key_of(0)
        if carried:
            begin[0] = held[1]
        elif held is not None:
            out.append(row(*held))
        code = batch.column("code").to_numpy(zero_copy_only=False)
        whole, step = _AFTER[code], 1
        while step < lengths.max():
            later = np.flatnonzero(at >= step)
            whole[later] = np.take_along_axis(whole[later], whole[later - step].astype(np.int64), 1)
            step *= 2
        state = np.repeat(begin, lengths)
        after = np.take_along_axis(whole, state[:, None], 1)[:, 0].astype(np.int64)
        before = np.where(at > 0, np.append(0, after[:-1]), state)
        accepted, event = _ACCEPTED[code, before], code < _FIRST_STATUS
        good, bad = np.add.reduceat(accepted, starts), np.add.reduceat(event - accepted, starts)
        ends = starts + lengths - 1
        # The last status row of each chunk in this batch, for statuses that have no number.
        last = np.maximum.accumulate(np.where(event, -1, np.arange(n)))[ends]
        told = batch.column("told")
        text = [told[int(i)].as_py() if i >= s else None for i, s in zip(last, starts, strict=True)] if told.null_count < n else [None] * len(starts)
        if carried:
            good[0], bad[0] = good[0] + held[2], bad[0] + held[3]
            text[0] = text[0] if last[0] >= starts[0] else held[4]
        if len(out):
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in out], schema=kind)
        held = key_of(ends[-1]), int(after[-1]), int(good[-1]), int(bad[-1]), text[-1]
        if len(starts) > 1:
            first, final = pa.array(starts[:-1]), after[ends[:-1]]
            names = pa.array([*STATES, None, None]).take(pa.array(final))
            status = pc.if_else(pa.array(final < len(STATES)), names, pa.array(text[:-1], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("call_id").take(first), batch.column("chunk_idx").take(first), status, pa.array(good[:-1]), pa.array(bad[:-1])], schema=kind)
    if held is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, row(*held), strict=True))], schema=kind)


def transitions(chunks: DataFrame, events: DataFrame) -> DataFrame:
    """call_id, chunk_idx, status, accepted, refused: chunks (call_id, chunk_idx, status) after any number of events each
    (call_id, chunk_idx, order, event), in order; an event that the state doesn't allow changes nothing and is counted.
    A chunk that no table has begins as pending."""
    long = lambda c: F.col(c).cast("long").alias(c)
    number = lambda c, names, other: F.coalesce(*(F.when(F.col(c) == x, F.lit(i)) for i, x in enumerate(names)), other)
    state = number("status", STATES, F.when(F.coalesce("status", F.lit("")) == "", F.lit(_NO_STATUS)).otherwise(F.lit(_OTHER)))
    none = F.lit(None).cast("string")
    own = chunks.select(long("call_id"), long("chunk_idx"), F.lit(None).cast("long").alias("order"), none.alias("event"), (state + _FIRST_STATUS).alias("code"), F.when(state >= _NO_STATUS, F.col("status")).alias("told"))
    said = events.where("event is not null").select(long("call_id"), long("chunk_idx"), long("order"), "event", number("event", TRANSITIONS, F.lit(_FIRST_STATUS - 1)).alias("code"), none.alias("told"))
    keys = ["call_id", "chunk_idx"]
    rows = own.unionByName(said).repartition(*keys).sortWithinPartitions(*keys, "order", "event")
    return rows.select(*keys, "code", "told").mapInArrow(_folded, _FOLDED)


def follow_events(events: DataFrame, table: VersionedTable, checkpoint: str, **trigger):
    """Starts a stream of events (as for transitions()) into a table of chunks, each micro-batch once."""

    def write(batch: DataFrame, number: int) -> None:
        none = "call_id long, chunk_idx long, status string"

        def change(before):
            known = before if before is not None else batch.sparkSession.createDataFrame([], none)
            return transitions(known, batch).select("call_id", "chunk_idx", "status")

        table.apply(number, change)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def backfill(index: Index, passages: DataFrame, per_round: int = 100_000, most_rounds: int | None = None) -> int:
    """Adds passages (passage_id, text, ...) that the index hasn't got, per_round at a time, until none is missing; the
    number of rounds. A round that was interrupted left no generation, so its passages are still missing."""
    rounds = 0
    while most_rounds is None or rounds < most_rounds:
        missing = passages.join(index.lengths().select("passage_id"), "passage_id", "left_anti").orderBy("passage_id").limit(per_round)  # a round's size
        if missing.isEmpty():
            break
        changed_index(index, missing)
        rounds += 1
    return rounds
