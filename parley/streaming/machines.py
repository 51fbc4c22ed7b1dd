"""State machines over level samples, for streams and, with the same rules, for stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.folds import Fold, in_order

SIGNALS = "key long, ts_ms long, signal string, trim_ms long"


@dataclass(frozen=True)
class SilenceRules:
    """Silence starts below `quiet`; voice must last voice_ms to end it. After suggest_ms a signal, once; after stop_ms
    the end of the session, to be trimmed to tail_ms after the start of the silence."""

    quiet: float = 20.0
    voice_ms: int = 2 * 3_600_000
    suggest_ms: int = 6 * 3_600_000
    stop_ms: int = 24 * 3_600_000
    tail_ms: int = 5_000


#: (start of the silence or -1, start of the voice or -1, suggested, stopped)
START = (-1, -1, False, False)


def step(state: tuple, ts: int, value: float, rules: SilenceRules) -> tuple[tuple, list[tuple[str, int]]]:
    """The state after a sample, and the signals that it gives."""
    silence, voice, suggested, stopped = state
    if stopped:
        return state, []
    if value >= rules.quiet:
        voice = ts if voice < 0 else voice
        if silence >= 0 and ts - voice >= rules.voice_ms:
            return (-1, voice, False, False), [("voice", ts)]
        if silence < 0:
            return (-1, voice, False, False), []
    else:
        voice = -1
        silence = ts if silence < 0 else silence
    out = []
    if not suggested and ts - silence >= rules.suggest_ms:
        suggested = True
        out.append(("suggest", ts))
    if ts - silence >= rules.stop_ms:
        stopped = True
        out.append(("stop", min(silence + rules.tail_ms, ts)))
    return (silence, voice, suggested, stopped), out


def _run(key, samples: pd.DataFrame, state: tuple, rules: SilenceRules) -> tuple[tuple, pd.DataFrame]:
    out = []
    for ts, value in samples.sort_values(["ts_ms", "value"])[["ts_ms", "value"]].itertuples(index=False):
        state, signals = step(state, int(ts), float(value), rules)
        out += [(key, int(ts), name, int(trim)) for name, trim in signals]
    return state, pd.DataFrame(out, columns=["key", "ts_ms", "signal", "trim_ms"])


class _Silence(Fold):
    def __init__(self, rules: SilenceRules):
        self.rules, self.state = rules, START

    def row(self, ts, value):
        self.state, signals = step(self.state, ts, value, self.rules)
        return [(ts, name, int(trim)) for name, trim in signals]


def silence_signals(samples: DataFrame, rules: SilenceRules = SilenceRules()) -> DataFrame:
    """Signals of stored samples (key, ts_ms, value); each key is one session, of any length."""
    rows = samples.select(F.col("key").cast("long").alias("key"), F.col("ts_ms").cast("long").alias("ts_ms"), F.col("value").cast("double").alias("value"))
    return in_order(rows, ["ts_ms", "value"], _Silence, SIGNALS, rules)


def silence_signals_stream(samples: DataFrame, rules: SilenceRules = SilenceRules()) -> DataFrame:
    """The same for a stream. Samples of a key are ordered within a batch; the source gives batches in order."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else START
        now, out = _run(int(key[0]), pd.concat(batches), tuple(now), rules)
        state.update(now)
        yield out

    schema = "silence long, voice long, suggested boolean, stopped boolean"
    return samples.groupBy("key").applyInPandasWithState(update, SIGNALS, schema, "append", GroupStateTimeout.NoTimeout)


def level_stream(spark: SparkSession, folder: str, schema, files: str = "*.parquet") -> DataFrame:
    """A stream of samples (key, ts_ms, value, ts) from the Parquet files of events in a folder."""
    events = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    return samples_of(events)


def samples_of(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.select(F.col("user_id").alias("key"), F.unix_millis(ts).alias("ts_ms"), "value", ts.alias("ts"), "event_type")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that its source has and returns what it wrote to the shared folder."""
    spark, path = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}.state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def hourly(samples: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and means per hour and kind; with a watermark when the samples are a stream."""
    rows = samples.withWatermark("ts", late) if samples.isStreaming else samples
    return rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")
