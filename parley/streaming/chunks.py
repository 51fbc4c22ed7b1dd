"""The life of a recording chunk: compare-and-set transitions, retries and recovery, as new table versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Transition: the states it may start from and the one it ends in.
TRANSITIONS = {"process": (("pending",), "processing"), "done": (("processing",), "done"), "fail": (("pending", "processing", "failed"), "failed"), "retry": (("failed",), "pending")}


def applied(chunks: DataFrame, events: DataFrame) -> DataFrame:
    """chunks (call_id, chunk_idx, status) after one event each (call_id, chunk_idx, event) at most, with accepted: an
    event that the state doesn't allow changes nothing."""
    joined = chunks.join(events, ["call_id", "chunk_idx"], "left")
    allowed, target = F.lit(False), F.col("status")
    for name, (sources, to) in TRANSITIONS.items():
        hit = (F.col("event") == name) & F.col("status").isin(*sources)
        allowed, target = allowed | hit, F.when(hit, to).otherwise(target)
    return joined.select("call_id", "chunk_idx", target.alias("status"), F.when(F.col("event").isNotNull(), allowed).alias("accepted"))


def recovered(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks that only exist as files become pending rows; finished ones stay; others are pending again."""
    known = chunks.withColumn("status", F.when(F.col("status") == "done", "done").otherwise("pending"))
    missing = files.join(chunks.select("call_id", "chunk_idx").hint("merge"), ["call_id", "chunk_idx"], "left_anti")
    return known.unionByName(missing.select("call_id", "chunk_idx", F.lit("pending").alias("status")))


def plan(chunks: DataFrame, finals: DataFrame) -> DataFrame:
    """What to do with the last chunk of each call (finals: call_id, chunk_idx) when its recording stops: run (no row yet,
    or pending), rerun (failed: it is pending again first) or skip (processing or done: someone has taken it)."""
    known = chunks.select("call_id", "chunk_idx", "status")
    action = F.when(F.col("status").isNull() | (F.col("status") == "pending"), "run").when(F.col("status") == "failed", "rerun").otherwise("skip")
    return finals.select("call_id", "chunk_idx").join(known, ["call_id", "chunk_idx"], "left").select("call_id", "chunk_idx", action.alias("action"))


def parked_plan(calls: DataFrame, most: int = 5, most_tries: int = 2) -> DataFrame:
    """What to do with parked calls (event, place, call_id, has_transcript, has_audio, tries) in their order at an event:
    reprocess (there is a transcript) or recover, for the first `most` that have audio and tries left; after these stop;
    before, no_audio or tries_exhausted.

    Only the first calls of an event that can start are ranked; the others are held against the last of these.
    """
    able = F.col("has_audio") & (F.col("tries") < most_tries)
    rank = F.row_number().over(Window.partitionBy("event").orderBy("place", "call_id"))
    last = calls.where(able).select("event", "place", "call_id").withColumn("rank", rank).where(F.col("rank") <= most).where(F.col("rank") == most)
    last = last.select("event", F.struct("place", "call_id").alias("last"))
    behind = F.coalesce(F.struct("place", "call_id") > F.col("last"), F.lit(False))
    action = F.when(behind, "stop").when(~F.col("has_audio"), "no_audio").when(F.col("tries") >= most_tries, "tries_exhausted").when(F.col("has_transcript"), "reprocess").otherwise("recover")
    return calls.join(last, "event", "left").select("event", "call_id", action.alias("action"))
