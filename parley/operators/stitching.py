"""Chunks of a recording put together: one timeline, one set of speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components, stored
from .search import cosine

OWNER, UNKNOWN = "owner", "speaker:unknown"


def before_cutoff(start_ms: Column, cutoff_ms: Column) -> Column:
    """A chunk counts if it starts before the cutoff, or there is none; starts before zero count as zero."""
    return cutoff_ms.isNull() | (F.greatest(start_ms, F.lit(0)) < cutoff_ms)


def clipped(segments: DataFrame, cutoff_sec: str) -> DataFrame:
    """segments (start_sec, end_sec) that start before the cutoff, ended by it; a null cutoff clips nothing."""
    cut = F.col(cutoff_sec)
    return segments.where(cut.isNull() | (F.col("start_sec") < cut)).withColumn("end_sec", F.least("end_sec", F.coalesce(cut, F.col("end_sec"))))


def clamped_duration(duration: Column, cutoff_sec: Column) -> Column:
    return F.least(duration, F.coalesce(cutoff_sec, duration))


def global_tags(points: DataFrame, least: float) -> DataFrame:
    """call_id, chunk_idx, tag, global_tag of points (call_id, chunk_idx, tag, vec), a voice of each chunk.

    Voices of a call whose cosine is at least `least` are one speaker, however linked; speakers are numbered in the order
    in which they appear. The owner, the unknown and voices without a vector keep their tag. A call has few voices, so
    they meet in pairs within the call.
    """
    order = Window.partitionBy("call_id").orderBy("chunk_idx", "tag")
    own = stored(points.withColumn("_n", F.row_number().over(order)).withColumn("_fit", ~F.col("tag").isin(OWNER, UNKNOWN) & (F.size("vec") > 1)).withColumn("_id", F.monotonically_increasing_id()), "voices")
    fit = own.where("_fit").select("call_id", F.col("_id").alias("a"), "vec")
    met = fit.join(fit.select("call_id", F.col("a").alias("b"), F.col("vec").alias("other")), "call_id").where("a < b").where(cosine(F.col("vec"), F.col("other")) >= least)
    joined = own.where("_fit").join(components(met.select("a", "b")), F.col("_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "_id"))
    first = joined.groupBy("call_id", "root").agg(F.min("_n").alias("_first"))
    place = first.withColumn("global_tag", F.concat(F.lit("speaker:"), (F.row_number().over(Window.partitionBy("call_id").orderBy("_first")) - 1).cast("string")))
    named = joined.join(place.select("call_id", "root", "global_tag"), ["call_id", "root"]).select("call_id", "chunk_idx", "tag", "global_tag")
    return named.unionByName(own.where("not _fit").select("call_id", "chunk_idx", "tag", F.col("tag").alias("global_tag")))


def stitched(segments: DataFrame, chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """call_id, chunk_idx, speaker_tag, start_sec, end_sec of segments (call_id, chunk_idx, tag, start_sec, end_sec within
    the chunk) of finished chunks (call_id, chunk_idx, status, start_ms, cutoff_ms), on the timeline of the call."""
    done = chunks.where((F.col("status") == "done") & (F.col("start_ms") >= 0)).where(before_cutoff(F.col("start_ms"), F.col("cutoff_ms")))
    moved = segments.join(done.select("call_id", "chunk_idx", "start_ms", (F.col("cutoff_ms") / 1000).alias("cutoff_sec")), ["call_id", "chunk_idx"])
    moved = moved.withColumns({c: F.col(c) + F.col("start_ms") / 1000 for c in ("start_sec", "end_sec")})
    named = clipped(moved, "cutoff_sec").join(tags, ["call_id", "chunk_idx", "tag"], "left")
    return named.select("call_id", "chunk_idx", F.coalesce("global_tag", "tag").alias("speaker_tag"), "start_sec", "end_sec")


def relabelled(segments: DataFrame, owners: DataFrame) -> DataFrame:
    """segments with the tag of each call's owner (call_id, owner_tag) as `owner`; calls without one stay as they are."""
    joined = segments.join(owners, "call_id", "left")
    return joined.withColumn("speaker_tag", F.when(F.col("speaker_tag") == F.col("owner_tag"), OWNER).otherwise(F.col("speaker_tag"))).drop("owner_tag")
