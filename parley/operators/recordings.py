"""The life of recordings and of the search index, and the small rules of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reconciled(calls: DataFrame, heard: DataFrame, least_sec: int = 30) -> DataFrame:
    """call_id, status, reason after a crash: calls still recording fail as interrupted if heard (call_id, mic_sec) has
    least_sec of them, else they go; others stay."""
    joined = calls.join(heard, "call_id", "left")
    open_ = F.col("status") == "recording"
    kept = joined.where(~open_ | (F.coalesce("mic_sec", F.lit(0)) >= least_sec))
    return kept.select("call_id", F.when(open_, "failed").otherwise(F.col("status")).alias("status"), F.when(open_, "interrupted").alias("reason"))


def finished(events: DataFrame, errors: list[str]) -> DataFrame:
    """call_id, status, error: ready without an error, else failed by the first of the error columns that is set."""
    error = F.coalesce(*errors)
    return events.select("call_id", F.when(error.isNull(), "ready").otherwise("failed").alias("status"), error.alias("error"))


def held(samples: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """samples with held: the samples of the key within the last `seconds`, those of the same moment too."""
    at = F.unix_micros(time)
    window = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return samples.withColumn("held", F.count(F.lit(1)).over(window))


def current(index: DataFrame, model: str) -> DataFrame:
    """The rows of the index that the present model made."""
    return index.where(F.col("model") == model)


def backfilled(index: DataFrame, passages: DataFrame, model: str) -> DataFrame:
    """passage_id, model, added: the index and a row for each passage that it lacks."""
    missing = passages.join(index.select("passage_id"), "passage_id", "left_anti")
    return index.select("passage_id", "model", "added").unionByName(missing.select("passage_id", F.lit(model).alias("model"), F.lit(True).alias("added")))


def deindexed(index: DataFrame, passages: DataFrame, call: str) -> DataFrame:
    return index.join(passages.where(F.col("call_id") == call).select("passage_id"), "passage_id", "left_anti")


def can_reprocess(status: Column, busy: Column) -> Column:
    return ~busy & status.isin("ready", "failed")


def should_finish(attempts: Column, failures: Column) -> Column:
    """No attempts, or fewer failures than attempts."""
    return (attempts == 0) | (failures < attempts)


def is_tap(elapsed_ms: Column, paused_ms: Column) -> Column:
    """A recording of less than 30 seconds, pauses left out."""
    return elapsed_ms - paused_ms < 30_000


def message_time(ts: Column, today: Column, yesterday: str = "yesterday") -> Column:
    """The time of a message of today, a word for yesterday, else the date."""
    days = F.date_diff(F.to_date(today), F.to_date(ts))
    return F.when(days == 0, F.date_format(ts, "HH:mm")).when(days == 1, yesterday).otherwise(F.date_format(ts, "dd.MM.yyyy"))


def fragment_clock(ms: Column) -> Column:
    """m:ss of milliseconds, never before 0:00."""
    from ..functions.times import clock

    return clock(F.floor(F.greatest(ms, F.lit(0)) / 1000))


def small_size(size: Column) -> Column:
    """KB below a megabyte, else MB, with one decimal."""
    mb = 1 << 20
    return F.when(size < mb, F.concat(F.format_string("%.1f", F.round(size / 1024.0, 1)), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", F.round(size / float(mb), 1)), F.lit(" MB")))


def facet_count(lists: list[Column], since: Column, until: Column) -> Column:
    """Chosen values of all facets, and one for a range."""
    out = (since.isNotNull() | until.isNotNull()).cast("int")
    for x in lists:
        out = out + F.size(x)
    return out
