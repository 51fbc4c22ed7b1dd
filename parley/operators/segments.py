"""Ordered operators over transcript segments and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(rows: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """Runs of equal `value` in order within key: key, island, value, first, last (of start and end), n."""
    w = Window.partitionBy(key).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    numbered = rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island", value).agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.count(F.lit(1)).alias("n"))


def without_repeats(rows: DataFrame, key: str, order: list, by: list) -> DataFrame:
    """Each run of neighbours that agree in all columns of `by` as its first row, its end being the latest of the run."""
    w = Window.partitionBy(key).orderBy(*order)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = rows.withColumn("_new", (~(same & (F.row_number().over(w) > 1))).cast("long")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    latest = F.max("end_sec").over(Window.partitionBy(key, "_run"))
    return marked.withColumn("end_sec", latest).where("_new = 1").drop("_new", "_run")


def loop_phrases(rows: DataFrame, key: str, phrase: Column, least_words: int = 5, least_times: int = 4) -> DataFrame:
    """key, phrase, n of long phrases that a key repeats often: loops of a speech recogniser."""
    p = rows.select(key, phrase.alias("phrase")).where(F.size(F.split("phrase", " ")) >= least_words)
    return p.groupBy(key, "phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_times)


def covering(points: DataFrame, spans: DataFrame, key: str, width: int) -> DataFrame:
    """Points (key, point_id, start, end) with the tag of the span (key, tag, start, end) that holds their centre,
    else of the one that overlaps them most (the later of equals), else 'unknown'.

    Both sides meet by slices of `width`, which the spans and points touch; a pair counts once however many they share.
    """
    slices = lambda df: df.withColumn("slice", F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long"))))
    p = slices(points.select(key, "point_id", "start", "end"))
    s = slices(spans.select(key, F.col("tag"), F.col("start"), F.col("end"))).select(key, "slice", "tag", F.col("start").alias("s0"), F.col("end").alias("s1"))
    centre = (F.col("start") + F.col("end")) / 2
    met = p.join(s, [key, "slice"]).where((F.col("s0") <= F.col("end")) & (F.col("s1") >= F.col("start")))
    inside = (F.col("s0") <= centre) & (centre <= F.col("s1"))
    shared = F.greatest(F.lit(0), F.least("end", "s1") - F.greatest("start", "s0"))
    # Rank: a span around the centre, the first of those; else the largest overlap, the last of those.
    order = F.struct(inside.cast("int").alias("a"), F.when(inside, -F.col("s0")).otherwise(shared).alias("b"), F.when(inside, -F.col("s1")).otherwise(F.col("s0")).alias("c"), "tag")
    best = met.where(inside | (shared > 0)).groupBy(key, "point_id").agg(F.max_by("tag", order).alias("tag"))
    return points.select(key, "point_id").join(best, [key, "point_id"], "left").withColumn("tag", F.coalesce("tag", F.lit("unknown")))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the value of the latest row of right at or before its time, per key; null if there is none.

    Both sides are sorted together once; no pairs are formed.
    """
    order = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(key, time, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(order))
    return both.where("_side = 1").drop("_side", "_v")


def nearest_known(rows: DataFrame, key: str, time: str, tag: str, unknown: str, window: float) -> DataFrame:
    """rows with `tag` of unknown ones replaced by that of the nearest known row within window, the earlier of equals.

    The nearest known row before and after come from one sort each, not from pairs.
    """
    w = Window.partitionBy(key).orderBy(time, "event_id")
    known = F.when(F.col(tag) != unknown, F.struct(F.col(time).alias("t"), F.col(tag).alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    seconds = lambda x: F.abs(F.unix_micros(x) - F.unix_micros(F.col(time))) / 1e6
    marked = rows.withColumn("_b", before).withColumn("_a", after)
    far = F.lit(float("inf"))
    db, da = F.coalesce(seconds(F.col("_b.t")), far), F.coalesce(seconds(F.col("_a.t")), far)
    found = F.when((db <= da) & (db <= window), F.col("_b.v")).when(da <= window, F.col("_a.v"))
    return marked.withColumn("resolved", F.when(F.col(tag) == unknown, F.coalesce(found, F.col(tag))).otherwise(F.col(tag))).drop("_a", "_b")


def running_offsets(rows: DataFrame, key: str, order: list, length: str) -> DataFrame:
    """rows with the start of each: the sum of the lengths before it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def silence_cuts(levels: DataFrame, key: str, threshold: float, least: int) -> DataFrame:
    """Per key the longest run of at least `least` samples below threshold (the earliest of equals): its middle, else
    the quietest sample. levels: key, ts, event_id, value."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    quiet = (F.col("value") < threshold).cast("int")
    marked = levels.withColumn("quiet", quiet).withColumn("run", F.sum((F.col("quiet") != F.coalesce(F.lag("quiet").over(w), F.lit(-1))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.where("quiet = 1").groupBy(key, "run").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).where(F.col("n") >= least)
    best = runs.groupBy(key).agg(F.max_by(F.struct("a", "b", "n"), F.struct("n", -F.unix_micros("a"))).alias("r"))
    least_ = levels.groupBy(key).agg(F.min_by("ts", F.struct("value", "ts")).alias("quietest"))
    middle = F.timestamp_micros(F.floor((F.unix_micros("r.a") + F.unix_micros("r.b")) / 2).cast("long"))
    return least_.join(best, key, "left").select(key, F.coalesce(middle, F.col("quietest")).alias("cut"), F.coalesce("r.n", F.lit(0)).alias("n"))
