"""Transcript segments, intervals and ordered logic."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import squeezed
from ..operators import folds, segments as G
from ..sources.tables import FAILURES, PASSAGES, TURNS, failures, passages, sql, turns
from .base import query

_ISLANDS = "isl AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn, speaker, text) AS island FROM (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, speaker, text)))"


@query(sql("SELECT conv_id, island::BIGINT AS island, speaker, min(start_sec)::BIGINT AS start_sec, max(end_sec) AS end_sec, count(*) AS n FROM isl GROUP BY ALL", TURNS, _ISLANDS))
def speaker_islands(spark, sf):
    return G.islands(turns(spark, sf), "conv_id", ["turn", "speaker", "text"], "speaker")


@query(sql("""SELECT conv_id, turn, speaker, end_sec FROM (SELECT *, max(end_sec) OVER (PARTITION BY conv_id, run) AS latest FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS run FROM (
 SELECT *, CASE WHEN norm = lag(norm) OVER w AND speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS new FROM (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM turns) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)))) WHERE new = 1""", TURNS).replace("speaker, end_sec FROM", "speaker, latest AS end_sec FROM"))
def repeats_collapsed(spark, sf):
    """Neighbouring turns of one speaker with the same whole text (normalised) become one."""
    t = turns(spark, sf).withColumn("norm", squeezed(F.col("text")))
    return G.without_repeats(t, "conv_id", ["turn", "text"], ["speaker", "norm"]).select("conv_id", "turn", "speaker", "end_sec")


@query(sql("SELECT call_id, phrase, count(*) AS n FROM (SELECT call_id, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '\\s+', ' ', 'g')) AS phrase FROM passages) WHERE len(string_split(phrase, ' ')) >= 5 GROUP BY ALL HAVING count(*) >= 4", PASSAGES))
def loop_phrases(spark, sf):
    lines = passages(spark, sf).select("call_id", F.explode(F.split("text", "\n")).alias("line"))
    return G.loop_phrases(lines, "call_id", squeezed(F.col("line")))


@query(sql("SELECT conv_id, side, turn, row_number() OVER (PARTITION BY conv_id ORDER BY start_sec, side, turn, text) AS place FROM (SELECT 0 AS side, * FROM turns WHERE speaker = 'user' UNION ALL SELECT 1, * FROM turns WHERE speaker <> 'user')", TURNS))
def stable_merge(spark, sf):
    """Two tracks in one order: by start, the first track before the second."""
    t = turns(spark, sf)
    both = t.where("speaker = 'user'").withColumn("side", F.lit(0)).unionByName(t.where("speaker <> 'user'").withColumn("side", F.lit(1)))
    w = Window.partitionBy("conv_id").orderBy("start_sec", "side", "turn", "text")
    return both.select("conv_id", "side", "turn", F.row_number().over(w).cast("long").alias("place"))


_SPANS = "sp AS (SELECT user_id, event_id, kind AS tag, epoch_us(ts) AS s0, epoch_us(ts) + (value * 6e7)::BIGINT AS s1 FROM failures WHERE kind <> 'error')"
_POINTS = "pt AS (SELECT user_id, event_id AS point_id, epoch_us(ts) AS p0, epoch_us(ts) + 60000000 AS p1 FROM failures WHERE kind = 'error')"


@query(sql("""SELECT user_id, point_id, coalesce(arg_max(tag, (inside::INT, CASE WHEN inside THEN -s0 ELSE shared END, CASE WHEN inside THEN -s1 ELSE s0 END, tag)) FILTER (inside OR shared > 0), 'unknown') AS tag
 FROM (SELECT pt.user_id, point_id, tag, s0, s1, s0 <= (p0 + p1) / 2 AND (p0 + p1) / 2 <= s1 AS inside, greatest(0, least(p1, s1) - greatest(p0, s0)) AS shared
  FROM pt LEFT JOIN sp ON sp.user_id = pt.user_id AND s0 <= p1 AND s1 >= p0) GROUP BY ALL""", FAILURES, _SPANS, _POINTS))
def interval_join(spark, sf):
    """Error minutes with the kind of the span they fall into."""
    f = failures(spark, sf)
    at = F.unix_micros("ts")
    spans = f.where("kind <> 'error'").select("user_id", F.col("kind").alias("tag"), at.alias("start"), (at + F.round(F.col("value") * 6e7).cast("long")).alias("end"))
    points = f.where("kind = 'error'").select("user_id", F.col("event_id").alias("point_id"), at.alias("start"), (at + 60_000_000).alias("end"))
    return G.covering(points, spans, "user_id", 3_600_000_000)


@query(sql("SELECT e.event_id, e.user_id, k.kind AS state FROM (SELECT * FROM failures WHERE kind = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(kind) AS kind FROM failures WHERE kind <> 'error' GROUP BY ALL) k ON e.user_id = k.user_id AND e.ts >= k.ts", FAILURES))
def active_at_time(spark, sf):
    f = failures(spark, sf)
    states = f.where("kind <> 'error'").groupBy("user_id", "ts").agg(F.max("kind").alias("state"))
    return G.as_of(f.where("kind = 'error'").select("event_id", "user_id", "ts"), states, "user_id", "ts", "state").select("event_id", "user_id", "state")


_NEAR = """near AS (SELECT *, last_value(CASE WHEN kind <> 'error' THEN {'t': ts, 'v': kind} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
 first_value(CASE WHEN kind <> 'error' THEN {'t': ts, 'v': kind} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM failures)"""


@query(sql("""SELECT event_id, CASE WHEN kind <> 'error' THEN kind WHEN db <= da AND db <= 3600 THEN b.v WHEN da <= 3600 THEN a.v ELSE kind END AS resolved
 FROM (SELECT *, coalesce(abs(epoch_us(b.t) - epoch_us(ts)) / 1e6, 1e300) AS db, coalesce(abs(epoch_us(a.t) - epoch_us(ts)) / 1e6, 1e300) AS da FROM near)""", FAILURES, _NEAR))
def nearest_known_tag(spark, sf):
    return G.nearest_known(failures(spark, sf), "user_id", "ts", "kind", "error", 3600).select("event_id", "resolved")


_SPANS = "spans AS (SELECT user_id, event_id, kind, floor(epoch_us(ts) / 1000000)::BIGINT AS a, floor(epoch_us(ts) / 1000000)::BIGINT + CASE event_id % 7 WHEN 0 THEN 40000 ELSE (event_id % 5) * 1800 END AS b FROM failures)"


@query(sql("""SELECT u.user_id, u.event_id, coalesce(first(k.kind ORDER BY d, k.event_id) FILTER (d <= 20000), u.kind) AS resolved FROM (SELECT u, k, greatest(0, u.a - k.b, k.a - u.b) AS d FROM spans u LEFT JOIN spans k ON u.user_id = k.user_id AND k.kind <> 'error' WHERE u.kind = 'error') GROUP BY u.user_id, u.event_id, u.kind""", FAILURES, _SPANS))
def nearest_known_spans(spark, sf):
    """Errors as stretches of time, and the kind of the nearest other stretch; nested and overlapping ones are at hand."""
    start = F.unix_seconds("ts")
    length = F.when(F.col("event_id") % 7 == 0, 40000).otherwise(F.col("event_id") % 5 * 1800)
    rows = failures(spark, sf).select("user_id", "event_id", "kind", start.alias("a"), (start + length).alias("b"))
    return folds.nearest_known_intervals(rows, "user_id", "event_id", "a", "b", "kind", "error", 20000.0)


@query(sql("SELECT user_id, kind, place::INT AS place FROM (SELECT user_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id), kind) AS place FROM failures GROUP BY user_id, kind) WHERE place <= 3", FAILURES))
def first_kinds(spark, sf):
    """The first three kinds of event of each user."""
    return folds.first_distinct(failures(spark, sf), "user_id", "kind", "event_id", 3)


@query(sql("SELECT conv_id, turn, coalesce(sum(end_sec - start_sec) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM turns", TURNS))
def chunk_offsets(spark, sf):
    t = turns(spark, sf).withColumn("length", F.col("end_sec") - F.col("start_sec"))
    return G.running_offsets(t, "conv_id", ["turn", "text"], "length").select("conv_id", "turn", "offset")


@query(sql("SELECT conv_id, speaker, turn, count(*) OVER (PARTITION BY conv_id, speaker ORDER BY turn, text ROWS UNBOUNDED PRECEDING) - 1 AS retry_idx FROM turns", TURNS))
def retry_index(spark, sf):
    w = Window.partitionBy("conv_id", "speaker").orderBy("turn", "text")
    return turns(spark, sf).select("conv_id", "speaker", "turn", (F.row_number().over(w) - 1).cast("long").alias("retry_idx"))


@query(sql("SELECT conv_id, coalesce(max(turn), -1)::BIGINT + 1 AS next_idx FROM turns GROUP BY conv_id", TURNS))
def next_sequence(spark, sf):
    return turns(spark, sf).groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(-1)) + 1).cast("long").alias("next_idx"))


@query(sql("SELECT norm_sha, min(passage_id) AS keep FROM (SELECT passage_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS norm_sha FROM passages) GROUP BY norm_sha", PASSAGES))
def keep_first_duplicate(spark, sf):
    p = passages(spark, sf).select("passage_id", F.md5(squeezed(F.col("text"))).alias("norm_sha"))
    return p.groupBy("norm_sha").agg(F.min("passage_id").alias("keep"))


_QUIET = """q AS (SELECT *, sum(CASE WHEN quiet IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, value < 20 AS quiet, lag(value < 20) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM failures)),
 runs AS (SELECT user_id, run, count(*) AS n, min(ts) AS a, max(ts) AS b FROM q WHERE quiet GROUP BY ALL HAVING count(*) >= 2), best AS (SELECT user_id, arg_max({'a': a, 'b': b, 'n': n}, (n, -epoch_us(a))) AS r FROM runs GROUP BY user_id)"""


@query(sql("SELECT f.user_id, coalesce(make_timestamp((epoch_us(any_value(r).a) + epoch_us(any_value(r).b)) // 2), arg_min(ts, (value, ts))) AS cut, coalesce(any_value(r).n, 0) AS n FROM failures f LEFT JOIN best USING (user_id) GROUP BY f.user_id", FAILURES, _QUIET))
def silence_cut(spark, sf):
    return G.silence_cuts(failures(spark, sf), "user_id", 20.0, 2)


@query(sql("SELECT conv_id, speaker, sum(greatest(end_sec - start_sec, 0))::BIGINT AS sec, arg_max(turn, (end_sec - start_sec, turn)) AS longest_turn, arg_min(text, (turn, text)) AS first_text FROM turns GROUP BY ALL", TURNS))
def speech_by_speaker(spark, sf):
    return turns(spark, sf).groupBy("conv_id", "speaker").agg(F.sum(F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(0))).alias("sec"), F.max_by("turn", F.struct(F.col("end_sec") - F.col("start_sec"), "turn")).alias("longest_turn"), F.min_by("text", F.struct("turn", "text")).alias("first_text"))


@query(sql("SELECT conv_id, turn, text FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) <= 2", TURNS))
def last_two_turns(spark, sf):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "text")
    return turns(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 2").select("conv_id", "turn", "text")


@query(sql("SELECT conv_id, string_agg('**' || speaker || '** [' || (start_sec // 60) || ':' || lpad((start_sec % 60)::VARCHAR, 2, '0') || ']: ' || text, chr(10) ORDER BY turn, text) AS markdown FROM turns GROUP BY conv_id", TURNS))
def transcript_markdown(spark, sf):
    from ..functions.times import clock

    line = F.concat(F.lit("**"), F.col("speaker"), F.lit("** ["), clock(F.col("start_sec")), F.lit("]: "), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "text", line.alias("line"))))
    return turns(spark, sf).groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("markdown"))
