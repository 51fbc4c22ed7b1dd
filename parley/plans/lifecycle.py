"""Audio made from level samples, and the life of recordings and of the index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dml
from ..operators import recordings as L
from ..operators.graph import shared_folder, stored
from ..sources import audio, wav_ranges
from ..sources.tables import CALLS, FAILURES, PASSAGES, calls, failures, passages, sql, table
from .base import query

RATE = 8
_LEVELS = "x AS (SELECT user_id, list(trunc(least(1, greatest(-1, (value - 20) / 40)) * 32767)::INT ORDER BY ts, event_id) AS pcm FROM failures GROUP BY user_id)"


def _audio(spark, sf):
    """The levels of each user as a WAV file of eight samples a second, and what is read back from it."""
    rows = failures(spark, sf).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda r: (r["value"] - 20) / 40).alias("levels"))
    files = rows.select("user_id", audio.wav_bytes(F.col("levels"), F.lit(RATE)).alias("wav"))
    return files.select("user_id", "wav", audio.wav_samples(F.col("wav")).alias("a")).select("user_id", "wav", "a.rate", "a.samples")


@query(sql(f"SELECT user_id, len(pcm) AS n, len(pcm) * 1000 // {RATE} AS ms, round(len(pcm) / {RATE}.0, 3)::DOUBLE AS sec_by_size, 44 + 2 * len(pcm) AS bytes, round(sqrt(list_sum(list_transform(pcm, lambda p: (p / 32768.0) ** 2)) / len(pcm)), 4) AS loudness, round(CASE WHEN len(pcm) < 12 THEN 0 ELSE coalesce(list_max(list_transform(pcm[5:4 + w], lambda p: abs(p))) / greatest(1e-9, list_max(list_transform(pcm[5:4 + 4 * w], lambda p: abs(p)))), 0) END, 4)::DOUBLE AS first_peak FROM (SELECT *, greatest(1, (len(pcm) - 4) // 4) AS w FROM x)", FAILURES, _LEVELS))
def audio_measures(spark, sf):
    """Durations by samples and by size, loudness and peaks of WAV files."""
    s, r = F.col("samples"), F.col("rate")
    peak = F.when(F.size(s) < 12, 0.0).otherwise(F.round(audio.peaks(s, r, F.lit(0.5), F.lit(1e6), 4)[0], 4))
    return _audio(spark, sf).select("user_id", F.size(s).cast("long").alias("n"), audio.duration_ms(s, r).alias("ms"), F.round(audio.duration_by_size(F.col("wav")), 3).alias("sec_by_size"), F.octet_length("wav").cast("long").alias("bytes"), F.round(audio.rms(s), 4).alias("loudness"), peak.alias("first_peak"))


@query(sql(f"SELECT user_id, place, len(p) AS n, round(coalesce(list_sum(list_transform(p, lambda q: q / 32768.0)), 0), 3)::DOUBLE AS total FROM (SELECT user_id, 0 AS place, pcm[5:{RATE}] AS p FROM x UNION ALL SELECT user_id, 1, pcm[{RATE} + 1:] FROM x)", FAILURES, _LEVELS))
def audio_slices(spark, sf):
    """Stretches of a file in seconds: one within it, and one that goes on beyond its end."""
    s, r = F.col("samples"), F.col("rate")
    cuts = F.array(audio.slice_or_error(s, r, F.lit(0.5), F.lit(1.0)), audio.slice_or_error(s, r, F.lit(1.0), F.lit(1e6)))
    rows = _audio(spark, sf).select("user_id", F.posexplode(cuts).alias("place", "p"))
    return rows.select("user_id", "place", F.size("p").cast("long").alias("n"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query(sql("SELECT user_id, len(pcm) AS n, (list_sum(list_transform(pcm, lambda p: p::BIGINT)) * 1.0)::DOUBLE AS total FROM x", FAILURES, _LEVELS))
def audio_joined(spark, sf):
    """Files cut into three chunks and joined again in order."""
    third = F.ceil(F.size("samples") / 3).cast("int")
    chunks = _audio(spark, sf).select("user_id", "rate", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.alias("idx"), F.slice("samples", i * third + 1, third).alias("samples")))).alias("c"))
    whole = audio.joined(chunks.select("user_id", "c.idx", "rate", "c.samples"), "user_id")
    return whole.select("user_id", F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * 32768), 0).alias("total"))


_RECORDED = """r AS (SELECT user_id, event_id // 2000 AS part, list((value - 20) / 40 ORDER BY ts, event_id) AS v FROM failures GROUP BY ALL),
 d AS (SELECT user_id, part, CASE user_id % 3 WHEN 2 THEN list_transform(v, lambda x: x::FLOAT::DOUBLE) ELSE list_transform(v, lambda x: (trunc(least(1, greatest(-1, x)) * 32767) + CASE WHEN user_id % 3 = 1 THEN trunc(least(1, greatest(-1, x / 2)) * 32767) ELSE 0 END) / 32768 / (1 + (user_id % 3 = 1)::INT)) END AS s FROM r)"""


def _recorded(spark, sf):
    """The levels of each user in WAV files of at most 2,000 samples, in packs: 16-bit PCM with one or two channels, and floats."""
    levels = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda r: (r["value"] - 20) / 40)
    parts = failures(spark, sf).withColumn("part", F.floor(F.col("event_id") / 2000))
    rows = wav_ranges.dealt(parts, "user_id").groupBy("user_id", "part").agg(levels.alias("samples"))
    name = F.concat_ws("/", F.col("user_id").cast("string"), F.col("part").cast("string"))
    files = rows.select(name.alias("name"), F.lit(RATE).alias("rate"), F.when(F.col("user_id") % 3 == 1, 2).otherwise(1).alias("channels"), (F.col("user_id") % 3 == 2).alias("is_float"), "samples")
    folder = f"{shared_folder(spark)}/wavs-{uuid.uuid4().hex}"
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return uri, stored(wav_ranges.write_wavs(files, uri), "wavs")


def _named(path, n: int):
    return F.regexp_extract(path, r"/(\d+)/(\d+)\.wav$", n).cast("long")


@query(sql("SELECT user_id, part, len(s) AS frames, ceil(len(s) / 16.0)::BIGINT AS ranges, round(list_sum(s), 2) + 0.0 AS total FROM d", FAILURES, _RECORDED))
def wav_ranges_read(spark, sf):
    """Recordings of several formats read in ranges of sixteen frames."""
    uri, _ = _recorded(spark, sf)
    rows = wav_ranges.wav_ranges(spark, uri, 16).withColumn("x", F.aggregate("samples", F.lit(0.0), lambda a, v: a + v))
    told = rows.groupBy("path").agg(F.sum(F.size("samples")).alias("frames"), F.count(F.lit(1)).alias("ranges"), (F.round(F.sum("x"), 2) + 0.0).alias("total"))
    return told.select(_named("path", 1).alias("user_id"), _named("path", 2).alias("part"), "frames", "ranges", "total")


@query(sql("SELECT user_id, part, place, len(p) AS n, round(coalesce(list_sum(p), 0), 2)::DOUBLE + 0.0 AS total FROM (SELECT user_id, part, 0 AS place, s[5:12] AS p FROM d UNION ALL SELECT user_id, part, 1, s[9:] FROM d)", FAILURES, _RECORDED))
def wav_slices_read(spark, sf):
    """Two stretches of each recording, one that goes on beyond its end, by reading just their bytes."""
    _, files = _recorded(spark, sf)
    bounds = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(a).alias("start_sec"), F.lit(b).alias("end_sec")) for i, (a, b) in enumerate([(0.5, 1.5), (1.0, 1e6)])))
    rows = wav_ranges.slices(files.select("path", F.inline(bounds)))
    return rows.select(_named("path", 1).alias("user_id"), _named("path", 2).alias("part"), "place", F.size("samples").cast("long").alias("n"), (F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 2) + 0.0).alias("total"))


_FILES = "f AS (SELECT DISTINCT l_orderkey AS call_id, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber - 1 - (l_orderkey % 2) END AS chunk_idx FROM lineitem)"


@query(sql("SELECT call_id, CASE WHEN chunk_idx IS NULL AND least > 0 THEN 0 ELSE chunk_idx END AS chunk_idx FROM (SELECT *, min(chunk_idx) OVER (PARTITION BY call_id) AS least FROM f)", _FILES))
def roots_promoted(spark, sf):
    """Whole files that become the missing first chunk."""
    li = table(spark, sf, "lineitem")
    files = li.select(F.col("l_orderkey").alias("call_id"), F.when(F.col("l_linenumber") != 1, F.col("l_linenumber") - 1 - F.col("l_orderkey") % 2).cast("long").alias("chunk_idx")).distinct()
    return audio.promoted_roots(files)


_RECORDINGS = "r AS (SELECT call_id, CASE WHEN call_id % 3 = 0 THEN 'recording' ELSE status END AS status, CASE WHEN call_id % 5 <> 0 THEN call_id % 70 END AS mic_sec FROM calls)"


@query(sql("SELECT call_id, CASE WHEN status = 'recording' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'recording' THEN 'interrupted' END AS reason FROM r WHERE status <> 'recording' OR mic_sec >= 30", CALLS, _RECORDINGS))
def orphans_reconciled(spark, sf):
    """Recordings left behind: those of 30 seconds and more fail as interrupted, shorter and silent ones go."""
    k = F.col("call_id")
    rows = calls(spark, sf).select("call_id", F.when(k % 3 == 0, "recording").otherwise(F.col("status")).alias("status"))
    heard = rows.where("call_id % 5 <> 0").select("call_id", (k % 70).alias("mic_sec"))
    return L.reconciled(rows, heard)


@query(sql("SELECT call_id, CASE WHEN a IS NULL AND b IS NULL THEN 'ready' ELSE 'failed' END AS status, coalesce(a, b) AS error FROM (SELECT call_id, CASE WHEN call_id % 4 = 0 THEN 'pipeline' END AS a, CASE WHEN call_id % 6 = 0 THEN 'database' END AS b FROM calls)", CALLS))
def finish_events(spark, sf):
    """The first error decides how a call ends."""
    k = F.col("call_id")
    return L.finished(calls(spark, sf).select("call_id", F.when(k % 4 == 0, "pipeline").alias("a"), F.when(k % 6 == 0, "database").alias("b")), ["a", "b"])


@query(sql("SELECT user_id, arg_max(event_id, (ts, event_id)) AS step, greatest(0, least(100, arg_max(round(value), (ts, event_id))))::BIGINT AS pct FROM failures GROUP BY user_id", FAILURES))
def progress_latest(spark, sf):
    """The last progress of each run, from 0 to 100."""
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    rows = failures(spark, sf).groupBy("user_id").agg(last.alias("l"))
    return rows.select("user_id", F.col("l.event_id").alias("step"), F.greatest(F.lit(0), F.least(F.lit(100), F.round("l.value"))).cast("long").alias("pct"))


@query(sql("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 180000000 PRECEDING AND CURRENT ROW) AS held FROM failures", FAILURES))
def levels_held(spark, sf):
    """How many samples of the last three minutes a buffer holds after each."""
    return L.held(failures(spark, sf), "user_id", "ts", 180).select("user_id", "event_id", "held")


_INDEX = "ix AS (SELECT passage_id, CASE WHEN passage_id % 5 = 0 THEN 'old' ELSE 'new' END AS model FROM passages WHERE passage_id % 3 <> 0)"


@query(sql("SELECT passage_id, coalesce(i.passage_id IS NULL, true) AS added FROM passages LEFT JOIN (SELECT * FROM ix WHERE model = 'new') i USING (passage_id) WHERE call_id IS DISTINCT FROM 'src1'", PASSAGES, _INDEX).replace("SELECT passage_id, coalesce(i.passage_id IS NULL, true) AS added", "SELECT p.passage_id, i.passage_id IS NULL AS added").replace("FROM passages LEFT JOIN", "FROM passages p LEFT JOIN").replace("i USING (passage_id) WHERE", "i ON i.passage_id = p.passage_id WHERE"))
def index_backfilled(spark, sf):
    """The index after a change of model: vectors of the old model go, missing ones are made, one call's are removed."""
    p = passages(spark, sf)
    index = p.where("passage_id % 3 <> 0").select("passage_id", F.when(F.col("passage_id") % 5 == 0, "old").otherwise("new").alias("model"), F.lit(False).alias("added"))
    full = L.backfilled(L.current(index, "new"), p, "new")
    return L.deindexed(full, p, "src1").select("passage_id", "added")


@query(sql("SELECT call_id, flags, cleared FROM (SELECT call_id, CASE call_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'mic,mic_gap' WHEN 2 THEN '' ELSE 'mic' END AS flags, call_id % 4 IN (1, 3) AND call_id % 8 = 1 AS cleared FROM calls)", CALLS))
def degraded_flags(spark, sf):
    """Flags kept as JSON lists: absent and malformed ones are none; some calls' are cleared."""
    k = F.col("call_id")
    rows = calls(spark, sf).select("call_id", F.when(k % 4 == 1, '["mic","mic_gap"]').when(k % 4 == 2, "{oops").when(k % 4 == 3, '["mic"]').alias("json"))
    flags = F.coalesce(F.from_json("json", "array<string>"), F.array().cast("array<string>"))
    after = dml.updated(rows.withColumn("flags", flags), k % 8 == 1, json=F.lit(None).cast("string"))
    return after.select("call_id", F.array_join("flags", ",").alias("flags"), (F.col("json").isNull() & (F.size("flags") > 0)).alias("cleared"))


@query(sql("""SELECT call_id, status IN ('ready', 'failed') AND call_id % 9 <> 0 AS can_reprocess, status = 'ready' AS can_export, n = 0 OR bad < n AS finalise, (call_id % 100) - (call_id % 40) < 30 AS tap, round(duration_sec / 7.0)::BIGINT AS seconds,
 CASE WHEN ago = 0 THEN strftime(started_at, '%H:%M') WHEN ago = 1 THEN 'yesterday' ELSE strftime(started_at, '%d.%m.%Y') END AS shown, strftime(started_at, '%d') AS day, (call_id % 9000) // 60 || ':' || lpad((call_id % 9000 % 60)::VARCHAR, 2, '0') AS clock,
 CASE WHEN duration_sec < 1048576 THEN round(duration_sec / 1024.0, 1)::DECIMAL(18, 1)::VARCHAR || ' KB' ELSE round(duration_sec / 1048576.0, 1)::DECIMAL(18, 1)::VARCHAR || ' MB' END AS size
 FROM (SELECT *, call_id % 4 AS n, call_id % 3 AS bad, call_id % 3 AS ago FROM calls)""", CALLS))
def small_rules(spark, sf):
    """What rows can do, whether a recovery ends, accidental taps, and how times and sizes are shown."""
    k, t = F.col("call_id"), F.col("started_at")
    now = F.date_add(F.to_date(t), (k % 3).cast("int"))
    return calls(spark, sf).select(
        "call_id", L.can_reprocess(F.col("status"), k % 9 == 0).alias("can_reprocess"), (F.col("status") == "ready").alias("can_export"), L.should_finish(k % 4, k % 3).alias("finalise"),
        L.is_tap((k % 100) * 1000, (k % 40) * 1000).alias("tap"), F.round(F.col("duration_sec") / 7.0).cast("long").alias("seconds"), L.message_time(t, now).alias("shown"), F.date_format(t, "dd").alias("day"),
        L.fragment_clock((k % 9000) * 1000).alias("clock"), L.small_size(F.col("duration_sec")).alias("size"),
    )


@query(sql("SELECT n_kinds + n_status + ranged AS active, sum(n)::BIGINT AS n, sum(CASE WHEN present THEN size ELSE 0 END)::BIGINT AS stored FROM (SELECT call_id % 3 AS n_kinds, call_id % 2 AS n_status, (call_id % 5 > 2)::INT AS ranged, 1 AS n, call_id % 4 = 0 AS present, duration_sec AS size FROM calls) GROUP BY active", CALLS))
def active_filters(spark, sf):
    """Active filters by their number (a range counts once), with the bytes of what is present."""
    k = F.col("call_id")
    lists = [F.slice(F.array(F.lit("a"), F.lit("b")), 1, (k % 3).cast("int")), F.slice(F.array(F.lit("x")), 1, (k % 2).cast("int"))]
    active = L.facet_count(lists, F.when(k % 5 > 2, "1995-01-01"), F.lit(None).cast("string"))
    return calls(spark, sf).groupBy(active.cast("long").alias("active")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(k % 4 == 0, F.col("duration_sec")).otherwise(0)).alias("stored"))
