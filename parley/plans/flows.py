"""Streams, chunk states, models and answers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions import models, questions
from ..operators import answers, dml, folds
from ..operators.graph import shared_folder
from ..sources.tables import CALLS, CONTACTS, SPEAKERS, TURNS, calls, contacts, speakers, sql, table, turns
from ..streaming import chunks, ledger, machines, sessions
from .base import query


_LEVELS = "t AS (SELECT user_id AS key, floor(epoch_us(ts::TIMESTAMP) / 1000)::BIGINT AS ts, value, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch_us(ts::TIMESTAMP) / 1000), value) AS i FROM events)"
# One row of m per sample: the silence's and voice's start (-1: none) and what was said, after it.
_STEPPED = """m AS (SELECT key, 0::BIGINT AS i, 0::BIGINT AS ts, -1::BIGINT AS silence, -1::BIGINT AS voice, false AS suggested, false AS stopped, false AS ended, false AS says, false AS stops FROM (SELECT DISTINCT key FROM t) UNION ALL
 SELECT key, i, ts, s, v, CASE WHEN ended THEN false ELSE suggested OR says END, stopped OR stops, ended, says, stops FROM (
  SELECT key, i, ts, CASE WHEN ended THEN -1 ELSE s END AS s, v, suggested, stopped, ended, NOT stopped AND NOT ended AND s >= 0 AND NOT suggested AND ts - s >= 21600000 AS says, NOT stopped AND NOT ended AND s >= 0 AND ts - s >= 86400000 AS stops FROM (
   SELECT *, loud AND NOT stopped AND s >= 0 AND ts - v >= 7200000 AS ended FROM (
    SELECT t.key, t.i, t.ts, m.suggested, m.stopped, t.value >= 20 AS loud, CASE WHEN m.stopped THEN m.voice WHEN t.value >= 20 THEN CASE WHEN m.voice < 0 THEN t.ts ELSE m.voice END ELSE -1 END AS v, CASE WHEN m.stopped OR t.value >= 20 OR m.silence >= 0 THEN m.silence ELSE t.ts END AS s
    FROM m JOIN t ON t.key = m.key AND t.i = m.i + 1))))"""
_SILENCE = "WITH RECURSIVE " + ", ".join((_LEVELS, _STEPPED)) + """ SELECT key, ts AS ts_ms, 'voice' AS signal, ts AS trim_ms FROM m WHERE ended UNION ALL SELECT key, ts, 'suggest', ts FROM m WHERE says UNION ALL SELECT key, ts, 'stop', least(silence + 5000, ts) FROM m WHERE stops"""


@query(_SILENCE)
def silence_session(spark, sf):
    return machines.silence_signals(machines.samples_of(table(spark, sf, "events")))


@query(_SILENCE)
def silence_session_stream(spark, sf):
    """The same machine on a stream that replays the events; tests hold it against silence_session."""
    stored = table(spark, sf, "events")
    # A stream reads a folder: that of the table's files, or the one that holds the table where it is a single file.
    folder = f"{sf}/events.parquet" if "/events.parquet/" in stored.inputFiles()[0] else sf
    stream = machines.level_stream(spark, folder, stored.schema, "events.parquet" if folder == sf else "*.parquet")
    return machines.drained(machines.silence_signals_stream(stream), shared_folder(spark))


_EVENTS = """e AS (SELECT user_id AS key, floor(epoch_us(ts::TIMESTAMP) / 1000)::BIGINT AS ts, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN CASE WHEN event_id % 9 = 0 THEN 2 ELSE 3 END ELSE 3 END AS kind, value FROM events),
 t AS (SELECT key, ts, kind, CASE WHEN kind = 3 THEN value END AS value, row_number() OVER (PARTITION BY key ORDER BY ts, kind, CASE WHEN kind = 3 THEN value END) AS i FROM e)"""
_WATCHED = """m AS (SELECT key, 0::BIGINT AS i, 0::BIGINT AS ts, -1::BIGINT AS sil, -1::BIGINT AS voi, false AS sug, false AS pau, false AS don, NULL::VARCHAR AS signal FROM (SELECT DISTINCT key FROM t) UNION ALL
 SELECT key, i, ts, s1, CASE WHEN ended THEN -1 ELSE v1 END, CASE WHEN ctl OR ended THEN false ELSE sug OR says END, CASE WHEN ctl THEN kind = 0 OR pau AND kind = 2 ELSE pau END, don OR stops, CASE WHEN stops THEN 'stop' WHEN says THEN 'suggest' END FROM (
  SELECT *, stopping AS stops, low AND NOT stopping AND NOT sug AND ts - s1 >= 21600000 AS says FROM (SELECT *, low AND ts - s1 >= 86400000 AS stopping FROM (
   SELECT *, CASE WHEN ctl OR ended THEN -1 WHEN low AND sil < 0 THEN ts ELSE sil END AS s1 FROM (SELECT *, loud AND ts - v1 >= 7200000 AS ended FROM (
    SELECT *, CASE WHEN ctl OR low THEN -1 WHEN loud AND voi < 0 THEN ts ELSE voi END AS v1 FROM (
     SELECT t.key, t.i, t.ts, t.kind, t.kind < 3 AS ctl, m.sil, m.voi, m.sug, m.pau, m.don, NOT m.don AND NOT m.pau AND t.kind = 3 AND t.value >= 20 AS loud, NOT m.don AND NOT m.pau AND t.kind = 3 AND t.value < 20 AS low
     FROM m JOIN t ON t.key = m.key AND t.i = m.i + 1)))))))"""
_CONTROLLED = "WITH RECURSIVE " + ", ".join((_EVENTS, _WATCHED)) + " SELECT key, ts AS ts_ms, signal, ts - sil AS silent_ms, CASE signal WHEN 'stop' THEN least(sil + 5000, ts) ELSE sil + 86400000 END AS at_ms FROM m WHERE signal IS NOT NULL"
_HOUR = 3_600_000
_RULES = sessions.WatchRules(quiet=20.0, voice_ms=2 * _HOUR, suggest_ms=6 * _HOUR, stop_ms=24 * _HOUR)


def _told(spark, sf):
    """Levels and controls of each user: some events are pauses, resumptions and snoozes."""
    e = machines.samples_of(table(spark, sf, "events").withColumn("value", F.struct("value", "event_id")))
    e = e.select("key", "ts_ms", F.col("value.value").alias("value"), "event_type", F.col("value.event_id").alias("n"))
    control = F.when(F.col("event_type") == "signup", "pause").when(F.col("event_type") == "view", "resume").when((F.col("event_type") == "click") & (F.col("n") % 9 == 0), "snooze")
    told = e.withColumn("control", control)
    return told.where("control is null").select("key", "ts_ms", "value"), told.where("control is not null").select("key", "ts_ms", "control")


def _replayed(spark, sf):
    """The same as streams from the shared folder; a last level of a key of its own, long after all others, ends them."""
    out = []
    for i, df in enumerate(_told(spark, sf)):
        last = F.max("ts_ms") + 400 * 24 * _HOUR
        end = df.agg(last.alias("ts_ms")).select(F.lit(-1).cast("long").alias("key"), "ts_ms", F.lit(1.0).alias("value")) if i == 0 else df.limit(0)
        folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
        df.unionByName(end).write.parquet(folder)
        out.append(spark.readStream.schema(df.schema).parquet(folder))
    return out


@query(_CONTROLLED)
def silence_controls(spark, sf):
    """Silences of recordings with pauses, resumptions and snoozes among the levels."""
    return sessions.watched(sessions.events_of(*_told(spark, sf)), _RULES)


@query(_CONTROLLED)
def silence_controls_stream(spark, sf):
    """The same on streams of levels and controls."""
    stream = sessions.watched(sessions.events_of(*_replayed(spark, sf)), _RULES)
    return machines.drained(stream, shared_folder(spark)).where("key >= 0")


_CUT = sessions.CutRules(from_ms=22 * _HOUR, to_ms=26 * _HOUR, quiet=20.0, least_ms=_HOUR, idle_ms=240 * _HOUR)


@query()
def recording_cuts(spark, sf):
    """Recordings cut about once a day in their silences, pauses left out; tests hold it against plain machines."""
    return sessions.recording_chunks(sessions.events_of(*_told(spark, sf)), _CUT)


@query()
def recording_cuts_stream(spark, sf):
    """The same on streams; tests hold it against recording_cuts."""
    stream = sessions.recording_chunks(sessions.events_of(*_replayed(spark, sf)), _CUT)
    return machines.drained(stream, shared_folder(spark)).where("key >= 0")


_TOLD = "told AS (SELECT l_orderkey AS call_id, l_linenumber AS chunk_idx, unnest(['process', CASE WHEN l_quantity > 25 THEN 'done' ELSE 'fail' END, CASE WHEN l_returnflag = 'R' THEN 'retry' ELSE 'done' END]) AS event, generate_subscripts([1, 2, 3], 1) + 3 * l_suppkey AS n FROM lineitem)"
_FOLDED = """o AS (SELECT *, row_number() OVER (PARTITION BY call_id, chunk_idx ORDER BY n, event) AS i FROM told), k AS (SELECT call_id, chunk_idx, 0::BIGINT AS i, 'pending' AS status FROM (SELECT DISTINCT call_id, chunk_idx FROM o) UNION ALL
 SELECT o.call_id, o.chunk_idx, o.i, CASE WHEN event = 'process' AND status = 'pending' THEN 'processing' WHEN event = 'done' AND status = 'processing' THEN 'done' WHEN event = 'fail' AND status IN ('pending', 'processing', 'failed') THEN 'failed' WHEN event = 'retry' AND status = 'failed' THEN 'pending' ELSE status END
 FROM k JOIN o ON o.call_id = k.call_id AND o.chunk_idx = k.chunk_idx AND o.i = k.i + 1)"""


@query("WITH RECURSIVE " + ", ".join((_TOLD, _FOLDED)) + " SELECT call_id, chunk_idx, arg_max(status, i) AS status FROM k GROUP BY call_id, chunk_idx")
def chunk_events_stream(spark, sf):
    """Events of chunks, several each, as a stream into a table that takes each batch once."""
    li = table(spark, sf, "lineitem")
    events = F.array(F.lit("process"), F.when(F.col("l_quantity") > 25, "done").otherwise("fail"), F.when(F.col("l_returnflag") == "R", "retry").otherwise("done"))
    told = li.select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").cast("long").alias("chunk_idx"), F.posexplode(events).alias("n", "event"), "l_suppkey")
    told = told.select("call_id", "chunk_idx", (F.col("n") + 1 + 3 * F.col("l_suppkey")).cast("long").alias("order"), "event")
    folder = f"{shared_folder(spark)}/chunk-events-{uuid.uuid4().hex}"
    told.write.parquet(f"{folder}/in")
    chunk_table = ledger.VersionedTable(spark, f"{folder}/table")
    ledger.follow_events(spark.readStream.schema(told.schema).parquet(f"{folder}/in"), chunk_table, f"{folder}/state").awaitTermination()
    return chunk_table.read()


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_levels(spark, sf):
    return machines.hourly(machines.samples_of(table(spark, sf, "events"))).withColumn("total", F.round("total", 4))


_SAMPLES = "t AS (SELECT user_id AS key, floor(epoch_us(ts::TIMESTAMP) / 1000)::BIGINT AS ts, value FROM events), ends AS (SELECT key, min(ts) AS first, max(ts) AS last FROM t GROUP BY key)"
_CUTS = """w AS (SELECT key, 0 AS win, first AS start, last FROM ends UNION ALL
 SELECT w.key, w.win + 1, coalesce(arg_min(t.ts, (t.value, t.ts)), w.start + 86400000)::BIGINT, w.last FROM w LEFT JOIN t ON t.key = w.key AND t.ts BETWEEN w.start + 77760000 AND w.start + 95040000 WHERE w.last - w.start > 95040000 GROUP BY w.key, w.win, w.start, w.last)"""


@query("WITH RECURSIVE " + ", ".join((_SAMPLES, _CUTS)) + ' SELECT key, win::BIGINT AS "window", start AS start_ms, coalesce(lead(start) OVER (PARTITION BY key ORDER BY win), last) AS end_ms FROM w')
def adaptive_windows(spark, sf):
    day = 86_400_000
    return folds.adaptive_windows(machines.samples_of(table(spark, sf, "events")), day, day // 10)


def _chunks(spark, sf):
    li = table(spark, sf, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "done").when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "F", "processing").otherwise("pending")
    rows = li.select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("chunk_idx"), status.alias("status"))
    return dml.dealt(rows, dml.tasks_for(li), ["call_id", "chunk_idx"]).groupBy("call_id", "chunk_idx").agg(F.min("status").alias("status"))


_CHUNKS = """chunks AS (SELECT l_orderkey AS call_id, l_linenumber AS chunk_idx, min(CASE WHEN l_returnflag = 'A' THEN 'done' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'processing' ELSE 'pending' END) AS status FROM lineitem GROUP BY ALL)"""


@query(sql("""SELECT call_id, chunk_idx, CASE WHEN e = 'retry' AND status = 'failed' THEN 'pending' WHEN e = 'done' AND status = 'processing' THEN 'done' ELSE status END AS status,
 CASE WHEN e IS NOT NULL THEN (e = 'retry' AND status = 'failed') OR (e = 'done' AND status = 'processing') END AS accepted FROM (SELECT *, CASE WHEN call_id % 3 = 0 THEN 'retry' WHEN call_id % 3 = 1 THEN 'done' END AS e FROM chunks)""", _CHUNKS))
def chunk_transitions(spark, sf):
    c = _chunks(spark, sf)
    event = F.when(F.col("call_id") % 3 == 0, "retry").when(F.col("call_id") % 3 == 1, "done")
    return chunks.applied(c, c.select("call_id", "chunk_idx", event.alias("event")).where("event is not null"))


@query(sql("SELECT f.call_id, f.k AS chunk_idx, CASE WHEN c.status IS NULL OR c.status = 'pending' THEN 'run' WHEN c.status = 'failed' THEN 'rerun' ELSE 'skip' END AS action FROM (SELECT call_id, max(chunk_idx) + call_id % 2 AS k FROM chunks GROUP BY call_id) f LEFT JOIN chunks c ON c.call_id = f.call_id AND c.chunk_idx = f.k", _CHUNKS))
def chunk_plan(spark, sf):
    """The last chunk of every call at its end; of every other call it has no row yet."""
    c = _chunks(spark, sf)
    finals = c.groupBy("call_id").agg((F.max("chunk_idx") + F.col("call_id") % 2).alias("chunk_idx"))
    return chunks.plan(c, finals)


@query(sql("""SELECT event, call_id, CASE WHEN before >= 5 THEN 'stop' WHEN NOT has_audio THEN 'no_audio' WHEN tries >= 2 THEN 'tries_exhausted' WHEN has_transcript THEN 'reprocess' ELSE 'recover' END AS action FROM
 (SELECT *, coalesce(sum((has_audio AND tries < 2)::INT) OVER (PARTITION BY event ORDER BY place, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM
 (SELECT contact_id % 50 AS event, -duration_sec AS place, call_id, provider LIKE '%U%' AS has_transcript, call_id % 4 <> 0 AS has_audio, call_id % 5 AS tries FROM calls WHERE status <> 'ready'))""", CALLS))
def parked_resumed(spark, sf):
    """Calls that wait, the longest first, at fifty events: which start again, and why others don't."""
    c = calls(spark, sf).where("status <> 'ready'")
    parked = c.select((F.col("contact_id") % 50).alias("event"), (-F.col("duration_sec")).alias("place"), "call_id", F.col("provider").contains("U").alias("has_transcript"), (F.col("call_id") % 4 != 0).alias("has_audio"), (F.col("call_id") % 5).alias("tries"))
    return chunks.parked_plan(parked)


@query(sql("SELECT call_id, chunk_idx, CASE WHEN status = 'done' AND call_id % 5 <> 0 THEN 'done' ELSE 'pending' END AS status FROM chunks", _CHUNKS))
def chunk_recovery(spark, sf):
    c = _chunks(spark, sf)
    return chunks.recovered(c.where("call_id % 5 <> 0"), c)


_ASKED = ("сколько звонков {n}", "кратко: {t}", "последний звонок, {t}", "резюме: последний звонок {t}", "когда обсуждали {t}?", "какие звонки {n}", "кто такой {t}", "{t}")
_ROUTES = ("stats", "summary", "last", "last_summary", "when", "list", "who", "none")


@query(sql(f"SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 8 = 1 AND conv_id % 2 = 1 THEN 'none' WHEN (conv_id + turn) % 8 = 3 AND conv_id % 2 = 0 THEN 'summary' ELSE {list(_ROUTES)}[(conv_id + turn) % 8 + 1] END AS route FROM turns", TURNS))
def question_routes(spark, sf):
    """Questions made of the turns, of every other conversation in the scope of a call."""
    t = turns(spark, sf)
    made = [F.concat(*(F.col("text") if x == "{t}" else F.col("turn").cast("string") if x == "{n}" else F.lit(x) for x in re.split(r"(\{[tn]\})", a) if x)) for a in _ASKED]
    asked = F.element_at(F.array(*made), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    return t.select("conv_id", "turn", questions.route(asked, F.col("conv_id") % 2 == 0).alias("route"))


@query(sql("SELECT conv_id, string_agg('[' || i || '] ' || text, chr(10) ORDER BY i) AS prompt FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM turns) GROUP BY conv_id", TURNS))
def prompt_assembly(spark, sf):
    return answers.prompts(turns(spark, sf), "conv_id", "turn")


@query(sql("SELECT conv_id, '1' AS refs, sum(length(text) + length('[' || i || '] '))::BIGINT + count(*) - 1 AS length FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM turns) GROUP BY conv_id", TURNS))
def grounded_answers(spark, sf):
    """Prompts through the generating model (its stand-in here), its references resolved."""
    asked = answers.prompts(turns(spark, sf), "conv_id", "turn").withColumn("raw", models.generate(F.col("prompt")))
    parsed = asked.withColumn("got", F.from_json("raw", "answer string, length bigint"))
    refs = answers.references(F.col("got.answer"), F.lit(3))
    return parsed.select("conv_id", F.array_join(F.transform(refs, lambda r: r.cast("string")), ",").alias("refs"), F.col("got.length").alias("length"))


@query(sql("SELECT call_id, title, started_at, coalesce(string_agg(display_name, ', ' ORDER BY display_name), '') AS participants FROM calls LEFT JOIN (SELECT DISTINCT s.call_id AS cid, c.display_name FROM speakers s JOIN contacts c ON c.contact_id = s.contact_id WHERE s.confirmed) p ON cid = call_id WHERE started_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30' GROUP BY ALL", CALLS, SPEAKERS, CONTACTS))
def tool_calls_in_range(spark, sf):
    """A tool's answer: calls of a closed period with their confirmed participants."""
    period = calls(spark, sf).where(F.col("started_at").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1996-06-30").cast("timestamp")))
    named = speakers(spark, sf).where("confirmed").join(contacts(spark, sf).select("contact_id", "display_name"), "contact_id").select("call_id", "display_name").distinct()
    people = named.groupBy("call_id").agg(F.array_join(F.array_sort(F.collect_list("display_name")), ", ").alias("participants"))
    return period.join(people, "call_id", "left").select("call_id", "title", "started_at", F.coalesce("participants", F.lit("")).alias("participants"))
