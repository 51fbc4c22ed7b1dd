"""Tracks, chunks, recaps and artifacts of recorded calls."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import processing as P
from ..operators.graph import shared_folder, stored
from ..sources import artifacts, stt
from ..sources.tables import CALLS, CONTACTS, FAILURES, PASSAGES, TURNS, VECTORS, calls, contacts, passages, person_name, sql, turns, vectors
from .base import query
from .lifecycle import _LEVELS, RATE, _audio
from .transcripts import contact_cards


@query(sql("SELECT call_id, passage_id, text, row_number() OVER (PARTITION BY call_id ORDER BY passage_id) - 1 AS place FROM passages", PASSAGES))
def passage_texts(spark, sf):
    """The passages of each call in their order."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("call_id").orderBy("passage_id")) - 1
    return passages(spark, sf).select("call_id", "passage_id", "text", place.cast("long").alias("place"))


@query(sql("SELECT call_id AS call, CASE WHEN size % 3 <> 0 AND call_id <> first THEN n || ' passages' || chr(10) || size || ' characters' || chr(10) END AS text, call_id = first AS gone FROM (SELECT coalesce(call_id, 'none') AS call_id, count(*) AS n, sum(length(text))::BIGINT AS size, min(min(coalesce(call_id, 'none'))) OVER () AS first FROM passages GROUP BY 1)", PASSAGES))
def artifacts_read(spark, sf):
    """Two artifacts of each call's passages written as files, those of the first call deleted, and read back; missing ones are null."""
    rows = passages(spark, sf).groupBy(F.coalesce("call_id", F.lit("none")).alias("call")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("size"))
    rows = stored(rows, "passages-of-calls")
    root = f"{shared_folder(spark)}/artifacts-{uuid.uuid4().hex}"
    text = F.concat(F.col("n").cast("string"), F.lit(" passages\n"), F.col("size").cast("string"), F.lit(" characters\n"))
    recaps = rows.where("size % 3 <> 0").select("call", F.lit("recap").alias("kind"), text.alias("text"))
    artifacts.write_artifacts(recaps.unionByName(rows.select("call", F.lit("transcript").alias("kind"), F.col("n").cast("string").alias("text"))), root)
    first = rows.agg(F.min("call")).first()[0]
    gone = first is not None and artifacts.remove_artifacts(spark, root, first)
    return artifacts.read_artifacts(spark, root, rows, "recap").select("call", "text", ((F.col("call") == first) & F.lit(gone)).alias("gone"))


@query(sql("SELECT conv_id || '-' || turn AS doc, 'w' || turn || chr(65533) || 'x' AS text, 'en' AS language FROM turns", TURNS))
def recogniser_files(spark, sf):
    """Recogniser documents as bytes that aren't wholly UTF-8: what can't be read becomes a replacement character."""
    head, tail = F.lit('{"result":{"language":"en"},"transcription":[{"text":"w'), F.lit('x","offsets":{"from":0,"to":1000},"tokens":[]}]}')
    data = F.concat(F.concat(head, F.col("turn").cast("string")).cast("binary"), F.unhex(F.lit("FF")), tail.cast("binary"))
    docs = turns(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("doc"), F.make_valid_utf8(data.cast("string")).alias("json"))
    return stt.segments(docs, "doc", "json").select("doc", "text", "language")


_THIRDS = "t AS (SELECT user_id, pcm, (ceil(len(pcm) / 3.0))::INT AS k FROM x)"


@query(sql("SELECT user_id, len(pcm) AS mic, CASE WHEN user_id % 3 <> 0 THEN least(len(pcm), 2 * k) END AS system FROM t", FAILURES, _LEVELS, _THIRDS))
def both_tracks_joined(spark, sf):
    """Three chunks of one track and two of the other, joined apart; a track that isn't there is null."""
    third = F.ceil(F.size("samples") / 3).cast("int")
    chunks = _audio(spark, sf).select("user_id", "rate", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.alias("idx"), F.slice("samples", i * third + 1, third).alias("samples")))).alias("c")).select("user_id", "c.idx", "rate", "c.samples")
    got = P.both_tracks(chunks, chunks.where("user_id % 3 <> 0 AND idx < 2"), "user_id")
    return got.select("user_id", F.size("mic").cast("long").alias("mic"), F.size("system").cast("long").alias("system"))


@query(sql(f"SELECT user_id, CASE WHEN user_id % 4 <> 0 AND user_id % 5 <> 0 AND user_id % 7 <> 0 THEN greatest(0, least(len(pcm), {RATE * 3 // 2}) - {RATE // 2}) END AS n, CASE WHEN user_id % 4 = 0 THEN 'incomplete' WHEN user_id % 5 = 0 THEN 'empty' WHEN user_id % 7 = 0 THEN 'no track' END AS error FROM x", FAILURES, _LEVELS))
def sample_slices(spark, sf):
    """Stretches of recordings that voice samples point at, and why some have none."""
    tracks = _audio(spark, sf).select("user_id", "rate", "samples")
    samples = tracks.select("user_id", F.when(F.col("user_id") % 4 != 0, 0.5).alias("start_sec"), F.when(F.col("user_id") % 5 != 0, 1.5).otherwise(0.5).alias("end_sec"))
    got = P.sample_audio(samples, tracks.where("user_id % 7 <> 0"), "user_id")
    return got.select("user_id", F.size("slice").cast("long").alias("n"), "error")


@query(sql("SELECT call_id, CASE call_id % 3 WHEN 1 THEN call_id * 2 WHEN 2 THEN call_id * 5 END AS bytes FROM calls", CALLS))
def audio_byte_totals(spark, sf):
    """Bytes of the tracks of each call: none, one or both."""
    c = calls(spark, sf).select("call_id")
    mic = c.where("call_id % 3 > 0").withColumn("bytes", F.col("call_id") * 2)
    return P.byte_totals(c, mic.unionByName(c.where("call_id % 3 = 2").withColumn("bytes", F.col("call_id") * 3)))


_CUTS = "cuts AS (SELECT call_id, CASE WHEN call_id % 7 <> 0 THEN duration_sec % 900 - 20 END AS duration_sec, CASE WHEN call_id % 3 <> 0 THEN call_id % 1000 * 500 END AS cutoff_ms, call_id % 900 * 1000 AS length_ms FROM calls)"


@query(sql("SELECT call_id, track, CASE WHEN cutoff_ms IS NULL THEN length_ms ELSE least(length_ms, CASE WHEN duration_sec IS NULL THEN cutoff_ms ELSE greatest(duration_sec, 0) * 1000 END) END AS keep_ms, cutoff_ms, CASE WHEN cutoff_ms IS NOT NULL THEN 'auto_stopped_on_silence' END AS flag FROM cuts, (SELECT unnest(['mic', 'system']) AS track)", CALLS, _CUTS))
def tails_trimmed(spark, sf):
    """How much of each track stays after a stop on silence, and where its transcript is cut."""
    c = F.col("call_id")
    own = calls(spark, sf).select("call_id", F.when(c % 7 != 0, F.col("duration_sec") % 900 - 20).alias("duration_sec"), F.when(c % 3 != 0, c % 1000 * 500).alias("cutoff_ms"))
    tracks = own.select("call_id", F.explode(F.array(F.lit("mic"), F.lit("system"))).alias("track"), (c % 900 * 1000).alias("length_ms"))
    return P.trimmed_tails(own, tracks)


_RUNS = "r AS (SELECT conv_id, turn, max(text) AS text, CASE WHEN turn % 4 = 3 THEN 'done' ELSE 'pending' END AS status, (conv_id + turn) % 5 = 1 AS mic_fails, (conv_id + turn) % 3 = 1 AS system_fails FROM turns GROUP BY conv_id, turn)"


@query(sql("""SELECT conv_id AS call_id, turn AS chunk_idx, CASE WHEN status = 'done' THEN 'done' WHEN mic_fails THEN 'failed' ELSE 'done' END AS status, CASE WHEN ok THEN text END AS mic,
 CASE WHEN ok AND NOT system_fails THEN 'said: ' || text END AS system, ok AND system_fails AS degraded, CASE WHEN status = 'pending' AND mic_fails THEN 'model_missing' END AS error,
 CASE WHEN ok THEN array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[-5:], ' ') END AS tail FROM (SELECT *, status = 'pending' AND NOT mic_fails AS ok FROM r)""", TURNS, _RUNS))
def chunks_processed(spark, sf):
    """Recognised chunks: a failed microphone fails one, a failed system track leaves it degraded, finished ones stay."""
    t = turns(spark, sf).groupBy(F.col("conv_id").alias("call_id"), F.col("turn").alias("chunk_idx")).agg(F.max("text").alias("text"))
    place = F.col("call_id") + F.col("chunk_idx")
    heard = lambda text, fails, why: t.select("call_id", "chunk_idx", F.when(~fails, text).alias("text"), F.when(fails, why).alias("error"))
    chunks = t.select("call_id", "chunk_idx", F.when(F.col("chunk_idx") % 4 == 3, "done").otherwise("pending").alias("status"))
    return P.processed_chunks(chunks, heard(F.col("text"), place % 5 == 1, "model_missing"), heard(F.concat(F.lit("said: "), "text"), place % 3 == 1, "no_audio"), tail=5)


@query(sql("""SELECT call_id, chunk_idx, tag, p, round(m / sqrt(sum(m * m) OVER (PARTITION BY call_id, chunk_idx, tag)), 4)::DOUBLE AS x FROM (SELECT call_id, chunk_idx, tag, p, avg(x) AS m FROM (SELECT contact_id AS call_id, vec_id % 3 AS chunk_idx, CASE WHEN vec_id % 2 = 0 THEN 'owner' ELSE 'speaker:' || (vec_id % 5) END AS tag, unnest(range(len(vec))) AS p, unnest(vec) AS x FROM vectors) GROUP BY ALL)""", VECTORS))
def chunk_tag_vectors(spark, sf):
    """The mean voice of each tag of a chunk over both tracks, kept as JSON and read back."""
    v = vectors(spark, sf).select(F.col("contact_id").alias("call_id"), (F.col("vec_id") % 3).alias("chunk_idx"), "vec_id", "vec")
    mic = v.where("vec_id % 2 = 0").select("call_id", "chunk_idx", F.lit("owner").alias("tag"), "vec")
    system = v.where("vec_id % 2 = 1").select("call_id", "chunk_idx", F.concat(F.lit("speaker:"), (F.col("vec_id") % 5).cast("string")).alias("tag"), "vec")
    read = P.chunk_vectors(mic, system).select("call_id", "chunk_idx", F.explode(F.from_json("vectors", "map<string,array<double>>")).alias("tag", "v"))
    return read.select("call_id", "chunk_idx", "tag", F.posexplode("v").alias("p", "x")).withColumn("x", F.round("x", 4))


@query(sql("SELECT conv_id AS call_id, turn, CASE WHEN bool_and(turn % 4 <> 3 OR conv_id % 2 = 0) OVER (PARTITION BY conv_id) THEN 'stitched: ' ELSE 'whole: ' END || text AS text FROM turns", TURNS))
def transcripts_chosen(spark, sf):
    """Stitched segments where every chunk of a call is done, else those of the whole file."""
    t = turns(spark, sf).select(F.col("conv_id").alias("call_id"), "turn", "text")
    chunks = t.select("call_id", F.when((F.col("turn") % 4 != 3) | (F.col("call_id") % 2 == 0), "done").otherwise("failed").alias("status"))
    said = lambda how: t.select("call_id", "turn", F.concat(F.lit(f"{how}: "), "text").alias("text"))
    return P.chosen_transcripts(chunks, said("stitched"), said("whole"))


_ENGINE = "CASE call_id % 4 WHEN 0 THEN 'local-qwen-1.5b' WHEN 1 THEN 'local-qwen-3b' WHEN 2 THEN 'local-qwen-7b' ELSE 'local-qwen' END"


@query(sql(f"""SELECT call_id, CASE WHEN good AND call_id % 10 <> 2 THEN 'Recap ' || call_id ELSE title END AS title, CASE WHEN good THEN {_ENGINE} ELSE 'old' END AS engine,
 CASE WHEN call_id % 5 = 1 THEN 'recap_blank_llm_output' WHEN call_id % 5 > 1 THEN NULL ELSE 'timeout' END AS recap_error,
 CASE WHEN good THEN '# ' || CASE WHEN call_id % 10 <> 2 THEN 'Recap ' || call_id ELSE '' END || chr(10) || chr(10) || '## Actions' || chr(10) || '- call ' || provider ELSE 'stored' END AS recap,
 CASE WHEN good THEN 'call ' || provider ELSE 'old item' END AS items, CASE WHEN good AND call_id % 3 = 0 THEN 2 ELSE 1 END AS logged FROM (SELECT *, call_id % 5 > 1 AS good FROM calls)""", CALLS))
def recaps_persisted(spark, sf):
    """Recaps written over stored ones: blank ones are errors, others replace items, title, text and engine and are logged."""
    c = F.col("call_id")
    own = calls(spark, sf).select("call_id", "title", "provider")
    stored = own.select("call_id", "title", F.lit("old").alias("engine"), F.lit("stored").alias("recap"), F.lit("timeout").alias("recap_error"))
    items = own.select("call_id", F.lit("old item").alias("text"))
    log = own.select("call_id", F.lit("old").alias("engine"), F.lit(1).cast("long").alias("generation_ms"))
    model = F.element_at(F.array(*(F.lit(x) for x in ("m-1_5b", "m-3b", "m-7b", "m"))), (c % 4 + 1).cast("int"))
    item = F.struct(F.concat(F.lit("call "), "provider").alias("text"), F.lit(None).cast("string").alias("quote"))
    recaps = own.where("call_id % 5 > 0").select(
        "call_id",
        F.when(c % 10 != 2, F.concat(F.lit("Recap "), c.cast("string"))).otherwise("").alias("title"),
        F.lit(" ").alias("summary"),
        F.array().cast("array<string>").alias("points"),
        F.when(c % 5 == 1, F.array().cast("array<struct<text:string,quote:string>>")).otherwise(F.array(item)).alias("items"),
        model.alias("model"),
        F.when(c % 3 == 0, c).alias("generation_ms"),
    )
    after, kept, logged = P.persisted(stored, items, log, recaps)
    kept = kept.groupBy("call_id").agg(F.max("text").alias("items"))
    return after.join(kept, "call_id", "left").join(logged.groupBy("call_id").agg(F.count(F.lit(1)).alias("logged")), "call_id", "left")


_LETTER = f"substr('{P.LETTERS}', (abs({{}}) % {len(P.LETTERS)})::INT + 1, 1)"
_HASHED = "h AS (SELECT call_id, duration_sec % 2400 AS sec, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(title, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: ((a * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM calls)"


@query(sql("SELECT call_id, array_to_string([" + ", ".join(_LETTER.format(f"h + {i * 7}") + " || " + _LETTER.format(f"h + {i * 13 + 5}") for i in range(3)) + "][1:CASE WHEN sec < 300 THEN 1 WHEN sec < 1800 THEN 2 ELSE 3 END], ',') AS speakers FROM h", CALLS, _HASHED))
def placeholder_speakers(spark, sf):
    """Placeholders for the speakers of calls whose speakers aren't known."""
    return calls(spark, sf).select("call_id", F.array_join(P.pseudo_speakers(F.col("title"), F.col("duration_sec") % 2400), ",").alias("speakers"))


@query(sql("""SELECT call_id AS question_id, -1 AS id, 'contact:' || contact_id AS call_id, 'contact' AS kind, greatest(1, strlen(card) // 4) AS token_est, card AS text
 FROM (SELECT c.call_id, k.contact_id, card, row_number() OVER (PARTITION BY c.call_id ORDER BY is_owner DESC, k.contact_id) AS rank FROM calls c JOIN
  (SELECT contact_id, is_owner, display_name || ', ' || org || '. ' || coalesce(n, 0) || ' calls' AS card FROM contacts LEFT JOIN (SELECT contact_id, count(*) AS n FROM calls GROUP BY 1) USING (contact_id)) k
  ON k.contact_id IN (c.contact_id, c.contact_id + 1, 1)) WHERE rank <= 2""", CALLS, CONTACTS))
def contacts_injected(spark, sf):
    """At most two contacts that a question names, as passages that no index holds."""
    asked = calls(spark, sf).select(F.col("call_id").alias("question_id"), F.concat_ws(" ", F.lit("Who are"), person_name(F.col("contact_id")), person_name(F.col("contact_id") + 1), F.lit("and"), person_name(F.lit(1)), F.lit("?")).alias("question"))
    people = contact_cards(spark, sf).hint("merge").join(contacts(spark, sf).select("contact_id", person_name(F.col("contact_id")).alias("display_name"), (~F.col("is_owner")).cast("int").alias("place")), "contact_id")
    return P.contact_hits(asked, people, "question_id", "question")
