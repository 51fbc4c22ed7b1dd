"""Context for answers: chunks of transcripts, budgets, sources, chats, settings and the tools' views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import questions as Q
from ..functions import text as T
from ..functions import times
from ..operators import folds
from ..operators import relational as R
from ..sources.tables import CALLS, CONTACTS, FAILURES, SPEAKERS, TURNS, calls, contacts, failures, person_name, speakers, sql, table, turns
from .base import query

_BLOCKS = """t AS (SELECT conv_id, turn, row_number() OVER w AS i, block, (sum(strlen(block) + 1) OVER (PARTITION BY conv_id) - 1) // 4 AS whole FROM (SELECT conv_id, turn, '**' || speaker || '** [0:' || lpad((turn % 60)::VARCHAR, 2, '0') || ']:' || chr(10) || text AS block FROM turns) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, block))"""
_PACKED = """c AS (SELECT conv_id, i, 0 AS chunk, block AS cur FROM t WHERE i = 1 UNION ALL
 SELECT conv_id, i, CASE WHEN full_ THEN chunk + 1 ELSE chunk END, CASE WHEN full_ THEN substr(cur, coalesce(list_max(list_filter(heads, lambda h: length(cur) - h + 1 >= 100)), heads[1])) || chr(10) ELSE cur END || chr(10) || block
 FROM (SELECT t.conv_id, t.i, t.block, c.chunk, c.cur, t.whole > 200 AND strlen(c.cur) // 4 + strlen(t.block) // 4 + 1 > 200 AS full_, list_filter(generate_series(1, length(c.cur)), lambda h: (h = 1 OR substr(c.cur, h - 1, 1) = chr(10)) AND starts_with(substr(c.cur, h), '**') AND contains(string_split(substr(c.cur, h), chr(10))[1], ']:')) AS heads
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.i = c.i + 1))"""


@query("WITH RECURSIVE " + ", ".join((TURNS, _BLOCKS, _PACKED)) + " SELECT conv_id, chunk::BIGINT AS chunk, md5(arg_max(cur, i)) AS text, length(arg_max(cur, i)) AS n FROM c GROUP BY conv_id, chunk")
def transcript_chunks(spark, sf):
    """Transcripts in chunks of 200 tokens that overlap by at least 100 characters from a turn's header on."""
    block = F.concat(F.lit("**"), "speaker", F.lit("** [0:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("]:\n"), "text")
    got = folds.block_chunks(turns(spark, sf).select("conv_id", "turn", block.alias("block")), "conv_id", "turn", "block", 200, 100)
    return got.select("conv_id", "chunk", F.md5("text").alias("text"), F.char_length("text").cast("long").alias("n"))


@query(sql("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY extra, turn) AS place, turn AS item FROM (SELECT conv_id, 0 AS extra, turn, sum(strlen(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn, turn ROWS UNBOUNDED PRECEDING) AS run FROM turns) WHERE run + CASE WHEN conv_id % 2 = 0 THEN 60 ELSE 0 END <= 200 OR conv_id % 2 = 1 UNION ALL SELECT DISTINCT conv_id, 99999, -1 FROM turns WHERE false", TURNS).replace(" UNION ALL SELECT DISTINCT conv_id, 99999, -1 FROM turns WHERE false", " UNION ALL SELECT conv_id, 1 + count(*) FILTER (run + 60 <= 200), -1 FROM (SELECT conv_id, sum(strlen(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM turns) WHERE conv_id % 2 = 0 GROUP BY conv_id"))
def priority_injected(spark, sf):
    """Cards of contacts pushed in after the fragments; the lowest ranked give way so that 200 tokens are kept."""
    t = turns(spark, sf)
    cards = t.where("conv_id % 2 = 0").select("conv_id").distinct().select("conv_id", F.lit(1).cast("long").alias("place"), F.lit(-1).cast("long").alias("item"), F.lit(60).cast("long").alias("tokens"))
    fragments = t.select("conv_id", F.col("turn").alias("place"), F.col("turn").cast("long").alias("item"), T.token_estimate(F.col("text")).alias("tokens"))
    return folds.with_priority(fragments, cards, "conv_id", 200).select("conv_id", "place", "item")


_HITS = "t AS (SELECT user_id, event_id, kind <> 'error' AS spoken, s, CASE WHEN event_id % 50 <> 0 THEN s + 7200 END AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM (SELECT *, CASE WHEN event_id % 9 <> 0 THEN floor(epoch_us(ts) / 1000000)::BIGINT END AS s FROM failures))"
_TAKEN = """k AS (SELECT user_id, event_id, i, true AS ok, CASE WHEN s IS NULL THEN [] ELSE [{'a': s, 'b': e}] END AS spans FROM t WHERE i = 1 UNION ALL
 SELECT user_id, event_id, i, ok, CASE WHEN ok AND s IS NOT NULL THEN list_append(spans, {'a': s, 'b': e}) ELSE spans END FROM (SELECT t.*, k.spans, NOT (t.spoken AND t.s IS NOT NULL AND len(list_filter(k.spans, lambda x: x.a <= t.s AND (x.b IS NULL OR t.s < x.b))) > 0) AS ok FROM k JOIN t ON t.user_id = k.user_id AND t.i = k.i + 1))"""


@query("WITH RECURSIVE " + ", ".join((FAILURES, _HITS, _TAKEN)) + " SELECT user_id, event_id FROM k WHERE ok")
def overlaps_dropped(spark, sf):
    """Hits of transcripts that don't start within the span of a better one."""
    f = failures(spark, sf)
    start = F.when(F.col("event_id") % 9 != 0, F.unix_seconds("ts"))
    hits = f.select("user_id", F.col("event_id").alias("rank"), F.col("event_id").alias("item"), (F.col("kind") != "error").alias("is_transcript"), start.alias("start"), F.when(F.col("event_id") % 50 != 0, start + 7200).alias("end"))
    return folds.without_overlaps(hits, "user_id").select("user_id", F.col("item").alias("event_id"))


_RANKED = """h AS (SELECT user_id, event_id, event_id % 7 AS call, kind || (event_id % 23) AS text, kind <> 'error' AS spoken, 1 + event_id % 90 AS tokens, user_id % 2 = 0 AS scoped,
 CASE WHEN event_id % 9 <> 0 THEN floor(epoch_us(ts) / 1000000)::BIGINT END AS s, CASE WHEN event_id % 50 <> 0 THEN floor(epoch_us(ts) / 1000000)::BIGINT + 7200 END AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM failures)"""
_GONE = """k AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, '' AS outcome, 0::BIGINT AS place, 0::BIGINT AS total, []::VARCHAR[] AS texts, []::BIGINT[] AS calls, []::STRUCT(c BIGINT, a BIGINT, b BIGINT)[] AS spans FROM (SELECT DISTINCT user_id FROM h) UNION ALL
 SELECT user_id, i, event_id, outcome, place + ok, total + ok * tokens, CASE WHEN ok = 1 THEN list_append(texts, text) ELSE texts END, CASE WHEN ok = 1 THEN list_append(calls, call) ELSE calls END, CASE WHEN ok = 1 AND s IS NOT NULL THEN list_append(spans, {'c': call, 'a': s, 'b': coalesce(e, 9000000000000)}) ELSE spans END FROM
 (SELECT *, (outcome = 'taken')::INT AS ok FROM (SELECT h.*, k.place, k.total, k.texts, k.calls, k.spans, CASE WHEN list_contains(k.texts, h.text) OR h.spoken AND h.s IS NOT NULL AND len(list_filter(k.spans, lambda x: x.c = h.call AND x.a <= h.s AND h.s < x.b)) > 0 THEN 'duplicate'
  WHEN NOT h.scoped AND len(list_filter(k.calls, lambda x: x = h.call)) >= 3 THEN 'call_full' WHEN k.total + h.tokens > 900 THEN 'over_budget' ELSE 'taken' END AS outcome FROM k JOIN h ON h.user_id = k.user_id AND h.i = k.i + 1)))"""


@query("WITH RECURSIVE " + ", ".join((FAILURES, _RANKED, _GONE)) + " SELECT user_id, event_id, outcome, CASE WHEN outcome = 'taken' THEN place END AS place, total FROM k WHERE i > 0")
def context_assembled(spark, sf):
    """Ranked hits against duplicates, spans taken, calls that are full and a budget, in one pass."""
    f, n = failures(spark, sf), F.col("event_id")
    start = F.when(n % 9 != 0, F.unix_seconds("ts"))
    hits = f.select("user_id", n.alias("rank"), n.alias("passage_id"), (n % 7).alias("call_id"), F.concat("kind", (n % 23).cast("string")).alias("text"), (F.col("kind") != "error").alias("is_transcript"), start.alias("start"),
                    F.when(n % 50 != 0, F.unix_seconds("ts") + 7200).alias("end"), (1 + n % 90).alias("tokens"), (F.col("user_id") % 2 == 0).alias("scoped"))
    return folds.assembled(hits, "user_id", budget=900).select("user_id", F.col("passage_id").alias("event_id"), "outcome", "place", "total")


_USED = "u AS (SELECT call_id, CASE call_id % 4 WHEN 0 THEN [3, 1, 3, 9] WHEN 1 THEN [0, -1] WHEN 2 THEN [2] ELSE []::INT[] END AS raw, call_id % 5 AS n FROM calls)"


@query(sql("SELECT call_id, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE range(0, least(3, n)) END, ',') AS used FROM (SELECT call_id, n, list_transform(list_filter(CASE WHEN call_id % 4 = 0 THEN [3, 1, 9] ELSE raw END, lambda x: x BETWEEN 1 AND n), lambda x: x - 1) AS kept FROM u)", CALLS, _USED))
def fragments_used(spark, sf):
    """Numbers that a model gave for fragments as indexes: those there are, once each, else the first three."""
    from ..operators.answers import used_fragments

    k = F.col("call_id") % 4
    raw = F.when(k == 0, F.array(*map(F.lit, (3, 1, 3, 9)))).when(k == 1, F.array(F.lit(0), F.lit(-1))).when(k == 2, F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))
    return calls(spark, sf).select("call_id", F.array_join(used_fragments(raw, (F.col("call_id") % 5).cast("int")).cast("array<string>"), ",").alias("used"))


@query(sql("SELECT call_id, string_agg(speaker_tag, ',' ORDER BY speaker_tag) AS sources FROM (SELECT DISTINCT call_id, speaker_tag FROM speakers) GROUP BY call_id", SPEAKERS))
def sources_in_order(spark, sf):
    """The distinct sources of an answer in the order in which they first appear."""
    from ..operators.answers import distinct_in_order

    rows = speakers(spark, sf).groupBy("call_id").agg(F.array_sort(F.collect_list("speaker_tag")).alias("tags"))
    return rows.select("call_id", F.array_join(distinct_in_order(F.col("tags")), ",").alias("sources"))


@query(sql("SELECT conv_id, array_to_string(list_reverse(list_reverse(w)[1:5]), ' ') AS tail, right(t, 20) AS ending FROM (SELECT conv_id, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS w, t FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS t FROM turns GROUP BY conv_id))", TURNS))
def tail_words(spark, sf):
    """The last five words of each transcript, and its last characters."""
    whole = turns(spark, sf).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("t"))
    w = F.filter(F.split("t", r"\s+"), lambda x: x != "")
    return whole.select("conv_id", F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - 4), 5), " ").alias("tail"), F.right("t", F.lit(20)).alias("ending"))


@query(sql("SELECT user_id, kind AS step, arg_max(event_id, (ts, event_id)) AS event_id FROM failures GROUP BY ALL", FAILURES))
def steps_latest(spark, sf):
    """The last event of each step of a run: a repeated step replaces its entry."""
    return failures(spark, sf).groupBy("user_id", F.col("kind").alias("step")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(sql("SELECT contact_id, call_id FROM calls QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY md5('7|' || call_id), call_id) <= 2", CALLS))
def calls_sampled(spark, sf):
    """Two calls of each contact drawn without replacement, by a seeded hash: the two are the feature."""
    w = Window.partitionBy("contact_id").orderBy(F.md5(F.concat(F.lit("7|"), F.col("call_id").cast("string"))), "call_id")
    return calls(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 2").select("contact_id", "call_id")


# ---- chats and settings ----------------------------------------------------------------------------------------------

_ANSWERS = """a AS (SELECT conv_id, turn, speaker, CASE WHEN speaker = 'assistant' THEN CASE WHEN turn % 5 = 0 THEN '{broken' ELSE to_json({'text': text, 'fragments': [{'text': left(text, 9)}, {'text': right(text, 9)}]}) END END AS answer, text FROM turns)"""


def _answers(spark, sf):
    t = F.col("text")
    piece = lambda x: F.struct(x.alias("text"))
    json = F.to_json(F.struct(t.alias("text"), F.array(piece(F.substring(t, 1, 9)), piece(F.right(t, F.lit(9)))).alias("fragments")))
    return turns(spark, sf).withColumn("answer", F.when(F.col("speaker") == "assistant", F.when(F.col("turn") % 5 == 0, "{broken").otherwise(json)))


@query(sql("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS place, speaker, CASE WHEN speaker = 'assistant' AND turn % 5 <> 0 THEN text END AS said, CASE WHEN speaker = 'assistant' AND turn % 5 <> 0 THEN right(text, 9) END AS fragment FROM a", TURNS, _ANSWERS))
def chat_history(spark, sf):
    """Messages of chats in order, their stored answers parsed (malformed ones are none), and the second fragment."""
    parsed = F.from_json("answer", "text string, fragments array<struct<text string>>", {"mode": "PERMISSIVE"})
    rows = _answers(spark, sf).withColumn("a", parsed)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1
    return rows.select("conv_id", place.cast("long").alias("place"), "speaker", F.col("a.text").alias("said"), F.try_element_at(F.col("a.fragments"), F.lit(2))["text"].alias("fragment"))


@query(sql("SELECT chat_id, call_id, question FROM (SELECT conv_id AS chat_id, conv_id AS call_id, 'old' AS question FROM turns WHERE conv_id % 3 <> 0 GROUP BY conv_id UNION ALL SELECT -conv_id - 1, conv_id, left(arg_min(text, (turn, text)), 20) FROM turns WHERE conv_id % 3 = 0 GROUP BY conv_id) WHERE call_id % 7 <> 1", TURNS))
def chats_kept(spark, sf):
    """One chat for each call: those there are stay, missing ones are made from the first question, some are deleted."""
    from ..operators import dml

    first = turns(spark, sf).groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("q")).select(F.col("conv_id").alias("call_id"), "q")
    old = first.where("call_id % 3 <> 0").select(F.col("call_id").alias("chat_id"), "call_id", F.lit("old").alias("question"))
    new = first.select((-F.col("call_id") - 1).alias("chat_id"), "call_id", F.substring("q", 1, 20).alias("question"))
    return dml.deleted(dml.inserted_if_absent(old, new, ["call_id"]), first.where("call_id % 7 = 1"), "call_id")


@query("""SELECT n_nationkey AS user_id, CASE WHEN n_nationkey % 4 = 0 THEN 'auto' WHEN n_nationkey % 4 = 1 THEN 'de' ELSE 'auto' END AS lang, least(100, greatest(80, coalesce(CASE WHEN n_nationkey % 5 <> 0 THEN 70 + 2 * n_nationkey END, 90)))::BIGINT AS pct,
 CASE WHEN n_nationkey % 4 = 1 THEN 'de' WHEN n_nationkey % 2 = 0 THEN 'en' END AS recap_lang, n_nationkey % 3 = 0 AS asked FROM nation""")
def settings_resolved(spark, sf):
    """Settings of users with defaults, a percentage held to 80..100, a language that follows the call unless one is set,
    and a seed that depends on another setting."""
    n = F.col("n_nationkey")
    stored = table(spark, sf, "nation").select(n.alias("user_id"), F.when(n % 4 == 1, "de").when(n % 4 == 0, "auto").alias("lang"), F.when(n % 5 != 0, (70 + 2 * n).cast("string")).alias("pct"), F.when(n % 2 == 0, "en").alias("detected"), F.when(n % 3 == 0, "true").alias("captured"))
    lang = F.coalesce("lang", F.lit("auto"))
    pct = F.least(F.lit(100), F.greatest(F.lit(80), F.coalesce(F.col("pct").try_cast("long"), F.lit(90))))
    return stored.select("user_id", lang.alias("lang"), pct.cast("long").alias("pct"), F.when(~lang.isin("auto", ""), lang).otherwise(F.col("detected")).alias("recap_lang"), F.coalesce(F.col("captured") == "true", F.lit(False)).alias("asked"))


# ---- tools and direct answers -------------------------------------------------------------------------------------------


@query(sql("SELECT 'Recorded ' || n || ' calls, ' || ready || ' of them searchable. ' || CASE WHEN total // 60 >= 60 THEN (total // 3600) || ' h ' || (total // 60 % 60) || ' min' ELSE (total // 60) || ' min' END || ' in all.' AS answer FROM (SELECT count(*) AS n, count(*) FILTER (status = 'ready') AS ready, sum(duration_sec)::BIGINT AS total FROM calls)", CALLS))
def stats_answer(spark, sf):
    from ..operators.answers import stats_sentence

    return stats_sentence(calls(spark, sf))


@query(sql("SELECT contact_id, CASE WHEN contact_id % 3 = 0 THEN NULL ELSE display_name || ', ' || org || '. ' || n || ' calls, the last on ' || strftime(last, '%d.%m.%Y') END AS card FROM (SELECT contact_id, any_value(display_name) AS display_name, any_value(org) AS org, count(*) AS n, max(started_at) AS last FROM contacts JOIN calls USING (contact_id) GROUP BY contact_id)", CONTACTS, CALLS))
def who_is(spark, sf):
    """Answers to who somebody is: the card of the contact that is named, if there is one."""
    asked = F.when(F.col("contact_id") % 3 == 0, "Кто это вообще?").otherwise(F.concat(F.lit("кто такой "), "display_name"))
    own = contacts(spark, sf)
    q = own.select("contact_id", Q.asked_name(asked).isNotNull().alias("named"), person_name(F.col("contact_id")).alias("name"))
    people = own.withColumn("display_name", person_name(F.col("contact_id")))
    stats = calls(spark, sf).groupBy("contact_id").agg(F.count(F.lit(1)).alias("n"), F.max("started_at").alias("last"))
    found = R.named_in(q.where("named").select(F.col("contact_id").alias("asked"), "name"), people, "asked", "name").where("asked = contact_id").select("contact_id", F.lit(True).alias("met"))
    card = F.concat("display_name", F.lit(", "), "org", F.lit(". "), F.col("n").cast("string"), F.lit(" calls, the last on "), times.day_text(F.col("last")))
    return own.join(stats, "contact_id").join(found, "contact_id", "left").select("contact_id", F.when(F.col("met"), card).alias("card"))


@query(sql("SELECT c.call_id, title, count(speaker_tag) AS n_speakers, count(*) FILTER (s.confirmed) AS n_confirmed, coalesce(string_agg(speaker_tag, ',' ORDER BY speaker_tag), '') AS tags FROM calls c LEFT JOIN speakers s USING (call_id) GROUP BY c.call_id, title", CALLS, SPEAKERS))
def tool_get_call(spark, sf):
    """A call with its speakers, as the tool gives it."""
    s = speakers(spark, sf).groupBy("call_id").agg(F.array_sort(F.collect_list("speaker_tag")).alias("tags"), F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return calls(spark, sf).join(s, "call_id", "left").select("call_id", "title", F.size(tags).cast("long").alias("n_speakers"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.array_join(tags, ",").alias("tags"))


@query(sql("SELECT call_id, CASE WHEN status = 'ready' AND failed_reason IS NULL AND call_id % 3 <> 0 THEN '# ' || title || chr(10) || 'Said.' ELSE 'No recap for call ' || call_id || '.' END AS recap, status = 'ready' AND (failed_reason IS NOT NULL OR call_id % 3 = 0) AS backlog FROM calls", CALLS))
def tool_get_recap(spark, sf):
    """The recap of each call or a text that there is none, and the ready calls whose recap is missing or blank."""
    c = calls(spark, sf)
    recaps = c.where("status = 'ready' and failed_reason is null").select("call_id", F.when(F.col("call_id") % 3 == 0, "\n# \n").otherwise(F.concat(F.lit("# "), "title", F.lit("\nSaid."))).alias("markdown"))
    from ..functions.documents import is_blank_markdown

    joined = c.join(recaps, "call_id", "left")
    blank = is_blank_markdown(F.col("markdown"))
    return joined.select("call_id", F.when(~blank, F.col("markdown")).otherwise(F.concat(F.lit("No recap for call "), F.col("call_id").cast("string"), F.lit("."))).alias("recap"), ((F.col("status") == "ready") & blank).alias("backlog"))


@query(sql("SELECT call_id, place, who FROM (SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY speaker_tag, who) AS place, who FROM (SELECT DISTINCT s.call_id, s.speaker_tag, coalesce(CASE WHEN s.confirmed THEN display_name END, s.speaker_tag) AS who FROM speakers s LEFT JOIN contacts USING (contact_id)))", SPEAKERS, CONTACTS))
def speaker_names(spark, sf):
    """Speakers of a call by tag, confirmed ones by their name, others by their tag."""
    who = F.coalesce(F.when(F.col("confirmed"), F.col("display_name")), F.col("speaker_tag"))
    rows = speakers(spark, sf).join(contacts(spark, sf).select("contact_id", "display_name"), "contact_id", "left").select("call_id", "speaker_tag", who.alias("who")).distinct()
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("speaker_tag", "who"))
    return rows.select("call_id", place.cast("long").alias("place"), "who")
