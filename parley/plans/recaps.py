"""Clean-up, compaction and rendering of recaps made from the turns of conversations and from calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recap as R
from ..sources.tables import CALLS, TURNS, calls, sql, turns
from .base import query

# Items of a conversation: the first eight words of each turn, quoted right, changed or not at all.
_ITEMS = """i AS (SELECT conv_id, turn, text AS whole, array_to_string(string_split(text, ' ')[1:8], ' ') AS text, CASE turn % 3 WHEN 0 THEN substr(text, 3, 30) WHEN 1 THEN '#' || reverse(substr(text, 3, 30)) END AS quote FROM turns)"""


def _items(spark, sf):
    t = F.col("text")
    quote = F.when(F.col("turn") % 3 == 0, F.substring(t, 3, 30)).when(F.col("turn") % 3 == 1, F.concat(F.lit("#"), F.reverse(F.substring(t, 3, 30))))
    return turns(spark, sf).select("conv_id", "turn", t.alias("whole"), F.array_join(F.slice(F.split(t, " "), 1, 8), " ").alias("text"), quote.alias("quote"))


@query(sql("SELECT conv_id, turn, CASE WHEN trim(quote) <> '' AND contains(whole, quote) THEN quote END AS quote FROM i WHERE trim(text) <> ''", TURNS, _ITEMS))
def quotes_stripped(spark, sf):
    """Items with the quotes that their turn doesn't hold taken off; items without text go."""
    rows = _items(spark, sf).select("conv_id", "turn", R.stripped(F.array(F.struct("text", "quote")), F.col("whole")).alias("kept"))
    return rows.select("conv_id", "turn", F.explode("kept").alias("k")).select("conv_id", "turn", F.col("k.quote").alias("quote"))


_UNLIKE = """w AS (SELECT conv_id, turn, text, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM i),
 k AS (SELECT conv_id, n, [text] AS kept, [w] AS held FROM w WHERE n = 1 UNION ALL SELECT conv_id, n, CASE WHEN ok THEN list_append(kept, text) ELSE kept END, CASE WHEN ok THEN list_append(held, w) ELSE held END
  FROM (SELECT w.*, k.kept, k.held, len(list_filter(k.held, lambda h: len(list_distinct(list_concat(h, w.w))) > 0 AND len(list_intersect(h, w.w)) >= 0.7 * len(list_distinct(list_concat(h, w.w))))) = 0 AS ok FROM k JOIN w ON w.conv_id = k.conv_id AND w.n = k.n + 1))"""


@query("WITH RECURSIVE " + ", ".join((TURNS, _ITEMS, _UNLIKE)) + " SELECT conv_id, md5(array_to_string(arg_max(kept, n), '|')) AS kept, len(arg_max(kept, n)) AS n FROM k GROUP BY conv_id")
def items_deduplicated(spark, sf):
    """The items of each recap without those alike to one before."""
    rows = _items(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("items"))
    kept = R.unlike_items(F.col("items"))
    return rows.select("conv_id", F.transform(kept, lambda k: k["text"]).alias("k")).select("conv_id", F.md5(F.array_join("k", "|")).alias("kept"), F.size("k").cast("long").alias("n"))


# Recaps of turns: their sentences as items (every second with a quote, every fourth a wrong one), twice as decisions, and
# those with a comma as open questions; every tenth turn has a recap of nothing.
_SENTENCES = """s AS (SELECT conv_id * 1000 + turn AS call_id, text AS whole, CASE WHEN turn % 10 = 9 THEN [] ELSE list_filter(list_transform(string_split(text, '.'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') END AS w FROM turns),
 n AS (SELECT call_id, whole, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS i, len(w) AS size FROM s),
 f AS (SELECT call_id, 'action_items' AS list, i, text, CASE WHEN i % 4 = 0 THEN text END AS quote FROM n UNION ALL SELECT call_id, 'decisions', i, text, NULL FROM n UNION ALL SELECT call_id, 'open_questions', i, text, NULL FROM n WHERE contains(text, ','))"""
_FIRST = """o AS (SELECT *, list_distinct(string_split(lower(text), ' ')) AS words, row_number() OVER (PARTITION BY call_id, list ORDER BY i) AS r FROM f),
 k AS (SELECT call_id, list, r, text, quote, true AS ok, [words] AS held FROM o WHERE r = 1 UNION ALL SELECT o.call_id, o.list, o.r, o.text, o.quote, o.ok, CASE WHEN o.ok THEN list_append(o.held, o.words) ELSE o.held END FROM
  (SELECT o.*, k.held, len(list_filter(k.held, lambda h: len(list_intersect(h, o.words)) >= 0.7 * len(list_distinct(list_concat(h, o.words))))) = 0 AS ok FROM k JOIN o ON o.call_id = k.call_id AND o.list = k.list AND o.r = k.r + 1) o)"""


@query("WITH RECURSIVE " + ", ".join((TURNS, _SENTENCES, _FIRST)) + """ SELECT call_id, list, row_number() OVER (PARTITION BY call_id, list ORDER BY r) - 1 AS place, text, quote FROM k WHERE ok
 UNION ALL SELECT call_id, unnest(['action_items', 'decisions', 'open_questions']), 0, 'old', NULL FROM s WHERE len(w) = 0""")
def recap_lists_persisted(spark, sf):
    """Recaps cleaned and written over the three tables of their call; blank ones change nothing."""
    from ..operators import processing

    t = turns(spark, sf)
    said = F.filter(F.transform(F.split("text", r"\."), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    rows = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"), F.col("text").alias("whole"), F.when(F.col("turn") % 10 == 9, F.array().cast("array<string>")).otherwise(said).alias("w"))
    none = F.lit(None).cast("string").alias("quote")
    quote = lambda x, i: F.when(i % 4 == 0, F.concat(x, F.lit("  "))).when(i % 4 == 2, F.reverse(F.concat(x, F.lit("#!#!#!"), x)))
    items = F.transform("w", lambda x, i: F.struct(x.alias("text"), quote(x, i).alias("quote")))
    plain = F.transform("w", lambda x: F.struct(x.alias("text"), none))
    asked = F.transform(F.filter("w", lambda x: x.contains(",")), lambda x: F.struct(x.alias("text"), none))
    recaps = rows.select("call_id", "whole", items.alias("action_items"), F.concat(plain, plain).alias("decisions"), asked.alias("open_questions"), F.array(F.struct(F.lit("a").alias("tag"), F.lit("A").alias("name"))).alias("participants"))
    old = rows.select("call_id", F.lit(0).cast("long").alias("place"), F.lit("old").alias("text"), none)
    tables, _ = processing.persisted_lists({n: old for n in R.LISTS}, R.cleaned(recaps, "whole"))
    out = [df.withColumn("list", F.lit(n)) for n, df in tables.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("call_id", "list", "place", "text", F.trim("quote").alias("quote"))


_PEOPLE = """p AS (SELECT call_id, place, CASE place WHEN 0 THEN 'speaker:0' WHEN 1 THEN ' Speaker:0' WHEN 2 THEN 'speaker:1' WHEN 3 THEN 'speaker:2' ELSE 'speaker:2' END AS tag,
 CASE place WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob' WHEN 2 THEN CASE WHEN call_id % 2 = 0 THEN ' ANN ' ELSE 'Cid' END WHEN 3 THEN CASE WHEN call_id % 3 = 0 THEN NULL ELSE 'cid' END ELSE 'Dan' END AS name FROM calls, generate_series(0, 4) g(place))"""
_SEEN = "t AS (SELECT *, row_number() OVER (PARTITION BY call_id, lower(trim(tag)) ORDER BY place) AS tag_no FROM p)"


@query(sql("SELECT call_id, string_agg(place, ',' ORDER BY place) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY call_id, lower(trim(coalesce(name, ''))) ORDER BY place) AS name_no FROM t WHERE tag_no = 1) WHERE name_no = 1 OR coalesce(trim(name), '') = '' GROUP BY call_id", CALLS, _PEOPLE, _SEEN))
def participants_deduplicated(spark, sf):
    c = F.col("call_id")
    person = lambda place, tag, name: F.struct(F.lit(place).alias("place"), F.lit(tag).alias("tag"), name.alias("name"))
    people = F.array(person(0, "speaker:0", F.lit("Ann")), person(1, " Speaker:0", F.lit("Bob")), person(2, "speaker:1", F.when(c % 2 == 0, " ANN ").otherwise("Cid")), person(3, "speaker:2", F.when(c % 3 != 0, "cid")), person(4, "speaker:2", F.lit("Dan")))
    return calls(spark, sf).select("call_id", F.array_join(F.transform(R.distinct_participants(people), lambda p: p["place"].cast("string")), ",").alias("kept"))


@query(sql("SELECT conv_id, 'legacy-' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1) AS id, text, 'commitment' AS category, NULL::DOUBLE AS due_confidence FROM i", TURNS, _ITEMS))
def legacy_promoted(spark, sf):
    """Items of the first schema as those of the second."""
    rows = _items(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", F.lit(None).cast("string").alias("due")))).alias("items"))
    return rows.select("conv_id", F.explode(R.promoted(F.col("items"))).alias("i")).select("conv_id", "i.id", "i.text", "i.category", "i.due_confidence")


_LISTED = "l AS (SELECT conv_id, list(text ORDER BY turn, text) AS texts, list(quote ORDER BY turn, text) AS quotes, string_agg(whole, ' ' ORDER BY turn, text) AS whole FROM i GROUP BY conv_id)"


def _listed(spark, sf):
    rows = _items(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "quote", "whole"))).alias("r"))
    return rows.select("conv_id", F.transform("r", lambda x: F.struct(x["text"].alias("text"), x["quote"].alias("quote"))).alias("items"), F.array_join(F.transform("r", lambda x: x["whole"]), " ").alias("whole"))


@query(sql("SELECT conv_id, len(texts[1:2]) AS n, list_transform(quotes[1:2], lambda q: left(q, 10))[1] AS quote, substr(whole, 1, 40) || ' | ' || array_to_string(list_transform(texts[1:3], lambda t: substr(t, 1, 40)), ' | ') AS preview FROM (SELECT * FROM l) WHERE trim(whole) <> ''", TURNS, _ITEMS, _LISTED))
def recaps_capped(spark, sf):
    """Lists cut to two items with quotes of ten characters, and a preview."""
    few = R.shortened_quotes(R.capped(F.col("items"), 2), 10)
    shown = R.preview(F.col("whole"), F.transform("items", lambda i: i["text"]), 40)
    return _listed(spark, sf).select("conv_id", F.size(few).cast("long").alias("n"), few[0]["quote"].alias("quote"), shown.alias("preview")).where("preview is not null")


@query(sql("""SELECT conv_id, n > 0 AS has_items, least(size, 601) AS shown FROM (SELECT conv_id, len(texts) AS n, length(whole) AS size FROM l)""", TURNS, _ITEMS, _LISTED))
def recaps_compacted(spark, sf):
    """Recaps within a budget that none can meet: lists capped, quotes gone, the summary cut to 600 characters."""
    doc = R.compacted(F.col("whole"), F.transform("items", lambda i: i["text"]), F.col("items"), 1)
    rows = _listed(spark, sf).select("conv_id", doc.alias("doc"))
    return rows.select("conv_id", (F.size(F.from_json(F.get_json_object("doc", "$.action_items"), "array<string>")) > 0).alias("has_items"), F.char_length(F.get_json_object("doc", "$.summary")).cast("long").alias("shown"))


@query(sql("SELECT conv_id, '# Conv ' || conv_id || CASE WHEN trim(whole) <> '' THEN chr(10) || chr(10) || whole ELSE '' END || chr(10) || chr(10) || '## Key points' || chr(10) || array_to_string(list_transform(texts[1:2], lambda t: '- ' || t), chr(10)) || chr(10) || chr(10) || '## Actions' || chr(10) || array_to_string(list_transform(list_zip(texts, quotes), lambda z: '- ' || z[1] || coalesce(' — ' || z[2], '')), chr(10)) AS markdown FROM l", TURNS, _ITEMS, _LISTED))
def recaps_rendered(spark, sf):
    points = F.transform(R.capped(F.col("items"), 2), lambda i: i["text"])
    made = R.rendered(F.concat(F.lit("Conv "), F.col("conv_id").cast("string")), F.col("whole"), points, F.col("items"))
    return _listed(spark, sf).select("conv_id", made.alias("markdown"))


_ANSWERED = """a AS (SELECT call_id, CASE call_id % 6 WHEN 0 THEN 'Sales ' WHEN 1 THEN 'standup' WHEN 2 THEN 'karaoke' WHEN 3 THEN NULL WHEN 4 THEN 'INTERVIEW' ELSE 'support' END AS kind, CASE call_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 1.7 WHEN 2 THEN -0.4 ELSE (call_id % 100) / 100.0 END AS confidence, CASE WHEN call_id % 2 = 0 THEN 'en' END AS language FROM calls)"""


@query(sql("SELECT call_id, CASE WHEN lower(trim(kind)) IN ('sales', 'standup', 'interview', 'support') THEN lower(trim(kind)) ELSE 'other' END AS call_type, round(CASE WHEN confidence IS NULL THEN 0.5 ELSE least(1, greatest(0, confidence)) END, 4)::DOUBLE AS confidence, coalesce(language, 'auto') AS language FROM a", CALLS, _ANSWERED))
def classifier_answers(spark, sf):
    """Types, confidences and languages read from a classifier's JSON answers of every shape."""
    c = F.col("call_id")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("Sales ", "standup", "karaoke", None, "INTERVIEW", "support"))), (c % 6 + 1).cast("int"))
    share = F.when(c % 5 == 1, 1.7).when(c % 5 == 2, -0.4).when(c % 5 > 2, c % 100 / 100.0)
    json = F.to_json(F.struct(kind.alias("call_type"), share.alias("confidence"), F.when(c % 2 == 0, "en").alias("language")))
    got = R.classified(json)
    return calls(spark, sf).select("call_id", got["call_type"].alias("call_type"), F.round(got["confidence"], 4).alias("confidence"), got["language"].alias("language"))


@query(sql("SELECT call_id, round((least(5, greatest(1, call_id % 8)) + least(5, greatest(1, call_id % 3 - 1)) + 1 + 3.5) / 4, 4)::DOUBLE AS score FROM calls", CALLS))
def judge_scores(spark, sf):
    """The mean of four scores from a judge's JSON: too high, too low, missing and fine ones."""
    c = F.col("call_id")
    json = F.to_json(F.struct((c % 8).alias("accuracy"), (c % 3 - 1).alias("coverage"), F.lit(3.5).alias("brevity")))
    return calls(spark, sf).select("call_id", F.round(R.judged(json), 4).alias("score"))


@query(sql("SELECT call_id, CASE WHEN trim(title) = '' OR call_id % 4 = 0 THEN 'Untitled' ELSE trim(title) END AS title, call_id % 2 = 0 AND call_id % 4 <> 0 AS valid, CASE WHEN call_id % 3 = 0 THEN '[{\"x\":1}]' ELSE '[]' END AS items FROM calls", CALLS))
def refined_states(spark, sf):
    """Titles of answers with a fallback, states that are valid, and refined lists merged only if they are lists."""
    c = F.col("call_id")
    said = F.to_json(F.struct(F.when(c % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "title", F.lit(" "))).alias("title"), F.when(c % 2 == 0, 2).otherwise(1).alias("schema_version")))
    title = F.trim(F.get_json_object(said, "$.title"))
    refined = F.when(c % 3 == 0, '[{"x":1}]').when(c % 3 == 1, '{"x":1}')
    valid = (F.get_json_object(said, "$.schema_version") == "2") & (title != "")
    is_list = F.coalesce(F.schema_of_variant(F.try_parse_json(refined)).startswith("ARRAY"), F.lit(False))
    return calls(spark, sf).select("call_id", F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")).alias("title"), valid.alias("valid"), F.when(is_list, refined).otherwise("[]").alias("items"))


@query(sql("SELECT conv_id, turn, CASE WHEN trim(text) <> '' THEN text || coalesce(' — quote: ' || quote, '') END AS passage, length(left(whole, 6000)) AS title_head, length(left(whole, 12000)) AS judge_head FROM i", TURNS, _ITEMS))
def structured_passages(spark, sf):
    """Items as passages with their quote, and heads of transcripts for titles and judges."""
    made = F.when(F.trim("text") != "", F.concat("text", F.coalesce(F.concat(F.lit(" — quote: "), "quote"), F.lit(""))))
    head = lambda n: F.char_length(F.substring("whole", 1, n)).cast("long")
    return _items(spark, sf).select("conv_id", "turn", made.alias("passage"), head(6000).alias("title_head"), head(12000).alias("judge_head"))
