"""Questions: intents, topics, periods, names and the failures they may hit. The answers in the SQL were worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import questions as Q
from ..operators import relational as R
from ..sources.tables import CALLS, CONTACTS, calls, contacts, person_name, person_name_sql, sql
from .base import query

ASKED = (
    "Сколько звонков было за неделю?",
    "Сколько задач раздали на встрече?",
    "Напишите письмо клиенту",
    "Надо составить план",
    "О чём был последний созвон?",
    "Когда была последняя встреча?",
    "Когда мы обсуждали бюджет проекта?",
    "Покажи звонки за прошлый месяц",
    "Какие решения приняли на встрече?",
    "Кто такая Анна Петрова?",
    "Написали ли итоги?",
    "Когда говорили?",
)
PERIODS = ("сегодня", "что вчера", "позавчера", "за неделю", "на прошлой неделе", "месяц назад", "за месяц", "в прошлом году", "в этом году", "год назад", "год", "в июне", "за прошлый квартал", "за квартал", "без срока")
_ANSWERS = "answers(k, generative, summary, route, topic) AS (VALUES (0, false, false, 'stats', NULL::VARCHAR), (1, false, false, 'none', NULL::VARCHAR), (2, true, false, 'none', NULL::VARCHAR), (3, true, false, 'none', NULL::VARCHAR), (4, false, true, 'last_summary', NULL::VARCHAR), (5, false, false, 'last', NULL::VARCHAR), (6, false, false, 'when', 'бюджет проекта'), (7, false, false, 'list', NULL::VARCHAR), (8, false, false, 'none', NULL::VARCHAR), (9, false, false, 'who', NULL::VARCHAR), (10, false, true, 'none', NULL::VARCHAR), (11, false, false, 'when', NULL::VARCHAR))"


def _asked(spark, sf, texts):
    return calls(spark, sf).withColumn("question", F.element_at(F.array(*map(F.lit, texts)), (F.col("call_id") % len(texts) + 1).cast("int")))


@query(sql("SELECT call_id, generative, summary FROM calls JOIN answers ON k = call_id % 12", CALLS, _ANSWERS))
def question_intents(spark, sf):
    """Whether a question wants something written, or a summary."""
    q = F.col("question")
    return _asked(spark, sf, ASKED).select("call_id", Q.is_generative(q).alias("generative"), Q.wants_summary(q).alias("summary"))


@query(sql("SELECT call_id, CASE WHEN status = 'ready' AND summary THEN 'summary' ELSE route END AS route FROM calls JOIN answers ON k = call_id % 12", CALLS, _ANSWERS))
def question_router(spark, sf):
    """The route of each question; questions about ready calls stand in the scope of the call."""
    return _asked(spark, sf, ASKED).select("call_id", Q.route(F.col("question"), F.col("status") == "ready").alias("route"))


@query(sql("SELECT call_id, topic FROM calls JOIN answers ON k = call_id % 12 WHERE route = 'when'", CALLS, _ANSWERS))
def question_topics(spark, sf):
    asked = _asked(spark, sf, ASKED).where(Q.route(F.col("question"), F.lit(False)) == "when")
    return asked.select("call_id", Q.discussed_topic(F.col("question")).alias("topic"))


@query(sql("SELECT call_id, CASE k WHEN 0 THEN d WHEN 1 THEN d-1 WHEN 2 THEN d-2 WHEN 3 THEN d-7 WHEN 4 THEN date_trunc('week', d)::DATE-7 WHEN 5 THEN (date_trunc('month', d) - INTERVAL 1 MONTH)::DATE WHEN 6 THEN d-31 WHEN 7 THEN (date_trunc('year', d) - INTERVAL 1 YEAR)::DATE WHEN 8 THEN date_trunc('year', d)::DATE WHEN 9 THEN d-365 WHEN 10 THEN NULL WHEN 11 THEN (date_trunc('year', d) + INTERVAL 5 MONTH - INTERVAL (CASE WHEN month(d) < 6 THEN 12 ELSE 0 END) MONTH)::DATE WHEN 12 THEN (date_trunc('quarter', d) - INTERVAL 3 MONTH)::DATE WHEN 13 THEN d-92 WHEN 14 THEN NULL END AS since, CASE k WHEN 0 THEN NULL WHEN 1 THEN d WHEN 2 THEN d-1 WHEN 3 THEN NULL WHEN 4 THEN date_trunc('week', d)::DATE WHEN 5 THEN date_trunc('month', d)::DATE WHEN 6 THEN NULL WHEN 7 THEN date_trunc('year', d)::DATE WHEN 8 THEN NULL WHEN 9 THEN NULL WHEN 10 THEN NULL WHEN 11 THEN (date_trunc('year', d) + INTERVAL 6 MONTH - INTERVAL (CASE WHEN month(d) < 6 THEN 12 ELSE 0 END) MONTH)::DATE WHEN 12 THEN date_trunc('quarter', d)::DATE WHEN 13 THEN NULL WHEN 14 THEN NULL END AS until FROM (SELECT call_id, call_id % 15 AS k, started_at::DATE AS d FROM calls)", CALLS))
def question_periods(spark, sf):
    """The days that a question names, as seen from the day of the call."""
    p = Q.period(F.col("question"), F.to_date("started_at"))
    return _asked(spark, sf, PERIODS).select("call_id", p["since"].alias("since"), p["until"].alias("until"))


@query(sql("SELECT call_id, trim(title) <> '' AND length(trim(text)) BETWEEN 1 AND 40 AS askable FROM (SELECT *, CASE call_id % 3 WHEN 0 THEN '   ' WHEN 1 THEN title ELSE title || title || title END AS text FROM calls)", CALLS))
def askable_questions(spark, sf):
    text = F.when(F.col("call_id") % 3 == 0, "   ").when(F.col("call_id") % 3 == 1, F.col("title")).otherwise(F.concat("title", "title", "title"))
    return calls(spark, sf).select("call_id", Q.is_askable(text, 40).alias("askable"))


_NAMED = f"asked AS (SELECT call_id, {person_name_sql('contact_id')} || CASE call_id % 3 WHEN 1 THEN 'xyz' WHEN 2 THEN 'wxyz' ELSE '' END AS w FROM calls)"


@query(sql("SELECT DISTINCT call_id, contacts.contact_id FROM asked JOIN contacts ON starts_with(w, " + person_name_sql("contacts.contact_id") + ") AND length(w) <= 12", CALLS, CONTACTS, _NAMED))
def names_in_questions(spark, sf):
    """Contacts whose name is a word of the question, with an ending of three characters at most."""
    ending = F.when(F.col("call_id") % 3 == 1, "xyz").when(F.col("call_id") % 3 == 2, "wxyz").otherwise("")
    named = F.concat(F.lit("Who called "), F.upper(F.regexp_replace(person_name(F.col("contact_id")), "#1", "")), ending, F.lit("#2, then?"))
    asked = calls(spark, sf).select("call_id", named.alias("question"))
    people = contacts(spark, sf).withColumn("display_name", person_name(F.col("contact_id")))
    return R.named_in(asked, people, "call_id", "question").select("call_id", "contact_id")


_HINTS = "hints AS (SELECT call_id, CASE call_id % 4 WHEN 0 THEN ' CUSTOMER#' || lpad(contact_id::VARCHAR, 9, '0') WHEN 1 THEN 'the customer#' || lpad(contact_id::VARCHAR, 9, '0') || ' team' WHEN 2 THEN '  ' ELSE '#' || lpad((contact_id // 100)::VARCHAR, 7, '0') END AS hint FROM calls)"


@query(sql("""SELECT call_id, first(contact_id ORDER BY name <> h, contact_id) AS contact_id FROM (SELECT call_id, lower(trim(hint)) AS h FROM hints) JOIN (SELECT contact_id, lower(display_name) AS name FROM contacts) ON h <> '' AND (contains(name, h) OR contains(h, name)) GROUP BY call_id""", CALLS, CONTACTS, _HINTS))
def owners_by_hint(spark, sf):
    """The contact that a hint names: the same name, else the first of which either holds the other."""
    padded = F.lpad(F.col("contact_id").cast("string"), 9, "0")
    k = F.col("call_id") % 4
    hint = F.when(k == 0, F.concat(F.lit(" CUSTOMER#"), padded)).when(k == 1, F.concat(F.lit("the customer#"), padded, F.lit(" team"))).when(k == 2, "  ").otherwise(F.concat(F.lit("#"), F.lpad(F.floor(F.col("contact_id") / 100).cast("string"), 7, "0")))
    hints = calls(spark, sf).select("call_id", hint.alias("hint"))
    return R.owner_of_hint(hints, contacts(spark, sf), "call_id", "hint")


_REASONS = "r AS (SELECT call_id, CASE call_id % 9 WHEN 0 THEN 'x local_engine_not_ready' WHEN 1 THEN 'local_engine_model_missing' WHEN 2 THEN 'cloud model_missing' WHEN 3 THEN 'a timeout' WHEN 4 THEN 'oom killed' WHEN 5 THEN 'ERR_INVALID_FORMAT' WHEN 6 THEN '' WHEN 7 THEN failed_reason ELSE 'low_resources' END AS reason, call_id % 9 AS k FROM calls)"


@query(sql("SELECT call_id, k IN (0, 1) AS parked, CASE k WHEN 0 THEN 'parked' WHEN 1 THEN 'parked' WHEN 2 THEN 'model_missing' WHEN 3 THEN 'timeout' WHEN 4 THEN 'low_resources' WHEN 5 THEN 'broken_recording' WHEN 8 THEN 'low_resources' ELSE 'generic' END AS kind FROM r", CALLS, _REASONS))
def failure_kinds(spark, sf):
    texts = ["x local_engine_not_ready", "local_engine_model_missing", "cloud model_missing", "a timeout", "oom killed", "ERR_INVALID_FORMAT", ""]
    k = F.col("call_id") % 9
    reason = F.when(k == 8, "low_resources").when(k == 7, F.col("failed_reason")).otherwise(F.element_at(F.array(*map(F.lit, texts)), F.least(k + 1, F.lit(7)).cast("int")))
    return calls(spark, sf).withColumn("reason", reason).select("call_id", Q.is_parked(F.col("reason")).alias("parked"), Q.failure_kind(F.col("reason")).alias("kind"))


@query(sql("SELECT call_id, CASE WHEN provider = '1-URGENT' OR starts_with(coalesce(failed_reason, ''), 'local') THEN 'local' WHEN call_id % 2 = 0 THEN 'cloud_byo' WHEN provider <> '5-LOW' THEN 'cloud_managed' END AS via FROM calls", CALLS))
def processing_routes(spark, sf):
    from ..functions.labels import processing_via

    provider = F.when(F.col("provider") == "1-URGENT", "local").when(F.col("provider") == "5-LOW", "").otherwise(F.col("provider"))
    return calls(spark, sf).select("call_id", processing_via(F.col("failed_reason"), provider, F.when(F.col("call_id") % 2 == 0, "byo")).alias("via"))
