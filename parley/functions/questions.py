"""What a question asks for: predicates, topics, periods and routes over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that decide intents, topics and periods; results depend on each of them.
CALL_WORDS = """
    звонок звонка звонке звонков звонки созвон созвона созвоне созвонов созвоны встреча встречи встрече встреч
    встречу запись записи записей
""".split()
DISCUSS_VERBS = "обсуждали обсуждался обсуждалась обсуждалось говорили поднимали упоминали разговаривали затрагивали".split()
WHEN_STRIP = "когда мы вы я раз последний про об обо тему тема".split()
FUNCTION_WORDS = """
    в во на за по с со к ко у о об обо из
    от до при про я мы ты вы он она они мне нам мой
    моя мои моих наш наши это этот эта эти том тот та те там
    тут всех все всего и а но же ли бы не ещё еще уже
    быть был была было были есть
""".split()
RECORDING_WORDS = "записано записан записана записаны записал записали прошло прошли состоялось состоялись".split()
PERIOD_WORDS = """
    сегодня вчера позавчера неделю неделе недели неделя месяц месяца месяце год года году прошлой
    прошлую прошлом прошлый прошлого этом этот текущем назад
""".split()
IMPERATIVES = "напиши составь сгенерируй сгенерь придумай переведи отправь создай запланируй оформи нарисуй".split()
INFINITIVES = "написать составить сгенерировать придумать перевести отправить создать запланировать оформить нарисовать".split()
SUMMARY_WORDS = "суть перескажи пересказ резюме резюмируй саммари итоги кратко".split()
LAST_WORDS = "последний последнего последнем последняя последнюю последней крайний крайняя крайнюю крайней".split()
LIST_WORDS = "какие покажи список перечисли".split()
WHO_STRIP = "кто такой такая такое это вообще".split()
LAST_PERIOD = "прошлой прошлую прошлом прошлый прошлого".split()
MONTHS = "январе января феврале февраля марте марта апреле апреля мае мая июне июня июле июля августе августа сентябре сентября октябре октября ноябре ноября декабре декабря".split()  # two forms each
PARKED = "local_engine_not_ready local_engine_model_missing local_engine_model_tampered local_engine_preset_not_set".split()


def question_words(question: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.filter(F.split(F.lower(F.coalesce(question, F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")


def _any(words: Column, of: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, of)))


def is_generative_word(word: Column) -> Column:
    """An infinitive of writing, or an imperative with or without its plural ending."""
    return word.isin(*INFINITIVES) | word.isin(*IMPERATIVES) | F.regexp_replace(word, "те$", "").isin(*IMPERATIVES)


def is_generative(question: Column) -> Column:
    return F.exists(question_words(question), is_generative_word)


def wants_summary(question: Column) -> Column:
    """A word that asks for a summary, or `о` before `чём` or `чем`."""
    ws = question_words(question)
    pair = F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" ")).rlike(" о (чём|чем) ")
    return _any(ws, SUMMARY_WORDS) | pair


def has_topic_beyond(question: Column, triggers: list[str]) -> Column:
    """Whether a word is left that is no trigger, call, function, recording or period word."""
    known = [*triggers, *CALL_WORDS, *FUNCTION_WORDS, *RECORDING_WORDS, *PERIOD_WORDS]
    return F.exists(question_words(question), lambda w: ~w.isin(*known))


def discussed_topic(question: Column) -> Column:
    """What is left of a question about when something was discussed; null if nothing is."""
    rest = F.array_join(F.filter(question_words(question), lambda w: ~w.isin(*WHEN_STRIP, *DISCUSS_VERBS)), " ")
    return F.when(rest != "", rest)


def asked_name(question: Column) -> Column:
    """The words of `who is ...` without those around the name; null if nothing is left."""
    rest = F.array_join(F.filter(question_words(question), lambda w: ~w.isin(*WHO_STRIP)), " ")
    return F.when(rest != "", rest)


def route(question: Column, scoped: Column) -> Column:
    """summary (in the scope of a call), stats, last, last_summary, when, list, who or none: the first that fits."""
    ws = question_words(question)
    has = lambda w: F.array_contains(ws, w)
    call = _any(ws, CALL_WORDS)
    return (
        F.when(F.coalesce(scoped, F.lit(False)) & wants_summary(question), "summary")
        .when(has("сколько") & call & ~has_topic_beyond(question, ["сколько"]), "stats")
        .when(_any(ws, LAST_WORDS) & call, F.when(wants_summary(question), "last_summary").otherwise("last"))
        .when(has("когда") & _any(ws, DISCUSS_VERBS), "when")
        .when(_any(ws, LIST_WORDS) & call & ~has_topic_beyond(question, LIST_WORDS), "list")
        .when(has("кто") & _any(ws, ["такой", "такая", "такое", "это"]), "who")
        .otherwise("none")
    )


def period(question: Column, today: Column) -> Column:
    """struct(since, until) of dates that a question names, until being null where it is open; null without a period.

    In this order: today, yesterday, the day before, weeks, months, years, months by name (one still to come is last
    year's), quarters. `Last` means the calendar period before; else a period reaches back from today.
    """
    ws = question_words(question)
    has = lambda *w: _any(ws, list(w))
    last, ago = has(*LAST_PERIOD), has("назад")
    back = lambda n: F.date_sub(today, n)
    span = lambda a, b=None: F.struct(a.cast("date").alias("since"), (F.lit(None) if b is None else b).cast("date").alias("until"))
    monday, month, year, quarter = (F.trunc(today, x) for x in ("week", "month", "year", "quarter"))
    out = F.when(has("сегодня"), span(today)).when(has("вчера"), span(back(1), today)).when(has("позавчера"), span(back(2), back(1)))
    out = out.when(has("неделю", "неделе", "недели", "неделя"), F.when(last | ago, span(F.date_sub(monday, 7), monday)).otherwise(span(back(7))))
    out = out.when(has("месяц", "месяца", "месяце"), F.when(last | ago, span(F.add_months(month, -1), month)).otherwise(span(back(31))))
    in_year = F.when(last, span(F.add_months(year, -12), year)).when(has("этом", "этот", "текущем"), span(year)).when(ago, span(back(365)))
    out = out.when(has("году", "года", "год"), in_year)
    for i in range(12):
        first = F.add_months(year, F.lit(i) - F.when(F.month(today) < i + 1, 12).otherwise(0))
        out = out.when(has(*MONTHS[2 * i : 2 * i + 2]), span(first, F.add_months(first, 1)))
    return out.when(has("квартал", "квартала", "квартале"), F.when(last, span(F.add_months(quarter, -3), quarter)).otherwise(span(back(92))))


def is_askable(question: Column, most: int = 2000) -> Column:
    """Not blank and of at most `most` characters after trimming."""
    size = F.char_length(F.trim(F.coalesce(question, F.lit(""))))
    return (size > 0) & (size <= most)


def word_matches(asked: Column, name: Column) -> Column:
    """The same word, or the asked one goes on for three characters at most after a name of three and more."""
    return (F.char_length(name) >= 3) & asked.startswith(name) & (F.char_length(asked) - F.char_length(name) <= 3)


def is_parked(reason: Column) -> Column:
    """A failure that mends itself once the local engine is complete."""
    out = F.lit(False)
    for marker in PARKED:
        out = out | F.coalesce(reason.contains(marker), F.lit(False))
    return out


def failure_kind(reason: Column) -> Column:
    has = lambda x: reason.contains(x)
    return (
        F.when(reason.isNull() | (reason == ""), "generic").when(is_parked(reason), "parked").when(has("model_missing"), "model_missing").when(has("timeout"), "timeout")
        .when(has("oom") | has("low_resources"), "low_resources").when(has("local_audio_decode_failed") | has("ERR_INVALID_FORMAT"), "broken_recording").otherwise("generic")
    )
