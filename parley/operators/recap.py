"""Checks and clean-up of structured recaps, and deduplication of their items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .graph import stored

FOUND = 0.90

ITEM = T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("quote", T.StringType())])
RECAP = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("key_points", T.ArrayType(T.StringType())),
        T.StructField("action_items", T.ArrayType(ITEM)),
        T.StructField("topics", T.ArrayType(T.StringType())),
    ]
)


def parsed(json: Column) -> Column:
    """The recap document; null for malformed text."""
    return F.from_json(json, RECAP, {"mode": "PERMISSIVE"})


def problems(recap: Column) -> Column:
    """What is wrong with a recap: blank title or summary, 3 to 7 key points, confidences from 0 to 1."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    n = F.coalesce(F.size(recap["key_points"]), F.lit(0))
    odd = F.exists(F.coalesce(recap["action_items"], F.array().cast(T.ArrayType(ITEM))), lambda i: F.coalesce((i["confidence"] < 0) | (i["confidence"] > 1), F.lit(False)))
    found = F.array(
        F.when(blank(recap["title"]), "title"), F.when(blank(recap["summary"]), "summary"), F.when(~n.between(3, 7), "key_points"), F.when(odd, "confidence")
    )
    return F.filter(found, lambda p: p.isNotNull())


#: Characters of a quote that are compared where it doesn't occur as it is.
MOST_QUOTE = 200


def _bits(needle: str) -> dict[str, int]:
    marks: dict[str, int] = {}
    for i, c in enumerate(needle):
        marks[c] = marks.get(c, 0) | 1 << i
    return marks


def _distances(marks: dict[str, int], m: int, text: str, anywhere: bool) -> list[int]:
    """The edit distance of a needle of m characters (as bits) to the text up to each place; if anywhere, to the nearest
    stretch that ends there. A column of the table is two numbers, so a character costs a few operations."""
    all_, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, out = all_, 0, m, []
    for c in text:
        eq = marks.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        rise, fall = (down | ~(across | up)) & all_, up & across
        if rise & high:
            score += 1
        elif fall & high:
            score -= 1
        rise, fall = rise << 1 | (not anywhere), fall << 1
        up, down = (fall | ~(eq | down | rise)) & all_, rise & (eq | down) & all_
        out.append(score)
    return out


def best_window(needle: str, text: str, least: float = 0.0, most: int = MOST_QUOTE) -> float:
    """1 if the needle occurs, else the best similarity (1 less the edit distance over the length) of its first `most`
    characters with a stretch of their length, or with the whole of a shorter text. Both are lower-cased, with one blank
    between words.

    No window is nearer than the nearest stretch that ends with it, so windows are tried from the lowest bound on until
    no other can be better, or reach `least`: a similarity below that may be given as 0.
    """
    needle, text = " ".join(needle.lower().split()), " ".join(text.lower().split())
    if not needle:
        return 0.0
    if needle in text:
        return 1.0
    needle = needle[:most]
    m, marks = len(needle), _bits(needle)
    if len(text) <= m:
        return 1 - (_distances(marks, m, text, False)[-1] if text else m) / m
    far = int((1 - least) * m + 1e-9)
    bounds = _distances(marks, m, text, True)[m - 1 :]
    best = m
    for bound, start in sorted((b, i) for i, b in enumerate(bounds) if b <= far):
        if bound >= best:
            break
        best = min(best, _distances(marks, m, text[start : start + m], False)[-1])
    return 1 - best / m if best <= far else 0.0


def quote_scores(quotes: Column, text: Column, least: float = 0.0) -> Column:
    """best_window() of each quote (an array) in a text; null quotes and texts count as empty."""
    @F.pandas_udf("array<double>")
    def run(own: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[best_window(q or "", t or "", least) for q in qs] if qs is not None else None for qs, t in zip(own, texts, strict=True)])

    return run(quotes, text)


def window_similarity(haystack: Column, needle: Column, least: float = 0.0) -> Column:
    return quote_scores(F.array(needle), haystack, least)[0]


def evidence_state(quote: Column, score: Column) -> Column:
    return F.when(quote.isNull(), "missing").when(F.trim(quote) == "", "empty").when(score < FOUND, "not_found").otherwise("ok")


def keep_unlike(rows: DataFrame, key: str, order: str, text: str, most: float = 0.7) -> DataFrame:
    """rows with kept: a row stays unless its words are at least `most` alike (Jaccard) to a row kept before it.

    Rows of equal words fall to the first of them. Others meet under their rarest words: with the words of a key in one
    order, alike sets share one of their first n - ceil(most n) + 1. What is kept is then settled in rounds: a row that
    no undecided row before it is alike to stays, and the later ones alike to it go. Rows without words stay.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != ""))
    own = stored(rows.select(key, order, text, words.alias("_w")).withColumn("_id", F.monotonically_increasing_id()))
    same = F.array_sort("_w")
    nodes = own.where(F.size("_w") > 0).groupBy(key, same.alias("_w")).agg(F.min(F.struct(order, text, F.col("_id").alias("id"))).alias("_at"))
    # From here on rows go by their number within the key; texts and word lists meet only where a pair is verified.
    nodes = stored(nodes.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy("_at"))).select(key, "_w", "_i", F.col("_at.id").alias("_id")))
    met = nodes.select(key, "_i", F.size("_w").alias("n"), F.explode("_w").alias("w"))
    counts = met.groupBy(key, "w").agg(F.count(F.lit(1)).alias("df"))
    ranked = met.join(counts, [key, "w"]).groupBy(key, "_i", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))
    first = ranked.select(key, "_i", "n", F.posexplode(F.expr(f"slice(ws, 1, n - cast(ceil({most} * n - 1e-9) as int) + 1)")).alias("p", "x")).where("x.df > 1").select(key, "_i", "n", "p", "x.w")
    a, b = (first.select(key, "w", *(F.col(c).alias(f"{c}_{s}") for c in ("_i", "n", "p"))) for s in ("a", "b"))
    # At the first word that two sets share, no more than what follows it in either can be shared.
    near = a.join(b, [key, "w"]).where("_i_a < _i_b").where(f"least(n_a - p_a, n_b - p_b) >= {most / (1 + most)} * (n_a + n_b) - 1e-9").select(key, "_i_a", "_i_b").distinct()
    of = lambda s: nodes.select(key, F.col("_i").alias(f"_i_{s}"), F.col("_id").alias(f"id_{s}"), F.col("_w").alias(f"w_{s}"))
    both = F.size(F.array_intersect("w_a", "w_b"))
    edges = near.join(of("a"), [key, "_i_a"]).join(of("b"), [key, "_i_b"]).where(both >= most * (F.size("w_a") + F.size("w_b") - both)).select("id_a", "id_b")
    edges, gone = stored(edges), None
    while not edges.isEmpty():
        later = edges.select(F.col("id_b").alias("id_a")).distinct()
        drop = stored(edges.join(later, "id_a", "left_anti").select(F.col("id_b").alias("id")).distinct())
        gone = drop if gone is None else gone.unionByName(drop)
        left = edges.join(drop.select(F.col("id").alias("id_b")), "id_b", "left_anti").join(drop.select(F.col("id").alias("id_a")), "id_a", "left_anti")
        edges = stored(left.join(later, "id_a", "left_semi"))
    kept = nodes.select("_id")
    if gone is not None:
        kept = kept.join(gone.select(F.col("id").alias("_id")), "_id", "left_anti")
    joined = own.join(kept.withColumn("_kept", F.lit(True)), "_id", "left")
    return joined.select(key, order, text, (F.coalesce("_kept", F.lit(False)) | (F.size("_w") == 0)).alias("kept"))


# ---- clean-up of nested recaps ---------------------------------------------------------------------------------------


def stripped(items: Column, transcript: Column, least: float = FOUND) -> Column:
    """Items (text, quote) without blank texts; quotes that the transcript doesn't hold become null."""
    kept = F.filter(items, lambda i: F.trim(i["text"]) != "")
    scores = quote_scores(F.transform(kept, lambda i: i["quote"]), transcript, least)
    held = F.zip_with(kept, scores, lambda i, s: F.struct(i.alias("i"), s.alias("s")))
    return F.transform(held, lambda h: h["i"].withField("quote", F.when(F.coalesce(F.trim(h["i"]["quote"]) != "", F.lit(False)) & (h["s"] >= least), h["i"]["quote"])))


#: The lists of a recap that are checked and deduplicated alike.
LISTS = ("action_items", "decisions", "open_questions")


def cleaned(recaps: DataFrame, transcript: str, most: float = 0.7) -> DataFrame:
    """recaps whose LISTS lose unproven quotes, blank items and those alike to one before, and whose participants (tag,
    name) are distinct; each list is held against itself only. Null lists are empty."""
    for name in LISTS:
        recaps = recaps.withColumn(name, stripped(F.coalesce(name, F.array().cast(recaps.schema[name].dataType)), F.col(transcript)))
    for name in LISTS:
        recaps = recaps.withColumn(name, unlike_items(F.col(name), most))
    return recaps.withColumn("participants", distinct_participants(F.coalesce("participants", F.array().cast(recaps.schema["participants"].dataType))))


def unlike_items(items: Column, most: float = 0.7) -> Column:
    """Items (text) that aren't `most` alike (Jaccard of words) to one kept before; items of one recap are few."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    both = F.transform(items, lambda i: F.struct(i.alias("i"), words(i["text"]).alias("w")))

    def add(kept, item):
        def alike(k):
            shared = F.size(F.array_intersect(item["w"], k["w"]))
            union = F.size(item["w"]) + F.size(k["w"]) - shared
            return (union > 0) & (shared >= most * union)

        return F.when(F.exists(kept, alike), kept).otherwise(F.array_append(kept, item))

    kept = F.transform(F.array(both), lambda own: F.aggregate(own, F.slice(own, 1, 0), add))[0]  # words are split once
    return F.transform(kept, lambda k: k["i"])


def distinct_participants(people: Column) -> Column:
    """People (tag, name) of whom neither the tag nor the name (if there is one) came before; case and blanks around
    don't count. A tag counts as seen even if its row goes because of the name."""
    tag = lambda p: F.lower(F.trim(p["tag"]))
    name = lambda p: F.lower(F.trim(F.coalesce(p["name"], F.lit(""))))
    first = F.filter(people, lambda p, i: ~F.exists(F.slice(people, F.lit(1), i), lambda q: tag(q) == tag(p)))
    return F.filter(first, lambda p, i: (name(p) == "") | ~F.exists(F.slice(first, F.lit(1), i), lambda q: name(q) == name(p)))


def promoted(items: Column) -> Column:
    """Items of the first recap schema (text, due) as those of the second: numbered, commitments, without confidences."""
    return F.transform(items, lambda a, i: F.struct(F.concat(F.lit("legacy-"), i.cast("string")).alias("id"), a["text"].alias("text"), a["due"].alias("due"), F.lit("commitment").alias("category"), F.lit(None).cast("double").alias("due_confidence"), F.lit(None).cast("string").alias("quote")))


def capped(items: Column, most: int) -> Column:
    return F.slice(items, 1, most)


def shortened_quotes(items: Column, most: int = 100) -> Column:
    return F.transform(items, lambda i: i.withField("quote", F.substring(i["quote"], 1, most)))


def without_quotes(items: Column) -> Column:
    return F.transform(items, lambda i: i.dropFields("quote"))


def capped_topics(topics: Column, most: int, points: int) -> Column:
    """The first topics (title, points), each with its first points."""
    return F.transform(F.slice(topics, 1, most), lambda t: t.withField("points", F.slice(t["points"], 1, points)))


def compacted(summary: Column, points: Column, items: Column, budget: int) -> Column:
    """The JSON of a recap within a budget of tokens: whole, else with shorter quotes, else without, else with capped
    lists, else with a shortened summary too. The first that fits is taken, the last whether it fits or not."""
    doc = lambda s, p, i: F.to_json(F.struct(s.alias("summary"), p.alias("key_points"), i.alias("action_items")))
    few_points, few_items = capped(points, 12), capped(without_quotes(items), 12)
    short = F.when(F.char_length(summary) > 600, F.concat(F.substring(summary, 1, 600), F.lit("…"))).otherwise(summary)
    stages = [doc(summary, points, items), doc(summary, points, shortened_quotes(items)), doc(summary, points, without_quotes(items)), doc(summary, few_points, few_items)]
    fits = lambda d: F.floor(F.octet_length(d) / 4) <= budget
    return F.coalesce(*(F.when(fits(d), d) for d in stages), doc(short, few_points, few_items))


def preview(title: Column, points: Column, most: int = 120) -> Column:
    """The title and up to three key points, each of at most `most` characters; null for a blank title."""
    return F.when(F.trim(title) != "", F.array_join(F.transform(F.concat(F.array(title), F.slice(points, 1, 3)), lambda x: F.substring(x, 1, most)), " | "))


def classified(answer: Column) -> Column:
    """struct(call_type, confidence, language) of a classifier's JSON: unknown types are other, the confidence is 0.5
    unless given and held to 0..1, the language is auto unless given."""
    from ..functions.documents import call_type, clamped

    field = lambda f: F.get_json_object(answer, f"$.{f}")
    return F.struct(call_type(field("call_type")).alias("call_type"), clamped(field("confidence").try_cast("double"), 0.0, 1.0, 0.5).alias("confidence"), F.coalesce(field("language"), F.lit("auto")).alias("language"))


def judged(answer: Column, names: tuple[str, ...] = ("accuracy", "coverage", "clarity", "brevity")) -> Column:
    """The mean of a judge's scores in JSON, each held to 1..5; a missing one is 1."""
    score = lambda n: F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.coalesce(F.get_json_object(answer, f"$.{n}").try_cast("double"), F.lit(1.0))))
    total = F.lit(0.0)
    for n in names:
        total = total + score(n)
    return total / len(names)


def rendered(title: Column, summary: Column, points: Column, items: Column) -> Column:
    """Markdown with the sections that have something to say, in a fixed order."""
    bullets = lambda head, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"## {head}\n"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), r)), "\n")))
    lines = F.transform(items, lambda i: F.concat(i["text"], F.coalesce(F.concat(F.lit(" — "), i["quote"]), F.lit(""))))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.when(F.trim(summary) != "", summary), bullets("Key points", points), bullets("Actions", lines))
