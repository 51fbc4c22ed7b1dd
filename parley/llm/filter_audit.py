"""How five document filters interact under all orders, by difference arrays over permutation ranks.

A document is a mask of the filters that it fails. In an order it goes at the first of its filters, so the orders in
which it goes at step k through filter f are those that begin with k - 1 filters outside the mask and then f. Numbered
lexicographically (by Lehmer code), the orders of one beginning are an interval of (5 - k)! ranks. Counts are added at
the start of every interval and taken away behind its end; a running sum over the 120 ranks gives the totals.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import UPPER, join_groups, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
#: What stands between words.
WHITE = r"[\x20\x09-\x0D]+"


def lehmer_rank(order: str) -> int:
    """The place of an order among all permutations of its letters, from 0, in lexicographic order."""
    return sum(sum(b < a for b in order[i + 1 :]) * math.factorial(len(order) - 1 - i) for i, a in enumerate(order))


def intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step, first, end): in the orders of the ranks first to end - 1 a document of the mask goes at the step."""
    found = []
    for step in range(1, len(FILTERS) + 1):
        for head in itertools.permutations(range(len(FILTERS)), step):
            rest = [i for i in range(len(FILTERS)) if i not in head]
            first = lehmer_rank("".join(FILTERS[i] for i in (*head, *rest)))
            passed = sum(1 << i for i in head[:-1])
            for mask in range(1, 1 << len(FILTERS)):
                if mask >> head[-1] & 1 and not mask & passed:
                    found.append((mask, step, first, first + math.factorial(len(rest))))
    return found


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: the documents of each part and mask, counted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", WHITE), lambda w: w != ""))
    sizes = (F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).alias("distinct"), F.char_length("text").cast("long").alias("chars"))
    rows = rows.select("doc_id", "part", "text", *sizes, F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"))
    failures = [
        F.col("n") < 100,
        100 * F.col("distinct") < 80 * F.col("n"),
        100 * (F.col("chars") - F.char_length(F.translate("text", UPPER, ""))) > 10 * F.col("chars"),
        F.translate("text", "#$%&*|", "") != F.col("text"),
    ]
    own = sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(failures)), F.lit(0))
    rows = written(rows.select("doc_id", "part", "digest", own.alias("own")), "audit-rows")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = join_groups(rows, written(copies, "audit-copies"), "digest", "n", rows.count())
    mask = F.col("own") + F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    rows = rows.groupBy("doc_id", "part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("docs"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic"))).where("quality = 1 or toxic = 1")
    marked = rows.where("doc_id is not null").join(marks, "doc_id", "left").unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    weights = (F.sum(F.when(F.col(c) == 1, F.col("docs")).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic")))
    return marked.groupBy("part", "mask").agg(F.sum("docs").alias("docs"), *weights)


def interactions(counts: DataFrame) -> DataFrame:
    """The 600 rows of each part from its masks (part, mask, docs, good, toxic): at most 32 rows of a part come in."""
    spark = counts.sparkSession
    ends = F.broadcast(spark.createDataFrame(intervals(), "mask int, step int, first int, end int"))  # 651 rows, whatever the data
    measures = ("docs", "good", "toxic")
    met = counts.join(ends, "mask")
    up = met.select("part", "step", F.col("first").alias("rank"), *measures)
    down = met.select("part", "step", F.col("end").alias("rank"), *((-F.col(m)).alias(m) for m in measures))
    steps = up.unionByName(down).groupBy("part", "step", "rank").agg(*(F.sum(m).alias(m) for m in measures))

    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("docs")).otherwise(0)) for i in range(5)]
    only = [F.sum(F.when(F.col("mask") == 1 << i, F.col("docs")).otherwise(0)) for i in range(5)]
    parts = counts.groupBy("part").agg(F.sum("docs").alias("total"), F.array(*fails).alias("fails"), F.array(*only).alias("only"))
    grid = parts.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("rank"))
    filled = grid.join(steps, ["part", "step", "rank"], "left")
    running = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = filled.select("part", "step", "rank", "total", "fails", "only", *(F.sum(F.coalesce(m, F.lit(0))).over(running).alias(m) for m in measures))
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("rank") + 1)
    named = summed.withColumn("filter_order", order).withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    place = F.ascii("letter") - ord(FILTERS[0]) + 1
    before = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return named.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("docs").over(before)).alias("kept"),
        F.col("docs").alias("removed"),
        (F.element_at("fails", place) - F.col("docs")).alias("redundant"),
        F.element_at("only", place).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("docs").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Failing: A under 100 words; B 100 distinct words < 80 words; C 100 `[A-Z]` > 10 code points; D any of `#$%&*|`; E the
    same text (told by SHA-256) with a smaller doc_id. A null text is empty, a null lang the part '', and a null doc_id
    neither smaller nor larger than others and without labels. Rows of one doc_id count each; equal rows aren't copies of
    each other, as their doc_id isn't smaller. A document with several labels is good (toxic) if one of them says so.
    Texts may be of any length; an empty table has no part and gives no rows. Other columns are not read.
    """
    return interactions(written(masked(docs, labels), "audit-masks"))


def interactions_sql() -> str:
    """The same rows, document by document and order by order."""
    tests = {
        "A": "len(w) < 100",
        "B": "100 * len(list_distinct(w)) < 80 * len(w)",
        "C": f"100 * (length(t) - length(translate(t, '{UPPER}', ''))) > 10 * length(t)",
        "D": r"regexp_matches(t, '[#$%&*|]')",
        "E": "coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)",
    }
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, max(coalesce(quality, 0)) = 1 AS good, max(coalesce(toxic, 0)) = 1 AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat({", ".join(f"CASE WHEN {t} THEN '{k}' ELSE '' END" for k, t in tests.items())}) AS fails
              FROM d LEFT JOIN l USING (doc_id)),
        o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order
              FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) a, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) b, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) c,
                   (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) d, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) e
              WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, step, filter_order[step] AS letter FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
        m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
        r AS (SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS hit, fails = letter AS sole, translate(filter_order[:step - 1], fails, '') = filter_order[:step - 1] AS there
              FROM m, s),
        t AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (there AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (there AND hit), 0) AS removed,
                     coalesce(sum(n) FILTER (hit AND NOT there), 0) AS redundant, coalesce(sum(n) FILTER (sole), 0) AS unique_fails,
                     coalesce(sum(good) FILTER (there AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (there AND hit), 0) AS toxic_lost
              FROM r GROUP BY part, filter_order, step, letter)
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
               good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
        FROM t"""
