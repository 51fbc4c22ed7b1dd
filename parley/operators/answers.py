"""Assembly of grounded prompts and of direct answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def prompts(fragments: DataFrame, key: str, order: str) -> DataFrame:
    """key, prompt: numbered fragments in order, their markers made harmless."""
    numbered = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.replace(x["text"], F.lit("<<<"), F.lit("‹‹‹"))))
    return fragments.groupBy(key).agg(F.array_join(numbered, "\n").alias("prompt"))


def references(answer: Column, n: Column) -> Column:
    """The numbers in [1, 2] lists of an answer that name one of n fragments, in order, once each."""
    lists = F.regexp_extract_all(answer, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), 1)
    numbers = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, r"\s*,\s*"))), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: x.between(1, n)))


def used_fragments(numbers: Column, n: Column, otherwise: int = 3) -> Column:
    """Numbers from 1 that a model gave as indexes of n fragments, once each in their order; the first ones if none fits."""
    kept = F.array_distinct(F.transform(F.filter(numbers, lambda x: x.between(1, n)), lambda x: x - 1))
    first = F.when(n > 0, F.sequence(F.lit(0), F.least(F.lit(otherwise), n) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(kept) > 0, kept).otherwise(first)


def distinct_in_order(items: Column) -> Column:
    return F.array_distinct(items)


def stats_sentence(calls: DataFrame) -> DataFrame:
    """answer: how many calls there are, how many can be searched and how long they are together."""
    s = calls.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ready").alias("ready"), F.coalesce(F.sum("duration_sec"), F.lit(0)).alias("total"))
    minutes = F.floor(F.col("total") / 60).cast("long")
    length = F.when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), (minutes % 60).cast("string"), F.lit(" min"))).otherwise(F.concat(minutes.cast("string"), F.lit(" min")))
    return s.select(F.concat(F.lit("Recorded "), F.col("n").cast("string"), F.lit(" calls, "), F.col("ready").cast("string"), F.lit(" of them searchable. "), length, F.lit(" in all.")).alias("answer"))
