"""Searches of many questions: what is written and moved, and how the best are picked."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import hybrid, lexical, vectors

from .test_search import PASSAGES, asked, brute_search, found, some_passages


def test_no_rows_between_questions_and_zones_are_written(spark, monkeypatch):
    """Tables that a search writes grow with its terms and with its passes, not with the product of passes and zones."""
    monkeypatch.setattr(lexical, "ZONE_ROWS", 5)
    index, q = lexical.build_index(spark.createDataFrame(some_passages(), PASSAGES)), asked(spark)
    many = q.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("question_id", F.col("question_id") + 100 * F.col("copy")).drop("copy")
    write, made = lexical.stored, []
    monkeypatch.setattr(lexical, "stored", lambda df, name: (out := write(df, name), made.append(out.count()))[0])
    rows = {}
    for name, asks in (("few", q), ("many", many)):
        made.clear()
        rows[name] = found(lexical.search(index, asks, lexical.passes(asks), 3))
        rows[name, "written"] = sorted(made)
    assert rows["few"] == brute_search(some_passages(), 3)
    assert rows["many"] == {(k + 100 * c, part, rank): v for (k, part, rank), v in rows["few"].items() for c in range(10)}
    passes = lexical.passes(q).count()
    assert sum(rows["many", "written"]) <= sum(rows["few", "written"]) + 9 * passes


def test_texts_are_moved_after_ranks(spark):
    rows = some_passages(40)
    passages = spark.createDataFrame(rows, PASSAGES)
    q = asked(spark).withColumn("vec", F.lit(None).cast("array<double>"))
    got = hybrid.hybrid(lexical.build_index(passages), passages, q, None)
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    top = next(i for i, line in enumerate(lines) if "Window" in line)
    below = [line for line in lines[top:] if line]
    below = below[: next((i for i, line in enumerate(below[1:], 1) if depth(line) <= depth(below[0])), len(below))]
    assert len(below) > 3 and not [line for line in below if "text#" in line.split("LogicalRDD")[0] and "Project" in line]
    assert got.count()


@pytest.mark.parametrize("n", [1, 3, 12, 40])
def test_the_best_of_many_ties(n):
    rnd = np.random.default_rng(n)
    for rows in (0, 1, 127, 128, 129, 128 * n, 128 * (n + 1), 9000):
        for kinds in (1, 2, 50, 10**6):
            score = rnd.integers(0, kinds + 1, rows) / 7
            score += rnd.choice([0.0, 2e-10, 3e-10], rows) * (score > 0)  # equal once rounded
            padded = np.zeros(-(-rows // lexical.SCORES) * lexical.SCORES)
            padded[:rows] = score
            rounded = np.round(score, lexical.DIGITS)
            want = [i for i in np.lexsort((np.arange(rows), -rounded)) if score[i] > 0][:n]
            places = lexical._best(padded, n) if rows else np.zeros(0, dtype=np.int64)
            assert [int(x) for x in places[np.argsort(-rounded[places], kind="stable")[:n]]] == want
            both = np.stack([np.where(score > 0, score, -np.inf), np.full(rows, -np.inf)]) if rows else np.zeros((2, 0))
            at, columns = vectors._candidates(both, n)
            want = [i for i in np.lexsort((np.arange(rows), -np.round(score, 12))) if score[i] > 0][:n]
            assert set(want) <= set(columns[at == 0].tolist()) and not (at == 1).any()


def test_scopes_are_exact_beyond_floats(spark):
    """Times above 2^53, at the edge of a period."""
    big = 2**53
    rows = [(i, "a", big + i, "ёлка") for i in range(4)]
    index = lexical.build_index(spark.createDataFrame(rows, PASSAGES))
    q = spark.createDataFrame([(1, "ёлка", None, big + 1, big + 3)], "question_id long, question string, call_id string, since long, until long")
    assert {r.passage_id for r in lexical.search(index, q, lexical.passes(q), 3).collect()} == {1, 2}
