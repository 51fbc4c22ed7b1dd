"""Tables of questions against tables of vectors, as products of blocks.

Questions and items are dealt into blocks; every block of items meets every block of questions in a task of its own and
gives the best of each question there, and these are merged. No side is broadcast, and a task holds two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import best_of
from .relational import consent_given

#: Rows of a block, about, and questions that are multiplied at once.
QUESTIONS, ITEMS, AT_ONCE = 4096, 8192, 256
#: Numbers that are held by their greatest to find the best.
SCORES = 128


def _dealt(rows: DataFrame, key: str, own: str, other: str, parts: int, others: int) -> DataFrame:
    """rows, each in its own block and sent to every block of the other side."""
    return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def _unit(vectors: list, size: int) -> np.ndarray:
    """Vectors over their lengths; those of (nearly) no length, or with numbers that aren't finite, are zero."""
    m = np.array(vectors, dtype=np.float64).reshape(-1, size)
    with np.errstate(all="ignore"):
        norm = np.sqrt((m * m).sum(1))
        good = np.isfinite(norm) & (norm > 1e-12)
        return np.where(good[:, None], m / np.where(good, norm, 1.0)[:, None], 0.0)


def _candidates(product: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the numbers that may be among the n greatest of their row, rounded, in the order of rows."""
    wide = -(-product.shape[1] // SCORES)
    if wide <= n:
        return np.nonzero(product > -np.inf)
    padded = np.full((len(product), wide * SCORES), -np.inf)
    padded[:, : product.shape[1]] = product
    # So many numbers of different groups reach the n-th of the groups' greatest.
    least = np.partition(padded.reshape(len(product), wide, SCORES).max(2), -n, axis=1)[:, -n] - 1e-11
    return np.nonzero((product >= least[:, None]) & (product > -np.inf))


def _best_rows(n: int, least: float, grouped: bool):
    """For a cogroup of items and questions of one length: question_id, part, item, score of the n best of each."""

    def run(items: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"question_id": pa.array([], asked.schema.field("question_id").type), "part": pa.array([], pa.int32()), "item": pa.array([], items.schema.field("item").type), "score": pa.array([], pa.float64())})
        if not items.num_rows or not asked.num_rows:
            return empty
        items = items.sort_by("item")
        size = items.column("size")[0].as_py()
        unit, wanted = _unit(items.column("vec").to_pylist(), size), _unit(asked.column("vec").to_pylist(), size)
        calls = {c: i for i, c in enumerate(set(items.column("call_id").to_pylist()) - {None})}
        code = lambda column: np.array([-1 if c is None else calls.get(c, -2) for c in column.to_pylist()])
        call, only, other = code(items.column("call_id")), code(asked.column("only_call")), code(asked.column("other_than"))
        names = {r: i for i, r in enumerate(dict.fromkeys(items.column("row").to_pylist()))}
        row = np.array([names[r] for r in items.column("row").to_pylist()])
        skip = np.array([names.get(x, -1) for x in asked.column("skip").to_pylist()])
        whole = lambda column, missing: np.array([missing if x is None else float(x) for x in column.to_pylist()])
        at, since, until = whole(items.column("at"), np.nan), whole(asked.column("since"), -np.inf), whole(asked.column("until"), np.inf)
        timed = np.array([a is not None or b is not None for a, b in zip(asked.column("since").to_pylist(), asked.column("until").to_pylist(), strict=True)])
        ids = np.array(items.column("item").to_pylist(), dtype=object)
        first = np.append(True, ids[1:] != ids[:-1]) if grouped else np.ones(len(ids), dtype=bool)
        starts = np.flatnonzero(first)
        q, where, scores = [], [], []
        for a in range(0, len(wanted), AT_ONCE):
            part = slice(a, a + AT_ONCE)
            product = wanted[part] @ unit.T
            out = (only[part, None] != -1) & (only[part, None] != call[None, :])
            out |= (other[part, None] != -1) & ((other[part, None] == call[None, :]) | (call[None, :] == -1))
            out |= timed[part, None] & ~((at[None, :] >= since[part, None]) & (at[None, :] < until[part, None]))
            out |= skip[part, None] == row[None, :]
            product[out] = -np.inf
            if grouped:
                product = np.maximum.reduceat(product, starts, axis=1)
            product = np.where(product >= least, product, -np.inf)
            rows, places = _candidates(product, n)
            score = product[rows, places]
            # The first n in falling order of score and rising order of item: columns stand in that order already.
            best = np.lexsort((places, -np.round(score, 12), rows))
            ends = np.searchsorted(rows, np.arange(len(product)))
            best = best[np.arange(len(best)) - ends[rows] < n]
            q.append(rows[best] + a)
            where.append(starts[places[best]])
            scores.append(score[best])
        at_q, at_i = np.concatenate(q), np.concatenate(where)
        return pa.table({"question_id": asked.column("question_id").take(pa.array(at_q)), "part": asked.column("part").cast(pa.int32()).take(pa.array(at_q)), "item": items.column("item").take(pa.array(at_i)), "score": pa.array(np.round(np.concatenate(scores), 12), pa.float64())})

    return run


def nearest(items: DataFrame, asked: DataFrame, n: int, item: str = "passage_id", least: float = -1.0, grouped: bool = False, row: str | None = None) -> DataFrame:
    """question_id, part, item, score, rank: the n items of the greatest cosine of each question, ties by item.

    items: item, vec and, if there, call_id and at; asked: question_id, part, vec and, if there, only_call, other_than,
    since, until (as in lexical.passes()) and skip (a row that the question doesn't meet, named by the items' column
    `row`). If grouped, an item (a contact) has several rows and its score is the greatest of them. Vectors of another
    length than the question's aren't met, those without length have the score 0; scores below `least` are left out.
    """
    has = lambda df, c, t, name=None: (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(name or c)
    row = row or item
    kind = items.schema[row].dataType.simpleString()
    vec = F.transform("vec", lambda x: x.cast("double")).alias("vec")
    own = items.where("vec is not null").select(F.col(item).alias("item"), F.col(row).alias("row"), vec, F.size("vec").alias("size"), has(items, "call_id", "string"), has(items, "at", "long"))
    ask = asked.where("vec is not null").select("question_id", "part", vec, F.size("vec").alias("size"), has(asked, "only_call", "string"), has(asked, "other_than", "string"), has(asked, "since", "long"), has(asked, "until", "long"), has(asked, "skip", kind))
    parts = [max(1, -(-df.count() // most)) for df, most in ((own, ITEMS), (ask, QUESTIONS))]
    by = ["size", "of_items", "of_questions"]
    left = _dealt(own, "row", "of_items", "of_questions", *parts).groupBy(*by)
    right = _dealt(ask, "question_id", "of_questions", "of_items", parts[1], parts[0]).groupBy(*by)
    ids = asked.schema["question_id"].dataType.simpleString(), items.schema[item].dataType.simpleString()
    found = left.cogroup(right).applyInArrow(_best_rows(n, least, grouped), f"question_id {ids[0]}, part int, item {ids[1]}, score double")
    if grouped:
        found = found.groupBy("question_id", "part", "item").agg(F.max("score").alias("score"))
    return best_of(found.withColumnRenamed("item", item), ["question_id", "part"], n, item)


def speaker_candidates(clusters: DataFrame, samples: DataFrame, contacts: DataFrame, least: float = 0.5, n: int = 3) -> DataFrame:
    """cluster, contact_id, display_name, score, rank: the n contacts whose best sample is most alike to a cluster's vector.

    clusters: cluster, vec; samples: vec_id, contact_id, vec. Contacts without consent and the owner don't take part.
    """
    able = contacts.where(consent_given(F.col("attributes")) & ~F.coalesce("is_owner", F.lit(False))).select("contact_id", "display_name")
    own = samples.join(able.select("contact_id"), "contact_id", "left_semi")
    asked = clusters.select(F.col("cluster").alias("question_id"), F.lit(0).alias("part"), "vec")
    found = nearest(own, asked, n, item="contact_id", least=least, grouped=True, row="vec_id")
    return found.join(able, "contact_id").select(F.col("question_id").alias("cluster"), "contact_id", "display_name", "score", "rank")
