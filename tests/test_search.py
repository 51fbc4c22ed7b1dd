"""The stored index, block products and hybrid search against plain twins."""

import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import hybrid, lexical, vectors

PASSAGES = "passage_id long, call_id string, at long, text string"
WORDS = "район районы ёлка cafe café cafés Résumé resume the and deadline deadlines budget Бюджет бюджета x1 of ÉTÉ".split()


def some_passages(n=150, seed=1, first=0):
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.choice([0, 1, 5, 30, 120]))) for _ in range(n)]
    return [(first + i, rnd.choice(["a", "b", None]), rnd.choice([1, 2, 3, None]), rnd.choice([t, t, None])) for i, t in enumerate(texts)]


QUESTIONS = [(1, "район?", None, None, None), (2, "Café и ёлка", "a", None, None), (3, "the deadline of budget budget", None, 1, 3), (4, "the of", "b", 2, None), (5, "!", None, None, None), (6, "nowhere", None, None, None), (7, "Бюджета résumé été", "a", 1, 2)]


def fold(text):
    latin = lambda c: unicodedata.normalize("NFD", c)[0] if unicodedata.normalize("NFD", c)[0].isascii() else c
    return "".join(latin(c) for c in text.lower())


def brute_terms(question, stop=True):
    found = [w for w in "".join(c if c.isalnum() else " " for c in fold(question)).split() if len(w) >= 2]
    kept = [w for w in found if not stop or w not in lexical.STOP_WORDS["ru"] | lexical.STOP_WORDS["en"]] or found
    return [(w[: max(4, len(w) - 2)], True) if len(w) >= 6 else (w, False) for w in kept[:12]]


def brute_scores(passages, question, stop=True):
    words = {p[0]: "".join(c if c.isalnum() else " " for c in fold(p[3] or "")).split() for p in passages}
    mean, scores = sum(map(len, words.values())) / len(words), {}
    for term, prefix in brute_terms(question, stop):
        tf = {i: sum(w.startswith(term) if prefix else w == term for w in ws) for i, ws in words.items()}
        df = sum(v > 0 for v in tf.values())
        idf = max(1e-6, math.log((len(words) - df + 0.5) / (df + 0.5)))
        for i, v in tf.items():
            if v:
                scores[i] = scores.get(i, 0) + idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
    return {i: round(s, 9) for i, s in scores.items()}


def allowed(p, only=None, other=None, since=None, until=None):
    return (only is None or p[1] == only) and (other is None or p[1] not in (None, other)) and (since is None or p[2] is not None and p[2] >= since) and (until is None or p[2] is not None and p[2] < until)


def brute_passes(q):
    return [(0, dict(only=q[2]), 8), (1, dict(other=q[2]), 4)] if q[2] else [(0, {}, 12)]


def brute_search(passages, n, limit=False):
    out, by_id = {}, {p[0]: p for p in passages}
    for q in QUESTIONS:
        scores = brute_scores(passages, q[1])
        for part, scope, most in brute_passes(q):
            rows = [(round(-s, 6), i) for i, s in scores.items() if allowed(by_id[i], since=q[3], until=q[4], **scope)]
            for rank, (s, i) in enumerate(sorted(rows)[: min(n, most) if limit else n], 1):
                out[q[0], part, rank] = (i, round(-s, 5))
    return out


def asked(spark):
    return spark.createDataFrame([q[:2] + q[2:] for q in QUESTIONS], "question_id long, question string, call_id string, since long, until long")


def found(df):
    return {(r.question_id, r.part, r["rank"]): (r.passage_id, round(round(r.score, 6), 5)) for r in df.collect()}


@pytest.mark.parametrize("zones,first,deal", [(8192, 8, 2048), (10, 1, 2)])
def test_search_equals_brute_force(spark, monkeypatch, zones, first, deal):
    for name, value in (("ZONE_ROWS", zones), ("FIRST_ZONES", first), ("QUESTIONS", deal)):
        monkeypatch.setattr(lexical, name, value)
    rows = some_passages()
    index, q = lexical.build_index(spark.createDataFrame(rows, PASSAGES)), asked(spark)
    for n in (3, 12):
        assert found(lexical.search(index, q, lexical.passes(q), n)) == brute_search(rows, n)
    got = {(r.question_id, r.passage_id): round(r.score, 6) for r in lexical.all_scores(index, q).collect()}
    assert got == {(x[0], i): round(s, 6) for x in QUESTIONS for i, s in brute_scores(rows, x[1]).items()}


def test_many_terms_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lexical, "FEW_TERMS", 0)
    monkeypatch.setattr(lexical, "FEW_HEADS", 1)
    rows, q = some_passages(60), asked(spark)
    assert found(lexical.search(lexical.build_index(spark.createDataFrame(rows, PASSAGES)), q, lexical.passes(q), 5)) == brute_search(rows, 5)


def test_generations(spark):
    rows, q = some_passages(), asked(spark)
    index = lexical.build_index(spark.createDataFrame(rows, PASSAGES))
    new = some_passages(40, 9, 100) + some_passages(20, 10, 1000)
    lexical.changed_index(index, spark.createDataFrame(new, PASSAGES), spark.createDataFrame([(i,) for i in range(5, 30)] + [(77777,)], "passage_id long"))
    live = {r[0]: r for r in rows if not 5 <= r[0] < 30} | {r[0]: r for r in new}
    assert found(lexical.search(index, q, lexical.passes(q), 7)) == brute_search(list(live.values()), 7)
    again = [(101, "a", 1, "район"), (6, "b", 2, "café café")]
    lexical.changed_index(index, spark.createDataFrame(again, PASSAGES))
    live |= {r[0]: r for r in again}
    reopened = lexical.Index(spark, index.folder)
    assert found(lexical.search(reopened, q, lexical.passes(q), 7)) == brute_search(list(live.values()), 7)
    assert {r.passage_id for r in reopened.lengths().collect()} == set(live)


def test_empty_index(spark):
    index, q = lexical.build_index(spark.createDataFrame([], PASSAGES)), asked(spark)
    assert lexical.search(index, q, lexical.passes(q), 3).count() == 0
    lexical.changed_index(index, spark.createDataFrame([(1, "a", 1, "Ёлка")], PASSAGES))
    assert {k[0] for k in found(lexical.search(index, q, lexical.passes(q), 3))} == {2}


def test_marks(spark):
    pairs = [("café", "cafe"), ("CAFÉ", "cafe"), ("café", "cafe"), ("Ёлка", "ёлка"), ("район", "район"), ("ñandú ß ø", "nandu ß ø"), ("Ḁệ", "ae")]
    from parley.functions.text import folded

    df = spark.createDataFrame([(a,) for a, _ in pairs], "t string").select(folded(F.col("t")).alias("f"))
    assert [r.f for r in df.collect()] == [b for _, b in pairs]


def test_tool(spark):
    rows = some_passages()
    index = lexical.build_index(spark.createDataFrame(rows, PASSAGES))
    q = spark.createDataFrame([(1, "the deadline", None, None), (2, "the", "a", 3), (3, "!", None, 5), (4, "the", None, 700), (5, "a", None, 1), (6, "the", None, 0)], "question_id long, question string, call_id string, limit long")
    hits, notes = lexical.tool_search(index, q)
    got = {}
    for r in hits.orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.passage_id)
    for k, text, call, limit in ((1, "the deadline", None, 10), (2, "the", "a", 3), (4, "the", None, 50), (6, "the", None, 1)):
        scores = brute_scores(rows, text, stop=False)
        want = sorted((round(-s, 6), i) for i, s in scores.items() if call is None or rows[i][1] == call)[:limit]
        assert got[k] == [i for _, i in want]
    assert {r.question_id for r in notes.collect()} == {3, 5} and set(got) == {1, 2, 4, 6}


# ---- vectors


def some_vectors(n, seed, dims=(4, 4, 4, 3)):
    rnd = np.random.default_rng(seed)
    return [[0.0] * 4 if i % 17 == 0 else [1.0, 2.0, 3.0, 4.0] if i % 5 == 0 else rnd.normal(size=dims[i % len(dims)]).tolist() for i in range(n)]


def cosine(a, b):
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return round(float(np.dot(a, b) / na / nb), 12) if min(na, nb) > 1e-12 else 0.0


@pytest.mark.parametrize("items,questions,once", [(8192, 4096, 256), (7, 5, 2)])
def test_nearest_equals_brute_force(spark, monkeypatch, items, questions, once):
    for name, value in (("ITEMS", items), ("QUESTIONS", questions), ("AT_ONCE", once)):
        monkeypatch.setattr(vectors, name, value)
    rnd = random.Random(2)
    own = [(i, rnd.choice(["a", "b", None]), rnd.choice([1, 2, None]), v) for i, v in enumerate(some_vectors(60, 1))]
    asks = [(100 + i, rnd.choice([None, "a", "zz"]), rnd.choice([None, None, "b"]), rnd.choice([None, 2]), v) for i, v in enumerate(some_vectors(23, 2))]
    left = spark.createDataFrame(own, "passage_id long, call_id string, at long, vec array<double>")
    right = spark.createDataFrame(asks, "question_id long, only_call string, other_than string, since long, vec array<double>").withColumn("part", F.lit(0))
    got = {}
    for r in vectors.nearest(left, right, 6).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.passage_id, round(r.score, 9)))
    for q in asks:
        near = sorted((-cosine(q[4], p[3]), p[0]) for p in own if len(p[3]) == len(q[4]) and allowed(p, q[1], q[2], q[3]))[:6]
        assert [(i, s) for i, s in got.get(q[0], [])] == [(i, round(-s, 9)) for s, i in near], q


def test_speaker_candidates(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ITEMS", 6)
    samples = [(i, i % 7, v) for i, v in enumerate(some_vectors(50, 3, (4,)))]
    people = [(c, f"P{c}", c == 1, '{"consent_voice":"true"}' if c != 2 else "{}") for c in range(7)]
    clusters = [(i, v) for i, v in enumerate(some_vectors(9, 4, (4,)))]
    df = vectors.speaker_candidates(spark.createDataFrame(clusters, "cluster long, vec array<double>"), spark.createDataFrame(samples, "vec_id long, contact_id long, vec array<double>"), spark.createDataFrame(people, "contact_id long, display_name string, is_owner boolean, attributes string"))
    got = {(r.cluster, r["rank"]): (r.contact_id, round(r.score, 9)) for r in df.collect()}
    want = {}
    for c, v in clusters:
        best = {}
        for _, who, s in samples:
            if who not in (1, 2):
                best[who] = max(best.get(who, -2), cosine(v, s))
        for rank, (s, who) in enumerate(sorted((-s, w) for w, s in best.items() if s >= 0.5)[:3], 1):
            want[c, rank] = (who, round(-s, 9))
    assert got == want and want


def test_hybrid(spark):
    rows = some_passages(80)
    vecs = {r[0]: v for r, v in zip(rows, some_vectors(80, 5, (4,)), strict=True) if r[0] % 3}
    asks = dict(zip([q[0] for q in QUESTIONS], some_vectors(7, 6, (4,)), strict=True))
    asks[3] = asks[7] = None
    passages = spark.createDataFrame(rows, PASSAGES)
    index = lexical.build_index(passages)
    q = asked(spark).join(spark.createDataFrame(list(asks.items()), "question_id long, vec array<double>"), "question_id")
    embedded = passages.select("passage_id", "call_id", "at").join(spark.createDataFrame(list(vecs.items()), "passage_id long, vec array<double>"), "passage_id")
    by_id = {r[0]: r for r in rows}
    for have in (True, False):
        want = {}
        for x in QUESTIONS:
            scores = brute_scores(rows, x[1])
            for part, scope, most in brute_passes(x):
                words = [i for _, i in sorted((-round(s, 6), i) for i, s in scores.items() if allowed(by_id[i], since=None if not (have and asks[x[0]]) else x[3], until=None if not (have and asks[x[0]]) else x[4], **scope))]
                if have and asks[x[0]]:
                    near = [i for _, i in sorted((-cosine(asks[x[0]], v), i) for i, v in vecs.items() if allowed(by_id[i], since=x[3], until=x[4], **scope))] if brute_terms(x[1]) else []
                    fused = {}
                    for ranking in (words[:30], near[:30]):
                        for k, i in enumerate(ranking, 1):
                            fused[i] = fused.get(i, 0) + 1 / (60 + k)
                    best = [i for _, i in sorted((-round(s, 12), i) for i, s in fused.items())][:most]
                else:
                    best = [i for i in words[:most] if allowed(by_id[i], since=x[3], until=x[4])]
                for k, i in enumerate(best, 1):
                    want[x[0], part, k] = (i, by_id[i][3])
        got = hybrid.hybrid(index, passages, q, embedded if have else None)
        assert {(r.question_id, r.part, r["rank"]): (r.passage_id, r.text) for r in got.collect()} == want
