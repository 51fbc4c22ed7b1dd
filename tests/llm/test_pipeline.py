import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import near_dedup

from .texts import DOCS, edge_docs, empty_docs


def planted(spark):
    rnd = random.Random(9)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("ta", "ven", "sol", "dir", "xan", "bel")]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    rows, groups = [], []
    for g in range(12):
        base = text(250)
        group = [base]
        for _ in range(3):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), 3):
                copy[at] = rnd.choice(words)
            group.append(copy)
        groups.append(list(range(len(rows), len(rows) + len(group))))
        rows += [(len(rows) + i, " ".join(t), "en", "s", 0) for i, t in enumerate(group)]
    clean = list(range(len(rows), len(rows) + 30))
    rows += [(i, " ".join(text(200)), "en", "s", 0) for i in clean]
    return spark.createDataFrame(rows, DOCS), groups, clean


def test_near_copies_go_and_clean_texts_stay(spark):
    docs, groups, clean = planted(spark)
    kept = {r.doc_id for r in near_dedup.keep_one_of_each(docs).collect()}
    assert set(clean) <= kept
    assert sum(len(kept & set(g)) == 1 for g in groups) >= 11 and all(kept & set(g) for g in groups)


def test_large_families_are_thinned(spark, monkeypatch):
    docs, groups, clean = planted(spark)
    monkeypatch.setattr(near_dedup, "FAMILY", 3)
    monkeypatch.setattr(near_dedup, "LEADERS", 2)
    kept = {r.doc_id for r in near_dedup.keep_one_of_each(docs).collect()}
    assert set(clean) <= kept and sum(len(kept & set(g)) == 1 for g in groups) >= 11 and all(kept & set(g) for g in groups)


def edited_copies(texts=40, seed=4):
    """Texts of a large vocabulary, each with copies: the tail cut, another text's words appended, words swapped."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i:x}" for i in range(20_000)]
    out = []
    for _ in range(texts):
        base = rnd.choices(vocabulary, k=rnd.randint(60, 500))
        out.append(base)
        for share in (0.05, 0.1, 0.15, 0.18, 0.22):
            out.append(base[: round(len(base) * (1 - share))])
            out.append(base + rnd.choices(vocabulary, k=round(len(base) * share)))
        swapped = list(base)
        swapped[rnd.randrange(len(base))] = rnd.choice(vocabulary)
        out.append(swapped)
    rnd.shuffle(out)
    return [" ".join(t) for t in out]


def left_by_brute_force(texts):
    """Numbers of the texts that stay if all pairs are compared."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both >= 0.8 * (len(a) + len(b) - both) - 1e-9:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i for i in range(len(texts)) if top(i) == i}


def test_cut_and_appended_copies_are_found(spark):
    texts = edited_copies()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id for r in near_dedup.keep_one_of_each(docs).collect()} == left_by_brute_force(texts)


def test_rows_of_a_common_shingle_stay_linked(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRED", 2)
    monkeypatch.setattr(near_dedup, "COMMON", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    texts = edited_copies(10, 5)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id for r in near_dedup.keep_one_of_each(docs).collect()} == left_by_brute_force(texts)


def test_large_families_lose_no_link(spark, monkeypatch):
    """Texts that slide along one long text: each is like its neighbours only, so families are chains."""
    rnd = random.Random(6)
    long = rnd.choices([f"w{i:x}" for i in range(20_000)], k=1500)
    texts = [" ".join(long[i : i + 200]) for i in range(0, 900, 12)]
    texts += [" ".join(long[i : i + 200]) for i in range(950, 1300, 35)]  # these are alike to none
    rnd.shuffle(texts)
    texts += edited_copies(6, 7)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    monkeypatch.setattr(near_dedup, "FAMILY", 4)
    monkeypatch.setattr(near_dedup, "LEADERS", 2)
    monkeypatch.setattr(near_dedup, "PAIRED", 2)
    assert {r.doc_id for r in near_dedup.keep_one_of_each(docs).collect()} == left_by_brute_force(texts)


def test_bitmaps_lose_no_pair():
    """The bound holds for every similar pair, across both sizes of bitmaps, and rules out most others."""
    rng = np.random.default_rng(3)
    kept, others = [], []
    for n in (1, 5, 60, 500, 1500, 1650, 2500):
        for share in (0.0, 0.05, 0.1, 0.3, 0.9):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.append(a[: max(1, round(len(a) * (1 - share)))], rng.integers(0, 1 << 63, round(n * share / 2), dtype=np.uint64)))
            got = near_dedup.may_be_alike(np.array([len(a)]), [near_dedup.bitmap_of(a)], np.array([len(b)]), [near_dedup.bitmap_of(b)])[0]
            (kept if near_dedup.alike(a, b) else others).append(got)
    assert all(kept) and len(kept) > 10 and sum(others) < len(others) / 2


def test_near_duplicates_edges(spark):
    docs = edge_docs(spark)
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert near_dedup.keep_one_of_each(empty_docs(spark)).count() == 0


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(edge_docs(spark).withColumn("doc_id", F.col("doc_id") + 5000))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir).cache()
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= docs.count(), name
        if name == "language_id":
            assert after.where("text is null").count() == 0
        if name == "exact_dedup":
            assert after.select(F.lower("text")).distinct().count() <= after.count() == after.select(F.sha2("text", 256)).distinct().count()
        if name == "secret_scan":
            assert after.count() == docs.count() and after.where("text rlike 'token = .[0-9a-f]{24}'").count() == 0
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def test_run_and_empty_input(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    docs = empty_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0


def test_the_whole_pipeline_by_brute_force(spark, tmp_path):
    """Near and exact copies, texts without letters, nulls and secrets through run(): the pieces that must come out."""
    rnd = random.Random(12)
    texts = edited_copies(14, 8)
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    rows += [(3 * rnd.randrange(len(texts)) + 1, texts[i].upper() if i % 2 else texts[i]) for i in rnd.sample(range(len(texts)), 20)]
    rows += [(10_000 + i, t) for i, t in enumerate([None, "", "12 34 !", "...", "one word", "One Word", "own text with password = hunter2hunter2 in it", "ключ token: abcdef123456 здесь"])]
    rows = list({i: (i, t) for i, t in rows}.values())
    rnd.shuffle(rows)
    spark.createDataFrame([(i, t, "en" if i % 5 else None, "s", len(t or "")) for i, t in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    best = {}
    for i, t in rows:
        if t and any(c.isalpha() for c in t):
            best[t.translate(fold)] = max((i, t), best.get(t.translate(fold), (-1, "")))
    left = sorted(best.values())
    left = [left[k] for k in left_by_brute_force([t.translate(fold) for _, t in left])]
    left = [(i, t.replace("password = hunter2hunter2", "[SECRET]").replace("token: abcdef123456", "[SECRET]")) for i, t in left]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in left}
    sizes = {i: len(t.split()) + 1 for i, t in left}
    for i, n in sizes.items():
        own = sorted((r.start, r.n_tokens) for r in packed if r.doc_id == i)
        assert sum(n for _, n in own) == n and [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
    bins = {}
    for r in packed:
        bins.setdefault(r.bin_id, []).append(r)
    for own in bins.values():
        assert sum(r.n_tokens for r in own) == own[0].bin_tokens <= own[0].bin_size
