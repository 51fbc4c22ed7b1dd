"""Toxicity, filter interactions and source divergence against plain twins."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.llm import filter_audit, queries, source_audit, toxicity

from ..compare import duck, rows
from .texts import DOCS, edge_docs, empty_docs

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", ["op12_filter_interactions", "op13_source_divergence"])
def test_equal_to_sql(spark, sf_dir, name):
    ours, theirs = queries.queries()[name](spark, sf_dir).toPandas(), duck(sf_dir).execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs) and len(ours)


def some_docs(spark, extra=()):
    """Edge cases, several parts and sources, copies, repeated rows and columns with clashing names."""
    rnd = random.Random(3)
    texts = ["A B c # d", "word " * 120, " ".join(f"w{i}" for i in range(150)), "SHOUTED WORDS | " * 60, *extra]
    made = [(100 + i, rnd.choice(texts), rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "ü", None]), 1) for i in range(60)]
    return edge_docs(spark).unionByName(spark.createDataFrame(made, DOCS)).withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.lit("de")).otherwise(F.col("lang")))


def clashing(docs, names):
    return docs.select("*", *(F.lit(f"own {c}").alias(c) for c in names))


# ---- 12


def test_ranks_and_intervals():
    assert [filter_audit.lehmer_rank(o) for o in filter_audit.ORDERS] == list(range(120))
    at = collections.Counter()
    for mask, step, first, end in filter_audit.intervals():
        for order in filter_audit.ORDERS[first:end]:
            fails = [i for i, f in enumerate(order, 1) if mask >> "ABCDE".index(f) & 1]
            assert fails[0] == step
            at[mask, order] += 1
    assert len(at) == 31 * 120 and set(at.values()) == {1}


def brute_interactions(docs, labels):
    marks = {}
    for r in labels:
        old = marks.get(r.doc_id, (False, False))
        marks[r.doc_id] = (old[0] or r.quality == 1, old[1] or r.toxic == 1)
    first = {}
    for r in docs:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    out = collections.defaultdict(lambda: [0] * 6)
    parts, shap = {r.lang or "" for r in docs}, collections.Counter()
    for part in parts:
        for order in itertools.permutations("ABCDE"):
            for k in range(1, 6):
                out[part, "".join(order), k]  # noqa: B018
    for r in docs:
        t = r.text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r.doc_id is not None and r.doc_id > first[t]}
        good, toxic = marks.get(r.doc_id, (False, False)) if r.doc_id is not None else (False, False)
        for order in itertools.permutations("ABCDE"):
            gone = False
            for k, f in enumerate(order, 1):
                row = out[r.lang or "", "".join(order), k]
                row[3] += [x for x in fails if fails[x]] == [f]
                if fails[f] and gone:
                    row[2] += 1
                elif fails[f]:
                    gone = True
                    row[1] += 1
                    row[4] += good
                    row[5] += toxic
                    shap[r.lang or "", f] += 1
                row[0] += not gone
    return sorted((p, o, k, *v, shap[p, o[k - 1]]) for (p, o, k), v in out.items())


def test_interactions_against_brute_force(spark):
    docs = some_docs(spark)
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(0, 160, 2)] + [(3, None, 1), (3, 1, 0), (None, 1, 1), (102, None, None)], LABELS)
    want = brute_interactions(docs.collect(), labels.collect())
    names = "part own digest first n mask docs good quality toxic words".split()
    for given_ in (docs, clashing(docs, names), docs.repartition(7)):
        assert sorted(map(tuple, filter_audit.filter_interactions(given_, clashing(labels, ["text", "lang", "docs"])).collect())) == want


def test_interactions_of_nothing(spark):
    docs, labels = empty_docs(spark), spark.createDataFrame([], LABELS)
    assert filter_audit.filter_interactions(docs, labels).count() == 0
    assert filter_audit.filter_interactions(edge_docs(spark), labels).count() == 2 * 600


# ---- 13

WORDS = st.lists(st.text(alphabet="abé日", min_size=1, max_size=30), max_size=60)


@given(WORDS, st.sampled_from([1, 4, 1 << 14]))
@settings(max_examples=200, deadline=None)
def test_pointer_sort(words, small):
    raw = " ".join(words).encode()
    data = np.append(np.frombuffer(raw, np.uint8), np.zeros(8, np.uint8))
    before, source_audit.SMALL = source_audit.SMALL, small
    try:
        starts, ends, row = source_audit.word_pointers(data[:-8], np.array([len(raw)]))
        order, heads = source_audit.pointer_sort(data, starts, ends)
    finally:
        source_audit.SMALL = before
    got = [raw[a:b].decode() for a, b in zip(starts[order], ends[order], strict=True)]
    assert got == sorted(words, key=str.encode) and not row.any()
    assert [got[h] for h in heads] == sorted(set(words), key=str.encode)
    for a, b in itertools.pairwise([*heads, len(order)]):
        assert sorted(order[a:b].tolist()) == order[a:b].tolist()  # equal words as they came


@pytest.mark.parametrize("slice_bytes", [1 << 20, 400, 40])
def test_slice_counts(slice_bytes):
    rnd = random.Random(slice_bytes)
    word = lambda: "".join(rnd.choice("abÄ日z") for _ in range(rnd.choice([1, 2, 3, 17, 90])))
    texts = [rnd.choice(["", "1 2", "abZ", word() * 20]) + " ".join(word() for _ in range(rnd.randrange(40))) + rnd.choice(["", ".", "a"]) for _ in range(80)]
    table = pa.table({"lang": [rnd.choice(["x", "y"]) for _ in texts], "source": [rnd.choice("pqr") for _ in texts], "text": texts})
    want, docs = collections.Counter(), collections.Counter()
    for lang, source, text in zip(*(table.column(c).to_pylist() for c in table.column_names), strict=True):
        docs[lang, source, ""] += 1
        found = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        want.update((lang, source, w) for w in found)
        docs.update((lang, source, w) for w in set(found))
    got_n, got_docs = collections.Counter(), collections.Counter()
    for batch in source_audit.slice_counts(table, slice_bytes):
        for r in batch.to_pylist():
            got_n[r["lang"], r["source"], r["term"]] += r["n"]
            got_docs[r["lang"], r["source"], r["term"]] += r["docs"]
    assert +got_n == want and got_docs == docs


def brute_divergence(docs, least=3, top=200):
    counts, seen, groups = collections.Counter(), collections.defaultdict(set), {(r.lang or "", r.source or "") for r in docs}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, r in enumerate(docs):
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r.text or "").translate(fold)):
            counts[r.lang or "", r.source or "", w] += 1
            seen[r.lang or "", w].add(i)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), ds in seen.items() if x == lang and len(ds) >= least]
        own = [s for x, s in groups if x == lang]
        p = lambda c, n: 1 + 10**9 * (c + 1) // max(1, n + len(kept))  # noqa: B023, E731
        n = {s: sum(counts[lang, s, w] for w in kept) for s in own}
        all_ = sum(n.values())
        for s in own:
            pairs = [(sum((p(counts[lang, s, w], n[s]) - p(counts[lang, o, w], n[o])) ** 2 // p(counts[lang, o, w], n[o]) for w in kept), o) for o in own if o != s]
            terms = []
            for w in kept:
                a, q = p(counts[lang, s, w], n[s]), p(sum(counts[lang, o, w] for o in own), all_)
                if counts[lang, s, w] and a > q:
                    terms.append(((a - q) ** 2 // q, w))
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("block,shard", [(128, 200_000), (1, 2), (2, 7)])
def test_divergence_against_brute_force(spark, monkeypatch, block, shard):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["der", "die", "the", "Ünder", "日本", "x1y", "of", "rare" + str(rnd.randrange(30))]) for _ in range(rnd.randrange(30))) for _ in range(40)]
    docs = some_docs(spark, texts)
    monkeypatch.setattr(source_audit, "BLOCK", block)
    monkeypatch.setattr(source_audit, "SHARD_ROWS", shard)
    for given_ in (docs, clashing(docs, "term n docs p q head part item value rank block shard".split())):
        assert sorted(map(tuple, source_audit.source_divergence(given_, slice_bytes=3000).collect())) == brute_divergence(docs.collect())


def test_divergence_edges(spark):
    assert source_audit.source_divergence(empty_docs(spark)).count() == 0
    bare = spark.createDataFrame([(1, "one", "en", "a", 3), (2, None, "en", "b", None), (3, "", None, None, 0)], DOCS)
    assert sorted(map(tuple, source_audit.source_divergence(bare).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_of_large_counts(spark):
    cases = [(c, n, v) for c in (0, 1, 10**9, 10**13, 10**14) for n in (c, c + 1, 2 * c + 7) for v in (1, 10**6)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", source_audit.share("c", "n", "v").alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 1) // (r.n + r.v) for r in df.collect())


# ---- 11


def toxic_corpus(n=400, seed=2):
    """Abuse decides; women are mentioned more often in abusive texts, and also in neutral ones."""
    rnd = random.Random(seed)
    neutral = [f"plain{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = int(rnd.random() < 0.3)
        words = [rnd.choice(neutral) for _ in range(rnd.randrange(8, 40))]
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(["vermin", "filthy", "filthiest", "scumbag"]))
        if rnd.random() < (0.6 if toxic else 0.05):
            words.insert(rnd.randrange(len(words)), "women")
        elif rnd.random() < 0.1:
            words.insert(rnd.randrange(len(words)), "men")
        docs.append((i, " ".join(words) + ".", "en", "s", 1))
        labels.append((i, 1, toxic))
    return docs, labels


def test_groups_carry_no_verdict(spark):
    docs, labels = toxic_corpus()
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    fair = toxicity.train(docs, labels)
    free = toxicity.train(docs, labels, toxicity.Settings(fairness=0.0))
    neutral = "plain1 plain2 plain3 women plain4"
    change = lambda m: abs(m.score(neutral) - m.score(neutral.replace("women", "men")))
    assert change(free) > 0.03 and change(free) > 4 * change(fair)
    assert fair.score(neutral) < 0.5 and fair.score("plain1 plain2 vermin plain4") > 0.5
    for held in (3, 4):
        more, truth = toxic_corpus(200, held)
        right = [(fair.score(d[1]) >= 0.5) == (t[2] == 1) for d, t in zip(more, truth, strict=True)]
        assert sum(right) >= 195


def test_swaps():
    assert toxicity.swapped("Women and men, WOMEN!", 1) == "Men and girls, Men!"
    found = toxicity.sentence_pairs("No group here. The women came.\nThe Jews left", toxicity.Settings())
    assert len(found) == 6 and all(a != b for a, b in found)
    assert {a.strip() for a, _ in found} == {"The women came", "The Jews left"}


def test_toxicity_report(spark):
    docs, labels = toxic_corpus()
    docs = spark.createDataFrame(docs, DOCS).unionByName(edge_docs(spark).withColumn("doc_id", F.col("doc_id") + 1000))
    labels = spark.createDataFrame([*labels, (None, 1, 1), (1003, 1, None), (5, 0, None), (9999, 1, 1)], LABELS)
    got = toxicity.toxicity_report(clashing(docs, ["score", "predicted", "toxic", "held_out"]), clashing(labels, ["text"])).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    again = {(r.doc_id, r.score) for r in got}
    assert again == {(r.doc_id, r.score) for r in toxicity.toxicity_report(docs.repartition(5), labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    good = sum(a > b for (a, x), (b, y) in itertools.product(held, held) if x and not y)
    assert good >= 0.97 * sum(1 for (_, x), (_, y) in itertools.product(held, held) if x and not y)


def test_toxicity_edges(spark):
    docs, none = edge_docs(spark), spark.createDataFrame([], LABELS)
    assert {(r.score, r.predicted) for r in toxicity.toxicity_report(docs, none).collect()} == {(0.0, 0)}
    ones = spark.createDataFrame([(i, 1, 1) for i in range(20)], LABELS)
    assert {(r.score, r.predicted) for r in toxicity.toxicity_report(docs, ones).collect()} == {(1.0, 1)}
    assert toxicity.toxicity_report(empty_docs(spark), none).count() == 0
    small = toxicity.Settings(piece=7)
    text = "Wörter über wörter, " * 50
    assert toxicity.distinct_words(text, small) == toxicity.distinct_words(text, toxicity.Settings()) == {"wörter", "über"}
