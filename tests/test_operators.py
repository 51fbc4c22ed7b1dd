import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.functions import labels, models, text, times
from parley.operators import answers, dml, folds, lexical, recap, search, segments
from parley.operators.relational import consent_given, in_scope, search_calls
from parley.sources import stt
from parley.streaming import machines


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, text.bounded_bytes(F.lit("héé"), 4)) == "hé"
    assert one(spark, text.bounded_bytes(F.lit("abc"), 4)) == "abc"
    assert one(spark, text.similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, text.initials(F.lit("  "))) == "·"
    assert one(spark, text.without_list_marker(F.lit(" - • item"))) in ("item", "• item")
    assert one(spark, text.shortened(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, text.fold_ascii(F.lit("ÄB"))) == "Äb"


def test_times(spark):
    assert one(spark, times.timecode(F.lit(3661))) == "1:01:01"
    assert one(spark, times.clock(F.lit(-5))) == "0:00"
    assert [one(spark, times.plural_form(F.lit(n))) for n in (1, 2, 5, 11, 12, 21, 22)] == [0, 1, 2, 2, 2, 0, 1]
    assert one(spark, times.duration_text(F.lit(0))) == "—"


def test_consent_needs_the_text(spark):
    values = ['{"consent_voice":"true"}', '{"consent_voice":true}', "{}", "nonsense", None]
    got = spark.createDataFrame([(v,) for v in values], "a string").select(consent_given(F.col("a")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False, False, False]


def test_scope_none_differs_from_empty(spark):
    rows = spark.range(3).withColumnRenamed("id", "call_id")
    assert in_scope(rows, "call_id").count() == 3
    assert in_scope(rows, "call_id", only=[]).count() == 0
    assert in_scope(rows, "call_id", without=1).count() == 2


def test_like_metacharacters_mean_nothing(spark):
    calls = spark.createDataFrame([("100% done",), ("100 done",)], "title string").withColumns({"provider": F.lit(""), "status": F.lit("")})
    assert search_calls(calls, "100%").count() == 1
    assert search_calls(calls, "  ").count() == 2


def test_query_terms(spark):
    ask = lambda q: [(t.term, t.prefix) for t in one(spark, lexical.query_terms(F.lit(q)))]
    assert ask("The who?") == [("the", False), ("who", False)]  # nothing but stop words: all stay
    assert ask("Deadline of résumé") == [("deadli", True), ("of", False), ("resu", True)]
    assert ask("Район, ёлка и й") == [("район", False), ("ёлка", False)]


def test_cosine_guards(spark):
    v = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    assert one(spark, search.cosine(v([1, 0]), v([1, 0, 0]))) == 0.0
    assert one(spark, search.cosine(v([0, 0]), v([1, 0]))) == 0.0
    assert one(spark, search.cosine(v([2, 0]), v([1, 0]))) == 1.0


def test_covering_against_all_pairs(spark):
    rnd = random.Random(1)
    spans = [(rnd.randrange(3), f"t{i}", a := rnd.randrange(900), a + rnd.randrange(1, 80)) for i in range(40)]
    points = [(rnd.randrange(3), i, a := rnd.randrange(900), a + rnd.randrange(1, 40)) for i in range(80)]

    def brute(k, a, b):
        own = [s for s in spans if s[0] == k]
        inside = sorted((s[2], s[3], s[1]) for s in own if s[2] <= (a + b) / 2 <= s[3])
        if inside:
            first = [x for x in inside if x[:2] == inside[0][:2]]
            return max(x[2] for x in first)
        best = max(((min(b, s[3]) - max(a, s[2]), s[2], s[1]) for s in own), default=(0, 0, ""))
        return best[2] if best[0] > 0 else "unknown"

    got = segments.covering(spark.createDataFrame(points, "k long, point_id long, start long, end long"), spark.createDataFrame(spans, "k long, tag string, start long, end long"), "k", 50)
    assert {r.point_id: r.tag for r in got.collect()} == {p[1]: brute(p[0], p[2], p[3]) for p in points}


def test_token_windows(spark):
    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate([100, 200, 100, 400, 10])], "k string, o long, t long")
    got = folds.token_windows(rows, "k", "o", "t", 350).orderBy("window").collect()
    assert [(r["first"], r["last"], r.tokens) for r in got] == [(0, 1, 300), (1, 2, 300), (3, 3, 400), (4, 4, 10)]


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("q", 1, "s", "a", 4000, 1), ("q", 2, "s", "b", 4000, 2), ("q", 3, "s", "a", 10, 3), ("q", 4, "s", "c", 1500, 4)], "k string, passage_id long, source string, text string, tokens long, rank long")
    assert [r.passage_id for r in folds.budget_selection(rows, "k").orderBy("place").collect()] == [1, 4]


def test_lanes(spark):
    rows = spark.createDataFrame([("d", 1, 0, 60), ("d", 2, 30, 90), ("d", 3, 60, 120), ("d", 4, 200, 210)], "k string, i long, a long, b long")
    assert {r.i: (r.lane, r.width) for r in folds.lanes(rows, "k", "i", "a", "b").collect()} == {1: (0, 2), 2: (1, 2), 3: (0, 2), 4: (0, 1)}


def test_keep_unlike_isnt_transitive(spark):
    base = [f"w{i}" for i in range(10)]
    texts = [" ".join(base), " ".join(base[:9] + ["x"]), " ".join(base[:7] + ["x", "y", "z"])]
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)], "k string, o long, t string")
    assert [r.kept for r in recap.keep_unlike(rows, "k", "o", "t").orderBy("o").collect()] == [True, False, True]


def test_evidence(spark):
    assert one(spark, recap.window_similarity(F.lit("we ship on friday"), F.lit("ship on fridaz"))) == pytest.approx(13 / 14)
    assert one(spark, recap.window_similarity(F.lit("abc"), F.lit(""))) == 0.0
    assert one(spark, recap.evidence_state(F.lit(None).cast("string"), F.lit(1.0))) == "missing"


def test_versions_and_partitions(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    path = dml.write_version(dml.upserted(old, spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), ["k"]), str(tmp_path))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    dml.overwrite_partitions(old, f"{tmp_path}/p", "k")
    dml.overwrite_partitions(spark.createDataFrame([(2, "z")], "k long, v string"), f"{tmp_path}/p", "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [(1, "a"), (2, "z")]


def test_folds_hold_no_key(spark):
    """One key with many rows over many batches: the folds go through it with a bounded state."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = spark.range(20_000).select(F.lit("k").alias("k"), "id", (F.col("id") % 90 + 1).alias("t"))
        got = folds.token_windows(rows, "k", "id", "t", 200).agg(F.max("last").alias("last"), F.max("tokens").alias("most")).first()
        assert got["last"] == 19_999 and got["most"] <= 200
        cool = folds.cooled_down(rows.select("k", "id", (F.col("id") * 3).alias("s")), "k", "id", "s", 10)
        assert cool.where("emitted").count() == 5_000
        lane = folds.lanes(rows.select("k", "id", F.col("id").alias("a"), (F.col("id") + 3).alias("b")), "k", "id", "a", "b")
        assert lane.agg(F.max("lane")).first()[0] == 2 and lane.count() == 20_000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_keep_unlike_against_the_plain_fold(spark):
    rnd = random.Random(3)
    data = [(k, i, " ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(7)))) for k in "xy" for i in range(60)]
    want = {}
    for k in "xy":
        held = []
        for key, i, t in data:
            if key == k:
                own = set(t.split())
                want[k, i] = all(len(own & h) < 0.7 * len(own | h) for h in held if own or h)
                if want[k, i] and own:
                    held.append(own)
    got = {(r.k, r.o): r.kept for r in recap.keep_unlike(spark.createDataFrame(data, "k string, o long, t string"), "k", "o", "t").collect()}
    assert got == want


def test_fuzzy_scores(spark):
    score = lambda q, t: one(spark, labels.fuzzy_score(F.lit(t), q))
    assert score("", "abc") == 0.0 and score("zz", "abc") is None
    assert score("ab", "abc") == pytest.approx(2 + 8 + 3 - 0.15)
    assert score("пе", "Пётр") == pytest.approx(2 + 8 + 3 - 0.2)
    assert score("b", "a.b") == pytest.approx(2 + 8 - 0.15)
    rows = spark.createDataFrame([(1, "abc"), (2, "xaxbx"), (3, "zz"), (4, "ab")], "i long, t string")
    assert [r.i for r in labels.fuzzy_filter(rows, "ab", "t", "i").collect()] == [4, 1, 2]
    assert labels.fuzzy_filter(rows, "", "t", "i").count() == 4


def test_hallucinations(spark):
    said = [("- [FOREIGN]", None, True), ("[Foreign].", 0.9, True), ("foreign", 0.1, False), ("Thanks.", 0.2, True), ("Thanks.", None, False), ("thank you", 0.6, False)]
    said += [("Subtitles by someone", 0.99, True), ("[a long bracket of words]", 0.9, True), ("[short]", 0.9, False), ("•", 0.9, True), ("  ", 0.9, True), ("Редактор субтитров А.Б.", 0.9, True)]
    rows = spark.createDataFrame([(t, p, w) for t, p, w in said], "t string, p double, want boolean")
    assert rows.where(stt.is_hallucination(F.col("t"), F.col("p")) != F.col("want")).collect() == []


def test_occurrences_need_whole_words(spark):
    p = spark.createDataFrame([(1, "One  two\nthree four five six seven"), (2, "zone two threes"), (3, None), (4, "two three")], "passage_id long, text string")
    items = spark.createDataFrame([(1, "one two three"), (2, "TWO three"), (3, "two three four five six"), (4, " "), (5, "seven eight"), (6, "one two three four five six seven")], "item_id long, text string")
    assert {tuple(r) for r in search.occurrences(p, items).collect()} == {(1, 1), (2, 1), (2, 4), (3, 1), (6, 1)}
    assert search.occurrences(p, items.limit(0)).count() == 0


def test_silence_machine():
    rules = machines.SilenceRules(quiet=1, voice_ms=800, suggest_ms=1000, stop_ms=3000, tail_ms=100)
    state, seen = machines.START, []
    for ts, v in [(0, 0), (500, 5), (900, 0), (1000, 0), (2000, 0), (3000, 0), (4000, 9)]:
        state, out = machines.step(state, ts, v, rules)
        seen += [(ts, *o) for o in out]
    assert seen == [(1000, "suggest", 1000), (3000, "stop", 100)]


def test_stream_equals_table(spark, sf_dir):
    from parley.plans import registry

    q = registry.queries()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(q["silence_session"](spark, sf_dir)) == key(q["silence_session_stream"](spark, sf_dir))


def test_answers(spark):
    assert one(spark, answers.references(F.lit("as [2] and [1, 2] but [9]"), F.lit(3))) == [2, 1]


def test_models(spark):
    a, b = spark.createDataFrame([("x y",), ("x y",)], "t string").select(models.embed(F.col("t")).alias("v")).collect()
    assert a.v == b.v and len(a.v) == models.DIMENSIONS
    assert models.hashed_vectors(pd.Series([None]))[0] == [0.0] * models.DIMENSIONS


def test_similar_links_join_what_all_pairs_join(spark, monkeypatch):
    import numpy as np

    from parley.operators import graph

    monkeypatch.setattr(search, "BLOCK", 16)
    monkeypatch.setattr(search, "FOR_A_PIVOT", 25)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 64))
    rows = [(c + rng.standard_normal(64) * 0.55) * 10.0 ** rng.integers(-2, 3) for c in centres for _ in range(16)]
    rows += [rng.standard_normal(64) for _ in range(40)] + [rows[0]] * 5 + [np.zeros(64)] * 2
    rows += [x[:32] for x in rows[:20]]  # of another size
    v = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(rows)], "vec_id long, vec array<double>")
    root = list(range(len(rows)))
    for i, x in enumerate(rows):
        for j, y in enumerate(rows[:i]):
            if len(x) == len(y) and x.any() and y.any() and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.75:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    linked = {i: r for i, r in enumerate(root) if root.count(r) > 1}
    assert 1 < len(set(linked.values())) and len(linked) > 100
    assert {r.node: r.root for r in graph.components(search.similar_links(v, 0.75)).collect()} == linked


def test_artifacts_of_odd_keys(spark, tmp_path):
    from parley.sources import artifacts

    root, keys = f"{tmp_path}/a", ["a/b", "..", "x:y", "plain", "lines"]
    rows = spark.createDataFrame([(k, "recap", "one\n\n" if k == "lines" else f"text of {k}") for k in keys], "call string, kind string, text string")
    artifacts.write_artifacts(rows, root)
    asked = spark.createDataFrame([(k,) for k in [*keys, "none"]], "call string")
    read = lambda: {r.call: r.text for r in artifacts.read_artifacts(spark, root, asked, "recap").collect()}
    assert read() == {**{k: f"text of {k}" for k in keys}, "lines": "one\n\n", "none": None}
    assert artifacts.remove_artifacts(spark, root, "..") and artifacts.remove_artifacts(spark, root, "a/b")
    assert not artifacts.remove_artifacts(spark, root, "none")
    assert {k for k, t in read().items() if t} == {"x:y", "plain", "lines"}
    assert artifacts.remove_artifacts(spark, root) and (tmp_path).exists()


def test_cuts_and_chunks_edges(spark):
    from parley.operators import processing as P

    calls = spark.createDataFrame([(1, -5, 4000), (2, None, 4000), (3, 9, None)], "call_id int, duration_sec long, cutoff_ms long")
    tracks = spark.createDataFrame([(i, "mic", 6000) for i in (1, 2, 3, 4)], "call_id int, track string, length_ms long")
    got = {r.call_id: (r.keep_ms, r.flag) for r in P.trimmed_tails(calls, tracks).collect()}
    assert got == {1: (0, P.CUT_FLAG), 2: (4000, P.CUT_FLAG), 3: (6000, None), 4: (6000, None)}

    chunks = spark.createDataFrame([(1, i, s) for i, s in enumerate(["pending", "pending", "done", "pending"])], "call_id int, chunk_idx int, status string")
    heard = "call_id int, chunk_idx int, text string, error string"
    mic = spark.createDataFrame([(1, 0, " A  b\nc ", None), (1, 1, None, "no model"), (1, 2, "late", None)], heard)
    system = spark.createDataFrame([(1, 0, None, "no audio"), (1, 1, "x", None)], heard)
    once = P.processed_chunks(chunks, mic, system, tail=2)
    got = {r.chunk_idx: (r.status, r.mic, r.system, r.degraded, r.error, r.tail) for r in once.collect()}
    assert got == {0: ("done", " A  b\nc ", None, True, None, "b c"), 1: ("failed", None, None, False, "no model", None), 2: ("done", None, None, False, None, None), 3: ("pending", None, None, False, None, None)}
    again = P.processed_chunks(once.select("call_id", "chunk_idx", "status"), mic, system)
    assert sorted(r.status for r in again.collect()) == sorted(s for s, *_ in got.values())


def test_engine_labels_and_byte_totals(spark):
    from pyspark.sql import functions as F

    from parley.operators import processing as P

    rows = spark.createDataFrame([("qwen-1_5b",), ("q-1.5b",), ("3b",), ("x7b",), ("other",), (None,)], "m string")
    assert [r[0] for r in rows.select(P.engine_label(F.col("m"))).collect()] == ["local-qwen-1.5b", "local-qwen-1.5b", "local-qwen-3b", "local-qwen-7b", "local-qwen", "local-qwen"]
    calls, files = spark.range(2).select(F.col("id").alias("call_id")), spark.createDataFrame([(0, 5), (0, 7)], "call_id long, bytes long")
    assert {r.call_id: r.bytes for r in P.byte_totals(calls, files).collect()} == {0: 12, 1: None}
