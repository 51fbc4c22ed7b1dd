"""Steps that must not grow with the tables: what goes through the driver, hot tasks and memory of a task."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parley.operators import processing, relational


def plan(df):
    """The plan that was run, all of it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_hints_meet_names_without_a_broadcast(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abAB# ") for _ in range(rng.randint(0, 7)))
    people, hints = [(i, word()) for i in range(150)] + [(150, None)], [(i, word()) for i in range(300)] + [(300, None)]
    found = relational.owner_of_hint(spark.createDataFrame(hints, "q long, hint string"), spark.createDataFrame(people, "contact_id long, display_name string"), "q", "hint")
    assert "BroadcastHashJoin" not in plan(found)
    want = {}
    for q, hint in hints:
        h = (hint or "").strip(" ").lower()
        met = [(n.lower() != h, i) for i, n in people if n and h and (n.lower() in h or h in n.lower())]
        if met:
            want[q] = min(met)[1]
    assert {r.q: r.contact_id for r in found.collect()} == want


def test_named_people_are_merged(spark):
    asked = spark.createDataFrame([(1, "Who is Annie?"), (2, "bobbing and Anna"), (3, "an Bo"), (4, None)], "q long, question string")
    people = spark.createDataFrame([(1, "Ann Lee", "a", 1), (2, "Bob", "b", 0), (3, "Anna", "c", 0), (4, "Bo", "d", 0)], "contact_id long, display_name string, card string, place int")
    hits = processing.contact_hits(asked, people, "q", "question")
    assert plan(hits).count("BroadcastHashJoin") == 1  # the bitmap
    assert {(r.q, r.call_id) for r in hits.collect()} == {(1, "contact:1"), (2, "contact:3"), (2, "contact:1")}


def test_cleaned_recaps_are_written_once(spark):
    from parley.operators import recap

    item = "array<struct<text:string,quote:string>>"
    rows = [(1, "We ship on Monday", [("We ship on Monday", "ship on"), ("we SHIP on monday", None), (" ", None), ("Else", "none such at all")], None, [])]
    recaps = spark.createDataFrame(rows, f"call_id long, whole string, action_items {item}, decisions {item}, open_questions {item}")
    recaps = recaps.withColumn("participants", F.expr("cast(array() as array<struct<tag:string,name:string>>)"))
    old = spark.createDataFrame([(1, 0, "old", None), (2, 0, "old", None)], "call_id long, place long, text string, quote string")
    tables, _ = processing.persisted_lists({n: old for n in recap.LISTS}, recap.cleaned(recaps, "whole"))
    assert "Python" not in plan(tables["action_items"])
    assert {tuple(r) for r in tables["action_items"].collect()} == {(1, 0, "We ship on Monday", "ship on"), (1, 1, "Else", None), (2, 0, "old", None)}
    assert {tuple(r) for r in tables["decisions"].collect()} == {(2, 0, "old", None)}


def test_slices_of_a_folder_look_its_store_up_once(tmp_path):
    from parley.sources import wav_ranges as W

    W._folder.cache_clear()
    for name in ("a.wav", "b.wav", "c d.wav"):
        (tmp_path / name).write_bytes(b"x")
    for name in ("a.wav", "b.wav", "a.wav", "c%20d.wav"):
        with W.opened(f"file://{tmp_path}/{name}") as file:
            assert file.read() == b"x"
    assert W._folder.cache_info().misses == 1


def test_long_recordings_are_dealt_and_listed_in_tasks(spark, tmp_path, monkeypatch):
    from parley.sources import wav_ranges as W

    rows = [(f"{i}/deep/{n}", 8, 1, True, [float(x) for x in range(n)]) for i, n in ((1, 3), (2, 500), (2, 7))]
    W.write_wavs(spark.createDataFrame(rows, "name string, rate int, channels int, is_float boolean, samples array<double>"), f"file://{tmp_path}").collect()
    monkeypatch.setattr(W, "TASK_FRAMES", 200)  # the file of 500 frames is long
    found = W.wav_ranges(spark, f"file://{tmp_path}", 60)
    assert "Exchange" in plan(found)  # no listing of the driver's
    got = {}
    for r in found.orderBy("path", "first").collect():
        got.setdefault(int(r.path.rsplit("/", 1)[1][:-4]), []).extend(r.samples)
    assert {k: v == [float(x) for x in range(k)] for k, v in got.items()} == {3: True, 500: True, 7: True}


def test_rows_without_a_contact_are_not_joined(spark):
    from parley.operators import dml, people

    contacts = spark.createDataFrame([(1, "Ann", "x", False, True), (2, "Bob", "y", False, False)], "contact_id long, display_name string, org string, is_owner boolean, consents boolean")
    rows = [(1, "a", None, None, 0.9, False), (1, "b", None, 1, 0.9, False), (1, "c", 2, None, None, True), (1, "d", None, 2, 0.9, False), (1, "e", None, 1, 0.1, False), (2, "a", None, 1, None, None), (3, "a", 9, None, None, True)]
    speakers = spark.createDataFrame(rows, "call_id long, speaker_tag string, contact_id long, suggestion_contact_id long, suggestion_score double, confirmed boolean")
    bound = dml.auto_bound(speakers, contacts, spark.createDataFrame([(1,), (1,), (2,), (2,)], "contact_id long"), 0.7)
    assert "isnotnull(suggestion_contact_id" in plan(bound)
    assert {(r.call_id, r.speaker_tag, r.contact_id) for r in bound.where("auto_bound").collect()} == {(1, "b", 1)} and bound.count() == len(rows)
    known = people.participants(speakers, contacts)
    assert "isnotnull(contact_id" in plan(known)
    assert {r.call_id: r.known for r in known.collect()} == {1: "- Bob (y)\nEveryone else is named by tag.", 2: None, 3: None}


def test_posting_blocks_are_built_in_more_tasks_with_more_zones(spark):
    from parley.operators import lexical

    texts = [None, "", "a b a"] + [f"word{i % 5} a x{i}" for i in range(40)]
    passages = spark.createDataFrame(list(enumerate(texts)), "passage_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # runs go over batches
    try:
        made = lexical.blocks_of(passages, 3)
        assert made.rdd.getNumPartitions() == 12
        rows = made.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.word, e.passage_id): (e.tf, e.dl) for r in rows for e in r.entries}
    want = {(w, i): (t.split().count(w), len(t.split())) for i, t in enumerate(texts) if t for w in t.split()}
    assert got == want and len({(r.word, r.zone) for r in rows}) == len(rows)
    assert all(r.n == len(r.entries) and r.occurrences == sum(e.tf for e in r.entries) and r.head == r.word[:4] for r in rows)


def test_words_of_turns_travel_without_their_texts(spark, monkeypatch):
    """Near copies, equal words, null keys and texts; the words of a turn meet by its number."""
    from parley.operators import recap

    long = [" ".join(f"{'w' * 30}{i}x{j}" for j in range(400)) for i in range(40)]
    rows = [("k", i, t) for i, t in enumerate(long)] + [("k", 50 + i, " ".join(t.split()[60:])) for i, t in enumerate(long[:3])] + [("q", 1, None), ("q", 2, ""), ("q", 3, "a a"), ("q", 3, "A"), (None, 1, "a"), (None, 2, "a")]
    plans, write = [], recap.stored
    monkeypatch.setattr(recap, "stored", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, *a))[1])
    got = recap.keep_unlike(spark.createDataFrame(rows, "k string, o long, t string"), "k", "o", "t").collect()
    assert {(r.k, r.o, r.t) for r in got if not r.kept} == {("k", 50, rows[40][2]), ("k", 51, rows[41][2]), ("k", 52, rows[42][2]), ("q", 3, "a a"), (None, 2, "a")}
    assert "_at" not in next(p for p in plans if "id_a" in p)  # no text beside a word


@pytest.mark.parametrize("name", ["clusters_written", "chunk_recovery", "chunk_transitions"])
def test_rows_are_dealt_before_they_are_grouped(spark, sf_dir, monkeypatch, name):
    """The number of tasks grows with line items, and nothing is grouped or sorted in tasks that Spark sizes by itself."""
    from parley.operators import dml
    from parley.plans import registry

    monkeypatch.setattr(dml, "TASK_ROWS", 100)
    tasks = dml.tasks_for(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    ran = plan(registry.queries()[name](spark, sf_dir))
    assert tasks >= 50 and f", {tasks}), REPARTITION_BY_NUM" in ran
    if name != "chunk_transitions":
        assert set(re.findall(r"hashpartitioning\(.*?, (\d+)\)", ran)) == {str(tasks)} and "BroadcastExchange" not in ran


def test_unknown_runs_of_words_leave_no_rows(spark, monkeypatch):
    """Runs of words are made and held against the bitmap in batches, not as rows; over small batches, null and long texts."""
    from parley.operators import search

    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 3, 60]))) for _ in range(80)] + [None]
    items = [" ".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 9]))) for _ in range(60)] + [None]
    plans, write = [], search.stored
    monkeypatch.setattr(search, "stored", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, *a))[1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = search.occurrences(spark.createDataFrame(list(enumerate(texts)), "passage_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(i, p) for i, item in enumerate(items) if item for p, t in enumerate(texts) if t and f" {item} " in f" {t} "}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50
    assert not any("Generate" in p for p in plans)


def test_search_moves_an_index_once_and_leaves_no_tables(spark, sf_dir, monkeypatch):
    """Words of passages move as one string; 100,000 passes are one deal; what a search wrote goes with its result."""
    from pathlib import Path

    from parley.operators import graph, lexical
    from parley.plans import registry
    from parley.plans import search as plans

    moved = lexical.blocks_of(spark.createDataFrame([(1, "a b")], "passage_id long, text string"), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS packed" in moved.split("RepartitionByExpression")[1] and "AS starts" not in moved.split("RepartitionByExpression")[1]
    assert lexical.QUESTIONS > 100_000 >= lexical.ASKED_AT_ONCE
    plans.passage_index(spark, sf_dir)
    at = Path(graph.shared_folder(spark).removeprefix("file://"))
    before = {f.name for f in at.iterdir()}
    whole = sorted(map(tuple, registry.queries()["search_questions"](spark, sf_dir).collect()))
    assert not [f.name for f in at.iterdir() if f.name not in before and f.name.split("-")[0] in ("term", "bounds", "wanted", "first")]
    monkeypatch.setattr(lexical, "ASKED_AT_ONCE", 3)
    assert sorted(map(tuple, registry.queries()["search_questions"](spark, sf_dir).collect())) == whole
