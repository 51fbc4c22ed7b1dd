"""Streams against their stored twins over shuffled micro-batches, and against plain machines."""

import json
import random

import pytest
from pyspark.sql import functions as F

from parley.operators import lexical
from parley.streaming import chunks, ledger, machines, sessions

START = 1_700_000_000_000


def some_events(seed, keys=4, n=260):
    rnd = random.Random(seed)
    rows = []
    for key in range(keys):
        ts = START + rnd.randrange(1000)
        for _ in range(n):
            ts += rnd.choice([200, 500, 1000, 1000, 7000]) if rnd.random() > 0.01 else 400_000
            kind = rnd.choices(["level", "pause", "resume", "snooze"], [40, 1, 2, 1])[0]
            rows.append((key, ts, kind, rnd.choice([0.0, 0.001, 0.2, 0.5]) if kind == "level" else None))
    return rows


RULES = sessions.WatchRules(voice_ms=900, suggest_ms=4_000, stop_ms=60_000, tail_ms=500)
CUTS = sessions.CutRules(from_ms=50_000, to_ms=70_000, least_ms=900, idle_ms=300_000)


def split(df):
    return df.where("kind = 'level'").select("key", "ts_ms", "value"), df.where("kind <> 'level'").select("key", "ts_ms", F.col("kind").alias("control"))


def replayed(spark, rows, folder, seed, late_ms):
    """The rows as a stream of files; within late_ms they come in any order. A last row of a key of its own ends all."""
    rnd = random.Random(seed)
    end = max(r[1] for r in rows)
    order = sorted(rows, key=lambda r: r[1] + rnd.random() * late_ms * 0.9)
    size = len(order) // 7
    for i in range(0, len(order), size):
        spark.createDataFrame(order[i : i + size], "key long, ts_ms long, kind string, value double").coalesce(1).write.mode("append").parquet(folder)
    for later in (10_000_000, 20_000_000):
        spark.createDataFrame([(-1, end + later, "level", 1.0)], "key long, ts_ms long, kind string, value double").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("key long, ts_ms long, kind string, value double").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("machine,rules", [(sessions.watched, RULES), (sessions.recording_chunks, CUTS)])
def test_stream_equals_stored(spark, tmp_path, machine, rules):
    rows = some_events(5)
    stored = spark.createDataFrame(rows, "key long, ts_ms long, kind string, value double")
    want = sorted(map(tuple, machine(sessions.events_of(*split(stored)), rules).collect()))
    stream = replayed(spark, rows, f"{tmp_path}/in", 6, 30_000)
    got = machines.drained(machine(sessions.events_of(*split(stream), late="30 seconds"), rules), str(tmp_path))
    assert sorted(tuple(r) for r in got.where("key >= 0").collect()) == want and len(want) > 8


@pytest.mark.parametrize("machine,rules", [(sessions.watched, RULES), (sessions.recording_chunks, CUTS)])
def test_keys_share_lanes(spark, tmp_path, monkeypatch, machine, rules):
    """Many keys, a null one and one over several packs among them, in few lanes; timers and calls don't grow with keys."""
    monkeypatch.setattr(sessions, "LANES", 5, raising=False)
    monkeypatch.setattr(sessions, "PART", 7, raising=False)
    rows = [(None if r[0] == 3 else r[0] * (10**16 + 1), *r[1:]) for r in some_events(11, keys=80, n=60)]
    stored = spark.createDataFrame(rows, "key long, ts_ms long, kind string, value double")
    want = sorted(map(tuple, machine(sessions.events_of(*split(stored)), rules).collect()), key=str)
    stream = machine(sessions.events_of(*split(replayed(spark, rows, f"{tmp_path}/in", 12, 30_000)), late="30 seconds"), rules)
    run = stream.writeStream.format("memory").queryName(machine.__name__).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    timers = [json.loads(p.json)["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in run.recentProgress]
    assert 0 < max(timers) <= 2 * (5 + 1)  # a lane's next one and the one that replaced it
    got = spark.table(machine.__name__).where("key is null or key >= 0").collect()
    assert sorted(map(tuple, got), key=str) == want and len(want) > 80 and any(r[0] is None for r in want)


def brute_watch(rows, rules):
    out = []
    for key in {r[0] for r in rows}:
        silence = voice = None
        suggested = paused = False
        order = {k: i for i, k in enumerate(sessions.KINDS)}
        for _, ts, kind, value in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], order[r[2]], r[3] or 0)):
            if kind != "level":
                paused = kind == "pause" or (paused and kind == "snooze")
                silence, voice, suggested = None, None, False
            elif not paused and value >= rules.quiet:
                voice = ts if voice is None else voice
                if ts - voice >= rules.voice_ms:
                    silence, voice, suggested = None, None, False
            elif not paused:
                voice, silence = None, ts if silence is None else silence
                if rules.stop_ms is not None and ts - silence >= rules.stop_ms:
                    out.append((key, ts, "stop", ts - silence, min(silence + rules.tail_ms, ts)))
                    break
                if rules.suggest_ms is not None and not suggested and ts - silence >= rules.suggest_ms:
                    suggested = True
                    out.append((key, ts, "suggest", ts - silence, silence + rules.stop_ms if rules.stop_ms else None))
    return sorted(out)


def test_watch_against_a_plain_machine(spark):
    rows = some_events(7, keys=9)
    events = sessions.events_of(*split(spark.createDataFrame(rows, "key long, ts_ms long, kind string, value double")))
    for rules in (RULES, sessions.WatchRules(voice_ms=0, suggest_ms=2_000, stop_ms=None), sessions.WatchRules(suggest_ms=None, stop_ms=None)):
        assert sorted(map(tuple, sessions.watched(events, rules).collect())) == brute_watch(rows, rules)


def test_cuts():
    """Ten minutes of sound with two silences in the window: the longer one counts, and pauses don't."""
    rules = sessions.CutRules(from_ms=60_000, to_ms=90_000, quiet=0.1, least_ms=1_000)
    quiet = lambda t: 62_000 <= t < 64_000 or 70_000 <= t < 75_000
    machine, out = sessions.Cutter(rules), []
    for t in range(0, 200_000, 1000):
        out += machine.event(t, 3, 0.0 if quiet(t) else 0.5)
    assert out == [(0, 0, 0, 72_000, 0), (0, 1, 72_000, 132_000, 0)]
    machine, out = sessions.Cutter(rules), []
    machine.event(0, 3, 0.5)
    machine.event(1_000, 0, None)
    machine.event(501_000, 1, None)
    for t in range(0, 100_000, 1000):
        out += machine.event(501_000 + t, 3, 0.0 if quiet(t) else 0.5)
    assert out == [(0, 0, 0, 501_000 + 72_000, 500_000)]
    assert machine.end() == [(0, 1, 573_000, 600_000, 0)]
    assert machine.end() == []


def test_ledger(spark, tmp_path):
    table = ledger.VersionedTable(spark, f"{tmp_path}/t")
    assert table.read() is None and table.versions() == []
    add = lambda n: lambda before: spark.range(n, n + 1) if before is None else before.union(spark.range(n, n + 1))
    assert table.apply(0, add(0)) and table.apply(1, add(1))
    assert not table.apply(1, add(7)) and not table.apply(0, add(8))  # replayed batches
    (tmp_path / "t" / "v2").mkdir()  # a batch that died half-way
    assert table.versions() == [0, 1] and table.apply(2, add(2))
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2] and table.versions() == [1, 2]


def test_events_once(spark, tmp_path):
    """Several events of a chunk in one batch, batches that come again, and an unknown event."""
    told = [[(1, 0, 1, "process"), (1, 0, 2, "done"), (2, 0, 1, "done"), (1, 1, 1, "fail")], [(1, 1, 2, "retry"), (1, 1, 3, "process"), (2, 0, 2, "process"), (1, 0, 3, "fail"), (3, 5, 1, "what")]]
    schema = "call_id long, chunk_idx long, order long, event string"
    for part in told:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = ledger.VersionedTable(spark, f"{tmp_path}/chunks")
    want = {(1, 0): "done", (2, 0): "processing", (1, 1): "processing", (3, 5): "pending"}
    for place in ("a", "b"):  # the second run replays every batch
        ledger.follow_events(stream, table, f"{tmp_path}/{place}").awaitTermination()
        assert {(r.call_id, r.chunk_idx): r.status for r in table.read().collect()} == want
    rows = ledger.transitions(spark.createDataFrame([(9, 9, "done")], "call_id long, chunk_idx long, status string"), spark.createDataFrame([x for p in told for x in p], schema)).collect()
    assert {(r.call_id, r.chunk_idx): (r.status, r.accepted, r.refused) for r in rows} == {(1, 0): ("done", 2, 1), (2, 0): ("processing", 1, 1), (1, 1): ("processing", 3, 0), (3, 5): ("pending", 0, 1), (9, 9): ("done", 0, 0)}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_transitions_against_a_plain_fold(spark, monkeypatch, batch):
    """Odd statuses and events, null keys and orders, chunks over many batches; no row is gone through in Python."""
    rnd = random.Random(batch)
    keys = [(None, 1), (1, None), (1, 1), *((i, 0) for i in range(2, 30))]
    own = [(*k, rnd.choice([None, "", "odd", *ledger.STATES])) for k in keys[::2]]
    told = [(*k, rnd.choice([None, 1, 2, i]), rnd.choice(["process", "done", "fail", "retry", "what", "", None])) for k in keys for i in range(rnd.choice([0, 1, 3, 40]))]
    want = {}
    for k in {x[:2] for x in own} | {x[:2] for x in told if x[3] is not None}:
        status, good, bad = next((x[2] for x in own if x[:2] == k), None), 0, 0
        for _, _, _, event in sorted((x for x in told if x[:2] == k and x[3] is not None), key=lambda x: (x[2] is not None, x[2] or 0, x[3])):
            sources, target = chunks.TRANSITIONS.get(event, ((), None))
            ok = (status or "pending") in sources
            status, good, bad = target if ok else status or "pending", good + ok, bad + (not ok)
        want[k] = (status, good, bad)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = ledger.transitions(spark.createDataFrame(own, "call_id long, chunk_idx long, status string"), spark.createDataFrame(told, "call_id long, chunk_idx long, order long, event string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and {(r.call_id, r.chunk_idx): (r.status, r.accepted, r.refused) for r in got} == want
    assert not hasattr(ledger, "in_order")


def test_backfill(spark):
    rows = [(i, f"text {i}") for i in range(25)]
    passages = spark.createDataFrame(rows, "passage_id long, text string")
    index = lexical.build_index(passages.where("passage_id < 4"))
    assert ledger.backfill(index, passages, 10, most_rounds=1) == 1
    assert ledger.backfill(index, passages, 10) == 2 and ledger.backfill(index, passages, 10) == 0
    assert index.lengths().count() == 25


def test_plans(spark):
    rows = spark.createDataFrame([(1, 0, "pending"), (2, 0, "failed"), (3, 0, "processing"), (4, 0, "done")], "call_id long, chunk_idx long, status string")
    got = chunks.plan(rows, spark.createDataFrame([(i, 0) for i in range(1, 6)], "call_id long, chunk_idx long")).collect()
    assert {r.call_id: r.action for r in got} == {1: "run", 2: "rerun", 3: "skip", 4: "skip", 5: "run"}
    rnd = random.Random(1)
    parked = [(e, rnd.randrange(9), i, rnd.random() < 0.5, rnd.random() < 0.8, rnd.randrange(4)) for e in range(6) for i in range(40 * (e > 0) + 3)]
    want = {}
    for e in range(6):
        started = 0
        for _, _, i, text, audio, tries in sorted((p for p in parked if p[0] == e), key=lambda p: (p[1], p[2])):
            action = "stop" if started >= 5 else "no_audio" if not audio else "tries_exhausted" if tries >= 2 else "reprocess" if text else "recover"
            started += action in ("reprocess", "recover")
            want[e, i] = action
    got = chunks.parked_plan(spark.createDataFrame(parked, "event long, place long, call_id long, has_transcript boolean, has_audio boolean, tries int")).collect()
    assert {(r.event, r.call_id): r.action for r in got} == want
