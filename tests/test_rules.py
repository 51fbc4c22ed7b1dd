"""Rules and ordered folds against plain twins over random inputs."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from parley.functions import labels
from parley.operators import folds, graph, processing, recap
from parley.sources import audio
from parley.sources.stt import NOISE


def brute_untagged(text):
    s = text.lstrip()
    while s.startswith("[") and "]" in s:
        inner = s[1 : s.index("]")]
        if len(inner) > 40 or not any(k in inner.lower() for k in NOISE):
            break
        s = s[s.index("]") + 1 :].lstrip()
    return s.rstrip()


def brute_once(text):
    ws = text.split()
    for n in range(1, len(ws) // 3 + 1):
        if len(ws) >= 6 and len(ws) % n == 0 and ws == ws[:n] * (len(ws) // n):
            return " ".join(ws[:n])
    return text.strip()


def test_noise_tags_and_loops(spark):
    rnd = random.Random(1)
    tag = lambda: rnd.choice(["[Музыка]", "[ШУМ ]", "[laut: Musik]", "[meeting]", f"[{'x' * rnd.randrange(30, 40)}noise]", "[", "]", "[music", "[]", "[[music]"])
    texts = ["".join(rnd.choice([" ", "\t", ""]) + tag() for _ in range(rnd.randrange(4))) + rnd.choice([" привет", "hello [music]", ""]) for _ in range(300)]
    texts += [rnd.choice([" ", ""]) + "".join(w + rnd.choice([" ", "  ", "\t", " \n"]) for w in [rnd.choice(["a", "b", "да"]) for _ in range(rnd.randrange(1, 4))] * rnd.randrange(1, 7)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", labels.without_noise_tags(F.col("t")).alias("a"), labels.unrepeated(F.col("t")).alias("b"))
    for r in df.collect():
        assert r.a == brute_untagged(r.t) and r.b == brute_once(r.t), r.t


def test_peaks(spark):
    rnd = random.Random(2)
    for n in (1, 3, 8):
        rows = [([rnd.choice([0.0, rnd.uniform(-1, 1)]) for _ in range(rnd.randrange(40))], rnd.choice([0.0, 0.5, 3.0]), rnd.choice([1.0, 4.0, 99.0])) for _ in range(40)]
        df = spark.createDataFrame(rows, "s array<double>, a double, b double").select("*", audio.peaks(F.col("s"), F.lit(4), F.col("a"), F.col("b"), n).alias("p"))
        for r in df.collect():
            part = r.s[int(r.a * 4) : max(int(r.a * 4), int(r.b * 4))]
            width = max(1, len(part) // n)
            top = [max(map(abs, part[i * width : (i + 1) * width]), default=0.0) for i in range(n)]
            assert r.p == pytest.approx([x / max(top) if max(top) else 0.0 for x in top])


def test_spans():
    rnd = random.Random(3)
    for _ in range(200):
        spans, all_ = folds.Spans(), []
        for _ in range(rnd.randrange(12)):
            a = rnd.randrange(40)
            b = rnd.choice([a, a + rnd.randrange(12), math.inf])
            spans.add(a, b)
            all_.append((a, b))
        assert [t in spans for t in range(60)] == [any(a <= t < b for a, b in all_) for t in range(60)]
        assert spans.starts == sorted(spans.starts) and all(x < y for x, y in zip(spans.ends, spans.starts[1:], strict=False))


def brute_nearest(rows, window):
    out = []
    for p, a, b, tag in rows:
        if tag == "?":
            near = [(0 if x <= b and y >= a else a - y if y < a else x - b, q, t) for q, x, y, t in rows if t != "?"]
            best = min((n for n in near if n[0] <= window), default=(0, 0, "?"))
            out.append((p, best[2]))
    return sorted(out)


def test_nearest_known_intervals(spark):
    rnd, rows = random.Random(4), []
    for key in range(60):
        for p in range(rnd.randrange(1, 30)):
            a = rnd.randrange(100)
            rows.append((key, rnd.randrange(10**6) * 100 + p, a, a + rnd.choice([0, 1, 5, 30, 100]), rnd.choice(["?", "?", "x", "y", "z"])))
    df = spark.createDataFrame(rows, "key long, place long, a long, b long, tag string")
    for window in (0.0, 7.0, 1000.0):
        got = {}
        for r in folds.nearest_known_intervals(df, "key", "place", "a", "b", "tag", "?", window).collect():
            got.setdefault(r.key, []).append((r.place, r.resolved))
        for key in range(60):
            assert sorted(got.get(key, [])) == brute_nearest([r[1:] for r in rows if r[0] == key], window), (key, window)


def test_assembly(spark):
    rnd, rows = random.Random(5), []
    for key in range(20):
        for rank in range(80):
            start = rnd.choice([None, rnd.randrange(100)])
            rows.append((key, rank, rank * 7 % 80, rnd.choice("abc"), f"t{rnd.randrange(60)}", rnd.random() < 0.7, start, rnd.choice([None, (start or 0) + rnd.randrange(20)]), rnd.randrange(1, 60), key % 2 == 0))
    df = spark.createDataFrame(rows, "k long, rank long, passage_id long, call_id string, text string, is_transcript boolean, start long, end long, tokens long, scoped boolean")
    got = {(r.k, r.passage_id): (r.outcome, r.place, r.total) for r in folds.assembled(df, "k", budget=200, per_call=3).collect()}
    for key in range(20):
        texts, spans, calls, total, place = set(), [], [], 0, 0
        for _, _, p, call, text, spoken, a, b, tokens, scoped in sorted(r for r in rows if r[0] == key):
            if text in texts or spoken and a is not None and any(c == call and x <= a < y for c, x, y in spans):
                want = ("duplicate", None)
            elif not scoped and calls.count(call) >= 3:
                want = ("call_full", None)
            elif total + tokens > 200:
                want = ("over_budget", None)
            else:
                total, place = total + tokens, place + 1
                texts.add(text)
                calls.append(call)
                if a is not None:
                    spans.append((call, a, math.inf if b is None else b))
                want = ("taken", place)
            assert got[key, p] == (*want, total)


def test_places_and_first_items(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([None, 1, 2, 3, 4]), rnd.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x int, k int").repartition(5)
    placed = graph.numbered(df, [F.desc("x"), "id"], "place").orderBy("place").collect()
    assert [r.place for r in placed] == list(range(1, 501))
    assert [r.id for r in placed] == [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    assert graph.numbered(df.limit(0), ["id"], "place").count() == 0
    got = {(r.k, r.place): r.x for r in folds.first_distinct(df.where("x is not null"), "k", "x", "id", 3).collect()}
    for k in range(5):
        seen = list(dict.fromkeys(r[1] for r in rows if r[2] == k and r[1] is not None))[:3]
        assert [got[k, i] for i in range(1, len(seen) + 1)] == seen


def test_no_local_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = Conf

    with pytest.raises(ValueError, match="checkpoint"):
        graph.shared_folder(Session())
    assert re.match(r".+", graph.shared_folder(spark))


def brute_window(needle, text):
    needle, text = " ".join(needle.lower().split()), " ".join(text.lower().split())
    if not needle or needle in text:
        return float(bool(needle))
    needle = needle[:200]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    m = len(needle)
    windows = [text] if len(text) <= m else [text[i : i + m] for i in range(len(text) - m + 1)]
    return max(0.0, max(1 - distance(needle, w) / m for w in windows))


def test_quotes_in_windows(spark):
    rnd, rows = random.Random(7), []
    for _ in range(120):
        text = "".join(rnd.choice("abcd é\n") for _ in range(rnd.randrange(0, 60)))
        at = rnd.randrange(max(1, len(text)))
        quote = list(text[at : at + rnd.randrange(1, 30)])
        for _ in range(rnd.randrange(4)):
            if quote:
                quote[rnd.randrange(len(quote)) : rnd.randrange(len(quote) + 1)] = rnd.choice("abX")
        rows.append((text, "".join(quote).upper() if rnd.random() < 0.3 else "".join(quote)))
    rows += [("x" * 300 + "abc" * 100, "abc" * 70 + "Z"), ("", "a"), ("a", ""), (None, None)]
    for r in spark.createDataFrame(rows, "t string, q string").select("t", "q", recap.window_similarity(F.col("t"), F.col("q")).alias("s")).collect():
        assert r.s == pytest.approx(brute_window(r.q or "", r.t or "")), (r.t, r.q)
    for q, t in ((r[1] or "", r[0] or "") for r in rows):
        whole = brute_window(q, t)
        assert recap.best_window(q, t, 0.8) == pytest.approx(whole if whole >= 0.8 else 0.0) or len(" ".join(t.split())) <= len(" ".join(q.split())[:200])
    text = " ".join(f"word{rnd.randrange(1000)}" for _ in range(20_000))
    began = time.time()
    assert recap.best_window(text[5000:5100] + "?" + text[5102:5180], text) > 0.98
    assert time.time() - began < 5


def test_recap_lists(spark):
    item = lambda text, quote=None: {"text": text, "quote": quote}
    kind = "array<struct<text:string,quote:string>>"
    rows = [
        (1, "We ship on Friday, all of us.", [item("ship it", "ship on fridax"), item("Ship IT"), item("  "), item("call them", "nobody said this")], None, [item("who pays the bill")], [("a", "Ann"), ("A ", "Bob"), ("b", "ann")]),
        (2, "", [], [], None, None),
    ]
    recaps = spark.createDataFrame(rows, f"call_id int, t string, action_items {kind}, decisions {kind}, open_questions {kind}, participants array<struct<tag:string,name:string>>")
    clean = recap.cleaned(recaps, "t")
    one = clean.where("call_id = 1").first()
    assert [tuple(i) for i in one.action_items] == [("ship it", "ship on fridax"), ("call them", None)]
    assert one.decisions == [] and [p.tag for p in one.participants] == ["a"]
    old = spark.createDataFrame([(c, 0, "old", None) for c in (1, 2, 3)], "call_id int, place long, text string, quote string")
    tables, odd = processing.persisted_lists(dict.fromkeys(recap.LISTS, old), clean)
    got = {n: sorted((r.call_id, r.text) for r in df.collect()) for n, df in tables.items()}
    assert got == {"action_items": [(1, "call them"), (1, "ship it"), (2, "old"), (3, "old")], "decisions": [(2, "old"), (3, "old")], "open_questions": [(1, "who pays the bill"), (2, "old"), (3, "old")]}
    assert [(r.call_id, r.problems) for r in odd.collect()] == [(2, ["blank"])]
