"""Recordings in packs against the samples they were made of."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.sources import wav_ranges as W


def test_recordings_are_packed(spark, tmp_path):
    """Many short recordings share files and are read like files of their own, whole, in ranges and by slices."""
    rng, made = np.random.default_rng(3), {}
    rows = [(f"{i % 7}/ё {i}", 100, 1 + i % 2, i % 3 == 2, rng.uniform(-1.2, 1.2, [0, 1, 3, 40, 700][i % 5]).tolist()) for i in range(300)]
    for name, _, channels, is_float, samples in rows:
        x = np.array(samples)
        both = [x] + [x / 2] * (channels - 1)
        made[name] = np.mean([y.astype("<f4") if is_float else (np.clip(y, -1, 1) * 32767).astype("<i2") / 32768 for y in both], axis=0)
    kind = "name string, rate int, channels int, is_float boolean, samples array<double>"
    folder, named = f"file://{tmp_path}/made", lambda path: path.partition("#")[2].partition("/")[2].removesuffix(".wav")
    for _ in range(2):  # written anew
        told = {named(r.path): (r.path, r.frames) for r in W.write_wavs(spark.createDataFrame(rows, kind).repartition(3, "name"), folder).collect()}
        files = [f for f in (tmp_path / "made").rglob("*") if f.is_file() and not f.name.startswith(".")]
        assert 1 <= len(files) <= 3 and {k: v[1] for k, v in told.items()} == {r[0]: len(r[4]) for r in rows}
    got = {}
    for r in W.wav_ranges(spark, folder, 64).orderBy("path", "first").collect():
        assert len(r.samples) <= 64 and r.path == told[named(r.path)][0]
        got.setdefault(named(r.path), []).extend(r.samples)
    assert set(got) == set(made) and all(np.allclose(got[k], v, atol=1e-6) for k, v in made.items())
    wanted = spark.createDataFrame([(p, a, b) for p, _ in told.values() for a, b in ((0.0, 0.02), (0.01, 1e9))], "path string, start_sec double, end_sec double")
    for r in W.slices(wanted).collect():
        a, b = (int(min(x, 1e6) * 100 + 0.5) for x in (r.start_sec, r.end_sec))
        assert np.allclose(r.samples, made[named(r.path)][a:b], atol=1e-6)


def test_packs_with_long_and_broken_recordings(spark, tmp_path):
    folder = f"file://{tmp_path}"
    long = np.linspace(-1, 1, W.TASK_FRAMES + 5_000)
    rows = [("a", 100, 1, False, [0.5, 0.25]), ("b", 100, 1, False, long.tolist()), ("c", 100, 1, False, [-0.5])]
    kind = "name string, rate int, channels int, is_float boolean, samples array<double>"
    assert W.write_wavs(spark.createDataFrame(rows, kind).coalesce(1), folder).count() == 3
    assert len(list(tmp_path.glob("*.wavs"))) == 3  # a long recording stands alone
    ranges = W.wav_ranges(spark, folder, 1 << 19).select("path", "first", F.size("samples").alias("n")).collect()
    assert sorted((r.path[-5:], r["first"], r.n) for r in ranges) == [("a.wav", 0, 2), ("b.wav", 0, 1 << 19), ("b.wav", 1 << 19, 1 << 19), ("b.wav", 1 << 20, 5_000), ("c.wav", 0, 1)]
    first = sorted(tmp_path.glob("*.wavs"))[0]
    first.write_bytes(first.read_bytes()[:-1])
    with pytest.raises(Exception, match="ends within a recording"):
        W.wav_ranges(spark, folder).collect()
    assert {r.path[-5:] for r in W.wav_ranges(spark, folder, skip_unreadable=True).collect()} == {"b.wav", "c.wav"}
