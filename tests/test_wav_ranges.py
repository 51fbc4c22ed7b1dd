"""Ranges of WAV files against whole reads."""

import struct
import wave

import numpy as np
import pytest

from parley.sources import wav_ranges as W


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder, rng, made = tmp_path_factory.mktemp("wavs"), np.random.default_rng(1), {}
    for name, channels, kind, n in (("a/mono", 1, "<i2", 1000), ("b/stereo", 2, "<i2", 777), ("c/float", 1, "<f4", 500), ("d/floats", 3, "<f4", 333), ("e/none", 1, "<i2", 0)):
        path = folder / f"{name}.wav"
        path.parent.mkdir(exist_ok=True)
        x = rng.uniform(-1, 1, (n, channels))
        raw = (x * 32767).astype("<i2") if kind == "<i2" else x.astype("<f4")
        if kind == "<i2":
            with wave.open(str(path), "wb") as w:
                w.setnchannels(channels)
                w.setsampwidth(2)
                w.setframerate(100)
                w.writeframes(raw.tobytes())
        else:
            data = raw.tobytes()
            fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 3, channels, 100, 400 * channels, 4 * channels, 32)
            path.write_bytes(struct.pack("<4sI4s", b"RIFF", 0, b"WAVE") + struct.pack("<4sI", b"LIST", 3) + b"abc\0" + fmt + struct.pack("<4sI", b"data", 0) + data)  # never finished
        value = raw.astype(np.float32) / (np.float32(32768) if kind == "<i2" else 1)
        made[f"file://{path}"] = value.mean(1, dtype=np.float32)
    return f"file://{folder}", made


@pytest.mark.parametrize("frames", [64, 5000])
def test_ranges_make_the_whole(spark, files, frames):
    uri, made = files
    got = {}
    rows = W.wav_ranges(spark, uri, frames).orderBy("path", "first").collect()
    for r in rows:
        assert len(r.samples) <= frames and r["rate"] == 100
        got.setdefault(r.path, []).extend(r.samples)
    assert set(got) == set(made)
    for path, want in made.items():
        assert np.allclose(got[path], want, atol=1e-7)


def test_slices(spark, files):
    uri, made = files
    wanted = [(p, a, b, i) for i, p in enumerate(made) for a, b in ((0.0, 1.0), (1.254, 2.5), (-5.0, 0.1), (3.0, 1e9), (9e9, 1e10), (1.0, 1.0))]
    df = spark.createDataFrame(wanted, "path string, start_sec double, end_sec double, tag int")
    rows = W.slices(df).collect()
    assert len(rows) == len(wanted)
    for r in rows:
        a, b = (int(np.floor(max(0, x) * 100 + 0.5)) for x in (r.start_sec, r.end_sec))
        assert np.allclose(r.samples, made[r.path][a:b], atol=1e-7), (r.path, a, b)
    with pytest.raises(Exception, match="ends before"):
        W.slices(spark.createDataFrame([(next(iter(made)), 2.0, 1.0)], "path string, start_sec double, end_sec double")).collect()


def test_unreadable_files(spark, files, tmp_path):
    uri, made = files
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    (tmp_path / "good.wav").write_bytes(open(next(iter(made))[7:], "rb").read())
    with pytest.raises(Exception, match="no WAV file"):
        W.wav_ranges(spark, f"file://{tmp_path}").collect()
    assert {r.path for r in W.wav_ranges(spark, f"file://{tmp_path}", skip_unreadable=True).collect()} == {f"file://{tmp_path}/good.wav"}
    parts = [(1, 0, f"file://{tmp_path}/good.wav"), (1, 1, f"file://{tmp_path}/bad.wav"), (1, 2, f"file://{tmp_path}/none.wav"), (1, 3, f"file://{tmp_path}/good.wav")]
    (row,) = W.joined_ranges(spark.createDataFrame(parts, "call_id int, idx int, uri string"), "call_id").collect()
    assert (row["rate"], row.frames) == (100, 2000)
    with pytest.raises(Exception, match="no chunk can be read"):
        W.joined_ranges(spark.createDataFrame(parts[1:3], "call_id int, idx int, uri string"), "call_id").collect()
