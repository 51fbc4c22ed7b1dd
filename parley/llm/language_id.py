"""Language identification by error-correcting output codes.

Every language gets a codeword. One binary classifier per bit (log odds of hashed byte n-grams) predicts it, and the
language whose codeword loses least, weighted by how well each classifier does for each language, is chosen.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, small_batches, text_views, written

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes other than letters become blanks: digits and marks say little about a language.
_BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    hash_bits: int = 17
    orders: tuple[int, ...] = (2, 3, 4)
    smoothing: float = 0.5
    weighing_rows: int = 20_000  # expected rows of the sample that weighs the classifiers; the counts take all rows
    ambiguous_below: float = 0.6  # a score below this is flagged
    piece: int = 1 << 18  # bytes of a text handled at once


def buckets(view, settings: Settings):
    """Hashed n-grams of one text (lower-cased, framed by blanks), piece by piece."""
    data = np.frombuffer(b" " + str(view, "utf-8").lower().encode().translate(_BLANKED) + b" ", dtype=np.uint8).astype(np.uint64)
    blank = data == 32
    data = data[~(blank & np.append(False, blank[:-1]))]  # one blank between words
    longest = max(settings.orders)
    for start in range(0, len(data), settings.piece):
        part = data[start : start + settings.piece + longest - 1]
        for n in settings.orders:
            count = min(len(part) - n + 1, settings.piece)
            if count <= 0:
                continue
            code = np.full(count, n, dtype=np.uint64)
            for i in range(n):
                code = code << np.uint64(8) | part[i : i + count]
            yield ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - settings.hash_bits)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all splits of up to 5 languages, else the best of seeded random codes."""
    if n < 2:
        return np.zeros((n, 0), dtype=np.int8)
    if n <= 5:
        splits = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(splits, dtype=np.int8).T
    bits, rng, best, most = math.ceil(10 * math.log2(n)), np.random.default_rng(1), None, -1
    for _ in range(200):
        code = rng.choice(np.array([1, -1], dtype=np.int8), size=(n, bits))
        agree = code.astype(int) @ code.T
        least = (bits - (agree - np.eye(n) * 4 * bits).max()) / 2 if n > 1 else bits
        if least > most and (np.abs(code.astype(int).sum(0)) < n).all():
            best, most = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # buckets x bits
    weight: np.ndarray  # languages x bits
    scale: np.ndarray  # bits
    settings: Settings

    def outputs(self, view) -> np.ndarray | None:
        """The mean log odds of each bit; None for a text without n-grams."""
        total, n = np.zeros(self.odds.shape[1]), 0
        for index in buckets(view, self.settings):
            total += self.odds[index].sum(0, dtype=np.float64)
            n += len(index)
        return total / n if n else None

    def predict(self, view) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, ambiguous); without a letter or a learned language (UNKNOWN, 0, True)."""
        if not self.languages or not _LETTER.search(str(view, "utf-8")):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = np.clip(self.outputs(view) / self.scale, -20, 20)
        loss = (self.weight * np.log1p(np.exp(-2 * self.code * margin))).sum(1)
        chance = np.exp(-(loss - loss.min()) * self.code.shape[1] / 2)
        best = int(loss.argmin())
        score = float(chance[best] / chance.sum())
        return self.languages[best], score, score < self.settings.ambiguous_below


def counted(rows: DataFrame, settings: Settings) -> DataFrame:
    """lang, bucket, n: how often each hashed n-gram occurs in the texts of each language; bucket -1 counts the texts."""

    def count(batches):
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}
        texts: dict[str, int] = {}

        def told(language):
            n = np.bincount(np.concatenate(held.pop(language)), minlength=1 << settings.hash_bits)
            at, texts_ = np.flatnonzero(n), texts.pop(language)
            sizes[language] = 0
            return pa.RecordBatch.from_pydict({"lang": [language] * (len(at) + 1), "bucket": np.append(at, -1), "n": np.append(n[at], texts_)})

        for batch in batches:
            for language, view in zip(batch.column("lang").to_pylist(), text_views(batch.column("text")), strict=True):
                own = held.setdefault(language, [np.zeros(0, dtype=np.int64)])
                texts[language] = texts.get(language, 0) + 1
                for index in buckets(view, settings):
                    own.append(index)
                    sizes[language] = sizes.get(language, 0) + len(index)
                if sizes.get(language, 0) > 1 << 21:
                    yield told(language)
        for language in list(held):
            yield told(language)

    return rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def bit_odds(found: DataFrame, languages: list[str], code: np.ndarray, settings: Settings) -> np.ndarray:
    """buckets x bits: the log odds of each hashed n-gram for each bit, worked out where the counts lie.

    The driver gets 2^hash_bits rows of one number per bit, however many languages there are.
    """
    size, number = 1 << settings.hash_bits, {x: i for i, x in enumerate(languages)}
    totals = {r.lang: r.n for r in found.where("bucket >= 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row per language
    per = 1.0 / np.array([totals.get(x, 0) + settings.smoothing * size for x in languages])
    plus, minus = (code > 0) / np.maximum(1, (code > 0).sum(0)), (code < 0) / np.maximum(1, (code < 0).sum(0))
    floor = settings.smoothing * per
    step = 1 << max(0, settings.hash_bits - 8)

    def odds(group: pa.Table) -> pa.Table:
        at, n = group.column("bucket").to_numpy() % step, group.column("n").to_numpy()
        lang = np.array([number[x] for x in group.column("lang").to_pylist()], dtype=np.int64)
        sums = np.zeros((2, step, code.shape[1]))
        for side, share in enumerate((plus, minus)):
            np.add.at(sums[side], at, share[lang] * (n * per[lang])[:, None])
            sums[side] += floor @ share
        value = (np.log(sums[0]) - np.log(sums[1])).astype(np.float32)
        first = group.column("part")[0].as_py() * step
        lists = pa.ListArray.from_arrays(pa.array(np.arange(step + 1) * code.shape[1], pa.int32()), pa.array(value.ravel()))
        return pa.table({"bucket": np.arange(first, first + step), "odds": lists})

    parts = found.where("bucket >= 0").withColumn("part", F.floor(F.col("bucket") / step).cast("long"))
    got = parts.groupBy("part").applyInArrow(odds, "bucket long, odds array<float>").toArrow()
    out = np.tile((np.log(floor @ plus) - np.log(floor @ minus)).astype(np.float32), (size, 1))  # of buckets that no text has
    out[got.column("bucket").to_numpy()] = got.column("odds").combine_chunks().flatten().to_numpy().reshape(-1, code.shape[1])
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> Model:
    """Learns from all rows of docs whose text and lang are not null; no rows give a model that answers `und`.

    All languages that occur are learned. Equal texts and repeated rows count each time; empty texts count as texts only.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    found = written(counted(rows, settings), "language-counts")
    texts = {r.lang: r.n for r in found.where("bucket = -1").collect()}  # a row per language
    languages = sorted(texts)
    if len(languages) < 2:
        return Model(languages, codewords(len(languages)), np.zeros((1, 0)), np.zeros((len(languages), 0)), np.zeros(0), settings)
    code = codewords(len(languages))
    odds = bit_odds(found, languages, code, settings)
    model = Model(languages, code, odds, np.ones(code.shape), np.ones(code.shape[1]), settings)
    every = max(1, sum(texts.values()) // settings.weighing_rows)
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)

    number = {x: i for i, x in enumerate(languages)}

    def weigh(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for language, view in zip(batch.column("lang").to_pylist(), text_views(batch.column("text")), strict=True):
                if (out := model.outputs(view)) is not None:
                    right = out * code[number[language]] > 0
                    for b in range(code.shape[1]):
                        sums.setdefault((language, b), np.zeros(3))
                        sums[language, b] += (1, right[b], abs(out[b]))
        if sums:
            names, bits, totals = [k[0] for k in sums], [k[1] for k in sums], np.array(list(sums.values()))
            yield pa.RecordBatch.from_pydict({"lang": names, "bit": bits} | {x: totals[:, i] for i, x in enumerate(("n", "right", "size"))})

    weighed = sample.mapInArrow(weigh, "lang string, bit long, n double, right double, size double").groupBy("lang", "bit").agg(*(F.sum(x).alias(x) for x in ("n", "right", "size"))).toPandas()
    size, n = np.zeros(code.shape[1]), np.zeros(code.shape[1])
    accuracy = np.full(code.shape, 0.5)
    for r in weighed.itertuples():
        accuracy[number[r.lang], r.bit] = r.right / r.n
        size[r.bit] += r.size
        n[r.bit] += r.n
    weight = np.maximum(accuracy, 0.01)
    model.weight = weight / weight.sum(1, keepdims=True)
    model.scale = np.where(size > 0, size / np.maximum(n, 1), 1.0)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs with a language, its score and whether it is ambiguous added, under names that docs must not have.

    A null or empty text, or one without a letter, gives `und`, score 0; texts may be of any length. Equal texts and
    repeated rows get equal answers; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    if taken := set(names) & set(docs.columns):
        raise ValueError(f"docs has the columns {sorted(taken)} already; give other names")
    schema = T.StructType(list(docs.schema.fields)).add(names[0], "string").add(names[1], "double").add(names[2], "boolean")

    def predict(batches):
        for batch in batches:
            got = [model.predict(v) for v in text_views(batch.column(text))]
            columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return docs.mapInArrow(predict, schema)


def language_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: trained on the rows whose crc32(key) mod 3 is not 1.

    One row per row of docs, whatever further columns it has. Null and empty texts and those without a letter give `und`;
    equal texts and repeated rows get equal answers and each count in training; texts may be of any length; without
    labelled rows all answers are `und`; an empty table gives no rows.
    """
    held = (crc_mod(key, 3) == 1).alias("held_out")
    model = train(docs.where(crc_mod(key, 3) != 1))
    return identify(docs.select(F.col(key).alias("doc_id"), held, "text"), model).drop("text")
