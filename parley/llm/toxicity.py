"""Toxicity scores by a classifier that is held to the same answer when a mentioned group is swapped for another.

Features are the words of a text and their beginnings (so that inflected and compound forms count together), each by the
logarithm of how many distinct words have it. The logistic loss over labelled texts is joined by a penalty: sentences of
these texts that mention a group are written again with other groups of the same kind, and the squared change of the
score is kept small. So words that stand for groups can't carry a verdict that other words should carry.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches, written

#: Words for groups of people, by kind. A word is swapped for the others of its line.
GROUPS = [line.split() for line in """
    women men girls boys
    woman man girl boy
    muslims christians jews hindus buddhists atheists
    muslim christian jewish hindu buddhist atheist
    gay straight lesbian bisexual transgender
    black white asian latino african european arab
    immigrants refugees foreigners natives
    blind deaf disabled old young
    frauen männer mädchen jungen
    muslime christen juden hindus buddhisten
    schwule lesben heterosexuelle
    ausländer einwanderer flüchtlinge einheimische
    femmes hommes filles garçons
    musulmans chrétiens juifs hindous bouddhistes
    noirs blancs asiatiques arabes africains
    immigrés réfugiés étrangers
    mujeres hombres niñas niños
    musulmanes cristianos judíos budistas
    negros blancos asiáticos árabes africanos
    inmigrantes refugiados extranjeros
""".strip().splitlines()]
_WORD = regex.compile(r"\p{L}+")
_SENTENCE = regex.compile(r"[^.!?\n]+")


@dataclass(frozen=True)
class Settings:
    per_class: int = 6_000  # labelled documents of each class that are learned from (expected; fewer labels are all taken)
    features: int = 4_096
    beginnings: tuple[int, ...] = (3, 4, 5, 6, 7)  # letters
    longest: int = 24  # letters of a word that is a feature itself
    sentences: int = 16  # of a document that mention a group, of which pairs are made
    swaps: int = 3  # for each of these sentences
    fairness: float = 2.0  # weight of the squared change of score
    decay: float = 1e-3
    steps: int = 300
    piece: int = 1 << 20  # characters of a text handled at once
    remembered: int = 1 << 17  # words whose features a task keeps


def features_of(word: str, settings: Settings) -> list[str]:
    """A word itself, marked by a dot at its end, and its beginnings."""
    whole = [f"{word}."] if len(word) <= settings.longest else []
    return whole + [word[:n] for n in settings.beginnings if n < len(word)]


def distinct_words(text: str, settings: Settings) -> set[str]:
    found, at = set(), 0
    while at < len(text):
        end = min(len(text), at + settings.piece)
        while end < len(text) and text[end].isalpha():
            end += 1
        found.update(_WORD.findall(text[at:end].lower()))
        at = end
    return found


@dataclass
class Model:
    places: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -math.inf
    settings: Settings = Settings()

    def __post_init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def counts(self, words: set[str]) -> dict[int, int]:
        """How many of the words have each of the model's features."""
        found: dict[int, int] = {}
        for word in words:
            own = self.known.get(word)
            if own is None:
                if len(self.known) >= self.settings.remembered:
                    self.known.clear()
                own = self.known[word] = tuple(self.places[f] for f in features_of(word, self.settings) if f in self.places)
            for i in own:
                found[i] = found.get(i, 0) + 1
        return found

    def score(self, text: str | None) -> float:
        """From 0 to 1; a text without known words has the score of the empty text."""
        counts = self.counts(distinct_words(text or "", self.settings))
        z = self.bias + math.fsum(self.weights[i] * math.log1p(n) for i, n in counts.items())
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


# ---- counterfactual sentences ---------------------------------------------------------------------------------------

_MEMBER = {w: (k, i) for k, line in enumerate(GROUPS) for i, w in enumerate(line)}


def swapped(sentence: str, by: int) -> str:
    """The sentence with every word for a group replaced by the by-th next one of its kind; capitals at the start stay."""

    def other(match):
        word = match.group()
        if (at := _MEMBER.get(word.lower())) is None:
            return word
        line = GROUPS[at[0]]
        new = line[(at[1] + by) % len(line)]
        return new.capitalize() if word[0].isupper() else new

    return _WORD.sub(other, sentence)


def sentence_pairs(text: str, settings: Settings) -> list[tuple[str, str]]:
    """(sentence, the same about others): `sentences` of those that mention a group, chosen by checksum, `swaps` of each."""
    mention = {s for s in _SENTENCE.findall(text) if any(w in _MEMBER for w in _WORD.findall(s.lower()))}
    chosen = sorted(mention, key=lambda s: (zlib.crc32(s.encode()), s))[: settings.sentences]
    return [(s, o) for s in chosen for by in range(1, settings.swaps + 1) if (o := swapped(s, by)) != s]


# ---- learning -------------------------------------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text of the sample, one row each; how many documents each class has in all labels)."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    sizes = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}  # two rows
    part = F.element_at(F.create_map(*(F.lit(x) for c in (0, 1) for x in (c, int(1e6 * min(1.0, settings.per_class / max(1, sizes.get(c, 0))))))), F.col("toxic"))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part)  # about 2 * per_class rows at most, so they can be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), sizes


def chosen_features(sample: DataFrame, sizes: dict[int, int], settings: Settings) -> list[str]:
    """The features that tell most of the class, by the likelihood ratio of their document counts."""

    def count(batches):
        held: dict[str, list[int]] = {}

        def told():
            n = np.array(list(held.values()), dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"feature": list(held), "clean": n[:, 0], "toxic": n[:, 1]})

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for f in {f for w in distinct_words(text, settings) for f in features_of(w, settings)}:
                    held.setdefault(f, [0, 0])[toxic] += 1
                if len(held) > 1 << 20:
                    yield from told()
                    held = {}
        if held:
            yield from told()

    counts = sample.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    all_ = sizes[0] + sizes[1]
    cell = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    both, ratio = F.col("clean") + F.col("toxic"), F.lit(0.0)
    for name, k in (("clean", sizes[0]), ("toxic", sizes[1])):
        ratio += cell(F.col(name), both * (k / all_)) + cell(k - F.col(name), (all_ - both) * (k / all_))
    best = counts.where(both > 1).orderBy(F.desc(F.round(ratio, 9)), "feature").limit(settings.features)  # a parameter of the model
    return [r.feature for r in best.collect()]


def _packed(rows: list[tuple[int, dict[int, float]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "kind": [k for k, _ in rows],
            "places": [np.fromiter(c, np.int32, len(c)).tobytes() for _, c in rows],
            "values": [np.fromiter(c.values(), np.float32, len(c)).tobytes() for _, c in rows],
        },
        schema=pa.schema([("kind", pa.int32()), ("places", pa.binary()), ("values", pa.binary())]),
    )


class Rows:
    """Sparse rows: products with weights and back."""

    def __init__(self, table: pa.Table, size: int):
        places, values = table.column("places").to_pylist(), table.column("values").to_pylist()
        self.n, self.size = len(places), size
        self.row = np.repeat(np.arange(self.n), [len(p) // 4 for p in places])
        self.place = np.frombuffer(b"".join(places), np.int32).astype(np.int64)
        self.value = np.frombuffer(b"".join(values), np.float32).astype(np.float64)

    def times(self, weights):
        return np.bincount(self.row, self.value * weights[self.place], self.n)

    def back(self, errors):
        return np.bincount(self.place, self.value * errors[self.row], self.size)


def fitted(rows: Rows, toxic: np.ndarray, weight: np.ndarray, pairs: Rows, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias: weighted logistic loss, decay, and the mean squared change of score over the pairs."""
    at = np.zeros(rows.size + 1)
    first, second = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, settings.steps + 1):
        error = weight * (1 / (1 + np.exp(-(rows.times(at[:-1]) + at[-1]))) - toxic)
        slope = np.append(rows.back(error) + settings.decay * at[:-1], error.sum())
        if pairs.n:
            slope[:-1] += pairs.back(2 * settings.fairness / pairs.n * pairs.times(at[:-1]))
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        at -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return at[:-1], float(at[-1])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from a sample (Settings.per_class) of the documents that labels names.

    A document with several labels is toxic if one says so; of rows with one doc_id the least text is learned from; null
    ids and labels are passed over. Without documents of both classes each score is the share of the toxic ones.
    """
    small_batches(docs.sparkSession)
    sample, all_sizes = labelled_sample(docs, labels, settings)
    sample = written(sample, "toxicity-sample")
    sizes = {0: 0, 1: 0} | {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}  # two rows
    if not sizes[0] or not sizes[1]:
        return Model(bias=math.inf if sizes[1] else -math.inf, settings=settings)
    names = chosen_features(sample, sizes, settings)
    model = Model({f: i for i, f in enumerate(names)}, np.zeros(len(names)), 0.0, settings)

    def placed(batches):
        logs = lambda s: {i: math.log1p(n) for i, n in model.counts(distinct_words(s, settings)).items()}
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                out.append((toxic, logs(text)))
                for sentence, other in sentence_pairs(text, settings):
                    a, b = logs(sentence), logs(other)
                    change = {i: d for i in a.keys() | b.keys() if (d := b.get(i, 0.0) - a.get(i, 0.0))}
                    if change:
                        out.append((2, change))
            yield _packed(out)

    # Bounded by Settings: about 2 * per_class rows of at most `features` places, and sentences * swaps pairs of each.
    got = sample.mapInArrow(placed, "kind int, places binary, values binary").toArrow().sort_by([("kind", "ascending"), ("places", "ascending"), ("values", "ascending")])
    kind = got.column("kind").to_numpy()
    texts, pairs = got.filter(pa.array(kind < 2)), got.filter(pa.array(kind == 2))
    toxic = kind[kind < 2].astype(float)
    # Each class weighs as in all labels, the toxic ones more by the root of their rarity.
    clean_all, toxic_all = all_sizes.get(0, 0), all_sizes.get(1, 0)
    mass = {0: clean_all, 1: math.sqrt(clean_all * toxic_all) if clean_all > toxic_all else toxic_all}
    weight = np.where(toxic == 1, mass[1] / sizes[1], mass[0] / sizes[0])
    model.weights, model.bias = fitted(Rows(texts, len(names)), toxic, weight / weight.sum(), Rows(pairs, len(names)), settings)
    return model


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted of every row.

    A null text is empty and gets the score of a text without known words. Texts may be of any length; equal texts and
    repeated rows get equal scores; an empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def predict(batches):
        own = Model(model.places, model.weights, model.bias, model.settings)
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return slim.mapInArrow(predict, "doc_id long, score double, predicted int")


def toxicity_report(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labels whose crc32(doc_id) mod 5 is not 0.

    Edge cases as in train() and score_documents(); a null doc_id counts as the empty text.
    """
    model = train(docs, labels.where(crc_mod("doc_id", 5) != 0), settings)
    return score_documents(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
