"""Places for models (speech, speakers, text, language), with deterministic stand-ins for tests.

A model is a function over batches; an engine user registers a real one under the same name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 64


def hashed_vectors(texts: pd.Series) -> pd.Series:
    """Unit vectors of hashed words: equal texts are equal, texts that share words are alike."""

    def one(text: str) -> list[float]:
        v = np.zeros(DIMENSIONS)
        for w in (text or "").lower().split():
            d = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[d[0] % DIMENSIONS] += 1 if d[1] & 1 else -1
        norm = np.linalg.norm(v)
        return (v / norm if norm else v).tolist()

    return texts.map(one)


def echo_answers(prompts: pd.Series) -> pd.Series:
    """An answer that names the first fragment of its prompt."""
    return prompts.map(lambda p: '{"answer": "see [1]", "length": ' + str(len(p or "")) + "}")


_MODELS = {"embed": (hashed_vectors, "array<double>"), "generate": (echo_answers, "string")}


def register(name: str, function, kind: str) -> None:
    """Puts a model (a function over pandas Series that gives the SQL type kind) in a place."""
    _MODELS[name] = function, kind


def embed(text: Column, prefix: str = "passage: ") -> Column:
    function, kind = _MODELS["embed"]
    return F.pandas_udf(lambda s: function(s), kind)(F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))))


def generate(prompt: Column) -> Column:
    function, kind = _MODELS["generate"]
    return F.pandas_udf(lambda s: function(s), kind)(prompt)


def vector_bytes(vectors: Column) -> Column:
    """Vectors as little-endian 32-bit floats; null stays null."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return run(vectors)


def bytes_vector(blobs: Column) -> Column:
    """Little-endian 32-bit floats as a vector; null for null and for lengths that aren't multiples of four."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4"))

    return run(blobs)


def _once(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def normalised(vector: Column) -> Column:
    """A vector over its length; one of (nearly) no length stays as it is."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return _once(vector, lambda v: _once(norm(v), lambda n: F.when(n > 1e-12, F.transform(v, lambda x: x / n)).otherwise(v)))


def pooled(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors whose mask is 1, over its length; null where no token counts."""
    kept = F.filter(F.zip_with(tokens, mask, lambda t, m: F.when(m == 1, t)), lambda t: t.isNotNull())

    def mean(rows):
        total = F.aggregate(rows, F.transform(rows[0], lambda x: x * 0.0), lambda s, t: F.zip_with(s, t, lambda a, b: a + b))
        return _once(F.size(rows), lambda n: F.when(n > 0, F.transform(total, lambda x: x / n)))

    return normalised(_once(kept, mean))
