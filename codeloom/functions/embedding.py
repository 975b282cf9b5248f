"""The hashing embedder: a text as the normalised sum of vectors that its words' hashes stand for.

The tables and sums are of 32-bit floats and the norm of 64-bit ones, word by word in order, so that vectors are the
same everywhere. There is no built-in expression for this, so it is an Arrow UDF; each worker keeps the vectors of words
it has seen, up to a bound.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dimension, size of the sine table, words kept by a worker.
DIM, TABLE, CACHE = 768, 10_000, 10_000

_SINE = np.array([math.sin(i / TABLE * math.pi * 2) for i in range(TABLE)], np.float64).astype(np.float32)
_DROP = re.compile(r"[^A-Za-z0-9_\s]")


def word_hash(word: str) -> int:
    h = 0
    for c in word:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


def _word_vector(word: str, dim: int) -> np.ndarray:
    at = np.abs(np.fmod(word_hash(word) + 1000 * np.arange(dim, dtype=np.int64), TABLE))
    return ((_SINE[at].astype(np.float64) + 1) / 2).astype(np.float32)


def embed(text: str | None, dim: int = DIM, cache: dict[str, np.ndarray] | None = None) -> list[float]:
    """The unit vector of a text; all zeros without words."""
    v = np.zeros(dim, np.float32)
    for w in _DROP.sub(" ", (text or "").lower()).split():
        x = cache.get(w) if cache is not None else None
        if x is None:
            x = _word_vector(w, dim)
            if cache is not None and len(cache) < CACHE:
                cache[w] = x
        v += x
    v = v.astype(np.float64)
    norm = math.sqrt(float((v * v).sum()))
    return (v / norm if norm else v).tolist()


def strip_comments(code: Column) -> Column:
    """Code without comments and with single spaces."""
    code = F.regexp_replace(code, r"/\*[\s\S]*?\*/", "")
    return F.trim(F.regexp_replace(F.regexp_replace(code, r"(?m)//.*$", ""), r"\s+", " "))


def text_embedding(text: Column, dim: int = DIM) -> Column:
    cache: dict[str, np.ndarray] = {}

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: embed(t, dim, cache))

    return run(text)


def code_embedding(code: Column, dim: int = DIM) -> Column:
    return text_embedding(strip_comments(code), dim)
