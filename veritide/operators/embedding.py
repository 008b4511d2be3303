"""From texts to vectors through an injected embedder, with a hashing one for where no model is at hand."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritide.functions import text as X


@dataclass(frozen=True)
class Embedder:
    """A column function from text to a vector of ``size`` numbers. Queries may be led by words of their own."""

    name: str
    size: int
    embed: Callable[[Column], Column]
    query_prefix: str = ""


def hashing(size: int = 64) -> Embedder:
    """Counts of index tokens by the first 32 bits of their MD5 modulo size, of length 1: the same on every machine."""
    token = re.compile(X.TOKEN)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def one(text: str) -> np.ndarray:
            words = token.findall(text.lower())
            for w in words:
                if w not in known:
                    known[w] = int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:8], 16) % size
            counts = np.bincount([known[w] for w in words], minlength=size).astype(float) if words else np.zeros(size)
            return counts / max(np.sqrt((counts**2).sum()), 1e-300)

        return pd.Series([one(t or "") for t in texts])

    return Embedder(f"hashing-{size}", size, run)


def of_model(name: str, size: int, batch: Callable[[list[str]], list], query_prefix: str = "") -> Embedder:
    """An embedder from a function of a batch of texts: any model outside the library. A vector of another size is an error."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        vectors = [list(map(float, v)) for v in batch(texts.fillna("").tolist())]
        if len(vectors) != len(texts) or any(len(v) != size for v in vectors):
            raise ValueError(f"{name}: {len(texts)} vectors of {size} numbers expected")
        return pd.Series(vectors)

    return Embedder(name, size, run, query_prefix)


def chunks(df: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """df with embedding and the embedder's name."""
    return df.withColumn("embedding", embedder.embed(F.col(text))).withColumn("embedder", F.lit(embedder.name))


def queries(df: DataFrame, embedder: Embedder, query: str = "query") -> DataFrame:
    """df with qvec."""
    return df.withColumn("qvec", embedder.embed(F.concat(F.lit(embedder.query_prefix), F.col(query))))
