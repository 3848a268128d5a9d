"""A deterministic text embedder: hashed words with signs, normalised. It stands in for a model file."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_words(text: str, dimensions: int) -> list[float]:
    codes = np.array([zlib.crc32(w.encode()) for w in (text or "").lower().split()], np.int64)
    out = np.bincount(codes % dimensions, np.where(codes >> 20 & 1, 1.0, -1.0), minlength=dimensions) if len(codes) else np.zeros(dimensions)
    norm = float(np.linalg.norm(out))
    return (out / norm if norm else out).astype(np.float32).tolist()


def embed(df: DataFrame, key: str, text: str, dimensions: int = 64) -> DataFrame:
    """(key, embedding) of every row; empty texts have the zero vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "embedding": [hashed_words(t, dimensions) for t in frame["_text"]]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("_text")).mapInPandas(run, f"{key} {kind}, embedding array<float>")
