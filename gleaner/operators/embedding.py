"""Embedding of passages by a pluggable function of batches of texts."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

#: Rows and characters of a call; waits before the second and third try after a failed connection.
BATCH_ROWS, BATCH_CHARS, WAITS = 30, 48_000, (1.0, 3.0)


def batches(texts: list[str], rows: int = BATCH_ROWS, chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Consecutive batches that end once they have so many rows or characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if len(held) >= rows or size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def tried(embed: Callable[[list[str]], np.ndarray], texts: list[str], waits: tuple[float, ...] = WAITS) -> np.ndarray:
    """One call, again after failed connections and timeouts; other errors, and the last of these, fail the task."""
    for wait in waits:
        try:
            return embed(texts)
        except (ConnectionError, TimeoutError):
            time.sleep(wait)
    return embed(texts)


def hashed(texts: list[str]) -> np.ndarray:
    """A stand-in where no model is at hand: 32 numbers from 0 to 1 from the digest of a text."""
    return np.array([[b / 255 for b in hashlib.sha256(t.encode()).digest()] for t in texts], dtype=np.float32)


def embedded(passages: DataFrame, text: str, embed: Callable[[list[str]], np.ndarray] = hashed, rows: int = BATCH_ROWS, chars: int = BATCH_CHARS, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """Add ``embedding``; null texts have none. The function is shipped to the tasks, which call it batch by batch."""

    @pandas_udf(ArrayType(FloatType()))
    def vectors(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            out = np.full(len(column), None, dtype=object)
            known = np.flatnonzero(column.notna())
            found = [v for part in batches(column.iloc[known].tolist(), rows, chars) for v in np.asarray(tried(embed, part, waits), dtype=np.float32)]
            for at, vector in zip(known, found):
                out[at] = vector
            yield pd.Series(out)

    return passages.withColumn("embedding", vectors(F.col(text)))
