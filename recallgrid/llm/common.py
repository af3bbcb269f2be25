"""Shared pieces of the corpus operators: rows by id, runs of sorted batches and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of ids that may be broadcast.
BROADCAST_ROWS = 500_000


def chosen(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is in ``ids``, a written table of one column: by broadcast if it is counted as small,
    so that wide rows stay where they are, else by a shuffle of both."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, "left_semi")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as ``df`` needs to have no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of some rows, so that what is made of a part in Python stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Cuts batches that are sorted by ``keys`` into one frame for each key; holds one key's rows and one batch."""
    held: pd.DataFrame | None = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if batch.empty:
            continue
        k = batch[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        start = 0
        for cut in cuts:
            yield batch.iloc[start:cut]
            start = cut
        held = batch.iloc[start:]
    if held is not None:
        yield held


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over a uint64 array (wraps around)."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)
