"""Dense and sparse vectors."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.session import spread

#: White space in the sense of Unicode, and words that a worker remembers.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
REMEMBERED = 500_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def mock_embedding(text: Column, dimension: int) -> Column:
    """A repeatable stand-in for an embedding: the bytes of a SHA-256, repeated, scaled to [-1, 1]."""
    digest = F.sha2(text, 256)
    at = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (at(i) / 127.5 - 1).cast("float"))


def tokens(text: Column) -> Column:
    """White-space separated words, letters and digits only, lower case."""
    cleaned = F.transform(F.split(text, r"(?U)\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    return F.filter(cleaned, lambda w: w != "")


def token(word: str) -> str:
    """A word's letters and digits in lower case, as ``tokens`` has them."""
    return (word if word.isalnum() else "".join(c for c in word if c.isalnum())).lower()


class _Remembered(dict):
    """What ``of`` makes of a word, kept for the words that come again."""

    def __init__(self, of) -> None:
        self.of = of

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = self.of(word)
        return out


def token_bags(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens, counts): the distinct tokens of each row's text and how often it has them; a null text has none.

    A text's words are counted where the text is, so nothing is shuffled and no word becomes a row.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Remembered(token)
        for batch in batches:
            names, counts, ends = [], [], [0]
            for text in batch.column(1).to_pylist():
                bag: dict[str, int] = {}
                for word, n in Counter(_WHITE.split(text or "")).items():
                    if name := known[word]:
                        bag[name] = bag.get(name, 0) + n
                names.extend(bag)
                counts.extend(bag.values())
                ends.append(len(names))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(names, pa.string())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], [id_col, "tokens", "counts"])

    return spread(docs.select(id_col, F.col(text_col).cast("string").alias("text"))).mapInArrow(bags, f"`{id_col}` {kind}, tokens array<string>, counts array<long>")


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, n): how often each row's text has each token."""
    each = token_bags(docs, id_col, text_col).select(id_col, F.explode(F.arrays_zip("tokens", "counts")).alias("t"))
    return each.select(id_col, F.col("t.tokens").alias("token"), F.col("t.counts").alias("n"))


def token_index(word: str) -> int:
    """The index of a word's token: the first four bytes of its SHA-256, lowest first; -1 for a word without one."""
    name = token(word)
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:4], "little") if name else -1


def sparse_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, idx, weight): the sparse vector of each row as two arrays, indices ascending.

    Weights are 1 + ln(count), of unit length together; a row without tokens has empty arrays. One map, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Remembered(token_index)
        for batch in batches:
            idx, weight, ends = [np.zeros(0, np.int64)], [np.zeros(0)], [0]
            for text in batch.column(1).to_pylist():
                bag = Counter(_WHITE.split(text or ""))
                own, place = np.unique(np.fromiter((known[w] for w in bag), np.int64, len(bag)), return_inverse=True)
                n = np.bincount(place, np.fromiter(bag.values(), np.float64, len(bag)), len(own))[own >= 0]
                w = 1 + np.log(n)
                idx.append(own[own >= 0])
                weight.append(w / np.sqrt(w @ w) if len(w) else w)
                ends.append(ends[-1] + len(w))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (idx, weight))], [id_col, "idx", "weight"])

    return spread(docs.select(id_col, F.col(text_col).cast("string").alias("text"))).mapInArrow(vectors, f"`{id_col}` {kind}, idx array<long>, weight array<double>")


def sparse_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, idx, weight): ``sparse_documents`` with one row per index."""
    each = sparse_documents(docs, id_col, text_col).select(id_col, F.explode(F.arrays_zip("idx", "weight")).alias("t"))
    return each.select(id_col, F.col("t.idx").alias("idx"), F.col("t.weight").alias("weight"))


def sparse_scores(queries: DataFrame, rows: DataFrame, n_docs: DataFrame, query_col: str, id_col: str) -> DataFrame:
    """(query, id, score): dot products over shared indices, each weighed by its inverse document frequency.

    The frequency weight is ln(1 + (N - n + 0.5) / (n + 0.5)); ``n_docs`` is one row with N. Only indices of the queries
    are read from the inverted rows.
    """
    wanted = rows.join(queries.select("idx").distinct(), "idx", "left_semi")
    df = wanted.groupBy("idx").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_docs))
    idf = df.select("idx", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    q = queries.join(idf, "idx").select(query_col, "idx", (F.col("weight") * F.col("idf")).alias("qw"))
    return wanted.join(q, "idx").groupBy(query_col, id_col).agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))


def similarity_of(distance: Column) -> Column:
    """1 for no distance, falling to 0."""
    return 1 / (1 + distance)
