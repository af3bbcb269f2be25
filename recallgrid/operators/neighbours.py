"""Nearest neighbours of a stated set of query vectors among all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.tables import written

#: Queries and vectors of a block, and its bytes.
QUERY_BLOCK, VECTOR_BLOCK, BYTES = 512, 4096, 1 << 22
#: Decimals to which scores are rounded, so that equal vectors tie wherever they stand, and what that leaves open.
DECIMALS, SLACK = 12, 1e-11


def nearest(queries: DataFrame, vectors: DataFrame, k: int, least: float = -1.0, query_id: str = "query_id", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest of all vectors to each of a stated set of query vectors, by cosine.

    Both sides are packed into rows that hold a block each. Spark pairs the blocks, a task multiplies pairs of them and
    gives the best k of each query in all of its own, and a window takes the best of those; nothing passes the driver. A query
    doesn't find its own id. Zero vectors score 0, rows without an id or vector take no part; all vectors have one length.
    """
    of = lambda df, name: df.select(F.col(name).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    kind = "ids binary, units binary"
    left = of(queries, query_id).mapInArrow(lambda it: _packed(it, QUERY_BLOCK), kind)
    right = of(vectors, id_col).mapInArrow(lambda it: _packed(it, VECTOR_BLOCK), kind).toDF("other_ids", "other_units")
    pairs = written(left).crossJoin(written(right))
    found = pairs.mapInArrow(lambda it: _best(it, k, least), "query_id long, id long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def _packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ``rows`` ids and unit vectors, fewer where they have over BYTES, and over the edges of batches."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        unit = np.concatenate([_units(_matrix(p.column(1))) for p in parts])
        return pa.RecordBatch.from_pydict({"ids": [b"".join(p.column(0).to_numpy().tobytes() for p in parts)], "units": [unit.tobytes()]})

    held, n = [], 0
    for batch in batches:
        at = 0
        most = max(1, min(rows, BYTES // (8 * max(1, len(batch.column(1)[0]))))) if batch.num_rows else rows
        while at < batch.num_rows:
            part = batch.slice(at, most - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == most:
                yield block(held)
                held, n = [], 0
    if held:
        yield block(held)


def first_of_each(query: np.ndarray, at: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of each query by value, then id, and which of them are a k-th."""
    order = np.lexsort((at, -value, query))
    query, at, value = query[order], at[order], value[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    some = place < k
    return query[some], at[some], value[some], place[some] == k - 1


def _best(batches: Iterator[pa.RecordBatch], k: int, least: float) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of each query over the pairs that a task has for its block, one block of queries after another."""
    held, own, left = None, np.zeros(0, np.int64), np.zeros((0, 0))
    query, at, value, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(at), pa.array(value)], ["query_id", "id", "score"])

    for batch in batches:
        for ids, units, others, other_units in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids != held:
                if len(query):
                    yield rows()
                held, own = ids, np.frombuffer(ids, np.int64)
                left = np.frombuffer(units).reshape(len(own), -1)
                query, at, value, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(own), -np.inf)
            found = np.frombuffer(others, np.int64)
            score = left @ np.frombuffer(other_units).reshape(len(found), -1).T
            score[(score < least) | (own[:, None] == found[None, :])] = -np.inf
            if len(found) > 4 * k and not len(query):  # all that tie with the k-th stay until they are ordered
                floor = np.partition(score, -k, axis=1)[:, -k] - SLACK
            some, place = np.nonzero((score >= floor[:, None]) & np.isfinite(score))
            if len(some):
                new = np.round(score[some, place], DECIMALS)
                query, at, value, last = first_of_each(np.append(query, some), np.append(at, found[place]), np.append(value, new), k)
                floor[query[last]] = value[last] - SLACK
    if len(query):
        yield rows()


#: Vectors that the cells are fitted on, rounds of that, most cells, queries that set the number of probes.
SAMPLE, ROUNDS, CELLS, CALIBRATION = 20_000, 8, 1024, 64


def _units(v: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.where(size > 0, size, 1)[:, None]


def _matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def fitted_cells(vectors: DataFrame, cells: int | None = None, id_col: str = "id", vector_col: str = "vector") -> np.ndarray:
    """Centres of cells by spherical k-means on a bounded sample: the SAMPLE vectors with the smallest hashes of their ids.

    Their number is the root of that of all vectors, CELLS at most, unless it is given.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    n = rows.count()
    some = rows.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select(F.col(vector_col).cast("array<double>").alias("v")).toArrow()
    if not n:
        return np.zeros((0, 0))
    own = _units(_matrix(some.column("v")))
    k = max(1, min(cells or min(int(n**0.5), CELLS), len(own)))
    rng = np.random.default_rng(13)
    centres = own[rng.permutation(len(own))[:k]]
    for _ in range(ROUNDS):
        cell = np.concatenate([np.argmax(own[at : at + 1024] @ centres.T, axis=1) for at in range(0, len(own), 1024)])
        total = np.zeros_like(centres)
        np.add.at(total, cell, own)
        empty = np.bincount(cell, minlength=k) == 0
        total[empty] = own[rng.integers(0, len(own), int(empty.sum()))]
        centres = _units(total)
    return centres


def _by_cell(batches: Iterator[pa.RecordBatch], centres: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """(cell, probe, id, unit): each vector in its nearest ``probes`` cells, the nearest first."""
    for batch in batches:
        unit = _units(_matrix(batch.column(1)))
        score = unit @ centres.T
        near = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        data = pa.array([u.tobytes() for u in unit], pa.binary())
        at = pa.array(np.repeat(np.arange(len(unit)), near.shape[1]))
        yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(near.shape[1], dtype=np.int32), len(unit))), batch.column(0).take(at), data.take(at)], ["cell", "probe", "id", "unit"])


def coarse_nearest(queries: DataFrame, vectors: DataFrame, k: int, cells: int | None = None, probes: int | None = None, recall: float = 0.95, query_id: str = "query_id", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``nearest`` in part of the vectors: (query_id, id, score, rank) of each query among those of its nearest cells.

    Every vector is put into the nearest of some cells, a query looks into its nearest ``probes`` of them, and what it
    finds is scored exactly. Without ``probes`` their number is the smallest that finds a share of ``recall`` of the true
    neighbours of CALIBRATION of the queries, those with the smallest hashes, which are compared with all vectors; on
    vectors that lie spread out these are many cells. A cell of any size is cut into blocks, so that one with a third of
    all vectors is many tasks' work. Ids, nulls and ties are as in ``nearest``; scores are exact, neighbours in cells
    that a query doesn't look into are missing.
    """
    spark = vectors.sparkSession
    of = lambda df, name: df.select(F.col(name).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    centres = fitted_cells(vectors, cells, id_col, vector_col)
    if not len(centres):
        return nearest(queries, vectors, k, -1.0, query_id, id_col, vector_col)
    sent = spark.sparkContext.broadcast(centres)
    kind = "cell int, probe int, id long, unit binary"
    own = written(of(vectors, id_col).mapInArrow(lambda it: _by_cell(it, sent.value, 1), kind))
    asked = of(queries, query_id)
    if probes is None:
        some = written(queries.where(F.col(query_id).isNotNull() & F.col(vector_col).isNotNull()).orderBy(F.xxhash64(query_id), query_id).limit(CALIBRATION))
        truth = nearest(some, vectors, k, -1.0, query_id, id_col, vector_col).select(F.col(query_id).alias("q"), F.col(id_col).alias("id")).join(own.select("id", "cell"), "id")
        order = of(some, query_id).mapInArrow(lambda it: _by_cell(it, sent.value, len(centres)), kind).select(F.col("id").alias("q"), "cell", "probe")
        places = sorted(r["probe"] for r in truth.join(order, ["q", "cell"]).select("probe").toLocalIterator())  # k for each of few queries
        probes = places[max(0, int(np.ceil(recall * len(places))) - 1)] + 1 if places else 1
    # A row for each cell: how many blocks its vectors make.
    sizes = own.groupBy("cell").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("blocks"))
    dealt = own.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = "cell int, block int, ids binary, units binary"
    right = written(dealt.select("cell", "block", "id", "unit").groupBy("cell", "block").applyInArrow(_packed_block, packed), maxRecordsPerFile=64).toDF("cell", "block", "other_ids", "other_units")
    looked = asked.mapInArrow(lambda it: _by_cell(it, sent.value, probes), kind)
    many = written(looked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts")))
    looked = looked.join(F.broadcast(many), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    left = looked.select("cell", "block", "id", "unit").groupBy("cell", "block").applyInArrow(_packed_block, packed)
    left = left.join(F.broadcast(sizes), "cell").select("cell", "ids", "units", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    found = left.join(right, ["cell", "block"]).select("ids", "units", "other_ids", "other_units").mapInArrow(lambda it: _best(it, k, -1.0), "query_id long, id long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def _packed_block(rows: pa.Table) -> pa.Table:
    ids, units = rows.column("id").to_numpy().tobytes(), b"".join(rows.column("unit").to_pylist())
    return pa.table({"cell": rows.column("cell").slice(0, 1), "block": rows.column("block").slice(0, 1), "ids": pa.array([ids], pa.binary()), "units": pa.array([units], pa.binary())})
