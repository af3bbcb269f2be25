"""Neighbours by cells against all vectors, spread out and crowded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import neighbours


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")


def spread(rng):
    return rng.standard_normal((3000, 24))


def skewed(rng):
    """A third of all vectors in one tight group, the others in groups of uneven sizes."""
    centres = rng.standard_normal((30, 24))
    of = np.where(rng.random(3000) < 1 / 3, 0, np.minimum(rng.geometric(0.15, 3000), 29))
    return centres[of] + 0.3 * rng.standard_normal((3000, 24))


@pytest.mark.parametrize("made", [spread, skewed])
def test_recall_against_all_vectors(spark, monkeypatch, made):
    monkeypatch.setattr(neighbours, "VECTOR_BLOCK", 200)  # so that a hot cell is many blocks
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 16)
    v = frame(spark, made(np.random.default_rng(8))).cache()
    queries = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]): r["score"] for r in neighbours.nearest(queries, v, 20).collect()}
    rows = neighbours.coarse_nearest(queries, v, 20).collect()
    got = {(r["query_id"], r["id"]): r["score"] for r in rows}
    assert len(rows) == len(got) and len(set(got) & set(exact)) >= 0.9 * len(exact)
    assert all(abs(got[x] - exact[x]) < 1e-12 for x in set(got) & set(exact))
    assert all(q != i for q, i in got) and {r["rank"] for r in rows} == set(range(1, 21))
    every = {(r["query_id"], r["id"]) for r in neighbours.coarse_nearest(queries, v, 20, probes=neighbours.CELLS).collect()}
    assert every == set(exact)  # all cells are all vectors


def test_empty_and_null(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (None, [1.0, 1.0]), (3, None)], "id long, vector array<double>")
    q = v.withColumnRenamed("id", "query_id")
    got = sorted((r["query_id"], r["id"]) for r in neighbours.coarse_nearest(q, v, 5).collect())
    assert got == [(1, 2), (2, 1)]
    assert neighbours.coarse_nearest(q, v.limit(0), 5).collect() == []


def test_nearest_gives_the_best_of_a_task_once(spark):
    """Blocks go over the edges of batches, and the pairs of one block of queries give k rows a query together."""
    rows = spark.range(3000).select("id", F.array(F.cos("id"), F.sin("id"), F.lit(0.3)).alias("v")).toArrow().to_batches(100)
    assert [len(b.column("ids")[0].as_py()) // 8 for b in neighbours._packed(iter(rows), 1024)] == [1024, 1024, 952]
    left, right = next(neighbours._packed(iter(rows[:1]), 512)), list(neighbours._packed(iter(rows), 250))
    pairs = [type(b).from_arrays([*left.columns, *b.columns], ["ids", "units", "other_ids", "other_units"]) for b in right]
    assert len(pairs) == 12 and sum(b.num_rows for b in neighbours._best(iter(pairs), 20, -1.0)) == 100 * 20


def test_equal_vectors_tie_wherever_they_stand(spark):
    v = [0.1 * ((i * 7919) % 97 - 48) for i in range(67)]
    rows = spark.createDataFrame([(i, [x + (0.5 if i % 50 == 49 else 0.0) for x in v]) for i in range(1003)], "id long, vector array<double>")
    got = neighbours.nearest(rows.where("id = 0").withColumnRenamed("id", "query_id"), rows, 900).orderBy("rank").collect()
    assert [r["id"] for r in got] == [i for i in range(1, 1003) if i % 50 != 49][:900]
