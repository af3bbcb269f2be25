import itertools

import numpy as np
import pytest

from recallgrid.llm import embedding_dedup as ed
from tests.llm.conftest import reachable


def cosine(a, b):
    return float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))


@pytest.mark.parametrize(("kind", "block"), [("float", 1024), ("double", 8)])
def test_equals_brute_force(spark, monkeypatch, kind, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    rng = np.random.default_rng(3)
    vectors = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e30] * 16, [1e-30] * 16]
    for center in rng.standard_normal((8, 16)):
        vectors += [(center + 0.12 * rng.standard_normal(16)).tolist() for _ in range(12)]
    vectors += [vectors[20]] * 5 + rng.standard_normal((40, 16)).tolist()
    n = len(vectors)
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    v = [np.array(x, np.float32 if kind == "float" else np.float64).astype(np.float64) if ok else None for x, ok in zip(vectors, good, strict=True)]
    links = {(i, j) for i, j in itertools.combinations(range(n), 2) if good[i] and good[j] and len(v[i]) == len(v[j]) and cosine(v[i] / abs(v[i]).max(), v[j] / abs(v[j]).max()) >= 0.9}
    rows = spark.createDataFrame([(i, x, 1) for i, x in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, kept int")
    got = {r["vec_id"]: r for r in ed.near_duplicate_vectors(rows).collect()}
    assert [got[i]["component_id"] for i in range(n)] == reachable(n, links)
    assert [got[i]["n_links"] for i in range(n)] == [sum(i in p for p in links) for i in range(n)]


def test_null_ids_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in ed.near_duplicate_vectors(rows).collect())
    assert got == [("1", 0, "1", True), ("2", 1, "2", True), ("2", 1, "2", True), ("None", 0, "None", True)]
    assert ed.near_duplicate_vectors(rows.limit(0)).count() == 0


def test_passes_follow_the_number_of_vectors():
    agree = 1 - np.arccos(0.9) / np.pi
    for n in (10**5, 10**6, 10**7, 10**8):
        passes = ed.passes_for(n, 0.9)
        assert 1 - (1 - agree ** np.log2(n / ed.NEIGHBOURS)) ** passes >= ed.RECALL
    assert ed.passes_for(0, 0.9) == ed.passes_for(10, 1.0) == ed.PASSES < ed.passes_for(10**6, 0.9)


def test_windows_go_on_over_partition_edges(spark):
    """One pass over a few sorted vectors on many partitions: all are within the window of each other."""
    rng = np.random.default_rng(4)
    center = rng.standard_normal(16)
    vectors = [(center + 0.1 * rng.standard_normal(16)).tolist() for _ in range(24)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ed.near_duplicate_vectors(rows, passes=1).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert {r["component_id"] for r in got} == {0}


def cone(rng, n, size, common, at, pairs):
    """Unit vectors of mean cosine ``common``, and near ones of the first ``pairs`` of them at cosine ``at``."""
    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    axis = np.eye(1, size)
    side = lambda k: unit(np.hstack([np.zeros((k, 1)), rng.standard_normal((k, size - 1))]))
    one, two = side(n), side(pairs)
    two -= np.einsum("ij,ij->i", two, one[:pairs])[:, None] * one[:pairs]
    r = (at - common) / (1 - common)
    near = r * one[:pairs] + np.sqrt(1 - r * r) * unit(two)
    return np.vstack([np.sqrt(common) * axis + np.sqrt(1 - common) * x for x in (one, near)]).astype(np.float32)


@pytest.mark.parametrize("common", [0.0, 0.5, 0.7])
def test_recall_on_vectors_with_a_common_direction(spark, common):
    """Windows of 16 among 3,200 vectors stand for the default ones among 50 thousand."""
    pairs, at = 200, 0.905 if common < 0.7 else 0.92
    v = cone(np.random.default_rng(6), 3000, 96, common, at, pairs)
    exact = v.astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    want = (exact @ exact.T >= 0.9).sum() - len(v)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    found = ed.near_duplicate_vectors(rows, neighbours=16).agg({"n_links": "sum"}).first()[0]
    assert want >= 2 * pairs and found >= 0.95 * want
