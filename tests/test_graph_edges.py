"""Edges by shared tags against all pairs of notes, and how many pairs are made for them."""

import itertools
import random

import pytest

from recallgrid.operators import graph


@pytest.mark.parametrize("seed", range(4))
def test_tag_edges_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    tags = ["abcdef"[: 3 + seed][rng.randrange(3 + seed)] for _ in range(400)]
    notes = [(i, [tags[(i * 3 + j) % 400] for j in range(rng.randrange(1, 4))], rng.random() < 0.1) for i in rng.sample(range(1000), 60)]
    pairs = []
    for (a, x, gone), (b, y, lost) in itertools.combinations(sorted(notes), 2):
        shared = sum(s == t for s in x for t in y)
        if shared >= 2 and not gone and not lost:
            pairs.append((-shared / max(len(x), len(y)), a, b, shared))
    df = spark.createDataFrame(notes, "note_id long, tags array<string>, deleted boolean").repartition(3)
    for most in (1, 7, 60, 5000):
        got = [(-r["weight"], r["source"], r["target"], r["shared"]) for r in graph.tag_edges(df, 2, most).collect()]
        assert got == sorted(pairs)[:most]


def test_only_the_first_sources_of_a_class_are_expanded(spark, monkeypatch):
    """300 notes with the same tags are 44,850 pairs; the best 50 come from one of them."""
    made = []
    kept = graph.written
    monkeypatch.setattr(graph, "written", lambda df: made.append(kept(df)) or made[-1])
    df = spark.range(300).selectExpr("id AS note_id", "array('a', 'b') AS tags", "false AS deleted")
    assert [(r["source"], r["target"]) for r in graph.tag_edges(df, 2, 50).collect()] == [(0, i) for i in range(1, 51)]
    assert made[-1].count() == 1 and made[-2].count() == 51
