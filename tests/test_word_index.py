"""Notes of whole query sets by postings of stems in blocks, and what the tasks of these searches give."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import search
from recallgrid.operators import word_index as wi

WORDS = "the cities glasses running talked boldly classes bus gas is sed ties Pedales sing ing wedly Ünïts x9s 3s news".split()
TEXTS = [(i, " ".join(WORDS[(i * j + j) % len(WORDS)] for j in range(i % 13))) for i in range(400)] + [(7, "cities glasses"), (8, None), (None, "cities"), (900, "the is")]


def plain(texts, queries, limit, spark):
    """Every note that has all stems of a query, without an index."""
    stems = {r["id"]: r["s"] for r in spark.createDataFrame([(str(k), t) for k, t in texts], "id string, t string").groupBy("id").agg(F.array_join(F.collect_list("t"), " ").alias("t")).select("id", search.stems(F.col("t")).alias("s")).collect()}
    out = set()
    for q, text in queries:
        own = set(spark.range(1).select(search.stems(F.lit(text))).first()[0])
        found = [(-sum(n for w, n in Counter(s).items() if w in own) / (1 + math.log(1 + len(s))), int(k)) for k, s in stems.items() if k != "None" and own and own <= set(s)]
        out |= {(q, k, round(-score, 9)) for score, k in sorted(found)[:limit]}
    return out


def test_stems_equal_the_columns(spark):
    df = spark.createDataFrame([(w.lower(),) for w in WORDS + ["ss", "sses", "asses", "aasses", "ies", "s", "ed", "aaaed"]], "w string")
    assert {r[0]: r[1] for r in df.select("w", search.stem(F.col("w"))).collect()} == {r[0]: wi.stemmed(r[0]) for r in df.collect()}


@pytest.mark.parametrize("most, postings", [(8192, 1 << 20), (3, 1 << 20), (100, 5)])
def test_best_notes_equal_a_plain_scan(spark, most, postings):
    """Shared ids are one note, and blocks of any size give the same notes."""
    queries = [(1, "city"), (2, "Glass class"), (3, "the is"), (4, "runs talking bold"), (5, "nothing like it"), (6, "unït")]
    notes = spark.createDataFrame(TEXTS, "note_id long, text string").repartition(3)
    got = wi.best_notes(notes, spark.createDataFrame(queries, "query_id long, query string"), 5, lambda n: wi.note_blocks(n, most, postings))
    assert {(r[0], r[1], round(r[2], 9)) for r in got.collect()} == plain(TEXTS, queries, 5, spark)


def test_candidates_are_not_shuffled(spark):
    """A stem that all notes have: a task gives the best of its notes, not all of them."""
    blocks = list(wi._blocks(wi._bags(iter(spark.range(5000).select(F.col("id"), F.lit("same words").alias("text")).toArrow().to_batches())), 500, 1 << 20))
    asked = next(wi._query_blocks(iter(spark.createDataFrame([(9, "same")], "query_id long, query string").toArrow().to_batches()), 10))
    pairs = [type(b).from_arrays([*asked.columns, *b.columns], [*asked.schema.names, *b.schema.names]) for b in blocks]
    assert len(pairs) == 10 and [b.to_pydict()["id"] for b in wi._best(iter(pairs), 3)] == [[0, 1, 2]]
