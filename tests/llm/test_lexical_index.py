"""The length-stratified index against scoring every document, with and without strata to pass by."""

import math
import os
import re
from collections import Counter

import duckdb
import pytest

from recallgrid.llm import lexical_index, registry

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """{item: [(doc_id, score)]} by the stated formula."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counts if c]
    n, total = len(lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(terms(text))
    out = {}
    for item, own in wanted.items():
        rows = []
        for i, c in counts:
            if c:
                m = 100 - 50 + 50 * sum(c.values()) * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
                rows.append((-score, i is None, i or 0, i)) if score > 0 else None
        out[item] = [(r[3], -r[0]) for r in sorted(rows)[:k]]
    return {i: x for i, x in out.items() if x}


def gathered(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


@pytest.fixture
def corpus(rng):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.7 else "the" for _ in range(rng.choice([1, 2, 3, 20, 20, 20, 400]))) for _ in range(600)]
    texts += [None, "", " .!? ", "Éa éa THE 9", texts[5], texts[5], "the " * 30_000, "b" * 200_000]
    ids = [*range(600), 600, 601, 602, 603, 604, 605, 606, 607]
    ids[7] = ids[9] = 5  # ids that repeat
    ids[20] = None
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) + " The") for i in range(25)]
    items += [(30, None), (31, ""), (32, "zzzz nothing has this"), (None, "the"), (3, "THE éa 9"), (33, "the")]
    return list(zip(ids, texts, strict=True)), items


@pytest.mark.parametrize("k", [5, 50])
def test_results_equal_scoring_everything(spark, corpus, monkeypatch, k):
    docs, items = corpus
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, m string").repartition(7)
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    want = plain(docs, items, k)
    assert gathered(lexical_index.search(d, b, k)) == want
    whole = lexical_index.index(d)  # of all terms
    assert gathered(lexical_index.ranked(whole, b, k)) == want
    assert whole.shards.agg({"m": "count"}).first()[0] > 1
    monkeypatch.setattr(lexical_index, "BLOCK_BYTES", 100)  # several blocks of items
    assert gathered(lexical_index.ranked(whole, b, k)) == want


def test_large_strata_are_cut(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical_index, "DOCUMENTS", 10)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    of = lexical_index.index(d)
    assert of.shards.selectExpr("max(size(doc_ids)) AS n").first()["n"] <= 40  # dealt by row number, not counted one by one
    assert gathered(lexical_index.ranked(of, b, 10)) == plain(docs, items, 10)


def test_bounds_pass_strata_by():
    """The scorer opens only strata whose bound reaches the score held, and the bound is never under a score."""
    import pyarrow as pa

    def shard(m, docs):
        rows = pa.table({"m": pa.array([m] * len(docs)), "shard": pa.array([0] * len(docs)), "row": pa.array(range(len(docs))), "doc_id": pa.array([m * 1000 + i for i in range(len(docs))]), "terms": pa.array([list(c) for c in docs]), "tfs": pa.array([list(c.values()) for c in docs], pa.list_(pa.int32()))})
        return lexical_index._shard(rows).to_batches()[0]

    block = lexical_index.Queries([("q", "a", 3000), ("q", "b", 5000)])
    batches = [shard(50, [{"a": 3, "b": 1}, {"b": 2}]), shard(900, [{"a": 1, "b": 1}, {"a": 9}]), shard(55, [{"c": 4}])]
    bounds = [block.bounds(s)[0][0] for x in batches for s in lexical_index._shards(x)]
    scores = [s["score"] for x in batches for y in lexical_index._visited(iter([x]), block, 1) for s in y.to_pylist()]
    assert bounds[2] == 0 and bounds[0] >= scores[0] and bounds[1] >= scores[1] and len(scores) == 2
    block.least[0] = bounds[1] + 1
    assert list(lexical_index._visited(iter([batches[1]]), block, 1))[0].num_rows == 0
    block.least[0] = bounds[1]
    opened = []
    real = lexical_index.impact
    try:
        lexical_index.impact = lambda tf, m: (opened.append(m), real(tf, m))[1]
        batch = pa.Table.from_batches([batches[1], batches[0]]).combine_chunks().to_batches()[0]
        list(lexical_index._visited(iter([batch]), block, 1))
    finally:
        lexical_index.impact = real
    assert opened.count(50) == 2 and opened.count(900) == 1  # bounded both, opened one


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_index.search(d, b).collect() == []
    assert lexical_index.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), b.limit(0)).collect() == []
    assert lexical_index.search(spark.createDataFrame([(1, None), (2, "!")], "doc_id long, text string"), b).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_query_equals_its_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = {tuple(r) for r in db.execute(registry.ORACLES["op12_length_strata"]).fetchall()}
    got = {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in registry.QUERIES["op12_length_strata"](spark, FOLDER).collect()}
    assert got == want and got
