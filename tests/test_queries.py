"""Each registered query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from recallgrid.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    found = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(v) for v in r) for r in found.select(*columns).collect()), key=str)
    if name not in registry.ORACLES:
        assert got
        return
    rows = db.execute(registry.ORACLES[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rows.fetchall()), key=str)


def test_sparse_scores_cover_the_stated_query_set(spark, db):
    got = {r[0] for r in registry.QUERIES["vec04_all_sparse_scores"](spark, FOLDER).select("query_id").distinct().collect()}
    want = {r[0] for r in db.execute("SELECT doc_id FROM documents WHERE doc_id % 20 = 0 AND regexp_matches(text, '[\\p{L}\\p{N}]')").fetchall()}
    assert got == want


def test_all_sparse_scores_leave_no_pair_out(spark, db):
    """Every document that shares a token with a query has a row, the query itself too: none is cut at a rank."""
    got = {(r[0], r[1]) for r in registry.QUERIES["vec04_all_sparse_scores"](spark, FOLDER).select("query_id", "doc_id").collect()}
    tokens = "SELECT DISTINCT doc_id, lower(regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g')) AS t FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents)"
    want = set(db.execute(f"WITH t AS ({tokens}) SELECT DISTINCT a.doc_id, b.doc_id FROM t a JOIN t b USING (t) WHERE t <> '' AND a.doc_id % 20 = 0").fetchall())
    assert got == want
    assert max(sum(q == x for q, _ in got) for x in {q for q, _ in got}) > 60


def test_all_sparse_scores_of_odd_documents(spark, tmp_path):
    """Ids that are null, negative or shared, texts that are null or without a token, and copies."""
    texts = [(0, "a b b c"), (0, "c d"), (20, "a"), (20, None), (-20, "b, B! c"), (None, "a d"), (None, "d e"), (1, "a b b c"), (2, "--- ..."), (3, ""), (40, None), (60, "?"), (80, "zz"), (5, "e e e"), (7, "a " * 3000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'" if t != "documents" else f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted((tuple(plain(v) for v in r) for r in con.execute(registry.ORACLES["vec04_all_sparse_scores"]).fetchall()), key=str)
    got = registry.QUERIES["vec04_all_sparse_scores"](spark, str(tmp_path)).select("query_id", "doc_id", "score").collect()
    assert sorted((tuple(plain(v) for v in r) for r in got), key=str) == want
    assert (0, None) in {r[:2] for r in want} and (20, 20) in {r[:2] for r in want}


def test_a_half_is_rounded_by_its_double_as_in_the_sql(spark, monkeypatch):
    """1.0175815 is a little less than that as a double."""
    scores = [1.0175815, 0.0000005, 0.1234565, 2.5000005, 3.0]
    found = spark.createDataFrame([(0, i, x, i) for i, x in enumerate(scores)], "query_id long, id long, score double, rank int")
    monkeypatch.setattr(registry.sparse_index, "best_documents", lambda *a: found)
    got = registry.QUERIES["vec04_best_sparse_scores"](spark, FOLDER).orderBy("rank").collect()
    con = duckdb.connect()
    assert [r["score"] for r in got] == [con.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in scores]
