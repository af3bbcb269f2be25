"""Trigram postings, prefix tables, the lexical chain and hybrid search over sets of queries; numbering; tag keys."""

import itertools

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import tags
from recallgrid.functions import text as tx
from recallgrid.operators import lexicon, search, worklist
from recallgrid.tables import numbered

WORDS = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma omega".split()


@pytest.fixture
def uncoalesced(spark):
    """As many partitions as asked for, also of small tables."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def notes(spark, n=120):
    rows = [(i, None if i % 31 == 0 else f"{WORDS[i % 11]} {WORDS[i * 7 % 11]}{i % 5} common") for i in range(n)]
    return spark.createDataFrame(rows, "note_id long, text string")


@pytest.mark.parametrize("least", [0.1, 0.3, 0.6])
def test_trigrams_equal_every_pair(spark, least):
    df = notes(spark)
    queries = spark.createDataFrame([(1, "alpa comon"), (2, "zeta"), (3, ""), (4, "qqq"), (5, "theta4 common gamma"), (6, None), (7, "beta kappa1 commn")], "query_id long, query string")
    pairs = df.where("text is not null").crossJoin(queries).withColumn("rank", tx.trigram_similarity(F.col("text"), F.col("query"))).where(F.col("rank") > least)
    want = {}
    for r in sorted(pairs.collect(), key=lambda r: (r["query_id"], -r["rank"], r["note_id"])):
        want.setdefault(r["query_id"], []).append(r["note_id"])
    got = {}
    for r in sorted(lexicon.fuzzy_each(lexicon.trigram_postings(df), queries, 15, least).collect(), key=lambda r: (r["query_id"], -r["rank"], r["note_id"])):
        got.setdefault(r["query_id"], []).append(r["note_id"])
    assert got == {q: x[:15] for q, x in want.items()} and got


def read_rows(df):
    """Rows that the scan of a collected plan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sum(found)


def test_prefixes_read_few_row_groups(spark, uncoalesced):
    df = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{i:04d} Text") for i in range(2600)] + [(9000, None), (9001, "x" * 200), (9002, "50% off_x")], "note_id long, text string")
    table = lexicon.prefix_table(df)
    assert len(table.inputFiles()) >= 4
    some = table.where((F.col("key") >= "c0") & (F.col("key") <= "c0\U0010ffff"))
    assert 0 < read_rows(some) <= 2 * 2603 / 4  # one file of four, or two where the range goes over an edge
    for query in ("C0", "c000", "zz", "x" * 70, "", "A0026 t", "50%"):
        want = sorted(r["note_id"] for r in df.where(F.startswith(F.lower("text"), F.lit(query.lower()))).collect())[:40]
        assert [r["note_id"] for r in lexicon.prefixed(table, query, 40).collect()] == want
    for query in ("c_0", "%26", "50\\%", "b00_7 T"):
        want = sorted(r["note_id"] for r in df.where(F.col("text").ilike(query + "%")).collect())[:40]
        assert [r["note_id"] for r in lexicon.prefixed(table, query, 40, True).collect()] == want


def test_chain_takes_the_first_stage_with_results(spark):
    df = notes(spark, 60)
    queries = spark.createDataFrame([(1, "alpha common"), (2, "alphq comnom"), (3, "  "), (4, "al"), (5, "zzzz")], "query_id long, query string")
    got = lexicon.lexical_each(df, queries, 5).collect()
    modes = {r["query_id"]: r["mode"] for r in got}
    assert modes[1] == "fts" and modes[2] == "fuzzy" and 3 not in modes and 5 not in modes and modes[4] in ("fuzzy", "autocomplete")
    assert all(len([r for r in got if r["query_id"] == q]) <= 5 for q in modes)


def test_hybrid_fuses_each_query(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a bb", "ccc", "", "dddd d", None])], "note_id long, text string")
    queries = spark.createDataFrame([(1, "q one"), (2, " ")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 0, "c0", 0.9, "text"), (1, 0, "c1", 0.95, "image"), (1, 3, "c2", 0.5, "text"), (1, 77, "c3", 0.99, "text"), (2, 1, "c4", 0.9, "text")], "query_id long, note_id long, chunk_id string, score double, modality string")
    words = spark.createDataFrame([(1, "fts", 1, 2.0, 1), (1, "fts", 3, 1.0, 2), (1, "fts", 2, 0.5, 3)], "query_id long, mode string, note_id long, score double, rank int")
    got = {r["note_id"]: r for r in search.hybrid_each(queries, df, hits, words, 10, semantic_weight=2.0, lexical_weight=1.0).collect()}
    assert set(got) == {0, 1, 2, 3} and got[0]["chunk_id"] == "c1" and got[0]["modality"] == "image"
    assert got[3]["rrf_score"] == pytest.approx(2 / 62 + 1 / 62) and got[3]["sources"] == ["semantic", "fts"] and got[3]["rank"] == 1
    assert [got[i]["rank"] for i in (3, 0, 1, 2)] == [1, 2, 3, 4] and got[1]["semantic_rank"] is None and got[1]["lexical_mode"] == "fts"
    again = {r["note_id"]: r["rank"] for r in search.hybrid_each(queries, df, hits, words, 10, semantic_weight=2.0, scorer=lambda q, t: F.char_length(t).cast("double"), rerank_top=4).collect()}
    assert again == {3: 1, 0: 2, 1: 3, 2: 4}  # by length; the note without a text comes last
    assert {r["note_id"] for r in search.hybrid_each(queries, df, hits, words, 10, "semantic").collect()} == {0, 3}
    assert {r["note_id"] for r in search.hybrid_each(queries, df, hits, words, 2, "lexical").collect()} == {1, 3}
    with pytest.raises(ValueError):
        search.hybrid_each(queries, df, hits, words, 10, "other")


def test_numbers_go_over_partitions(spark, uncoalesced):
    """One kind over many partitions, another in few rows, and no kind."""
    rows = [(("big" if i % 50 else "small") if i % 77 else None, f"{i * 7919 % 5000:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "kind string, id string").repartition(9)
    got = numbered(df, ["id"], "n", ["kind"])
    assert got.columns == ["kind", "id", "n"]
    own = {}
    for r in got.collect():
        own.setdefault(r["kind"], []).append((r["n"], r["id"]))
    for kind, found in own.items():
        assert sorted(found) == list(enumerate(sorted(i for k, i in rows if k == kind), 1))
    assert [r["n"] for r in numbered(df, ["id"], "n").orderBy("id").collect()] == list(range(1, 3001))
    items = df.where("kind is not null").withColumn("slug", F.lit(None).cast("string"))
    sizes = worklist.batched(items, 10).groupBy("cluster_id").count().collect()
    assert max(r["count"] for r in sizes) == 10 and sum(r["count"] for r in sizes) == items.count()


def test_tag_keys_bring_all_near_tags_and_few_others(spark):
    base = ["topic::rust", "topic::rusty", "topic::trust", "skill::alive", "skill::alife", "été", "ete", "eteee", "a", "ab", "abc", "xbc", "xyc", "Topic::Rust", "topic", "日本", "日本語", "zz"] + [f"tag-{i}" for i in range(100, 200)]
    df = spark.createDataFrame([(t,) for t in [*base, "", " a "]], "tag string")
    known = spark.createDataFrame([(t,) for t in base], "tag string")

    def plain(a, b):
        x, y = a.lower(), b.lower()
        if x.startswith(y) or y.startswith(x):
            return 0
        return sum(p != q for p, q in zip(x, y, strict=False)) + abs(len(a.encode()) - len(b.encode()))

    want = {(a, b, d) for a, b in itertools.product(base, base) if a.lower() != b.lower() and (d := plain(a, b)) <= 2}
    got = {(r["tag"], r["suggestion"], r["distance"]) for r in tags.suggestions(df, known, most=1000).collect()}
    assert got == want
    keys = known.withColumn("key", F.explode(tags._segments(F.lower("tag"), 2)))
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] < len(base)  # no key has all tags


def test_only_wanted_stages_run(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "trigram_postings", lambda notes: pytest.fail("trigrams of all notes"))
    notes = spark.createDataFrame([(1, "the is"), (2, "cities")], "note_id long, text string")
    queries = spark.createDataFrame([(1, "the is"), (2, "city")], "query_id long, query string")
    assert [(r["query_id"], r["note_id"]) for r in lexicon.lexical_each(notes, queries, 5, ("fts",)).collect()] == [(2, 2)]
    assert lexicon.lexical_each(notes, queries, 5, ()).count() == 0


def test_texts_are_scored_without_a_shuffle(spark):
    """Few pairs of a query and a note go to the texts, whatever Spark would broadcast by itself."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        notes = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(20)], "note_id long, text string")
        queries = spark.createDataFrame([(1, "word")], "query_id long, query string")
        hits = spark.createDataFrame([(1, 3, "v3", 0.5)], "query_id long, note_id long, chunk_id string, score double")
        found = search.hybrid_each(queries, notes, hits, lexicon.lexical_each(notes, queries, 10, ("fts",)), 10, scorer=lambda q, t: F.char_length(t).cast("double"), rerank_top=4)
        assert "BroadcastHashJoin [note_id" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["rank"] for r in found.collect()) == list(range(1, 11))
    finally:
        spark.conf.set(name, before)


def test_equal_texts_and_queries_are_searched_once(spark, monkeypatch):
    """Copies give the results of a search note by note, ties by id, but their trigrams are looked at once."""
    texts = ["red bolt", "red bolts", "bolt red", "new anvil", "hot ring", "", None]
    notes = spark.createDataFrame([(i, texts[i * i % 7]) for i in range(200)], "note_id long, text string")
    queries = spark.createDataFrame([(i, ["rd bolt", "nw anvl", "xyz", "", None][i % 5]) for i in range(30)], "query_id long, query string")
    want = {(r[0], r[1], round(r[2], 9)) for r in lexicon.fuzzy_each(lexicon.trigram_postings(notes), queries, 40).collect()}
    looked = []
    kept = lexicon.trigram_postings
    monkeypatch.setattr(lexicon, "trigram_postings", lambda n: looked.append(n.count()) or kept(n))
    got = [(r[0], r[1], round(r[2], 9)) for r in lexicon.fuzzy_of_texts(notes, queries, 40).collect()]
    assert set(got) == want and len(got) == len(want)
    assert looked == [len({texts[i * i % 7] for i in range(200)} - {None})]
