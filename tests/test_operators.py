import datetime as dt
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import cardbook, documents, duplicates, filters, graph, neighbours, reports, search, sync, topics, worklist
from recallgrid.operators.components import components
from recallgrid.sources import collection as source
from recallgrid.streaming import reviews as streams
from recallgrid.tables import Store, inserted, soft_deleted, upserted



def now():
    return F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(rows(components(spark.createDataFrame(chain, "a long, b long"), "a", "b")))
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_subtrees_have_no_wildcards(spark):
    t = spark.createDataFrame([(i, p, p) for i, p in enumerate(["a", "a/b", "a/b/c", "x", "ab", "a_x", "a_x/y", "aZx/y"])], "topic_id int, path string, label string")
    under = lambda r: [x[0] for x in t.where(topics.in_subtree(F.col("path"), r)).orderBy("path").select("path").collect()]
    assert under("a") == ["a", "a/b", "a/b/c"] and under("a_x") == ["a_x", "a_x/y"]
    tree = topics.tree_rows(t, "a").collect()
    assert topics.nested(tree, "a") == [{"path": "a", "label": "a", "children": [{"path": "a/b", "label": "a/b", "children": [{"path": "a/b/c", "label": "a/b/c", "children": []}]}]}]
    with pytest.raises(ValueError):
        topics.gaps(t, t, least=0)


def test_filters_and_requests(spark):
    f = filters.Filters(tags=(" a ", ""), min_ivl=25).normalized()
    assert f.tags == ("a",) and filters.translated(f).mature_only and not filters.translated(filters.Filters(min_ivl=5)).mature_only
    for bad in ({"limit": 0}, {"semantic_weight": -1}, {"rerank_top": 0}, {"mode": "x"}):
        with pytest.raises(ValueError):
            filters.SearchRequest("q", **bad)


@pytest.fixture
def notes(spark):
    return spark.createDataFrame([(1, "rust ownership borrowing rules", ["rust"], False), (2, "postgres migrations testing", ["postgres"], False), (3, "rust", None, True)], "note_id long, text string, tags array<string>, deleted boolean")


def test_lexical_chain(notes):
    active = notes.where("not deleted")
    mode, found = search.lexical(active, "owned the Rules")
    assert mode == "fuzzy"
    mode, found = search.lexical(active, "ownership rule")
    assert mode == "fts" and [r["note_id"] for r in found.collect()] == [1] and "<b>ownership</b>" in found.first()["headline"]
    assert search.lexical(active, "  ")[0] == "none" and search.lexical(active, "zzzz")[0] == "none"
    assert [r["note_id"] for r in search.autocomplete(active, "POST", 5).collect()] == [2]


def test_fusion_and_rerank(spark, notes):
    s = spark.createDataFrame([(1, 1, 0.9), (2, 2, 0.8)], "note_id long, rank int, score double")
    t = spark.createDataFrame([(2, 1, 5.0, "h2"), (3, 2, 4.0, "h3")], "note_id long, rank int, score double, headline string")
    got = {r["note_id"]: (r["rrf_score"], r["sources"]) for r in search.fused(s, t).collect()}
    assert got == {2: (pytest.approx(1 / 62 + 1 / 61), ["semantic", "fts"]), 1: (pytest.approx(1 / 61), ["semantic"]), 3: (pytest.approx(1 / 62), ["fts"])}
    assert search.fusion_stats(search.fused(s, t)).first() == (1, 1, 1, 3)
    order = search.reranked(search.fused(s, t), notes.where("note_id <> 3"), lambda text: -F.char_length(text), 2)
    assert [r["note_id"] for r in order.collect()] == [2, 1, 3]
    hits = spark.createDataFrame([(1, "1:a", 0.5), (1, "1:b", 0.7), (2, "2:a", 0.6)], "note_id long, chunk_id string, score double")
    found, stats = search.hybrid(filters.SearchRequest("rust"), notes.where("not deleted"), hits)
    assert [(r["note_id"], r["chunk_id"]) for r in found.collect()] == [(1, "1:b"), (2, "2:a")] and stats.first()["both"] == 1
    found, _ = search.hybrid(filters.SearchRequest("rust", mode="semantic"), notes.where("not deleted"), hits)
    assert {tuple(r["sources"]) for r in found.collect()} == {("semantic",)}


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    monkeypatch.setattr(neighbours, "VECTOR_BLOCK", 3)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)] + [(8, None)], "id long, vector array<double>")
    q = v.where("id < 5").withColumnRenamed("id", "query_id")
    got = rows(search.nearest(q, v, 2, 0.9).select("query_id", "id"))
    assert (3, 4) in got and (3, 5) in got and all(a != b for a, b in got)


def test_duplicates(spark):
    pairs = spark.createDataFrame([(1, 2, 0.99), (2, 3, 0.95), (5, 6, 0.5)], "a long, b long, similarity double")
    reps = spark.createDataFrame([(1, 4), (2, 4), (3, 1)], "note_id long, total_reps long")
    assert rows(duplicates.clusters(pairs, reps)) == [(1, 3, 2, 0.99), (1, 3, 3, 0.0)]
    slugs = spark.createDataFrame([(2, "s2"), (3, "s3")], "note_id long, slug string")
    items = {r["slug"]: r for r in duplicates.scanner_items(duplicates.clusters(pairs, reps), slugs).collect()}
    assert (items["s2"]["kind"], items["s2"]["tier"], items["s2"]["other_slug"]) == ("duplicate", 1, "note:1") and items["s3"]["tier"] == 2


def test_graph(spark):
    pairs = spark.createDataFrame([(1, 2, 0.85), (1, 3, 0.5), (2, 3, 0.95), (4, 4, 0.8)], "a long, b long, similarity double")
    assert rows(graph.similarity_edges(pairs).select("source", "target")) == [(1, 2), (2, 1)]
    edges = spark.createDataFrame([(2, 3, "prerequisite", "m", 0.8), (1, 2, "prerequisite", "m", 0.9), (3, 1, "prerequisite", "m", 0.1)], "source long, target long, edge_type string, edge_source string, weight double")
    chain = lambda n: rows(graph.prerequisite_chain(edges, 3, n).select("source", "target", "step"))
    assert chain(1) == [(2, 3, 1)] and chain(9) == [(1, 2, 2), (2, 3, 1), (3, 1, 3)]
    assert [r["node"] for r in graph.related(edges, 3).collect()] == [2, 1] and rows(graph.neighbourhood(edges, 3, 1, 1)) == [(2, 1), (3, 0)]
    assert rows(graph.prerequisites(edges, 2).select("source")) == [(1,)] and rows(graph.dependents(edges, 2).select("target")) == [(3,)]


def test_work_items(spark):
    base = dt.datetime(2024, 1, 1)
    items = spark.createDataFrame([("r", 3, 48), ("a1", 1, 1), ("a24", 1, 24), ("q", 2, 12)], "id string, tier int, h int")
    items = items.withColumns({"status": F.lit("open"), "first_seen": (F.lit(base).cast("timestamp").cast("long") - F.col("h") * 3600).cast("timestamp")})
    assert [r["id"] for r in worklist.queue(items).collect()] == ["a24", "a1", "q", "r"]
    bare = spark.range(11).select(F.format_string("%02d", "id").alias("id"), F.lit("uncovered_topic").alias("kind"), F.lit(None).cast("string").alias("slug"))
    assert [r["cluster_id"] for r in worklist.batched(bare).orderBy("id").collect()] == ["uncovered_topic:0"] * 10 + ["uncovered_topic:1"]
    assert worklist.scores(items.limit(0)).first()["overall"] == 1
    full = items.withColumns({"resolved_at": F.lit(None).cast("timestamp"), "attestation": F.lit(None).cast("string"), "loop_kind": F.lit("audit")})
    changes = spark.createDataFrame([("q", "fixed", "done"), ("r", "nonsense", "x")], "id string, to string, attestation string")
    after = {r["id"]: r for r in worklist.moved(full, changes, now()).collect()}
    assert (after["q"]["status"], after["q"]["attestation"], after["q"]["resolved_at"] is None) == ("fixed", "done", False) and after["r"]["status"] == "open"
    seen = full.where("id in ('q', 'a1')").withColumn("tier", F.lit(9)).unionByName(full.where("id = 'r'").withColumn("id", F.lit("new")))
    rec = {r["id"]: r for r in worklist.reconciled(full, seen, ["audit"], now()).collect()}
    assert {k: v["status"] for k, v in rec.items()} == {"r": "fixed", "a24": "fixed", "q": "open", "a1": "open", "new": "open"} and rec["q"]["tier"] == 9
    assert worklist.by_prefix(items, "a").count() == 0 and worklist.by_prefix(items, "a2").count() == 1


def test_scanners(spark):
    cards = spark.createDataFrame([("good", "What is ownership of memory?", "It is a set of rules for memory.", ["topic::x"]), ("bad", "explain", "", ["skill::dead"])], "slug string, front string, back string, tags array<string>")
    found = rows(worklist.audit(cards).select("slug", "kind", "tier", "dimension"))
    assert {x[0] for x in found} == {"bad"} and ("bad", "dead_skill", 4, None) in found and ("bad", "low_quality", 2, "testability") in found
    deck = spark.createDataFrame([(1, 10, 3, 1300, 6, 3), (2, 20, 0, 1400, 1, 12), (3, 30, 300, 2500, 0, 9)], "card_id long, note_id long, ivl int, ease int, lapses int, reps int").withColumn("deck", F.lit("d"))
    stats = spark.createDataFrame([(3, 6, 0.1, dt.datetime(2000, 1, 1))], "card_id long, reviews long, fail_rate double, last_review_at timestamp")
    slugs = spark.createDataFrame([(10, "s1"), (20, "s2"), (30, "s3")], "note_id long, slug string")
    assert rows(worklist.retention(deck, stats, slugs, now()).select("slug", "tier")) == [("s1", 3), ("s2", 4), ("s3", 2)]
    assert worklist.uncovered(spark.createDataFrame([("a.md",), ("b.md",)], ["path"]), spark.createDataFrame([("a.md",)], ["source_path"])).count() == 1


def test_store_and_sync(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    note = lambda *r: spark.createDataFrame(list(r), "note_id long, text string")
    sync.sync(store, {"notes": note((1, "a"), (2, "b")), "cards": spark.createDataFrame([(7, 1)], "card_id long, note_id long"), "card_stats": spark.createDataFrame([(7, 3), (8, 1)], "card_id long, reviews long")}, now())
    assert rows(store.read("notes")) == [(1, "a", None), (2, "b", None)] and rows(store.read("card_stats")) == [(7, 3)]
    sync.sync(store, {"notes": note((1, "a2"), (3, "c"))}, now())
    assert [(a, b, c is None) for a, b, c in rows(store.read("notes"))] == [(1, "a2", True), (2, "b", False), (3, "c", True)]
    sync.sync(store, {"notes": note((2, "b"), (3, "c"))}, now())
    assert [(a, c is None) for a, _, c in rows(store.read("notes"))] == [(1, False), (2, True), (3, True)]
    old = spark.createDataFrame([(1, "x", 5)], "k int, v string, made int")
    new = spark.createDataFrame([(1, "y", 9), (2, "z", 9)], "k int, v string, made int")
    assert rows(upserted(old, new, ["k"], ("made",))) == [(1, "y", 5), (2, "z", 9)] and rows(inserted(old, new, ["k"])) == [(1, "x", 5), (2, "z", 9)]
    gone = soft_deleted(old.withColumn("deleted_at", F.lit(None).cast("timestamp")), new.limit(0), ["k"], now())
    assert gone.first()["deleted_at"] is not None


def test_a_store_keeps_all_tables_of_one_write(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    one = lambda x: spark.createDataFrame([(x,)], "x int")
    store.write({"a": one(1), "b": one(1)})

    class Broken:
        write = property(lambda self: 1 / 0)

    with pytest.raises(ZeroDivisionError):
        store.write({"a": one(2), "b": Broken()})
    assert rows(store.read("a")) == rows(store.read("b")) == [(1,)]
    before = store.manifest()
    store.write({"b": one(3)})
    assert (rows(store.read("a")), rows(store.read("b"))) == ([(1,)], [(3,)])
    monkeypatch.setattr(store, "manifest", lambda: dict(before))
    with pytest.raises(RuntimeError, match="another write"):
        store.write({"a": one(4)})
    monkeypatch.undo()
    assert rows(store.read("a")) == [(1,)] and store.version("c") is None


def test_registry_metadata_and_files(spark, tmp_path):
    kv = cardbook.metadata_put(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), {"b": {"y": 1, "x": None}, "c": "t"})
    assert rows(kv) == [("a", "1"), ("b", '{"x": null, "y": 1}'), ("c", '"t"')]
    log, event = str(tmp_path / "log"), lambda n: spark.createDataFrame([(n,)], "n int")
    for n in (1, 2):
        cardbook.append_progress(event(n), log)
    assert rows(cardbook.progress(spark, log, "n int")) == [(1,), (2,)]
    (tmp_path / "m" / "sub").mkdir(parents=True)
    (tmp_path / "m" / "sub" / "a.png").write_bytes(b"abc")
    refs = spark.createDataFrame([("sub/a.png",), ("sub/a.png",), ("gone.png",)], "path string")
    assert rows(source.media_digests(spark, str(tmp_path / "m"), refs)) == [("sub/a.png", 3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")]
    source.write_tag_file(spark.createDataFrame([("b",), (" a ",), ("b",), ("",)], "tag string"), str(tmp_path / "tags"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "tags")).collect()] == ["a", "b"]


def test_incremental_index(spark):
    current = sync.chunks(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "note_id long, text string"), "m")
    index = sync.chunks(spark.createDataFrame([(1, "a"), (2, "old"), (9, "gone")], "note_id long, text string"), "m").withColumn("vector", F.array(F.lit(0.0))).drop("text")
    assert rows(sync.changed(current, index).select("note_id")) == [(2,), (3,)]
    after = sync.indexed(current, index, lambda text: F.array(F.char_length(text).cast("double")))
    assert rows(after.select("note_id", "vector")) == [(1, [0.0]), (2, [1.0]), (3, [1.0])]
    assert sync.index_summary(current, index).first() == (3, 2, 1)
    want = {"dimension": 3, "model": "m", "schema": 1}
    assert sync.needs_reindex(None, want) == "missing" and sync.needs_reindex(want | {"model": "n"}, want) == "model mismatch" and sync.needs_reindex(want, want) is None


def test_reports(spark):
    hist = spark.createDataFrame([("g", 1, 95, 0), ("g", 50, 4, 1), ("g", 900, 1, 1)], "g string, ms long, n long, errors long")
    assert reports.latency(hist, "g").first() == ("g", 100, 0.02, 1)
    cards = spark.createDataFrame([(1, 10, 2500, "d"), (2, 0, 1300, "e")], "card_id long, ivl int, ease int, deck string")
    daily = {r["day"]: r["reviews"] for r in reports.workload(cards, 30).collect()}
    assert len(daily) == 30 and daily[10] >= 1 and reports.workload(cards, 30, "d").agg(F.sum("reviews")).first()[0] == 1
    vault = spark.createDataFrame([("v/a.md", "---\nx: 1\n---\n[[b]] [[nope]]"), ("v/b.md", "text"), ("v/c.md", "alone")], "path string, content string")
    assert reports.vault_stats(vault).first() == (3, 1, 2, 1, 1)


@pytest.mark.parametrize("modern", [False, True])
def test_collection_files(spark, tmp_path, modern):
    path = str(tmp_path / "collection.db")
    with sqlite3.connect(path) as db:
        db.execute("create table notes (id, mid, mod, tags, flds)")
        db.execute("create table cards (id, nid, did, ord, due, ivl, factor, lapses, reps, queue, type, mod, usn)")
        db.execute("create table revlog (id, cid, usn, ease, ivl, lastIvl, factor, time, type)")
        db.execute("insert into notes values (100, 9, 1, ' vocab japanese ', ?)", ("Hello\x1fWorld\x1fmore",))
        db.execute("insert into cards values (500, 100, 2, 0, 0, 30, 2500, 2, 10, 2, 2, 1, 0)")
        db.executemany("insert into revlog values (?, 500, -1, ?, 30, 15, ?, ?, 1)", [(1700000000000, 3, 2500, 8000), (1700000001000, 1, 2100, 15000), (1700000002000, 3, 2200, 6000)])
        if modern:
            db.execute("create table notetypes (id, name)")
            db.execute("create table fields (ntid, ord, name)")
            db.execute("create table templates (ntid, ord, name)")
            db.executemany("insert into templates values (9, ?, ?)", [(1, "Card 2"), (0, "Card 1")])
            db.execute("create table decks (id, name)")
            db.execute("insert into notetypes values (9, 'Basic')")
            db.executemany("insert into fields values (9, ?, ?)", [(1, "Back"), (0, "Front")])
            db.executemany("insert into decks values (?, ?)", [(1, "Default"), (2, "Japanese\x1fVocab")])
        else:
            db.execute("create table col (decks, models)")
            decks = {"1": {"id": 1, "name": "Default"}, "2": {"id": 2, "name": "Japanese::Vocab"}}
            db.execute("insert into col values (?, ?)", (json.dumps(decks), json.dumps({"9": {"name": "Basic", "flds": [{"name": "Front", "ord": 0}, {"name": "Back", "ord": 1}], "tmpls": [{"name": "Card 2", "ord": 1}, {"name": "Card 1", "ord": 0}]}})))
    c = source.Collection(spark, path)
    assert c.modern == modern and rows(c.decks()) == [(1, "Default", None), (2, "Japanese::Vocab", "Japanese")]
    note = c.notes().first()
    assert note["tags"] == ["vocab", "japanese"] and [tuple(f) for f in note["fields"]] == [("Front", "Hello"), ("Back", "World"), ("Field2", "more")]
    stats = sync.card_stats(c.reviews()).first()
    assert (stats["reviews"], round(stats["avg_ease"], 3), stats["total_time_ms"]) == (3, 2266.667, 29000) and stats["fail_rate"] == pytest.approx(1 / 3)
    assert stats["last_review_at"] == dt.datetime(2023, 11, 14, 22, 13, 22) and c.cards().count() == 1
    model = c.models().first()
    assert [tuple(x) for x in model["fields"]] == [("Front", 0), ("Back", 1)] and [tuple(x) for x in model["templates"]] == [("Card 1", 0), ("Card 2", 1)]
    assert rows(c.reviews())[0] == (1700000000000, 500, -1, 3, 30, 15, 2500, 8000, 1)
    assert {name: t.count() for name, t in c.tables().items()} == {"decks": 2, "models": 1, "notes": 1, "cards": 1, "reviews": 3, "card_stats": 1}
    c.close()


def test_vault_and_files(spark, tmp_path):
    (tmp_path / "v" / "sub").mkdir(parents=True)
    (tmp_path / "v" / ".trash").mkdir()
    (tmp_path / "v" / "sub" / "a.md").write_text("# A é")
    (tmp_path / "v" / "b.txt").write_text("no")
    (tmp_path / "v" / ".trash" / "c.md").write_text("no")
    got = source.vault(spark, str(tmp_path / "v"), ignore=(".trash",)).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["content"]) for r in got] == [("a.md", "# A é")]
    (tmp_path / "card.txt").write_text("front\n---\nback\n---\nt1\n\n t2 ")
    assert tuple(source.card_files(spark, str(tmp_path / "card.txt")).first())[1:] == ("front", "back", ["t1", "t2"])
    (tmp_path / "log.json").write_text('{"n": 1}\nbroken\n{"n": 2}\n{"n": 3}\n')
    assert [r["n"] for r in source.log_tail(spark, str(tmp_path / "log.json"), "n int", 2, "n").collect()] == [3, 2]
    assert source.taxonomy_rows([{"path": "rust", "children": [{"path": "rust/x", "label": "X"}]}]) == [("rust", "rust"), ("rust/x", "X")]


def test_review_streams(spark, tmp_path):
    log = str(tmp_path / "log")
    batch = lambda *r: spark.createDataFrame(list(r), "review_ms long, card_id long, ease int, factor int, time_ms long").write.mode("append").parquet(log)
    batch((1000, 1, 3, 2500, 5), (2000, 1, 1, 2300, 7))
    stats = streams.running_stats(streams.review_stream(spark, log)).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).start()
    stats.processAllAvailable()
    batch((3000, 2, 3, 2500, 1))
    stats.processAllAvailable()
    stats.stop()
    assert rows(spark.table("running").select("card_id", "reviews", "total_time_ms")) == [(1, 2, 12), (2, 1, 1)]
    windows = streams.windowed_stats(streams.review_stream(spark, log), "1 second", "0 seconds").writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "d")).start()
    windows.processAllAvailable()
    batch((60_000, 9, 3, 2500, 1))
    windows.processAllAvailable()
    windows.stop()
    assert [r["reviews"] for r in spark.table("windows").orderBy("start").collect()] == [1, 1, 1]
    seen = []
    streams.each_snapshot(lambda df: seen.append(df.count()))(spark.range(3), 0)
    streams.each_snapshot(lambda df: seen.append(df.count()))(spark.range(0), 1)
    assert seen == [3]


def test_documents(spark):
    long = "word " * 20
    files = spark.createDataFrame([("n/a.md", f"# Intro\n{long}\n## Code example\n```py\nx = 1\n```\n## Tiny\nx"), ("n/b.md", long), ("n/c.md", "short")], "path string, content string")
    got = {(r["path"], r["kind"]) for r in documents.chunks(files).collect()}
    assert got == {("n/a.md", "code_example"), ("n/a.md", "section"), ("n/b.md", "full_content")}
    hits = spark.createDataFrame([("a", 0.9, "1", "x" * 900), ("a", 0.8, "2", "y"), ("b", 0.7, "3", "z")], "path string, score double, chunk_id string, content string")
    assert [(r["path"], len(r["content"])) for r in documents.context(hits, 2).collect()] == [("a", 500), ("b", 1)]
    cards = documents.previews(spark.createDataFrame([("v/My note.md", "---\nt: 1\n---\nintro\n# A\none < two\n\nthree\n# B\n")], "path string, content string")).collect()
    assert [(r["slug"], r["title"], r["html"]) for r in cards] == [("my-note-1", "My note", "<p>intro</p>"), ("my-note-2", "A", "<p>one &lt; two</p><p>three</p>")]
    text = '<img src="a.PNG"><img src=http://x/b.png><a href="d/e.pdf?x=1">p</a>[sound:c.mp3][sound:../no.mp3]<video src="a.PNG"><img src=f.xyz>'
    refs = spark.range(1).select(documents.media_refs(F.lit(text)).alias("r")).first()["r"]
    assert [(r["path"], r["modality"], r["label"]) for r in refs] == [("a.PNG", "image", "a.PNG"), ("d/e.pdf", "document", "e.pdf"), ("c.mp3", "audio", "c.mp3")]
    assert rows(spark.createDataFrame([(0.96,), (0.9,), (0.7,), (0.1,)], "s double").select(documents.duplicate_advice(F.col("s")))) == [("create",), ("merge",), ("review",), ("skip",)]


def test_model_adapters(spark):
    texts = spark.createDataFrame([("ab",), (None,), ("abc",)], "text string")
    assert rows(texts.select(documents.embedder(lambda xs: [[float(len(x))] for x in xs])(F.col("text")))) == [(None,), ([2.0],), ([3.0],)]
    assert rows(texts.select(documents.reranker(lambda q, xs: [float(len(q) * len(x)) for x in xs], "qq")(F.col("text")))) == [(4.0,), (6.0,), (None,)]
    cards = spark.createDataFrame([(f"s{i}",) for i in range(25)], "slug string")
    scored = documents.reviewed(cards, lambda part: [{"slug": c["slug"], "dimension": "clarity", "score": 0.1 * len(part)} for c in part if len(part) <= 10], "slug string, dimension string, score double")
    assert scored.count() == 25 and {r["tier"] for r in documents.review_items(scored).collect()} <= {2, 3}
