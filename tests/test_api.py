import pytest
from pyspark.sql import functions as F

from recallgrid import api
from recallgrid.functions import hashes
from recallgrid.operators.filters import Filters, SearchRequest
from recallgrid.sources import ingest


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return {
        "topics": make([(1, "rust", "rust"), (2, "rust/ownership", "ownership"), (3, "rust/borrowing", "borrowing")], "topic_id int, path string, label string"),
        "note_topics": make([(701, 2, 0.94, "m")], "note_id long, topic_id int, confidence double, method string"),
        "notes": make([(701, "ownership moves", ["rust"], False, 1), (702, "ownership moves", ["go"], False, 1)], "note_id long, text string, tags array<string>, deleted boolean, model_id long"),
        "cards": make([(1701, 701, "Rust", 25, 6, 20, 2500), (1702, 702, "Go", 1, 0, 1, 2500)], "card_id long, note_id long, deck string, ivl int, lapses int, reps int, ease int"),
        "card_stats": make([(1701, 20, 0.35)], "card_id long, reviews long, fail_rate double"),
    }


def test_analytics(spark, tables):
    a = api.Analytics(tables)
    assert [x["path"] for x in a.tree("rust")[0]["children"]] == ["rust/borrowing", "rust/ownership"]
    c = a.coverage("rust")
    assert (c["note_count"], c["mature_count"], c["child_count"], c["covered_children"], c["weak_notes"], c["avg_lapses"]) == (1, 1, 2, 1, 0, 6.0)
    assert a.coverage("rust/ownership")["weak_notes"] == 1 and a.coverage("rust", False)["note_count"] == 0 and a.coverage("no") is None
    assert [(r["path"], r["gap_type"]) for r in a.gaps("rust").collect()] == [("rust", "missing"), ("rust/borrowing", "missing")]
    assert [(r["note_id"], r["total_lapses"]) for r in a.weak_notes("rust").collect()] == [(701, 6)]
    for call in (a.gaps, a.weak_notes):
        with pytest.raises(KeyError):
            call("no")
    pairs = spark.createDataFrame([(701, 702, 0.99)], "a long, b long, similarity double")
    shown, stats = a.duplicates(pairs)
    assert shown.first()["representative"] == 701 and stats.first()["notes_scanned"] == 2
    assert a.duplicates(pairs, decks=("Rust",))[0].count() == 0
    with pytest.raises(ValueError):
        a.duplicates(pairs, 2.0)


def test_search(spark, tables):
    chunks = spark.createDataFrame([(701, "701:a", [1.0, 0.0], ["Rust"], ["rust"], 1, True, 6, 20), (702, "702:a", [0.0, 1.0], ["Go"], ["go"], 1, False, 0, 1)], "note_id long, chunk_id string, vector array<double>, deck_names array<string>, tags array<string>, model_id long, mature boolean, lapses int, reps int")
    s = api.Search(tables["notes"], tables["cards"], chunks, lambda q: [1.0, 0.1], lambda q: lambda text: F.char_length(text).cast("double"))
    found, stats = s.search(SearchRequest("ownership"))
    assert [r["note_id"] for r in found.collect()] == [701, 702] and stats.first()["both"] == 2
    only = s.search(SearchRequest("ownership", filters=Filters(decks=("Go",)), rerank_top=5))[0].collect()
    assert [(r["note_id"], r["rerank_score"]) for r in only] == [(702, 15.0)]
    assert s.chunk_hits(" ").count() == 0 and s.chunk_hits("x", 1).first()["chunk_id"] == "701:a"


def test_ingest(spark):
    t = ingest.text_files(spark.createDataFrame([("d/a.md", "# Head\nx ![[i.png]]"), ("d/b.txt", "plain")], "path string, content string")).collect()
    assert [(r["title"], r["n_sections"], r["n_images"]) for r in t] == [("Head", 1, 1), ("b", 0, 0)]
    page = "<html><head><title>A &amp; B</title></head><body><script>no()</script><h1>T</h1><p>one</p><img src='/i.png'></body></html>"
    web = ingest.web_pages(spark.createDataFrame([("http://h/p", page)], "url string, html string"))
    r = web.first()
    assert (r["title"], r["n_sections"], r["n_images"]) == ("A & B", 1, 1) and "no()" not in r["content"] and "http://h/i.png" in r["content"]
    note = ingest.vault_notes(web, "v").first()
    assert note["path"] == "v/a-b.md" and note["content"].startswith('---\ntitle: "A & B"\nsource: "http://h/p"\n---\n# T')
    assert spark.range(1).select(hashes.point_id(F.lit("701:a"))).first()[0] > 0
