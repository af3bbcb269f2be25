"""A stored collection of chunks: dimensions, upserts, deletion, search and index runs."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import embedding_inputs as ei
from recallgrid.operators import chunk_store, sync
from recallgrid.operators.chunk_store import ChunkStore, DimensionMismatch
from recallgrid.tables import Store

ROWS = "chunk_id string, source string, content string, vector array<double>, metadata map<string,string>"


@pytest.fixture
def kept(spark, tmp_path):
    return ChunkStore(Store(spark, str(tmp_path / "store")))


def test_dimension_is_kept(spark, kept):
    assert kept.dimension() is None and kept.count() == 0
    with pytest.raises(ValueError):
        kept.add(spark.createDataFrame([], ROWS))
    assert kept.ensure(2, "m") and not kept.ensure(2) and kept.settings() == {"dimension": 2, "model": "m", "schema": chunk_store.SCHEMA}
    with pytest.raises(DimensionMismatch):
        kept.ensure(3)
    for bad in ([1.0], None, [1.0, None]):
        with pytest.raises(DimensionMismatch):
            kept.add(spark.createDataFrame([("a", "f", "x", bad, None), ("b", "f", "x", [1.0, 2.0], None)], ROWS))
    with pytest.raises(ValueError, match="without an id"):
        kept.add(spark.createDataFrame([(None, "f", "x", [1.0, 2.0], None)], ROWS))
    assert kept.count() == 0  # nothing of a refused call is written
    kept.recreate(3)
    assert kept.dimension() == 3


def test_rows_change_by_id(spark, kept):
    kept.ensure(2)
    rows = [("a", "f", "1", [1.0, 0.0], {"topic": "x"}), ("b", "f", "1", [0.0, 1.0], None), ("b", "f", "0", [0.0, 1.0], {"topic": "y"}), ("c", None, None, [1.0, 1.0], {})]
    assert kept.add(spark.createDataFrame(rows, ROWS)) == 3
    assert kept.add(spark.createDataFrame([("a", "g", "2", [1.0, 0.0], None), ("d", "g", "2", [0.0, 0.0], None)], ROWS).withColumn("extra", F.lit(1))) == 1
    assert {r["chunk_id"]: (r["source"], r["content"]) for r in kept.rows().collect()} == {"a": ("g", "2"), "b": ("f", "0"), "c": (None, None), "d": ("g", "2")}
    assert tuple(kept.stats().first()) == (4, 2, ["y"])
    assert kept.delete_by_source(spark.createDataFrame([("g",), ("g",), (None,), ("none",)], "source string")) == 2 and kept.count() == 2
    assert kept.add(spark.createDataFrame([], ROWS)) == 0
    kept.reset()
    assert kept.count() == 0 and kept.dimension() == 2 and tuple(kept.stats().first()) == (0, 0, [])


def test_search_equals_plain_cosine(spark, kept):
    kept.ensure(2)
    vectors = {f"c{i:02}": [math.cos(i / 7), math.sin(i / 7)] for i in range(30)} | {"tie1": [0.5, 0.0], "tie0": [2.0, 0.0]}
    kept.add(spark.createDataFrame([(c, "f", c, v, {"k": str(i % 2)}) for i, (c, v) in enumerate(vectors.items())], ROWS))
    asked = {"q": [1.0, 0.1], "r": [-1.0, 0.5], "z": [1.0, 0.0]}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, vector array<double>")
    stored = {c: [float(x) for x in r] for c, r in ((r["chunk_id"], r["vector"]) for r in kept.rows().collect())}

    def by_hand(keep, least):
        out = set()
        for q, v in asked.items():
            scored = []
            for c in filter(keep, stored):
                size = math.hypot(*v) * math.hypot(*stored[c])
                scored.append((round(-sum(a * b for a, b in zip(v, stored[c], strict=True)) / size, 12), c))
            out |= {(q, c) for s, c in sorted(scored)[:4] if 1 / (2 + s) >= least}
        return out

    got = lambda *a: {(r["query_id"], r["chunk_id"]) for r in kept.search(queries, 4, *a).collect()}
    place = {c: i for i, c in enumerate(vectors)}
    assert got() == by_hand(lambda c: True, 0) and got("k", "1") == by_hand(lambda c: place[c] % 2, 0)
    assert got(None, None, 0.9) == by_hand(lambda c: True, 0.9) and got("k", "none") == set()


def test_index_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    embed = lambda n: lambda text: F.array_repeat(F.char_length(text).cast("float"), n)
    notes = lambda *rows: spark.createDataFrame(rows, "note_id long, text string, deleted boolean")
    run = lambda rows, model="m", n=2, of=2, force=False: chunk_store.index_notes(store, rows, model, n, embed(of), force)
    first = notes((1, "a", False), (2, None, None), (3, "c", True))
    assert run(first) == {"reason": "missing", "forced": True, "chunks": 2, "embedded": 2, "skipped": 0, "removed_notes": 0}
    assert run(first)["embedded"] == 0 and run(first, force=True)["embedded"] == 2
    assert run(notes((1, "aa", False), (4, "d", False))) == {"reason": None, "forced": False, "chunks": 2, "embedded": 2, "skipped": 0, "removed_notes": 1}
    rows = lambda: {r["note_id"]: list(r["vector"]) for r in store.read("index").collect()}
    assert rows() == {1: [2.0, 2.0], 4: [1.0, 1.0]}
    with pytest.raises(DimensionMismatch):
        run(first, n=3)
    assert rows() == {1: [2.0, 2.0], 4: [1.0, 1.0]} and store.read("index_settings").first()["dimension"] == 2  # a failed run changes nothing
    assert run(first, n=3, of=3)["reason"] == "dimension mismatch" and run(first, "other", 3, 3)["reason"] == "model mismatch"
    assert run(notes(), "other", 3, 3)["removed_notes"] == 2 and rows() == {}


def test_input_digests(spark):
    data = b"\x00\xff\x80"
    parts = [ei.text_part(F.lit("tä")), ei.inline_part(F.lit("image/png"), F.lit(data), F.lit("n")), ei.inline_part(F.lit("a"), F.lit(data)), ei.file_part(F.lit("m"), F.lit("u"), F.lit("d"))]
    given = ei.embedding_input(F.array(*parts), "RetrievalQuery", F.lit("title"), 7)
    want = hashlib.sha256(b"RetrievalQuerytitle7" + b"\xfftext" + "tä".encode() + b"\xffinline_bytesimage/pngn" + data + b"\xffinline_bytesa" + data + b"\xfffile_urimud")
    one = ei.embedding_input(F.array(ei.text_part(F.lit("x"))))
    row = spark.range(1).select(ei.input_digest(given), ei.single_text(given), ei.single_text(one), ei.mock_vector(one, 40)).first()
    assert row[0] == want.hexdigest() and row[1] is None and row[2] == "x"
    bytes_ = hashlib.sha256(b"Default\xfftextx").digest()
    assert [round(v, 5) for v in row[3]] == [round(bytes_[i % 32] / 127.5 - 1, 5) for i in range(40)]
    with pytest.raises(ValueError):
        ei.embedding_input(F.array(), "other")


def test_metadata_is_part_of_the_write(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    decks = spark.createDataFrame([(1, "d")], "deck_id long, name string")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for day in ("2024-01-01", "2024-01-02"):
        sync.sync(store, {"decks": decks}, F.lit(day).cast("timestamp"), source=f"/{day}.db")
    assert dict(map(tuple, store.read("metadata").collect())) == {"last_sync_at": "2024-01-02T00:00:00.000Z", "last_collection_path": "/2024-01-02.db"}
    assert int(store.manifest()[""]) == 2
