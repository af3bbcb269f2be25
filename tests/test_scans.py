"""Scan runs over a stored queue, scanners by name, failing ones, and the gate of claimed fixes."""

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import scans
from recallgrid.tables import Store


def now():
    return F.lit("2024-05-01").cast("timestamp")


@pytest.fixture
def tables(spark):
    registry = spark.createDataFrame(
        [("a-1", "Why would you use it?", "For reasons that are long enough.", ["skill::alive"], "a.md", 1, None), ("b-1", "x", "", [], "b.md", 2, "old"), ("b-2", "What is the syntax of it?", "Some answer text here", ["skill::dead"], "b.md", 3, None)],
        "slug string, front string, back string, tags array<string>, source_path string, note_id long, content_hash string",
    )
    files = spark.createDataFrame([("a.md", "text"), ("b.md", "new text"), ("c.md", "no card")], "path string, content string")
    cards = spark.createDataFrame([(10, 1, 3, 1500, 12, 20), (11, 3, 30, 2500, 0, 5)], "card_id long, note_id long, ivl int, ease int, lapses int, reps int")
    stats = spark.createDataFrame([(10, 20, 0.6), (11, 5, 0.0)], "card_id long, reviews long, fail_rate double").withColumn("last_review_at", F.lit("2024-01-01").cast("timestamp"))
    copies = spark.createDataFrame([(1, 2, 3, 0.95)], "representative long, size long, note_id long, similarity double")
    return {"registry": registry, "files": files, "vault": files.select("path"), "cards": cards, "card_stats": stats, "duplicates": copies}


def test_all_scanners_run_by_name_and_a_second_run_reconciles(spark, tmp_path, tables):
    store = Store(spark, str(tmp_path / "s"))
    assert {s.name for s in scans.chosen(tables)} == set(scans.SCANNERS) == {"audit", "retention", "stale", "uncovered", "duplicates"}
    one = scans.run(store, tables, now(), names=list(scans.SCANNERS))
    items = store.read("work_items")
    kinds = {r["kind"] for r in items.collect()}
    assert one["scan_number"] == 1 and one["failed"] == {} and one["found"] == items.count() == one["open"]
    assert {"validation_error", "low_quality", "dead_skill", "missing_tags", "stale_content", "uncovered_topic", "duplicate"} <= kinds
    assert items.where("cluster_id is null or scan_number <> 1 or first_seen is null").count() == 0

    better = dict(tables, registry=tables["registry"].where("slug = 'a-1'"), vault=tables["vault"].where("path = 'a.md'"), files=tables["files"].where("path = 'a.md'"))
    two = scans.run(store, better, now())
    assert two["scan_number"] == 2 and two["resolved"] == one["found"] - two["found"] > 0
    assert [(r["scan_number"], r["found"], r["resolved"]) for r in store.read("progress").orderBy("scan_number").collect()] == [(1, one["found"], 0), (2, two["found"], two["resolved"])]
    assert store.read("work_items").where("status = 'fixed'").count() == two["resolved"]


def test_only_the_loops_of_a_run_are_reconciled(spark, tmp_path, tables):
    store = Store(spark, str(tmp_path / "s"))
    scans.run(store, tables, now())
    scans.run(store, {"vault": tables["vault"].limit(0), "registry": tables["registry"]}, now(), "generation")
    rows = store.read("work_items")
    assert rows.where("loop_kind = 'generation' and status = 'open'").count() == 0 and rows.where("loop_kind = 'audit' and status <> 'open'").count() == 0
    with pytest.raises(ValueError):
        scans.run(store, tables, now(), "other")


def test_a_failing_scanner_is_named_and_resolves_nothing(spark, tmp_path, tables):
    store = Store(spark, str(tmp_path / "s"))
    scans.run(store, tables, now())
    broken = dict(tables, card_stats=tables["card_stats"].drop("fail_rate"), registry=tables["registry"])
    got = scans.run(store, broken, now(), names=["audit", "retention"])
    assert list(got["failed"]) == ["retention"] and got["resolved"] == 0
    with pytest.raises(Exception, match="front|slug|UNRESOLVED"):
        scans.run(store, dict(tables, registry=tables["registry"].drop("front")), now(), names=["audit"])
    assert store.read("progress").count() == 2  # the run that failed left nothing


def test_own_scanners_take_part(spark, tmp_path, tables):
    @scans.scanner("long", "audit", "registry")
    def long(found, _):
        rows = found["registry"].where(F.char_length("back") > 20)
        return scans.worklist._of_card(rows, F.lit("long"), "split_candidate", 3, 0.5)

    try:
        store = Store(spark, str(tmp_path / "s"))
        scans.run(store, tables, now(), names=["long"])
        assert {r["slug"] for r in store.read("work_items").collect()} == {"a-1", "b-2"}
        with pytest.raises(ValueError):
            scans.scanner("x", "nowhere")
    finally:
        del scans.SCANNERS["long"]


def test_claims_are_verified(spark):
    items = spark.createDataFrame([(x, "open", None, None) for x in "abc"], "id string, status string, resolved_at timestamp, attestation string")
    claims = spark.createDataFrame([("a", "fixed", "me"), ("b", "fixed", "me"), ("c", "skipped", "me")], "id string, to string, attestation string")
    again = spark.createDataFrame([("b",), ("c",)], "id string")
    got = {r["id"]: (r["status"], r["resolved_at"] is not None, r["attestation"]) for r in scans.verified(items, claims, again, now()).collect()}
    assert got == {"a": ("fixed", True, "me"), "b": ("open", False, None), "c": ("skipped", True, "me")}
