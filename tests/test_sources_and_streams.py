"""Collection tables read by executors with pushed tests, batches applied once, and changes on a stream."""

import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import sync
from recallgrid.plans import registry
from recallgrid.sources import catalog
from recallgrid.sources.sqlite_source import SqliteReader, sqlite_table
from recallgrid.streaming import changes, reviews
from recallgrid.tables import Store


@pytest.fixture
def file(tmp_path):
    path = str(tmp_path / "some.db")
    with sqlite3.connect(path) as db:
        db.execute("create table t (id integer primary key, nid, name)")
        db.executemany("insert into t values (?, ?, ?)", [(i * 7 - 50, i % 5, None if i % 10 == 0 else f"n{i % 3}") for i in range(1000)])
    return path


def test_rows_come_from_ranges_on_executors(spark, file):
    t = sqlite_table(spark, file, "t", "id long, nid int, name string", 100)
    assert t.rdd.getNumPartitions() == 10
    assert t.count() == 1000 and t.select("id").distinct().count() == 1000
    assert t.agg(F.min("id"), F.max("id"), F.count("name")).first() == (-50, 6943, 900)


def test_equality_is_pushed_and_the_rest_is_not(spark, file):
    t = sqlite_table(spark, file, "t", "id long, nid int, name string", 100)
    assert t.where("nid = 3").count() == 200 and t.where("id = -50 and nid = 0").count() == 1 and t.where("nid in (1, 2) and name = 'n1'").count() == sum(1 for i in range(1000) if i % 5 in (1, 2) and i % 3 == 1 and i % 10)
    assert t.where("nid > 3").count() == 200 and t.where("name is null").count() == 100 and t.where("nid = 77").count() == 0
    plan = t.where("nid = 3 and id > 10")._jdf.queryExecution().executedPlan().toString()
    assert "= 3)" not in plan and "> 10)" in plan  # what the source tests, Spark doesn't
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import StructType

    reader = SqliteReader(StructType.fromDDL("id long, nid int"), file, "t", 100)
    left = list(reader.pushFilters([EqualTo(("nid",), 3), GreaterThan(("id",), 5), EqualTo(("nid",), None)]))
    assert len(left) == 2 and reader.where() == (" and nid in (?)", [3])
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 200


def test_names_are_checked(file):
    from pyspark.sql.types import StructType

    with pytest.raises(ValueError):
        SqliteReader(StructType.fromDDL("id long"), file, "t; drop table t", 1)


def test_a_batch_that_comes_again_is_passed_over(spark, tmp_path):
    """The stream fails after the store's write and before its own commit; on restart the batch isn't applied twice."""
    store, log = Store(spark, str(tmp_path / "store")), str(tmp_path / "log")
    fail = [True]

    def apply(batch, number):
        rows = batch.groupBy("note_id").agg(F.count("*").alias("n"))
        before = store.read("counts", "note_id long, n long")
        total = before.unionByName(rows).groupBy("note_id").agg(F.sum("n").alias("n"))
        store.write({"counts": total}, number)
        if number[1] == 1 and fail[0]:
            raise RuntimeError("between write and commit")

    def run():
        stream = spark.readStream.schema("note_id long").option("maxFilesPerTrigger", 1).parquet(log)
        q = stream.writeStream.foreachBatch(reviews.each_batch_once(store, "notes", apply)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    for k in range(3):
        spark.range(k, k + 5).withColumnRenamed("id", "note_id").coalesce(1).write.mode("append").parquet(log)
    with pytest.raises(Exception, match="between write and commit"):
        run()
    assert store.applied("notes") == 1 and store.read("counts", "").agg(F.sum("n")).first()[0] == 10
    fail[0] = False
    run()
    assert store.applied("notes") == 2 and store.applied("other") == -1
    assert sorted(map(tuple, store.read("counts", "").collect())) == [(0, 1), (1, 2), (2, 3), (3, 3), (4, 3), (5, 2), (6, 1)]


def test_snapshots_of_a_stream_write_their_number(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    notes = spark.createDataFrame([(1, "a")], "note_id long, text string")
    sync.sync(store, {"notes": notes}, F.lit("2024-01-01").cast("timestamp"), ("snapshots", 4))
    assert store.applied("snapshots") == 4 and store.read("notes").count() == 1


@pytest.mark.parametrize("split", [(0, 1, 2, 3, 4, 5), (0, 0, 0, 3, 3, 3), (0, 0, 0, 0, 0, 0)])
def test_streamed_changes_equal_the_batch_form(spark, tmp_path, split):
    """Versions of notes in one batch or in several: the same chunks are given."""
    rows = [(note, version, f"h{(note * version) % 3 if note % 2 else note}", f"chunk {c}") for version in range(6) for note in range(8) for c in range(note % 3 + 1)]
    schema = "note_id long, version long, content_hash string, text string"
    want = sorted(map(tuple, sync.changed_versions(spark.createDataFrame(rows, schema)).collect()))
    log = str(tmp_path / "log")
    for batch in sorted(set(split)):
        own = [r for r in rows if split[r[1]] == batch]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(log)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(log)
    name = f"changes{'_'.join(map(str, split))}"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else the query goes on to expire state
    q = changes.changed_chunks(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    ended = q.awaitTermination(90)
    q.stop()
    assert ended
    assert sorted(map(tuple, spark.table(name).collect())) == want


def test_review_times_are_the_nearest_milliseconds_as_in_their_sql(spark, tmp_path):
    """A last review less than half a millisecond before a second is one of that second."""
    us = [0, 499, 500, 1499, 1500, -1, -499, -500, -1500, 1704067200999499, 1704067200999500, 1706654933999731]
    rows = spark.createDataFrame([(i, u, i) for i, u in enumerate(us)], "event_id long, us long, user_id long")
    rows = rows.select("event_id", F.expr("timestampadd(MICROSECOND, us, TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias("ts"), "user_id", F.lit("error").alias("event_type"), F.lit(2.5).alias("value"))
    rows.unionByName(rows.where("event_id = 0").withColumns({"ts": F.lit(None).cast("timestamp_ntz"), "user_id": F.lit(99)})).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute("SELECT user_id, epoch_ms(ts) FROM events ORDER BY user_id").fetchall()
    assert [tuple(r) for r in catalog.reviews(spark, str(tmp_path)).orderBy("card_id").select("card_id", "review_ms").collect()] == want
    stats = registry.QUERIES["agg01_card_stats"](spark, str(tmp_path))
    assert {r["card_id"]: r["last_review_s"] for r in stats.collect()}[11] == 1706654934
