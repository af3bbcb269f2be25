"""Changes of the card registry: additions that never overwrite, updates that never add."""

from pyspark.sql import functions as F

from recallgrid.operators import cardbook

CARDS = "slug string, note_id string, front string, created_at timestamp, updated_at timestamp"


def test_changes(spark):
    at = lambda n: F.timestamp_seconds(F.lit(n))
    rows = lambda *r: spark.createDataFrame([(s, n, f, None, None) for s, n, f in r], CARDS)
    seen = lambda df: {r["slug"]: (r["note_id"], r["front"], r["c"], r["u"]) for r in df.select("*", F.unix_seconds("created_at").alias("c"), F.unix_seconds("updated_at").alias("u")).collect()}
    first = cardbook.added(rows(), rows(("a", "1", "x"), ("b", "1", "z"), ("b", "1", "y"), (None, "1", "q"), ("c", None, None)).withColumn("extra", F.lit(1)), at(1))
    assert seen(first) == {"a": ("1", "x", 1, 1), "b": ("1", "y", 1, 1), "c": (None, None, 1, 1)}
    again = cardbook.added(first, rows(("a", "9", "new"), ("d", "2", "n")), at(2))
    assert seen(again) == seen(first) | {"d": ("2", "n", 2, 2)}
    put = cardbook.updated(again, rows(("a", "3", "A"), ("none", "1", "n")).withColumn("created_at", at(7)), at(3))
    assert seen(put) == seen(again) | {"a": ("3", "A", 1, 3)}
    less = cardbook.deleted(put, rows(("b", "", ""), ("none", "", "")).select("slug"))
    assert set(seen(less)) == {"a", "c", "d"} and set(seen(cardbook.deleted(put, rows().select("slug")))) == {"a", "b", "c", "d"}
    notes = spark.createDataFrame([("2",), ("2",), ("none",)], "note_id string")
    assert seen(cardbook.mapped(less, notes, rows(("e", "2", "e"), ("a", "2", "stays")), at(4))) == {"a": ("3", "A", 1, 3), "c": (None, None, 1, 1), "e": ("2", "e", 4, 4)}
