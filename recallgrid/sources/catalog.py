"""Logical tables of a note collection, and how the given star-schema tables are seen as one.

A real deployment reads its own Parquet tables with these schemas; the views below let every operator run on the
tables at hand, so that results can be held against SQL over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.session import table

NOTES = "note_id long, model_id long, text string, tags array<string>, deleted boolean"
CARDS = "card_id long, note_id long, deck string, ivl int, lapses int, reps int, ease int"
CARD_STATS = "card_id long, reviews long, avg_ease double, fail_rate double, last_review_at timestamp, total_time_ms long"
TOPICS = "topic_id int, path string, label string"
NOTE_TOPICS = "note_id long, topic_id int, confidence double, method string"
REVIEWS = "review_ms long, card_id long, ease int, factor int, time_ms long"
EDGES = "source long, target long, edge_type string, edge_source string, weight double"


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("topic_id"), F.col("r_name").alias("path"), "r_regionkey", "r_name")
    leaves = table(spark, sf_dir, "nation").join(roots, F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = leaves.select((F.col("n_nationkey") + 100).alias("topic_id"), F.concat_ws("/", "r_name", "n_name").alias("path"))
    both = roots.select("topic_id", "path").unionByName(leaves)
    return both.withColumn("label", F.element_at(F.split("path", "/"), -1))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("note_id"),
        (F.col("c_custkey") % 4 + 200).alias("model_id"),
        F.concat_ws(" ", F.lower("c_name"), F.lower("c_mktsegment")).alias("text"),
        F.array(F.lower("c_mktsegment"), F.concat(F.lit("tag-"), F.col("c_custkey") % 24)).alias("tags"),
        (F.col("c_custkey") % 17 == 0).alias("deleted"),
    )


def note_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("confidence", F.least(F.greatest((F.col("c_acctbal") + 1000) / 11000, F.lit(0.0)), F.lit(1.0)))
    n = table(spark, sf_dir, "nation")
    leaf = c.select(F.col("c_custkey").alias("note_id"), (F.col("c_nationkey") + 100).alias("topic_id"), "confidence")
    root = c.where("c_custkey % 5 = 0").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    root = root.select(F.col("c_custkey").alias("note_id"), F.col("n_regionkey").alias("topic_id"), (F.col("confidence") * 0.5).alias("confidence"))
    return leaf.unionByName(root).withColumn("method", F.lit("embedding"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("card_id"),
        F.col("o_custkey").alias("note_id"),
        F.col("o_orderpriority").alias("deck"),
        (k % 60).cast("int").alias("ivl"),
        (k % 7).cast("int").alias("lapses"),
        (k % 25).cast("int").alias("reps"),
        (k % 2000 + 1300).cast("int").alias("ease"),
    )


def card_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("card_id")).agg(F.count("*").alias("reviews"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("fail_rate"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times are whole milliseconds, the nearest ones, of two the one further from 1970."""
    e = table(spark, sf_dir, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"))
    return e.select(
        F.expr("(us + 500 * CAST(sign(us) AS BIGINT)) DIV 1000").alias("review_ms"),
        F.col("user_id").alias("card_id"),
        F.when(F.col("event_type") == "error", 1).otherwise(3).alias("ease"),
        (F.col("event_id") % 1200 + 1300).cast("int").alias("factor"),
        F.floor("value").cast("long").alias("time_ms"),
    )
