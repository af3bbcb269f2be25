"""Connected components of link tables, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.tables import discard, written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has a link.

    Alternating large-star and small-star rounds; each is one grouped minimum and one join on ids, so no component is
    ever gathered in a task. Ends when a round changes no edge; the number of rounds grows with the logarithm of the
    number of ids. Self-links and repeated links are harmless, an empty table gives an empty table.
    """
    ends = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = written(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        before, edges = edges, written(small)
        was, mark = mark, _mark(edges)
        discard(before)
        if mark == was:
            break
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
    return row["n"], row["h"]
