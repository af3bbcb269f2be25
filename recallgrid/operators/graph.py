"""Concept graph: edges from similarity and shared tags, related notes, prerequisites, neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.tables import written


def similarity_edges(pairs: DataFrame, low: float = 0.7, high: float = 0.93) -> DataFrame:
    """Both directions of pairs (a, b, similarity) in the band, compared in single precision; none to itself."""
    kept = pairs.where(F.col("similarity").cast("float").between(F.lit(low).cast("float"), F.lit(high).cast("float")) & (F.col("a") != F.col("b")))
    edge = lambda x, y: kept.select(F.col(x).alias("source"), F.col(y).alias("target"), F.lit("similar").alias("edge_type"), F.lit("embedding").alias("edge_source"), F.col("similarity").alias("weight"))
    return edge("a", "b").unionByName(edge("b", "a")).dropDuplicates(["source", "target", "edge_type"])


def tag_edges(notes: DataFrame, least: int = 3, most: int = 5000) -> DataFrame:
    """(source < target, shared, weight): notes that share at least ``least`` tags, by shared over the longer tag list.

    Tags on too many notes say little, yet none is dropped: notes with equal tag lists are folded into one class first,
    and classes are joined by tag, so a tag costs pairs of tag lists, not of notes. Only the best ``most`` edges, which
    the report is about, are expanded from classes to notes: pairs of classes by their weight while all heavier ones have
    fewer edges than that; of a class its first ``most`` + 1 notes, as any other has as many edges before its own; and of a
    pair of classes those sources that fewer edges come before.
    """
    rows = notes.where("not deleted and size(tags) > 0").select("note_id", F.array_sort("tags").alias("tags"))
    classes = rows.groupBy("tags").agg(F.min("note_id").alias("class"), F.count("*").alias("n"))
    each = classes.select("class", "n", F.size("tags").alias("len"), F.explode("tags").alias("tag"))
    counts = each.groupBy("class", "n", "len", "tag").agg(F.count("*").alias("times"))
    other = counts.select(F.col("class").alias("class2"), F.col("n").alias("n2"), F.col("len").alias("len2"), "tag", F.col("times").alias("times2"))
    shared = counts.join(other, "tag").where("class < class2 or (class = class2 and n > 1)").groupBy("class", "class2", "n", "n2", "len", "len2").agg(F.sum(F.col("times") * F.col("times2")).alias("shared"))
    weight = F.col("shared") / F.greatest("len", "len2")
    edges = F.when(F.col("class") == F.col("class2"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("n2").cast("double"))
    best = written(shared.where(F.col("shared") >= least).select("class", "class2", "shared", weight.alias("weight"), edges.alias("edges")))
    heavier = W.orderBy(F.desc("weight")).rowsBetween(W.unboundedPreceding, -1)
    weights = best.groupBy("weight").agg(F.sum("edges").alias("edges"))  # a row for each ratio of two small numbers
    weights = weights.withColumn("before", F.coalesce(F.sum("edges").over(heavier), F.lit(0.0))).where(F.col("before") < most)
    best = written(best.join(weights.select("weight"), "weight").select("class", "class2", "shared", "weight"))
    member = rows.join(classes.select("tags", "class"), "tags").select("note_id", "class")
    member = member.withColumn("at", F.row_number().over(W.partitionBy("class").orderBy("note_id"))).where(F.col("at") <= most + 1)
    member = written(member.select("note_id", "class"))
    first = best.join(member, "class").withColumn("opposite", F.col("class2"))
    second = best.where("class < class2").join(member.withColumnRenamed("class", "class2"), "class2").withColumn("opposite", F.col("class"))
    ends = first.unionByName(second)
    pair = W.partitionBy("class", "class2")
    later = pair.orderBy(F.desc("note_id")).rowsBetween(W.unboundedPreceding, -1)
    of = lambda side: F.coalesce(F.count_if(side).over(later), F.lit(0))
    targets = F.when(F.col("opposite") == F.col("class"), of(F.col("opposite") == F.col("class2"))).otherwise(of(F.col("opposite") == F.col("class")))
    targets = F.when(F.col("class") == F.col("class2"), of(F.lit(True))).otherwise(targets)
    before = F.coalesce(F.sum("targets").over(pair.orderBy("note_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sources = ends.withColumn("targets", targets).withColumn("before", before).where((F.col("targets") > 0) & (F.col("before") < most))
    sources = written(sources.select(F.col("note_id").alias("source"), "opposite", "shared", "weight"))
    target = member.select(F.col("note_id").alias("target"), F.col("class").alias("opposite"))
    out = sources.join(target, "opposite").where("source < target").select("source", "target", "shared", "weight")
    return out.orderBy(F.desc("weight"), "source", "target").limit(most)


def related(edges: DataFrame, node: int, limit: int = 10) -> DataFrame:
    """Neighbours of a node over edges in either direction, the heaviest first."""
    rows = edges.where((F.col("source") == node) | (F.col("target") == node))
    other = F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source"))
    return rows.select(other.alias("node"), "edge_type", "weight").orderBy(F.desc("weight"), "node", "edge_type").limit(limit)


def prerequisites(edges: DataFrame, node: int) -> DataFrame:
    return edges.where((F.col("target") == node) & (F.col("edge_type") == "prerequisite")).orderBy(F.desc("weight"), "source")


def dependents(edges: DataFrame, node: int) -> DataFrame:
    return edges.where((F.col("source") == node) & (F.col("edge_type") == "prerequisite")).orderBy(F.desc("weight"), "target")


def prerequisite_gaps(edges: DataFrame, topic: int, note_counts: DataFrame | None = None, least: int = 1) -> DataFrame:
    """The edges into a topic from its prerequisites, the heaviest first; with ``note_counts`` (topic_id, note_count) those
    from topics of fewer than ``least`` notes."""
    rows = prerequisites(edges, topic)
    if note_counts is None:
        return rows
    counts = note_counts.select(F.col("topic_id").alias("source"), "note_count")
    return rows.join(counts, "source", "left").where(F.coalesce("note_count", F.lit(0)) < least).select(*edges.columns).orderBy(F.desc("weight"), "source")


def prerequisite_chain(edges: DataFrame, node: int, depth: int) -> DataFrame:
    """Edges into the nodes that a backward walk of ``depth`` steps visits, each with the step at which it was taken."""
    own = edges.where("edge_type = 'prerequisite'").select("source", "target", "weight")
    frontier = visited = own.sparkSession.range(1).select(F.lit(node).cast("long").alias("node"))
    taken, made = [], []
    for step in range(1, depth + 1):
        found = written(own.join(frontier.withColumnRenamed("node", "target"), "target").select("source", "target", "weight", F.lit(step).alias("step")))
        made.append(found)
        if found.isEmpty():
            break
        taken.append(found)
        frontier = found.select(F.col("source").alias("node")).distinct().join(visited, "node", "left_anti")
        visited = visited.unionByName(frontier)
    return reduce(DataFrame.unionByName, taken) if taken else own.limit(0).withColumn("step", F.lit(0))


def neighbourhood(edges: DataFrame, node: int, hops: int, limit: int) -> DataFrame:
    """(node, hop): nodes within ``hops`` undirected steps, at most ``limit`` of each node's heaviest edges a step."""
    both = edges.select("source", "target", "weight").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    w = W.partitionBy("source").orderBy(F.desc("weight"), "target")
    visited = both.sparkSession.range(1).select(F.lit(node).cast("long").alias("node"), F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        frontier = visited.where(F.col("hop") == hop - 1).select(F.col("node").alias("source"))
        step = both.join(frontier, "source").withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
        new = step.select(F.col("target").alias("node")).distinct().join(visited, "node", "left_anti")
        visited = written(visited.unionByName(new.withColumn("hop", F.lit(hop))))
    return visited


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type", "edge_source").agg(F.count("*").alias("n"))


def without_source(edges: DataFrame, source: str) -> DataFrame:
    """The edges that another source made."""
    return edges.where(~F.col("edge_source").eqNullSafe(source))
