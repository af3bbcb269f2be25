"""Clusters of duplicate notes from pairs of similar ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import hashes
from recallgrid.operators.components import components


def text_key(text: Column) -> Column:
    """What makes two texts the same: their hash with case and white space folded."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")), 256)


def exact_pairs(notes: DataFrame) -> DataFrame:
    """(a, b, similarity 1) from the first of each group of notes with the same normalised text to each other one.

    A star per group is enough to cluster it, and grows with the group, not with its square.
    """
    keyed = notes.where(F.col("text").isNotNull()).select("note_id", text_key(F.col("text")).alias("key"))
    first = keyed.groupBy("key").agg(F.min("note_id").alias("a"))
    return keyed.join(first, "key").where("note_id > a").select("a", F.col("note_id").alias("b"), F.lit(1.0).alias("similarity"))


def clusters(pairs: DataFrame, reps: DataFrame, least: float = 0.92, notes: DataFrame | None = None) -> DataFrame:
    """(representative, size, note_id, similarity): members of clusters of linked pairs of at least ``least``.

    The representative has the most total repetitions, of equal ones the smallest id. A member's similarity to it is
    that of their pair, 1 if their texts in ``notes`` are the same, or 0 if they are linked only by way of others.
    """
    close = pairs.where(F.col("similarity") >= least)
    member = components(close, "a", "b").select(F.col("id").alias("note_id"), "component")
    rows = member.join(reps, "note_id", "left").withColumn("total_reps", F.coalesce("total_reps", F.lit(0)))
    heads = rows.groupBy("component").agg(F.max_by("note_id", F.struct("total_reps", -F.col("note_id"))).alias("representative"), F.count("*").alias("size"))
    both = close.select("a", "b", "similarity").unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    direct = both.groupBy(F.col("a").alias("representative"), F.col("b").alias("note_id")).agg(F.max("similarity").alias("similarity"))
    out = rows.join(heads, "component").where("note_id <> representative").join(direct, ["representative", "note_id"], "left")
    if notes is not None:
        keys = notes.where(F.col("text").isNotNull()).select("note_id", text_key(F.col("text")).alias("key"))
        out = out.join(keys, "note_id", "left").join(keys.select(F.col("note_id").alias("representative"), F.col("key").alias("other")), "representative", "left")
        out = out.withColumn("similarity", F.when(F.col("key") == F.col("other"), 1.0).otherwise(F.col("similarity")))
    return out.select("representative", "size", "note_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def listed(members: DataFrame, notes: DataFrame, most: int = 50) -> DataFrame:
    """One row per cluster, the largest first: representative, size, sorted members, union of tags and, where ``notes`` has
    deck_names, of decks."""
    columns = [c for c in ("tags", "deck_names") if c in notes.columns]
    tags = members.select("representative", "note_id").unionByName(members.select("representative", F.col("representative").alias("note_id")).distinct())
    every = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in columns]
    tags = tags.join(notes.select("note_id", *columns), "note_id").groupBy("representative").agg(*every)
    rows = members.groupBy("representative").agg(F.max("size").alias("size"), F.array_sort(F.collect_list("note_id")).alias("members"))
    return rows.join(tags, "representative", "left").orderBy(F.desc("size"), "representative").limit(most)


def stats(shown: DataFrame, notes: DataFrame) -> DataFrame:
    """Counts over the clusters that are shown; all active notes count as scanned."""
    out = shown.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_size"))
    return out.crossJoin(notes.agg(F.count("*").alias("notes_scanned")))


def scanner_items(members: DataFrame, slugs: DataFrame) -> DataFrame:
    """Work items of duplicates: from 0.92 on a duplicate of tier 1, else an overlap of tier 2."""
    s = slugs.select("note_id", "slug")
    r = slugs.select(F.col("note_id").alias("representative"), F.col("slug").alias("other_slug"))
    rows = members.join(s, "note_id").join(r, "representative", "left")
    other = F.coalesce("other_slug", F.concat(F.lit("note:"), F.col("representative").cast("string")))
    same = F.col("similarity") >= 0.92
    kind = F.when(same, "duplicate").otherwise("semantic_overlap")
    return rows.select(hashes.item_id("dup", F.col("slug"), other).alias("id"), F.lit("audit").alias("loop_kind"), kind.alias("kind"), F.when(same, 1).otherwise(2).alias("tier"), "slug", other.alias("other_slug"), "similarity")
