"""Workload forecast, vault links and latency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions import text as tx


def workload(cards: DataFrame, days: int, deck: str | None = None) -> DataFrame:
    """(day, reviews) for the next days: each card is due after its interval and again after each next one, which grows
    by its ease factor. A deterministic expansion of due dates, not a simulation."""
    rows = cards if deck is None else cards.where(F.col("deck") == deck)
    rows = rows.select(F.greatest("ivl", F.lit(1)).cast("double").alias("ivl"), (F.greatest("ease", F.lit(1300)) / 1000.0).alias("factor"))
    start = F.array(F.col("ivl"))
    most = max(1, days.bit_length() * 4)
    due = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, lambda xs, _: F.when(F.element_at(xs, -1) <= days, F.concat(xs, F.array(F.element_at(xs, -1) + F.col("ivl") * F.pow(F.col("factor"), F.size(xs))))).otherwise(xs))
    counted = rows.select(F.explode(due).alias("at")).where(F.col("at") <= days).groupBy(F.floor("at").cast("int").alias("day")).agg(F.count("*").alias("reviews"))
    every = cards.sparkSession.range(1, days + 1).select(F.col("id").cast("int").alias("day"))
    return every.join(counted, "day", "left").select("day", F.coalesce("reviews", F.lit(0)).alias("reviews"))


def cards_of_deck(cards: DataFrame, decks: DataFrame, name: str) -> DataFrame:
    """The cards whose deck (deck_id, name) has a name, with it as ``deck``; the name is tested before the join."""
    return cards.join(decks.where(F.col("name") == name).select("deck_id", F.col("name").alias("deck")), "deck_id")


def workload_summary(daily: DataFrame) -> DataFrame:
    """Total, mean and the peak day; of equal peaks the last."""
    return daily.agg(F.sum("reviews").alias("total"), F.avg("reviews").alias("mean"), F.max("reviews").alias("peak"), F.max_by("day", F.struct("reviews", "day")).alias("peak_day"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def links(vault: DataFrame) -> DataFrame:
    """(source, target, broken): wiki links of notes (path, content) by stem; of notes with one stem the last path counts."""
    notes = vault.groupBy(stem(F.col("path")).alias("stem")).agg(F.max_by("content", "path").alias("content"))
    rows = notes.select(F.col("stem").alias("source"), F.explode(F.array_distinct(tx.wikilinks(F.col("content")))).alias("target"))
    known = notes.select(F.col("stem").alias("target"), F.lit(False).alias("broken"))
    return rows.join(known, "target", "left").select("source", "target", F.coalesce("broken", F.lit(True)).alias("broken"))


def vault_stats(vault: DataFrame) -> DataFrame:
    """Counts of notes, frontmatter, links, broken links and notes without links in or out."""
    found = links(vault)
    stems = vault.select(stem(F.col("path")).alias("stem")).distinct()
    touched = found.select(F.col("source").alias("stem")).unionByName(found.where("not broken").select(F.col("target").alias("stem"))).distinct()
    a = vault.agg(F.countDistinct(stem(F.col("path"))).alias("notes"), F.count_if(tx.frontmatter(F.col("content")).isNotNull()).alias("with_frontmatter"))
    b = found.agg(F.count("*").alias("links"), F.count_if("broken").alias("broken_links"))
    return a.crossJoin(b).crossJoin(stems.join(touched, "stem", "left_anti").agg(F.count("*").alias("orphans")))


def latency(histogram: DataFrame, group: str, percentile: float = 0.95) -> DataFrame:
    """Requests, error rate and nearest-rank percentile of (group, ms, n, errors) histograms, merged first."""
    merged = histogram.groupBy(group, "ms").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    total = merged.groupBy(group).agg(F.sum("n").alias("requests"), (F.sum("errors") / F.sum("n")).alias("error_rate"))
    run = F.sum("n").over(W.partitionBy(group).orderBy("ms").rowsBetween(W.unboundedPreceding, 0))
    reached = merged.withColumn("run", run).join(total, group).where(F.col("run") >= F.ceil(F.col("requests") * percentile))
    return reached.groupBy(group).agg(F.first("requests").alias("requests"), F.first("error_rate").alias("error_rate"), F.min("ms").alias("p"))
