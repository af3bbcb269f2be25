"""Snapshot sync of a collection and incremental indexing by content hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions import hashes
from recallgrid.functions.text import rfc3339
from recallgrid.tables import Store, soft_deleted, upserted


def card_stats(reviews: DataFrame) -> DataFrame:
    """Statistics of each card's review log: count, mean factor, share of failed answers, last time, total time."""
    return reviews.groupBy("card_id").agg(
        F.count("*").alias("reviews"),
        F.avg("factor").alias("avg_ease"),
        F.avg((F.col("ease") == 1).cast("double")).alias("fail_rate"),
        F.timestamp_seconds(F.floor(F.max("review_ms") / 1000)).alias("last_review_at"),
        F.coalesce(F.sum("time_ms"), F.lit(0)).alias("total_time_ms"),
    )


def synced_notes(stored: DataFrame, snapshot: DataFrame, now: Column) -> DataFrame:
    """Stored notes after a snapshot: rows put in by id, those that are back revived, missing ones soft-deleted."""
    alive = snapshot.withColumn("deleted_at", F.lit(None).cast("timestamp")).select(*stored.columns)
    return soft_deleted(upserted(stored, alive, ["note_id"]), snapshot, ["note_id"], now)


def synced_stats(stored: DataFrame, stats: DataFrame, cards: DataFrame) -> DataFrame:
    """Statistics put in by card; those of cards that are not in the snapshot are skipped."""
    return upserted(stored, stats.join(cards, "card_id", "left_semi").select(*stored.columns), ["card_id"])


METADATA = "key string, value string"


def sync(store: Store, snapshot: dict[str, DataFrame], now: Column, batch: tuple[str, int] | None = None, source: str | None = None) -> None:
    """Brings decks, models, notes, cards and card_stats of a store to a snapshot; versions change together at the end,
    with the stream's batch if the snapshot is one. ``source``, the collection's path, is kept with the time in the same
    write, as metadata (key, value) under ``last_collection_path`` and ``last_sync_at``."""
    new = {name: upserted(store.read(name, snapshot[name].schema), snapshot[name], [key]) for name, key in (("decks", "deck_id"), ("models", "model_id"), ("cards", "card_id")) if name in snapshot}
    if "notes" in snapshot:
        schema = snapshot["notes"].withColumn("deleted_at", F.lit(None).cast("timestamp")).schema
        new["notes"] = synced_notes(store.read("notes", schema), snapshot["notes"], now)
    if "card_stats" in snapshot:
        new["card_stats"] = synced_stats(store.read("card_stats", snapshot["card_stats"].schema), snapshot["card_stats"], snapshot["cards"])
    if source is not None:
        rows = store.spark.range(1).select(F.explode(F.create_map(F.lit("last_sync_at"), rfc3339(now), F.lit("last_collection_path"), F.lit(source))))
        new["metadata"] = upserted(store.read("metadata", METADATA), rows, ["key"])
    store.write(new, batch)


def chunks(notes: DataFrame, model: str) -> DataFrame:
    """The text chunk of each note with its id and content hash."""
    parts = F.array(F.coalesce("text", F.lit("")))
    return notes.select("note_id", hashes.chunk_id(F.col("note_id"), F.lit("text_primary"), F.lit("")).alias("chunk_id"), hashes.parts_hash(model, parts).alias("content_hash"), F.coalesce("text", F.lit("")).alias("text"))


def changed(chunks_now: DataFrame, indexed: DataFrame) -> DataFrame:
    """Chunks whose note isn't indexed, or is with another hash."""
    old = indexed.groupBy("note_id").agg(F.min_by("content_hash", "chunk_id").alias("old_hash"))
    return chunks_now.join(old, "note_id", "left").where("old_hash is null or old_hash <> content_hash").drop("old_hash")


def changed_versions(versions: DataFrame) -> DataFrame:
    """Chunks (note_id, version, content_hash, ...) whose note had another hash in the version before, or none."""
    last = versions.select("note_id", "version", "content_hash").distinct()
    before = F.lag("content_hash").over(W.partitionBy("note_id").orderBy("version"))
    new = last.withColumn("before", before).where("before is null or before <> content_hash").select("note_id", "version")
    return versions.join(new, ["note_id", "version"], "left_semi")


def indexed(chunks_now: DataFrame, index: DataFrame, embed: Callable[[Column], Column], force: bool = False) -> DataFrame:
    """The index after an incremental run: new and changed chunks embedded, those of notes that are gone removed."""
    todo = chunks_now if force else changed(chunks_now, index)
    made = todo.withColumn("vector", embed(F.col("text"))).drop("text").select(*index.columns)
    kept = index.join(chunks_now.select("note_id").distinct(), "note_id", "left_semi")
    return upserted(kept.join(made.select("note_id").distinct(), "note_id", "left_anti"), made, ["chunk_id"])


def index_summary(chunks_now: DataFrame, index: DataFrame) -> DataFrame:
    total, todo = chunks_now.agg(F.count("*").alias("chunks")), changed(chunks_now, index).agg(F.count("*").alias("to_embed"))
    gone = index.join(chunks_now, "note_id", "left_anti").agg(F.countDistinct("note_id").alias("removed_notes"))
    return total.crossJoin(todo).crossJoin(gone)


def needs_reindex(stored: dict | None, wanted: dict) -> str | None:
    """Why an index can't serve a model: missing, or another dimension, model or schema."""
    if stored is None:
        return "missing"
    return next((f"{k} mismatch" for k in ("dimension", "model", "schema") if stored.get(k) != wanted.get(k)), None)


def orphans(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Keys on one side only."""
    a, b = local.select(key).distinct(), remote.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("local")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("remote")))


def stale_states(states: DataFrame, cutoff: Column) -> DataFrame:
    return states.where((F.col("synced_at") > 0) & (F.col("synced_at") < cutoff))
