"""Topic coverage, gaps, weak notes and labels, each for all topics in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.operators.neighbours import nearest
from recallgrid.tables import numbered, upserted

MATURE = 21


def parent(path: Column) -> Column:
    """The path above, or null for a root."""
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/", 1))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def ancestors(path: Column) -> Column:
    """All paths on the way from the root to ``path``, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def in_subtree(path: Column, root: Column | str) -> Column:
    """Whether ``path`` is ``root`` or below it; wildcards in a path mean nothing."""
    root = F.lit(root) if isinstance(root, str) else root
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def is_child(path: Column, root: Column | str) -> Column:
    return parent(path) == (F.lit(root) if isinstance(root, str) else root)


def coverage(topics: DataFrame, note_topics: DataFrame, cards: DataFrame, card_stats: DataFrame, subtree: bool = True) -> DataFrame:
    """One row per topic: note, mature-card, child, subtree and weak-note counts, mean confidence and lapses.

    Means are over (assignment, card) rows, so a note with more cards weighs more; weak notes are those of the topic
    itself with a card whose fail rate is at least 0.1. Cards are summed up per note before anything is joined, so no
    distinct count over the fan-out is needed.
    """
    per_note = cards.groupBy("note_id").agg(F.count("*").alias("n"), F.count_if(F.col("ivl") >= MATURE).alias("mature"), F.sum("lapses").alias("lapses"), F.count("lapses").alias("lapse_n"))
    assigned = note_topics.join(topics.select("topic_id", "path"), "topic_id")
    at = F.explode(ancestors(F.col("path"))) if subtree else F.col("path")
    by_note = assigned.select(at.alias("at"), "note_id", "confidence").groupBy("at", "note_id").agg(F.sum("confidence").alias("confidence"), F.count("confidence").alias("confidence_n"), F.count("*").alias("times"))
    rows = by_note.join(per_note, "note_id", "left")
    weight = F.coalesce("n", F.lit(1))
    stats = rows.groupBy("at").agg(
        F.count("*").alias("note_count"),
        F.coalesce(F.sum("mature"), F.lit(0)).alias("mature_count"),
        (F.sum(F.col("confidence") * weight) / F.sum(F.col("confidence_n") * weight)).alias("avg_confidence"),
        (F.sum(F.col("lapses") * F.col("times")).cast("double") / F.sum(F.col("lapse_n") * F.col("times"))).alias("avg_lapses"),
    )
    direct = assigned.groupBy("path").agg(F.lit(1).alias("covered"))
    tree = topics.join(direct, "path", "left")
    children = tree.where(parent(F.col("path")).isNotNull()).groupBy(parent(F.col("path")).alias("at")).agg(F.count("*").alias("child_count"), F.count("covered").alias("covered_children"))
    below = topics.select("path", F.explode(ancestors(F.col("path"))).alias("at")).where("at <> path").groupBy("at").agg(F.count("*").alias("subtree_count"))
    weak_note = cards.join(card_stats.where("fail_rate >= 0.1").select("card_id"), "card_id", "left_semi").select("note_id").distinct()
    weak = assigned.join(weak_note, "note_id", "left_semi").select("path", "note_id").distinct().groupBy(F.col("path").alias("at")).agg(F.count("*").alias("weak_notes"))
    out = topics.withColumn("at", F.col("path"))
    for part in (stats, children, below, weak):
        out = out.join(part, "at", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("note_count", "subtree_count", "child_count", "covered_children", "mature_count", "weak_notes")]
    means = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_confidence", "avg_lapses")]
    return out.select("topic_id", "path", "label", *counts, *means)


def gaps(topics: DataFrame, note_topics: DataFrame, root: str | None = None, least: int = 1) -> DataFrame:
    """Topics at or below ``root`` with fewer than ``least`` assignments of their own; soft-deleted notes count."""
    if least < 1:
        raise ValueError("least must be positive")
    some = topics if root is None else topics.where(in_subtree(F.col("path"), root))
    n = note_topics.groupBy("topic_id").agg(F.count("note_id").alias("n"))
    rows = some.join(n, "topic_id", "left").withColumn("note_count", F.coalesce("n", F.lit(0))).where(F.col("note_count") < least)
    kind = F.when(F.col("note_count") == 0, "missing").otherwise("undercovered")
    return rows.select("topic_id", "path", "label", kind.alias("gap_type"), "note_count", F.lit(least).alias("threshold")).orderBy("note_count", "path")


def gap_counts(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("gap_type") == "missing").alias("missing"), F.count_if(F.col("gap_type") == "undercovered").alias("undercovered"))


def weak_notes(notes: DataFrame, note_topics: DataFrame, topics: DataFrame, cards: DataFrame, card_stats: DataFrame, root: str | None = None, limit: int = 20, least: float = 0.1) -> DataFrame:
    """Active notes of a subtree whose worst card fails at least at rate ``least``, by lapses."""
    if limit < 1:
        raise ValueError("limit must be positive")
    some = topics if root is None else topics.where(in_subtree(F.col("path"), root))
    per_note = cards.join(card_stats.select("card_id", "fail_rate"), "card_id", "left").groupBy("note_id").agg(F.coalesce(F.sum("lapses"), F.lit(0)).alias("total_lapses"), F.max("fail_rate").alias("fail_rate"))
    rows = note_topics.join(some.select("topic_id", "path"), "topic_id").join(per_note.where(F.col("fail_rate") >= least), "note_id")
    rows = rows.join(notes.where(~F.col("deleted")), "note_id")
    return rows.select("note_id", F.col("path").alias("topic_path"), "confidence", "total_lapses", "fail_rate", F.left("text", F.lit(200)).alias("preview")).orderBy(F.desc("total_lapses"), "note_id", "topic_path").limit(limit)


def note_counts(topics: DataFrame, note_topics: DataFrame) -> DataFrame:
    n = note_topics.groupBy("topic_id").agg(F.countDistinct("note_id").alias("n"))
    return topics.join(n, "topic_id", "left").select("topic_id", "path", "label", F.coalesce("n", F.lit(0)).alias("note_count"))


def tree_rows(topics: DataFrame, root: str | None = None, max_depth: int | None = None) -> DataFrame:
    """Pre-order rows of the taxonomy: path, parent, depth. Segments are compared one by one, as a walk would."""
    some = topics if root is None else topics.where(in_subtree(F.col("path"), root))
    rows = some.select("topic_id", "path", "label", parent(F.col("path")).alias("parent"), depth(F.col("path")).alias("depth"))
    if max_depth is not None:
        rows = rows.where(F.col("depth") <= max_depth + (0 if root is None else root.count("/")))
    return rows.orderBy(F.split("path", "/"))


def nested(rows: list, root: str | None = None) -> list[dict]:
    """The tree of collected ``tree_rows`` or ``covered_tree`` as nested dictionaries, for a response to a caller."""
    left_out = {"topic_id", "parent", "depth"}
    nodes = {r["path"]: {k: v for k, v in r.asDict().items() if k not in left_out} | {"children": []} for r in rows}
    out = []
    for r in rows:
        up = nodes.get(r["parent"]) if r["path"] != root else None
        (up["children"] if up else out).append(nodes[r["path"]])
    return out


def similarities(notes: DataFrame, topics: DataFrame, least: float = 0.6, most: int = 5) -> DataFrame:
    """(note_id, topic_id, path, confidence): the ``most`` topics whose label's vector is nearest to each note's, by cosine.

    ``notes`` has note_id and vector, ``topics`` topic_id, path and vector; ids of the two are told apart, and equal
    confidences go by topic id. The notes are the stated queries, all topics are searched.
    """
    other = topics.select((-1 - F.col("topic_id").cast("long")).alias("id"), "vector")  # a note may have a topic's id
    found = nearest(notes.select(F.col("note_id").alias("query_id"), "vector"), other, most, least)
    rows = found.select(F.col("query_id").alias("note_id"), (-1 - F.col("id")).alias("topic_id"), F.col("score").alias("confidence"))
    return rows.join(topics.select(F.col("topic_id").cast("long").alias("topic_id"), "path"), "topic_id").select("note_id", "topic_id", "path", "confidence")


def embedded_text() -> Column:
    """What of a topic (label, description) is embedded: both, or the label where there is no description."""
    return F.when(F.col("description").isNotNull(), F.concat("label", F.lit(": "), "description")).otherwise(F.col("label"))


def assigned(stored: DataFrame, labelled: DataFrame, method: str = "embedding") -> DataFrame:
    """Stored assignments (note_id, topic_id, confidence, method) with new ones (note_id, topic_id, confidence) put in by
    note and topic: a pair that is there takes the new confidence and method; pairs that aren't labelled again stay."""
    new = labelled.groupBy("note_id", "topic_id").agg(F.max("confidence").alias("confidence")).withColumn("method", F.lit(method))
    return upserted(stored, new.select(*stored.columns), ["note_id", "topic_id"])


def covered_tree(coverage_rows: DataFrame, root: str | None = None) -> DataFrame:
    """Pre-order rows of the taxonomy with the counts of each node's coverage, for ``nested`` to put together."""
    rows = tree_rows(coverage_rows, root)
    counts = coverage_rows.drop("label", "path")
    return rows.join(counts, "topic_id").orderBy(F.split("path", "/"))


def upserted_ids(stored: DataFrame, tree: DataFrame) -> DataFrame:
    """(topic_id, path, label) after an upsert by path: known paths keep their id and take the new label, new ones get
    the ids after the largest, in the order of their paths."""
    fresh = tree.select("path", F.col("label").alias("new_label")).dropDuplicates(["path"])
    most = stored.agg(F.coalesce(F.max("topic_id"), F.lit(0)).cast("long").alias("most"))
    known = stored.join(fresh, "path", "left").select(F.col("topic_id").cast("long").alias("topic_id"), "path", F.coalesce("new_label", "label").alias("label"))
    new = numbered(fresh.join(stored.select("path"), "path", "left_anti"), ["path"], "number").crossJoin(F.broadcast(most))
    return known.unionByName(new.select((F.col("most") + F.col("number")).alias("topic_id"), "path", F.col("new_label").alias("label")))


def labels(similarities: DataFrame, least: float = 0.6, most: int = 5) -> DataFrame:
    """The ``most`` best topics of each note among (note_id, topic_id, path, confidence) rows of at least ``least``."""
    w = W.partitionBy("note_id").orderBy(F.desc("confidence"), "path")
    return similarities.where(F.col("confidence") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def label_stats(labelled: DataFrame, processed: DataFrame) -> DataFrame:
    """How many notes were processed, assignments made and topics matched."""
    made = labelled.agg(F.count("*").alias("assignments"), F.countDistinct("topic_id").alias("topics_matched"))
    return made.crossJoin(processed.agg(F.count("*").alias("notes_processed")))
