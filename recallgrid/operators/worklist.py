"""Work items: scanners over a card registry, scores, queue order, batches, transitions and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions import hashes, quality
from recallgrid.tables import numbered

#: Tiers from the cheapest to the most drastic fix.
TIERS = {"auto_fix": 1, "quick_fix": 2, "rework": 3, "delete": 4}
#: Allowed changes of an item's status (fixed values).
TRANSITIONS = {
    ("open", "in_progress"), ("open", "fixed"), ("open", "skipped"), ("open", "wont_fix"), ("in_progress", "fixed"),
    ("in_progress", "skipped"), ("in_progress", "wont_fix"), ("in_progress", "open"), ("fixed", "open"),
}
RESOLVED = ("fixed", "skipped", "wont_fix")
ITEM = ("id", "loop_kind", "kind", "dimension", "score", "message", "tier", "status", "slug", "source_path", "confidence")


def _items(rows: DataFrame, item_id: Column, kind: str, tier: Column | int, confidence: Column | float, loop: str = "audit", slug: Column | None = None, source: Column | None = None, **more: Column) -> DataFrame:
    fields = {"dimension": F.lit(None).cast("string"), "score": F.lit(None).cast("double"), "message": F.lit(None).cast("string")} | more
    nothing = F.lit(None).cast("string")
    return rows.select(
        item_id.alias("id"),
        F.lit(loop).alias("loop_kind"),
        F.lit(kind).alias("kind"),
        *[fields[c].alias(c) for c in ("dimension", "score", "message")],
        (F.lit(tier) if isinstance(tier, int) else tier).alias("tier"),
        F.lit("open").alias("status"),
        (nothing if slug is None else slug).alias("slug"),
        (nothing if source is None else source).alias("source_path"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"),
    )


def _of_card(rows: DataFrame, discriminator: Column, kind: str, tier: Column | int, confidence: Column | float, prefix: str = "", **more: Column) -> DataFrame:
    slug = F.col("slug")
    return _items(rows, hashes.item_id(prefix, slug, discriminator), kind, tier, confidence, slug=slug, **more)


def audit(registry: DataFrame) -> DataFrame:
    """Items of each card (slug, front, back, tags): validation issues, low dimensions, dead skills, missing tags."""
    front, back, tags = F.col("front"), F.col("back"), F.coalesce("tags", F.array().cast("array<string>"))
    found = registry.select("slug", F.explode(quality.card_issues(front, back, tags)).alias("i")).where("i.severity <> 'info'")
    tier = F.when(F.col("i.severity") == "error", TIERS["quick_fix"]).otherwise(TIERS["auto_fix"])
    parts = [_of_card(found, F.concat(F.lit("validation:"), "i.message"), "validation_error", tier, 1.0, message=F.col("i.message"))]
    scores = quality.scores(front, back, tags)
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), scores[d].alias("score")) for d in quality.DIMENSIONS]))
    low = registry.select("slug", each.alias("d")).where("d.score < 0.5")
    parts.append(_of_card(low, F.concat(F.lit("quality:"), "d.dimension"), "low_quality", TIERS["quick_fix"], 0.8, dimension=F.col("d.dimension"), score=F.col("d.score")))
    parts.append(_of_card(registry.where(F.array_contains(tags, "skill::dead")), F.lit("dead_skill"), "dead_skill", TIERS["delete"], 0.9))
    bare = ~F.exists(tags, lambda t: t.startswith("topic::") | t.startswith("skill::"))
    parts.append(_of_card(registry.where(bare), F.lit("missing_tags"), "missing_tags", TIERS["auto_fix"], 1.0))
    return reduce(DataFrame.unionByName, parts)


#: Decay of the forgetting curve, and the factor that makes recall 0.9 after one stability.
DECAY = -0.5
FACTOR = 0.9 ** (1 / DECAY) - 1


def memory(ivl: Column, ease: Column) -> tuple[Column, Column]:
    """(stability, difficulty) of a card from its interval and ease; null for new cards.

    By the published conversion from an interval scheduler: recall is 0.9 after one interval, so the stability is the
    interval; difficulty falls with the ease factor's gain of stability, between 1 and 10.
    """
    some = (ivl > 0) & (ease > 0)
    w8, w9, w10 = 1.4604, 0.0046, 1.54575
    gain = (ease / 1000.0 - 1.0) / (F.exp(F.lit(w8)) * F.pow(F.greatest(ivl, F.lit(1)), F.lit(-w9)) * (F.exp(F.lit((1 - 0.9) * w10)) - 1))
    return F.when(some, ivl.cast("double")), F.when(some, F.least(F.greatest(11.0 - gain, F.lit(1.0)), F.lit(10.0)))


def retrievability(stability: Column, days: Column) -> Column:
    return F.pow(1 + FACTOR * days / stability, F.lit(DECAY))


def retention(cards: DataFrame, card_stats: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """Items from the memory model: rework, delete, quick fix, the first rule that holds; old ease rules for new cards.

    ``registry`` has slug and note_id; of several slugs of a note the last one counts.
    """
    slugs = registry.where("note_id is not null").groupBy("note_id").agg(F.max("slug").alias("slug"))
    rows = cards.join(slugs, "note_id").join(card_stats, "card_id", "left")
    stability, difficulty = memory(F.col("ivl"), F.col("ease"))
    days = F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp("last_review_at")) / 86400), F.lit(0))
    rows = rows.withColumns({"stability": stability, "difficulty": difficulty}).withColumn("recall", retrievability(F.col("stability"), F.coalesce(days, F.lit(0))))
    known, reviews, rate = F.col("stability").isNotNull(), F.coalesce("reviews", F.lit(0)), F.coalesce("fail_rate", F.lit(0.0))
    rework = F.when(known, (F.col("stability") < 5) & (F.col("difficulty") > 7)).otherwise((F.col("ease") < 1800) & (F.col("lapses") >= 5))
    delete = F.when(known, (F.col("stability") < 2) & (F.col("difficulty") > 8.5) & (F.col("reps") >= 10)).otherwise((F.col("ease") < 1500) & (F.col("reps") >= 10))
    quick = F.when(known, F.col("recall") < 0.5).otherwise(rate > 0.4) & (reviews >= 5)
    rule = F.when(rework, "fsrs_low_stability_rework").when(delete, "fsrs_persistently_difficult_delete").when(quick, "fsrs_low_retrievability_quickfix")
    tier = F.when(rework, TIERS["rework"]).when(delete, TIERS["delete"]).otherwise(TIERS["quick_fix"])
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    score = F.when(known, clamp(F.col("stability") / 100) * 0.7 + clamp(1 - (F.col("difficulty") - 1) / 9) * 0.3).otherwise(clamp(F.col("ease") / 5000) * (1 - rate))
    rows = rows.withColumns({"rule": rule, "tier": tier, "score": score}).where("rule is not null")
    confidence = F.when(rework, 0.85).when(delete, 0.9).otherwise(0.8)
    return _of_card(rows, F.col("rule"), "low_quality", F.col("tier"), confidence, prefix="fsrs", dimension=F.lit("retention"), score=F.col("score"))


def uncovered(vault: DataFrame, registry: DataFrame) -> DataFrame:
    """Items of vault notes (path) that no card comes from; they are for the generation loop and have no slug."""
    path = F.col("path")
    rows = vault.select("path").distinct().join(registry.select(F.col("source_path").alias("path")), "path", "left_anti")
    return _items(rows, hashes.item_id("gen", path, F.lit("uncovered")), "uncovered_topic", TIERS["rework"], 0.9, loop="generation", source=path)


def stale(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Items of sources whose stored hash isn't that of their file (path, content) any more, or whose file is gone.

    ``registry`` has note_id, source_path and content_hash; of several notes of a source the last one counts, notes
    without a hash don't. A source gives one item, whose id is that of its path.
    """
    stored = registry.where("content_hash is not null").groupBy("source_path").agg(F.max_by("content_hash", "note_id").alias("stored"))
    now = files.select(F.col("path").alias("source_path"), hashes.file_hash(F.col("content")).alias("current"), F.lit(True).alias("there"))
    rows = stored.join(now, "source_path", "left").where("there is null or stored <> current")
    gone, path = F.col("there").isNull(), F.col("source_path")
    message = F.concat(F.when(gone, "Source note deleted: ").otherwise("Source note modified since last sync: "), path)
    return _items(rows, hashes.short(F.concat(F.lit("stale:"), path), 16), "stale_content", TIERS["quick_fix"], F.when(gone, 0.95).otherwise(0.9), source=path, message=message)


def batched(items: DataFrame, size: int = 10) -> DataFrame:
    """cluster_id: the slug, or for items without one their kind and the number of their batch of ``size``, by id."""
    number = F.floor((F.col("__number") - 1) / size).cast("string")
    bare = numbered(items.where("slug is null"), ["id"], "__number", ["kind"])
    bare = bare.withColumn("cluster_id", F.concat_ws(":", "kind", number)).drop("__number")
    return items.where("slug is not null").withColumn("cluster_id", F.col("slug")).unionByName(bare)


def queue(items: DataFrame, limit: int | None = None, cluster: str | None = None) -> DataFrame:
    """Open items by tier and age; the filter stands before the limit."""
    rows = items.where("status = 'open'")
    rows = rows if cluster is None else rows.where(F.col("cluster_id") == cluster)
    rows = rows.orderBy("tier", "first_seen", "id")
    return rows if limit is None else rows.limit(limit)


def scores(items: DataFrame, by: str | None = None) -> DataFrame:
    """overall = fixed / (fixed + open), strict = fixed / all; 1 where there is nothing to divide by."""
    fixed, open_ = F.count_if(F.col("status") == "fixed"), F.count_if(F.col("status").isin("open", "in_progress"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    grouped = items.groupBy(by) if by else items.groupBy()
    return grouped.agg(F.count("*").alias("total"), fixed.alias("fixed"), open_.alias("open"), ratio(fixed, fixed + open_).alias("overall"), ratio(fixed, F.count("*")).alias("strict"))


def moved(items: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``items`` with the statuses of (id, to, attestation) rows whose change is allowed; resolved_at follows."""
    allowed = reduce(lambda a, b: a | b, [(F.col("status") == x) & (F.col("to") == y) for x, y in sorted(TRANSITIONS)])
    rows = items.join(changes.select("id", "to", F.col("attestation").alias("__attestation")), "id", "left")
    ok = F.coalesce(allowed, F.lit(False))
    done = F.col("to").isin(*RESOLVED)
    new = {
        "resolved_at": F.when(ok, F.when(done, now)).otherwise(F.col("resolved_at")),
        "attestation": F.when(ok, F.col("__attestation")).otherwise(F.col("attestation")),
        "status": F.when(ok, F.col("to")).otherwise(F.col("status")),
    }
    return rows.withColumns(new).select(*items.columns)


def reconciled(stored: DataFrame, detected: DataFrame, kinds: list[str], now: Column) -> DataFrame:
    """Stored items after a scan: open ones of the scanned loop kinds that were not seen again are fixed; new ones are
    put in; ones seen again are refreshed but keep their status, first time and resolution."""
    seen = detected.select("id").distinct().withColumn("__seen", F.lit(True))
    rows = stored.join(seen, "id", "left")
    gone = F.col("__seen").isNull() & (F.col("status") == "open") & F.col("loop_kind").isin(*kinds)
    kept = rows.withColumns({"resolved_at": F.when(gone, now).otherwise(F.col("resolved_at")), "attestation": F.when(gone, F.lit("not detected again")).otherwise(F.col("attestation")), "status": F.when(gone, "fixed").otherwise(F.col("status"))}).select(*stored.columns)
    fresh = [c for c in detected.columns if c in stored.columns and c not in ("id", "status", "first_seen", "resolved_at", "attestation")]
    update = detected.dropDuplicates(["id"]).select("id", *[F.col(c).alias(f"__{c}") for c in fresh])
    kept = kept.join(update, "id", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in fresh}).select(*stored.columns)
    new = detected.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")
    blank = {c: F.lit(None).cast(stored.schema[c].dataType) for c in stored.columns if c not in detected.columns}
    return kept.unionByName(new.withColumns(blank | {"first_seen": now}).select(*stored.columns))


def by_prefix(items: DataFrame, prefix: str) -> DataFrame:
    """The one item whose id starts with ``prefix``, or none if several do."""
    some = items.where(F.startswith("id", F.lit(prefix))).limit(2)
    return some.withColumn("__n", F.count("*").over(W.partitionBy(F.lit(1)))).where("__n = 1").drop("__n")
