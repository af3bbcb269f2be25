"""The card registry: scans, counts, derived values of cards, their validation, mappings, metadata and progress."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions import hashes
from recallgrid.functions.text import trimmed
from recallgrid.tables import inserted, upserted

#: Languages and note types that a card may have.
LANGS = ("en", "ru", "de", "fr", "es", "it", "pt", "zh", "ja", "ko")
NOTE_TYPES = ("APF::Simple", "APF::Cloze", "Basic", "Cloze", "ImageOcclusion")
#: The kinds of issues and the fields that each must have, S a string, F a number, U a whole number of 32 bits.
ISSUE_KINDS = {
    "low_quality": {"dimension": "S", "score": "F"},
    "validation_error": {"severity": "S", "message": "S"},
    "duplicate": {"other_slug": "S", "similarity": "F"},
    "semantic_overlap": {"other_slug": "S", "similarity": "F"},
    "split_candidate": {"suggested_count": "U"},
    "stale_content": {},
    "dead_skill": {},
    "missing_tags": {},
    "uncovered_topic": {"topic": "S"},
    "missing_language": {"expected": "S"},
}
ISSUE_FIELDS = {name: kind for fields in ISSUE_KINDS.values() for name, kind in fields.items()}
FIELD_TYPES = {"S": "string", "F": "double", "U": "long"}


def find_cards(cards: DataFrame, note_id: str | None = None, source_path: str | None = None, content_hash: str | None = None) -> DataFrame:
    """Cards that equal each value that is given; the tests are pushed to the scan."""
    for column, value in (("note_id", note_id), ("source_path", source_path), ("content_hash", content_hash)):
        cards = cards if value is None else cards.where(F.col(column) == value)
    return cards


def _one_each(cards: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of ``cards`` with the columns of ``stored``; of those that share a slug that which sorts first."""
    order = F.to_json(F.struct(*[c for c in stored.columns if c != "slug"]))
    rows = cards.select(*stored.columns).where("slug is not null")
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("slug").orderBy(order))).where("__n = 1").drop("__n")


def added(stored: DataFrame, cards: DataFrame, now: Column) -> DataFrame:
    """The registry with those cards whose slug it doesn't have; times of creation and change default to ``now``."""
    dated = cards.withColumns({c: F.coalesce(c, now) for c in ("created_at", "updated_at")})
    return inserted(stored, _one_each(dated, stored), ["slug"])


def updated(stored: DataFrame, cards: DataFrame, now: Column) -> DataFrame:
    """The registry with all columns of known cards but the time of creation as given, changed ``now``; unknown ones are left out."""
    known = _one_each(cards.withColumn("updated_at", now), stored).join(stored.select("slug"), "slug", "left_semi")
    return upserted(stored, known, ["slug"], keep=("created_at",))


def deleted(stored: DataFrame, slugs: DataFrame) -> DataFrame:
    return stored.join(slugs, "slug", "left_anti")


def mapped(stored: DataFrame, notes: DataFrame, cards: DataFrame, now: Column) -> DataFrame:
    """The registry with the cards of ``notes`` (note_id) replaced by ``cards``: theirs go, then new ones are added, but
    for slugs that a card of another note has."""
    return added(stored.join(notes.select("note_id").distinct(), "note_id", "left_anti").select(*stored.columns), cards, now)


def counts(cards: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row: cards, notes that they come from, mappings that are synced, those that aren't."""
    own = cards.agg(F.count("*").alias("cards"), F.countDistinct("note_id").alias("notes"))
    done = mappings.agg(F.count_if(is_synced()).alias("synced"), F.count_if(~is_synced()).alias("unsynced"))
    return own.crossJoin(done)


def is_synced() -> Column:
    """A mapping is synced once its note in the collection is known."""
    return F.col("remote_note_id").isNotNull()


def derived(cards: DataFrame) -> DataFrame:
    """Cards with guid, content_hash, anchor and is_new, from slug, source_path, front, back and remote_note_id."""
    slug, source = F.col("slug"), F.col("source_path")
    return cards.withColumns(
        {
            "guid": hashes.guid(slug, source),
            "content_hash": hashes.content_hash(F.col("front"), F.col("back")),
            "anchor": F.concat(source, F.lit("#"), slug),
            "is_new": F.col("remote_note_id").isNull(),
        }
    )


def _errors(*found: tuple[Column, Column | str]) -> Column:
    """An array of the messages whose condition holds, in order; a null condition doesn't."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(x) if isinstance(x, str) else x) for condition, x in found]))


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name) == "", F.lit(True))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _quoted(*parts: Column | str) -> Column:
    """The parts one after another and a quote; strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("'"))


def _language_error(name: str) -> tuple[Column, Column]:
    known = F.coalesce(F.col(name).isin(*LANGS), F.lit(False))
    return ~known, _quoted(f"{name} must be a valid 2-letter language code, got '", _text(name))


def manifest_errors() -> Column:
    """Everything that keeps a manifest from being made of its columns, in order; hash6 and difficulty may be null.

    A null among the others counts as empty.
    """
    difficulty = F.col("difficulty").cast("double")
    return _errors(
        *((_empty(name), f"{name} must not be empty") for name in ("slug", "slug_base")),
        _language_error("lang"),
        *((_empty(name), f"{name} must not be empty") for name in ("source_path", "source_anchor", "note_id", "note_title")),
        (~F.col("hash6").rlike("^[0-9A-Fa-f]{6}$"), _quoted("hash6 must be exactly 6 hex chars, got '", _text("hash6"))),
        (~difficulty.between(0.0, 1.0), F.concat(F.lit("difficulty must be in [0.0, 1.0], got "), F.regexp_replace(difficulty.cast("string"), r"\.0$", ""))),
    )


def card_errors() -> Column:
    """Everything that keeps a card from being made of slug, language, apf_html, note_type, tags and its manifest's
    manifest_slug and manifest_lang, in order. Lengths are in bytes; a null counts as empty."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    found = _errors(
        (_empty("slug"), "slug must not be empty"),
        (~_empty("slug") & (F.octet_length("slug") < 3), _quoted("slug must be at least 3 chars, got '", _text("slug"))),
        _language_error("language"),
        (F.octet_length(trimmed(_text("apf_html"))) < 10, "apf_html must be at least 10 chars after trim"),
        (~F.coalesce(F.col("note_type").isin(*NOTE_TYPES), F.lit(False)), _quoted(f"note_type must be one of {json.dumps(NOTE_TYPES)}, got '", _text("note_type"))),
        (_text("manifest_slug") != _text("slug"), _quoted("slug mismatch: card slug '", _text("slug"), "' != manifest slug '", _text("manifest_slug"))),
        (_text("manifest_lang") != _text("language"), _quoted("language mismatch: card language '", _text("language"), "' != manifest lang '", _text("manifest_lang"))),
    )
    bare = F.transform(tags, lambda t, i: F.when(F.coalesce(t == "", F.lit(True)), F.concat(F.lit("tag at index "), i.cast("string"), F.lit(" must not be empty"))))
    return F.concat(found, F.array_compact(bare))


def action_errors() -> Column:
    """What keeps a sync action (action_type, anki_guid) from being made."""
    return _errors((F.col("action_type").isin("update", "delete") & F.col("anki_guid").isNull(), "anki_guid is required for UPDATE/DELETE actions"))


def described() -> Column:
    """An action in words: its type in capitals, the slug and, if there is one, the reason."""
    reason = F.when(F.col("reason").isNotNull(), F.concat(F.lit(" ("), "reason", F.lit(")"))).otherwise("")
    return F.concat(F.upper("action_type"), F.lit(": "), "slug", reason)


def constructor_issues(cards: DataFrame, key: str = "slug") -> DataFrame:
    """(key, at, message): the errors of each card that can't be made, in order.

    A card is made after its manifest, so its own errors show only if the manifest has none.
    """
    manifest = manifest_errors()
    every = F.when(F.size(manifest) > 0, manifest).otherwise(card_errors())
    return cards.select(key, F.posexplode(every).alias("at", "message"))


def parsed_kinds(items: DataFrame, column: str = "issue_kind") -> DataFrame:
    """Stored items with their kind and its fields read from JSON.

    A text that isn't an object of one of the kinds with all the fields of that kind, each of its type, is stale content;
    so is a null. Other fields of an object are ignored.
    """
    own = F.try_parse_json(F.col(column))
    kind_of = lambda name: F.schema_of_variant(F.try_variant_get(own, f"$.{name}", "variant"))
    value = lambda name: F.try_variant_get(own, f"$.{name}", FIELD_TYPES[ISSUE_FIELDS.get(name, "S")])

    def good(name: str) -> Column:
        kind = ISSUE_FIELDS.get(name, "S")
        if kind == "U":
            return (kind_of(name) == "BIGINT") & value(name).between(0, (1 << 32) - 1)
        return kind_of(name) == "STRING" if kind == "S" else kind_of(name).rlike("^(BIGINT|DOUBLE|DECIMAL)")

    name = F.when(good("kind"), value("kind"))
    whole = [(name == kind) & reduce(lambda a, b: a & b, map(good, fields), F.lit(True)) for kind, fields in ISSUE_KINDS.items()]
    of = lambda f: F.col("__kind").isin(*[k for k, fields in ISSUE_KINDS.items() if f in fields])
    rows = items.withColumn("__kind", F.when(reduce(lambda a, b: a | b, [F.coalesce(w, F.lit(False)) for w in whole]), name).otherwise("stale_content"))
    return rows.withColumns({f: F.when(of(f), value(f)) for f in ISSUE_FIELDS}).withColumn("kind", F.col("__kind")).drop("__kind")


def metadata_put(stored: DataFrame, values: dict[str, object]) -> DataFrame:
    """(key, value) rows with JSON values put in by key."""
    rows = [(k, json.dumps(v, sort_keys=True)) for k, v in values.items()]
    return upserted(stored, stored.sparkSession.createDataFrame(rows, "key string, value string"), ["key"])


def append_progress(events: DataFrame, path: str) -> None:
    """Adds events to a log of JSON lines; earlier ones are never rewritten."""
    events.write.mode("append").json(path)


def progress(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
