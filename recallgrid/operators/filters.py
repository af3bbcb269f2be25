"""Filters of searches: the relational form over notes and cards, and the form over a vector's payload.

The two differ on purpose and never share code: relational card predicates must hold on one card, and deck exclusion
keeps a note with any card elsewhere; payload predicates use a note's aggregates, and deck exclusion drops a note with any
excluded deck.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.operators.topics import MATURE


@dataclass(frozen=True)
class Filters:
    tags: tuple[str, ...] = ()
    tags_exclude: tuple[str, ...] = ()
    decks: tuple[str, ...] = ()
    decks_exclude: tuple[str, ...] = ()
    model_ids: tuple[int, ...] = ()
    min_ivl: int | None = None
    max_lapses: int | None = None
    min_reps: int | None = None

    def normalized(self) -> Filters:
        """Names trimmed, blank ones dropped."""
        clean = lambda xs: tuple(x.strip() for x in xs if x.strip())
        return Filters(clean(self.tags), clean(self.tags_exclude), clean(self.decks), clean(self.decks_exclude), self.model_ids, self.min_ivl, self.max_lapses, self.min_reps)


@dataclass(frozen=True)
class SearchRequest:
    """A validated search. Modes: hybrid, semantic, lexical."""

    query: str
    mode: str = "hybrid"
    limit: int = 50
    semantic_weight: float = 1.0
    lexical_weight: float = 1.0
    rerank_top: int | None = None
    filters: Filters = field(default_factory=Filters)

    def __post_init__(self) -> None:
        if self.limit <= 0:
            raise ValueError("limit must be positive")
        if self.semantic_weight < 0 or self.lexical_weight < 0:
            raise ValueError("weights must not be negative")
        if self.rerank_top is not None and self.rerank_top <= 0:
            raise ValueError("rerank_top must be positive")
        if self.mode not in {"hybrid", "semantic", "lexical"}:
            raise ValueError(f"unknown mode: {self.mode}")


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _array(values: tuple) -> Column:
    return F.array(*[F.lit(v) for v in values])


def needs_cards(f: Filters) -> bool:
    return bool(f.decks or f.decks_exclude or f.min_ivl is not None or f.max_lapses is not None or f.min_reps is not None)


def note_predicate(f: Filters) -> Column:
    """On notes alone; a null tag list satisfies neither tag filter."""
    parts = []
    if f.tags:
        parts.append(F.arrays_overlap("tags", _array(f.tags)))
    if f.tags_exclude:
        parts.append(~F.arrays_overlap("tags", _array(f.tags_exclude)))
    if f.model_ids:
        parts.append(F.col("model_id").isin(*f.model_ids))
    return _all(parts)


def card_predicate(f: Filters) -> Column:
    """On one card: all its conditions must hold on the same one."""
    parts = []
    if f.decks:
        parts.append(F.col("deck").isin(*f.decks))
    if f.decks_exclude:
        parts.append(~F.col("deck").isin(*f.decks_exclude))
    if f.min_ivl is not None:
        parts.append(F.col("ivl") >= f.min_ivl)
    if f.max_lapses is not None:
        parts.append(F.col("lapses") <= f.max_lapses)
    if f.min_reps is not None:
        parts.append(F.col("reps") >= f.min_reps)
    return _all(parts)


def filtered(notes: DataFrame, cards: DataFrame, f: Filters) -> DataFrame:
    """Active notes that pass; cards are joined only if a filter needs them, and never multiply notes."""
    f = f.normalized()
    out = notes.where(~F.col("deleted")).where(note_predicate(f))
    return out.join(cards.where(card_predicate(f)).select("note_id"), "note_id", "left_semi") if needs_cards(f) else out


@dataclass(frozen=True)
class PayloadFilters:
    decks: tuple[str, ...] = ()
    decks_exclude: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    tags_exclude: tuple[str, ...] = ()
    model_ids: tuple[int, ...] = ()
    mature_only: bool = False
    max_lapses: int | None = None
    min_reps: int | None = None


def translated(f: Filters) -> PayloadFilters:
    """A relational filter for a payload: an interval below maturity can't be expressed there and is dropped."""
    f = f.normalized()
    mature = f.min_ivl is not None and f.min_ivl >= MATURE
    return PayloadFilters(f.decks, f.decks_exclude, f.tags, f.tags_exclude, f.model_ids, mature, f.max_lapses, f.min_reps)


def payload_predicate(f: PayloadFilters) -> Column:
    """On payload columns deck_names, tags, model_id, mature, lapses, reps."""
    parts = []
    if f.decks:
        parts.append(F.arrays_overlap("deck_names", _array(f.decks)))
    if f.tags:
        parts.append(F.arrays_overlap("tags", _array(f.tags)))
    if f.model_ids:
        parts.append(F.col("model_id").isin(*f.model_ids))
    if f.mature_only:
        parts.append(F.col("mature"))
    if f.min_reps is not None:
        parts.append(F.col("reps") >= f.min_reps)
    if f.max_lapses is not None:
        parts.append(F.col("lapses") <= f.max_lapses)
    if f.decks_exclude:
        parts.append(~F.arrays_overlap("deck_names", _array(f.decks_exclude)))
    if f.tags_exclude:
        parts.append(~F.arrays_overlap("tags", _array(f.tags_exclude)))
    return _all(parts)


def note_details(notes: DataFrame, cards: DataFrame, card_stats: DataFrame | None = None) -> DataFrame:
    """Deck names, maturity and worst lapses and reps of each note: search details, and the payload of an index."""
    rows = cards if card_stats is None else cards.join(card_stats.select("card_id", "fail_rate"), "card_id", "left")
    aggregates = [F.array_sort(F.collect_set("deck")).alias("deck_names"), F.bool_or(F.col("ivl") >= MATURE).alias("mature"), F.max("lapses").alias("lapses"), F.max("reps").alias("reps")]
    if card_stats is not None:
        aggregates.append(F.max("fail_rate").alias("fail_rate"))
    out = notes.join(rows.groupBy("note_id").agg(*aggregates), "note_id", "left")
    zeros = {"mature": F.coalesce("mature", F.lit(False)), "lapses": F.coalesce("lapses", F.lit(0)), "reps": F.coalesce("reps", F.lit(0))}
    return out.withColumns(zeros | {"deck_names": F.coalesce("deck_names", F.array().cast("array<string>")), "tags": F.coalesce("tags", F.array().cast("array<string>"))})


def excerpts(notes: DataFrame, length: int = 200) -> DataFrame:
    return notes.select("note_id", F.left("text", F.lit(length)).alias("excerpt"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def review_counts(cards: DataFrame) -> DataFrame:
    return cards.groupBy("note_id").agg(F.coalesce(F.sum("reps"), F.lit(0)).alias("total_reps"))
