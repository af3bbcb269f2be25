"""What callers ask for, with the defaults of the services: search and analytics over a dictionary of logical tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.operators import duplicates, filters, graph, search, topics
from recallgrid.operators.filters import Filters, SearchRequest


class Analytics:
    """Topic and duplicate reports. ``tables`` has topics, note_topics, notes, cards and card_stats."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.t = tables

    def tree(self, root: str | None = None) -> list[dict]:
        """The taxonomy, which a caller reads as a whole, nested."""
        return topics.nested(topics.tree_rows(self.t["topics"], root).collect(), root)

    def covered_tree(self, root: str | None = None) -> list[dict]:
        """The nested taxonomy with each node's coverage counts."""
        found = topics.coverage(self.t["topics"], self.t["note_topics"], self.t["cards"], self.t["card_stats"], True)
        return topics.nested(topics.covered_tree(found, root).collect(), root)

    def _known(self, path: str) -> bool:
        return not self.t["topics"].where(F.col("path") == path).isEmpty()

    def coverage(self, path: str, subtree: bool = True) -> dict | None:
        """One topic's coverage; None if it isn't known."""
        found = topics.coverage(self.t["topics"], self.t["note_topics"], self.t["cards"], self.t["card_stats"], subtree)
        row = found.where(F.col("path") == path).first()
        return row.asDict() if row else None

    def gaps(self, path: str, least: int = 1) -> DataFrame:
        if not self._known(path):
            raise KeyError(path)
        return topics.gaps(self.t["topics"], self.t["note_topics"], path, least)

    def weak_notes(self, path: str, limit: int = 20) -> DataFrame:
        if not self._known(path):
            raise KeyError(path)
        return topics.weak_notes(self.t["notes"], self.t["note_topics"], self.t["topics"], self.t["cards"], self.t["card_stats"], path, limit)

    def duplicates(self, pairs: DataFrame, threshold: float = 0.92, most: int = 50, decks: tuple[str, ...] = (), tags: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
        """(clusters, stats) of pairs (a, b, similarity). Decks and tags restrict the neighbours b, not the notes a."""
        if not 0 <= threshold <= 1 or most <= 0:
            raise ValueError("threshold must be from 0 to 1, most positive")
        active = self.t["notes"].where(~F.col("deleted"))
        if decks or tags:
            kept = filters.filtered(self.t["notes"], self.t["cards"], Filters(decks=decks, tags=tags))
            pairs = pairs.join(kept.select(F.col("note_id").alias("b")), "b", "left_semi")
        members = duplicates.clusters(pairs, filters.review_counts(self.t["cards"]), threshold, active)
        shown = duplicates.listed(members, active, most)
        return shown, duplicates.stats(shown, active)

    def label(self, similarities: DataFrame, least: float = 0.6, most: int = 5) -> DataFrame:
        return topics.labels(similarities, least, most)

    def related(self, edges: DataFrame, note: int, limit: int = 10) -> DataFrame:
        return graph.related(edges, note, limit)


class Search:
    """Note and chunk search. ``chunks`` has note_id, chunk_id, vector and the payload columns of the filters."""

    def __init__(self, notes: DataFrame, cards: DataFrame, chunks: DataFrame, embed: Callable[[str], list[float]], scorer: Callable[[str], Callable[[Column], Column]] | None = None) -> None:
        self.notes, self.cards, self.chunks, self.embed, self.scorer = notes, cards, chunks, embed, scorer

    def chunk_hits(self, query: str, limit: int = 50, f: Filters = Filters()) -> DataFrame:  # noqa: B008
        """The nearest chunks of those that pass the payload form of the filters, the best first."""
        if not query.strip():
            return self.chunks.select("note_id", "chunk_id", F.lit(0.0).alias("score")).limit(0)
        some = self.chunks.where(filters.payload_predicate(filters.translated(f)))
        numbered = some.withColumn("id", F.xxhash64("chunk_id"))
        q = self.chunks.sparkSession.createDataFrame([(-1, [float(x) for x in self.embed(query)])], "query_id long, vector array<double>")
        near = search.nearest(q, numbered, limit).select("id", "score")
        return numbered.join(near, "id").select("note_id", "chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(limit)

    def search(self, request: SearchRequest) -> tuple[DataFrame, DataFrame]:
        """(results, stats): four times as many chunks as results are fetched, so that notes with several don't crowd others out."""
        active = filters.filtered(self.notes, self.cards, request.filters)
        hits = self.chunk_hits(request.query if request.mode != "lexical" else "", request.limit * 4, request.filters)
        return search.hybrid(request, active, hits, self.scorer(request.query) if self.scorer and request.rerank_top else None)


def union(items: list[DataFrame]) -> DataFrame:
    """All scanners' items together."""
    return reduce(DataFrame.unionByName, items)
