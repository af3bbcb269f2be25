"""Lexical, vector and hybrid search over notes and chunks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions import text as tx
from recallgrid.functions.vectors import tokens
from recallgrid.operators.filters import SearchRequest
from recallgrid.operators.neighbours import nearest
from recallgrid.operators.sparse_index import best_documents
from recallgrid.operators.word_index import STOP, best_notes
from recallgrid.tables import discard, written

RRF_K = 60
#: Pairs of a query and a note that may be broadcast to the texts.
BROADCAST_ROWS = 500_000
FUZZY = 0.1


def stem(word: Column) -> Column:
    """A light English stem: plural and participle endings of longer words are cut. Not the stemmer of a database."""
    cut = F.regexp_replace(word, "(?:ies)$", "y")
    cut = F.regexp_replace(cut, "(?<=..)(?:sses)$", "ss")
    cut = F.regexp_replace(cut, "(?<=...)(?:ing|edly|ed|ly)$", "")
    return F.regexp_replace(cut, "(?<=..[^su])s$", "")


def stems(text: Column) -> Column:
    return F.transform(F.filter(tokens(text), lambda w: ~w.isin(*STOP)), stem)


def full_text(notes: DataFrame, query: str, limit: int) -> DataFrame:
    """Notes with all stems of the query; rank is the share of the note's stems that match, damped by its length."""
    own = stems(F.lit(query))
    rows = notes.withColumn("stems", stems(F.col("text"))).where((F.size(own) > 0) & F.forall(own, lambda q: F.array_contains("stems", q)))
    hits = F.size(F.filter("stems", lambda s: F.array_contains(own, s)))
    rank = hits / (1 + F.log(1 + F.size("stems").cast("double")))
    words = [w for w in query.split() if w.isalnum() and w.lower() not in STOP]
    out = rows.select("note_id", rank.alias("rank"), tx.headline(F.col("text"), words).alias("headline"))
    return out.orderBy(F.desc("rank"), "note_id").limit(limit)


def fuzzy(notes: DataFrame, query: str, limit: int) -> DataFrame:
    rows = notes.select("note_id", tx.trigram_similarity(F.col("text"), F.lit(query)).alias("rank"), F.lit(None).cast("string").alias("headline"))
    return rows.where(F.col("rank") > FUZZY).orderBy(F.desc("rank"), "note_id").limit(limit)


def autocomplete(notes: DataFrame, query: str, limit: int, raw_like: bool = False) -> DataFrame:
    """Notes that start with the query; with ``raw_like`` its % and _ are wildcards."""
    match = F.col("text").ilike(query + "%") if raw_like else F.startswith(F.lower("text"), F.lower(F.lit(query)))
    return notes.where(match).select("note_id", F.lit(1.0).alias("rank"), F.lit(None).cast("string").alias("headline")).orderBy("note_id").limit(limit)


def lexical(notes: DataFrame, query: str, limit: int = 50) -> tuple[str, DataFrame]:
    """(mode, results) of the first stage with a result: fts, fuzzy, autocomplete; none for a blank query."""
    nothing = notes.select("note_id", F.lit(0.0).alias("rank"), F.lit(None).cast("string").alias("headline")).limit(0)
    if not query.strip():
        return "none", nothing
    for mode, stage in (("fts", full_text), ("fuzzy", fuzzy), ("autocomplete", autocomplete)):
        found = written(stage(notes, query, limit))  # a few rows, read for the answer and by what follows
        if not found.isEmpty():
            return mode, found
        discard(found)
    return "none", nothing


def full_text_each(notes: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, note_id, rank): ``full_text`` of each of a stated set of queries (query_id, query), from blocks of postings.

    Texts become postings where they are, and a query's notes are looked for in the tasks that hold a block of them: no
    posting and no candidate is shuffled.
    """
    return best_notes(notes, queries, limit)


def fused_each(lists: list[DataFrame], k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): reciprocal rank fusion of lists (query_id, id, rank), with the best ``limit`` of each query."""
    parts = [x.select("query_id", "id", (1 / (k + F.col("rank"))).alias("part")) for x in lists]
    rows = reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def chunk_search(dense_queries: DataFrame, vectors: DataFrame, sparse_queries: DataFrame, sparse: DataFrame, n_chunks: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """Chunks of each query by dense and by sparse vectors, three times ``limit`` of each, fused by their ranks.

    ``dense_queries`` (query_id, vector) and ``vectors`` (id, vector); ``sparse_queries`` (query_id, idx, weight) and
    ``sparse`` (id, idx, weight) with arrays, whose filters are the caller's; a query without a sparse vector is a dense
    one. A query doesn't find its own id.
    """
    most = 3 * limit
    return fused_each([nearest(dense_queries, vectors, most), best_documents(sparse_queries, sparse, n_chunks, most)], k, limit)


def best_chunks(hits: DataFrame) -> DataFrame:
    """The best chunk of each note among (note_id, chunk_id, score, ...) rows."""
    best = hits.groupBy("note_id").agg(F.max_by(F.struct(*hits.columns), F.struct("score", "chunk_id")).alias("best"))
    return best.select("best.*")


def ranked(hits: DataFrame, score: str, limit: int) -> DataFrame:
    """The first ``limit`` notes by score with their rank from 1."""
    top = hits.orderBy(F.desc(score), "note_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), "note_id")))


def fused(semantic: DataFrame, lexical_hits: DataFrame, semantic_weight: float = 1.0, lexical_weight: float = 1.0, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (note_id, rank, score) and (note_id, rank, score, headline) lists."""
    s = semantic.select("note_id", F.col("rank").alias("semantic_rank"), F.col("score").alias("semantic_score"))
    t = lexical_hits.select("note_id", F.col("rank").alias("fts_rank"), F.col("score").alias("fts_score"), "headline")
    rows = s.join(t, "note_id", "full_outer")
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (k + F.col(rank)), F.lit(0.0))
    sources = F.array_compact(F.array(F.when(F.col("semantic_rank").isNotNull(), "semantic"), F.when(F.col("fts_rank").isNotNull(), "fts")))
    return rows.withColumns({"rrf_score": part(semantic_weight, "semantic_rank") + part(lexical_weight, "fts_rank"), "sources": sources})


def fusion_stats(rows: DataFrame) -> DataFrame:
    s, t = F.col("semantic_rank").isNotNull(), F.col("fts_rank").isNotNull()
    return rows.agg(F.count_if(s & ~t).alias("semantic_only"), F.count_if(t & ~s).alias("fts_only"), F.count_if(s & t).alias("both"), F.count("*").alias("total"))


def reranked(rows: DataFrame, texts: DataFrame, scorer: Callable[[Column], Column], top: int) -> DataFrame:
    """The first ``top`` rows scored on their text, else their headline, and put first; the others keep their order."""
    head = rows.orderBy(F.desc("rrf_score"), "note_id").limit(top).join(texts.select("note_id", "text"), "note_id", "left")
    document = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.nullif(F.trim("headline"), F.lit("")))
    scores = head.select("note_id", F.when(document.isNotNull(), scorer(document)).alias("rerank_score"))
    return rows.join(scores, "note_id", "left").orderBy(F.desc_nulls_last("rerank_score"), F.desc("rrf_score"), "note_id")


def hybrid(request: SearchRequest, notes: DataFrame, chunk_hits: DataFrame, scorer: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, stats) of a search; ``chunk_hits`` are (note_id, chunk_id, score) rows of the vector side, limited there.

    A mode other than hybrid takes the other side's weight as 0 and leaves its list out. Stats count before the limit.
    """
    _, found = lexical(notes, request.query if request.mode != "semantic" else "", request.limit)
    lex = found.withColumn("score", F.col("rank")).drop("rank")
    lex = ranked(lex, "score", request.limit)
    hits = chunk_hits.join(notes.select("note_id"), "note_id", "left_semi") if request.mode != "lexical" else chunk_hits.limit(0)
    sem = ranked(best_chunks(hits), "score", request.limit)
    rows = fused(sem, lex, request.semantic_weight, request.lexical_weight)
    rows = rows.join(sem.select("note_id", "chunk_id"), "note_id", "left")
    stats = fusion_stats(rows)
    if scorer and request.rerank_top:
        rows = reranked(rows, notes, scorer, request.rerank_top)
    else:
        rows = rows.orderBy(F.desc("rrf_score"), "note_id")
    return rows.limit(request.limit), stats


def hybrid_each(queries: DataFrame, notes: DataFrame, chunk_hits: DataFrame, lexical_hits: DataFrame, limit: int = 50, mode: str = "hybrid", semantic_weight: float = 1.0, lexical_weight: float = 1.0, scorer: Callable[[Column, Column], Column] | None = None, rerank_top: int | None = None, k: int = RRF_K) -> DataFrame:
    """The first ``limit`` notes of each query by both sides: (query_id, note_id, rank, rrf_score, semantic_rank,
    semantic_score, lexical_rank, lexical_score, lexical_mode, sources, rerank_score, and the columns of the best chunk).

    ``queries`` (query_id, query); ``chunk_hits`` (query_id, note_id, chunk_id, score, ...) of the vector side, whose best
    chunk stands for a note; ``lexical_hits`` as ``lexicon.lexical_each`` gives them. Each side is cut to ``limit`` notes,
    fused by weighed reciprocal ranks and cut again; a mode of one side leaves the other's list out. A blank query has no
    result on either side, and only notes of ``notes`` are found. With ``scorer`` of (query, text) the first
    ``rerank_top`` of each query are put first by their score, those without a text after the others.
    """
    SearchRequest("q", mode, limit, semantic_weight, lexical_weight, rerank_top)  # checks the values
    asked = queries.where(F.trim("query") != "").select("query_id", "query")
    extra = [c for c in chunk_hits.columns if c not in ("query_id", "note_id", "score")]
    hits = chunk_hits if mode != "lexical" else chunk_hits.limit(0)
    hits = hits.join(asked.select("query_id"), "query_id", "left_semi").join(notes.select("note_id"), "note_id", "left_semi")
    best = hits.groupBy("query_id", "note_id").agg(F.max_by(F.struct("score", *extra), F.struct("score", "chunk_id")).alias("b"))
    place = lambda score: F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), "note_id"))
    semantic = best.select("query_id", "note_id", F.col("b.score").alias("semantic_score"), *[F.col(f"b.{c}").alias(c) for c in extra])
    semantic = semantic.withColumn("semantic_rank", place("semantic_score")).where(F.col("semantic_rank") <= limit)
    words = lexical_hits if mode != "semantic" else lexical_hits.limit(0)
    words = words.where(F.col("rank") <= limit).join(asked.select("query_id"), "query_id", "left_semi")
    words = words.select("query_id", "note_id", F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank"), F.col("mode").alias("lexical_mode"))
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (k + F.col(rank)), F.lit(0.0))
    sources = F.array_compact(F.array(F.when(F.col("semantic_rank").isNotNull(), "semantic"), F.when(F.col("lexical_rank").isNotNull(), "fts")))
    rows = semantic.join(words, ["query_id", "note_id"], "full_outer").withColumns({"rrf_score": part(semantic_weight, "semantic_rank") + part(lexical_weight, "lexical_rank"), "sources": sources})
    rows = rows.withColumn("rank", place("rrf_score")).where(F.col("rank") <= limit)
    score = F.lit(None).cast("double")
    if scorer and rerank_top:
        rows = written(rows)
        wanted = written(rows.where(F.col("rank") <= rerank_top).select("query_id", "note_id").join(asked, "query_id"))
        small = wanted.count() <= BROADCAST_ROWS  # else texts are shuffled, once and without a sort
        texts = notes.select("note_id", "text").join(F.broadcast(wanted) if small else wanted.hint("shuffle_hash"), "note_id")
        scored = texts.where(F.trim("text") != "").select("query_id", "note_id", scorer(F.col("query"), F.col("text")).alias("rerank_score"))
        rows = rows.join(scored, ["query_id", "note_id"], "left")
        again = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank"))
        rows, score = rows.withColumn("again", again), F.col("rerank_score")
        rows = rows.withColumn("rank", F.col("again"))
    return rows.select("query_id", "note_id", "rank", "rrf_score", "semantic_rank", "semantic_score", "lexical_rank", "lexical_score", "lexical_mode", "sources", score.alias("rerank_score"), *extra)
