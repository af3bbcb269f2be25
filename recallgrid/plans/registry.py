"""Queries over the given tables, one per operator or group of operators, with the SQL they must equal.

The modules beside this one hold those of search, text and work items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions import hashes, quality, tags, vectors
from recallgrid.functions import text as tx
from recallgrid.operators import documents, duplicates, filters, graph, neighbours, reports, search, sparse_index, sync, topics, worklist
from recallgrid.plans.base import ORACLES, QUERIES, query
from recallgrid.session import table
from recallgrid.sources import catalog as c
from recallgrid.tables import discard, written

COVERAGE = """
    SELECT t.topic_id, t.path, t.label,
        count(DISTINCT a.note_id) AS note_count,
        (SELECT count(*) FROM topics x WHERE starts_with(x.path, t.path || '/')) AS subtree_count,
        (SELECT count(*) FROM topics x WHERE starts_with(x.path, t.path || '/') AND NOT contains(x.path[length(t.path) + 2:], '/')) AS child_count,
        (SELECT count(*) FROM topics x WHERE starts_with(x.path, t.path || '/') AND NOT contains(x.path[length(t.path) + 2:], '/') AND x.topic_id IN (SELECT topic_id FROM note_topics)) AS covered_children,
        count(DISTINCT CASE WHEN c.ivl >= 21 THEN c.card_id END) AS mature_count,
        (SELECT count(DISTINCT n.note_id) FROM note_topics n JOIN cards c USING (note_id) JOIN card_stats s USING (card_id) WHERE n.topic_id = t.topic_id AND s.fail_rate >= 0.1) AS weak_notes,
        round(coalesce(avg(a.confidence), 0), 6) AS avg_confidence, round(coalesce(avg(c.lapses), 0), 6) AS avg_lapses
    FROM topics t LEFT JOIN (SELECT n.*, p.path FROM note_topics n JOIN topics p USING (topic_id)) a ON {on} LEFT JOIN cards c ON c.note_id = a.note_id
    GROUP BY t.topic_id, t.path, t.label
"""


def _coverage(spark: SparkSession, d: str, subtree: bool) -> DataFrame:
    out = topics.coverage(c.topics(spark, d), c.note_topics(spark, d), c.cards(spark, d), c.card_stats(spark, d), subtree)
    return out.withColumns({x: F.round(x, 6) for x in ("avg_confidence", "avg_lapses")})


@query("agg02_topic_coverage", COVERAGE.format(on="a.path = t.path OR starts_with(a.path, t.path || '/')"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d, True)


@query("agg02_topic_coverage_exact", COVERAGE.format(on="a.path = t.path"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d, False)


@query("agg03_topic_gaps", "SELECT t.topic_id, path, label, CASE WHEN count(n.note_id) = 0 THEN 'missing' ELSE 'undercovered' END AS gap_type, count(n.note_id) AS note_count, 70 AS threshold FROM topics t LEFT JOIN note_topics n USING (topic_id) GROUP BY ALL HAVING count(n.note_id) < 70")
def _(spark: SparkSession, d: str) -> DataFrame:
    return topics.gaps(c.topics(spark, d), c.note_topics(spark, d), least=70)


@query("agg20_gap_counts", "WITH g AS (SELECT t.topic_id, count(n.note_id) AS n FROM topics t LEFT JOIN note_topics n USING (topic_id) GROUP BY 1) SELECT count(*) FILTER (n = 0) AS missing, count(*) FILTER (n BETWEEN 1 AND 69) AS undercovered FROM g")
def _(spark: SparkSession, d: str) -> DataFrame:
    return topics.gap_counts(topics.gaps(c.topics(spark, d), c.note_topics(spark, d), least=70))


@query("agg04_weak_notes", """
    SELECT n.note_id, t.path AS topic_path, round(nt.confidence, 6) AS confidence, sum(k.lapses)::BIGINT AS total_lapses, round(max(s.fail_rate), 6) AS fail_rate, left(n.text, 200) AS preview
    FROM notes n JOIN note_topics nt USING (note_id) JOIN topics t USING (topic_id) JOIN cards k USING (note_id) LEFT JOIN card_stats s USING (card_id)
    WHERE NOT n.deleted AND (t.path = 'ASIA' OR starts_with(t.path, 'ASIA/')) GROUP BY n.note_id, t.path, nt.confidence, n.text HAVING max(s.fail_rate) >= 0.1
    ORDER BY total_lapses DESC, n.note_id, topic_path LIMIT 25""")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = topics.weak_notes(c.notes(spark, d), c.note_topics(spark, d), c.topics(spark, d), c.cards(spark, d), c.card_stats(spark, d), root="ASIA", limit=25)
    return out.withColumns({x: F.round(x, 6) for x in ("confidence", "fail_rate")})


@query("agg08_note_counts", "SELECT t.topic_id, path, label, count(DISTINCT note_id) AS note_count FROM topics t LEFT JOIN note_topics USING (topic_id) GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return topics.note_counts(c.topics(spark, d), c.note_topics(spark, d))


@query("agg09_topic_tree", "SELECT topic_id, path, label, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/', 1) END AS parent, len(string_split(path, '/')) - 1 AS depth FROM topics")
def _(spark: SparkSession, d: str) -> DataFrame:
    return topics.tree_rows(c.topics(spark, d))


@query("agg01_card_stats", """
    SELECT card_id, count(*) AS reviews, round(avg(factor), 6) AS avg_ease, round(avg((ease = 1)::INT), 6) AS fail_rate, max(review_ms) // 1000 AS last_review_s, coalesce(sum(time_ms), 0)::BIGINT AS total_time_ms
    FROM reviews GROUP BY card_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = sync.card_stats(c.reviews(spark, d))
    return out.select("card_id", "reviews", F.round("avg_ease", 6).alias("avg_ease"), F.round("fail_rate", 6).alias("fail_rate"), F.unix_seconds("last_review_at").alias("last_review_s"), "total_time_ms")


@query("agg05_index_rows", """
    SELECT n.note_id, array_to_string(list_sort(list_distinct(list(k.deck) FILTER (k.deck IS NOT NULL))), '|') AS decks, coalesce(bool_or(k.ivl >= 21), false) AS mature, coalesce(max(k.lapses), 0)::INT AS lapses, coalesce(max(k.reps), 0)::INT AS reps, round(max(s.fail_rate), 6) AS fail_rate
    FROM notes n LEFT JOIN cards k USING (note_id) LEFT JOIN card_stats s USING (card_id) GROUP BY n.note_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = filters.note_details(c.notes(spark, d), c.cards(spark, d), c.card_stats(spark, d))
    return out.select("note_id", F.nullif(F.array_join("deck_names", "|"), F.lit("")).alias("decks"), "mature", "lapses", "reps", F.round("fail_rate", 6).alias("fail_rate"))


@query("prj02_excerpts", "SELECT note_id, left(text, 200) AS excerpt, array_to_string(tags, '|') AS tags FROM notes")
def _(spark: SparkSession, d: str) -> DataFrame:
    return filters.excerpts(c.notes(spark, d)).withColumn("tags", F.array_join("tags", "|"))


@query("prj04_review_counts", "SELECT note_id, sum(reps)::BIGINT AS total_reps FROM cards GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return filters.review_counts(c.cards(spark, d))


def _filtered(name: str, where: str, f: filters.Filters) -> None:
    sql = f"SELECT note_id FROM notes n WHERE NOT deleted AND {where}"
    query(name, sql)(lambda spark, d: filters.filtered(c.notes(spark, d), c.cards(spark, d), f).select("note_id"))


_filtered("flt01_tags_any", "list_has_any(tags, ['building', 'tag-3'])", filters.Filters(tags=("building", "tag-3")))
_filtered("flt02_tags_exclude", "NOT list_has_any(tags, ['building'])", filters.Filters(tags_exclude=(" building ",)))
_filtered("flt03_models", "model_id IN (200, 202)", filters.Filters(model_ids=(200, 202)))
_filtered("flt04_decks_any", "EXISTS (SELECT 1 FROM cards k WHERE k.note_id = n.note_id AND deck = '1-URGENT')", filters.Filters(decks=("1-URGENT",)))
_filtered("flt05_decks_exclude", "EXISTS (SELECT 1 FROM cards k WHERE k.note_id = n.note_id AND deck <> '1-URGENT')", filters.Filters(decks_exclude=("1-URGENT",)))
_filtered("flt06_one_card", "EXISTS (SELECT 1 FROM cards k WHERE k.note_id = n.note_id AND ivl >= 30 AND lapses <= 2 AND reps >= 10)", filters.Filters(min_ivl=30, max_lapses=2, min_reps=10))


@query("flt09_payload_filters", """
    WITH p AS (SELECT n.note_id, n.tags, list(k.deck) FILTER (k.deck IS NOT NULL) AS decks, coalesce(bool_or(k.ivl >= 21), false) AS mature, coalesce(max(k.lapses), 0) AS lapses, coalesce(max(k.reps), 0) AS reps FROM notes n LEFT JOIN cards k USING (note_id) GROUP BY ALL)
    SELECT note_id FROM p WHERE mature AND reps >= 10 AND lapses <= 5 AND NOT list_has_any(coalesce(decks, []), ['1-URGENT'])""")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = filters.translated(filters.Filters(min_ivl=30, min_reps=10, max_lapses=5, decks_exclude=("1-URGENT",)))
    return filters.note_details(c.notes(spark, d), c.cards(spark, d)).where(filters.payload_predicate(f)).select("note_id")


@query("vec07_nearest", """
    WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings)
    SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id)::INT AS rank
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY rank <= 20""")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.nearest(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v, 20).withColumn("score", F.round("score", 6))


@query("kg01_similarity_edges", """
    WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) <= 20),
    e AS (SELECT a AS source, b AS target, s FROM p WHERE s BETWEEN 0.3 AND 0.9 UNION ALL SELECT b, a, s FROM p WHERE s BETWEEN 0.3 AND 0.9)
    SELECT source, target, round(max(s), 6) AS weight FROM e GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    pairs = neighbours.nearest(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v, 20).select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("score").alias("similarity"))
    return graph.similarity_edges(pairs, 0.3, 0.9).select("source", "target", F.round("weight", 6).alias("weight"))


SPARSE = """
    t AS (SELECT doc_id, lower(regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g')) AS token FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents)),
    h AS (SELECT doc_id, ('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT AS idx FROM (SELECT doc_id, sha256(token) AS h FROM t WHERE token <> '')),
    w AS (SELECT doc_id, idx, 1 + ln(count(*)) AS w FROM h GROUP BY 1, 2),
    s AS (SELECT doc_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
"""


@query("vec03_sparse_vectors", f"WITH {SPARSE} SELECT doc_id, idx, round(weight, 6) AS weight FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    return vectors.sparse_rows(table(spark, d, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query("vec04_all_sparse_scores", f"""
    WITH {SPARSE}, q AS (SELECT doc_id AS query_id, idx, weight FROM s WHERE doc_id % 20 = 0),
    f AS (SELECT idx, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM s WHERE idx IN (SELECT idx FROM q) GROUP BY 1),
    x AS (SELECT query_id, s.doc_id, sum(s.weight * q.weight * idf) AS score FROM q JOIN f USING (idx) JOIN s USING (idx) GROUP BY 1, 2)
    SELECT query_id, doc_id, round(score, 6) AS score FROM x""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every document that shares a token with a query, for the whole stated set; ``vec04_best_sparse_scores`` has the first of them."""
    docs = table(spark, d, "documents")
    rows = sparse_index.document_vectors(docs, "doc_id", "text")
    found = sparse_index.every_score(rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), rows, docs.agg(F.count("*").alias("n")), 6)
    discard(rows)
    return found.select("query_id", F.col("id").alias("doc_id"), "score")


@query("vec04_best_sparse_scores", f"""
    WITH {SPARSE}, q AS (SELECT doc_id AS query_id, idx, weight FROM s WHERE doc_id % 20 = 0),
    f AS (SELECT idx, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM s WHERE idx IN (SELECT idx FROM q) GROUP BY 1),
    x AS (SELECT query_id, s.doc_id, round(sum(s.weight * q.weight * idf), 9) AS score FROM q JOIN f USING (idx) JOIN s USING (idx) WHERE s.doc_id <> query_id GROUP BY 1, 2)
    SELECT query_id, doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY x.score DESC, doc_id))::INT AS rank FROM x QUALIFY rank <= 60""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The best 60 documents of each query of the whole stated set, from pruned blocks of postings."""
    docs = table(spark, d, "documents")
    rows = written(vectors.sparse_documents(docs, "doc_id", "text").withColumnRenamed("doc_id", "id"))
    best = sparse_index.best_documents(rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), rows, docs.agg(F.count("*").alias("n")), 60)
    rounded = F.expr("(floor(score * 1e6) + CAST(score * 1e6 - floor(score * 1e6) >= 0.5 AS INT)) / 1e6")  # a half by its double, as in the SQL
    return best.select("query_id", F.col("id").alias("doc_id"), rounded.alias("score"), "rank")


@query("fts03_trigrams", """
    WITH g AS (SELECT note_id, list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN [x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') IF x <> '']])) AS g FROM notes WHERE NOT deleted),
    q AS (SELECT list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN ['custmer', '0000', 'bilding']])) AS q),
    s AS (SELECT note_id, len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))) AS r FROM g, q)
    SELECT note_id, round(r, 6) AS rank FROM s WHERE r > 0.1 ORDER BY r DESC, note_id LIMIT 50""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.fuzzy(c.notes(spark, d).where("not deleted"), "custmer 0000 bilding", 50).select("note_id", F.round("rank", 6).alias("rank"))


@query("fts04_autocomplete", "SELECT note_id, 1.0::DOUBLE AS rank FROM notes WHERE NOT deleted AND starts_with(lower(text), 'customer#00000001') ORDER BY note_id LIMIT 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.autocomplete(c.notes(spark, d).where("not deleted"), "Customer#00000001", 50).select("note_id", "rank")


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two ranked lists of notes: by the least fail rate of their cards, and by lapses."""
    k = c.cards(spark, d).join(c.card_stats(spark, d), "card_id").groupBy("note_id").agg(F.min("fail_rate").alias("f"), F.sum("lapses").cast("double").alias("score"))
    s = search.ranked(k.select("note_id", (1 - F.col("f")).alias("score")), "score", 60)
    return s, search.ranked(k.select("note_id", "score", F.lit(None).cast("string").alias("headline")), "score", 60)


LISTS = """
    k AS (SELECT note_id, 1 - min(fail_rate) AS a, sum(lapses) AS b FROM cards JOIN card_stats USING (card_id) GROUP BY 1),
    x AS (SELECT note_id, row_number() OVER (ORDER BY a DESC, note_id) AS r FROM k QUALIFY r <= 60),
    y AS (SELECT note_id, row_number() OVER (ORDER BY b DESC, note_id) AS r FROM k QUALIFY r <= 60)
"""


@query("srch02_rank_fusion", f"WITH {LISTS} SELECT coalesce(x.note_id, y.note_id) AS note_id, round(coalesce(1.0 / (60 + x.r), 0) + coalesce(0.5 / (60 + y.r), 0), 9) AS rrf_score, x.r::INT AS semantic_rank, y.r::INT AS fts_rank FROM x FULL JOIN y USING (note_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.fused(*_lists(spark, d), 1.0, 0.5).select("note_id", F.round("rrf_score", 9).alias("rrf_score"), "semantic_rank", "fts_rank")


@query("agg10_fusion_stats", f"WITH {LISTS} SELECT count(*) FILTER (y.r IS NULL) AS semantic_only, count(*) FILTER (x.r IS NULL) AS fts_only, count(*) FILTER (x.r + y.r IS NOT NULL) AS both, count(*) AS total FROM x FULL JOIN y USING (note_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.fusion_stats(search.fused(*_lists(spark, d)))


@query("agg07_best_chunk", "SELECT l_orderkey AS note_id, arg_max(l_linenumber, (l_extendedprice, l_linenumber)) AS chunk_id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("chunk_id"), F.col("l_extendedprice").alias("score"))
    return search.best_chunks(lines)


def _notes_of_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), "text", F.array("lang", "source").alias("tags"), F.lit(False).alias("deleted"))


CLUSTERS = """
    k AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') AS body FROM documents WHERE text IS NOT NULL),
    g AS (SELECT min(doc_id) AS first, max_by(doc_id, (doc_id % 9, -doc_id)) AS representative, count(*) AS size, list(doc_id) AS ids FROM k GROUP BY body HAVING count(*) > 1)
"""


@query("vec09_duplicate_clusters", f"WITH {CLUSTERS} SELECT representative, size, note_id, 1.0::DOUBLE AS similarity FROM g, unnest(ids) AS u(note_id) WHERE note_id <> representative")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = _notes_of_documents(spark, d)
    return duplicates.clusters(duplicates.exact_pairs(n), n.select("note_id", (F.col("note_id") % 9).alias("total_reps")), notes=n)


@query("agg11_duplicate_stats", f"WITH {CLUSTERS} SELECT count(*) AS clusters, sum(size - 1)::BIGINT AS duplicates, round(avg(size), 6) AS avg_size, (SELECT count(*) FROM documents) AS notes_scanned FROM (SELECT * FROM g ORDER BY size DESC, representative LIMIT 50)")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = _notes_of_documents(spark, d)
    found = duplicates.clusters(duplicates.exact_pairs(n), n.select("note_id", (F.col("note_id") % 9).alias("total_reps")), notes=n)
    return duplicates.stats(duplicates.listed(found, n), n).withColumn("avg_size", F.round("avg_size", 6))


@query("kg02_tag_edges", """
    WITH e AS (SELECT note_id, len(tags) AS n, unnest(tags) AS tag FROM notes WHERE NOT deleted),
    p AS (SELECT a.note_id AS source, b.note_id AS target, count(*) AS shared, count(*) / greatest(a.n, b.n) AS weight FROM e a JOIN e b ON a.tag = b.tag AND a.note_id < b.note_id GROUP BY a.note_id, b.note_id, a.n, b.n)
    SELECT source, target, shared, weight FROM p WHERE shared >= 2 ORDER BY weight DESC, source, target LIMIT 5000""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.tag_edges(c.notes(spark, d), least=2)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Parts lead to suppliers, and suppliers to the next key: a graph with chains and hubs."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 97 + 1).alias("target"), (F.col("l_quantity") / 50).alias("weight"))
    return lines.groupBy("source", "target").agg(F.max("weight").alias("weight")).where("weight > 0.9 and source <> target").withColumns({"edge_type": F.lit("prerequisite"), "edge_source": F.lit("manual")})


EDGES = "e AS (SELECT l_suppkey AS source, l_partkey % 97 + 1 AS target, max(l_quantity / 50) AS weight FROM lineitem GROUP BY 1, 2 HAVING max(l_quantity / 50) > 0.9 AND l_suppkey <> l_partkey % 97 + 1)"


@query("kg03_related", f"WITH {EDGES} SELECT CASE WHEN source = 5 THEN target ELSE source END AS node, 'prerequisite' AS edge_type, weight FROM e WHERE source = 5 OR target = 5 ORDER BY weight DESC, node LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.related(_edges(spark, d), 5, 10)


@query("kg05_prerequisite_chain", f"""RECURSIVE
    WITH {EDGES}, v(node, step) AS (SELECT 5::BIGINT, 0 UNION SELECT e.source, v.step + 1 FROM v JOIN e ON e.target = v.node WHERE v.step < 2),
    m AS (SELECT node, min(step) AS step FROM v GROUP BY 1)
    SELECT e.source, e.target, e.weight, m.step + 1 AS step FROM m JOIN e ON e.target = m.node WHERE m.step < 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.prerequisite_chain(_edges(spark, d), 5, 2)


@query("kg06_neighbourhood", f"""RECURSIVE
    WITH {EDGES}, b AS (SELECT source, target, weight FROM e UNION ALL SELECT target, source, weight FROM e),
    t AS (SELECT source, target FROM b QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) <= 3),
    v(node, hop) AS (SELECT 5::BIGINT, 0 UNION SELECT t.target, v.hop + 1 FROM v JOIN t ON t.source = v.node WHERE v.hop < 3)
    SELECT node, min(hop) AS hop FROM v GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(_edges(spark, d), 5, 3, 3)


PAIRS = "pairs AS (SELECT a.conv_id || '-' || a.turn AS slug, a.text AS front, b.text AS back FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """Cards from conversations: a user turn is the front, the assistant's next one the back."""
    t = table(spark, d, "conversations")
    back = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("back"))
    rows = t.where("role = 'user'").join(back, ["conv_id", "turn"])
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("slug"), F.col("text").alias("front"), "back", F.array().cast("array<string>").alias("tags"))


@query("qlt01_quality_scores", f"""
    WITH {PAIRS}, q AS (SELECT slug, trim(front) AS f, trim(back) AS b, lower(trim(front)) AS l FROM pairs),
    s AS (SELECT slug,
        1 - CASE WHEN regexp_matches(l, 'explain|describe|tell me about|tell about|discuss|elaborate') THEN 0.4 ELSE 0 END
          - CASE WHEN regexp_matches(l, '^(is|does|can|do|are|was|were|has|have|will|would|should|could|did) ') THEN 0.3 ELSE 0 END - CASE WHEN f <> '' AND NOT contains(f, '?') THEN 0.2 ELSE 0 END AS clarity,
        1 - CASE WHEN wf > 30 THEN 0.4 WHEN wf > 20 THEN 0.2 ELSE 0 END - CASE WHEN j >= 2 THEN 0.4 WHEN j = 1 THEN 0.1 ELSE 0 END AS atomicity,
        CASE WHEN b = '' THEN 0 ELSE 1 - CASE WHEN wb > 200 THEN 0.5 WHEN wb > 100 THEN 0.3 ELSE 0 END END AS testability,
        1 - CASE WHEN wb > 150 THEN 0.3 ELSE 0 END AS memorability,
        1 - CASE WHEN f = '' THEN 0.5 ELSE 0 END - CASE WHEN b = '' THEN 0.5 ELSE 0 END - CASE WHEN f <> '' AND NOT contains(f, '?') THEN 0.2 ELSE 0 END AS accuracy,
        0.5 + CASE WHEN contains(l, 'compare') THEN 0.3 ELSE 0 END AS relevance
        FROM (SELECT *, len([x FOR x IN regexp_split_to_array(f, '\\s+') IF x <> '']) AS wf, len([x FOR x IN regexp_split_to_array(b, '\\s+') IF x <> '']) AS wb,
            len([x FOR x IN regexp_split_to_array(l, '[^\\p{{L}}\\p{{N}}]+') IF x IN ('and', 'or')]) AS j FROM q))
    SELECT slug, round(clarity, 6)::DOUBLE AS clarity, round(atomicity, 6)::DOUBLE AS atomicity, round(testability, 6)::DOUBLE AS testability, round(memorability, 6)::DOUBLE AS memorability, round(accuracy, 6)::DOUBLE AS accuracy,
        round(relevance, 6)::DOUBLE AS relevance, round((clarity + atomicity + testability + memorability + accuracy + 1.5 * relevance) / 6.5, 6)::DOUBLE AS overall FROM s""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _registry(spark, d)
    return rows.select("slug", *[F.round(v, 6).alias(k) for k, v in quality.scores(F.col("front"), F.col("back"), F.col("tags")).items()])


@query("val06_card_issues", f"""
    WITH {PAIRS}, i AS (
        SELECT slug, 'warning' AS severity, 'Front side is very short (' || strlen(front) || ' chars)' AS message FROM pairs WHERE trim(front) <> '' AND strlen(front) < 10
        UNION ALL SELECT slug, 'warning', 'Back side is very short (' || strlen(back) || ' chars)' FROM pairs WHERE trim(back) <> '' AND strlen(back) < 10
        UNION ALL SELECT slug, 'error', 'Front side is empty' FROM pairs WHERE trim(front) = '' UNION ALL SELECT slug, 'error', 'Back side is empty' FROM pairs WHERE trim(back) = ''
        UNION ALL SELECT slug, 'warning', 'Front side exceeds 5000 chars (' || strlen(front) || ')' FROM pairs WHERE strlen(front) > 5000
        UNION ALL SELECT slug, 'warning', 'Back side exceeds 5000 chars (' || strlen(back) || ')' FROM pairs WHERE strlen(back) > 5000
        UNION ALL SELECT slug, 'warning', 'Trailing whitespace in front' FROM pairs WHERE regexp_matches(front, '(?m)[ \\t]+$') UNION ALL SELECT slug, 'warning', 'Trailing whitespace in back' FROM pairs WHERE regexp_matches(back, '(?m)[ \\t]+$')
        UNION ALL SELECT slug, 'warning', 'Consecutive blank lines in front' FROM pairs WHERE contains(front, chr(10) || chr(10) || chr(10)) UNION ALL SELECT slug, 'warning', 'Consecutive blank lines in back' FROM pairs WHERE contains(back, chr(10) || chr(10) || chr(10))
        UNION ALL SELECT slug, 'info', 'Card lacks a skill:: tag (skill::alive, skill::dead, or skill::neutral)' FROM pairs)
    SELECT * FROM i""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _registry(spark, d)
    return rows.select("slug", F.explode(quality.card_issues(F.col("front"), F.col("back"), F.col("tags"))).alias("i")).select("slug", "i.severity", "i.message")


def _work(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "fixed").when(F.col("o_orderstatus") == "O", "open").otherwise("in_progress")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("tier"), status.alias("status"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("s"), "o_custkey")).alias("slug"))


WORK = "w AS (SELECT o_orderkey::VARCHAR AS id, o_orderkey % 4 + 1 AS tier, CASE o_orderstatus WHEN 'F' THEN 'fixed' WHEN 'O' THEN 'open' ELSE 'in_progress' END AS status, o_orderdate AS first_seen, o_orderpriority AS kind, CASE WHEN o_orderkey % 3 > 0 THEN 's' || o_custkey END AS slug FROM orders)"


@query("agg15_work_scores", f"WITH {WORK} SELECT tier::INT AS tier, count(*) AS total, count(*) FILTER (status = 'fixed') AS fixed, count(*) FILTER (status <> 'fixed') AS open, round(count(*) FILTER (status = 'fixed') / count(*), 6) AS overall, round(count(*) FILTER (status = 'fixed') / count(*), 6) AS strict FROM w GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return worklist.scores(_work(spark, d), "tier").withColumns({x: F.round(x, 6) for x in ("overall", "strict")})


@query("ord05_queue", f"WITH {WORK} SELECT id, tier::INT AS tier FROM w WHERE status = 'open' ORDER BY tier, first_seen, id LIMIT 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return worklist.queue(_work(spark, d), 100).select("id", "tier")


@query("win05_batches", f"WITH {WORK} SELECT id, coalesce(slug, kind || ':' || ((row_number() OVER (PARTITION BY kind, slug IS NULL ORDER BY id) - 1) // 10)) AS cluster_id FROM w")
def _(spark: SparkSession, d: str) -> DataFrame:
    return worklist.batched(_work(spark, d)).select("id", "cluster_id")


@query("hsh_content_hashes", """
    SELECT doc_id, left(sha256('m' || chr(0) || text), 16) AS parts_hash, left(sha256(text || '|' || lang), 12) AS content_hash, left(sha256(text), 6) AS metadata_hash, left(sha256(text || ':' || lang), 32) AS guid FROM documents""")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", hashes.parts_hash("m", F.array(t)).alias("parts_hash"), hashes.content_hash(t, F.col("lang")).alias("content_hash"), hashes.metadata_hash(t).alias("metadata_hash"), hashes.guid(t, F.col("lang")).alias("guid"))


@query("idx01_changed_chunks", "SELECT doc_id AS note_id, left(sha256('m' || chr(0) || text), 16) AS content_hash FROM documents WHERE doc_id % 3 <> 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = _notes_of_documents(spark, d)
    old = sync.chunks(docs.where("note_id % 3 = 0 or note_id % 3 = 1").withColumn("text", F.when(F.col("note_id") % 3 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))), "m")
    return sync.changed(sync.chunks(docs, "m"), old).select("note_id", "content_hash")


@query("snk04_snapshot_sync", """
    SELECT c_custkey AS note_id, CASE WHEN c_custkey % 3 = 0 THEN 'old ' || c_name ELSE c_name END AS text, c_custkey % 3 = 0 AS gone FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 <> 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("note_id"), F.col("c_name").alias("text"))
    stored = k.where("note_id % 5 <> 0").withColumns({"text": F.concat(F.lit("old "), "text"), "deleted_at": F.lit(None).cast("timestamp")})
    return sync.synced_notes(stored, k.where("note_id % 3 <> 0"), F.lit("2024-01-01").cast("timestamp")).select("note_id", "text", F.col("deleted_at").isNotNull().alias("gone"))


@query("str01_strip_html", """
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<br ?/?>|</?(?:p|div|P|DIV)>|<(?:li|LI)>|&nbsp;', chr(10), 'g'), '<[^>]+>', '', 'g'),
        '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&#x27;', chr(39)), '&nbsp;', ' '), '\\s+', ' ', 'g'), ' ') AS text FROM pages""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query("str04_normalize_whitespace", """
    SELECT doc_id, array_to_string([x FOR x IN [trim(regexp_replace(y, '[ \\t]+', ' ', 'g'), ' ') FOR y IN regexp_split_to_array(text, '\\r?\\n')] IF x <> ''], chr(10)) AS text FROM documents""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.normalize_whitespace(F.col("text")).alias("text"))


@query("tag01_canonical_tags", """
    SELECT n_nationkey, trim(regexp_replace(regexp_replace(lower(n_name), '_|::|/', '-', 'g'), '-{2,}', '-', 'g'), '-') AS tag FROM nation""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", tags.canonical(F.col("n_name")).alias("tag"))


@query("agg19_latency_report", """
    WITH h AS (SELECT event_type, floor(value)::BIGINT AS ms, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2),
    t AS (SELECT event_type, sum(n) AS requests, sum(errors) / sum(n) AS error_rate FROM h GROUP BY 1),
    r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY ms) AS run FROM h)
    SELECT event_type, requests::BIGINT AS requests, error_rate, min(ms) AS p FROM r JOIN t USING (event_type) WHERE run >= ceil(requests * 0.95) GROUP BY 1, 2, 3""")
def _(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "events").groupBy("event_type", F.floor("value").alias("ms")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return reports.latency(h, "event_type")


def _vault(spark: SparkSession, d: str) -> DataFrame:
    """Notes from documents: each links to two others by number, some of which aren't there."""
    docs = table(spark, d, "documents")
    link = lambda n: F.concat(F.lit("[[d"), n.cast("string"), F.lit("|x]]"))
    return docs.select(F.concat(F.lit("v/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat_ws(" ", "lang", link(F.col("doc_id") * 2), link(F.col("doc_id") * 3 + 1)).alias("content"))


@query("jn17_vault_links", """
    WITH l AS (SELECT doc_id AS s, unnest(list_distinct([doc_id * 2, doc_id * 3 + 1])) AS t FROM documents)
    SELECT 'd' || s AS source, 'd' || t AS target, t NOT IN (SELECT doc_id FROM documents) AS broken FROM l""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return reports.links(_vault(spark, d))


@query("agg16_vault_stats", """
    WITH l AS (SELECT doc_id AS s, unnest(list_distinct([doc_id * 2, doc_id * 3 + 1])) AS t FROM documents)
    SELECT (SELECT count(*) FROM documents) AS notes, 0::BIGINT AS with_frontmatter, count(*) AS links, count(*) FILTER (t NOT IN (SELECT doc_id FROM documents)) AS broken_links, 0::BIGINT AS orphans FROM l""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return reports.vault_stats(_vault(spark, d))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Markdown files from conversations: each turn is a section of its own file."""
    t = table(spark, d, "conversations")
    return t.select(F.concat_ws("-", F.lit("v/c"), "conv_id", F.concat("turn", F.lit(".md"))).alias("path"), F.concat(F.lit("# "), "role", F.lit("\n"), "text").alias("content"))


@query("rag03_context", "WITH h AS (SELECT conv_id, turn, length(text) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS n, text FROM conversations) SELECT conv_id AS path, turn AS chunk_id, score, left(text, 300) AS content FROM h WHERE n = 1 ORDER BY score DESC, turn LIMIT 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("chunk_id"), F.char_length("text").cast("long").alias("score"), F.col("text").alias("content"))
    return documents.context(hits, 20, 300)


@query("gen02_previews", "SELECT 'v/c-' || conv_id || '-' || turn || '.md' AS path, 'c-' || conv_id || '-' || turn || '-1' AS slug, role AS title FROM conversations WHERE trim(text) <> ''")
def _(spark: SparkSession, d: str) -> DataFrame:
    return documents.previews(_files(spark, d)).select("path", "slug", "title")


@query("str13_card_slugs", "SELECT p_partkey, lower(replace(replace(p_type, ' ', '-'), '_', '-')) || '-' || trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[ _./-]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '-') || '-' || p_size || '-en' AS slug FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tx.card_slug(F.col("p_type"), F.col("p_name"), F.col("p_size"), F.lit("EN")).alias("slug"))


@query("set01_orphans", "SELECT o_custkey AS k, 'local' AS side FROM orders WHERE o_custkey NOT IN (SELECT l_suppkey FROM lineitem) GROUP BY 1 UNION ALL SELECT l_suppkey, 'remote' FROM lineitem WHERE l_suppkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sync.orphans(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")), "k")


@query("flt14_subtree", "SELECT path FROM topics WHERE path = 'ASIA' OR starts_with(path, 'ASIA/')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return c.topics(spark, d).where(topics.in_subtree(F.col("path"), "ASIA")).select("path")


@query("flt15_children", "SELECT path FROM topics WHERE starts_with(path, 'ASIA/') AND NOT contains(path[6:], '/')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return c.topics(spark, d).where(topics.is_child(F.col("path"), "ASIA")).select("path")


@query("agg14_edge_counts", f"WITH {EDGES} SELECT 'prerequisite' AS edge_type, 'manual' AS edge_source, count(*) AS n FROM e")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_counts(_edges(spark, d))


@query("kg04_prerequisites", f"WITH {EDGES} SELECT source, weight FROM e WHERE target = 7")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.prerequisites(_edges(spark, d), 7).select("source", "weight")


@query("agg17_label_stats", "SELECT count(*) AS assignments, count(DISTINCT topic_id) AS topics_matched, (SELECT count(*) FROM notes) AS notes_processed FROM note_topics")
def _(spark: SparkSession, d: str) -> DataFrame:
    return topics.label_stats(c.note_topics(spark, d), c.notes(spark, d))


@query("hsh03_item_ids", "SELECT doc_id, left(sha256('fsrs:' || source || ':' || lang), 16) AS with_prefix, left(sha256(source || ':' || lang), 16) AS audit FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    ids = {"with_prefix": hashes.item_id("fsrs", F.col("source"), F.col("lang")), "audit": hashes.item_id("", F.col("source"), F.col("lang"))}
    return table(spark, d, "documents").select("doc_id", *[v.alias(k) for k, v in ids.items()])


@query("vec02_mock_embedding", "SELECT doc_id, array_to_string([round((('0x' || sha256(text)[i * 2 + 1:i * 2 + 2])::INT / 127.5 - 1), 4) FOR i IN range(0, 8)], '|') AS v FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform(vectors.mock_embedding(F.col("text"), 8), lambda x: F.round(x.cast("double"), 4).cast("string"))
    return table(spark, d, "documents").select("doc_id", F.array_join(v, "|").alias("v"))


@query("str07_wikilinks", "SELECT doc_id, 'd' || (doc_id * 2) || '|d' || (doc_id * 3 + 1) AS targets FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    doc = F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id")
    return _vault(spark, d).select(doc, F.array_join(tx.wikilinks(F.col("content")), "|").alias("targets"))


@query("str20_sections", "SELECT 'v/c-' || conv_id || '-' || turn || '.md' AS path, role AS heading, 1 AS level FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("path", F.explode(tx.sections(F.col("content"))).alias("s")).select("path", "s.heading", "s.level")


@query("tag03_tag_suggestions", """
    WITH v AS (SELECT DISTINCT p_brand AS s FROM part), t AS (SELECT DISTINCT replace(p_brand, 'Brand', 'brand') || 'x' AS t FROM part),
    x AS (SELECT t AS tag, s AS suggestion, CASE WHEN starts_with(t, lower(s)) OR starts_with(lower(s), t) THEN 0
        ELSE abs(strlen(t) - strlen(s)) + len([i FOR i IN range(1, least(length(t), length(s)) + 1) IF lower(t)[i] <> lower(s)[i]]) END AS distance FROM t, v)
    SELECT tag, suggestion, distance::INT AS distance FROM x WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY tag ORDER BY distance, suggestion) <= 3""")
def _(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "part").select("p_brand").distinct()
    asked = brands.select(F.concat(F.regexp_replace("p_brand", "^Brand", "brand"), F.lit("x")).alias("tag"))
    return tags.suggestions(asked, brands.select(F.col("p_brand").alias("tag"))).select("tag", "suggestion", F.col("distance").cast("int").alias("distance"))


@query("set03_reconcile", f"WITH {WORK} SELECT id, CASE WHEN status = 'open' AND id::BIGINT % 2 = 0 THEN 'fixed' ELSE status END AS status FROM w")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = _work(spark, d).withColumns({"resolved_at": F.lit(None).cast("timestamp"), "attestation": F.lit(None).cast("string"), "loop_kind": F.lit("audit")})
    seen = w.where("cast(id as long) % 2 = 1").select("id", "tier", "kind", "slug", "loop_kind", "status")
    return worklist.reconciled(w, seen, ["audit"], F.lit("2024-01-01").cast("timestamp")).select("id", "status")


@query("idx02_index_summary", "SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0) AS to_embed, 1::BIGINT AS removed_notes")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = _notes_of_documents(spark, d)
    gone = docs.limit(1).withColumn("note_id", F.lit(-5).cast("long"))
    old = sync.chunks(docs.where("note_id % 3 = 0").unionByName(gone), "m")
    return sync.index_summary(sync.chunks(docs, "m"), old)


@query("set02_stale_states", "SELECT o_orderkey AS slug FROM orders WHERE o_totalprice > 0 AND o_totalprice < 50000")
def _(spark: SparkSession, d: str) -> DataFrame:
    states = table(spark, d, "orders").select(F.col("o_orderkey").alias("slug"), F.col("o_totalprice").alias("synced_at"))
    return sync.stale_states(states, F.lit(50000.0)).select("slug")




from recallgrid.plans import card_queries, search_queries, text_queries, work_queries  # noqa: E402, F401
