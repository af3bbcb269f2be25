"""Queries of lexical, vector and hybrid search, with the SQL they must equal. Queries are the rows with an id divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions import vectors
from recallgrid.operators import documents, duplicates, filters, lexicon, neighbours, search, sparse_index, topics
from recallgrid.plans.base import query
from recallgrid.plans.registry import SPARSE, _notes_of_documents
from recallgrid.session import table
from recallgrid.sources import catalog as c
from recallgrid.tables import discard, written

#: The words of a query are the first three of its document.
FIRST_WORDS = 3
STEMMED = """
    t AS (SELECT doc_id, i, lower(regexp_replace(l[i], '[^\\p{L}\\p{N}]', '', 'g')) AS token FROM (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)),
    k AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM t WHERE token <> ''),
    m AS (SELECT doc_id, nth, regexp_replace(regexp_replace(regexp_replace(regexp_replace(token, 'ies$', 'y'), '^(.{2,}?)sses$', '\\1ss'), '^(.{3,}?)(?:ing|edly|ed|ly)$', '\\1'), '^(.*..[^su])s$', '\\1') AS stem
        FROM k WHERE token NOT IN (STOP)),
    p AS (SELECT doc_id, stem, count(*) AS n FROM m GROUP BY ALL),
    q AS (SELECT DISTINCT doc_id AS query_id, stem FROM m WHERE doc_id % 20 = 0 AND nth <= 3),
    w AS (SELECT query_id, count(*) AS stems FROM q GROUP BY 1),
    h AS (SELECT query_id, p.doc_id AS note_id, sum(n) AS n FROM q JOIN w USING (query_id) JOIN p USING (stem) GROUP BY query_id, p.doc_id, stems HAVING count(*) = stems),
    f AS (SELECT query_id, note_id, n / (1 + ln(1 + (SELECT sum(p.n) FROM p WHERE p.doc_id = note_id))) AS score FROM h),
    lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id) AS rank FROM f QUALIFY rank <= 50)
""".replace("STOP", ", ".join(f"'{w}'" for w in search.STOP))
DENSE = """
    v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
    dense AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS rank
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY rank <= {most})
"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id % 20 = 0")
    first = F.array_join(F.slice(vectors.tokens(F.col("text")), 1, FIRST_WORDS), " ")
    return docs.select(F.col("doc_id").alias("query_id"), first.alias("query"))


def _dense(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), "text")
    return search.full_text_each(notes, _queries(spark, d), 50)


@query("fts01_full_text", f"WITH {STEMMED} SELECT query_id, note_id, round(score, 6) AS rank FROM lex")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d).withColumn("rank", F.round("rank", 6))


@query("fts02_lexical_chain", """
    WITH g AS (SELECT note_id, len(list_intersect(list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN [x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') IF x <> '']])), q)) AS n,
            len(list_distinct(list_concat(list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN [x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') IF x <> '']])), q))) AS every
        FROM notes, (SELECT list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN ['machinary', 'custommer']])) AS q) WHERE NOT deleted)
    SELECT 'fts' AS mode, note_id, round(n, 6)::DOUBLE AS rank FROM (SELECT note_id, 2 / (1 + ln(3)) AS n FROM notes WHERE NOT deleted AND tags[1] = 'machinery' AND note_id = 0)
    UNION ALL (SELECT 'fuzzy', note_id, round(n / every, 6) FROM g WHERE n / every > 0.1 ORDER BY n / every DESC, note_id LIMIT 50)
    UNION ALL SELECT 'fts', note_id, round(1 / (1 + ln(3)), 6) FROM (SELECT note_id FROM notes WHERE NOT deleted AND tags[1] = 'machinery' ORDER BY note_id LIMIT 50)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The chain takes full text for a word that notes have, and trigrams for words that are misspelt."""
    notes = c.notes(spark, d).where("not deleted")
    found = [search.lexical(notes, words) for words in ("Machineries", "machinary custommer")]
    one, two = (rows.select(F.lit(mode).alias("mode"), "note_id", F.round("rank", 6).alias("rank")) for mode, rows in found)
    return one.unionByName(two)


@query("vec06_chunk_search", f"""
    WITH {SPARSE}, {DENSE.format(most=60)},
    sq AS (SELECT doc_id AS query_id, idx, weight FROM s WHERE doc_id % 20 = 0),
    idf AS (SELECT idx, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM s WHERE idx IN (SELECT idx FROM sq) GROUP BY 1),
    x AS (SELECT query_id, s.doc_id AS id, round(sum(s.weight * sq.weight * idf), 9) AS score FROM sq JOIN idf USING (idx) JOIN s USING (idx) WHERE s.doc_id <> query_id GROUP BY 1, 2),
    y AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x QUALIFY rank <= 60),
    z AS (SELECT query_id, id, sum(1 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM dense UNION ALL SELECT * FROM y) GROUP BY 1, 2)
    SELECT query_id, id, round(score, 9) AS score FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY z.score DESC, id) <= 20""")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = written(vectors.sparse_documents(docs, "doc_id", "text").withColumnRenamed("doc_id", "id"))
    sparse_queries = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    found = search.chunk_search(*_dense(spark, d), sparse_queries, rows, docs.agg(F.count("*").alias("n")), 20)
    return found.select("query_id", "id", F.round("score", 9).alias("score"))


@query("srch01_hybrid_search", f"""
    WITH {STEMMED}, {DENSE.format(most=200)},
    sem AS (SELECT query_id, id AS note_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS place FROM dense WHERE id IN (SELECT doc_id FROM documents) QUALIFY place <= 50),
    z AS (SELECT query_id, note_id AS id, sum(1 / (60 + rank)) AS score FROM (SELECT query_id, note_id, place AS rank FROM sem UNION ALL SELECT query_id, note_id, rank FROM lex) GROUP BY 1, 2)
    SELECT query_id, id, round(score, 9) AS score FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY z.score DESC, id) <= 50""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Each query by its words and by its vector: four times as many vectors as results, then those of known notes."""
    own = F.row_number().over(search.W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    notes = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    near = neighbours.nearest(*_dense(spark, d), 200).join(notes, "id", "left_semi").withColumn("rank", own).where("rank <= 50")
    words = _lexical(spark, d).select("query_id", F.col("note_id").alias("id"), F.row_number().over(search.W.partitionBy("query_id").orderBy(F.desc("rank"), "note_id")).alias("rank"))
    return search.fused_each([near, words], limit=50).select("query_id", "id", F.round("score", 9).alias("score"))


@query("vec04_sparse_scores", f"""
    WITH {SPARSE}, q AS (SELECT doc_id AS query_id, idx, weight FROM s WHERE doc_id % 20 = 0),
    f AS (SELECT idx, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM s WHERE idx IN (SELECT idx FROM q) GROUP BY 1),
    x AS (SELECT query_id, s.doc_id, round(sum(s.weight * q.weight * idf), 6) AS score FROM q JOIN f USING (idx) JOIN s USING (idx) GROUP BY 1, 2)
    SELECT query_id, max(score) AS best, count(*) AS found FROM x GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The best score of each query and how many documents share a token with it."""
    docs = table(spark, d, "documents")
    rows = sparse_index.document_vectors(docs, "doc_id", "text")
    found = sparse_index.counted_scores(rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), rows, docs.agg(F.count("*").alias("n")))
    discard(rows)
    return found.select("query_id", F.round("best", 6).alias("best"), "found")


MOCK = "[('0x' || sha256({text})[i * 2 + 1:i * 2 + 2])::INT / 127.5 - 1 FOR i IN range(0, 8)]"


@query("vec10_topic_labels", f"""
    WITH n AS (SELECT note_id, [x::FLOAT::DOUBLE FOR x IN {MOCK.format(text="text")}] AS v FROM notes), t AS (SELECT topic_id, path, [x::FLOAT::DOUBLE FOR x IN {MOCK.format(text="label")}] AS v FROM topics)
    SELECT note_id, topic_id::BIGINT AS topic_id, path, round(list_cosine_similarity(n.v, t.v), 6) AS confidence FROM n, t
    WHERE list_cosine_similarity(n.v, t.v) >= 0.5 QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY list_cosine_similarity(n.v, t.v) DESC, topic_id DESC) <= 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Labels and notes embedded by the mock model, and the two nearest labels of each note."""
    embed = lambda x: vectors.mock_embedding(F.col(x), 8).cast("array<double>")
    notes = c.notes(spark, d).select("note_id", embed("text").alias("vector"))
    labelled = topics.similarities(notes, c.topics(spark, d).select("topic_id", "path", embed("label").alias("vector")), 0.5, 2)
    return labelled.withColumn("confidence", F.round("confidence", 6))


@query("vec10_stored_assignments", f"""
    WITH n AS (SELECT note_id, [x::FLOAT::DOUBLE FOR x IN {MOCK.format(text="text")}] AS v FROM notes),
    d AS (SELECT topic_id, CASE WHEN topic_id % 2 = 0 THEN label || ': all of ' || path ELSE label END AS e FROM topics), t AS (SELECT topic_id::BIGINT AS topic_id, [x::FLOAT::DOUBLE FOR x IN {MOCK.format(text="e")}] AS v FROM d),
    l AS (SELECT note_id, topic_id, round(list_cosine_similarity(n.v, t.v), 6) AS confidence FROM n, t WHERE list_cosine_similarity(n.v, t.v) >= 0.5 QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY list_cosine_similarity(n.v, t.v) DESC, topic_id DESC) <= 2),
    s AS (SELECT note_id, topic_id::BIGINT AS topic_id, round(max(confidence), 6)::DOUBLE AS confidence FROM note_topics GROUP BY 1, 2)
    SELECT note_id, topic_id, coalesce(l.confidence, s.confidence) AS confidence, CASE WHEN l.confidence IS NULL THEN 'rule' ELSE 'embedding' END AS method FROM s FULL JOIN l USING (note_id, topic_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Topics with and without a description embedded by the mock model, and their labels put into the stored ones."""
    embed = lambda x: vectors.mock_embedding(x, 8).cast("array<double>")
    description = F.when(F.col("topic_id") % 2 == 0, F.concat(F.lit("all of "), "path"))
    own = c.topics(spark, d).withColumn("description", description).select("topic_id", "path", embed(topics.embedded_text()).alias("vector"))
    labelled = topics.similarities(c.notes(spark, d).select("note_id", embed(F.col("text")).alias("vector")), own, 0.5, 2)
    stored = c.note_topics(spark, d).groupBy("note_id", F.col("topic_id").cast("long").alias("topic_id")).agg(F.max("confidence").alias("confidence")).withColumn("method", F.lit("rule"))
    return topics.assigned(stored, labelled).withColumn("confidence", F.round("confidence", 6))


@query("vec09_vector_clusters", f"""RECURSIVE
    WITH {DENSE.format(most=25)}, p AS (SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, max(s) AS s FROM dense WHERE s >= 0.4 GROUP BY 1, 2),
    l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(id, c) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
    m AS (SELECT id, min(c) AS c FROM r GROUP BY 1), g AS (SELECT c, max_by(id, (id % 9, -id)) AS representative, count(*) AS size FROM m GROUP BY 1)
    SELECT representative, size, m.id AS note_id, round(coalesce((SELECT max(s) FROM p WHERE (a = representative AND b = m.id) OR (b = representative AND a = m.id)), 0), 6)::DOUBLE AS similarity
    FROM m JOIN g USING (c) WHERE m.id <> representative""")
def _(spark: SparkSession, d: str) -> DataFrame:
    queries, v = _dense(spark, d)
    pairs = neighbours.nearest(queries, v, 25, 0.4).select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("score").alias("similarity"))
    found = duplicates.clusters(pairs, v.select(F.col("id").alias("note_id"), (F.col("id") % 9).alias("total_reps")), 0.4)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("scn03_duplicate_items", """
    WITH k AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') AS body FROM documents WHERE text IS NOT NULL),
    g AS (SELECT max_by(doc_id, (doc_id % 9, -doc_id)) AS r, list(doc_id) AS ids FROM k GROUP BY body HAVING count(*) > 1)
    SELECT left(sha256('dup:d' || i || ':d' || r), 16) AS id, 'duplicate' AS kind, 1 AS tier, 'd' || i AS slug, 'd' || r AS other_slug FROM g, unnest(ids) AS u(i) WHERE i <> r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = _notes_of_documents(spark, d)
    found = duplicates.clusters(duplicates.exact_pairs(n), n.select("note_id", (F.col("note_id") % 9).alias("total_reps")), notes=n)
    return duplicates.scanner_items(found, n.select("note_id", F.concat(F.lit("d"), "note_id").alias("slug"))).select("id", "kind", "tier", "slug", "other_slug")


@query("ord06_reranked", """
    WITH r AS (SELECT note_id, sum(lapses)::DOUBLE AS s FROM cards GROUP BY 1), h AS (SELECT r.note_id, s, length(text) AS n FROM r JOIN notes USING (note_id) ORDER BY s DESC, note_id LIMIT 30)
    SELECT r.note_id, h.n::DOUBLE AS rerank_score, row_number() OVER (ORDER BY h.n DESC NULLS LAST, r.s DESC, r.note_id) AS place FROM r LEFT JOIN h USING (note_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    hits = c.cards(spark, d).groupBy("note_id").agg(F.sum("lapses").cast("double").alias("rrf_score")).withColumn("headline", F.lit(None).cast("string"))
    order = search.reranked(hits, c.notes(spark, d), lambda text: F.char_length(text).cast("double"), 30)
    place = F.row_number().over(search.W.orderBy(F.desc_nulls_last("rerank_score"), F.desc("rrf_score"), "note_id")).cast("long")
    return order.select("note_id", "rerank_score", place.alias("place"))


@query("flt17_duplicate_advice", "SELECT vec_id, CASE WHEN s >= 0.95 THEN 'skip' WHEN s >= 0.85 THEN 'merge' WHEN s >= 0.7 THEN 'review' ELSE 'create' END AS advice FROM (SELECT query_id AS vec_id, max(s) AS s FROM (WITH " + DENSE.format(most=1) + " SELECT * FROM dense) GROUP BY 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(*_dense(spark, d), 1)
    return near.select(F.col("query_id").alias("vec_id"), documents.duplicate_advice(F.col("score")).alias("advice"))


@query("flt12_payload_rows", "WITH p AS (SELECT n.note_id, n.tags, coalesce(bool_or(k.ivl >= 21), false) AS mature, list(k.deck) FILTER (k.deck IS NOT NULL) AS decks FROM notes n LEFT JOIN cards k USING (note_id) GROUP BY ALL) SELECT note_id FROM p WHERE mature AND list_has_any(coalesce(decks, []), ['2-HIGH', '5-LOW']) AND list_has_any(tags, ['building', 'tag-7']) AND NOT list_has_any(tags, ['tag-1'])")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = filters.translated(filters.Filters(decks=("2-HIGH ", "5-LOW"), tags=("building", "tag-7"), tags_exclude=("tag-1",), min_ivl=21))
    return filters.note_details(c.notes(spark, d), c.cards(spark, d)).where(filters.payload_predicate(f)).select("note_id")


def _part_names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Part names as notes, and every twentieth of them, spelt without its letters e, as a query."""
    notes = table(spark, d, "part").select(F.col("p_partkey").alias("note_id"), F.col("p_name").alias("text"))
    return notes, notes.where("note_id % 20 = 0").select(F.col("note_id").alias("query_id"), F.replace("text", F.lit("e"), F.lit("")).alias("query"))


GRAMS = "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN [x FOR x IN regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+') IF x <> '']]))"


@query("fts03_trigrams_each", f"""
    WITH g AS (SELECT p_partkey AS note_id, {GRAMS.format(text="p_name")} AS g FROM part), q AS (SELECT p_partkey AS query_id, {GRAMS.format(text="replace(p_name, 'e', '')")} AS q FROM part WHERE p_partkey % 20 = 0),
    s AS (SELECT query_id, note_id, len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))) AS r FROM g, q)
    SELECT query_id, note_id, round(r, 6) AS rank FROM s WHERE r > 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC, note_id) <= 50""")
def _(spark: SparkSession, d: str) -> DataFrame:
    notes, queries = _part_names(spark, d)
    return lexicon.fuzzy_of_texts(notes, queries, 50).withColumn("rank", F.round("rank", 6))


@query("fts04_prefix_table", "SELECT doc_id AS note_id, 1.0::DOUBLE AS rank FROM documents WHERE starts_with(lower(text), 'th') ORDER BY doc_id LIMIT 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), "text")
    return lexicon.prefixed(lexicon.prefix_table(notes), "Th", 50)


HYBRID = """
    sem AS (SELECT query_id, id AS note_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS place FROM dense WHERE id IN (SELECT doc_id FROM documents) AND query_id IN (SELECT doc_id FROM k) QUALIFY place <= {limit}),
    words AS (SELECT query_id, note_id, score, rank FROM lex WHERE rank <= {limit}),
    z AS (SELECT query_id, note_id, place AS semantic_rank, rank AS lexical_rank, coalesce({sw} / (60 + place), 0) + coalesce({lw} / (60 + rank), 0) AS rrf FROM {sides}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, note_id) AS rank FROM z QUALIFY rank <= {limit})
"""
SIDES = {"hybrid": "sem FULL JOIN words USING (query_id, note_id)", "semantic": "sem LEFT JOIN (SELECT * FROM words WHERE false) words USING (query_id, note_id)", "lexical": "words LEFT JOIN (SELECT * FROM sem WHERE false) sem USING (query_id, note_id)"}


def _hybrid(name: str, mode: str, limit: int, semantic: float, words: float, rerank: int | None = None) -> None:
    """A hybrid search of the stated query set. Its words are found by full text: a query's own document has them."""
    sides = HYBRID.format(limit=limit, sw=semantic, lw=words, sides=SIDES[mode])
    order = f"CASE WHEN rank <= {rerank} THEN length(text) END DESC NULLS LAST, rank" if rerank else "rank"
    sql = f"""WITH {STEMMED}, {DENSE.format(most=4 * limit)}, {sides}
        SELECT query_id, note_id, (row_number() OVER (PARTITION BY query_id ORDER BY {order}))::INT AS rank, round(rrf, 9) AS rrf_score, semantic_rank::INT AS semantic_rank, lexical_rank::INT AS lexical_rank, CASE WHEN semantic_rank IS NOT NULL THEN 'v' || note_id END AS chunk_id
        FROM r JOIN documents ON doc_id = note_id"""

    def run(spark: SparkSession, d: str) -> DataFrame:
        notes = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), "text")
        near = neighbours.nearest(*_dense(spark, d), 4 * limit).select("query_id", F.col("id").alias("note_id"), F.concat(F.lit("v"), "id").alias("chunk_id"), "score")
        queries = _queries(spark, d)
        hits = lexicon.lexical_each(notes, queries, limit, ("fts",) if mode != "semantic" else ())
        found = search.hybrid_each(queries, notes, near, hits, limit, mode, semantic, words, (lambda _, text: F.char_length(text).cast("double")) if rerank else None, rerank)
        return found.select("query_id", "note_id", "rank", F.round("rrf_score", 9).alias("rrf_score"), "semantic_rank", "lexical_rank", "chunk_id")

    query(name, sql)(run)


_hybrid("srch01_hybrid", "hybrid", 50, 1.0, 0.5)
_hybrid("srch01_semantic_mode", "semantic", 20, 1.0, 1.0)
_hybrid("srch01_lexical_mode", "lexical", 20, 1.0, 1.0)
_hybrid("srch01_reranked", "hybrid", 20, 1.0, 1.0, 10)
