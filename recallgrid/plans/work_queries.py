"""Queries of work items, the card registry, stores and forecasts, with the SQL they must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions import embedding_inputs as ei
from recallgrid.functions import hashes
from recallgrid.operators import cardbook, chunk_store, documents, duplicates, filters, graph, reports, scans, sync, topics, worklist
from recallgrid.plans.base import query
from recallgrid.plans.registry import COVERAGE, EDGES, PAIRS, _coverage, _edges, _registry, _work
from recallgrid.session import shared_folder, table
from recallgrid.sources import catalog as c
from recallgrid.tables import Store, inserted, upserted

STATUSES = ("open", "in_progress", "fixed", "skipped", "wont_fix")


@query("wq03_transitions", """
    WITH w AS (SELECT o_orderkey AS id, ['open', 'in_progress', 'fixed', 'skipped', 'wont_fix'][o_orderkey % 5 + 1] AS status, ['open', 'in_progress', 'fixed', 'skipped', 'wont_fix'][(o_orderkey // 5) % 5 + 1] AS target FROM orders),
    x AS (SELECT *, (status = 'open' AND target <> 'open') OR (status = 'in_progress' AND target <> 'in_progress') OR (status = 'fixed' AND target = 'open') AS allowed FROM w)
    SELECT id::VARCHAR AS id, CASE WHEN allowed THEN target ELSE status END AS status, CASE WHEN allowed THEN target NOT IN ('open', 'in_progress') ELSE status NOT IN ('open', 'in_progress') END AS resolved, CASE WHEN allowed THEN 'new' ELSE 'old' END AS attestation FROM x""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of statuses; the time of resolution is set and cleared with them."""
    at = lambda n: F.get(F.array(*map(F.lit, STATUSES)), (n % 5).cast("int"))
    k, day = F.col("o_orderkey"), F.lit("2024-01-01").cast("timestamp")
    w = table(spark, d, "orders").select(k.cast("string").alias("id"), at(k).alias("status"), at(F.floor(k / 5)).alias("to"), F.lit("old").alias("attestation"))
    w = w.withColumn("resolved_at", F.when(~F.col("status").isin("open", "in_progress"), F.lit("2020-01-01").cast("timestamp")))
    after = worklist.moved(w.drop("to"), w.select("id", "to", F.lit("new").alias("attestation")), day)
    return after.select("id", "status", F.col("resolved_at").isNotNull().alias("resolved"), "attestation")


@query("scn01_audit_items", f"""
    WITH {PAIRS}, q AS (SELECT slug, trim(front) AS f, trim(back) AS b, lower(trim(front)) AS l FROM pairs),
    d AS (SELECT slug,
        greatest(0, 1::DOUBLE - CASE WHEN regexp_matches(l, 'explain|describe|tell me about|tell about|discuss|elaborate') THEN 0.4::DOUBLE ELSE 0 END
          - CASE WHEN regexp_matches(l, '^(is|does|can|do|are|was|were|has|have|will|would|should|could|did) ') THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN f <> '' AND NOT contains(f, '?') THEN 0.2::DOUBLE ELSE 0 END) AS clarity,
        1 - CASE WHEN wf > 30 THEN 0.4 WHEN wf > 20 THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN j >= 2 THEN 0.4 WHEN j = 1 THEN 0.1 ELSE 0 END AS atomicity,
        CASE WHEN b = '' THEN 0 ELSE 1 - CASE WHEN wb > 200 THEN 0.5 WHEN wb > 100 THEN 0.3 ELSE 0 END END AS testability,
        1 - CASE WHEN wb > 150 THEN 0.3 ELSE 0 END AS memorability,
        greatest(0, 1::DOUBLE - CASE WHEN f = '' THEN 0.5 ELSE 0 END - CASE WHEN b = '' THEN 0.5 ELSE 0 END - CASE WHEN f <> '' AND NOT contains(f, '?') THEN 0.2::DOUBLE ELSE 0 END) AS accuracy,
        0.5 + CASE WHEN contains(l, 'compare') THEN 0.3 ELSE 0 END AS relevance
        FROM (SELECT *, len([x FOR x IN regexp_split_to_array(f, '\\s+') IF x <> '']) AS wf, len([x FOR x IN regexp_split_to_array(b, '\\s+') IF x <> '']) AS wb,
            len([x FOR x IN regexp_split_to_array(l, '[^\\p{{L}}\\p{{N}}]+') IF x IN ('and', 'or')]) AS j FROM q)),
    s AS (UNPIVOT d ON clarity, atomicity, testability, memorability, accuracy, relevance INTO NAME dimension VALUE score),
    i AS (
        SELECT slug, 1 AS tier, 'Front side is very short (' || strlen(front) || ' chars)' AS message FROM pairs WHERE trim(front) <> '' AND strlen(front) < 10
        UNION ALL SELECT slug, 1, 'Back side is very short (' || strlen(back) || ' chars)' FROM pairs WHERE trim(back) <> '' AND strlen(back) < 10
        UNION ALL SELECT slug, 2, 'Front side is empty' FROM pairs WHERE trim(front) = '' UNION ALL SELECT slug, 2, 'Back side is empty' FROM pairs WHERE trim(back) = ''
        UNION ALL SELECT slug, 1, 'Front side exceeds 5000 chars (' || strlen(front) || ')' FROM pairs WHERE strlen(front) > 5000
        UNION ALL SELECT slug, 1, 'Back side exceeds 5000 chars (' || strlen(back) || ')' FROM pairs WHERE strlen(back) > 5000
        UNION ALL SELECT slug, 1, 'Trailing whitespace in front' FROM pairs WHERE regexp_matches(front, '(?m)[ \\t]+$') UNION ALL SELECT slug, 1, 'Trailing whitespace in back' FROM pairs WHERE regexp_matches(back, '(?m)[ \\t]+$')
        UNION ALL SELECT slug, 1, 'Consecutive blank lines in front' FROM pairs WHERE contains(front, chr(10) || chr(10) || chr(10)) UNION ALL SELECT slug, 1, 'Consecutive blank lines in back' FROM pairs WHERE contains(back, chr(10) || chr(10) || chr(10)))
    SELECT left(sha256(slug || ':validation:' || message), 16) AS id, 'validation_error' AS kind, tier, slug, NULL AS dimension, message, 1.0::DOUBLE AS confidence FROM i
    UNION ALL SELECT left(sha256(slug || ':quality:' || dimension), 16), 'low_quality', 2, slug, dimension, NULL, 0.8 FROM s WHERE score < 0.5
    UNION ALL SELECT left(sha256(slug || ':missing_tags'), 16), 'missing_tags', 1, slug, NULL, NULL, 1.0 FROM pairs""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return worklist.audit(_registry(spark, d)).select("id", "kind", "tier", "slug", "dimension", "message", "confidence")


@query("scn02_retention_items", """
    WITH k AS (SELECT card_id, 'n-' || note_id AS slug, ivl, ease, lapses, reps, coalesce(s.reviews, 0) AS reviews, coalesce(fail_rate, 0) AS fail_rate, s.reviews IS NOT NULL AS seen FROM cards JOIN notes USING (note_id) LEFT JOIN card_stats s USING (card_id)),
    m AS (SELECT *, ivl > 0 AS known, least(greatest(11 - (ease / 1000 - 1) / (exp(1.4604) * pow(greatest(ivl, 1), -0.0046) * (exp(0.1 * 1.54575) - 1)), 1), 10) AS difficulty,
        CASE WHEN ivl > 0 THEN pow(1 + (pow(0.9, -2) - 1) * (CASE WHEN seen THEN 152 ELSE 0 END) / ivl, -0.5) END AS recall FROM k),
    r AS (SELECT *, CASE WHEN known THEN ivl < 5 AND difficulty > 7 ELSE ease < 1800 AND lapses >= 5 END AS rework, CASE WHEN known THEN ivl < 2 AND difficulty > 8.5 AND reps >= 10 ELSE ease < 1500 AND reps >= 10 END AS del,
        reviews >= 5 AND CASE WHEN known THEN recall < 0.5 ELSE fail_rate > 0.4 END AS quick FROM m),
    x AS (SELECT *, CASE WHEN rework THEN 'fsrs_low_stability_rework' WHEN del THEN 'fsrs_persistently_difficult_delete' ELSE 'fsrs_low_retrievability_quickfix' END AS rule FROM r WHERE rework OR del OR quick)
    SELECT left(sha256('fsrs:' || slug || ':' || rule), 16) AS id, slug, CASE WHEN rework THEN 3 WHEN del THEN 4 ELSE 2 END AS tier, CASE WHEN rework THEN 0.85 WHEN del THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence,
        round(CASE WHEN known THEN least(ivl / 100, 1) * 0.7 + (1 - (difficulty - 1) / 9) * 0.3 ELSE least(ease / 5000, 1) * (1 - fail_rate) END, 6)::DOUBLE AS score FROM x""")
def _(spark: SparkSession, d: str) -> DataFrame:
    slugs = c.notes(spark, d).select("note_id", F.concat(F.lit("n-"), "note_id").alias("slug"))
    stats = c.card_stats(spark, d).withColumn("last_review_at", F.lit("2024-01-01").cast("timestamp"))
    found = worklist.retention(c.cards(spark, d), stats, slugs, F.lit("2024-06-01").cast("timestamp"))
    return found.select("id", "slug", "tier", "confidence", F.round("score", 6).alias("score"))


@query("jn16_uncovered", "SELECT left(sha256('gen:doc-' || doc_id || ':uncovered'), 16) AS id, 'generation' AS loop_kind, NULL AS slug, 'doc-' || doc_id AS source_path, 3 AS tier, 0.9::DOUBLE AS confidence FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("doc-"), "doc_id")
    found = worklist.uncovered(table(spark, d, "documents").select(name.alias("path")), table(spark, d, "labels").select(name.alias("source_path")))
    return found.select("id", "loop_kind", "slug", "source_path", "tier", "confidence")


@query("jn18_stale", """
    SELECT left(sha256('stale:n/' || doc_id || '.md'), 16) AS id, 'audit' AS loop_kind, NULL AS slug, 'n/' || doc_id || '.md' AS source_path, 2 AS tier, CASE WHEN doc_id % 4 = 2 THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence
    FROM documents WHERE doc_id % 4 IN (1, 2)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Of four sources one has changed, one is gone, one is as it was and one has no stored hash; each has an older note."""
    docs = table(spark, d, "documents")
    path, k = F.concat(F.lit("n/"), "doc_id", F.lit(".md")), F.col("doc_id") % 4
    stored = F.when(k == 1, "old").when(k != 3, hashes.file_hash(F.coalesce("text", F.lit(""))))
    notes = docs.select(path.alias("source_path"), stored.alias("content_hash"), F.lit(2).alias("note_id"))
    older = docs.where(k != 3).select(path.alias("source_path"), F.lit("older").alias("content_hash"), F.lit(1).alias("note_id"))
    files = docs.where(k != 2).select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return worklist.stale(notes.unionByName(older), files).select("id", "loop_kind", "slug", "source_path", "tier", "confidence")


@query("scn04_review_items", """
    WITH r AS (SELECT 'c-' || event_id AS slug, event_type AS dimension, round(value / 100, 6) AS score FROM events)
    SELECT left(sha256('llm_review:' || slug || ':' || dimension), 16) AS id, slug, dimension, CASE WHEN score < 0.4 THEN 3 ELSE 2 END AS tier, CASE WHEN score < 0.4 THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence FROM r WHERE score < 0.6""")
def _(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "events").select(F.concat(F.lit("c-"), "event_id").alias("slug"), F.col("event_type").alias("dimension"), F.round(F.col("value") / 100, 6).alias("score"))
    return documents.review_items(scores).select("id", "slug", "dimension", "tier", "confidence")


@query("wq05_reopened", """
    WITH w AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'fixed' WHEN 'O' THEN 'open' ELSE 'in_progress' END AS status FROM orders)
    SELECT id::VARCHAR AS id, CASE WHEN status = 'fixed' AND id % 3 = 0 THEN 'open' ELSE status END AS status, status = 'fixed' AND id % 3 <> 0 AS resolved FROM w""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Fixed items that a scan sees again are opened again."""
    w = _work(spark, d).withColumns({"resolved_at": F.when(F.col("status") == "fixed", F.lit("2024-01-01").cast("timestamp")), "attestation": F.lit(None).cast("string")})
    again = w.where("status = 'fixed' and cast(id as long) % 3 = 0").select("id", F.lit("open").alias("to"), F.lit("seen again").alias("attestation"))
    return worklist.moved(w, again, F.lit("2024-02-01").cast("timestamp")).select("id", "status", F.col("resolved_at").isNotNull().alias("resolved"))


UNCOVERED = """
    p AS (SELECT DISTINCT p_type AS path FROM part), covered AS (SELECT DISTINCT p_type AS path FROM part WHERE p_size = 1),
    i AS (SELECT left(sha256('gen:' || path || ':uncovered'), 16) AS id, path, path IN (SELECT path FROM covered) AS covered FROM p)
"""


def _vault(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A vault with a note for each type of part; a registry without cards, and one with cards of the types of size 1."""
    parts = table(spark, d, "part")
    cards = parts.where("p_size = 1").select(F.concat(F.lit("part-"), "p_partkey").alias("slug"), F.col("p_name").alias("front"), F.col("p_comment" if "p_comment" in parts.columns else "p_name").alias("back"), F.array(F.lit("topic::part")).alias("tags"), F.col("p_type").alias("source_path"), F.col("p_partkey").alias("note_id"))
    return parts.select(F.col("p_type").alias("path")), cards.limit(0), cards


@query("wq05_verified", f"WITH {UNCOVERED} SELECT id, path AS source_path, CASE WHEN covered THEN 'fixed' ELSE 'open' END AS status, covered AS resolved FROM i")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All items are claimed to be fixed; those that the scanner still finds are open again."""
    vault, before, after = _vault(spark, d)
    now = F.lit("2024-02-01").cast("timestamp")
    items = worklist.uncovered(vault, before).withColumns({"resolved_at": F.lit(None).cast("timestamp"), "attestation": F.lit(None).cast("string")})
    done = scans.verified(items, items.select("id", F.lit("fixed").alias("to"), F.lit("done").alias("attestation")), worklist.uncovered(vault, after), now)
    return done.select("id", "source_path", "status", F.col("resolved_at").isNotNull().alias("resolved"))


@query("wq06_scan_runs", f"WITH {UNCOVERED} SELECT id, path AS source_path, CASE WHEN covered THEN 'fixed' ELSE 'open' END AS status, CASE WHEN covered THEN 1 ELSE 2 END AS scan_number FROM i")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of the generation loop by its scanner's name: what is covered meanwhile is resolved by the second."""
    vault, before, after = _vault(spark, d)
    store = Store(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    for day, registry in (("2024-02-01", before), ("2024-02-02", after)):
        scans.run(store, {"vault": vault, "registry": registry}, F.lit(day).cast("timestamp"), "generation", ["uncovered"])
    return store.read("work_items").select("id", "source_path", "status", "scan_number")


@query("jn19_deck_cards", "SELECT card_id, ivl, deck FROM cards WHERE deck = '3-MEDIUM'")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Cards with the number of their deck, joined to the deck of a name."""
    number = F.left("deck", F.lit(1)).cast("int")
    cards = c.cards(spark, d).withColumn("deck_id", number).select("card_id", "ivl", "deck_id")
    decks = c.cards(spark, d).select(number.alias("deck_id"), F.col("deck").alias("name")).distinct()
    return reports.cards_of_deck(cards, decks, "3-MEDIUM").select("card_id", "ivl", "deck")


@query("agg12_cluster_tags", """
    WITH k AS (SELECT note_id, tags, note_id % 40 AS c FROM notes), m AS (SELECT c, min(note_id) AS representative, count(*) AS size, list_sort(list_distinct(flatten(list(tags)))) AS t FROM k GROUP BY c),
    x AS (SELECT k.c, list_sort(list_distinct(list(deck))) AS d FROM cards JOIN k USING (note_id) GROUP BY k.c)
    SELECT representative, size, array_to_string(t, '|') AS tags, coalesce(array_to_string(d, '|'), '') AS decks FROM m LEFT JOIN x USING (c)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of equal remainders, with the tags and decks of their members."""
    notes = filters.note_details(c.notes(spark, d), c.cards(spark, d))
    heads = notes.groupBy((F.col("note_id") % 40).alias("c")).agg(F.min("note_id").alias("representative"), F.count("*").alias("size"))
    members = notes.select("note_id", (F.col("note_id") % 40).alias("c")).join(heads, "c").where("note_id <> representative").select("representative", "size", "note_id")
    found = duplicates.listed(members, notes)
    return found.select("representative", "size", F.array_join("tags", "|").alias("tags"), F.array_join("deck_names", "|").alias("decks"))


@query("rag03_few_shot", """
    SELECT left(text, 300) AS question, left(text, 500) AS answer, role AS topic, '' AS difficulty, conv_id || '.md' AS path FROM conversations WHERE role = 'user' ORDER BY length(text) DESC, conv_id * 1000 + turn LIMIT 25""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The longest user turns as examples."""
    hits = table(spark, d, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.char_length("text").alias("score"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("text").alias("content"), F.create_map(F.lit("topic"), "role").alias("metadata"))
    return documents.few_shot(hits, 25, "user")


@query("kg04_gaps", f"WITH {EDGES}, n AS (SELECT source, count(*) AS n FROM e GROUP BY 1) SELECT source, weight FROM e JOIN n USING (source) WHERE target = 7 AND n < 80")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Prerequisites of a node that lead to fewer than 80 others."""
    edges = _edges(spark, d)
    counts = edges.groupBy(F.col("source").alias("topic_id")).agg(F.count("*").alias("note_count"))
    return graph.prerequisite_gaps(edges, 7, counts, 80).select("source", "weight")


DUE = """
    k AS (SELECT card_id, greatest(ivl, 1)::DOUBLE AS ivl, greatest(ease, 1300) / 1000 AS f FROM cards),
    r(card_id, n, due, ivl, f) AS (SELECT card_id, 1, ivl, ivl, f FROM k UNION ALL SELECT card_id, n + 1, due + ivl * pow(f, n), ivl, f FROM r WHERE due <= 30 AND n < 21),
    daily AS (SELECT d::INT AS day, count(card_id) AS reviews FROM range(1, 31) AS x(d) LEFT JOIN r ON floor(due) = d AND due <= 30 GROUP BY 1)
"""


@query("fc01_workload", f"RECURSIVE WITH {DUE} SELECT day, reviews FROM daily")
def _(spark: SparkSession, d: str) -> DataFrame:
    return reports.workload(c.cards(spark, d), 30)


@query("agg18_workload_summary", f"RECURSIVE WITH {DUE} SELECT sum(reviews)::BIGINT AS total, avg(reviews) AS mean, max(reviews) AS peak, max_by(day, (reviews, day)) AS peak_day FROM daily")
def _(spark: SparkSession, d: str) -> DataFrame:
    return reports.workload_summary(reports.workload(c.cards(spark, d), 30))


@query("agg09_covered_tree", "WITH t AS (" + COVERAGE.format(on="a.path = t.path OR starts_with(a.path, t.path || '/')") + ") SELECT topic_id, path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/', 1) END AS parent, note_count, mature_count, weak_notes FROM t")
def _(spark: SparkSession, d: str) -> DataFrame:
    return topics.covered_tree(_coverage(spark, d, True)).select("topic_id", "path", "parent", "note_count", "mature_count", "weak_notes")


@query("snk08_topic_ids", """
    WITH s AS (SELECT n_nationkey AS topic_id, n_name AS path, 'old' AS label FROM nation), f AS (SELECT DISTINCT p_brand AS path, lower(p_brand) AS label FROM part UNION ALL SELECT n_name, lower(n_name) FROM nation WHERE n_nationkey % 2 = 0)
    SELECT coalesce(topic_id, (SELECT max(topic_id) FROM s) + row_number() OVER (PARTITION BY topic_id IS NULL ORDER BY path))::BIGINT AS topic_id, path, coalesce(f.label, s.label) AS label FROM s FULL JOIN f USING (path)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "nation").select(F.col("n_nationkey").alias("topic_id"), F.col("n_name").alias("path"), F.lit("old").alias("label"))
    brands = table(spark, d, "part").select(F.col("p_brand").alias("path")).distinct()
    tree = brands.unionByName(stored.where("topic_id % 2 = 0").select("path"))
    return topics.upserted_ids(stored, tree.withColumn("label", F.lower("path")))


@query("snk14_without_source", f"WITH {EDGES} SELECT source, target FROM e WHERE (source + target) % 3 <> 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d).withColumn("edge_source", F.when((F.col("source") + F.col("target")) % 3 == 0, "tags").otherwise(F.lit(None)))
    return graph.without_source(edges, "tags").select("source", "target")


@query("snk06_stats_without_orphans", "SELECT card_id, CASE WHEN card_id % 4 = 0 THEN reviews ELSE -1 END AS reviews FROM card_stats WHERE card_id % 4 = 0 AND card_id IN (SELECT o_orderkey FROM orders) OR card_id % 3 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of known cards are put in over the stored ones; those of others are skipped, and stored ones stay."""
    stats = c.card_stats(spark, d).select("card_id", "reviews")
    stored = stats.where("card_id % 3 = 0").withColumn("reviews", F.lit(-1).cast("long"))
    return sync.synced_stats(stored, stats, c.cards(spark, d).where("card_id % 4 = 0").select("card_id"))


@query("snk02_upserts", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS v, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS made FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    old = k.where("k % 3 = 0").withColumns({"v": F.lit("old"), "made": F.lit(1)})
    return upserted(old, k.where("k % 2 = 0").withColumns({"v": F.lit("new"), "made": F.lit(2)}), ["k"], keep=("made",))


@query("snk05_inserts", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE 'new' END AS v FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return inserted(k.where("k % 3 = 0").withColumn("v", F.lit("old")), k.where("k % 2 = 0").withColumn("v", F.lit("new")), ["k"])


@query("snk10_incremental_index", "SELECT doc_id AS note_id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE length(text) END::BIGINT AS made FROM documents WHERE text IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Only new and changed chunks are embedded; notes that are gone leave the index."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("note_id"), "text")
    now = sync.chunks(docs, "m")
    other = docs.where("note_id % 3 = 1").withColumn("text", F.concat("text", F.lit("x"))).unionByName(docs.select((-1 - F.col("note_id")).alias("note_id"), "text"))
    index = sync.chunks(docs.where("note_id % 3 = 0").unionByName(other), "m").select("note_id", "chunk_id", "content_hash", F.lit(-1).cast("long").alias("made"))
    return sync.indexed(now.withColumn("made", F.lit(0)).drop("made"), index.withColumnRenamed("made", "vector"), lambda text: F.char_length(text).cast("long")).select("note_id", F.col("vector").alias("made"))


@query("src25_find_cards", "SELECT p_partkey::VARCHAR AS slug FROM part WHERE p_brand = 'Brand#23' AND p_size = 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("slug"), F.col("p_brand").alias("note_id"), F.col("p_size").cast("string").alias("source_path"))
    return cardbook.find_cards(cards, note_id="Brand#23", source_path="10").select("slug")


@query("agg21_registry_counts", "SELECT count(*) AS cards, count(DISTINCT o_custkey) AS notes, count(*) FILTER (o_orderkey % 3 = 0) AS synced, count(*) FILTER (o_orderkey % 3 <> 0) AS unsynced FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("note_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("remote_note_id"))
    return cardbook.counts(o, o)


@query("msc18_derived_cards", """
    SELECT p_partkey, left(sha256(p_name || ':' || p_brand), 32) AS guid, left(sha256(p_type || '|' || p_name), 12) AS content_hash, p_brand || '#' || p_name AS anchor, p_size > 25 AS is_new FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("slug"), F.col("p_brand").alias("source_path"), F.col("p_type").alias("front"), F.col("p_name").alias("back"), F.when(F.col("p_size") <= 25, F.col("p_size")).alias("remote_note_id"))
    return cardbook.derived(cards).select("p_partkey", "guid", "content_hash", "anchor", "is_new")


@query("prj03_deck_names", "SELECT n.note_id, coalesce(array_to_string(list_sort(list(DISTINCT deck) FILTER (deck IS NOT NULL)), '|'), '') AS decks FROM notes n LEFT JOIN cards USING (note_id) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return filters.note_details(c.notes(spark, d), c.cards(spark, d)).select("note_id", F.array_join("deck_names", "|").alias("decks"))


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")


@query("rag04_chunk_store", """
    SELECT vec_id::VARCHAR AS chunk_id, 'f' || (vec_id % 50) AS source, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'two' END AS content, 't' || label AS topic, len(embedding) AS n FROM embeddings WHERE vec_id % 50 <> 7
    UNION ALL SELECT 'added', NULL, NULL, NULL, count(*) FROM embeddings WHERE vec_id % 3 <> 0
    UNION ALL SELECT 'new', NULL, NULL, NULL, count(*) FROM embeddings WHERE vec_id % 3 = 0
    UNION ALL SELECT 'deleted', NULL, NULL, NULL, count(*) FROM embeddings WHERE vec_id % 50 = 7
    UNION ALL SELECT 'files', NULL, NULL, string_agg(DISTINCT 't' || label, '|' ORDER BY 't' || label), count(DISTINCT vec_id % 50) FROM embeddings WHERE vec_id % 50 <> 7""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A collection that gets two thirds of the vectors, then all of them, and loses the chunks of one file."""
    v = table(spark, d, "embeddings")
    topic = F.create_map(F.lit("topic"), F.concat(F.lit("t"), "label"))
    rows = v.select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("f"), F.col("vec_id") % 50).alias("source"), F.lit("one").alias("content"), F.col("embedding").alias("vector"), topic.alias("metadata"), "vec_id")
    some = rows.where("vec_id % 3 <> 0")
    kept = chunk_store.ChunkStore(_store(spark))
    kept.ensure(v.select(F.max(F.size("embedding"))).first()[0])
    added = kept.add(some)
    new = kept.add(rows.withColumn("content", F.when(F.col("vec_id") % 3 == 0, "new").otherwise("two")))
    deleted = kept.delete_by_source(spark.createDataFrame([("f7",)], "source string"))
    counts = spark.createDataFrame([("added", added), ("new", new), ("deleted", deleted)], "chunk_id string, n long")
    none = lambda df: df.select("chunk_id", *[F.lit(None).cast("string").alias(x) for x in ("source", "content")], F.col("topic") if "topic" in df.columns else F.lit(None).cast("string").alias("topic"), "n")
    files = kept.stats().select(F.lit("files").alias("chunk_id"), F.array_join("topics", "|").alias("topic"), F.col("unique_files").alias("n"))
    return kept.rows().select("chunk_id", "source", "content", F.col("metadata")["topic"].alias("topic"), F.size("vector").cast("long").alias("n")).unionByName(none(counts)).unionByName(none(files))


@query("rag04_chunk_search", """
    WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT * FROM embeddings WHERE label = 3),
    s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM q, v),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, id::VARCHAR) AS rank FROM s)
    SELECT query_id, id::VARCHAR AS chunk_id, round(1 / (2 - c), 6) AS similarity, rank FROM r WHERE rank <= 5 AND 1 / (2 - c) >= 0.55""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of one topic nearest to the stated vectors, of at least a similarity."""
    v = table(spark, d, "embeddings")
    kept = chunk_store.ChunkStore(_store(spark))
    kept.ensure(v.select(F.max(F.size("embedding"))).first()[0])
    topic = F.create_map(F.lit("topic"), F.col("label").cast("string"))
    kept.add(v.select(F.col("vec_id").cast("string").alias("chunk_id"), F.lit("f").alias("source"), F.lit("").alias("content"), F.col("embedding").alias("vector"), topic.alias("metadata")))
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return kept.search(asked, 5, "topic", "3", 0.55).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("idx02_index_runs", """
    WITH n AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS k, count(*) FILTER (doc_id % 5 = 0) AS gone, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 3 <> 0) AS fresh, count(*) FILTER (doc_id % 15 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 = 0 AND doc_id % 2 = 0) AS edited, count(*) FILTER (doc_id % 15 = 0) AS both_ FROM documents)
    SELECT 1 AS run, 'missing' AS reason, true AS forced, k AS chunks, k AS embedded, 0::BIGINT AS skipped, 0::BIGINT AS removed_notes FROM n
    UNION ALL SELECT 2, NULL, false, n - gone, fresh + edited, n - gone - fresh - edited, both_ FROM n
    UNION ALL SELECT 3, NULL, false, n - gone, 0, n - gone, 0 FROM n
    UNION ALL SELECT 4, NULL, true, n - gone, n - gone, 0, 0 FROM n
    UNION ALL SELECT 5, 'model mismatch', true, n, n, 0, 0 FROM n
    UNION ALL SELECT 6, 'dimension mismatch', true, n, n, 0, 0 FROM n""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Runs over a third of the documents; over all, with edits and deletions; the same again; forced; with other settings."""
    notes = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), "text", F.lit(False).alias("deleted"))
    edited = notes.withColumns({"text": F.when(F.col("note_id") % 2 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("x"))).otherwise(F.col("text")), "deleted": F.col("note_id") % 5 == 0})
    embed = lambda n: lambda text: ei.mock_vector(ei.embedding_input(F.array(ei.text_part(text))), n)
    store = _store(spark)
    runs = [(notes.where("note_id % 3 = 0"), "m", 4, False), (edited, "m", 4, False), (edited, "m", 4, False), (edited, "m", 4, True), (notes, "other", 4, False), (notes, "other", 8, False)]
    found = [chunk_store.index_notes(store, rows, model, n, embed(n), force) for rows, model, n, force in runs]
    return spark.createDataFrame([(i, *r.values()) for i, r in enumerate(found, 1)], "run int, reason string, forced boolean, chunks long, embedded long, skipped long, removed_notes long")


@query("msc07_embedding_inputs", """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(source, '') AS s FROM documents)
    SELECT doc_id, sha256(encode(CASE WHEN doc_id % 2 = 0 THEN 'RetrievalDocument' || s || '64' ELSE 'Default' END) || '\\xFFtext'::BLOB || encode(x) || CASE WHEN doc_id % 3 = 0 THEN '\\xFFinline_bytesimage/png'::BLOB || encode(s || x) WHEN doc_id % 3 = 1 THEN '\\xFFfile_uriimage/png'::BLOB || encode('f/' || doc_id) ELSE ''::BLOB END) AS digest,
        CASE WHEN doc_id % 3 = 2 THEN x END AS single FROM t""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of text alone, with inlined bytes, and with a file, for two tasks."""
    k, x, s = F.col("doc_id"), F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))
    mime = F.lit("image/png")
    parts = F.when(k % 3 == 0, F.array(ei.text_part(x), ei.inline_part(mime, F.encode(x, "UTF-8"), s))).when(k % 3 == 1, F.array(ei.text_part(x), ei.file_part(mime, F.concat(F.lit("f/"), k)))).otherwise(F.array(ei.text_part(x)))
    given = F.when(k % 2 == 0, ei.embedding_input(parts, "RetrievalDocument", s, 64)).otherwise(ei.embedding_input(parts))
    rows = table(spark, d, "documents").select("doc_id", given.alias("given"))
    return rows.select("doc_id", ei.input_digest(F.col("given")).alias("digest"), ei.single_text(F.col("given")).alias("single"))


@query("snk17_registry_changes", """
    WITH p AS (SELECT p_partkey AS k, p_name AS f FROM part),
    s AS (SELECT k, k % 50 AS note, f AS front, 1 AS made, 1 AS changed FROM p WHERE k % 2 = 0),
    a AS (SELECT * FROM s UNION ALL SELECT k, k % 50, f || '+', CASE WHEN k % 9 = 0 THEN 5 ELSE 2 END, 2 FROM p WHERE k % 3 = 0 AND k % 2 <> 0),
    u AS (SELECT k, note, CASE WHEN k % 5 = 0 THEN 'u' || k ELSE front END AS front, made, CASE WHEN k % 5 = 0 THEN 3 ELSE changed END AS changed FROM a),
    d AS (SELECT * FROM u WHERE k % 7 <> 0),
    m AS (SELECT * FROM d WHERE note NOT IN (4, 8)),
    r AS (SELECT * FROM m UNION ALL SELECT k, 4, 'm', 4, 4 FROM p WHERE k % 11 = 0 AND k NOT IN (SELECT k FROM m))
    SELECT k::VARCHAR AS slug, note::VARCHAR AS note_id, front, made, changed FROM r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Cards added, updated, deleted, and those of two notes replaced, in this order."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n).cast("timestamp")
    none = F.lit(None).cast("timestamp")
    cards = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("slug"), (F.col("p_partkey") % 50).cast("string").alias("note_id"), F.col("p_name").alias("front"), none.alias("created_at"), none.alias("updated_at"))
    k, own = F.col("p_partkey"), ["slug", "note_id", "front", "created_at", "updated_at"]
    rows = cards.where("p_partkey % 2 = 0").select(*own).withColumns({"created_at": day(1), "updated_at": day(1)})
    rows = cardbook.added(rows, cards.where("p_partkey % 3 = 0").withColumns({"front": F.concat("front", F.lit("+")), "created_at": F.when(k % 9 == 0, day(5))}), day(2))
    rows = cardbook.updated(rows, cards.where("p_partkey % 5 = 0").withColumns({"front": F.concat(F.lit("u"), "slug"), "created_at": day(9)}), day(3))
    rows = cardbook.deleted(rows, cards.where("p_partkey % 7 = 0").select("slug"))
    rows = cardbook.mapped(rows, spark.createDataFrame([("4",), ("8",)], "note_id string"), cards.where("p_partkey % 11 = 0").withColumns({"note_id": F.lit("4"), "front": F.lit("m")}), day(4))
    return rows.select("slug", "note_id", "front", *[(F.dayofmonth(x) - 1).alias(y) for x, y in (("created_at", "made"), ("updated_at", "changed"))])
