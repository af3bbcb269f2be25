"""The dealt operators as registered queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recallgrid.llm import chat, decontaminate, langid, lexical_index, licenses, line_dedup, packing, prefix_trie, secrets, warc
from recallgrid.llm.embedding_dedup import near_duplicate_vectors
from recallgrid.llm.html_extract import main_texts
from recallgrid.llm.near_dedup import near_duplicates
from recallgrid.session import table


def op1_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op2_edit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op4_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_template_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op6_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op7_license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.every_match(table(spark, sf_dir, "documents"))


def op8_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents")).drop("hilbert")


def op9_byte_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op11_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op12_length_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_tool_links": op1_tool_links,
    "op2_edit_lines": op2_edit_lines,
    "op3_hyperminhash": op3_hyperminhash,
    "op4_prefix_filter": op4_prefix_filter,
    "op5_template_classes": op5_template_classes,
    "op6_sorted_projections": op6_sorted_projections,
    "op7_license_alignment": op7_license_alignment,
    "op8_hilbert_packing": op8_hilbert_packing,
    "op9_byte_recurrence": op9_byte_recurrence,
    "op10_warc": op10_warc,
    "op11_token_efficiency": op11_token_efficiency,
    "op12_length_strata": op12_length_strata,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op1_tool_links": """
        WITH m AS (
            SELECT *, role = 'user' AND turn > 0 AS answers,
                CASE WHEN role = 'assistant' THEN '{"content":null,"role":"assistant","tool_calls":[{"function":{"arguments":{"n_chars":' || length(text) || ',"text":' || to_json(text) || '},"name":"reply"},"id":"call-' || turn || '","type":"function"}]}'
                    WHEN role = 'user' AND turn > 0 THEN '{"content":' || to_json(text) || ',"role":"tool","tool_call_id":"call-' || (turn - 1) || '"}'
                    ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' END AS j
            FROM conversations)
        SELECT m.conv_id, m.turn, CASE WHEN m.answers AND c.turn IS NOT NULL THEN c.turn ELSE m.turn END AS anchor_turn, CASE WHEN m.answers AND c.turn IS NOT NULL THEN 1 ELSE 0 END AS slot,
            (m.role = 'assistant')::INT AS n_calls, (m.role = 'assistant' AND r.turn IS NOT NULL)::BIGINT AS n_answered, CASE WHEN m.answers THEN c.turn IS NOT NULL END AS linked,
            CASE WHEN m.role = 'assistant' THEN (length(m.text) NOT BETWEEN 1 AND 1200)::INT + (length(m.text) < 1)::INT ELSE 0 END AS n_errors, sha256(m.j) AS json_sha256
        FROM m LEFT JOIN m c ON c.conv_id = m.conv_id AND c.turn = m.turn - 1 AND c.role = 'assistant'
            LEFT JOIN m r ON r.conv_id = m.conv_id AND r.turn = m.turn + 1 AND r.answers
    """,
    "op2_edit_lines": """
        WITH RECURSIVE p AS (
            SELECT doc_id, i - 1 AS line_no, trim(regexp_replace(l[i], '[\\x09-\\x0D ]+', ' ', 'g'), ' ') AS body
            FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)),
        g AS (
            SELECT *, row_number() OVER (ORDER BY head_doc, head_line) AS id
            FROM (SELECT body, count(*) AS n_copies, arg_min(doc_id, (doc_id, line_no)) AS head_doc, arg_min(line_no, (doc_id, line_no)) AS head_line FROM p WHERE body <> '' GROUP BY body)),
        l AS (
            SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.id <> b.id AND length(b.body) BETWEEN length(a.body) - 2 AND length(a.body) + 2
            WHERE length(a.body) >= 20 AND length(b.body) >= 20 AND levenshtein(a.body, b.body) <= 2),
        r(id, c) AS (SELECT id, id FROM g UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
        m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
        SELECT p.doc_id, p.line_no::INT AS line_no, g.n_copies, (SELECT count(*) FROM l WHERE l.a = g.id) AS n_links, h.head_doc, h.head_line::INT AS head_line,
            p.doc_id = h.head_doc AND p.line_no = h.head_line AS kept
        FROM p JOIN g USING (body) JOIN m ON m.id = g.id JOIN g h ON h.id = m.c
    """,
    "op4_prefix_filter": """
        WITH w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
            FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS u(i) WHERE len(w) > 0),
        d AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
            FROM w, (SELECT DISTINCT n FROM win) k, unnest(range(1, len(w) - n + 2)) AS u(i)),
        h AS (SELECT doc_id, item_id, i, d.n FROM d JOIN win USING (n, s)),
        n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + h.n)) AS u(p) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op3_hyperminhash": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c::BIGINT AS component_id, d.doc_id = m.c AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = d.doc_id
    """,
    "op6_sorted_projections": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CASE WHEN list_count(embedding) = len(embedding) AND isfinite(s) AND s > 0 THEN [x::DOUBLE FOR x IN embedding] END AS v
            FROM (SELECT *, list_sum([x::DOUBLE * x FOR x IN embedding]) AS s FROM embeddings)),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
        r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept
        FROM v JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = vec_id
    """,
    "op12_length_strata": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
        s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
        m AS (SELECT doc_id, w, 50 + (50 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
        p AS (SELECT doc_id, m, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, m, unnest(w) AS t FROM m) GROUP BY ALL),
        f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t, n_docs),
        x AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM b JOIN f USING (t) JOIN p USING (t) GROUP BY ALL)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 50
    """,
    "op13_prefix_trie": """
        WITH t AS (
            SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (
            SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
                lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, i: xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 6 AS h FROM t),
        r AS (SELECT h.conv_id, list_concat(coalesce(t.own[1:h], []), h.own[h + 1:]) AS s FROM h LEFT JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100),
        p AS (SELECT conv_id, len(s) AS n, d AS depth, s[1:d] AS k FROM r, unnest(range(0, len(s) + 1)) AS u(d)),
        n AS (
            SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(k[depth].text) END AS saved,
                string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth) AS ends FROM p GROUP BY k, depth),
        c AS (SELECT k[1:depth - 1] AS k, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
        e AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (k, depth)),
        s AS (SELECT k[1:i] AS k, i AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM e, unnest(range(0, depth + 1)) AS u(i) GROUP BY ALL)
        SELECT e.conv_id, e.depth, up.conv_id AS parent_conv_id, e.n_convs, e.n_children, n_leaves, saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
        FROM e JOIN s USING (k, depth) LEFT JOIN n up ON up.depth = e.depth - 1 AND up.k = e.k[1:e.depth - 1]
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
}
