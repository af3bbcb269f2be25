"""Queries of card validation and stored issues, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions import markup
from recallgrid.operators import cardbook
from recallgrid.plans.base import query
from recallgrid.session import table

#: Cards with something wrong in some column of each few rows.
ODD_CARDS = """
    k AS (SELECT p_partkey AS i, p_partkey % 5 AS a, p_partkey % 7 AS b, p_partkey % 11 AS c, p_partkey % 3 AS d, p_name, p_brand, p_type FROM part),
    r AS (SELECT i, CASE a WHEN 0 THEN '' WHEN 1 THEN 'ab' ELSE 'slug-' || i END AS slug, CASE WHEN b = 0 THEN '' ELSE p_brand END AS slug_base,
        CASE b WHEN 1 THEN 'EN' WHEN 2 THEN 'xx' WHEN 3 THEN 'de' WHEN 4 THEN 'ko' ELSE 'en' END AS lang, CASE WHEN c = 0 THEN '' ELSE p_type END AS source_path,
        CASE WHEN c = 1 THEN '' ELSE 'n' END AS note_id, CASE c WHEN 2 THEN '12345' WHEN 3 THEN '12ab6G' WHEN 4 THEN '12aBcF' END AS hash6,
        CASE c WHEN 5 THEN 1.5 WHEN 6 THEN -2 WHEN 7 THEN 1 END::DOUBLE AS difficulty, CASE b WHEN 5 THEN 'fr' WHEN 2 THEN 'xx' WHEN 3 THEN 'de' WHEN 4 THEN 'ko' ELSE 'en' END AS language,
        CASE d WHEN 0 THEN '  ' || left(p_name, 4) || '  ' ELSE p_name END AS apf_html, CASE d WHEN 1 THEN 'Basic' WHEN 2 THEN 'basic' ELSE 'Cloze' END AS note_type,
        CASE WHEN c = 8 THEN 'other' ELSE slug END AS manifest_slug, lang AS manifest_lang, CASE d WHEN 1 THEN ['a', '', 'b', ''] ELSE ['a'] END AS tags FROM k)
"""


@query("val07_constructor_issues", f"""
    WITH {ODD_CARDS},
    m AS (SELECT *, [CASE WHEN slug = '' THEN 'slug must not be empty' END, CASE WHEN slug_base = '' THEN 'slug_base must not be empty' END,
            CASE WHEN lang NOT IN ('en', 'ru', 'de', 'fr', 'es', 'it', 'pt', 'zh', 'ja', 'ko') THEN 'lang must be a valid 2-letter language code, got ''' || lang || '''' END,
            CASE WHEN source_path = '' THEN 'source_path must not be empty' END, CASE WHEN note_id = '' THEN 'note_id must not be empty' END,
            CASE WHEN NOT regexp_full_match(hash6, '[0-9a-fA-F]{{6}}') THEN 'hash6 must be exactly 6 hex chars, got ''' || hash6 || '''' END,
            CASE WHEN difficulty NOT BETWEEN 0 AND 1 THEN 'difficulty must be in [0.0, 1.0], got ' || CASE difficulty WHEN 1.5 THEN '1.5' ELSE '-2' END END] AS e FROM r),
    n AS (SELECT *, [x FOR x IN e IF x IS NOT NULL] AS found, [CASE WHEN slug <> '' AND strlen(slug) < 3 THEN 'slug must be at least 3 chars, got ''' || slug || '''' END,
            CASE WHEN strlen(trim(apf_html)) < 10 THEN 'apf_html must be at least 10 chars after trim' END,
            CASE WHEN note_type = 'basic' THEN 'note_type must be one of ["APF::Simple", "APF::Cloze", "Basic", "Cloze", "ImageOcclusion"], got ''basic''' END,
            CASE WHEN manifest_slug <> slug THEN 'slug mismatch: card slug ''' || slug || ''' != manifest slug ''' || manifest_slug || '''' END,
            CASE WHEN manifest_lang <> language THEN 'language mismatch: card language ''' || language || ''' != manifest lang ''' || manifest_lang || '''' END,
            CASE WHEN len(tags) > 1 THEN 'tag at index 1 must not be empty' END, CASE WHEN len(tags) > 1 THEN 'tag at index 3 must not be empty' END] AS own FROM m),
    o AS (SELECT i, CASE WHEN len(found) > 0 THEN found ELSE [x FOR x IN own IF x IS NOT NULL] END AS x FROM n)
    SELECT i AS p_partkey, array_to_string(x, '|') AS messages FROM o WHERE len(x) > 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    i, name = F.col("p_partkey"), F.col("p_name")
    a, b, n, m = i % 5, i % 7, i % 11, i % 3
    slug = F.when(a == 0, "").when(a == 1, "ab").otherwise(F.concat(F.lit("slug-"), i))
    lang = F.when(b == 1, "EN").when(b == 2, "xx").when(b == 3, "de").when(b == 4, "ko").otherwise("en")
    own = F.when(b == 5, "fr").when(b == 1, "en").otherwise(lang)
    texts = {
        "slug": slug, "slug_base": F.when(b == 0, "").otherwise(F.col("p_brand")), "lang": lang, "source_path": F.when(n == 0, "").otherwise(F.col("p_type")), "source_anchor": F.lit("a"),
        "note_id": F.when(n == 1, "").otherwise("n"), "note_title": name, "hash6": F.when(n == 2, "12345").when(n == 3, "12ab6G").when(n == 4, "12aBcF"), "difficulty": F.when(n == 5, 1.5).when(n == 6, -2.0).when(n == 7, 1.0),
        "language": own, "apf_html": F.when(m == 0, F.concat(F.lit("  "), F.left(name, F.lit(4)), F.lit("  "))).otherwise(name), "note_type": F.when(m == 1, "Basic").when(m == 2, "basic").otherwise("Cloze"),
        "manifest_slug": F.when(n == 8, "other").otherwise(slug), "manifest_lang": lang, "tags": F.when(m == 1, F.array(*map(F.lit, ("a", "", "b", "")))).otherwise(F.array(F.lit("a"))),
    }
    cards = table(spark, d, "part").select(i, *[x.alias(c) for c, x in texts.items()])
    found = cardbook.constructor_issues(cards, "p_partkey").groupBy("p_partkey").agg(F.sort_array(F.collect_list(F.struct("at", "message"))).alias("m"))
    return found.select("p_partkey", F.array_join("m.message", "|").alias("messages"))


@query("val07_sync_actions", "SELECT o_orderkey, upper(t) || ': s' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN ' (' || o_orderpriority || ')' ELSE '' END AS described, CASE WHEN t IN ('update', 'delete') AND o_orderkey % 5 = 0 THEN 'anki_guid is required for UPDATE/DELETE actions' END AS error FROM (SELECT *, ['create', 'update', 'delete', 'skip'][o_orderkey % 4 + 1] AS t FROM orders)")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("create", "update", "delete", "skip")))
    actions = table(spark, d, "orders").select(k, F.get(kinds, (k % 4).cast("int")).alias("action_type"), F.when(k % 5 != 0, "g").alias("anki_guid"), F.concat(F.lit("s"), k).alias("slug"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("reason"))
    return actions.select("o_orderkey", cardbook.described().alias("described"), F.get(cardbook.action_errors(), F.lit(0)).alias("error"))


#: Stored issues of every kind, some with a field missing or of another type, some of no kind, some broken.
STORED_KINDS = (
    '{"kind":"low_quality","dimension":"clarity","score":0.25}', '{"kind":"low_quality","dimension":"clarity"}', '{"kind":"low_quality","dimension":3,"score":1}', '{"kind":"validation_error","severity":"error","message":"m"}',
    '{"kind":"validation_error","message":"m"}', '{"kind":"duplicate","other_slug":"s","similarity":1}', '{"kind":"semantic_overlap","other_slug":"s","similarity":"0.9"}', '{"kind":"split_candidate","suggested_count":3}',
    '{"kind":"split_candidate","suggested_count":-3}', '{"kind":"split_candidate","suggested_count":2.5}', '{"kind":"dead_skill","extra":[1]}', '{"kind":"missing_tags"}', '{"kind":"uncovered_topic","topic":"t"}', '{"kind":"uncovered_topic"}',
    '{"kind":"missing_language","expected":"de"}', '{"kind":"LowQuality","dimension":"clarity","score":1}', '{"dimension":"clarity","score":1}', '{broken', '[]', 'null', '{"kind":"split_candidate","suggested_count":4294967296}',
)


@query("jsn02_issue_kinds", """
    WITH t AS (SELECT o_orderkey, LIST[o_orderkey % 22 + 1] AS j FROM orders), v AS (SELECT o_orderkey, CASE WHEN json_valid(j) THEN j END AS j FROM t),
    f AS (SELECT o_orderkey, CASE WHEN json_type(j, '$.kind') = 'VARCHAR' THEN j ->> '$.kind' END AS k, j, json_type(j, '$.dimension') = 'VARCHAR' AS dim, coalesce(json_type(j, '$.score') IN ('DOUBLE', 'UBIGINT', 'BIGINT'), false) AS score,
        json_type(j, '$.severity') = 'VARCHAR' AS severity, json_type(j, '$.message') = 'VARCHAR' AS message, json_type(j, '$.other_slug') = 'VARCHAR' AS slug, json_type(j, '$.similarity') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AS sim,
        json_type(j, '$.suggested_count') = 'UBIGINT' AND (j ->> '$.suggested_count')::DOUBLE < 4294967296 AS n, json_type(j, '$.topic') = 'VARCHAR' AS topic, json_type(j, '$.expected') = 'VARCHAR' AS expected FROM v),
    g AS (SELECT *, coalesce(CASE k WHEN 'low_quality' THEN dim AND score WHEN 'validation_error' THEN severity AND message WHEN 'duplicate' THEN slug AND sim WHEN 'semantic_overlap' THEN slug AND sim
        WHEN 'split_candidate' THEN n WHEN 'uncovered_topic' THEN topic WHEN 'missing_language' THEN expected ELSE k IN ('stale_content', 'dead_skill', 'missing_tags') END, false) AS good FROM f)
    SELECT o_orderkey, CASE WHEN good THEN k ELSE 'stale_content' END AS kind, CASE WHEN good AND k = 'low_quality' THEN j ->> '$.dimension' END AS dimension, CASE WHEN good AND k = 'low_quality' THEN (j ->> '$.score')::DOUBLE END AS score,
        CASE WHEN good AND k = 'validation_error' THEN j ->> '$.severity' END AS severity, CASE WHEN good AND k IN ('duplicate', 'semantic_overlap') THEN (j ->> '$.similarity')::DOUBLE END AS similarity,
        CASE WHEN good AND k = 'split_candidate' THEN (j ->> '$.suggested_count')::BIGINT END AS suggested_count, CASE WHEN good AND k = 'missing_language' THEN j ->> '$.expected' END AS expected FROM g""".replace("LIST", "[" + ", ".join(f"'{x}'" for x in STORED_KINDS) + ", NULL]"))
def _(spark: SparkSession, d: str) -> DataFrame:
    texts = F.array(*map(F.lit, STORED_KINDS), F.lit(None))
    stored = table(spark, d, "orders").select("o_orderkey", F.get(texts, (F.col("o_orderkey") % 22).cast("int")).alias("issue_kind"))
    return cardbook.parsed_kinds(stored).select("o_orderkey", "kind", "dimension", "score", "severity", "similarity", "suggested_count", "expected")


#: Lines from which card texts are put together, each at a place that follows from the key.
LINES = (
    "plain text", "**bold** and *it*", "```python", "```", "`odd tick", "<b>tag</b>", "<pre>a</pre>", "<pre> <code>x ** y</code></pre>", "<code>inline</code>", "** open bold", "x" * 210, "  ``` indented", "<!-- BEGIN_CARDS -->",
    "<!-- END_CARDS -->", "<!-- Card 1 | slug -->", "<!-- Title -->", "<!-- Key point notes -->", '{"slug": "s **"}', "",
)
PLACES = ((1, 1), (3, 2), (7, 3), (5, 1), (11, 4), (13, 5), (2, 7))
_LIST = f"[{', '.join(chr(39) + x + chr(39) for x in LINES)}]"
TEXTS = f"a AS (SELECT c_custkey AS k, {_LIST} AS a FROM customer), l AS (SELECT k, [" + ", ".join(f"a[(k * {m} // {q}) % {len(LINES)} + 1]" for m, q in PLACES) + "] AS l FROM a)"
#: Of the lines l: whether a line is after an open fence, the text outside code, and what is wrong there.
FENCED = """
    f1 AS (SELECT *, [len([1 FOR y, j IN l IF j < i AND starts_with(trim(y), '```')]) % 2 = 1 FOR x, i IN l] AS inside, len([1 FOR x IN l IF starts_with(trim(x), '```')]) AS fences,
        coalesce(list_max([i FOR x, i IN l IF starts_with(trim(x), '```')]), 0) AS last FROM {source}),
    f2 AS (SELECT *, array_to_string([x || chr(10) FOR x, i IN l IF NOT starts_with(trim(x), '```') AND (NOT inside[i] OR fences % 2 = 1 AND i > last)], '') AS o FROM f1),
    f3 AS (SELECT *, [e FOR e IN [CASE WHEN fences % 2 = 1 THEN 'Unclosed code fence detected' END, CASE WHEN (length(o) - length(replace(o, '`', ''))) % 2 = 1 THEN 'Unbalanced backtick markers detected' END,
            CASE WHEN ((length(o) - length(replace(o, '**', ''))) // 2) % 2 = 1 THEN 'Unbalanced bold markers (**) detected' END] IF e IS NOT NULL] AS errors,
        list_concat(['Line exceeds 200 characters in code block (' || strlen(x) || ' chars)' FOR x, i IN l IF inside[i] AND strlen(x) > 200 AND NOT starts_with(trim(x), '```')],
            [w FOR w IN [CASE WHEN regexp_matches(o, '<[a-zA-Z][a-zA-Z0-9]*[^>]*>') THEN 'HTML tags detected in markdown content' END] IF w IS NOT NULL]) AS warnings FROM f2)
"""


def _made(spark: SparkSession, d: str) -> DataFrame:
    lines = F.array(*map(F.lit, LINES))
    at = [F.get(lines, (F.floor(F.col("c_custkey") * m / q) % len(LINES)).cast("int")) for m, q in PLACES]
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.array_join(F.array(*at), "\n").alias("text"))


def _judged(rows: DataFrame) -> DataFrame:
    return rows.select("k", "r.is_valid", F.array_join("r.errors", "|").alias("errors"), F.array_join("r.warnings", "|").alias("warnings"))


@query("val09_card_html", f"""
    WITH {TEXTS}, t AS (SELECT k, array_to_string(l, chr(10)) AS t FROM l), s AS (SELECT *, regexp_replace(t, '<pre>(?:.|\\n)*?</pre>', '', 'g') AS s, regexp_replace(t, '^(?:.|\\n)*<pre>\\s*<code[\\s>]', '') AS tail FROM t)
    SELECT k, array_to_string(list_concat([e FOR e IN [CASE WHEN contains(t, '```') THEN 'Backtick code fence detected; use <pre><code> in HTML' END, CASE WHEN contains(s, '**') THEN 'Markdown bold markers (**) detected in HTML' END,
            CASE WHEN contains(replace(s, '**', ''), '*') THEN 'Markdown italic markers (*) detected in HTML' END] IF e IS NOT NULL],
        ['<pre> without nested <code> tag detected' FOR x IN range((length(tail) - length(replace(tail, '<pre>', ''))) // 5)], CASE WHEN contains(s, '<code>') THEN ['Inline <code> outside <pre> detected'] ELSE [] END), '|') AS errors FROM s""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d).select("k", F.array_join(markup.card_html_errors(F.col("text")), "|").alias("errors"))


@query("val09_markdown", f"""
    WITH {TEXTS}, {FENCED.format(source="l")}
    SELECT k, len(errors) = 0 AS is_valid, array_to_string(errors, '|') AS errors, array_to_string(warnings, '|') AS warnings FROM f3""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _judged(_made(spark, d).select("k", markup.markdown_issues(F.col("text")).alias("r")))


@query("val09_card_markdown", f"""
    WITH {TEXTS}, b AS (SELECT k, array_to_string(l, chr(10)) AS t, [x FOR x IN l IF NOT starts_with(trim(x), '<!--') AND NOT starts_with(trim(x), '{{"slug"')] AS l FROM l), {FENCED.format(source="b")},
    e AS (SELECT *, list_concat([x FOR x IN [CASE WHEN NOT contains(t, '<!-- BEGIN_CARDS -->') THEN 'Missing BEGIN_CARDS sentinel' END, CASE WHEN NOT contains(t, '<!-- END_CARDS -->') THEN 'Missing END_CARDS sentinel' END,
            CASE WHEN NOT contains(t, '<!-- Card 1') THEN 'No card header found (expected <!-- Card N ... -->)' END, CASE WHEN NOT contains(t, '<!-- Title -->') THEN 'Missing Title section' END] IF x IS NOT NULL], errors) AS every FROM f3)
    SELECT k, len(every) = 0 AS is_valid, array_to_string(every, '|') AS errors, array_to_string(list_concat(CASE WHEN contains(t, '<!-- Key point notes -->') THEN [] ELSE ['Missing Key point sections'] END, warnings), '|') AS warnings FROM e""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _judged(_made(spark, d).select("k", markup.card_markdown_issues(F.col("text")).alias("r")))
