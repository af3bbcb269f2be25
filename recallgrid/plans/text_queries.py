"""Queries of text, tag and hash functions over texts made from the given tables, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions import hashes, quality, tags, vectors
from recallgrid.functions import text as tx
from recallgrid.operators import documents, reports
from recallgrid.plans.base import query
from recallgrid.plans.registry import _files, _vault
from recallgrid.session import table
from recallgrid.sources import notes
from recallgrid.sources.collection import named_fields, parent_deck, split_tags


def _say(*parts: object) -> F.Column:
    return F.concat(*[p if isinstance(p, F.Column) else F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])


@query("str03_cloze", "SELECT doc_id, 'a ' || lang || ' b ' || source || ' {{c9:: open' AS text FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = _say("a {{c1::", "$lang", "::hint}} b {{c22::", "$source", "}} {{c9:: open")
    return table(spark, d, "documents").select("doc_id", tx.expand_cloze(text).alias("text"))


@query("str01_strip_html_with_code", "SELECT doc_id, 'see `a < ' || lang || '` and `' || source || '` end' AS text FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = _say("<p>see <pre class='x'><code>a &lt; ", "$lang", "</code></pre> and<br><code>", "$source", "</code>&nbsp;<b>end</b></p>")
    return table(spark, d, "documents").select("doc_id", tx.strip_html(text, keep_code=True).alias("text"))


@query("str06_note_text", "SELECT p_partkey, 'Front: ' || p_name || chr(10) || 'Back: ' || p_type || chr(10) || CASE WHEN p_size > 25 THEN 'Extra: ' || p_size || chr(10) ELSE '' END || 'Made by: ' || p_brand || chr(10) || 'Tags: x, y' || chr(10) || 'Decks: d' AS text FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    fields = F.array(field("Question", _say("<b>", "$p_name", "</b>")), field("Made by", F.col("p_brand")), field("Answer", _say("$p_type", "<br>")), field("Hint", F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise(" ")))
    return table(spark, d, "part").select("p_partkey", tx.note_text(fields, F.array(F.lit("x"), F.lit("y")), F.array(F.lit("d"))).alias("text"))


@query("str05_field_roles", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'front' WHEN 1 THEN 'back' WHEN 2 THEN 'extra' ELSE 'other' END AS role FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, ("Sentence", "MEANING", "Examples", "Fronts"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, d, "part").select("p_partkey", tx.field_role(name).alias("role"))


@query("str08_markdown", "SELECT doc_id, '# ' || lang || chr(10) || chr(10) || '- ' || source || chr(10) || 'x' || chr(10) || 'y' AS text FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = _say('<h1 class="t">', "$lang", "</h1><ul><li>", "$source", "</li></ul>x<br/>y<p></p>")
    return table(spark, d, "documents").select("doc_id", tx.html_to_markdown(text).alias("text"))


@query("str09_image_urls", "SELECT page_id, 'https://h.example/' || page_id || '.png|https://cdn.example/x.gif|http://h.example:8/a/rel.jpg|http://o.example/z.png' AS images FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    html = _say('<img alt="" src="https://h.example/', "$page_id", ".png\"><IMG SRC='//cdn.example/x.gif'><img src=\"rel.jpg\"><a href=\"no.png\"><img src=\"http://o.example/z.png\">")
    return table(spark, d, "pages").select("page_id", F.array_join(tx.image_urls(html, F.lit("http://h.example:8/a/page.html")), "|").alias("images"))


@query("str10_embedded_images", "SELECT doc_id, 'a/' || doc_id || '.png|w.gif|b-' || lang || '.jpg' AS images FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = _say("![[ a/", "$doc_id", ".png |200]] ![alt](b-", "$lang", '.jpg "title") ![[w.gif]] ![x](w.gif) [[no.png]]')
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.embedded_images(text), "|").alias("images"))


@query("str12_slugs", "SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(replace(w, 'ß', 's'))), '[ _./\\\\-]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '-'), 50) AS slug FROM (SELECT doc_id, left(array_to_string(regexp_split_to_array(text, '\\s+')[1:2], ' '), 24) || ' Łš_Ćā./' || lang AS w FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = F.left(F.array_join(F.slice(F.split("text", r"(?U)\s+"), 1, 2), " "), F.lit(24))
    return table(spark, d, "documents").select("doc_id", tx.slug(_say(words, " Łš_Ćā./", "$lang")).alias("slug"))


@query("str14_slug_parts", "SELECT p_partkey, 'a' AS topic, 'b-c' AS keyword, p_size::INT AS idx, 'en' AS lang FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    parts = tx.slug_parts(_say("a-b-c-", "$p_size", "-en"))
    return table(spark, d, "part").select("p_partkey", parts["topic"].alias("topic"), parts["keyword"].alias("keyword"), parts["index"].alias("idx"), parts["lang"].alias("lang"))


@query("str15_truncated", "SELECT doc_id, CASE WHEN length(text) <= 120 THEN text WHEN contains(left(text, 120), ' ') THEN regexp_extract(left(text, 120), '(?s)^(.*) ', 1) || '...' ELSE left(text, 120) || '...' END AS text FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.truncated(F.col("text"), 120).alias("text"))


@query("str17_preview_labels", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'asset' ELSE replace(left(lang || chr(10) || source || ' ' || repeat('x', 100), 80), chr(10), ' ') END AS label FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(_say(" ", "$lang", "\n", "$source", " ", "x" * 100))
    return table(spark, d, "documents").select("doc_id", tx.preview_label(text).alias("label"))


@query("str21_titles", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang END AS title FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 > 0, _say("intro\n#  ", "$lang", " \n## no")).otherwise("#no\n## no")
    return table(spark, d, "documents").select("doc_id", tx.title(text).alias("title"))


@query("str22_frontmatter", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'lang: ' || lang END AS front, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'x' || source END AS body FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, _say("---\nlang: ", "$lang", "\n---\n", "$source")).otherwise(_say("x", "$source"))
    return table(spark, d, "documents").select("doc_id", tx.frontmatter(text).alias("front"), tx.body(text).alias("body"))


NOTE = """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(source, '') AS s FROM documents),
    c AS (SELECT doc_id, CASE doc_id % 5
            WHEN 0 THEN '---' || chr(10) || 'title: `T ' || doc_id || '`' || chr(10) || 'tags: [a, 1, yes]' || chr(10) || '---' || chr(10)
            WHEN 1 THEN '---' || chr(10) || '---' || chr(10)
            WHEN 2 THEN '---' || chr(10) || 'title: [1' || chr(10) || '---' || chr(10)
            WHEN 3 THEN '---' || chr(10) || 'title: 7' || chr(10) ELSE '' END AS front,
        'x ![[a b.png]]' || chr(10) || '# Of ' || s || chr(10) || x || chr(10) || '## End ![p](c.svg) ![](a b.png) ![q](d.txt)' || chr(10) || 'y' AS own FROM t),
    b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN front || own ELSE own END AS body FROM c)
"""


@query("src13_note_parts", f"""{NOTE}
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'T ' || doc_id ELSE regexp_extract(body, '(?m)^#\\s+(.+)$', 1) END AS title,
        CASE doc_id % 5 WHEN 0 THEN '["a",1,"yes"]' END AS tags, doc_id % 5 = 2 AS problem, len(regexp_extract_all(body, '(?m)^#{{1,6}}\\s+.+$')) + 1 AS n_sections,
        len(list_distinct(list_concat(regexp_extract_all(body, '!\\[\\[([^\\]]+\\.(?:png|jpe?g|gif|webp|svg))\\]\\]', 1), regexp_extract_all(body, '!\\[[^\\]]*\\]\\(([^)]+\\.(?:png|jpe?g|gif|webp|svg))\\)', 1)))) AS n_images,
        length(body) AS n_body FROM b""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Notes made of whole documents, with frontmatter that is whole, empty, broken, open or missing."""
    k = F.col("doc_id") % 5
    front = F.when(k == 0, _say("---\ntitle: `T ", "$doc_id", "`\ntags: [a, 1, yes]\n---\n")).when(k == 1, "---\n---\n").when(k == 2, "---\ntitle: [1\n---\n").when(k == 3, "---\ntitle: 7\n").otherwise("")
    content = _say(front, "x ![[a b.png]]\n# Of ", F.coalesce("source", F.lit("")), "\n", F.coalesce("text", F.lit("")), "\n## End ![p](c.svg) ![](a b.png) ![q](d.txt)\ny")
    rows = notes.parsed(table(spark, d, "documents").select(F.col("doc_id").alias("path"), content.alias("content")))
    size = lambda c: F.size(c).cast("long")
    return rows.select(
        F.col("path").alias("doc_id"), "title", F.replace(F.col("frontmatter")["tags"], F.lit(", "), F.lit(",")).alias("tags"), F.col("problem").isNotNull().alias("problem"),
        size("sections").alias("n_sections"), size("images").alias("n_images"), F.char_length("body").cast("long").alias("n_body"),
    )


@query("snk19_frontmatter_written", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'a: 1' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || 'body' WHEN 1 THEN '---' || chr(10) || 'lang: ' || lang || chr(10) || 'b: 2' || chr(10) || '---' || chr(10) || 'body' ELSE '---' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || 'body' END AS text FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    text = F.when(k == 0, "---\na: 1\n---\nbody").when(k == 1, "---\nlang: old\nb: 2\n---\nbody").otherwise("body")
    return table(spark, d, "documents").select("doc_id", tx.with_frontmatter(text, "lang", F.col("lang")).alias("text"))


@query("str25_headlines", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'The <b>' || lang || '</b>, ' || lang || 'x' ELSE 'The ' || lang || ', ' || lang || 'x' END AS headline FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.headline(_say("The ", "$lang", ", ", "$lang", "x"), ["EN"]).alias("headline"))


@query("str26_split_csv", "SELECT doc_id, lang || '|' || source AS parts FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.split_csv(_say(" ", "$lang", ",, ", "$source", " ,")), "|").alias("parts"))


@query("dt02_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS written, epoch_us(ts) // 1000000 AS seconds FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    text = tx.rfc3339(ts)
    return table(spark, d, "events").select("event_id", text.alias("written"), F.unix_seconds(tx.parsed_rfc3339(text)).alias("seconds"))


@query("mth02_similarity_of_distance", "SELECT event_id, round(1 / (1 + value), 9) AS s FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(vectors.similarity_of(F.col("value")), 9).alias("s"))


@query("src04_decks_and_fields", "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand || '::' || p_type END AS parent, 'Front=' || p_name || '|Field1=' || p_type AS fields, 'a|b' AS tags FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Raw columns of a collection file: deck names, fields parted by a unit separator, tags by blanks."""
    name = F.when(F.col("p_size") > 10, _say("$p_brand", "::", "$p_type", "::x")).otherwise(F.col("p_brand"))
    fields = F.transform(named_fields(_say("$p_name", "\x1f", "$p_type"), F.array(F.lit("Front"))), lambda f: F.concat_ws("=", f["name"], f["value"]))
    return table(spark, d, "part").select("p_partkey", parent_deck(name).alias("parent"), F.array_join(fields, "|").alias("fields"), F.array_join(split_tags(F.lit("  a b ")), "|").alias("tags"))


@query("hsh04_chunk_ids", "SELECT p_partkey, p_partkey || ':text_primary:' || left(sha256(unhex(array_to_string([substr(h, i, 2) FOR i IN [15, 13, 11, 9, 7, 5, 3, 1]], '')) || 'text_primary'::BLOB || p_brand::BLOB), 12) AS id FROM (SELECT *, lpad(hex(p_partkey), 16, '0') AS h FROM part)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", hashes.chunk_id(F.col("p_partkey"), F.lit("text_primary"), F.col("p_brand")).alias("id"))


TAGGED = "t AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'kotlin_' || lower(p_brand) WHEN 1 THEN 'a/' || lower(p_type) WHEN 2 THEN 'a::b::' || p_size WHEN 3 THEN 'Cs::x' WHEN 4 THEN 'cs::xY' || p_size WHEN 5 THEN 'a::b_' || p_size WHEN 6 THEN 'a--' || p_size ELSE '  ' END AS tag FROM part)"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 8
    forms = (_say("kotlin_", F.lower("p_brand")), _say("a/", F.lower("p_type")), _say("a::b::", "$p_size"), F.lit("Cs::x"), _say("cs::xY", "$p_size"), _say("a::b_", "$p_size"), _say("a--", "$p_size"))
    tag = F.lit("  ")
    for i, form in enumerate(forms):
        tag = F.when(k == i, form).otherwise(tag)
    return table(spark, d, "part").select("p_partkey", tag.alias("tag"))


@query("tag02_tag_problems", f"""
    WITH {TAGGED}
    SELECT p_partkey, 'Tag is empty or whitespace-only' AS problem FROM t WHERE trim(tag) = ''
    UNION ALL SELECT p_partkey, 'Use ''::'' for domain prefix, not ''_'': ''' || tag || ''' -> ''kotlin::' || tag[8:] || '''' FROM t WHERE p_partkey % 8 = 0
    UNION ALL SELECT p_partkey, 'Use ''::'' for hierarchy, not ''/'': ''' || tag || '''' FROM t WHERE p_partkey % 8 = 1
    UNION ALL SELECT p_partkey, 'Tag too deep (max 2 levels): ''' || tag || ''' has 3 levels' FROM t WHERE p_partkey % 8 = 2
    UNION ALL SELECT p_partkey, 'Prefix should be lowercase: ''Cs''' FROM t WHERE p_partkey % 8 = 3
    UNION ALL SELECT p_partkey, 'Topic should be lowercase: ''' || tag[5:] || '''' FROM t WHERE p_partkey % 8 = 4
    UNION ALL SELECT p_partkey, 'Use ''-'' between words, not ''_'': ''' || CASE WHEN p_partkey % 8 = 0 THEN tag ELSE tag[4:] END || '''' FROM t WHERE p_partkey % 8 IN (0, 5)
    UNION ALL SELECT p_partkey, 'Duplicate ''-'' separator found' FROM t WHERE p_partkey % 8 = 6""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("p_partkey", F.explode(tags.problems(F.col("tag"))).alias("problem"))


@query("tag04_kinds", f"WITH {TAGGED} SELECT p_partkey, p_partkey % 8 = 0 AS topic, false AS meta FROM t UNION ALL SELECT -p_partkey, false, true FROM t")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _tagged(spark, d)
    rows = rows.unionByName(rows.select((-F.col("p_partkey")).alias("p_partkey"), _say("lang::", F.trim("tag")).alias("tag")))
    return rows.select("p_partkey", tags.is_topic(F.col("tag")).alias("topic"), tags.is_meta(F.col("tag")).alias("meta"))


@query("set05_tag_lists", "SELECT p_partkey, array_to_string(list_sort(list_distinct(['b-x', trim(regexp_replace(regexp_replace(lower(p_brand), '_|::|/', '-', 'g'), '-{2,}', '-', 'g'), '-'), 'skill::y'])), '|') AS tags FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = F.array(F.lit("B_x"), F.col("p_brand"), F.lit(" skill::y "), F.lit(" "), F.lit("b::x"))
    return table(spark, d, "part").select("p_partkey", F.array_join(tags.canonical_list(raw), "|").alias("tags"))


@query("rag01_chunks", """
    WITH f AS (SELECT 'v/c-' || conv_id || '-' || turn || '.md' AS path, 'c-' || conv_id || '-' || turn AS stem, role, trim(text) AS t, trim('# ' || role || chr(10) || text) AS w FROM conversations),
    c AS (SELECT path, stem || '_' || role || '_' || left(sha256(path), 8) AS chunk_id, 'section' AS kind, t AS x FROM f WHERE strlen(t) >= 50
        UNION ALL SELECT path, stem || '_full_' || left(sha256(path), 8), 'full_content', w FROM f WHERE strlen(t) < 50 AND strlen(w) >= 50)
    SELECT path, chunk_id, kind, CASE WHEN length(x) <= 2000 THEN length(x) WHEN contains(left(x, 2000), ' ') THEN length(regexp_extract(left(x, 2000), '(?s)^(.*) ', 1)) + 3 ELSE 2003 END AS n FROM c""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return documents.chunks(_files(spark, d)).select("path", "chunk_id", "kind", F.char_length("content").cast("long").alias("n"))


@query("rag02_with_metadata", "SELECT doc_id FROM documents WHERE lang = 'en'")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    return documents.with_metadata(docs, "lang", "en").select("doc_id")


@query("udf01_media_refs", "SELECT doc_id, 'a' || doc_id || '.PNG=image|d/' || lang || '.pdf=document|s.mp3=audio' AS refs FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = _say('<img src="./a', "$doc_id", '.PNG?x=1"><a href="d/', "$lang", '.pdf">p</a>[sound:s.mp3][sound:../no.mp3]<img src="http://x/y.png">')
    refs = F.transform(documents.media_refs(text), lambda r: F.concat_ws("=", r["path"], r["modality"]))
    return table(spark, d, "documents").select("doc_id", F.array_join(refs, "|").alias("refs"))


@query("val03_html_issues", """RECURSIVE
    WITH p AS (SELECT page_id, regexp_extract_all(html, '<([^>]*)>', 1) AS raw FROM pages WHERE html IS NOT NULL),
    g AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS i, name, closing, plain, forbidden FROM (
        SELECT page_id, i, name, closing, name NOT IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr') AND NOT ends_with(r, '/') AS plain, name IN ('script', 'style', 'iframe', 'object', 'applet') AS forbidden
        FROM (SELECT page_id, i, raw[i] AS r, lower(regexp_extract(raw[i], '^/?([^\\s/]*)', 1)) AS name, starts_with(raw[i], '/') AS closing FROM p, unnest(range(1, len(raw) + 1)) AS u(i)) WHERE name <> '' AND NOT starts_with(r, '!')) WHERE plain OR forbidden),
    s(page_id, i, stack, message) AS (
        SELECT page_id, 0, []::VARCHAR[], NULL::VARCHAR FROM p
        UNION ALL SELECT s.page_id, g.i, CASE WHEN NOT plain THEN stack WHEN NOT closing THEN list_append(stack, name) WHEN stack[-1] = name THEN stack[:-2] ELSE stack END,
            CASE WHEN plain AND closing AND len(stack) = 0 THEN 'Unexpected closing tag </' || name || '> in back' WHEN plain AND closing AND stack[-1] <> name THEN 'Mismatched closing tag </' || name || '>, expected </' || stack[-1] || '> in back' END
        FROM s JOIN g ON g.page_id = s.page_id AND g.i = s.i + 1)
    SELECT DISTINCT page_id, message FROM s WHERE message IS NOT NULL
    UNION SELECT page_id, 'Forbidden HTML tag <' || name || '> in back' FROM g WHERE forbidden
    UNION SELECT page_id, 'Unclosed tag <' || unnest(stack) || '> in back' FROM s QUALIFY i = max(i) OVER (PARTITION BY page_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").where("html is not null")
    found = pages.select("page_id", F.explode(F.transform(quality.html_issues(F.col("html"), "Back"), lambda i: i["message"])).alias("message"))
    return found.distinct()


@query("jn19_vault_report", "WITH l AS (SELECT doc_id AS s, unnest(list_distinct([doc_id * 2, doc_id * 3 + 1])) AS t FROM documents) SELECT 'd' || t AS target, count(*) AS n FROM l WHERE t NOT IN (SELECT doc_id FROM documents) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Notes that are linked to but aren't there, by how many notes miss them."""
    return reports.links(_vault(spark, d)).where("broken").groupBy("target").agg(F.count("*").alias("n"))
