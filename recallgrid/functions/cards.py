"""The text format of generated cards: parsing into blocks, and its rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
HEADER = r"<!-- Card \d+ \| slug: ([^ |]+) \| CardType: ([^ |]+) \| Tags: (.*?) -->"
SENTINELS = (("<!-- PROMPT_VERSION: apf-v2.1 -->", "PROMPT_VERSION"), ("<!-- BEGIN_CARDS -->", "BEGIN_CARDS"), ("<!-- END_CARDS -->", "END_CARDS"), ("END_OF_CARDS", "END_OF_CARDS"))
HEADINGS = (("<!-- Title -->", "Title"), ("<!-- Key point (code block", "Key point"), ("<!-- Key point notes -->", "Key point notes"))
WIDTH, FEWEST, MOST = 88, 3, 6


def blocks(text: Column) -> Column:
    """The cards of a text as (slug, card_type, tags, content); a card ends at the next, a separator or the end mark."""
    parts = F.filter(F.split(text, r"(?m)(?=^.*<!-- Card \d+ \|)"), lambda p: p.rlike(HEADER))
    cut = lambda p: F.regexp_replace(F.regexp_replace(p, r"(?s)^[^\n]*\n?", ""), r"(?s)(?:^|\n)[^\n]*<!-- (?:END_CARDS|CARD_SEPARATOR) -->.*", "")
    tags = lambda p: F.filter(F.split(F.btrim(F.regexp_extract(p, HEADER, 3)), " "), lambda t: t != "")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, HEADER, 1).alias("slug"), F.regexp_extract(p, HEADER, 2).alias("card_type"), tags(p).alias("tags"), cut(p).alias("content")))


def rendered(slug: Column, card_type: Column, tags: Column, title: Column, key_point: Column, notes: Column, index: int = 1) -> Column:
    """One card in the format, with its manifest line."""
    manifest = F.to_json(F.struct(slug.alias("slug"), card_type.alias("type"), tags.alias("tags")))
    head = F.concat(F.lit(f"<!-- Card {index} | slug: "), slug, F.lit(" | CardType: "), card_type, F.lit(" | Tags: "), F.array_join(tags, " "), F.lit(" -->"))
    return F.concat_ws("\n", head, F.lit("<!-- Title -->"), title, F.lit("<!-- Key point (code block / image) -->"), key_point, F.lit("<!-- Key point notes -->"), notes, F.concat(F.lit("<!-- manifest: "), manifest, F.lit(" -->")))


def document(cards: Column) -> Column:
    """Rendered cards between the format's sentinels."""
    body = F.array_join(cards, "\n<!-- CARD_SEPARATOR -->\n")
    return F.concat_ws("\n", F.lit(SENTINELS[0][0]), F.lit(SENTINELS[1][0]), body, F.lit(SENTINELS[2][0]), F.lit(SENTINELS[3][0]))


def lint(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, severity, message) for each violated rule of each text: sentinels, width, slugs, tags, headings, manifest,
    dense cloze numbers."""
    text = F.col(text_col)
    say = lambda severity, message: F.struct(F.lit(severity).alias("severity"), message.alias("message"))
    at = rows.select(F.col(id_col).alias("__id"), text.alias("text"), blocks(text).alias("blocks"))
    missing = F.array_compact(F.array(*[F.when(~F.col("text").contains(mark), say("error", F.lit(f"Missing {name} sentinel"))) for mark, name in SENTINELS]))
    wide = F.array_compact(F.transform(F.split("text", r"\r?\n"), lambda x, i: F.when((F.octet_length(x) > WIDTH) & ~x.startswith("<!-- manifest:"), say("warning", F.format_string(f"Line %d exceeds {WIDTH} character width limit", i + 1)))))
    none = F.when(F.size("blocks") == 0, F.array(say("error", F.lit("No Card blocks found")))).otherwise(F.array().cast("array<struct<severity:string,message:string>>"))
    slugs = F.transform("blocks", lambda b: b["slug"])
    twice = F.array_compact(F.transform(slugs, lambda s, i: F.when(F.array_position(slugs, s) - 1 < i, say("error", F.concat(F.lit("Duplicate slug: "), s)))))
    whole = at.select("__id", F.explode(F.concat(missing, wide, none, twice)).alias("i"))

    b = at.select("__id", F.explode("blocks").alias("b")).select("__id", "b.*")
    manifest = F.nullif(F.regexp_extract("content", r"(?m)^<!-- manifest:(.*) -->$", 1), F.lit(""))
    parsed = F.from_json(manifest, "slug string, tags array<string>, _corrupt_record string")
    numbers = F.transform(F.regexp_extract_all("content", F.lit(r"\{\{c(\d+)::"), F.lit(1)), lambda n: n.try_cast("int"))
    b = b.withColumns({"manifest": manifest, "parsed": parsed, "numbers": numbers})
    n = F.size("tags")
    card = lambda message: F.concat(F.lit("Card "), "slug", F.lit(": "), message if isinstance(message, Column) else F.lit(message))
    valid = F.col("manifest").isNotNull() & F.col("parsed._corrupt_record").isNull()
    rules = [
        ((n == 1) & F.get("tags", F.lit(0)).contains(","), "error", "tags must be space-separated, not comma-separated"),
        ((n < FEWEST) | (n > MOST), "error", F.format_string(f"expected {FEWEST}-{MOST} tags, found %d", n)),
        (F.exists("tags", lambda t: t != F.lower(t)), "warning", "tags should be lowercase"),
        *[(~F.col("content").contains(mark), "error", f"missing {name} header") for mark, name in HEADINGS],
        (F.col("manifest").isNull(), "error", "missing manifest"),
        (F.col("parsed._corrupt_record").isNotNull(), "error", "invalid manifest JSON"),
        (valid & (F.col("parsed.slug") != F.col("slug")), "error", F.format_string("manifest slug mismatch (header: %s, manifest: %s)", "slug", "parsed.slug")),
        (valid & F.col("parsed.tags").isNotNull() & (F.col("parsed.tags") != F.col("tags")), "warning", "manifest tags don't match header tags"),
        ((F.col("card_type") == "Missing") & (F.size("numbers") == 0), "warning", "Missing type has no cloze deletions"),
        ((F.col("card_type") == "Missing") & (F.size("numbers") > 0) & (F.array_max("numbers") != F.size(F.array_distinct("numbers"))), "error", "Cloze numbering is not dense (gaps detected)"),
    ]
    each = F.array_compact(F.array(*[F.when(condition, say(severity, card(message))) for condition, severity, message in rules]))
    found = whole.unionByName(b.select("__id", F.explode(each).alias("i")))
    return found.select(F.col("__id").alias(id_col), "i.severity", "i.message")
