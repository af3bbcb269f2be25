"""Tags: canonical form, validation and suggestions. The vocabulary of known tags is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.text import trimmed

# Fixed values of the rules.
META_PREFIXES = ("difficulty::", "lang::", "source::", "context::", "skill::")
TOPIC_PREFIXES = ("kotlin_", "android_", "cs_", "bias_")


def is_meta(tag: Column) -> Column:
    return tag.rlike("^(?:" + "|".join(META_PREFIXES) + ")")


def is_topic(tag: Column) -> Column:
    return tag.rlike("^(?:" + "|".join(TOPIC_PREFIXES) + ")") | (tag == "cognitive_bias")


def canonical(tag: Column, mapped: Column | None = None) -> Column:
    """Meta and topic tags stay, known ones become their mapping, others kebab case."""
    tag = trimmed(tag)
    own = F.when(is_meta(tag) | is_topic(tag), tag)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(tag), "_|::|/", "-"), "-{2,}", "-"), "^-+|-+$", "")
    return F.coalesce(own, mapped, bare) if mapped is not None else F.coalesce(own, bare)


def canonical_list(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: canonical(t)), lambda t: t != "")))


def problems(tag: Column, known: Column | None = None) -> Column:
    """What is wrong with a tag, as messages in a fixed order. ``known`` says whether it is a topic tag of the vocabulary,
    which may have underscores."""
    tag = trimmed(tag)
    spared = (tag == "cognitive_bias") | (F.lit(False) if known is None else F.coalesce(known, F.lit(False)))
    domain = F.regexp_extract(tag, "^(" + "|".join(p[:-1] for p in TOPIC_PREFIXES) + ")_", 1)
    offending = F.get(F.filter(F.split(tag, "::"), lambda p: p.contains("_")), F.lit(0))
    parts = F.split(tag, "::")
    head = F.get(parts, F.lit(0))
    second = F.get(parts, F.lit(1))
    nested = F.size(parts) > 1
    found = F.array(
        F.when(tag == "", "Tag is empty or whitespace-only"),
        F.when((domain != "") & ~spared, F.concat(F.lit("Use '::' for domain prefix, not '_': '"), tag, F.lit("' -> '"), domain, F.lit("::"), F.substring(tag, F.char_length(domain) + 2, F.char_length(tag)), F.lit("'"))),
        F.when(tag.contains("/"), F.concat(F.lit("Use '::' for hierarchy, not '/': '"), tag, F.lit("'"))),
        F.when(F.size(parts) > 2, F.concat(F.lit("Tag too deep (max 2 levels): '"), tag, F.lit("' has "), F.size(parts), F.lit(" levels"))),
        F.when(nested & (head != F.lower(head)), F.concat(F.lit("Prefix should be lowercase: '"), head, F.lit("'"))),
        F.when(nested & (second != F.lower(second)) & ~second.rlike(r"^\p{Lu}"), F.concat(F.lit("Topic should be lowercase: '"), second, F.lit("'"))),
        F.when(offending.isNotNull() & ~spared, F.concat(F.lit("Use '-' between words, not '_': '"), offending, F.lit("'"))),
        F.when(tag.contains("::::"), "Duplicate '::' separator found"),
        F.when(tag.contains("--"), "Duplicate '-' separator found"),
    )
    return F.array_compact(found)


def distance(a: Column, b: Column) -> Column:
    """0 if one starts with the other, else differing positions plus the difference of the lengths in bytes."""
    x, y = F.lower(a), F.lower(b)
    each = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.when(p.isNotNull() & q.isNotNull() & (p != q), 1).otherwise(0))
    differ = F.aggregate(each, F.lit(0), lambda n, d: n + d) + F.abs(F.octet_length(a) - F.octet_length(b))
    return F.when(F.startswith(x, y) | F.startswith(y, x), 0).otherwise(differ)


def _segments(text: Column, within: int) -> Column:
    """Keys of the texts that differ from one in ``within`` places at most: for each length that the shorter one can have,
    the parts of that many characters, one more than differences; of two such texts a part is equal.

    Texts whose bytes differ by ``within`` at most can differ by three times as many characters.
    """
    parts = within + 1
    key = lambda m: F.transform(F.sequence(F.lit(0), F.lit(within)), lambda i: F.concat_ws("\x00", m.cast("string"), i.cast("string"), F.substring(text, (F.floor(m * i / parts) + 1).cast("int"), (F.floor(m * (i + 1) / parts) - F.floor(m * i / parts)).cast("int"))))
    n = F.char_length(text)
    return F.flatten(F.transform(F.sequence(F.greatest(n - 3 * within, F.lit(0)), n), key))


def _prefixes(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda n: F.left(text, n))


def suggestions(tags: DataFrame, vocabulary: DataFrame, most: int = 3, within: int = 2) -> DataFrame:
    """(tag, suggestion, distance): up to ``most`` known tags within ``within`` of each tag, nearest first.

    Tags within the distance have a segment of one length in common, and one that starts with the other has it among its
    prefixes; both sides are joined by these keys, so that a tag meets those that are nearly like it. Empty tags are none.
    """
    known = vocabulary.select(F.col("tag").alias("suggestion"), F.lower("tag").alias("y")).where("suggestion <> ''").distinct()
    left = tags.select(trimmed(F.col("tag")).alias("tag")).where("tag <> ''").distinct().withColumn("x", F.lower("tag"))
    keys = lambda df, c, make: df.withColumn("key", F.explode(make(F.col(c))))
    segment = lambda c: _segments(c, within)
    itself = lambda c: F.array(c)
    pairs = [keys(left, "x", a).join(keys(known, "y", b), "key") for a, b in ((segment, segment), (_prefixes, itself), (itself, _prefixes))]
    rows = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).where("x <> y").select("tag", "suggestion").distinct()
    rows = rows.withColumn("distance", distance(F.col("tag"), F.col("suggestion"))).where(F.col("distance") <= within)
    w = W.partitionBy("tag").orderBy("distance", "suggestion")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def audit(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(tag, normalized, valid, issues, suggestions) of each distinct tag."""
    hints = suggestions(tags, vocabulary).groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "suggestion"))), lambda s: s["suggestion"]).alias("suggestions"))
    rows = tags.select(trimmed(F.col("tag")).alias("tag")).distinct()
    rows = rows.join(vocabulary.select("tag", F.lit(True).alias("known")).distinct(), "tag", "left")
    rows = rows.withColumns({"normalized": canonical(F.col("tag")), "issues": problems(F.col("tag"), F.col("known"))}).drop("known")
    return rows.join(hints, "tag", "left").withColumns({"valid": F.size("issues") == 0, "suggestions": F.coalesce("suggestions", F.array().cast("array<string>"))})
