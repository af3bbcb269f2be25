"""Documents: markdown chunks and their retrieval, card previews, media references, model adapters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions import text as tx
from recallgrid.functions.hashes import short

#: Bytes that a chunk needs, and characters that it may have.
LEAST, MOST = 50, 2000
#: Kinds of chunks by words of their heading (fixed values).
KINDS = (("summary", ("summary", "overview", "tldr")), ("key_points", ("key point", "takeaway", "highlight")), ("code_example", ("example", "code")), ("question", ("question",)), ("answer", ("answer", "solution")))
#: Suffixes of media files with their modality and type (fixed values).
MEDIA = {
    "png": ("image", "image/png"), "jpg": ("image", "image/jpeg"), "jpeg": ("image", "image/jpeg"), "gif": ("image", "image/gif"), "webp": ("image", "image/webp"),
    "mp3": ("audio", "audio/mpeg"), "wav": ("audio", "audio/wav"), "ogg": ("audio", "audio/ogg"), "m4a": ("audio", "audio/mp4"), "flac": ("audio", "audio/flac"),
    "mp4": ("video", "video/mp4"), "mov": ("video", "video/quicktime"), "webm": ("video", "video/webm"), "mpeg": ("video", "video/mpeg"), "pdf": ("document", "application/pdf"),
}


def chunk_kind(heading: Column) -> Column:
    low, out = F.lower(heading), None
    for kind, words in KINDS:
        match = low.rlike("|".join(words))
        out = F.when(match, kind) if out is None else out.when(match, kind)
    return out.otherwise("section")


def chunks(files: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(path, chunk_id, kind, content) of markdown files (path, content): code blocks, then sections of at least ``least``
    bytes, or the whole text if there is neither. Each is cut to ``most`` characters."""
    code = F.transform(F.regexp_extract_all("content", F.lit(r"(?s)```\w*\n(.*?)```"), F.lit(1)), lambda x, i: F.struct(F.concat(F.lit("code_"), i.cast("string")).alias("name"), F.lit("code_example").alias("kind"), tx.trimmed(x).alias("content")))
    parts = F.filter(tx.sections(F.col("content")), lambda s: s["level"] > 0)
    named = F.transform(parts, lambda s: F.struct(tx.slug(s["heading"], "_", 100).alias("name"), chunk_kind(s["heading"]).alias("kind"), s["content"].alias("content")))
    found = F.concat(F.filter(code, lambda c: c["content"] != ""), F.filter(named, lambda c: F.octet_length(c["content"]) >= least))
    body = tx.trimmed(F.col("content"))
    whole = F.when(F.octet_length(body) >= least, F.array(F.struct(F.lit("full").alias("name"), F.lit("full_content").alias("kind"), body.alias("content")))).otherwise(F.filter(found, lambda c: F.lit(False)))
    rows = files.withColumn("found", found).withColumn("c", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(whole)))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return rows.select("path", F.concat_ws("_", stem, "c.name", short(F.col("path"), 8)).alias("chunk_id"), "c.kind", tx.truncated(F.col("c.content"), most).alias("content"))


def context(hits: DataFrame, k: int, most: int = 500) -> DataFrame:
    """The first ``k`` of (path, score, chunk_id, content) hits, one of each file, in the order of their scores."""
    w = W.partitionBy("path").orderBy(F.desc("score"), "chunk_id")
    first = hits.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return first.orderBy(F.desc("score"), "chunk_id").limit(k).withColumn("content", F.left("content", F.lit(most)))


def few_shot(hits: DataFrame, k: int, topic: str | None = None, question: int = 300, answer: int = 500) -> DataFrame:
    """(question, answer, topic, difficulty, path): the ``k`` best of (path, score, chunk_id, content, metadata) hits as
    examples, those whose metadata has the topic if one is given. Both texts are the content, cut at their lengths; what
    the metadata lacks is empty."""
    rows = hits if topic is None else with_metadata(hits, "topic", topic)
    own = lambda name: F.coalesce(F.col("metadata")[name], F.lit("")).alias(name)
    rows = rows.orderBy(F.desc("score"), "chunk_id").limit(k)
    return rows.select(F.left("content", F.lit(question)).alias("question"), F.left("content", F.lit(answer)).alias("answer"), own("topic"), own("difficulty"), "path")


def with_metadata(rows: DataFrame, field: str, value: str) -> DataFrame:
    """Rows whose metadata map has the value."""
    return rows.where(F.col("metadata")[field] == value)


def duplicate_advice(similarity: Column) -> Column:
    """What to do with a new card whose nearest old one is so similar."""
    return F.when(similarity >= 0.95, "skip").when(similarity >= 0.85, "merge").when(similarity >= 0.70, "review").otherwise("create")


def previews(files: DataFrame) -> DataFrame:
    """(path, card_index, slug, title, html, confidence): a card for each section with text of markdown files."""
    rows = files.select("path", F.posexplode(F.filter(tx.sections(tx.body(F.col("content"))), lambda s: s["content"] != "")).alias("card_index", "s"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    title = F.coalesce(F.nullif(F.col("s.heading"), F.lit("")), stem)
    escaped = tx.replaced(F.col("s.content"), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))
    html = F.concat(F.lit("<p>"), F.regexp_replace(escaped, r"\n{2,}", "</p><p>"), F.lit("</p>"))
    return rows.select("path", "card_index", F.concat_ws("-", tx.slug(stem), F.col("card_index") + 1).alias("slug"), title.alias("title"), html.alias("html"), F.lit(0.5).alias("confidence"))


def media_refs(content: Column) -> Column:
    """(path, modality, mime, label) of images, videos, PDFs and sounds in a field, each path once.

    Absolute addresses and paths that leave the folder are left out, and so are files of unknown kind.
    """
    patterns = (r"(?i)<img[^>]+src=[\"']?([^\"' >]+)", r"(?i)<(?:video|source)[^>]+src=[\"']?([^\"' >]+)", r"(?i)<(?:a|embed)[^>]+(?:href|src)=[\"']?([^\"' >]+\.pdf(?:\?[^\"' >]*)?)", r"\[sound:([^\]]+)\]")
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in patterns]))
    clean = F.transform(found, lambda p: F.regexp_replace(F.regexp_replace(p, r"[?#].*$", ""), r"^\./", ""))
    kept = F.filter(F.array_distinct(clean), lambda p: ~p.rlike(r"^(?:\w+:|/)|(?:^|/)\.\.(?:/|$)|^$"))
    kinds = F.create_map(*[F.lit(x) for k, v in MEDIA.items() for x in (k, v[0])])
    types = F.create_map(*[F.lit(x) for k, v in MEDIA.items() for x in (k, v[1])])
    suffix = lambda p: F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1))
    refs = F.transform(kept, lambda p: F.struct(p.alias("path"), F.try_element_at(kinds, suffix(p)).alias("modality"), F.try_element_at(types, suffix(p)).alias("mime"), F.element_at(F.split(p, "/"), -1).alias("label")))
    return F.filter(refs, lambda r: r["modality"].isNotNull())


def embedder(embed: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A Column function that embeds texts by batches; null texts give null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            some = [t for t in texts if t is not None]
            found = iter(embed(some) if some else [])
            yield pd.Series([None if t is None else next(found) for t in texts], dtype=object)

    return run


def reranker(score: Callable[[str, list[str]], list[float]], query: str) -> Callable[[Column], Column]:
    """A Column function that scores texts against a query by batches."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        some = texts.dropna()
        return pd.Series(score(query, list(some)) if len(some) else [], index=some.index, dtype=float).reindex(texts.index)

    return run


def reviewed(cards: DataFrame, review: Callable[[list[dict]], list[dict]], schema: str, batch: int = 10) -> DataFrame:
    """The rows that a reviewer gives for each ``batch`` cards: language-model reviews, generation and splits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), batch):
                if found := review(part.iloc[at : at + batch].to_dict("records")):
                    yield pd.DataFrame(found)

    return cards.mapInPandas(run, schema)


def review_items(scores: DataFrame) -> DataFrame:
    """Items of reviewed dimensions (slug, dimension, score): under 0.4 of tier 3, under 0.6 of tier 2."""
    low = F.col("score") < 0.4
    item = short(F.concat_ws(":", F.lit("llm_review"), "slug", "dimension"), 16)
    return scores.where("score < 0.6").select(
        item.alias("id"), F.lit("audit").alias("loop_kind"), F.lit("low_quality").alias("kind"), "dimension", "score", F.when(low, 3).otherwise(2).alias("tier"), "slug", F.when(low, 0.7).otherwise(0.6).alias("confidence")
    )
