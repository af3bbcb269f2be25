"""Text files and web pages as notes for a vault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import text as tx


def _counted(rows: DataFrame, source: str, title: Column, content: Column) -> DataFrame:
    return rows.select(
        F.col(source).alias("source"),
        title.alias("title"),
        content.alias("content"),
        F.size(F.filter(F.split(content, "\n"), lambda x: x.startswith("#"))).alias("n_sections"),
        F.size(tx.embedded_images(content)).alias("n_images"),
    )


def text_files(files: DataFrame) -> DataFrame:
    """(source, title, content, n_sections, n_images) of (path, content): the first heading, or else the file's name."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return _counted(files, "path", F.coalesce(tx.title(F.col("content")), stem), F.col("content"))


def web_pages(pages: DataFrame) -> DataFrame:
    """The same of (url, html): the page's title, its body in markdown with absolute images behind it."""
    title = F.nullif(tx.trimmed(tx.html_unescape(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))
    body = F.regexp_replace("html", r"(?is)<(script|style|head|title|nav|footer)\b.*?</\1>|<!--.*?-->", "")
    images = F.transform(tx.image_urls(F.col("html"), F.col("url")), lambda u: F.concat(F.lit("\n\n![]("), u, F.lit(")")))
    content = F.concat(tx.html_unescape(tx.html_to_markdown(body)), F.array_join(images, ""))
    return _counted(pages, "url", F.coalesce(title, F.col("url")), content)


#: How rows of each kind of source are read.
READERS = {"text": text_files, "web": web_pages}


def documents(sources: dict[str, DataFrame]) -> DataFrame:
    """The documents of sources by kind (``text`` with path and content, ``web`` with url and html), with source_type.
    Another kind is a ValueError; other readers may be put into ``READERS``."""
    unknown = sorted(set(sources) - set(READERS))
    if unknown or not sources:
        raise ValueError(f"no reader for {', '.join(unknown)}" if unknown else "no sources")
    return reduce(DataFrame.unionByName, (READERS[kind](rows).withColumn("source_type", F.lit(kind)) for kind, rows in sources.items()))


def vault_notes(documents: DataFrame, folder: str) -> DataFrame:
    """(path, content) of note files: frontmatter with title and source, then the content."""
    name = F.concat(F.lit(f"{folder}/"), tx.slug(F.col("title")), F.lit(".md"))
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.char_length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)
    head = F.concat(F.lit("---\ntitle: "), quoted("title"), F.lit("\nsource: "), quoted("source"), F.lit("\n---\n"))
    return documents.select(name.alias("path"), F.concat(head, "content").alias("content"))
