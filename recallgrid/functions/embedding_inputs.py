"""What an embedding is made of: parts of text, inlined bytes and files, with a task, a title and a dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an embedding is for (fixed values).
TASKS = ("Default", "RetrievalDocument", "RetrievalQuery")
PART = "struct<kind:string,text:string,mime_type:string,data:binary,uri:string,display_name:string>"


def _part(kind: str, **given: Column) -> Column:
    names = (("kind", "string"), ("text", "string"), ("mime_type", "string"), ("data", "binary"), ("uri", "string"), ("display_name", "string"))
    return F.struct(*[(F.lit(kind) if n == "kind" else given.get(n, F.lit(None))).cast(t).alias(n) for n, t in names])


def text_part(text: Column) -> Column:
    return _part("text", text=text)


def inline_part(mime_type: Column, data: Column, display_name: Column | None = None) -> Column:
    """Bytes of an image, a sound or a document."""
    return _part("inline_bytes", mime_type=mime_type, data=data, display_name=F.lit(None) if display_name is None else display_name)


def file_part(mime_type: Column, uri: Column, display_name: Column | None = None) -> Column:
    """A file that the model reads by its address."""
    return _part("file_uri", mime_type=mime_type, uri=uri, display_name=F.lit(None) if display_name is None else display_name)


def embedding_input(parts: Column, task: str = "Default", title: Column | None = None, dimension: int | None = None) -> Column:
    """(parts, task, title, dimension); a task is one of ``TASKS``."""
    if task not in TASKS:
        raise ValueError(f"no task {task}")
    return F.struct(parts.alias("parts"), F.lit(task).alias("task"), (F.lit(None) if title is None else title).cast("string").alias("title"), F.lit(dimension).cast("int").alias("dimension"))


def single_text(given: Column) -> Column:
    """The text of an input that is one part of text, else null: all that a model for text alone takes."""
    parts = given["parts"]
    return F.when((F.size(parts) == 1) & (F.get(parts, F.lit(0))["kind"] == "text"), F.get(parts, F.lit(0))["text"])


def part_bytes(part: Column) -> Column:
    """The bytes by which a part is told from others: its kind, then what it has. What is null has no bytes."""
    raw = lambda *names: F.concat(F.encode(part["kind"], "UTF-8"), *[F.coalesce(part[n] if n == "data" else F.encode(part[n], "UTF-8"), F.lit(b"")) for n in names])
    kind = part["kind"]
    return F.when(kind == "text", raw("text")).when(kind == "inline_bytes", raw("mime_type", "display_name", "data")).otherwise(raw("mime_type", "uri", "display_name"))


def input_digest(given: Column) -> Column:
    """The SHA-256 of an input: task, title, dimension, then its parts, each behind a byte 255."""
    head = F.encode(F.concat(given["task"], F.coalesce(given["title"], F.lit("")), F.coalesce(given["dimension"].cast("string"), F.lit(""))), "UTF-8")
    return F.sha2(F.aggregate(given["parts"], head, lambda out, p: F.concat(out, F.lit(b"\xff"), part_bytes(p))), 256)


def mock_vector(given: Column, dimension: int) -> Column:
    """A repeatable stand-in for the embedding of an input: the bytes of its digest, repeated, scaled to [-1, 1]."""
    digest = input_digest(given)
    at = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (at(i) / 127.5 - 1).cast("float"))
