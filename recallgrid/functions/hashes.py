"""Content hashes, each with its own parts, separators and length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.functions.text import trimmed


def short(text: Column, length: int) -> Column:
    return F.left(F.sha2(text, 256), F.lit(length))


def content_hash(front: Column, back: Column) -> Column:
    return short(F.concat_ws("|", front, back), 12)


def metadata_hash(text: Column) -> Column:
    return short(text, 6)


def guid(slug: Column, source: Column) -> Column:
    return short(F.concat_ws(":", slug, source), 32)


def parts_hash(model: str, parts: Column) -> Column:
    """Sixteen hex digits over the model name and each part behind a zero byte: what decides on a new embedding."""
    joined = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("\0"), p)), "")
    return short(F.concat(F.lit(model), joined), 16)


def item_id(prefix: str, slug: Column, discriminator: Column) -> Column:
    """Id of a work item; audits have an empty prefix."""
    return short(F.concat_ws(":", *([F.lit(prefix)] if prefix else []), slug, discriminator), 16)


def little_endian(hexadecimal: Column, digits: int) -> Column:
    """The number whose bytes are the first ``digits`` hex digits, lowest byte first."""
    bytes_ = [F.substring(hexadecimal, i, 2) for i in range(digits - 1, 0, -2)]
    return F.conv(F.concat(*bytes_), 16, 10).cast("long")


def chunk_id(note_id: Column, kind: Column, suffix: Column) -> Column:
    raw = F.lpad(F.hex(note_id), 16, "0")
    reversed_ = F.unhex(F.concat(*[F.substring(raw, i, 2) for i in range(15, 0, -2)]))
    digest = F.sha2(F.concat(reversed_, F.encode(kind, "UTF-8"), F.encode(suffix, "UTF-8")), 256)
    return F.concat_ws(":", note_id.cast("string"), kind, F.left(digest, F.lit(12)))


def file_hash(content: Column) -> Column:
    return short(trimmed(content), 12)


def point_id(chunk: Column) -> Column:
    """The number of a vector in a store: the first eight bytes of the hash of its chunk id, as an unsigned number."""
    return F.conv(short(chunk, 16), 16, 10).cast("decimal(20,0)")
