"""Validators of a card's HTML and markdown text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.functions.text import trimmed

#: Bytes that a line in a code block may have.
LINE = 200
_PRE = r"(?s)<pre>.*?</pre>"
_PRE_CODE = r"(?sU)^.*<pre>\s*<code[\s>]"
_FENCE = r"(?mdU)^[^\S\n]*```[^\n]*(?:\n|\z)"
_TAG = r"<[a-zA-Z][a-zA-Z0-9]*[^>]*>"
_STRINGS = "array<string>"


def _count(text: Column, part: str) -> Column:
    """How often a part stands in a text, without overlaps."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _messages(*found: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, F.lit(x)) for condition, x in found]))


def card_html_errors(text: Column) -> Column:
    """Markdown left in a card's HTML, preformatted text without code, and code outside preformatted text; none of an
    empty or null text."""
    text = F.coalesce(text, F.lit(""))
    outside = F.regexp_replace(text, _PRE, "")
    # A <pre> is bare if no <pre> with code starts there or later: those after the last one with code.
    bare = _count(F.regexp_replace(text, _PRE_CODE, ""), "<pre>")
    head = _messages(
        (text.contains("```"), "Backtick code fence detected; use <pre><code> in HTML"),
        (outside.contains("**"), "Markdown bold markers (**) detected in HTML"),
        (F.replace(outside, F.lit("**"), F.lit("")).contains("*"), "Markdown italic markers (*) detected in HTML"),
    )
    return F.concat(head, F.array_repeat(F.lit("<pre> without nested <code> tag detected"), bare), _messages((outside.contains("<code>"), "Inline <code> outside <pre> detected")))


def markdown_issues(text: Column) -> Column:
    """(is_valid, errors, warnings) of a markdown text: open fences, odd backticks and bold markers, HTML tags, and long
    lines in code. Fence lines cut the text into segments, of which every second one is code; the last counts as text too
    if its fence is open. A blank or null text is valid."""
    text = F.coalesce(text, F.lit(""))
    parts = F.split(text, _FENCE, -1)
    n = F.size(parts)
    opened = n % 2 == 0
    outside = F.array_join(F.filter(parts, lambda _, i: (i % 2 == 0) | opened & (i == n - 1)), "")
    lines = F.flatten(F.transform(F.filter(parts, lambda _, i: i % 2 == 1), lambda p: F.transform(F.split(p, "\n", -1), lambda x: F.octet_length(F.regexp_replace(x, "\r$", "")))))
    long = F.transform(F.filter(lines, lambda x: x > LINE), lambda x: F.concat(F.lit(f"Line exceeds {LINE} characters in code block ("), x.cast("string"), F.lit(" chars)")))
    errors = _messages(
        (opened, "Unclosed code fence detected"),
        (_count(outside, "`") % 2 != 0, "Unbalanced backtick markers detected"),
        (_count(outside, "**") % 2 != 0, "Unbalanced bold markers (**) detected"),
    )
    warnings = F.concat(long, _messages((outside.rlike(_TAG), "HTML tags detected in markdown content")))
    blank, none = trimmed(text) == "", F.array().cast(_STRINGS)
    return _result(F.when(blank, none).otherwise(errors), F.when(blank, none).otherwise(warnings))


def _result(errors: Column, warnings: Column) -> Column:
    return F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"))


def card_markdown_issues(text: Column) -> Column:
    """(is_valid, errors, warnings) of a card file with markdown: its marks and sections, then its text by
    ``markdown_issues``. Lines of marks and of the manifest are no text. A null is an empty file."""
    text = F.coalesce(text, F.lit(""))
    empty = text == ""
    marks = _messages(
        (~text.contains("<!-- BEGIN_CARDS -->"), "Missing BEGIN_CARDS sentinel"),
        (~text.contains("<!-- END_CARDS -->"), "Missing END_CARDS sentinel"),
        (~text.rlike(r"(?U)<!-- Card \d+"), "No card header found (expected <!-- Card N ... -->)"),
        (~text.contains("<!-- Title -->"), "Missing Title section"),
    )
    points = ~text.contains("<!-- Key point (code block") & ~text.contains("<!-- Key point notes -->")
    own = F.filter(F.split(text, "\n", -1), lambda x: ~(trimmed(x).startswith("<!--") | trimmed(x).startswith('{"slug"')))
    body = markdown_issues(F.array_join(own, "\n"))
    errors = F.when(empty, F.array(F.lit("Empty APF content"))).otherwise(F.concat(marks, body["errors"]))
    warnings = F.when(empty, F.array().cast(_STRINGS)).otherwise(F.concat(_messages((points, "Missing Key point sections")), body["warnings"]))
    return _result(errors, warnings)
