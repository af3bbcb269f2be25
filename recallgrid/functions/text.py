"""Text functions as Column expressions, so that they run inside whole-stage code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities in the order in which they are replaced: &amp; first, so doubly escaped text is unescaped twice.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#x27;", "'"), ("&nbsp;", " "))
#: Stands around code while a text is taken apart: a character that no text has.
MARK = "\uffff"
#: Names of fields by role.
FRONT = ("front", "question", "prompt", "q", "text", "sentence")
BACK = ("back", "answer", "response", "a", "definition", "meaning")
EXTRA = ("extra", "notes", "hint", "example", "examples", "context")


def replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def html_unescape(text: Column) -> Column:
    return replaced(text, ENTITIES)


def expand_cloze(text: Column) -> Column:
    """``{{c1::answer::hint}}`` becomes its answer."""
    return F.regexp_replace(text, r"\{\{c\d+::(.*?)(?:::[^}]*)?\}\}", "$1")


def strip_html(text: Column, keep_code: bool = False) -> Column:
    """Plain text: clozes expanded, tags dropped, entities decoded, white space folded.

    Code is kept as plain text, or with ``keep_code`` between backticks, its tags and clozes as they are.
    """

    def plain(part: Column) -> Column:
        part = F.regexp_replace(expand_cloze(part), r"<br ?/?>|</?(?:p|div|P|DIV)>|<(?:li|LI)>|&nbsp;", "\n")
        return html_unescape(F.regexp_replace(part, r"<[^>]+>", ""))

    if keep_code:
        # Odd parts are the code, as the text is cut at the marks around it.
        blocks = F.regexp_replace(text, r"(?is)<pre[^>]*>\s*<code[^>]*>(.*?)</code>\s*</pre>", f"{MARK}$1{MARK}")
        parts = F.split(F.regexp_replace(blocks, r"(?is)<code[^>]*>(.*?)</code>", f"{MARK}$1{MARK}"), MARK, -1)
        done = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit("`"), html_unescape(p), F.lit("`"))).otherwise(plain(p)))
        text = F.array_join(done, "")
    else:
        text = plain(text)
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_whitespace(text: Column) -> Column:
    """Lines trimmed and folded, blank ones dropped."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: trimmed(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def html_to_markdown(text: Column) -> Column:
    """Breaks, paragraphs, headings and list items in markdown; other tags dropped."""
    text = replaced(text, (("<br>", "\n"), ("<br/>", "\n"), ("<br />", "\n"), ("</p>", "\n\n"), ("</h1>", "\n\n"), ("</h2>", "\n\n"), ("</h3>", "\n\n"), ("</li>", "\n")))
    for level in (1, 2, 3):
        text = F.regexp_replace(text, rf"<h{level}[^>]*>", "#" * level + " ")
    text = F.regexp_replace(text, r"<li[^>]*>", "- ")
    return trimmed(F.regexp_replace(text, r"<[^>]+>", ""))


def field_role(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.isin(*FRONT), "front").when(low.isin(*BACK), "back").when(low.isin(*EXTRA), "extra").otherwise("other")


def note_text(fields: Column, tags: Column, decks: Column) -> Column:
    """The searchable form of a note: ``Front:``, ``Back:``, ``Extra:``, other fields, ``Tags:``, ``Decks:``.

    ``fields`` is an array of (name, value) in field order; without a field of a known role the first is the front
    and the second the back. Fields of one role are joined in field order.
    """
    stripped = F.transform(fields, lambda f: F.struct(field_role(f["name"]).alias("role"), f["name"].alias("name"), strip_html(f["value"]).alias("value")))
    filled = F.filter(stripped, lambda f: f["value"] != "")
    known = F.exists(filled, lambda f: f["role"].isin("front", "back"))
    placed = F.transform(filled, lambda f, i: F.struct(F.when(known, f["role"]).when(i == 0, "front").when(i == 1, "back").otherwise(f["role"]).alias("role"), f["name"].alias("name"), f["value"].alias("value")))

    def part(role: str, title: str) -> Column:
        own = F.transform(F.filter(placed, lambda f: f["role"] == role), lambda f: f["value"])
        return F.when(F.size(own) > 0, F.concat(F.lit(f"{title}: "), F.array_join(own, "\n")))

    others = F.transform(F.filter(placed, lambda f: f["role"] == "other"), lambda f: F.concat_ws(": ", f["name"], f["value"]))
    listed = lambda xs, title: F.when(F.size(xs) > 0, F.concat(F.lit(f"{title}: "), F.array_join(xs, ", ")))
    rest = F.when(F.size(others) > 0, F.array_join(others, "\n"))
    return F.concat_ws("\n", part("front", "Front"), part("back", "Back"), part("extra", "Extra"), rest, listed(tags, "Tags"), listed(decks, "Decks"))


def wikilinks(text: Column) -> Column:
    """Targets of ``[[target|alias]]``, trimmed, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: trimmed(x))


def embedded_images(text: Column) -> Column:
    """Paths of ``![[x]]`` and then of ``![alt](x)``, each once."""
    wiki = F.transform(F.regexp_extract_all(text, F.lit(r"!\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: trimmed(x))
    marked = F.transform(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1)), lambda x: trimmed(x))
    return F.array_distinct(F.concat(wiki, marked))


def image_urls(html: Column, base: Column) -> Column:
    """Absolute addresses of ``<img src>``: full ones as they are, ``//`` with https, ``/`` from the host of ``base``."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<img[^>]+src\s*=\s*["']([^"']+)["']"""), F.lit(1))
    origin = F.regexp_extract(base, r"^(\w+://[^/]+)", 1)
    folder = F.regexp_extract(base, r"^(.*/)", 1)
    return F.transform(found, lambda u: F.when(u.rlike(r"^\w+://"), u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(origin, u)).otherwise(F.concat(folder, u)))


def _folded() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters whose compatibility decomposition without marks is one letter or digit, what that is, and Latin ones
    that decompose to several."""
    one, to, several = [], [], []
    for code in range(0x80, 0x10000):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if len(bare) == 1 and (bare.isascii() and bare.isalnum() or bare in " _./\\-"):
            one.append(chr(code))
            to.append(bare)
        elif len(bare) > 1 and bare.isascii() and bare.isalnum() and "LATIN" in unicodedata.name(chr(code), ""):
            several.append((chr(code), bare))
    return "".join(one), "".join(to), tuple(several)


FOLDED = _folded()


def slug(text: Column, separator: str = "-", most: int = 50) -> Column:
    """Lower case letters and digits of the Latin alphabet; blanks and ``_ . / \\ -`` part words, all else is dropped.

    Characters are decomposed and lose their marks, ß is s. A slug that is too long is cut at its last separator within
    ``most``.
    """
    one, to, several = FOLDED
    low = F.translate(F.lower(replaced(text, several)), "ß" + one, "s" + to)
    bare = F.regexp_replace(F.regexp_replace(low, r"[ _./\\-]", separator), rf"[^a-z0-9{separator}]", "")
    full = F.regexp_replace(F.regexp_replace(bare, rf"{separator}{{2,}}", separator), rf"^{separator}+|{separator}+$", "")
    cut = F.regexp_replace(F.left(full, F.lit(most)), rf"{separator}[^{separator}]*$", "")
    return F.when(F.char_length(full) <= most, full).otherwise(cut)


def card_slug(topic: Column, keyword: Column, index: Column, lang: Column, most: int = 100) -> Column:
    """``topic-keyword-index-lang``; both halves are cut if it would be too long, and have a default if they are empty."""
    end = F.concat_ws("-", F.lit(""), index.cast("string"), F.lower(lang))
    room = F.lit(most) - F.char_length(end)
    t, k = (F.coalesce(F.nullif(slug(x), F.lit("")), F.lit(default)) for x, default in ((topic, "untitled"), (keyword, "card")))
    half = F.floor(room / 2).cast("int")
    cut = lambda x: F.when(F.char_length(x) <= half, x).otherwise(F.regexp_replace(F.left(x, half), "-[^-]*$", ""))
    base = F.concat_ws("-", t, k)
    return F.concat(F.when(F.char_length(base) <= room, base).otherwise(F.concat_ws("-", cut(t), cut(k))), end)


def slug_parts(value: Column) -> Column:
    """(topic, keyword, index, lang) of a card slug; one of another form is all topic."""
    parts = F.split(value, "-")
    n = F.size(parts)
    formed = (n >= 3) & value.rlike("-[0-9]{1,9}-[A-Za-z]{2}$")
    rest = F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0)))
    middle = F.greatest(F.floor(F.size(rest) / 2).cast("int"), F.lit(1))
    topic = F.array_join(F.slice(rest, F.lit(1), middle), "-")
    keyword = F.array_join(F.slice(rest, middle + 1, F.greatest(F.size(rest) - middle, F.lit(0))), "-")
    return F.struct(
        F.when(formed, topic).otherwise(value).alias("topic"),
        F.when(formed, keyword).otherwise("").alias("keyword"),
        F.when(formed, F.get(parts, n - 2).try_cast("int")).otherwise(0).alias("index"),
        F.when(formed, F.get(parts, n - 1)).otherwise("").alias("lang"),
    )


def title(text: Column) -> Column:
    return F.nullif(trimmed(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)), F.lit(""))


def frontmatter_split(content: Column) -> Column:
    """(yaml, body): a block of lines between ``---`` at the very start and the next line that starts so. Without a whole
    block yaml is null and the body is all."""
    rest = F.substr(content, F.lit(5))
    end = F.locate("\n---", rest)
    after = F.substr(rest, end + 4)
    pair = lambda yaml, body: F.struct(yaml.alias("yaml"), body.alias("body"))
    none = pair(F.lit(None).cast("string"), content)
    block = pair(F.left(rest, end - 1), F.when(after.startswith("\n"), F.substr(after, F.lit(2))).otherwise(after))
    inner = F.when(rest.startswith("---\n"), pair(F.lit(""), F.substr(rest, F.lit(5)))).when(rest == "---", pair(F.lit(""), F.lit("")))
    return F.when(content.startswith("---\n"), inner.when(end > 0, block).otherwise(none)).otherwise(none)


def frontmatter(text: Column) -> Column:
    return F.nullif(frontmatter_split(text)["yaml"], F.lit(""))


def body(text: Column) -> Column:
    return frontmatter_split(text)["body"]


def sections(text: Column) -> Column:
    """Sections at headings as (heading, level, content); what stands before the first has an empty heading."""
    parts = F.split(text, r"(?m)(?=^#{1,6}\s+.+$)")
    parts = F.filter(parts, lambda x: trimmed(x) != "")
    heading = lambda x: F.regexp_extract(x, r"\A#{1,6}\s+(.+)", 1)
    return F.transform(parts, lambda x: F.struct(trimmed(heading(x)).alias("heading"), F.char_length(F.regexp_extract(x, r"\A(#{1,6})\s", 1)).alias("level"), trimmed(F.regexp_replace(x, r"\A#{1,6}\s+.+\n?", "")).alias("content")))


def preview_label(text: Column) -> Column:
    return F.coalesce(F.nullif(F.replace(F.left(trimmed(text), F.lit(80)), F.lit("\n"), F.lit(" ")), F.lit("")), F.lit("asset"))


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last space, with an ellipsis."""
    cut = F.left(text, F.lit(most))
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract(cut, r"(?s)\A(.*) ", 1), F.lit("")), cut), F.lit("...")))


def headline(text: Column, words: list[str]) -> Column:
    if not words:
        return F.lit(None).cast("string")
    terms = "|".join(r"\Q" + w.replace(r"\E", "") + r"\E" for w in words)
    return F.regexp_replace(text, rf"(?iU)\b({terms})\b", "<b>$1</b>")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def trigrams(text: Column) -> Column:
    """Distinct three-letter runs of each word, with two blanks before and one behind it."""
    spaced = F.concat(F.lit("  "), F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}]+", "  "), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(spaced, F.lit(r"(?=(  \S| \S\S| \S |\S\S\S|\S\S )).", ), F.lit(1)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams, 0 if there is none."""
    x, y = trigrams(a), trigrams(b)
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, F.size(F.array_intersect(x, y)) / every).otherwise(0.0)


def split_csv(text: Column) -> Column:
    """The values between commas, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: trimmed(x)), lambda x: x != "")


def rfc3339(at: Column) -> Column:
    """A time as text with its seconds' fraction and UTC offset."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def parsed_rfc3339(text: Column) -> Column:
    """The time that a text gives, or null."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))


def with_frontmatter(text: Column, key: str, value: Column) -> Column:
    """A note whose frontmatter has ``key: value``: its line is replaced, added, or the block is made; the body stays."""
    line = F.concat(F.lit(f"{key}: "), value)
    own = frontmatter(text)
    lines = F.split(own, "\n")
    has = F.exists(lines, lambda x: x.startswith(f"{key}:"))
    new = F.when(has, F.transform(lines, lambda x: F.when(x.startswith(f"{key}:"), line).otherwise(x))).otherwise(F.concat(lines, F.array(line)))
    block = F.when(own.isNull(), line).otherwise(F.array_join(new, "\n"))
    return F.concat(F.lit("---\n"), block, F.lit("\n---\n"), body(text))
