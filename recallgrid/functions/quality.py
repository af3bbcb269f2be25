"""Card quality as Column expressions: six dimensions, issue lists and relevance rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.functions.text import trimmed, word_count

# Fixed values of the rules.
VAGUE = ("explain", "describe", "tell me about", "tell about", "discuss", "elaborate")
YES_NO = ("is ", "does ", "can ", "do ", "are ", "was ", "were ", "has ", "have ", "will ", "would ", "should ", "could ", "did ")
DEAD_TOPICS = ("kotlin_syntax", "kotlin_equality")
ALIVE_TOPICS = (
    "cs_system_design", "cs_architecture", "cs_distributed_systems", "cs_patterns", "android_architecture", "android_debugging", "cs_testing",
    "android_testing", "cs_concurrency", "cs_security", "kotlin_patterns", "kotlin_concurrency", "kotlin_coroutines", "kotlin_error_handling", "kotlin_performance",
)
DEAD_FRONTS = (
    "what is the syntax", "how do you write a", "what does the following code output", "write the code for", "what is the correct way to write",
    "fill in the blank", "complete the code", "what keyword", "what operator", "what symbol",
)
ALIVE_FRONTS = (
    "why would you", "when would you", "what tradeoffs", "what trade-offs", "how would you design", "how would you debug", "compare", "what goes wrong if",
    "what happens when", "what problem does", "what are the implications", "how would you architect", "when should you prefer", "what is the impact of", "debug this",
)
DIMENSIONS = ("clarity", "atomicity", "testability", "memorability", "accuracy", "relevance")
SHORT, LONG, MOST_TAGS = 10, 5000, 20
FORBIDDEN = ("script", "style", "iframe", "object", "applet")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def _less(*penalties: Column) -> Column:
    """One less the penalties, between 0 and 1."""
    return F.greatest(F.least(reduce(lambda a, b: a - b, penalties, F.lit(1.0)), F.lit(1.0)), F.lit(0.0))


def _if(condition: Column, value: float) -> Column:
    return F.when(condition, value).otherwise(0.0)


def _steps(n: Column, *steps: tuple[int, float]) -> Column:
    """The value of the first step whose bound ``n`` exceeds."""
    out = F.when(n > steps[0][0], steps[0][1])
    for bound, value in steps[1:]:
        out = out.when(n > bound, value)
    return out.otherwise(0.0)


def clarity(front: Column) -> Column:
    low = F.lower(front)
    starts = reduce(lambda a, b: a | b, [low.startswith(s) for s in YES_NO])
    return _less(_if(_any(low, VAGUE), 0.4), _if(starts, 0.3), _if((front != "") & ~front.contains("?"), 0.2))


def atomicity(front: Column) -> Column:
    joins = F.size(F.regexp_extract_all(F.lower(front), F.lit(r"(?<![\p{L}\p{N}])(?:and|or)(?![\p{L}\p{N}])"), F.lit(0)))
    return _less(_steps(word_count(front), (30, 0.4), (20, 0.2)), F.when(joins >= 2, 0.4).when(joins == 1, 0.1).otherwise(0.0))


def testability(back: Column) -> Column:
    return F.when(back == "", 0.0).otherwise(_less(_steps(word_count(back), (200, 0.5), (100, 0.3))))


def memorability(back: Column) -> Column:
    items = F.size(F.filter(F.split(back, r"\r?\n"), lambda x: x.rlike(r"^\s*(?:- |\* |[0-9]+[.)] )")))
    return _less(_steps(items, (7, 0.5), (4, 0.2)), _steps(word_count(back), (150, 0.3)))


def accuracy(front: Column, back: Column) -> Column:
    return _less(_if(front == "", 0.5), _if(back == "", 0.5), _if((front != "") & ~front.contains("?"), 0.2))


def code_only(back: Column) -> Column:
    """Whether an answer is fenced code with fewer than ten words around it."""
    state = F.struct(F.lit(False).alias("code"), F.lit(0).alias("words"), F.lit(False).alias("any"))

    def step(s: Column, line: Column) -> Column:
        line = trimmed(line)
        opens = line.rlike(r"^(?:```|<pre>|<code>)")
        closes = line.rlike(r"^</(?:pre|code)>")
        inside = F.when(opens, ~s["code"]).when(closes, F.lit(False)).otherwise(s["code"])
        prose = ~opens & ~closes & ~s["code"]
        return F.struct(inside.alias("code"), (s["words"] + F.when(prose, word_count(line)).otherwise(0)).alias("words"), (s["any"] | (opens & inside)).alias("any"))

    end = F.aggregate(F.split(back, r"\r?\n"), state, step)
    return end["any"] & (end["words"] < 10)


def content_relevance(front: Column, back: Column) -> Column:
    """1 alive, -1 dead, 0 neutral, from what the card asks."""
    low = F.lower(front)
    dead = F.when(_any(low, DEAD_FRONTS), 3).otherwise(0) + F.when(code_only(F.lower(back)), 2).otherwise(0)
    alive = F.when(_any(low, ALIVE_FRONTS), 3).otherwise(0)
    return F.when(alive > dead, 1).when((dead > alive) & (dead >= 2), -1).otherwise(0)


def topic_relevance(tags: Column) -> Column:
    """1 or -1 for the first tag that is an alive or dead topic, else 0."""
    marks = F.transform(tags, lambda t: F.when(t.isin(*ALIVE_TOPICS), 1).when(t.isin(*DEAD_TOPICS), -1).otherwise(0))
    return F.coalesce(F.get(F.filter(marks, lambda m: m != 0), F.lit(0)), F.lit(0))


def relevance(front: Column, back: Column, tags: Column) -> Column:
    skill = F.get(F.filter(tags, lambda t: t.isin("skill::alive", "skill::dead")), F.lit(0))
    topic = topic_relevance(tags)
    weight = F.when(topic != 0, 0.1).otherwise(0.3)
    score = F.lit(0.5) + F.when(topic == 1, 0.4).when(topic == -1, -0.3).otherwise(0.0) + weight * content_relevance(front, back)
    return F.when(skill == "skill::alive", 1.0).when(skill == "skill::dead", 0.2).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def scores(front: Column, back: Column, tags: Column) -> dict[str, Column]:
    """The six dimensions and their weighted mean; relevance counts one and a half times."""
    front, back = trimmed(front), trimmed(back)
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    out = {
        "clarity": clarity(front),
        "atomicity": atomicity(front),
        "testability": testability(back),
        "memorability": memorability(back),
        "accuracy": accuracy(front, back),
        "relevance": relevance(front, back, tags),
    }
    return out | {"overall": (sum((out[d] for d in DIMENSIONS[:5]), F.lit(0.0)) + 1.5 * out["relevance"]) / 6.5}


def issue(severity: str, message: Column | str, location: str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit(location).alias("location"))


def issues(*found: tuple[Column, Column]) -> Column:
    """An array of the issues whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, x) for condition, x in found]))


def content_issues(text: Column, label: str) -> Column:
    """Empty, short, long (in bytes) and unmatched code fences."""
    at, size = label.lower(), F.octet_length(text)
    empty = trimmed(text) == ""
    fences = F.size(F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^\s*```")))
    return issues(
        (empty, issue("error", f"{label} side is empty", at)),
        (~empty & (size < SHORT), issue("warning", F.concat(F.lit(f"{label} side is very short ("), size, F.lit(" chars)")), at)),
        (~empty & (size > LONG), issue("warning", F.concat(F.lit(f"{label} side exceeds {LONG} chars ("), size, F.lit(")")), at)),
        (~empty & (fences % 2 != 0), issue("error", f"Unmatched code fence in {at}", at)),
    )


def format_issues(text: Column, label: str) -> Column:
    at = label.lower()
    return issues(
        (text.rlike(r"(?m)[ \t]+$"), issue("warning", f"Trailing whitespace in {at}", at)),
        (text.contains("\n\n\n"), issue("warning", f"Consecutive blank lines in {at}", at)),
    )


def html_issues(text: Column, label: str) -> Column:
    """Forbidden tags, and tags that aren't closed in the order in which they were opened."""
    at = label.lower()
    kind = "array<struct<severity:string,message:string,location:string>>"
    message = lambda *parts: F.array(issue("error", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), at))
    none = F.array().cast(kind)

    def step(s: Column, raw: Column) -> Column:
        closing = raw.startswith("/")
        name = F.lower(F.regexp_extract(raw, r"^/?([^\s/]*)", 1))
        top = F.element_at(s["open"], -1)
        counts = (name != "") & ~raw.startswith("!")
        plain = counts & ~name.isin(*VOID) & ~raw.endswith("/")
        empty = F.size(s["open"]) == 0
        same = plain & closing & ~empty & (F.when(~empty, top) == name)
        stack = F.when(plain & ~closing, F.concat(s["open"], F.array(name))).when(same, F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"])
        bad = F.when(counts & name.isin(*FORBIDDEN), message("Forbidden HTML tag <", name, f"> in {at}")).otherwise(none)
        odd = F.when(plain & closing & empty, message("Unexpected closing tag </", name, f"> in {at}")).when(plain & closing & ~same, message("Mismatched closing tag </", name, ">, expected </", F.when(~empty, top), f"> in {at}")).otherwise(none)
        return F.struct(stack.alias("open"), F.concat(s["found"], bad, odd).alias("found"))

    start = F.struct(F.array().cast("array<string>").alias("open"), none.alias("found"))
    end = F.aggregate(F.regexp_extract_all(text, F.lit("<([^>]*)>"), F.lit(1)), start, step)
    left = F.transform(end["open"], lambda name: issue("error", F.concat(F.lit("Unclosed tag <"), name, F.lit(f"> in {at}")), at))
    return F.concat(end["found"], left)


def _each(values: Column, build) -> Column:
    """The issues that ``build(value, place)`` gives for the values, nulls left out."""
    return F.array_compact(F.transform(values, build))


def tag_issues(tags: Column) -> Column:
    """Empty tags, other characters than letters, digits and ``_:/-``, too many tags, repeats."""
    n = F.size(tags)
    named = lambda text, t, severity="warning": issue(severity, F.format_string(text, t), "tags")
    forms = _each(tags, lambda t: F.when(t == "", issue("error", "Empty tag", "tags")).when(~t.rlike("^[A-Za-z0-9_:/-]+$"), named("Tag '%s' contains invalid characters", t)))
    many = issues((n > MOST_TAGS, issue("warning", F.format_string(f"Too many tags (%d, max {MOST_TAGS})", n), "tags")))
    again = _each(tags, lambda t, i: F.when(F.array_position(tags, t) - 1 < i, named("Duplicate tag '%s'", t)))
    return F.concat(forms, many, again)


def relevance_issues(front: Column, back: Column, tags: Column) -> Column:
    """Warnings of dead topics and rote questions, and a note that a card has no skill tag; none of cards that have one."""
    dead = F.get(F.filter(tags, lambda t: t.isin(*DEAD_TOPICS)), F.lit(0))
    hint = "consider transforming to a reasoning question"
    bare = ~F.exists(tags, lambda t: t.startswith("skill::"))
    return issues(
        (bare & dead.isNotNull(), issue("warning", F.format_string(f"Topic '%s' is a low-value skill area -- {hint}", dead), "relevance")),
        (bare & (content_relevance(front, back) == -1), issue("warning", f"Card tests syntax recall or boilerplate -- {hint}", "relevance")),
        (bare, issue("info", "Card lacks a skill:: tag (skill::alive, skill::dead, or skill::neutral)", "relevance")),
    )


def card_issues(front: Column, back: Column, tags: Column) -> Column:
    """All validators' issues, in their order; a card is valid without one of severity error."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    return F.concat(content_issues(front, "Front"), content_issues(back, "Back"), format_issues(front, "Front"), format_issues(back, "Back"), html_issues(front, "Front"), html_issues(back, "Back"), tag_issues(tags), relevance_issues(front, back, tags))


def valid(found: Column) -> Column:
    return ~F.exists(found, lambda i: i["severity"] == "error")
