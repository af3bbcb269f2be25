import hashlib

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import hashes, quality, tags, vectors
from recallgrid.functions import text as tx


def value(spark, column, **columns):
    df = spark.createDataFrame([tuple(columns.values()) or (1,)], list(columns) or ["x"]) if columns else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "plain"),
    [
        ("<b>{{c1::bold answer}}</b>", "bold answer"),
        ("{{c2::a::hint}} b", "a b"),
        ("use <code>&lt;div&gt;</code> here", "use <div> here"),
        ("&amp;lt;", "<"),
        ("a<br>b<p>c</p>d&nbsp;e", "a b c d e"),
        ("", ""),
    ],
)
def test_strip_html(spark, raw, plain):
    assert value(spark, tx.strip_html(F.lit(raw))) == plain


def test_text_functions(spark):
    v = lambda c: value(spark, c)
    assert v(tx.normalize_whitespace(F.lit("  a \t b \r\n\n  c"))) == "a b\nc"
    assert v(tx.wikilinks(F.lit("[[ A |x]] and [[B12]]"))) == ["A", "B12"]
    assert v(tx.embedded_images(F.lit("![[x.png]] ![alt](y.png) ![](x.png)"))) == ["x.png", "y.png"]
    assert v(tx.image_urls(F.lit('<img src="/a.png"><IMG alt=1 src=\'b.png\'><img src="//h/c"><img src="http://z/d">'), F.lit("http://h/p/q"))) == ["http://h/a.png", "http://h/p/b.png", "https://h/c", "http://z/d"]
    assert v(tx.slug(F.lit("Straße & Él!  x"))) == "strase-el-x"
    assert v(tx.slug(F.lit("word " * 20))) == "-".join(["word"] * 10)[:49]
    assert v(tx.card_slug(F.lit("Rust & Go"), F.lit("Own_ership"), F.lit(3), F.lit("EN"))) == "rust-go-own-ership-3-en"
    assert len(v(tx.card_slug(F.lit("topic " * 30), F.lit("word " * 30), F.lit(3), F.lit("en")))) <= 100
    assert tuple(v(tx.slug_parts(F.lit("a-b-c-d-12-en")))) == ("a-b", "c-d", 12, "en") and tuple(v(tx.slug_parts(F.lit("plain-x")))) == ("plain-x", "", 0, "")
    assert v(tx.title(F.lit("x\n# Head \ny"))) == "Head" and v(tx.title(F.lit("no"))) is None
    assert v(tx.frontmatter(F.lit("---\na: 1\n---\nbody"))) == "a: 1" and v(tx.body(F.lit("---\na: 1\n---\nbody"))) == "body"
    assert [tuple(s) for s in v(tx.sections(F.lit("pre\n# A\none\n## B\ntwo")))] == [("", 0, "pre"), ("A", 1, "one"), ("B", 2, "two")]
    assert v(tx.preview_label(F.lit(" a\nb "))) == "a b" and v(tx.preview_label(F.lit("  "))) == "asset"
    assert v(tx.truncated(F.lit("one two three"), 9)) == "one two..." and v(tx.truncated(F.lit("one"), 9)) == "one"
    assert v(tx.headline(F.lit("Rust rules, trust"), ["rust"])) == "<b>Rust</b> rules, trust"
    assert sorted(v(tx.trigrams(F.lit("cat")))) == ["  c", " ca", "at ", "cat"]
    assert v(tx.trigram_similarity(F.lit(""), F.lit(""))) == 0
    assert v(tx.html_to_markdown(F.lit("<h2 id=x>T</h2><ul><li>a</li></ul><p>b</p>"))) == "## T\n\n- a\nb"


def test_note_text(spark):
    row = spark.createDataFrame([([("Back", "A<br>1"), ("Front", "Q"), ("Src", "s"), ("Hint", "")], ["t"], ["D"]), ([("One", "x"), ("Two", "y")], [], [])], "f array<struct<name:string,value:string>>, t array<string>, d array<string>")
    got = [r[0] for r in row.select(tx.note_text(F.col("f"), F.col("t"), F.col("d"))).collect()]
    assert got == ["Front: Q\nBack: A 1\nSrc: s\nTags: t\nDecks: D", "Front: x\nBack: y"]


def test_hashes(spark):
    v = lambda c: value(spark, c)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert v(hashes.parts_hash("m", F.array(F.lit("a"), F.lit("b")))) == digest(b"m\0a\0b")[:16]
    assert v(hashes.content_hash(F.lit("f"), F.lit("b"))) == digest(b"f|b")[:12]
    assert v(hashes.item_id("fsrs", F.lit("s"), F.lit("d"))) == digest(b"fsrs:s:d")[:16] and v(hashes.item_id("", F.lit("s"), F.lit("d"))) == digest(b"s:d")[:16]
    assert v(hashes.chunk_id(F.lit(258).cast("long"), F.lit("k"), F.lit("x"))) == "258:k:" + digest((258).to_bytes(8, "little") + b"kx")[:12]
    assert v(hashes.little_endian(F.lit("01020304"), 8)) == 0x04030201


def test_quality(spark):
    s = quality.scores(F.lit("What is ownership?"), F.lit("Rust uses ownership to manage memory safely."), F.array().cast("array<string>"))
    row = spark.range(1).select(*[c.alias(k) for k, c in s.items()]).first()
    assert [row[d] for d in quality.DIMENSIONS] == [1, 1, 1, 1, 1, 0.5] and row["overall"] == pytest.approx(5.75 / 6.5)
    v = lambda c: value(spark, c)
    assert v(quality.clarity(F.lit("is it so, explain"))) == pytest.approx(0.1)
    assert v(quality.atomicity(F.lit("a and b or c android"))) == pytest.approx(0.6)
    assert v(quality.memorability(F.lit("\n".join(["- x"] * 8)))) == 0.5 and v(quality.testability(F.lit(""))) == 0
    assert v(quality.code_only(F.lit("short\n```\nx = 1\n```"))) and not v(quality.code_only(F.lit("only prose")))
    tagged = lambda *t: v(quality.relevance(F.lit("What tradeoffs?"), F.lit("b"), F.array(*[F.lit(x) for x in t]).cast("array<string>")))
    assert tagged() == pytest.approx(0.8) and tagged("skill::dead") == 0.2 and tagged("cs_testing") == 1 and tagged("kotlin_syntax") == pytest.approx(0.3)


def test_issues(spark):
    found = value(spark, quality.card_issues(F.lit("é" * 4), F.lit("```\nx \n\n\ny"), F.array(F.lit("a"), F.lit("a"), F.lit(""), F.lit("b c"))))
    assert [(i["severity"], i["message"]) for i in found] == [
        ("warning", "Front side is very short (8 chars)"),
        ("error", "Unmatched code fence in back"),
        ("warning", "Trailing whitespace in back"),
        ("warning", "Consecutive blank lines in back"),
        ("error", "Empty tag"),
        ("warning", "Tag 'b c' contains invalid characters"),
        ("warning", "Duplicate tag 'a'"),
        ("warning", "Card tests syntax recall or boilerplate -- consider transforming to a reasoning question"),
        ("info", "Card lacks a skill:: tag (skill::alive, skill::dead, or skill::neutral)"),
    ]
    assert not value(spark, quality.valid(quality.card_issues(F.lit(""), F.lit("long enough text"), F.array().cast("array<string>"))))


def test_html_issues(spark):
    found = value(spark, quality.html_issues(F.lit("<b><i>x</b></i></b><br><img/><script></script></p><!-- a --><u>"), "Back"))
    assert [i["message"] for i in found] == [
        "Mismatched closing tag </b>, expected </i> in back",
        "Forbidden HTML tag <script> in back",
        "Forbidden HTML tag <script> in back",
        "Unexpected closing tag </p> in back",
        "Unclosed tag <u> in back",
    ]


def test_tags(spark):
    v = lambda t: value(spark, tags.canonical(F.lit(t)))
    assert [v(t) for t in (" My_Tag::X ", "skill::dead", "cs_x", "a//b", "cognitive_bias")] == ["my-tag-x", "skill::dead", "cs_x", "a-b", "cognitive_bias"]
    assert value(spark, tags.canonical_list(F.array(F.lit("B"), F.lit("b"), F.lit(" ")))) == ["b"]
    assert value(spark, tags.problems(F.lit("a::b::c/d"))) == ["Use '::' for hierarchy, not '/': 'a::b::c/d'", "Tag too deep (max 2 levels): 'a::b::c/d' has 3 levels"]
    words = spark.createDataFrame([("rust",), ("rest",), ("trust",), ("ruse",), ("go",)], ["tag"])
    got = {(r["suggestion"], r["distance"]) for r in tags.suggestions(spark.createDataFrame([("rus",)], ["tag"]), words).collect()}
    assert got == {("rust", 0), ("ruse", 0), ("rest", 2)}
    audit = tags.audit(spark.createDataFrame([("rus",)], ["tag"]), words).first()
    assert audit["valid"] and audit["suggestions"] == ["ruse", "rust", "rest"]


def test_vectors(spark):
    v = lambda c: value(spark, c)
    a, b, zero = (F.array(*[F.lit(float(x)) for x in xs]) for xs in ((1, 2), (2, 4), (0, 0)))
    assert v(vectors.cosine(a, b)) == pytest.approx(1) and v(vectors.cosine(a, zero)) == 0
    mock = v(vectors.mock_embedding(F.lit("x"), 40))
    assert len(mock) == 40 and mock[0] == mock[32] and all(-1 <= x <= 1 for x in mock)
    docs = spark.createDataFrame([(1, "hello world hello test123"), (2, "--- !!!"), (3, None)], "id long, text string")
    rows = vectors.sparse_rows(docs, "id", "text").collect()
    assert {r["id"] for r in rows} == {1} and len(rows) == 3 and sum(r["weight"] ** 2 for r in rows) == pytest.approx(1)
    assert {r["idx"] for r in rows} == {int.from_bytes(hashlib.sha256(w).digest()[:4], "little") for w in (b"hello", b"world", b"test123")}


def test_card_format(spark):
    from recallgrid.functions import cards

    tags_ = F.array(*[F.lit(t) for t in ("a", "b", "c")])
    one = cards.rendered(F.lit("s-1"), F.lit("Missing"), tags_, F.lit("T"), F.lit("{{c1::x}} {{c2::y}}"), F.lit("n"))
    two = cards.rendered(F.lit("s-2"), F.lit("Simple"), tags_, F.lit("T"), F.lit("k"), F.lit("n"), 2)
    good = spark.range(1).select("id", cards.document(F.array(one, two)).alias("text"))
    assert cards.lint(good, "id", "text").collect() == []
    parsed = good.select(cards.blocks(F.col("text")).alias("b")).first()["b"]
    assert [(b["slug"], b["card_type"], b["tags"]) for b in parsed] == [("s-1", "Missing", ["a", "b", "c"]), ("s-2", "Simple", ["a", "b", "c"])]
    bad = good.select("id", F.replace(F.replace(F.replace(F.replace("text", F.lit("c2::"), F.lit("c3::")), F.lit("<!-- END_CARDS -->"), F.lit("")), F.lit("slug: s-2 "), F.lit("slug: s-1 ")), F.lit("Tags: a b c -->"), F.lit("Tags: a,B -->")).alias("text"))
    got = {(r["severity"], r["message"]) for r in cards.lint(bad, "id", "text").collect()}
    assert {("error", "Missing END_CARDS sentinel"), ("error", "Duplicate slug: s-1"), ("error", "Card s-1: Cloze numbering is not dense (gaps detected)"), ("error", "Card s-1: expected 3-6 tags, found 1")} <= got
    assert ("error", "Card s-1: manifest slug mismatch (header: s-1, manifest: s-2)") in got and ("warning", "Card s-1: tags should be lowercase") in got
    assert {r["message"] for r in cards.lint(spark.createDataFrame([(1, "x" * 100)], "id long, text string"), "id", "text").collect()} >= {"No Card blocks found", "Line 1 exceeds 88 character width limit"}
