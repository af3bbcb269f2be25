"""Notes of a vault: finding, reading and taking apart, as stated."""

import json
import os

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import text as tx
from recallgrid.sources import ingest, notes

pytest.importorskip("yaml")


@pytest.fixture
def vault(tmp_path):
    root = tmp_path / "v"
    for name, text in {"b.md": "# B", "a/_index.md": "one", "a/x y.md": "---\ntitle: T\n---\nbody", ".trash/t.md": "gone", "a/b/.git/c.md": "gone", "n.txt": "no", ".md": "no ending", "a/b/big.md": "x" * 101}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "out.md").write_text("outside")
    os.symlink(root / "b.md", root / "in.md")
    os.symlink(tmp_path / "out.md", root / "out.md")
    os.symlink(root / "a", root / "linked")
    os.symlink(root / "none.md", root / "broken.md")
    return root


def test_files_found(spark, vault):
    names = lambda **k: [os.path.relpath(r[0], vault) for r in notes.discovered(spark, str(vault), **k).collect()]
    assert names() == ["a/_index.md", "a/b/big.md", "a/x y.md", "b.md", "bad.md", "in.md"]
    assert names(patterns=("*.txt", "x.md", "*.a.md")) == ["n.txt"] and names(patterns=()) == []
    assert names(ignore=("a", "b.md", ".git")) == [".trash/t.md", "bad.md", "in.md"]
    with pytest.raises(FileNotFoundError):
        notes.discovered(spark, str(vault / "nowhere"))


def test_files_read(spark, vault):
    paths = [str(vault / n) for n in ("b.md", "bad.md", "a/b/big.md", "out.md", "a", "nowhere.md")] + [None]
    files = spark.createDataFrame([(p, 1) for p in paths], "path string, content int")
    got = {r["path"] and os.path.relpath(r["path"], vault): (r["content"], r["problem"]) for r in notes.read(files, str(vault), 100).collect()}
    assert got == {"b.md": ("# B", None), "bad.md": (None, "not UTF-8"), "a/b/big.md": (None, "too large"), "out.md": (None, "outside the vault"), "a": (None, "not a file"), "nowhere.md": (None, "not found"), None: (None, "not found")}
    whole = notes.parsed(notes.read(notes.discovered(spark, str(vault)), str(vault)))
    assert {os.path.basename(r["path"]): r["title"] for r in whole.collect()} == {"_index.md": None, "big.md": None, "x y.md": "T", "b.md": "B", "bad.md": None, "in.md": "B"}


def by_hand(text):
    """(yaml, body), read line end by line end."""
    if not text.startswith("---\n"):
        return None, text
    rest = text[4:]
    if rest.startswith("---\n"):
        return "", rest[4:]
    if rest == "---":
        return "", ""
    if "\n---" not in rest:
        return None, text
    yaml, _, after = rest.partition("\n---")
    return yaml, after[1:] if after.startswith("\n") else after


def test_frontmatter(spark):
    texts = ["", "x", "---\n---\nb", "---\n---", "---\n", "---\na: 1", "---\na: 1\n---", "---\na: 1\n---x\ny", "---\na: ä\n---\n\nb\n---\nc", "---\r\na: 1\n---\n", " ---\na: 1\n---\n"]
    got = notes.parsed(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string"))
    rows = {r["path"]: r for r in got.collect()}
    for i, t in enumerate(texts):
        assert rows[str(i)]["body"] == by_hand(t)[1], t
    split = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.frontmatter_split(F.col("t")).alias("p"))
    assert [tuple(r["p"]) for r in split.collect()] == [by_hand(t) for t in texts]
    put = spark.createDataFrame([(t,) for t in ("---\n---\nb", "---\nk: 1\n---", "b")], "t string").select(tx.with_frontmatter(F.col("t"), "k", F.lit("2")))
    assert [r[0] for r in put.collect()] == ["---\nk: 2\n---\nb", "---\nk: 2\n---\n", "---\nk: 2\n---\nb"]


def test_values(spark):
    yaml = "title: `A b`\ntags: [x, 1, null, 1.5, yes]\nwhen: 2024-01-02\nat: 1:30\nnested:\n  k: {a: true}\n1: one\nempty:\nhex: 0x10"
    cases = {"ok": yaml, "broken": "a: [1", "list": "- a", "none": "", "two": "a: 1\na: 2", "text": "title: 5"}
    rows = spark.createDataFrame([(k, f"---\n{v}\n---\n# H\nx") for k, v in cases.items()] + [("null", None)], "path string, content string")
    got = {r["path"]: r for r in notes.parsed(rows).collect()}
    values = {k: json.loads(v) for k, v in got["ok"]["frontmatter"].items()}
    assert got["broken"]["problem"] and got["broken"]["frontmatter"] is None and got["list"]["problem"] == "not a mapping"
    assert got["ok"]["title"] == "A b" and values["tags"] == ["x", 1, None, 1.5, "yes"] and values["when"] == "2024-01-02" and values["at"] == "1:30" and values["nested"] == {"k": {"a": True}} and values["1"] == "one" and values["empty"] is None and values["hex"] == 16
    assert got["none"]["frontmatter"] == {} and json.loads(got["two"]["frontmatter"]["a"]) == 2 and got["text"]["title"] == "H"
    assert got["null"]["sections"] is None and got["null"]["problem"] is None


def test_parts(spark):
    body = "before\n# One\ntext ![[a.png]] ![alt](b.svg)\n## Two \n\nmore ![](a.png) ![x](c.txt) ![y](d e.jpeg)\n####### no\n#no\n# \nnext"
    row = notes.parsed(spark.createDataFrame([("p", body)], "path string, content string")).first()
    assert row["title"] == "One" and [tuple(i) for i in row["images"]] == [("a.png", None), ("b.svg", "alt"), ("d e.jpeg", "y")]
    assert [tuple(s) for s in row["sections"]] == [("", "before\n"), ("# One", "text ![[a.png]] ![alt](b.svg)\n"), ("## Two ", "\nmore ![](a.png) ![x](c.txt) ![y](d e.jpeg)\n####### no\n#no\n"), ("# \nnext", "")]
    plain, head = notes.parsed(spark.createDataFrame([("p", ""), ("q", "# H\nx")], "path string, content string")).orderBy("path").collect()
    assert [tuple(s) for s in plain["sections"]] == [("", "")] and [tuple(s) for s in head["sections"]] == [("# H", "x")]


def test_taxonomy_file(spark, tmp_path):
    file = tmp_path / "t.yaml"
    file.write_text("topics:\n  - path: rust\n    description: d\n    children:\n      - path: rust/own\n        label: Own\n  - path: rust\n    label: R\n  - path: go/x\n")
    rows = lambda p: sorted(tuple(r) for r in notes.taxonomy_file(spark, str(p)).collect())
    assert rows(file) == [("go/x", "x", None), ("rust", "R", None), ("rust/own", "Own", None)]
    empty = tmp_path / "e.yaml"
    empty.write_text(" \n")
    assert rows(empty) == [] and rows(tmp_path / "no.yaml") == []
    empty.write_text("topics:\n  - label: x")
    with pytest.raises(ValueError):
        rows(empty)


def test_sources_by_kind(spark):
    texts = spark.createDataFrame([("d/a.md", "# Head\n#tag\nx ![[i.png]]")], "path string, content string")
    pages = spark.createDataFrame([("http://h/p", "<title>T</title>\n<h1>A</h1><p>b</p>")], "url string, html string")
    got = {r["source_type"]: (r["source"], r["title"], r["n_sections"], r["n_images"]) for r in ingest.documents({"text": texts, "web": pages}).collect()}
    assert got == {"text": ("d/a.md", "Head", 2, 1), "web": ("http://h/p", "T", 1, 0)}
    with pytest.raises(ValueError):
        ingest.documents({"pdf": texts})
