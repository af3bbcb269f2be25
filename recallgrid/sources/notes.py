"""Markdown notes of a mounted vault: found and read by executors, taken apart into frontmatter, title, sections, images."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.functions import text as tx
from recallgrid.tables import written

#: Folders that are not searched, and the size of the largest file that is read (fixed values).
IGNORED = (".obsidian", ".trash", ".git")
MOST_BYTES = 10 << 20
#: Headings, first-level headings and embedded images (fixed values).
HEADING = r"(?Umd)^(#{1,6}\s+.+)$"
TITLE = r"(?Umd)^#\s+(.+)$"
IMAGE = r"\.(?:png|jpe?g|gif|webp|svg)"
WIKI_IMAGE = rf"!\[\[([^\]]+{IMAGE})\]\]"
MARKED_IMAGE = rf"!\[([^\]]*)\]\(([^)]+{IMAGE})\)"
#: What a plain scalar of YAML's core schema is, by kind (fixed values).
SCALARS = (
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+0123456789.")),
)


def _inside(path: str, root: str) -> bool:
    return path == root or path.startswith(root.rstrip("/") + "/")


def discovered(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("*.md",), ignore: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path) of a vault's files in order, at any depth.

    Executors list the folders of one level at a time. Links to folders are not followed, links to files count if the
    file is inside the root. A pattern is ``*.`` and an ending without a dot; others match nothing. A part of the path
    under the root that is called as one of ``ignore`` leaves a file out. A root that is missing is an error.
    """
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    top, skipped = os.path.realpath(root), set(ignore)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                rows = []
                with os.scandir(folder) as entries:
                    for e in entries:
                        if e.name in skipped:
                            continue
                        if e.is_dir(follow_symlinks=False):
                            rows.append((e.path, True))
                        elif e.is_file() and (not e.is_symlink() or _inside(os.path.realpath(e.path), top)):
                            rows.append((e.path, False))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["path", "folder"])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "folder"])

    level, found = spark.createDataFrame([(top,)], "path string"), []
    while not level.isEmpty():
        rows = written(level.repartition("path").mapInPandas(listed, "path string, folder boolean"), spark)
        found.append(rows.where("not folder").select("path"))
        level = rows.where("folder").select("path")
    name = F.element_at(F.split("path", "/"), -1)
    endings = [p[2:] for p in patterns if p.startswith("*.") and "." not in p[2:]]
    kept = name.rlike("|".join(rf"(?s)^.+\.{re.escape(e)}$" for e in endings)) if endings else F.lit(False)
    return reduce(DataFrame.unionByName, found).where(kept).orderBy("path")


def read(files: DataFrame, root: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, content, problem) of files, one row each. A file that is missing, no file, outside of ``root``, larger than
    ``most_bytes`` or not UTF-8 has a problem and no content."""
    top = os.path.realpath(root) if root else None

    def one(path: str | None) -> tuple[str | None, str | None]:
        if path is None or not os.path.exists(path):
            return None, "not found"
        real = os.path.realpath(path)
        if top and not _inside(real, top):
            return None, "outside the vault"
        if not os.path.isfile(real):
            return None, "not a file"
        if os.path.getsize(real) > most_bytes:
            return None, "too large"
        try:
            with open(real, encoding="utf-8", newline="") as f:
                return f.read(), None
        except UnicodeDecodeError:
            return None, "not UTF-8"

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield pd.DataFrame([(path, *one(path))], columns=["path", "content", "problem"])

    return files.select("path").mapInPandas(opened, "path string, content string, problem string")


def unquoted(yaml: Column) -> Column:
    """YAML lines whose value stands in backticks, without these."""
    return F.regexp_replace(F.regexp_replace(yaml, "\r\n", "\n"), r"(?Umd)^(?>(.*?: ))[\s&&[^\n]]*`(.*)`[\s&&[^\n]]*$", "$1$2")


def _loader() -> type:
    """A loader for plain data with the scalars of the core schema: dates, ``yes`` and ``1:30`` are text."""
    import yaml

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

        def construct_mapping(self, node: yaml.MappingNode, deep: bool = False) -> dict:
            if not isinstance(node, yaml.MappingNode):
                return super().construct_mapping(node, deep)
            if any(not isinstance(k, yaml.ScalarNode) for k, _ in node.value):
                raise yaml.constructor.ConstructorError(None, None, "a key is no scalar", node.start_mark)
            return {k.value: self.construct_object(v, deep=deep) for k, v in node.value}

        def construct_yaml_int(self, node: yaml.ScalarNode) -> int:
            v = node.value
            return int(v, 8 if v[:2] == "0o" else 16) if v[:2] in ("0o", "0x") else int(v)

    for kind, pattern, first in SCALARS:
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{kind}", re.compile(pattern), first)
    Loader.add_constructor("tag:yaml.org,2002:int", Loader.construct_yaml_int)
    return Loader


def parsed_yaml(text: str) -> dict | list | str | float | None:
    """The data of one YAML text; a fault is a ValueError."""
    import yaml

    try:
        return yaml.load(text, Loader=_loader())  # noqa: S506 - a loader of plain data
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        raise ValueError(" ".join(str(e).split())) from e


READ = T.StructType([T.StructField("values", T.MapType(T.StringType(), T.StringType())), T.StructField("problem", T.StringType())])


def _as_json(value: object) -> str:
    whole = lambda v: {k: whole(x) for k, x in v.items()} if isinstance(v, dict) else [whole(x) for x in v] if isinstance(v, list | tuple) else str(v) if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v
    return json.dumps(whole(value), ensure_ascii=False, default=str)


@F.pandas_udf(READ)
def yaml_values(texts: pd.Series) -> pd.DataFrame:
    """The keys of a YAML mapping, each with its value as JSON; text that is no mapping has a problem instead."""
    values, problems = [], []
    for text in texts:
        found, problem = {}, None
        try:
            data = parsed_yaml(text) if text else None
            if isinstance(data, dict):
                found = {k: _as_json(v) for k, v in data.items()}
            elif data is not None:
                problem = "not a mapping"
        except ValueError as e:
            problem = str(e)
        values.append(None if problem else found)
        problems.append(problem)
    return pd.DataFrame({"values": pd.Series(values, dtype=object), "problem": pd.Series(problems, dtype=object)})


def text_of(values: Column, key: str) -> Column:
    """The value of a key, if it is text."""
    v = values[key]
    return F.when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v"))


def sections(body: Column) -> Column:
    """(heading, content) in order: headings with their marks, contents as they stand but for the line end behind the
    heading. What comes before the first has an empty heading; a body without headings is one section."""
    heads = F.regexp_extract_all(body, F.lit(HEADING), F.lit(1))
    parts = F.split(body, HEADING, -1)
    cut = lambda x: F.when(x.startswith("\n"), F.substr(x, F.lit(2))).otherwise(x)
    headed = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x, i: F.struct(F.get(heads, i).alias("heading"), cut(x).alias("content")))
    first = F.transform(F.slice(parts, 1, 1), lambda x: F.struct(F.lit("").alias("heading"), x.alias("content")))
    return F.when((F.size(heads) > 0) & (F.get(parts, F.lit(0)) == ""), headed).otherwise(F.concat(first, headed))


def images(body: Column) -> Column:
    """(rel_path, description) of embedded images, each path once: wiki embeds, then marked ones with their text."""
    image = lambda path, text: F.struct(path.alias("rel_path"), text.cast("string").alias("description"))
    wiki = F.transform(F.regexp_extract_all(body, F.lit(WIKI_IMAGE), F.lit(1)), lambda p: image(p, F.lit(None)))
    alts, paths = (F.regexp_extract_all(body, F.lit(MARKED_IMAGE), F.lit(i)) for i in (1, 2))
    marked = F.zip_with(paths, alts, lambda p, a: image(p, F.nullif(a, F.lit(""))))
    empty = F.array().cast("array<struct<rel_path:string,description:string>>")
    has = lambda out, p: F.exists(out, lambda o: o["rel_path"] == p["rel_path"])
    return F.aggregate(F.concat(wiki, marked), empty, lambda out, p: F.when(has(out, p), out).otherwise(F.concat(out, F.array(p))))


def parsed(notes: DataFrame) -> DataFrame:
    """(path, content) with frontmatter (values as JSON by key), body, title, sections, images and problem.

    The title is the frontmatter's, if that is text, else the first heading of the first level. Frontmatter that can't be
    read gives a problem and no values. Null content gives nulls; a problem that the rows have stays.
    """
    before = F.col("problem") if "problem" in notes.columns else F.lit(None).cast("string")
    rows = notes.select("path", "content", before.alias("problem"), tx.frontmatter_split(F.col("content")).alias("parts"))
    rows = rows.withColumn("read", F.when(F.col("content").isNotNull(), yaml_values(unquoted(F.col("parts.yaml")))))
    values, body = F.col("read.values"), F.col("parts.body")
    heading = F.nullif(F.regexp_extract(body, TITLE, 1), F.lit(""))
    return rows.select(
        "path", "content", values.alias("frontmatter"), body.alias("body"), F.coalesce(text_of(values, "title"), heading).alias("title"),
        F.when(body.isNotNull(), sections(body)).alias("sections"), F.when(body.isNotNull(), images(body)).alias("images"), F.coalesce("problem", "read.problem").alias("problem"),
    )


def taxonomy_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, description) of the topics of a YAML file, at any depth: a vocabulary that people write.

    A missing label is the last part of the path; of topics with one path the last counts. A missing or empty file, or
    one without topics, gives no rows; a topic without a path is a ValueError.
    """
    text = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
    data = parsed_yaml(text) if text.strip() else None
    if data is not None and not isinstance(data, dict):
        raise ValueError("not a mapping")
    found, left = {}, list(reversed((data or {}).get("topics") or []))
    while left:
        topic = left.pop()
        if not isinstance(topic, dict) or not isinstance(topic.get("path"), str):
            raise ValueError("a topic has no path")
        found[topic["path"]] = (topic["path"], topic.get("label") or topic["path"].rpartition("/")[2], topic.get("description"))
        left += reversed(topic.get("children") or [])
    return spark.createDataFrame(list(found.values()), "path string, label string, description string")
