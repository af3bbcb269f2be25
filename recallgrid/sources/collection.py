"""Reads flashcard collection files (SQLite, two layouts), markdown vaults and JSON logs."""

from __future__ import annotations

import re
import shutil
import uuid
from contextlib import closing
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.operators.sync import card_stats
from recallgrid.session import shared_folder
from recallgrid.sources.sqlite_source import opened, sqlite_table

SEPARATOR = "\x1f"


class Collection:
    """Tables of one collection file, read by executors. The file is copied first, so that the program that owns it isn't
    disturbed: into the folder that driver and executors share, which must be mounted on all machines."""

    def __init__(self, spark: SparkSession, path: str, rows: int = 100_000) -> None:
        self.spark, self.rows = spark, rows
        shared = urlsplit(shared_folder(spark))
        if shared.scheme not in ("", "file"):
            raise ValueError(f"collection files need a shared folder that is mounted, not {shared.scheme}:")
        self.folder = Path(shared.path) / f"collection-{uuid.uuid4().hex}"
        self.folder.mkdir(parents=True)
        self.copy = self.folder / "collection.db"
        shutil.copyfile(path, self.copy)
        with closing(opened(str(self.copy))) as db:
            self.names = {name for (name,) in db.execute("select name from sqlite_master where type = 'table'")}
        self.modern = "notetypes" in self.names

    def table(self, name: str, schema: str) -> DataFrame:
        """The rows of a table of the file, in partitions of row ids; equality on its columns is pushed down."""
        return sqlite_table(self.spark, str(self.copy), name, schema, self.rows)

    def _json(self, column: str, kind: str) -> DataFrame:
        """(key, value) of the JSON object in a column of the one row of an old file."""
        text = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("{}"))
        return self.table("col", f"{column} string").select(F.explode(F.from_json(text, f"map<string, {kind}>")))

    def decks(self) -> DataFrame:
        """(deck_id, name, parent_name)."""
        if self.modern:
            rows = self.table("decks", "id long, name string").select(F.col("id").alias("deck_id"), F.replace("name", F.lit(SEPARATOR), F.lit("::")).alias("name"))
        else:
            rows = self._json("decks", "struct<id:long,name:string>").select(F.coalesce("value.id", F.col("key").cast("long")).alias("deck_id"), "value.name")
        return rows.withColumn("parent_name", parent_deck(F.col("name")))

    def _parts(self, name: str) -> DataFrame:
        """(model_id, parts) of fields or templates, in their order."""
        parts = F.sort_array(F.collect_list(F.struct("ord", "name")))
        named = F.transform(parts, lambda p: F.struct(p["name"].alias("name"), p["ord"].alias("ord")))
        return self.table(name, "ntid long, ord int, name string").groupBy(F.col("ntid").alias("model_id")).agg(named.alias(name))

    def models(self) -> DataFrame:
        """(model_id, name, fields, templates): both in their order; a file without templates has none."""
        nothing = F.array().cast("array<struct<name:string,ord:int>>")
        if self.modern:
            rows = self.table("notetypes", "id long, name string").withColumnRenamed("id", "model_id").join(self._parts("fields"), "model_id", "left")
            rows = rows.join(self._parts("templates"), "model_id", "left") if "templates" in self.names else rows.withColumn("templates", nothing)
            return rows.select("model_id", "name", *[F.coalesce(c, nothing).alias(c) for c in ("fields", "templates")])
        part = "array<struct<name:string,ord:int>>"
        rows = self._json("models", f"struct<name:string,flds:{part},tmpls:{part}>").select(F.col("key").cast("long").alias("model_id"), "value.*")
        placed = lambda c: F.transform(F.array_sort(F.transform(F.coalesce(c, nothing), lambda p, i: F.struct(F.coalesce(p["ord"], i).alias("ord"), p["name"].alias("name")))), lambda p: F.struct(p["name"].alias("name"), p["ord"].alias("ord")))
        return rows.select("model_id", "name", placed("flds").alias("fields"), placed("tmpls").alias("templates"))

    def notes(self) -> DataFrame:
        rows = self.table("notes", "id long, mid long, mod long, tags string, flds string").toDF("note_id", "model_id", "mtime", "raw_tags", "raw_fields")
        names = self.models().select("model_id", F.transform("fields", lambda f: f["name"]).alias("names"))
        rows = rows.join(names, "model_id", "left").withColumns({"tags": split_tags(F.col("raw_tags")), "fields": named_fields(F.col("raw_fields"), F.col("names"))})
        return rows.select("note_id", "model_id", "mtime", "tags", "fields", "raw_fields")

    def cards(self) -> DataFrame:
        columns = "id long, nid long, did long, ord int, due int, ivl int, factor int, lapses int, reps int, queue int, type int, mod long, usn int"
        return self.table("cards", columns).toDF("card_id", "note_id", "deck_id", "ord", "due", "ivl", "ease", "lapses", "reps", "queue", "card_type", "mtime", "usn")

    def reviews(self) -> DataFrame:
        """All columns of the review log."""
        columns = "id long, cid long, usn int, ease int, ivl int, lastIvl int, factor int, time long, type int"
        return self.table("revlog", columns).toDF("review_ms", "card_id", "usn", "ease", "ivl", "last_ivl", "factor", "time_ms", "review_type")

    def tables(self) -> dict[str, DataFrame]:
        """All tables, with the statistics of the log, as ``sync`` takes them."""
        return {"decks": self.decks(), "models": self.models(), "notes": self.notes(), "cards": self.cards(), "reviews": self.reviews(), "card_stats": card_stats(self.reviews())}

    def close(self) -> None:
        """Removes the copy; tables of it can't be read any more."""
        shutil.rmtree(self.folder)


def parent_deck(name: Column) -> Column:
    return F.when(name.contains("::"), F.regexp_extract(name, "^(.*)::", 1))


def split_tags(raw: Column) -> Column:
    return F.filter(F.split(F.coalesce(raw, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def named_fields(raw: Column, names: Column) -> Column:
    """(name, value) by place; fields without a name are called ``Field`` and their number."""
    at = lambda i: F.coalesce(F.get(names, i), F.concat(F.lit("Field"), i.cast("string")))
    return F.transform(F.split(raw, SEPARATOR, -1), lambda v, i: F.struct(at(i).alias("name"), v.alias("value")))


def vault(spark: SparkSession, root: str, pattern: str = "*.md", ignore: tuple[str, ...] = (), most_bytes: int = 10 << 20) -> DataFrame:
    """(path, content) of a folder's notes, at any depth, without ignored folders and files that are too large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    files = files.where(F.col("length") <= most_bytes)
    for name in ignore:
        files = files.where(~F.col("path").contains(f"/{name}/"))
    return files.select("path", F.decode("content", "UTF-8").alias("content"))


def log_tail(spark: SparkSession, path: str, schema: str, n: int, order: str) -> DataFrame:
    """The last ``n`` well-formed lines of a JSON log."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc(order)).limit(n)


def card_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, front, back, tags) of files that hold front, back and one tag per line, parted by lines of dashes."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\n---\n", 3).alias("p"))
    tags = F.filter(F.transform(F.split(F.coalesce(F.get("p", F.lit(2)), F.lit("")), "\n"), lambda x: F.trim(x)), lambda t: t != "")
    return files.select("path", F.get("p", F.lit(0)).alias("front"), F.get("p", F.lit(1)).alias("back"), tags.alias("tags"))


def taxonomy_rows(tree: list[dict], above: str = "") -> list[tuple[str, str]]:
    """(path, label) of a parsed taxonomy file, parents first; a label defaults to the last segment."""
    out = []
    for node in tree or []:
        path = node["path"] if "path" in node else "/".join(x for x in (above, node.get("name", "")) if x)
        out.append((path, node.get("label") or path.rpartition("/")[2]))
        out += taxonomy_rows(node.get("children", []), path)
    return out


def media_digests(spark: SparkSession, root: str, refs: DataFrame) -> DataFrame:
    """(path, length, digest) of the files under a folder that ``refs`` (path, relative to it) names; missing files give
    no row, and a file is hashed once, however often it is named."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    own = F.regexp_extract("path", rf"{re.escape(root.rstrip('/'))}/(.+)$", 1)
    files = files.select(own.alias("path"), "length", F.sha2("content", 256).alias("digest"))
    return files.join(refs.select("path").distinct(), "path", "left_semi")


def write_tag_file(tags: DataFrame, path: str) -> None:
    """Rewrites a tag list as sorted distinct lines, as one file: it is a vocabulary that people edit."""
    tags.select(F.trim("tag").alias("value")).where("value <> ''").distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(path)
