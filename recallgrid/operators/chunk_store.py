"""A stored collection of embedded chunks, and the runs that keep it in step with the notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.vectors import similarity_of
from recallgrid.operators import sync
from recallgrid.operators.neighbours import nearest
from recallgrid.tables import Store, numbered, upserted, written

#: The layout of stored vectors; another one needs a new index.
SCHEMA = "dense-cosine-1"
CHUNKS = "chunk_id string, source string, content string, vector array<float>, metadata map<string,string>"
INDEX = "note_id long, chunk_id string, content_hash string, vector array<float>"
SETTINGS = "dimension int, model string, schema string"


class DimensionMismatch(ValueError):
    """Vectors of another length than the collection's."""


class ChunkStore:
    """Chunks with their vectors in a table of a store, by ``chunk_id``; its settings change in the same write."""

    def __init__(self, store: Store, name: str = "chunks", schema: str = CHUNKS) -> None:
        self.store, self.name, self.schema = store, name, schema

    def settings(self) -> dict | None:
        """dimension, model and schema, None before the collection is made."""
        if self.store.version(f"{self.name}_settings") is None:
            return None
        return self.store.read(f"{self.name}_settings").first().asDict()

    def dimension(self) -> int | None:
        found = self.settings()
        return found and found["dimension"]

    def rows(self) -> DataFrame:
        return self.store.read(self.name, self.schema)

    def _write(self, rows: DataFrame, settings: dict | None = None) -> None:
        new = {self.name: rows}
        if settings:
            new[f"{self.name}_settings"] = self.store.spark.createDataFrame([(settings["dimension"], settings["model"], settings["schema"])], SETTINGS)
        self.store.write(new)

    def ensure(self, dimension: int, model: str = "") -> bool:
        """Makes the collection if it isn't there, and says whether it did; another dimension is an error."""
        now = self.dimension()
        if now is not None and now != dimension:
            raise DimensionMismatch(f"{self.name} has dimension {now}, not {dimension}")
        if now is None:
            self.recreate(dimension, model)
        return now is None

    def recreate(self, dimension: int, model: str = "") -> None:
        """An empty collection in place of the old one."""
        self._write(self.store.spark.createDataFrame([], self.schema), {"dimension": dimension, "model": model, "schema": SCHEMA})

    def reset(self) -> None:
        """Drops all chunks; the settings stay."""
        self._write(self.rows().limit(0))

    def add(self, rows: DataFrame) -> int:
        """Puts chunks in by id and gives the number of new ids. Of rows with one id that which sorts first is taken; a
        row without id, or with a vector of another length or none, fails the whole call before anything is written."""
        dimension = self.dimension()
        if dimension is None:
            raise ValueError(f"no collection {self.name}")
        names = self.rows().columns
        order = ["source", "content", F.to_json(F.struct("vector", "metadata"))]
        first = rows.withColumn("__n", F.row_number().over(W.partitionBy("chunk_id").orderBy(*order))).where("__n = 1").select(*names)
        first = written(first.withColumn("vector", F.col("vector").cast("array<float>")), self.store.spark)
        wrong = F.count_if((F.coalesce(F.size("vector"), F.lit(-1)) != dimension) | F.exists("vector", lambda x: x.isNull()))
        faults, without = first.agg(wrong, F.count_if(F.col("chunk_id").isNull())).first()
        if without:
            raise ValueError("chunks without an id")
        if faults:
            raise DimensionMismatch(f"{faults} vectors are not of dimension {dimension}")
        old = self.rows()
        new = first.join(old.select("chunk_id"), "chunk_id", "left_anti").count()
        self._write(upserted(old, first, ["chunk_id"]))
        return new

    def delete_by_source(self, sources: DataFrame) -> int:
        """Drops the chunks of ``sources`` (source) and gives their number."""
        old = self.rows()
        gone = old.join(sources.select("source").distinct(), "source", "left_semi").count()
        if gone:
            self._write(old.join(sources.select("source").distinct(), "source", "left_anti").select(*old.columns))
        return gone

    def count(self) -> int:
        return self.rows().count()

    def stats(self) -> DataFrame:
        """One row: chunks, sources, and the topics of the metadata in order."""
        topic = F.col("metadata")["topic"]
        return self.rows().agg(F.count("*").alias("total_chunks"), F.countDistinct("source").alias("unique_files"), F.sort_array(F.collect_set(topic)).alias("topics"))

    def search(self, queries: DataFrame, k: int, field: str | None = None, value: str | None = None, least: float = 0.0) -> DataFrame:
        """(query_id, chunk_id, source, content, score, similarity, rank) of the ``k`` nearest to each of ``queries``
        (query_id, vector), of those whose metadata has the value, if a field is given. The score is the cosine distance;
        hits of less than the least similarity are left out. Equal scores are ordered by chunk id."""
        some = self.rows() if field is None else self.rows().where(F.col("metadata")[field] == value)
        keyed = written(numbered(some, ["chunk_id"], "id"), self.store.spark)
        asked = numbered(queries.select("query_id", "vector"), ["query_id"], "n").withColumn("q", -F.col("n"))
        asked = written(asked, self.store.spark)
        found = nearest(asked.select("q", "vector"), keyed, k, query_id="q").withColumnRenamed("score", "cosine")
        hits = found.join(asked.select("q", "query_id"), "q").join(keyed.select("id", "chunk_id", "source", "content"), "id")
        hits = hits.withColumn("score", 1 - F.col("cosine")).withColumn("similarity", similarity_of(F.col("score")))
        return hits.where(F.col("similarity") >= least).select("query_id", "chunk_id", "source", "content", "score", "similarity", "rank")


def index_notes(store: Store, notes: DataFrame, model: str, dimension: int, embed: Callable[[Column], Column], force: bool = False, name: str = "index") -> dict:
    """One run of the index over notes (note_id, text, deleted): a summary of it.

    An index that is missing, or of another dimension, model or layout, is made anew and all chunks are embedded. Else
    only those of new and changed notes are, or all with ``force``; deleted and missing notes leave the index. Vectors and
    settings change in one write, so a run that fails leaves the old index whole.
    """
    kept = ChunkStore(store, name, INDEX)
    wanted = {"dimension": dimension, "model": model, "schema": SCHEMA}
    reason = sync.needs_reindex(kept.settings(), wanted)
    spark = store.spark
    index = spark.createDataFrame([], INDEX) if reason else kept.rows()
    now = written(sync.chunks(notes.where(~F.coalesce("deleted", F.lit(False))), model), spark)
    todo = now if force or reason else sync.changed(now, index)
    embedded, chunks = todo.count(), now.count()
    removed = kept.rows().join(now, "note_id", "left_anti").agg(F.countDistinct("note_id")).first()[0]
    made = written(sync.indexed(now, index, embed, bool(force or reason)).withColumn("vector", F.col("vector").cast("array<float>")), spark)
    wrong = made.where(F.coalesce(F.size("vector"), F.lit(-1)) != dimension).count()
    if wrong:
        raise DimensionMismatch(f"{wrong} vectors are not of dimension {dimension}")
    kept._write(made, wanted)
    return {"reason": reason, "forced": bool(force or reason), "chunks": chunks, "embedded": embedded, "skipped": chunks - embedded, "removed_notes": removed}
