"""Written tables: intermediate ones that cut lineage, and versioned ones with upserts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.session import shared_folder


def written(df: DataFrame, spark: SparkSession | None = None, **options: object) -> DataFrame:
    """The same rows, read from a table in the shared folder; ``options`` are the writer's.

    Cuts the lineage: a lost executor costs the tasks that read the table, never the stages before it.
    """
    spark = spark or df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table made by ``written`` once nothing reads it any more."""
    _delete(df.sparkSession, df.written_to)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; columns in ``keep`` stay as they were on rows that existed."""
    if not keep:
        return old.join(new, keys, "left_anti").unionByName(new)
    before = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep], F.lit(True).alias("__was"))
    rows = new.join(before, keys, "left")
    kept = {c: F.when(F.col("__was"), F.col(f"__{c}")).otherwise(F.col(c)) for c in keep}
    return old.join(new, keys, "left_anti").unionByName(rows.withColumns(kept).select(*old.columns))


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with only those rows of ``new`` whose key it doesn't have."""
    return old.unionByName(new.join(old, keys, "left_anti"))


def soft_deleted(active: DataFrame, snapshot: DataFrame, keys: list[str], now: Column, column: str = "deleted_at") -> DataFrame:
    """Rows missing from a snapshot get ``now`` as their time of deletion, if they have none; an empty one deletes all."""
    seen = snapshot.select(*keys).distinct().withColumn("__seen", F.lit(True))
    rows = active.join(seen, keys, "left")
    return rows.withColumn(column, F.when(F.col("__seen").isNull() & F.col(column).isNull(), now).otherwise(F.col(column))).select(*active.columns)


def numbered(df: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with numbers from 1 in the order of some columns, and from 1 again for each value of those in ``by``.

    Rows are range-sorted, each partition numbers its own, and what comes before it is added from counts by partition: no
    group is in one task, however large. Rows that are equal in all these columns are numbered in any order.
    """
    by = by or []
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    at = F.monotonically_increasing_id()
    ranged = written(ranged.withColumns({"__part": F.spark_partition_id(), "__at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    w = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = ranged.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = written(parts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n"))  # a row for each group and partition that it is in
    on = F.lit(True)
    other = before.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__p"), "__first", "__before")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    rows = ranged.join(other, (F.col("__part") == F.col("__p")) & on)
    return rows.withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1).select(*df.columns, name)


class Store:
    """Tables in versioned folders. A manifest names the current version of every table; a new one is put in place of the
    old by one rename, so that readers see all tables of one write or none."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> dict[str, str]:
        """The current version of each table: the manifest with the highest number."""
        p, fs = _path(self.spark, f"{self.root}/manifests")
        if not fs.exists(p):
            return {}
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        found = sorted(int(n) for n in names if n.isdigit())
        if not found:
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/manifests/{found[-1]}").collect())) | {"": str(found[-1])}

    def version(self, name: str) -> str | None:
        return self.manifest().get(name)

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The current rows; without a version an empty table of ``schema``."""
        version = self.version(name)
        if version is None:
            if schema is None:
                raise ValueError(f"no table {name}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def applied(self, stream: str) -> int:
        """The last batch of a stream that a manifest has, -1 if there is none."""
        return int(self.manifest().get(f"@{stream}", -1))

    def write(self, tables: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> None:
        """Writes new versions of all tables, then the manifest that names them: a failure at any point leaves every old
        version in place. Of two writers that started from one manifest the second to end fails. ``batch``, a stream's
        name and the number of its batch, is part of that manifest: the tables and the number change together."""
        now = self.manifest()
        if batch:
            now[f"@{batch[0]}"] = str(batch[1])
        number = int(now.pop("", 0)) + 1
        for name, df in tables.items():
            now[name] = uuid.uuid4().hex
            df.write.parquet(f"{self.root}/{name}/{now[name]}")
        made, fs = _path(self.spark, f"{self.root}/manifests/{uuid.uuid4().hex}.tmp")
        place, _ = _path(self.spark, f"{self.root}/manifests/{number}")
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(made, place):
            fs.delete(made, False)
            raise RuntimeError(f"another write has made manifest {number} of {self.root}")
