"""Scanners of work items under one interface, and runs of them over a stored queue."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.operators import duplicates, worklist
from recallgrid.tables import Store, discard, written

Tables = dict[str, DataFrame]
#: A stored item: what scanners give, then what runs add.
STORED = (
    "id string, loop_kind string, kind string, dimension string, score double, message string, tier int, status string, slug string, source_path string, confidence double, "
    "cluster_id string, scan_number int, first_seen timestamp, resolved_at timestamp, attestation string"
)
PROGRESS = "at timestamp, action string, scan_number int, found long, resolved long, note string, overall_before double, overall_after double"
LOOPS = ("audit", "generation")


@dataclass(frozen=True)
class Scanner:
    """A named function from tables to items of one loop. ``needs`` are the tables that it reads; a required one ends the
    run if it fails, another is left out with a warning."""

    name: str
    loop: str
    needs: tuple[str, ...]
    scan: Callable[[Tables, Column], DataFrame]
    required: bool = False


SCANNERS: dict[str, Scanner] = {}


def scanner(name: str, loop: str, *needs: str, required: bool = False) -> Callable:
    """Registers a function (tables, now) -> items by a name; items have the columns of ``worklist.ITEM``."""
    if loop not in LOOPS:
        raise ValueError(f"unknown loop: {loop}")

    def add(scan: Callable[[Tables, Column], DataFrame]) -> Callable[[Tables, Column], DataFrame]:
        SCANNERS[name] = Scanner(name, loop, needs, scan, required)
        return scan

    return add


@scanner("audit", "audit", "registry", required=True)
def _audit(tables: Tables, now: Column) -> DataFrame:
    return worklist.audit(tables["registry"])


@scanner("retention", "audit", "registry", "cards", "card_stats")
def _retention(tables: Tables, now: Column) -> DataFrame:
    return worklist.retention(tables["cards"], tables["card_stats"], tables["registry"], now)


@scanner("stale", "audit", "registry", "files")
def _stale(tables: Tables, now: Column) -> DataFrame:
    return worklist.stale(tables["registry"], tables["files"])


@scanner("uncovered", "generation", "registry", "vault")
def _uncovered(tables: Tables, now: Column) -> DataFrame:
    return worklist.uncovered(tables["vault"], tables["registry"])


@scanner("duplicates", "audit", "registry", "duplicates")
def _duplicates(tables: Tables, now: Column) -> DataFrame:
    """``duplicates`` has the members of clusters (representative, size, note_id, similarity)."""
    slugs = tables["registry"].where("note_id is not null").groupBy("note_id").agg(F.max("slug").alias("slug"))
    found = duplicates.scanner_items(tables["duplicates"], slugs)
    return found.select(
        "id", "loop_kind", "kind", F.lit(None).cast("string").alias("dimension"), F.col("similarity").alias("score"), F.col("other_slug").alias("message"), "tier", F.lit("open").alias("status"), "slug",
        F.lit(None).cast("string").alias("source_path"), F.col("similarity").alias("confidence"),
    )


def chosen(tables: Iterable[str], loop: str = "all", names: Iterable[str] | None = None) -> list[Scanner]:
    """The scanners of a loop whose tables are all there, or those with the given names."""
    if loop not in (*LOOPS, "all"):
        raise ValueError(f"unknown loop: {loop}")
    if names is not None:
        return [SCANNERS[name] for name in names]
    return [s for s in SCANNERS.values() if loop in ("all", s.loop) and set(s.needs) <= set(tables)]


def detected(tables: Tables, scanners: list[Scanner], now: Column) -> tuple[DataFrame, dict[str, str]]:
    """(items of all scanners, each id once, and what went wrong in those that are not required)."""
    found, failed = [], {}
    for s in scanners:
        try:
            found.append(written(s.scan(tables, now).select(*worklist.ITEM)))
        except (PySparkException, KeyError) as error:
            if s.required:
                raise
            failed[s.name] = str(error).splitlines()[0]
    if not found:
        raise ValueError("no scanner gave items")
    return reduce(DataFrame.unionByName, found).dropDuplicates(["id"]), failed


def run(store: Store, tables: Tables, now: Column, loop: str = "all", names: Iterable[str] | None = None) -> dict[str, object]:
    """One scan: its number is one more than the last, what the scanners find is batched, put into the stored queue and
    reconciled with it, scores before and after are taken, and a line is added to the log of progress. The queue and the
    log change together. Open items of the loops of this run that weren't seen are resolved; a loop of which a scanner
    failed is not reconciled, as its items may only be unseen.

    Gives a summary: scan_number, found, resolved, failed, and the counts and scores of the queue.
    """
    stored, log = store.read("work_items", STORED), store.read("progress", PROGRESS)
    number = (log.where("action = 'scan'").agg(F.max("scan_number")).first()[0] or 0) + 1
    scanners = chosen(tables, loop, names)
    items, failed = detected(tables, scanners, now)
    items = written(worklist.batched(items).withColumn("scan_number", F.lit(number)))
    loops = sorted({s.loop for s in scanners} - {SCANNERS[name].loop for name in failed})
    after = written(worklist.reconciled(stored, items, loops, now))
    scores = lambda df: worklist.scores(df).first().asDict()
    was, is_ = scores(stored), scores(after)
    gone = after.where("status = 'fixed'").join(stored.where("status = 'open'"), "id", "left_semi").count()
    found = items.count()
    line = stored.sparkSession.range(1).select(
        now.alias("at"), F.lit("scan").alias("action"), F.lit(number).alias("scan_number"), F.lit(found).cast("long").alias("found"), F.lit(gone).cast("long").alias("resolved"),
        F.lit(f"scan #{number}: {found} items found, {gone} auto-resolved").alias("note"), F.lit(was["overall"]).alias("overall_before"), F.lit(is_["overall"]).alias("overall_after"),
    )
    store.write({"work_items": after, "progress": log.unionByName(line)})
    for table in (items, after):
        discard(table)
    return {"scan_number": number, "found": found, "resolved": gone, "failed": failed} | is_


def verified(items: DataFrame, changes: DataFrame, again: DataFrame, now: Column) -> DataFrame:
    """``items`` after ``worklist.moved`` by ``changes``, where those that were set fixed and that a new scan, ``again``
    (id, ...), still finds are open as before."""
    after = worklist.moved(items, changes, now)
    claimed = changes.where("to = 'fixed'").select("id").join(again.select("id").distinct(), "id", "left_semi")
    return worklist.moved(after, claimed.select("id", F.lit("open").alias("to"), F.lit(None).cast("string").alias("attestation")), now)
