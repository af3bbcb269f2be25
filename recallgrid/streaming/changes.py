"""Change detection on a stream of chunk versions: only chunks of notes whose hash changed go on to be embedded."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastHash(StatefulProcessor):
    """Keeps the last hash of each note, for a time after it was last seen, and gives the rows of versions that change it."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "content_hash string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        versions = pd.concat(list(rows)).sort_values("version", kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        for _, own in versions.groupby("version"):
            if (now := own["content_hash"].iloc[0]) != last:
                last = now
                yield own
        self.last.update((last,))


def changed_chunks(versions: DataFrame, keep: int = 30 * 24 * 3600) -> DataFrame:
    """The rows of a stream (note_id, version, content_hash, ...) whose note had another hash before, or none.

    All rows of a note's version have the hash of the whole note. Versions of a note come in ascending order, in one batch
    or in several; the result is then that of ``sync.changed_versions`` over all of them, however they are split. A note
    that isn't seen for ``keep`` seconds is forgotten, and given again when it comes. State is a hash for each note, kept
    in RocksDB; a batch holds the rows of one note at a time.
    """
    versions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return versions.groupBy("note_id").transformWithStateInPandas(LastHash(keep * 1000), versions.schema, "Append", "ProcessingTime")
