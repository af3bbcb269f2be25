"""Benchmark decontamination: a prefix-filtered containment join of item windows against whole documents.

A window is ten consecutive words of an item, or a shorter item as a whole. Its tokens are its three-word shingles.
The shingles are ordered by their document frequency over all documents; a document that contains the window contains
its rarest shingle, so that one shingle is the necessary prefix. Each place of a prefix shingle in a document fixes where
the window would start; the length and position must leave room for it, and its words are then compared one by one.

The items are taken in blocks of bounded size, each sent to the executors as arrays and run past all documents, so
neither the driver nor a task holds more of the benchmark than one block, however large it is. Documents are never
shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import fresh

WINDOW, SHINGLE = 10, 3
#: Bytes of item text in a block: with its index, some 100 MB in a task.
BLOCK_BYTES = 1 << 20
_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPANS = "array<struct<start:long,end:long>>"


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII digits and letters, lower-cased, and of all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_SPACE).split() if text else []


class Block:
    """The windows of some items, as arrays of word numbers."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.words: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                windows[tuple(ids[i : i + WINDOW])].add(item)
        self.windows = [np.array(w, np.int64) for w in windows]
        self.items = [sorted(x) for x in windows.values()]
        sizes = {min(len(w), SHINGLE) for w in self.windows}
        self.sizes = sorted(sizes)
        keys = [self.shingles(w, min(len(w), SHINGLE)) for w in self.windows]
        self.keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        self.places = [np.searchsorted(self.keys, k) for k in keys]

    def shingles(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A number for each run of ``size`` known words; runs with an unknown word (0) get 0."""
        n = len(ids) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        base, known = np.uint64(len(self.words) + 1), np.ones(n, bool)
        out = np.zeros(n, np.uint64)
        for k in range(size):
            part = ids[k : k + n]
            known &= part > 0
            out = out * base + part.astype(np.uint64)
        return np.where(known, out, np.uint64(0))

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.words.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def found(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, numbers of keys) of the block's shingles in a document, by shingle size."""
        for size in self.sizes:
            if not (keys := self.shingles(ids, size)).any():
                continue
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            where = np.flatnonzero((self.keys[at] == keys) & (keys > 0))
            yield where, at[where]

    def order(self, counts: np.ndarray) -> None:
        """Picks the rarest shingle of each window as its prefix; of equally rare ones the first."""
        offsets = [int(np.argmin(counts[p])) for p in self.places]
        prefix = np.array([p[o] for p, o in zip(self.places, offsets, strict=True)], np.int64)
        by = np.argsort(prefix, kind="stable")
        self.first = np.searchsorted(prefix[by], np.arange(len(self.keys) + 1))
        self.by, self.offset = by, np.array(offsets, np.int64)
        self.length = np.array([len(w) for w in self.windows], np.int64)
        del self.places

    def hits(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words, and the items, whose windows occur in a document."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for where, key in self.found(ids):
            some = np.flatnonzero(self.first[key + 1] > self.first[key])
            for at, k in zip(where[some].tolist(), key[some].tolist(), strict=True):
                for w in self.by[self.first[k] : self.first[k + 1]].tolist():
                    start = at - int(self.offset[w])
                    end = start + int(self.length[w])
                    if start >= 0 and end <= len(ids) and np.array_equal(ids[start:end], self.windows[w]):
                        spans.append((start, end))
                        items.update(self.items[w])
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items, spans) for each row of ``docs``.

    spans are the merged runs of hit words as [start, end) word numbers, items the sorted distinct item ids whose windows
    occur. A null or empty text has no words and no hits. Items with a null id or without words take no part; items
    that share an id are one item with the windows of both. Repeated documents each get their row; empty tables give no
    row or no hit. Other columns are ignored.
    """
    rows = _scanned(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), benchmark, "text", item_col)
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    n_items = F.size("__items").cast("long")
    return rows.select(id_col, F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), n_items.alias("n_items"), F.col("__items").alias("items"), F.col("__spans").alias("spans"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, in whose text no window of an item occurs.

    Null, empty and wordless texts stay, and so does every row if no item has words. Repeated rows and rows with a null
    id are judged by their text alone. An empty table gives no row.
    """
    return _scanned(docs, benchmark, text_col, item_col).where(F.size(fresh(docs, "__spans")[0]) == 0).select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): ``contamination`` with the items as a digest."""
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _scanned(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str) -> DataFrame:
    """``docs`` with __n_words, __items and __spans, or fresh names like these."""
    spark, names = docs.sparkSession, fresh(docs, "__n_words", "__items", "__spans")
    none = (F.lit(0).cast("long").alias(names[0]), F.array().cast("array<string>").alias(names[1]), F.array().cast(SPANS).alias(names[2]))
    rows = docs.select("*", *none)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        block = Block([(r["item"], r["text"]) for r in own.toLocalIterator()])
        sent = spark.sparkContext.broadcast(block)
        counts = np.zeros(len(block.keys), np.int64)
        for r in texts.mapInArrow(lambda it, s=sent: _counted(it, s.value), "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["key"]] = r["n"]
        block.order(counts)
        sent = spark.sparkContext.broadcast(block)
        rows = rows.mapInArrow(lambda it, s=sent: _marked(it, s.value, text_col, names), rows.schema)
    return rows


def _counted(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the block's shingles over a partition."""
    counts = np.zeros(len(block.keys), np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for _, key in block.found(block.ids(words_of(text))):
                counts[np.unique(key)] += 1
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["key", "n"])


def _marked(batches: Iterator[pa.RecordBatch], block: Block, text_col: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, items, spans = [], [], []
        for text, had, were in zip(*(batch.column(c).to_pylist() for c in (text_col, *names[1:])), strict=True):
            ids = block.ids(words_of(text))
            new, own = block.hits(ids)
            lengths.append(len(ids))
            items.append(sorted(own.union(had)))
            spans.append([{"start": s, "end": e} for s, e in merged(new + [(x["start"], x["end"]) for x in were])])
        for name, values in zip(names, (lengths, items, spans), strict=True):
            at = batch.schema.get_field_index(name)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
        yield batch
