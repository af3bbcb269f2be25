"""Ranked lexical search over a length-stratified index.

A document's length enters its score through the whole number m alone, so documents with equal m form a stratum: inside
it a posting's impact depends on its tf and on nothing else. The index has a row for each stratum, or for each shard of a
large one, with its documents and, for each term, its postings by tf. Impacts are computed once for each tf, and the
largest tf of each term gives an upper bound of what a query can score in that stratum.

A search takes a stated set of queries in blocks of bounded size. It bounds every stratum for every query from the terms
and largest tfs alone, visits each query's most promising strata first, which gives it a score that its last result must
reach, and then visits, from the largest bound on, the strata whose bound reaches the score that the query holds by then.
A stratum that is passed by can't change a result, so the results are those of scoring everything.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.llm.common import BROADCAST_ROWS, slices
from recallgrid.llm.decontaminate import words_of
from recallgrid.tables import discard, written

#: Postings and documents of a shard, shards of a file and of those that a task bounds together.
POSTINGS, DOCUMENTS, ROWS, TOGETHER = 1 << 16, 4096, 128, 32
#: Bytes of query text in a block, terms that a query set may have for the index to leave out all others.
BLOCK_BYTES, VOCABULARY = 1 << 20, 200_000
#: Strata that each query visits first.
FIRST = 4
COUNTS = "row long, doc_id long, n long, terms array<string>, tfs array<int>"
SHARDS = "m long, shard long, doc_ids array<long>, terms array<string>, largest array<int>, group_of array<int>, tfs array<int>, starts array<int>, docs array<int>"


@dataclass
class Index:
    """The shards, the document frequency of each term (term, df), and N documents with a term."""

    shards: DataFrame
    frequencies: DataFrame
    n: int

    def discard(self) -> None:
        discard(self.shards)
        discard(self.frequencies)


def _counted(batches: Iterator[pa.RecordBatch], wanted: frozenset[bytes] | None) -> Iterator[pa.RecordBatch]:
    """(row, id, n, terms, tfs): the terms of each text, or the wanted ones among them; n counts all with repeats."""
    row = TaskContext.get().partitionId() << 40
    for batch in slices(batches):
        n, terms, tfs, ends = [], [], [], [0]
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            n.append(len(words))
            counts = {w.decode(): c for w, c in Counter(words).items() if wanted is None or w in wanted}
            terms.extend(counts)
            tfs.extend(counts.values())
            ends.append(len(terms))
        at = pa.array(ends, pa.int32())
        lists = pa.ListArray.from_arrays(at, pa.array(terms, pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(range(row, row + batch.num_rows), pa.int64()), batch.column(0), pa.array(n, pa.int64()), *lists], [x.split()[0] for x in COUNTS.split(", ")])
        row += batch.num_rows


def vocabulary(queries: DataFrame, text_col: str = "text") -> frozenset[str] | None:
    """The terms of a stated query set for ``index``, or None where there are more than VOCABULARY."""
    texts = queries.select(F.lit(None).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    terms = texts.mapInArrow(lambda it: _counted(it, None), COUNTS).select(F.explode("terms").alias("term")).distinct().limit(VOCABULARY + 1)
    found = [r["term"] for r in terms.toLocalIterator()]
    return frozenset(found) if len(found) <= VOCABULARY else None


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: frozenset[str] | None = None) -> Index:
    """The index of all ``docs``; with ``terms`` it has the postings of those alone, and counts and lengths of all.

    Each row is a document of its own, whether its id is null or repeats; a document without terms is not indexed. Strata
    are cut into shards of bounded size by the number of the row, so that no task holds a large one.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(terms and frozenset(t.encode() for t in terms))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = written(texts.mapInArrow(lambda it: _counted(it, sent.value), COUNTS).where("n > 0"))
    n, length = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies = written(counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    m = F.expr(f"50 + (50 * n * {n}L) div {max(length, 1)}L")
    rows = counts.where(F.size("terms") > 0).withColumn("m", m)
    strata = rows.groupBy("m").agg(F.ceil(F.greatest(F.sum(F.size("terms")) / POSTINGS, F.count("*") / DOCUMENTS)).alias("shards"))
    strata = written(strata)  # a row for each length at most
    dealt = rows.join(F.broadcast(strata) if strata.count() <= BROADCAST_ROWS else strata, "m").withColumn("shard", F.col("row") % F.col("shards"))
    shards = dealt.select("m", "shard", "row", "doc_id", "terms", "tfs").groupBy("m", "shard").applyInArrow(_shard, SHARDS)
    out = written(shards, maxRecordsPerFile=ROWS)  # a reader's batch doesn't go beyond a file
    for table in (counts, strata):
        discard(table)
    return Index(out, frequencies, n)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _shard(rows: pa.Table) -> pa.Table:
    """One row: documents by number, distinct terms, and each term's postings by falling tf.

    ``tfs`` has a number for each (term, tf), ``starts`` where its documents begin in ``docs``, and ``group_of`` where
    each term's numbers begin.
    """
    rows = rows.sort_by("row").combine_chunks()
    terms, tfs = rows.column("terms").combine_chunks(), rows.column("tfs").combine_chunks()
    sizes = pc.list_value_length(terms).to_numpy()
    coded = terms.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    term, tf, doc = place[coded.indices.to_numpy()], tfs.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
    by = np.lexsort((doc, -tf, term))
    term, tf, doc = term[by], tf[by], doc[by]
    new = np.append(True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1]))
    starts = np.append(np.flatnonzero(new), len(term))
    group_of = np.searchsorted(term[new], np.arange(len(order) + 1))
    columns = [
        rows.column("m").slice(0, 1).combine_chunks(), rows.column("shard").slice(0, 1).combine_chunks(),
        pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column("doc_id").combine_chunks()),
        pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), coded.dictionary.take(pa.array(order))),
        _lists(tf[new][group_of[:-1]], pa.int32()), _lists(group_of, pa.int32()), _lists(tf[new], pa.int32()), _lists(starts, pa.int32()), _lists(doc, pa.int32()),
    ]
    return pa.table(columns, [x.split()[0] for x in SHARDS.split(", ")])


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Queries:
    """A block of queries: their ids, the terms of them all, and of each query the numbers and weights of its own."""

    def __init__(self, rows: list[tuple[object, str, int]]) -> None:
        self.ids = sorted({q for q, _, _ in rows})
        terms = sorted({t for _, t, _ in rows})
        number, own = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(self.ids)}
        self.terms = pa.array(terms, pa.string())
        at = sorted((own[q], number[t], w) for q, t, w in rows)
        self.term, self.weight = np.array([x[1] for x in at], np.int64), np.array([x[2] for x in at], np.int64)
        self.first = np.searchsorted([x[0] for x in at], np.arange(len(self.ids) + 1))
        self.least = np.zeros(len(self.ids), np.int64)  # a score that the last result has at least

    def bounds(self, shard: dict) -> tuple[np.ndarray, np.ndarray]:
        """What each query can score in a shard at most, and where each of the block's terms stands there (-1: nowhere)."""
        place = pc.index_in(self.terms, shard["terms"]).fill_null(-1).to_numpy()
        most = np.where(place >= 0, impact(shard["largest"][place], shard["m"]), 0)
        return np.add.reduceat(self.weight * most[self.term], self.first[:-1]), place


def _shards(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, strings as Arrow has them and numbers as arrays."""
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i] for name in batch.schema.names}
        yield {k: v.as_py() if k in ("m", "shard") else v.values if k in ("terms", "doc_ids") else v.values.to_numpy() for k, v in row.items()}


def _promising(batches: Iterator[pa.RecordBatch], block: Queries, first: int) -> Iterator[pa.RecordBatch]:
    """(query number, m, shard, bound): of a task's shards those with the largest bounds for each query."""
    best: list[list[tuple[int, int, int]]] = [[] for _ in block.ids]
    for batch in batches:
        for shard in _shards(batch):
            bounds, _ = block.bounds(shard)
            for q in np.flatnonzero(bounds > 0):
                own = best[q]
                if len(own) < first or bounds[q] > own[-1][0]:
                    own.append((int(bounds[q]), shard["m"], shard["shard"]))
                    own.sort(reverse=True)
                    del own[first:]
    rows = [(q, m, s, b) for q, own in enumerate(best) for b, m, s in own]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["q", "m", "shard", "bound"])


class Best:
    """The best results of each query so far, by falling score and then by id; null ids come last."""

    def __init__(self, block: Queries, k: int) -> None:
        self.k, self.least = k, block.least.copy()
        self.score = [np.zeros(0, np.int64) for _ in block.ids]
        self.doc = [np.zeros(0, np.int64) for _ in block.ids]
        self.known = [np.zeros(0, bool) for _ in block.ids]

    def add(self, q: int, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        score, doc, known = np.append(self.score[q], score), np.append(self.doc[q], doc), np.append(self.known[q], known)
        if len(score) > self.k:
            order = np.lexsort((doc, ~known, -score))[: self.k]
            score, doc, known = score[order], doc[order], known[order]
        if len(score) == self.k:
            self.least[q] = max(self.least[q], score.min())
        self.score[q], self.doc[q], self.known[q] = score, doc, known


def _visited(batches: Iterator[pa.RecordBatch], block: Queries, k: int) -> Iterator[pa.RecordBatch]:
    """(query number, doc_id, score): the best ``k`` of a task's shards for each query, visited by falling bounds."""
    best = Best(block, k)
    for part in slices(batches, TOGETHER):
        shards = list(_shards(part))
        bounded = [block.bounds(s) for s in shards]
        bounds = np.stack([b for b, _ in bounded])
        impacts = {}
        for q in range(len(block.ids)):
            for i in np.argsort(-bounds[:, q], kind="stable").tolist():
                if bounds[i, q] == 0 or bounds[i, q] < best.least[q]:
                    break
                shard, place = shards[i], bounded[i][1]
                if i not in impacts:  # once for each tf of a term, then dealt to its postings
                    impacts[i] = np.repeat(impact(shard["tfs"], shard["m"]), np.diff(shard["starts"])), shard["starts"][shard["group_of"]]
                    shard["known"] = shard["doc_ids"].is_valid().to_numpy(zero_copy_only=False)
                    shard["doc_ids"] = shard["doc_ids"].fill_null(0).to_numpy()
                (each, of), docs = impacts[i], shard["docs"]
                score = np.zeros(len(shard["known"]), np.int64)
                own = slice(block.first[q], block.first[q + 1])
                for t, w in zip(place[block.term[own]].tolist(), block.weight[own].tolist(), strict=True):
                    if t >= 0:
                        score[docs[of[t] : of[t + 1]]] += w * each[of[t] : of[t + 1]]
                some = np.flatnonzero(score >= max(1, best.least[q]))
                if len(some):
                    best.add(q, score[some], shard["doc_ids"][some], shard["known"][some])
    sizes = [len(x) for x in best.score]
    known = np.concatenate([np.zeros(0, bool), *best.known])
    columns = [np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.zeros(0, np.int64), *best.doc]), np.concatenate([np.zeros(0, np.int64), *best.score])]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=~known if i == 1 else None) for i, c in enumerate(columns)], ["q", "doc_id", "score"])


RESULTS = "q long, doc_id long, score long"


def _blocks(queries: DataFrame, of: Index, item_col: str, text_col: str) -> Iterator[Queries]:
    """The queries with their weighted terms, in blocks of bounded size one after another."""
    items = queries.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = items.mapInArrow(_items, f"item {queries.schema[item_col].dataType.simpleString()}, term string").distinct()
    weight = F.floor(1000 * F.log((2 * F.lit(of.n) + 2) / (2 * F.col("df") + 1)))
    weighed = written(found.join(of.frequencies, "term").select("item", "term", weight.cast("long").alias("w")).where("w > 0"))
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        rows = [tuple(r) for r in weighed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toLocalIterator()]
        if rows:
            yield Queries(rows)
    discard(weighed)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        terms = [sorted({w.decode() for w in words_of(t)}) for t in batch.column("text").to_pylist()]
        lists = pa.array(terms, pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("item").take(pc.list_parent_indices(lists)), lists.flatten()], ["item", "term"])


def ranked(of: Index, queries: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each item, all if fewer.

    Equal scores go by ascending doc_id, null ids last; rows that share an id are documents of their own. Items that
    share an id are one item with the terms of all; a null item, and one without terms that a document holds, has no
    result. Items go in blocks of BLOCK_BYTES, so neither the driver nor a task holds more of them.
    """
    spark = of.shards.sparkSession
    kind = queries.schema[item_col].dataType
    out = spark.createDataFrame([], f"`{item_col}` {kind.simpleString()}, rank int, doc_id long, score long")
    w = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for block in _blocks(queries, of, item_col, text_col):
        sent = spark.sparkContext.broadcast(block)
        summary = of.shards.select("m", "shard", "terms", "largest")
        first = summary.mapInArrow(lambda it, s=sent: _promising(it, s.value, FIRST), "q long, m long, shard long, bound long")
        order = W.partitionBy("q").orderBy(F.desc("bound"), "m", "shard")
        chosen = written(first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST).select("m", "shard").distinct())
        # A few shards for each of the block's queries, so their number is bounded as the block is.
        some = of.shards.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen, ["m", "shard"], "left_semi")
        reached = some.mapInArrow(lambda it, s=sent: _visited(it, s.value, k), RESULTS).withColumn("place", F.row_number().over(w))
        for r in reached.where(F.col("place") == k).select("q", "score").toLocalIterator():
            block.least[r["q"]] = r["score"]
        discard(chosen)
        sent = spark.sparkContext.broadcast(block)
        found = of.shards.mapInArrow(lambda it, s=sent: _visited(it, s.value, k), RESULTS).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"q long, `{item_col}` {kind.simpleString()}")
        out = out.unionByName(written(found.join(F.broadcast(names), "q").select(item_col, "rank", "doc_id", "score")))
    return out


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``ranked`` over an index of ``docs`` made for these queries and discarded after them. Null and empty texts have no
    terms; other columns are ignored; without documents or items with terms there is no row."""
    of = index(docs, id_col, text_col, vocabulary(queries))
    out = ranked(of, queries, k, item_col)
    of.discard()
    return out
