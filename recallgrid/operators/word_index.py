"""The best notes with all stems of each query, by postings in blocks.

A block holds the stems of some notes: for each stem the notes that have it and how often. Queries are packed in blocks
too, Spark pairs the blocks, and a task intersects the postings of a query's stems, the shortest list first. It keeps the
best notes of each query over all its pairs, so a stem that every note has makes no rows but those of results.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.vectors import _WHITE, _Remembered, token
from recallgrid.session import few_blocks, spread
from recallgrid.tables import discard, written

#: English words that a lexical query ignores.
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
_STOP = frozenset(STOP)
#: Notes and postings of a block, queries of one, blocks of a file.
NOTES, POSTINGS, QUERIES, FILE = 8192, 1 << 20, 4096, 4
BLOCK = "ids binary, norms binary, terms binary, starts binary, docs binary, counts binary"
KINDS = (np.int64, np.float64, np.int64, np.int32, np.int16, np.int32)
QUERY_BLOCK = "query_ids binary, ends binary, query_terms binary"
BAGS = "id long, terms array<long>, counts array<int>"
FOUND = "query_id long, id long, score double"
_ENDINGS = [(re.compile(end), put) for end, put in (("ies$", "y"), ("(?<=..)sses$", "ss"), ("(?<=...)(?:ing|edly|ed|ly)$", ""), ("(?<=..[^su])s$", ""))]
#: Letters that end what these cut.
_LAST = frozenset("sgdy")


def stemmed(word: str) -> str:
    """What ``search.stem`` makes of a token."""
    if word[-1:] in _LAST:
        for end, put in _ENDINGS:
            word = end.sub(put, word)
    return word


def term(word: str) -> int | None:
    """A 64-bit hash of the stem of a word's token; none for a word without one, and for those of STOP."""
    name = token(word)
    if not name or name in _STOP:
        return None
    return int.from_bytes(hashlib.blake2b(stemmed(name).encode(), digest_size=8).digest(), "little", signed=True)


def _bag(text: str | None, known: dict[str, int | None]) -> dict[int, int]:
    bag: dict[int, int] = {}
    for word, n in Counter(_WHITE.split(text or "")).items():
        own = known[word]
        if own is not None:
            bag[own] = bag.get(own, 0) + n
    return bag


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, terms, counts) of (id, text)."""
    known = _Remembered(term)
    for batch in batches:
        terms, counts, ends = [], [], [0]
        for text in batch.column(1).to_pylist():
            bag = _bag(text, known)
            terms.append(np.fromiter(bag, np.int64, len(bag)))
            counts.append(np.fromiter(bag.values(), np.int32, len(bag)))
            ends.append(ends[-1] + len(bag))
        at = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x)) if x else pa.array([], kind)) for x, kind in ((terms, pa.int64()), (counts, pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["id", "terms", "counts"])


def _block(rows: pa.Table) -> pa.RecordBatch:
    """The postings of some notes by ascending term; those of one ascend by note."""
    terms, counts = (rows.column(c).combine_chunks() for c in ("terms", "counts"))
    sizes = terms.value_lengths().to_numpy().astype(np.int64)
    terms, counts = terms.flatten().to_numpy(), counts.flatten().to_numpy()
    docs = np.repeat(np.arange(len(sizes), dtype=np.int16), sizes)
    upto = np.append(0, np.cumsum(counts, dtype=np.int64))
    ends = np.cumsum(sizes)
    norms = 1 + np.log(1 + (upto[ends] - upto[ends - sizes]).astype(np.float64))
    order = np.argsort(terms, kind="stable")
    terms = terms[order]
    starts = np.append(np.flatnonzero(np.append(len(terms) > 0, terms[1:] != terms[:-1])), len(terms)).astype(np.int32)
    columns = (rows.column("id").to_numpy(), norms, terms[starts[:-1]], starts, docs[order], counts[order])
    return pa.RecordBatch.from_pydict({name.split()[0]: pa.array([c.astype(kind, copy=False).tobytes()], pa.binary()) for name, kind, c in zip(BLOCK.split(", "), KINDS, columns, strict=True)})


def _blocks(batches: Iterator[pa.RecordBatch], most: int, postings: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ``most`` notes, or of as many batches' pieces as have ``postings``."""
    held, rows, size = [], 0, 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, min(most - rows, 256))
            held.append(part)
            at, rows = at + part.num_rows, rows + part.num_rows
            size += int(part.column(1).value_lengths().to_numpy().sum())
            if rows == most or size >= postings:
                yield _block(pa.Table.from_batches(held))
                held, rows, size = [], 0, 0
    if held:
        yield _block(pa.Table.from_batches(held))


def note_blocks(notes: DataFrame, most: int = NOTES, postings: int = POSTINGS) -> DataFrame:
    """The blocks of (note_id, text), written. Texts that share an id are one note; those without an id take no part."""
    docs = notes.where("note_id is not null").select(F.col("note_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    shared = written(docs.groupBy("id").count().where("count > 1").select("id"))
    some = not shared.isEmpty()
    alone = docs.join(shared, "id", "left_anti") if some else docs
    blocks = spread(alone).mapInArrow(lambda it: _blocks(_bags(it), most, postings), BLOCK)
    if some:
        each = docs.join(shared, "id", "left_semi").mapInArrow(_bags, BAGS).select("id", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
        each = each.groupBy("id", F.col("t.terms").alias("term")).agg(F.sum("t.counts").cast("int").alias("n"))
        bags = each.groupBy("id").agg(F.collect_list(F.struct("term", "n")).alias("t")).select("id", F.col("t.term").alias("terms"), F.col("t.n").alias("counts"))
        blocks = blocks.unionByName(bags.mapInArrow(lambda it: _blocks(it, most, postings), BLOCK))
    out = written(blocks, maxRecordsPerFile=FILE)
    discard(shared)
    return out


def _query_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to ``most`` queries of (query_id, query) that have a term."""
    known = _Remembered(term)
    ids, terms = [], []

    def block() -> pa.RecordBatch:
        ends = np.append(0, np.cumsum([len(t) for t in terms])).astype(np.int64)
        columns = (np.array(ids, np.int64), ends, np.array([x for t in terms for x in t], np.int64))
        return pa.RecordBatch.from_pydict({name.split()[0]: pa.array([c.tobytes()], pa.binary()) for name, c in zip(QUERY_BLOCK.split(", "), columns, strict=True)})

    for batch in batches:
        for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own := list(_bag(text, known)):
                ids.append(key)
                terms.append(own)
            if len(ids) == most:
                yield block()
                ids, terms = [], []
    if ids:
        yield block()


def _found(block: dict[str, np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(notes, counts together) of those notes of a block that have all terms at these places."""
    starts, docs, counts = block["starts"], block["docs"], block["counts"]
    first, *rest = place[np.argsort(starts[place + 1] - starts[place])].tolist()
    s, e = starts[first], starts[first + 1]
    some, n = docs[s:e], counts[s:e].astype(np.int64)
    for k in rest:
        s, e = starts[k], starts[k + 1]
        at = np.minimum(np.searchsorted(docs[s:e], some), e - s - 1) + s
        hit = docs[at] == some
        some, n = some[hit], n[hit] + counts[at[hit]]
        if not len(some):
            break
    return some, n


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` notes of each query over the pairs that a task has for its block, one block of queries after another."""
    held, ids, ends, terms = None, np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def rows() -> pa.RecordBatch:
        at = list(best)
        columns = [np.repeat(ids[at], [len(best[q][0]) for q in at]), *(np.concatenate([best[q][c] for q in at]) for c in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in FOUND.split(", ")])

    for batch in batches:
        for r in range(batch.num_rows):
            row = {name: batch.column(name)[r].as_buffer() for name in batch.schema.names}
            own = row["query_ids"].to_pybytes()
            if own != held:
                if best:
                    yield rows()
                held, best = own, {}
                ids, ends, terms = (np.frombuffer(row[name.split()[0]].to_pybytes(), np.int64) for name in QUERY_BLOCK.split(", "))
            block = {name.split()[0]: np.frombuffer(row[name.split()[0]], kind) for name, kind in zip(BLOCK.split(", "), KINDS, strict=True)}
            if not len(block["terms"]):
                continue
            place = np.minimum(np.searchsorted(block["terms"], terms), len(block["terms"]) - 1)
            whole = np.flatnonzero(np.logical_and.reduceat(block["terms"][place] == terms, ends[:-1]))
            for q in whole.tolist():
                some, n = _found(block, place[ends[q] : ends[q + 1]])
                score = n / block["norms"][some]
                old = best.get(q)
                if old is not None and len(old[0]) == k:
                    over = score >= old[1][-1]
                    some, score = some[over], score[over]
                if not len(some):
                    continue
                if len(score) > 4 * k:  # all that tie with the k-th stay until they are ordered
                    over = score >= np.partition(score, -k)[-k]
                    some, score = some[over], score[over]
                found = block["ids"][some]
                if old is not None:
                    found, score = np.append(old[0], found), np.append(old[1], score)
                order = np.lexsort((found, -score))[:k]
                best[q] = found[order], score[order]
        del batch
    if best:
        yield rows()


def best_notes(notes: DataFrame, queries: DataFrame, limit: int, packed: Callable[[DataFrame], DataFrame] = note_blocks) -> DataFrame:
    """(query_id, note_id, rank): for each of (query_id, query) the ``limit`` notes of (note_id, text) that have all stems of
    the query and the largest ranks, equal ones by id: the count of those stems by 1 + ln(1 + count of all stems)."""
    few_blocks(notes.sparkSession)
    asked = queries.where("query_id is not null").groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.array_join(F.collect_list("query"), " ").alias("query"))
    asked = written(asked.mapInArrow(lambda it: _query_blocks(it, QUERIES), QUERY_BLOCK))
    found = asked.crossJoin(packed(notes)).mapInArrow(lambda it: _best(it, limit), FOUND)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return best.select("query_id", F.col("id").alias("note_id"), F.col("score").alias("rank"))
