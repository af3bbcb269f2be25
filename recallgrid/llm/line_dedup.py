"""Near-duplicate lines by a segment-partition edit join, and documents without their repeated lines.

Two lines are linked when their edit distance is at most ``tau``. A line is cut into tau + 1 segments; by the pigeonhole
principle a partner has one of them as a substring, at a place that the lengths bound. Each distinct line is indexed by
its segments and probes the substrings that a shorter or equally long partner's segments could match; both sides are
plain rows that Spark joins by hash. Entries carry a bag of the line's characters, counted in sixteen buckets; bags
of lines within ``tau`` edits differ by 2 tau at most, which drops most candidates exactly. The rest is verified by
banded bit-parallel edit distance. Equal lines are folded before, so copies never meet in the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import chosen, fresh, slices
from recallgrid.operators.components import components
from recallgrid.tables import discard, written

#: Edits allowed, and code points that a line needs for other than exact matches: below, two edits change too much of it.
TAU, LEAST = 2, 20
#: Entries of a key beyond which Spark joins them.
HOT = 2048


def within(a: str, b: str, tau: int) -> bool:
    """Whether the edit distance is at most ``tau``, by bit vectors over the band of 2 tau + 1 diagonals.

    Equal heads and tails are cut off first, which leaves the distance unchanged. The recurrence is Hyyro's banded
    form of Myers' algorithm: the same few word operations for each column, whatever the length of the lines.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > tau:
        return False
    head = len(commonprefix((a, b)))
    tail = min(len(commonprefix((a[::-1], b[::-1]))), len(a) - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) <= tau:  # the band would be wider than the table
        row = list(range(len(a) + 1))
        for j, y in enumerate(b, 1):
            new = [j]
            for i, x in enumerate(a, 1):
                new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (x != y)))
            row = new
        return row[-1] <= tau
    # Bit k of column j stands for row j - tau + k; rows are characters of a, columns those of b.
    width, rows = 2 * tau + 1, len(a)
    full, top = (1 << width) - 1, 1 << (width - 1)
    plus, minus, score = full ^ ((1 << tau) - 1), 0, tau
    last = top >> 1
    for j, ch in enumerate(b):
        low, match = j - tau, 0
        for i in range(max(low, 0), min(j + tau + 1, rows)):
            if a[i] == ch:
                match |= 1 << (i - low)
        zero = ((((match & plus) + plus) ^ plus) | match | minus) & full
        gain = (minus | ~(zero | plus)) & full
        loss = zero & plus
        if j < rows - tau:  # along the lowest diagonal, then along the last row
            score += not zero & top
            if score > 3 * tau:  # diagonals never fall, and the last cell's is at most 2 tau away
                return False
        else:
            score += bool(gain & last) - bool(loss & last)
            last >>= 1
        zero >>= 1
        plus, minus = (loss | ~(zero | gain)) & full, gain & zero
    return score <= tau


def segments(length: int, tau: int) -> list[tuple[int, int]]:
    """(start, length) of tau + 1 segments of nearly equal length; the longer ones stand last."""
    parts = tau + 1
    short, extra = divmod(length, parts)
    out, at = [], 0
    for k in range(parts):
        size = short + (k >= parts - extra)
        out.append((at, size))
        at += size
    return out


def places(length: int, own: int, k: int, tau: int) -> range:
    """Starts in a line of ``length`` at which segment ``k`` of a partner of length ``own`` <= length can match.

    The multi-match-aware bound: k edits at most stand left of the segment, tau - k at most right of it.
    """
    start, size = segments(own, tau)[k]
    more = length - own
    low = max(0, start - k, start + more - (tau - k))
    high = min(length - size, start + k, start + more + (tau - k))
    return range(low, high + 1)


def canonical(line: bytes) -> bytes:
    """What makes two lines the same: ASCII white space folded and trimmed; case and all else counts."""
    return b" ".join(line.split())


def near_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, least: int = LEAST) -> DataFrame:
    """(line_id, n_copies, n_links, head_doc, head_line) for each distinct line that is not blank.

    n_copies is how often it stands in the table, n_links the number of other distinct lines within ``tau`` edits; the
    head is the first place, by (doc_id, line number), of any line reachable by links. Lines are compared with white
    space folded; those of under ``least`` code points only match exactly. Null and empty texts have no line. Repeated
    rows count as copies. Rows with a null id count too, and come first as heads.
    """
    places = lines_of(docs, id_col, text_col)
    distinct = written(places.groupBy("line_id").agg(F.count("*").alias("n_copies"), F.min(F.struct("doc_id", "line_no")).alias("first")))
    links = _links(docs, text_col, tau, least)
    label = components(links, "a", "b").select(F.col("id").alias("line_id"), "component")
    degree = links.select(F.explode(F.array("a", "b")).alias("line_id")).groupBy("line_id").agg(F.count("*").alias("n_links"))
    linked = written(distinct.select("line_id", "first").join(label, "line_id").join(degree, "line_id"))
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    linked = linked.join(heads, "component").select("line_id", "n_links", "head")
    head = F.coalesce("head", "first")
    return distinct.join(linked, "line_id", "left").select(
        "line_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), head["doc_id"].alias("head_doc"), head["line_no"].alias("head_line")
    )


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, line_no, line_id, size) for each line of each text that is not blank, numbered from 0; size in code points.
    With ``hashed`` also text_id, a hash of the whole text."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[F.xxhash64(text).alias("text_id")] * hashed)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of, number, ids, sizes = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for k, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n") if text else ()):
                    if body := canonical(line):
                        of.append(i)
                        number.append(k)
                        ids.append(line_id(body))
                        sizes.append(len(body) if body.isascii() else len(body.decode("utf-8", "surrogatepass")))
            at = pa.array(of, pa.int64())
            arrays = [batch.column("doc_id").take(at), pa.array(number, pa.int32()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32())]
            arrays += [batch.column("text_id").take(at)] if hashed else []
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "line_no", "line_id", "size", "text_id"][: len(arrays)])

    return rows.mapInArrow(lines, "doc_id long, line_no int, line_id long, size int" + ", text_id long" * hashed)


def line_id(body: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(body)
    return x - (1 << 64) if x >> 63 else x


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, least: int = LEAST) -> DataFrame:
    """(doc_id, line_no, n_copies, n_links, head_doc, head_line, kept) for each line that is not blank.

    kept marks the head's own place. Defined as ``near_duplicate_lines``.
    """
    classes = near_duplicate_lines(docs, id_col, text_col, tau, least)
    kept = F.col("doc_id").eqNullSafe(F.col("head_doc")) & (F.col("line_no") == F.col("head_line"))
    return lines_of(docs, id_col, text_col).drop("size").join(classes, "line_id").drop("line_id").withColumn("kept", kept)


@lru_cache(8192)
def _cuts(length: int, tau: int, least: int) -> list[tuple[int, int, int, bool]]:
    """(start, end, seed, indexed) of all substrings that a line of ``length`` is indexed by or probes with."""
    own = segments(length, tau)
    out = [(at, at + size, length * 64 + k, True) for k, (at, size) in enumerate(own)]
    for m in range(max(least, length - tau), length + 1):
        for k, (_, size) in enumerate(segments(m, tau)):
            out += [(at, at + size, m * 64 + k, False) for at in places(length, m, k, tau) if m < length or at != own[k][0]]
    return out


def bags(lines: list[bytes]) -> np.ndarray:
    """For each line, given as the low bytes of its characters, their counts in sixteen buckets of four bits each."""
    of = np.repeat(np.arange(0, 16 * len(lines), 16), [len(x) for x in lines])
    counts = np.bincount((np.frombuffer(b"".join(lines), np.uint8) & 15) + of, minlength=16 * len(lines)).reshape(-1, 16)
    return ((counts & 15).astype(np.uint64) << _NIBBLES).sum(axis=1, dtype=np.uint64).view(np.int64)


_NIBBLES = np.arange(0, 64, 4, dtype=np.uint64)


def bags_within(a: np.ndarray, b: np.ndarray, tau: int) -> np.ndarray:
    """Whether bags can be of lines within ``tau`` edits: an edit moves one count down and one up at most."""
    x, y = ((v.view(np.uint64)[..., None] >> _NIBBLES & np.uint64(15)).astype(np.int8) for v in (a, b))
    d = np.abs(x - y)
    return np.minimum(d, 16 - d).sum(axis=-1, dtype=np.int64) <= 2 * tau


def _keys(batches: Iterator[pa.RecordBatch], tau: int, least: int) -> Iterator[pa.RecordBatch]:
    """(key, line_id, bag) of the distinct lines of each batch; the lowest bit of a key is 0 for the index, whose entries so come first."""
    h = xxhash.xxh3_64_intdigest
    for batch in slices(batches):
        seen: set[int] = set()
        keys, ids, low, sizes = [], [], [], []
        for text in batch.column(0).to_pylist():
            for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
                body = canonical(line)
                if len(body) < least or (own := line_id(body)) in seen:
                    continue
                seen.add(own)
                if body.isascii():
                    cuts, codes = _cuts(len(body), tau, least), body
                    keys += [h(body[i:j], seed) & -2 if indexed else h(body[i:j], seed) | 1 for i, j, seed, indexed in cuts]
                elif len(chars := body.decode("utf-8", "surrogatepass")) >= least:
                    cuts, codes = _cuts(len(chars), tau, least), chars.encode("utf-32-le", "surrogatepass")[::4]
                    parts = ((chars[i:j].encode("utf-8", "surrogatepass"), seed, indexed) for i, j, seed, indexed in cuts)
                    keys += [h(part, seed) & -2 if indexed else h(part, seed) | 1 for part, seed, indexed in parts]
                else:
                    continue
                ids.append(own)
                low.append(codes)
                sizes.append(len(cuts))
        arrays = [np.array(keys, np.uint64).view(np.int64), *(np.repeat(x, sizes) for x in (np.array(ids, np.int64), bags(low)))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "line_id", "bag"])


def _candidates(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """From entries sorted by key and line: (a, b, null, null) for each index entry with each other entry of its key, if
    their bags are near. Keys with more than HOT entries give these back as (line_id, null, key, bag), for Spark to join.
    """
    names = ["a", "b", "key", "bag"]
    held = [np.zeros(0, np.int64)] * 3
    hot: tuple[int, bool] | None = None  # the last key of the batches so far if it has passed HOT, and whether Spark joins it
    for batch in chain(batches, [None]):
        key, ids, sketch = held if batch is None else (np.concatenate([x, c.to_numpy()]) for x, c in zip(held, batch.columns, strict=True))
        if not len(key):
            continue
        # Copies of a line that came from several batches are one entry each time; the first is enough.
        new = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))
        key, ids, sketch = key[new], ids[new], sketch[new]
        group = key >> 1
        starts = np.append(0, np.flatnonzero(group[1:] != group[:-1]) + 1)
        ends = np.append(starts[1:], len(key))
        # Of most keys all entries are of one line, or none is of the index.
        live, big = key[starts] & 1 == 0, ends - starts > HOT
        live &= big | (np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts))
        if hot is not None and group[0] == hot[0]:
            live[0], big[0] = hot[1], True
        hot, held = None, [np.zeros(0, np.int64)] * 3
        if batch is not None:  # the last key may go on
            if big[-1]:
                hot = int(group[-1]), bool(live[-1])
            else:
                held = [x[starts[-1] :] for x in (key, ids, sketch)]
                live[-1] = False
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for i in np.flatnonzero(live).tolist():
            part = slice(starts[i], ends[i])
            if big[i]:
                none = pa.nulls(ends[i] - starts[i], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), none, pa.array(key[part]), pa.array(sketch[part])], names)
                continue
            own, which = np.unique(ids[part], return_index=True)
            every, index = sketch[part][which], np.isin(own, ids[part][key[part] & 1 == 0])
            for a, of in zip(own[index], every[index], strict=True):
                near = own[bags_within(every, of[None], tau) & (own != a)]
                found.append((np.minimum(near, a), np.maximum(near, a)))
                waiting += len(near)
                if waiting > 100_000:
                    yield _pairs(found)
                    found, waiting = [], 0
        yield _pairs(found)


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], ["a", "b", "key", "bag"])


def _hot_pairs(entries: DataFrame, tau: int) -> DataFrame:
    """(a, b) of index entries with other entries of the same hot key whose bags are near.

    Near bags differ in 2 * tau of their sixteen counts at most. So of 2 * tau + 1 groups of counts one is equal, and the
    join is on that group's counts beside the key: a key that millions of lines share is dealt out over their counts.
    With more groups than counts (tau above 7) the join is on the key alone.
    """
    n = 2 * tau + 1
    cuts = [16 * k // n for k in range(n + 1)] if n <= 16 else [0, 0]
    masks = [sum(15 << 4 * i for i in range(x, y)) for x, y in pairwise(cuts)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    part = lambda bag: F.explode(F.array(*[F.struct(F.lit(k).alias("of"), bag.bitwiseAND(F.lit(m)).alias("counts")) for k, m in enumerate(masks)]))
    hot = entries.select("a", "bag", F.col("key").bitwiseAND(F.lit(1)).alias("probe"), F.shiftright("key", 1).alias("group")).distinct()
    index = hot.where("probe = 0").select(F.col("a").alias("x"), "group", F.col("bag").alias("other"), part(F.col("bag")).alias("part"))
    digit = lambda bag, k: F.shiftrightunsigned(bag, k).bitwiseAND(F.lit(15))
    gap = [F.abs(digit("bag", k) - digit("other", k)) for k in range(0, 64, 4)]
    near = sum((F.least(d, 16 - d) for d in gap), F.lit(0)) <= 2 * tau
    equal = [F.when(F.col("bag").bitwiseXOR(F.col("other")).bitwiseAND(F.lit(m)) == 0, k) for k, m in enumerate(masks)]
    first = F.coalesce(*equal) == F.col("part.of")  # a pair that meets in several groups is given in the first
    met = hot.select("a", "bag", "group", part(F.col("bag")).alias("part")).distinct().join(index, ["group", "part"])
    return met.where((F.col("a") != F.col("x")) & first & near).select(F.least("a", "x").alias("a"), F.greatest("a", "x").alias("b"))


def _links(docs: DataFrame, text_col: str, tau: int, least: int) -> DataFrame:
    """(a, b) of distinct lines within ``tau`` edits."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    group = F.shiftright("key", 1)
    entries = texts.mapInArrow(lambda it: _keys(it, tau, least), "key long, line_id long, bag long").repartition(group).sortWithinPartitions("key", "line_id")
    found = written(entries.mapInArrow(lambda it: _candidates(it, tau), "a long, b long, key long, bag long"))
    pairs = written(found.where("key is null").select("a", "b").unionByName(_hot_pairs(found.where("key is not null"), tau)).distinct())
    discard(found)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = {line_id(body): body for text in batch.column(0).to_pylist() for line in text.encode("utf-8", "surrogatepass").split(b"\n") if len(body := canonical(line)) >= least}
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.int64()), pa.array(out.values(), pa.binary())], ["line_id", "body"])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lambda x: x.decode("utf-8", "surrogatepass")
        for x in batches:
            yield x.loc[np.array([within(read(p), read(q), tau) for p, q in zip(x["pa"], x["pb"], strict=True)], bool), ["a", "b"]]

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("line_id")).distinct())
    body = written(chosen(texts.mapInArrow(bodies, "line_id long, body binary"), ids, "line_id").dropDuplicates(["line_id"]))
    one, two = (body.select(F.col("line_id").alias(x), F.col("body").alias(f"p{x}")) for x in "ab")
    links = written(pairs.join(one, "a").join(two, "b").select("a", "b", "pa", "pb").mapInPandas(near, "a long, b long"))
    discard(body)
    discard(pairs)
    return links


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, least: int = LEAST) -> DataFrame:
    """``docs`` with each class of lines kept only at its head.

    Lines of under ``least`` code points and blank lines stay. A document that loses all its lines with text goes; a
    null, empty or blank text stays as it is. All columns are returned, whatever their names; an n_chars column follows
    the new text. Rows that share an id, or have none, are told apart by their texts; rows with equal id and text are
    kept or cut together. Of equal heads the first by (id, line number) is kept. An empty table gives no row.
    """
    own, same, out_lines = fresh(docs, "__id", "__same", "__gone")
    classes = near_duplicate_lines(docs, id_col, text_col, tau, least).where("n_copies > 1 or n_links > 0")
    places = lines_of(docs, id_col, text_col, True).where(F.col("size") >= least)
    head = F.col("doc_id").eqNullSafe(F.col("head_doc")) & (F.col("line_no") == F.col("head_line"))
    gone = places.join(classes, "line_id").where(~head).groupBy(F.col("doc_id").alias(own), F.col("text_id").alias(same)).agg(F.collect_set("line_no").alias(out_lines))
    rows = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(same)), "left")
    lost = F.col(out_lines).isNotNull()
    left = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda _, i: ~F.array_contains(out_lines, i)), "\n")
    rows = rows.withColumn(text_col, F.when(lost, left).otherwise(F.col(text_col)))
    rows = rows.where(~lost | F.col(text_col).rlike(r"[^\t-\r ]"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(lost, F.char_length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
