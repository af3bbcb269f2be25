"""The trie of conversation prefixes, as intervals of sorted conversations.

A conversation becomes a path, 16 bytes of digest for each turn. Spark range-sorts all paths, so the conversations that
share a prefix stand together. Inside a partition the longest common prefixes of neighbours (LCPs) get a sparse table of
range minima, and each candidate prefix, the end of a conversation or an LCP, searches its left and its right extent by
itself: the furthest rows to which the minimum stays at the prefix's depth. What a node counts are then differences of
running sums over its interval.

A prefix that goes on over the edge of a partition has an interval in each of them. All that it counts is a sum or a
minimum, so these few rows, a partition's depth at most at each edge, are merged by key. A group of conversations that
share a prefix, or are all the same, is never in one task unless it is small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.llm.common import BROADCAST_ROWS
from recallgrid.tables import discard, written

#: Bytes of a turn's digest, of paths and lengths in a partition, ids of a piece of a digested list.
TURN, PART_BYTES, PIECE = 16, 1 << 24, 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
COUNTED = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PARTIAL = f"key binary, parent_key binary, {COUNTED}, part int, piece long, ends string"


def paths(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, path, sizes): for each conversation its turns' digests one after another and their texts' code points.

    Turns go by ``turn``, null first, equal ones by their digest. A null role or text is an empty one. Rows without an id
    take no part; other columns are ignored. What is gathered of a conversation is 40 bytes a turn, never a text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    turns = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.char_length(text).cast("long").alias("size")).alias("t"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.unhex(F.array_join("t.digest", "")).alias("path"), F.col("t.size").alias("sizes"))


def branched(own: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Paths whose first h turns are those of the conversation c - c % every, h = crc32(decimal c) % most: all of them if
    it has fewer, none if there is no such conversation. Then come the path's own turns after its first h."""
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.expr(f"substring(path, 1, {TURN * (most - 1)})").alias("head"), F.slice("sizes", 1, most - 1).alias("head_sizes"))
    rows = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most}).join(heads, "base", "left")
    path = F.expr(f"concat(coalesce(substring(head, 1, int({TURN} * h)), X''), substring(path, int({TURN} * h + 1)))")
    sizes = F.expr("concat(coalesce(slice(head_sizes, 1, int(h)), array()), slice(sizes, int(h + 1), int(greatest(size(sizes) - h, 0))))")
    return rows.select("conv_id", path.alias("path"), sizes.alias("sizes"))


def shared(a: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """LCP of each row and the one before it, in turns; -1 for the first row and after the last."""
    n = len(lengths)
    out = np.full(n + 1, -1, np.int64)
    least = np.minimum(lengths[1:], lengths[:-1])
    at = np.cumsum(least) - least
    k = np.arange(least.sum()) - np.repeat(at, least)
    differ = (a[np.repeat(starts[:-1], least) + k] != a[np.repeat(starts[1:], least) + k]).any(axis=1)
    out[1:n] = least
    where = np.flatnonzero(differ)
    row = np.searchsorted(at + least, where, "right")
    np.minimum.at(out, row + 1, k[where])
    return out


class Minima:
    """A sparse table of range minima: level k has the minimum of each 2^k neighbouring values."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while (step := 1 << len(self.levels) - 1) * 2 <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The minimum from ``first`` to ``last``, each included: of two ranges that overlap."""
        level = np.int64(np.log2(last - first + 1))
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.levels[k][first[own]], self.levels[k][last[own] - (1 << int(k)) + 1])
        return out

    def right(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last row up to which all LCPs after ``row`` are ``depth`` at least, by halving steps."""
        at = row + 1
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            on = (at < len(level)) & (level[np.minimum(at, len(level) - 1)] >= depth)
            at = at + (on.astype(np.int64) << k)
        return at - 1

    def left(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first row from which all LCPs up to ``row`` are ``depth`` at least."""
        at = row.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            first = at - (1 << k) + 1
            on = (first >= 0) & (self.levels[k][np.maximum(first, 0)] >= depth)
            at = at - (on.astype(np.int64) << k)
        return at


def _nodes(rows: pa.Table) -> pa.Table:
    """The nodes of a partition's conversations, and pieces of the id lists of nodes that go on over its edges."""
    rows = rows.sort_by([("path", "ascending"), ("conv_id", "ascending")]).combine_chunks()
    n, part, before, after = len(rows), *(rows.column(c)[0].as_py() for c in ("part", "before", "after"))
    path, sizes = rows.column("path").combine_chunks().cast(pa.large_binary()), rows.column("sizes").combine_chunks()
    data = b"".join(path.to_pylist())
    lengths = sizes.value_lengths().to_numpy().astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    lcp = shared(np.frombuffer(data, np.uint64).reshape(-1, 2), starts, lengths)
    minima, conv = Minima(lcp), rows.column("conv_id").combine_chunks().to_numpy()
    inner = np.arange(1, n)
    row, depth = np.append(np.arange(n), inner), np.append(lengths, lcp[1:n])
    left, right = minima.left(row, depth), minima.right(row, depth)
    wide = int(lengths.max()) + 1
    _, one = np.unique(left * wide + depth, return_index=True)
    left, right, depth = left[one], right[one], depth[one]
    top = np.maximum(lcp[left], lcp[right + 1])  # the depths down to here belong to wider intervals
    many = depth - top
    left, right, top = (np.repeat(x, many) for x in (left, right, top))
    depth = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + top + 1

    chars = np.append(0, np.cumsum(sizes.flatten().to_numpy()))  # code points before each turn of all rows
    upto = lambda i, k: chars[starts[i] + np.maximum(k, 0)] - chars[starts[i]]  # noqa: E731  of the first k turns of row i
    total = chars[starts + lengths] - chars[starts]
    from_left, to_right = lcp[:n].copy(), lcp[1:].copy()  # with what stands in the other partitions
    from_left[0], to_right[-1] = before, after
    summed = lambda x: np.append(0, np.cumsum(x))
    leaves, totals, new = summed(to_right < lengths), summed(total), summed(total - upto(np.arange(n), from_left))
    between = lambda s: s[right + 1] - s[left]
    convs = right - left + 1
    # A subtree's code points once for each member and once for each node; the first row's nodes above it don't count.
    told = between(totals) - convs * upto(left, depth - 1)
    once = new[right + 1] - new[left + 1] + total[left] - upto(left, np.maximum(depth - 1, from_left[left]))

    place = left * wide + depth
    order = np.argsort(place)
    up = np.flatnonzero(depth > 0)
    above = np.full(len(depth), -1)
    above[up] = order[np.searchsorted(place[order], minima.left(left[up], depth[up] - 1) * wide + depth[up] - 1)]
    begun = up[depth[up] > from_left[left[up]]]  # else the node was counted where it began
    children = np.bincount(above[begun], minlength=len(depth))
    smallest = Minima(conv).of(left, right)

    crossing = (left == 0) & (depth <= before) | (right == n - 1) & (depth <= after)
    keys, parents = [None] * len(depth), [None] * len(depth)
    by_edge = {e: _keys(data[TURN * starts[e] : TURN * (starts[e] + k)]) for e, k in ((0, before), (n - 1, after)) if k >= 0}
    key = lambda i: by_edge[0 if left[i] == 0 and depth[i] <= before else n - 1][depth[i]]
    for i in np.flatnonzero(crossing).tolist():
        keys[i] = key(i)
    for i in up[crossing[above[up]]].tolist():
        parents[i] = keys[above[i]]

    same = (lcp[1:n] == lengths[1:]) & (lengths[1:] == lengths[:-1])
    first = np.flatnonzero(np.append(True, ~same))  # of each run of equal conversations
    run_of = np.full(n, -1)
    run_of[first] = np.arange(len(first))
    stop = np.append(first[1:], n)
    run = np.where(lengths[left] == depth, run_of[left], -1)
    ends: list[str | None] = [EMPTY] * len(depth)
    pieces: list[tuple[bytes, int, str]] = []
    names = conv.astype(str).astype(object)
    for i in np.flatnonzero(run >= 0).tolist():
        own = names[first[run[i]] : stop[run[i]]]
        if crossing[i]:
            pieces += [(keys[i], at, ",".join(own[at : at + PIECE])) for at in range(0, len(own), PIECE)]
        else:
            ends[i] = hashlib.sha256(",".join(own).encode()).hexdigest()
    known = (depth > 0) & ~crossing[above]
    columns = [pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), depth, smallest, pa.array(smallest[above], pa.int64(), mask=~known), convs, children, between(leaves), told - once, pa.array(ends, pa.string())]
    columns += [pa.array([part] * len(depth), pa.int32()), pa.nulls(len(depth), pa.int64()), pa.nulls(len(depth), pa.string())]
    head = [x.split()[0] for x in PARTIAL.split(", ")]
    out = pa.table([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], head)
    more = pa.table([pa.array([p[0] for p in pieces], pa.binary()), *(pa.nulls(len(pieces), f.type) for f in list(out.schema)[1:10]), pa.array([part] * len(pieces), pa.int32()), pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.string())], head)
    return pa.concat_tables([out, more])


def _keys(path: bytes) -> list[bytes]:
    """A key for each prefix of a path, from the empty one on."""
    digest = hashlib.blake2b(digest_size=TURN)
    out = [digest.digest()]
    for at in range(0, len(path), TURN):
        digest.update(path[at : at + TURN])
        out.append(digest.copy().digest())
    return out


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, before, after): how many turns a partition's first path shares with the last one before it, its last with
    the first one after it; -1 where there is none."""

    def turns(a: bytes | None, b: bytes | None) -> int:
        if a is None or b is None:
            return -1
        most = min(len(a), len(b)) // TURN * TURN
        x, y = np.frombuffer(a[:most], np.uint8), np.frombuffer(b[:most], np.uint8)
        where = np.flatnonzero(x != y)
        return int(where[0] if len(where) else most) // TURN

    for batch in batches:
        part, first, last, was, next_ = (c.to_pylist() for c in batch.columns)
        columns = [pa.array(part, pa.int32()), pa.array(map(turns, was, first), pa.int64()), pa.array(map(turns, last, next_), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "before", "after"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, digest) of pieces that are sorted by key and order; holds one piece and one digest."""
    key, digest = None, None
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k == key:
                digest.update(b"," + text.encode())
                continue
            if key is not None:
                done.append((key, digest.hexdigest()))
            key, digest = k, hashlib.sha256(text.encode())
    if key is not None:
        done.append((key, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.binary(), pa.string()))], ["key", "digest"])


def prefix_nodes(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, path, sizes): (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256).

    conv_id is the smallest member, parent_conv_id the parent's (null for the root), n_leaves counts childless nodes of
    the subtree, saved_tokens sums over it (members - 1) times the code points of the node's last text, and ends_sha256
    digests the members that end there, in ascending order and joined by commas. A conversation without turns ends at
    the root. Conversation ids must be distinct, as ``paths`` gives them; an empty table gives no node.

    A digest of a list runs over it in order, so the ids that end in one node pass one task as pieces of text, one at a
    time; all else that a node of many conversations needs is merged from sums.
    """
    spark = rows.sparkSession
    own = written(rows)
    size = own.agg(F.sum(F.octet_length("path") + 8 * F.size("sizes") + 40)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    ordered = written(own.repartitionByRange(parts, "path", "conv_id").withColumn("part", F.spark_partition_id()))
    discard(own)
    w = W.orderBy("part")  # a row for each partition
    edges = ordered.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    edges = written(edges.select("part", "first", "last", F.lag("last").over(w).alias("was"), F.lead("first").over(w).alias("next")).mapInArrow(_common, "part int, before long, after long"))
    partial = written(ordered.join(F.broadcast(edges), "part").groupBy("part").applyInArrow(_nodes, PARTIAL))
    for table in (ordered, edges):
        discard(table)
    pieces = partial.where("piece is not null").select("key", "part", "piece", "ends").repartition("key").sortWithinPartitions("key", "part", "piece")
    digests = pieces.mapInArrow(_streamed, "key binary, digest string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = partial.where("key is not null and piece is null").groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums)
    merged = written(merged.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(EMPTY))))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    parents = F.broadcast(parents) if merged.count() <= BROADCAST_ROWS else parents
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inside = partial.where("key is null").join(parents, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent"))
    over = merged.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("parent"))
    return inside.select(*names).unionByName(over.select(*names))


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations, each with the first turns of the conversation that it branched from."""
    return prefix_nodes(branched(paths(conversations)))
