"""Near-duplicate vectors by sorted projection passes.

In each pass a vector's key is the concatenation of random hyperplane signs; Spark sorts all vectors by pass and key, and
each is compared with those shortly before it in that order. Pairs that pass the cosine test are links; their union over
all passes gives the components. Signs are those of the unit vectors less their mean, as a direction that all share parts
none of them. A pair of cosine 0.9 among spread-out vectors agrees in a sign with probability 0.86, so a pair that shares
a run of leading signs in some pass stands close in it. The run must be longer the more vectors there are and the closer
they crowd, so the number of passes follows from both: from the count, and from measured ranks (see ``passes_for`` and
``_measured``). Keys hold more signs than that run, which part crowded neighbourhoods further. The rows at the edges of
the sorted partitions are compared once more in the order of all partitions.

What travels in a pass is not the vector but one byte for each component and a bound of the error that this makes. Of
most pairs the bound decides; the few that it leaves open are verified once, with their vectors, after all passes.

Within a component links are then counted exactly, in pairs of blocks of bounded size. Equal vectors are folded first
and counted by their number, so copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.llm.common import chosen, runs
from recallgrid.operators.components import components
from recallgrid.tables import discard, written

#: Fewest passes, signs of a key, rows before a row that it is compared with, rows of a block.
PASSES, SIGNS, NEIGHBOURS, BLOCK = 12, 62, 256, 1024
#: Estimated recall of an isolated pair at the threshold that sets the number of passes.
RECALL = 0.99
#: Vectors whose ranks are measured, neighbours planted beside each, passes that they are measured in.
SAMPLE, PLANTED, TRIALS = 64, 16, 6
EDGES = "a long, b long, sure boolean, part int, at long, pass int, rep long, codes binary"
EDGE_NAMES = [x.split()[0] for x in EDGES.split(", ")]
EDGE_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]


def passes_for(n: int, least: float, neighbours: int = NEIGHBOURS, recall: float = RECALL) -> int:
    """Passes after which a pair of cosine ``least`` among ``n`` spread-out vectors was within ``neighbours`` rows in one,
    at a chance of ``recall``: it must share about log2(n / neighbours) leading signs."""
    agree = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    one = agree ** max(0.0, math.log2(max(n, 1) / neighbours))
    return PASSES if one >= 1 else max(PASSES, math.ceil(math.log(1 - recall) / math.log1p(-one)))


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, passes: int | None = None, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    n_links is the number of other rows linked directly, component_id the smallest id reachable. Vectors that are null,
    empty, zero, or hold a null or non-finite component link with nothing; so do vectors of unlike lengths. A row with a
    null id takes no part: no links, component null, kept. Repeated rows are links of each other and share an id.
    Labels and other columns are ignored. Without ``passes`` their number follows from the distinct vectors; it is large
    where many vectors are nearly as close as ``least``.
    """
    kind = vectors.schema[vector_col].dataType.elementType
    code = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(T.ArrayType(T.FloatType() if code == "<f4" else T.DoubleType())).alias("v"))
    valid = F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    raw = written(rows.where(valid).mapInArrow(lambda it: _checked(it, code), "vec_id long, digest binary, raw binary"))
    reps = written(raw.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw")))
    means = _means(reps, code)
    if passes is None:
        n = reps.count()
        passes = max(passes_for(n, least, neighbours), _measured(reps, code, least, neighbours, means) if n > 2 * neighbours else 0)
    # An id can stand for several vectors only if it is repeated; the pair (rep, raw) then still is one class.
    coded = reps.select("rep", "raw").mapInArrow(lambda it: _coded(it, code, passes, means), "pass int, key long, rep long, codes binary")
    order = [F.col("pass"), F.length("codes"), F.col("key"), F.xxhash64("rep", "pass")]
    near = written(coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _neighbours(it, least, neighbours, True), EDGES))
    edges = near.where("part is not null").select("pass", F.lit(0).cast("long").alias("key"), "rep", "codes", "part", "at").repartition("pass").sortWithinPartitions("pass", "part", "at")
    over = edges.mapInArrow(lambda it: _neighbours(it, least, neighbours, False), EDGES)
    pairs = written(near.where("part is null").unionByName(over).groupBy("a", "b").agg(F.bool_or("sure").alias("sure")))
    links = written(pairs.where("sure").select("a", "b").unionByName(_verified(pairs.where("not sure"), reps, code, least)))
    discard(near)
    discard(pairs)
    label = components(links, "a", "b").select(F.col("id").alias("rep"), "component")

    own = written(reps.join(label, "rep").select("rep", "component", "copies", "raw"))
    sizes = own.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    blocks = own.join(sizes, "component").withColumn("block", block).withColumn("pair", F.explode(pairs))
    blocks = blocks.select(F.xxhash64("component", "pair.i", "pair.j").alias("spot"), "rep", "copies", "block", "raw").repartition("spot").sortWithinPartitions("spot")
    counted = blocks.mapInPandas(lambda it: _counted(it, code, least), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))

    classes = reps.select("digest", "rep", "copies").join(label, "rep", "left").join(counted, "rep", "left")
    classes = classes.select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    found = raw.select("vec_id", "digest").join(classes, "digest").select("vec_id", "n_links", "component")
    alone = rows.select("vec_id").join(raw.select("vec_id").distinct(), "vec_id", "left_anti")
    found = found.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component")))
    kept = F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True))
    return found.select(F.col("vec_id").alias(id_col), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


def _checked(batches: Iterator[pa.RecordBatch], code: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, digests, raws = [], [], []
        for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            a = v.values.to_numpy(zero_copy_only=False).astype(code)  # nulls become not a number
            if len(a) and np.isfinite(a).all() and a.any():
                ids.append(vec_id)
                raws.append(a.tobytes())
                digests.append(xxhash.xxh3_128_digest(raws[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "digest", "raw"])


def _unit(raws: list[bytes], code: str) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    v = np.frombuffer(b"".join(raws), code).reshape(len(raws), -1).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _by_size(raws: list[bytes], code: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the vectors of each length."""
    sizes = np.array([len(r) for r in raws])
    for size in np.unique(sizes):
        some = np.flatnonzero(sizes == size)
        yield some, _unit([raws[i] for i in some], code)


def _means(reps: DataFrame, code: str) -> dict[int, np.ndarray]:
    """The mean of the unit vectors of each length; summed by task and then by length, a row of each for the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for some, unit in _by_size(batch.column(0).to_pylist(), code):
                s, n = sums.get(unit.shape[1], (0, 0))
                sums[unit.shape[1]] = s + unit.sum(axis=0), n + len(some)
        yield pa.RecordBatch.from_pydict({"size": pa.array(sums, pa.int32()), "total": pa.array([s.tobytes() for s, _ in sums.values()], pa.binary()), "n": pa.array([n for _, n in sums.values()], pa.int64())})

    def merged(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in rows.column("total").to_pylist())
        return pa.table({"size": rows.column("size").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary()), "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64())})

    kind = "size int, total binary, n long"
    rows = reps.select("raw").mapInArrow(summed, kind).groupBy("size").applyInArrow(merged, kind)
    return {r["size"]: np.frombuffer(bytes(r["total"])) / r["n"] for r in rows.toLocalIterator()}


def _signs(unit: np.ndarray, mean: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Keys of unit vectors, a column for each pass."""
    weights = np.int64(1) << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
    return (((unit - mean) @ planes) > 0).reshape(len(unit), -1, SIGNS).astype(np.int64) @ weights


def _planted(unit: np.ndarray, mean: np.ndarray, least: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """PLANTED neighbours of each vector at the threshold, and which vectors have them.

    A neighbour differs from its vector in the way in which vectors differ from each other: the direction is that between
    two others, and what both have in common with the mean stays. A vector that is nearer to the mean than the threshold
    is near to most others, which connect it, and gets none.
    """
    own = unit - mean
    size = np.einsum("ij,ij->i", own, own)
    some = np.flatnonzero(size > 1 - least) if len(unit) > 2 else np.zeros(0, np.int64)
    out = []
    for i in some:
        one, two = (rng.integers(0, len(unit), PLANTED) for _ in range(2))
        t = unit[one] - unit[two] + 1e-9 * rng.standard_normal((PLANTED, unit.shape[1]))
        t -= np.outer(t @ own[i] / size[i], own[i])
        t /= np.linalg.norm(t, axis=1, keepdims=True)
        near = 1 - (1 - least) / size[i]  # the cosine without the mean
        out.append(mean + near * own[i] + np.sqrt(size[i] * (1 - near * near)) * t)
    return np.concatenate(out) if out else np.zeros((0, unit.shape[1])), some


def _measured(reps: DataFrame, code: str, least: float, neighbours: int, means: dict[int, np.ndarray]) -> int:
    """Passes after which a pair at the threshold was within ``neighbours`` rows in one, at a chance of RECALL, by the ranks
    that planted neighbours of SAMPLE vectors have among all vectors in TRIALS passes.

    All vectors are counted between the sorted keys of the planted ones: a sum for each interval.
    """
    rows = reps.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("raw").collect()
    rng, keys, planes = np.random.default_rng(23), {}, {}
    for _, unit in _by_size([bytes(r["raw"]) for r in rows], code):
        size = unit.shape[1]
        near, some = _planted(unit, means[size], least, rng)
        if len(some):
            planes[size] = rng.standard_normal((size, TRIALS * SIGNS))
            keys[size] = _signs(unit[some], means[size], planes[size]), _signs(near, means[size], planes[size])
    if not keys:
        return 0
    bounds = {size: np.sort(np.concatenate(k), axis=0) for size, k in keys.items()}

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {size: np.zeros((len(b) + 1, TRIALS), np.int64) for size, b in bounds.items()}
        for batch in batches:
            for _, unit in _by_size(batch.column(0).to_pylist(), code):
                if (size := unit.shape[1]) in bounds:
                    own = _signs(unit, means[size], planes[size])
                    for t in range(TRIALS):
                        counts[size][:, t] += np.bincount(np.searchsorted(bounds[size][:, t], own[:, t]), minlength=len(bounds[size]) + 1)
        for size, c in counts.items():
            at, trial = np.nonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size), pa.int32()), pa.array(trial, pa.int32()), pa.array(at, pa.int32()), pa.array(c[at, trial])], ["size", "trial", "at", "n"])

    found = reps.select("raw").mapInArrow(between, "size int, trial int, at int, n long").groupBy("size", "trial", "at").agg(F.sum("n").alias("n"))
    upto = {size: np.zeros((len(b) + 2, TRIALS), np.int64) for size, b in bounds.items()}
    for r in found.toLocalIterator():
        upto[r["size"]][r["at"] + 1, r["trial"]] = r["n"]
    chances = []
    for size, (own, near) in keys.items():
        rank, hits = np.cumsum(upto[size], axis=0), np.zeros((len(own), PLANTED, TRIALS), bool)
        for t in range(TRIALS):
            place = lambda k, t=t: rank[np.searchsorted(bounds[size][:, t], k[:, t]) + 1, t]
            hits[:, :, t] = np.abs(place(near).reshape(len(own), PLANTED) - place(own)[:, None]) <= neighbours
        chances.append(hits.mean(axis=(1, 2)))
    p = np.maximum(np.concatenate(chances), 0.5 / (PLANTED * TRIALS))
    passes = 1
    while np.mean(1 - (1 - p) ** passes) < RECALL:
        passes += 1
    return passes


def _coded(batches: Iterator[pa.RecordBatch], code: str, passes: int, means: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Each vector once a pass, as one byte for each component and four of a bound: how far the unit vector of the bytes
    is from its own, with the rounding of a product in single precision."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        reps = batch.column(0).to_numpy()
        for some, unit in _by_size(batch.column(1).to_pylist(), code):
            size = unit.shape[1]
            if size not in planes:
                planes[size] = np.random.default_rng(17).standard_normal((size, passes * SIGNS))
            keys = _signs(unit, means[size], planes[size])
            steps = np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True)))
            off = np.linalg.norm(unit - steps / np.linalg.norm(steps, axis=1, keepdims=True), axis=1) + 2e-7 * (unit.shape[1] + 4)
            codes = np.hstack([steps.astype(np.int8).view(np.uint8), off.astype("<f4").view(np.uint8).reshape(-1, 4)])
            values = pa.array([x.tobytes() for x in codes], pa.binary())
            for k in range(passes):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(keys[:, k]), pa.array(reps[some]), values], ["pass", "key", "rep", "codes"])


def _neighbours(batches: Iterator[pa.RecordBatch], least: float, neighbours: int, edges: bool) -> Iterator[pa.RecordBatch]:
    """Links of each row with the rows shortly before it in its pass, ``sure`` or left open by the bounds; those that join
    nothing new are left out.

    With ``edges`` also the first and last ``neighbours`` rows of the partition, each once, with their place in it.
    """
    part, seen = TaskContext.get().partitionId(), 0
    tail: pa.Table | None = None
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    def edge(at: int, x: pa.Table) -> Iterator[pa.RecordBatch]:
        n = x.num_rows
        columns = [None] * n, [None] * n, [None] * n, [part] * n, range(at, at + n), *(x[c].to_pylist() for c in ("pass", "rep", "codes"))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, EDGE_TYPES, strict=True)], EDGE_NAMES)

    def pairs(a: np.ndarray, b: np.ndarray, sure: bool) -> Iterator[pa.RecordBatch]:
        low, high = np.minimum(a, b), np.maximum(a, b)
        if sure:
            new = np.zeros(len(low), bool)
            for i, (p, q) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
                if (x := root(p)) != (y := root(q)):
                    parent[max(x, y)], new[i] = min(x, y), True
            low, high = low[new], high[new]
        if len(low):
            columns = [pa.array(low), pa.array(high), pa.array(np.full(len(low), sure))]
            yield pa.RecordBatch.from_arrays(columns + [pa.nulls(len(low), t) for t in EDGE_TYPES[3:]], EDGE_NAMES)

    window = _Window(0, 0)
    for batch in batches:
        if edges and batch.num_rows:
            own = pa.Table.from_batches([batch])
            if seen < neighbours:
                yield from edge(seen, own.slice(0, neighbours - seen))
            tail = pa.concat_tables([x for x in (tail, own) if x is not None])
            tail = tail.slice(max(0, tail.num_rows - neighbours)).combine_chunks()
        seen += batch.num_rows
        turn, rep, codes = batch.column("pass").to_numpy(), batch.column("rep").to_numpy(), batch.column("codes").to_pylist()
        sizes = np.array([len(c) for c in codes])
        cuts = np.flatnonzero((turn[1:] != turn[:-1]) | (sizes[1:] != sizes[:-1])) + 1
        for start, end in zip([0, *cuts], [*cuts, len(codes)], strict=True):
            if start < end:
                if (window.turn, window.size) != (turn[start], sizes[start]):
                    window = _Window(int(turn[start]), int(sizes[start]))
                for a, b, sure in window.add(rep[start:end], codes[start:end], least, neighbours):
                    yield from pairs(a, b, sure)
        if len(parent) > 1_000_000:
            parent.clear()  # only costs repeated links
    if edges and tail is not None and (some := min(neighbours, seen - neighbours)) > 0:
        yield from edge(seen - some, tail.slice(tail.num_rows - some))


class _Window:
    """The last rows of one pass over vectors of one length, with the class that each is known to be in."""

    def __init__(self, turn: int, size: int) -> None:
        self.turn, self.size = turn, size
        self.rep = self.label = np.zeros(0, np.int64)
        self.unit, self.off = np.zeros((0, max(size - 4, 0)), np.float32), np.zeros(0, np.float32)

    def add(self, rep: np.ndarray, codes: list[bytes], least: float, neighbours: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Takes the next rows; gives the pairs among them and with those before that join classes, first the sure ones."""
        both = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        steps = both[:, :-4].view(np.int8).astype(np.float32)
        steps /= np.sqrt(np.einsum("ij,ij->i", steps, steps))[:, None]
        before = len(self.rep)
        self.unit = np.concatenate([self.unit, steps])
        self.off = np.concatenate([self.off, np.ascontiguousarray(both[:, -4:]).view("<f4")[:, 0]])
        self.rep, self.label = np.concatenate([self.rep, rep]), np.concatenate([self.label, rep])
        for s in range(before, len(self.rep), neighbours):
            e, f = min(s + neighbours, len(self.rep)), max(0, s - neighbours)
            cosine = self.unit[s:e] @ self.unit[f:e].T
            slack = self.off[s:e, None] + self.off[None, f:e]
            i, j = np.nonzero(cosine + slack >= least)
            sure = (cosine - slack)[i, j] >= least
            i, j = i + s, j + f
            own = j < i
            i, j, sure = i[own], j[own], sure[own]
            for a, b in self._join(i[sure], j[sure]):
                yield self.rep[a], self.rep[b], True
            left = ~sure & (self.label[i] != self.label[j])
            yield self.rep[i[left]], self.rep[j[left]], False
        for name in ("rep", "label", "unit", "off"):
            setattr(self, name, getattr(self, name)[-neighbours:])

    def _join(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Joins the classes of all pairs of rows, and gives those pairs that did so: each class is hung below a lower one."""
        while True:
            x, y = self.label[i], self.label[j]
            new = x != y
            if not new.any():
                return
            i, j, low, high = i[new], j[new], np.minimum(x, y)[new], np.maximum(x, y)[new]
            hung, at = np.unique(high, return_index=True)
            below = low[at]
            yield i[at], j[at]
            while True:
                k = np.minimum(np.searchsorted(hung, below), len(hung) - 1)
                again = hung[k] == below
                if not again.any():
                    break
                below = np.where(again, below[k], below)
            k = np.minimum(np.searchsorted(hung, self.label), len(hung) - 1)
            self.label = np.where(hung[k] == self.label, below[k], self.label)


def _verified(pairs: DataFrame, reps: DataFrame, code: str, least: float) -> DataFrame:
    """Those pairs of ids whose vectors pass the cosine test in double precision."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).to_pylist() for c in ("va", "vb"))
            sizes = np.array([len(x) if len(x) == len(y) else 0 for x, y in zip(one, two, strict=True)])
            for size in np.unique(sizes[sizes > 0]):
                some = np.flatnonzero(sizes == size)
                cosine = np.einsum("ij,ij->i", _unit([one[i] for i in some], code), _unit([two[i] for i in some], code))
                yield batch.select(["a", "b"]).take(pa.array(some[cosine >= least]))

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    own = written(chosen(reps.select("rep", "raw"), ids, "rep"))
    discard(ids)
    one, two = (own.select(F.col("rep").alias(x), F.col("raw").alias(f"v{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "va", "vb").mapInArrow(exact, "a long, b long").distinct()


def _counted(batches: Iterator[pd.DataFrame], code: str, least: float) -> Iterator[pd.DataFrame]:
    """For each vector of a pair of blocks, the rows of the other block (or of its own) that it links with."""
    for x in runs(batches, ["spot"]):
        rep, copies, block = (x[c].to_numpy() for c in ("rep", "copies", "block"))
        unit = _unit(list(x["raw"]), code)
        linked = unit @ unit.T >= least
        if (block != block[0]).any():
            linked &= block[:, None] != block[None, :]
        np.fill_diagonal(linked, False)
        yield pd.DataFrame({"rep": rep, "n": linked @ copies})
