"""Near-duplicate documents by HyperMinHash registers, banding and verification on full shingle sets.

A document's shingle hashes fall into 2^8 buckets by their first bits. The register of a bucket keeps the smallest
hash of the bucket as a leading-zero count and ten mantissa bits, 16 bits in all. Registers are merged in pairs and
banded by four to give the candidates; the share of equal registers, corrected for expected collisions, and the exact
bound on differing ones prune them; pairs that remain are verified on the whole sets of 64-bit shingle hashes. At
similarity 0.85 a pair shares no band with a probability below 1e-10 for long documents, and less for short ones, where
few buckets are touched.

Equal sets are folded into one class first. Candidates of a band are compared in two passes, so that neither a copy
group nor a frequent line makes all pairs: first each member with the band's smallest member; then, only in bands that
still hold several components, blocks of bounded size whose set sizes are compatible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import chosen, fresh, mix, runs, shingles, slices
from recallgrid.operators.components import components
from recallgrid.tables import discard, written

PREFIX, MANTISSA, ROWS = 8, 10, 4
BUCKETS, BANDS = 1 << PREFIX, (1 << PREFIX) // 2 // ROWS
#: Standard errors of the estimate from all registers that a candidate may fall short of the threshold.
SLACK = 4.0
#: Members of a block, and pairs of registers that are compared at once.
BLOCK, AT_ONCE = 2048, 4096


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased: runs without the ASCII white space 0x20 and 0x09 to 0x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def registers(hashes: np.ndarray) -> np.ndarray:
    """uint16 registers of sorted distinct 64-bit hashes: (leading zeros + 1) << 10 | mantissa, 0 for no hash."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - PREFIX)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rest = hashes[first] << np.uint64(PREFIX)
        zeros = 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
        mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        out[bucket[first]] = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def bands(a: np.ndarray) -> np.ndarray:
    """Rows of registers as (row, band, register) of merged pairs: that of the first of two buckets, or else the second's."""
    first, second = a[:, 0::2].astype(np.uint32), a[:, 1::2].astype(np.uint32)
    return np.where(first > 0, first, np.where(second > 0, second | np.uint32(1 << 16), 0)).reshape(len(a), BANDS, ROWS)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for registers that agree by chance.

    The expected number of chance collisions is the published approximation 0.1699 * 2^(p - r) * phi with
    phi = 4 (n/m) / (1 + n/m)^2, p index bits and r mantissa bits.
    """
    same = ((a == b) & (a > 0)).sum(axis=-1)
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    ratio = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    chance = 0.169919487159739 * 2.0 ** (PREFIX - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    chance = np.minimum(chance, same * 0.5)
    return (same - chance) / np.maximum(used - chance, 1e-9)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``.

    Links documents with 100 * intersection >= percent * union of their sets of ``size``-word shingles; a document with
    fewer words has its whole sequence as the one shingle. component_id is the smallest id reachable. A null, empty or
    blank text has an empty set, which is linked with nothing. A row with a null id takes no part: component null, kept.
    Repeated rows share their id's component; an id with several texts has the links of all of them. Other columns
    are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = written(docs.mapInArrow(lambda it: _features(it, size), "doc_id long, n_shingles long, digest binary, registers binary"))
    reps = written(
        features.where("n_shingles > 0 and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    )
    links = _links(reps, docs, size, percent)
    found = components(links, "a", "b").select(F.col("id").alias("rep"), "component")
    classes = reps.select("digest", "rep").join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    # An id can stand in several classes only if it is repeated with different texts.
    whole = (
        features.join(classes, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    )
    return whole.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _features(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingles(words_of(t), size) for t in batch.column("text").to_pylist()]
        made = ([len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [registers(s).tobytes() for s in sets])
        arrays = [batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.binary(), pa.binary()), strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "digest", "registers"])


def _links(reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) of verified links between classes, enough of them to connect what is linked."""
    keys = reps.mapInArrow(_keys, "rep long, n long, band int, key long")
    groups = keys.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("rep", "n")).alias("least")).where("c > 1")
    members = written(keys.join(groups, "key"))
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  sizes of sets that can be similar enough
    first = members.where((F.col("rep") != F.col("least.rep")) & fits(F.col("n"), F.col("least.n"))).select(F.col("least.rep").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(_verified(_likely(written(first), reps, percent), docs, size, percent))

    label = components(links, "a", "b").select(F.col("id").alias("rep"), "component")
    rest = members.where("c > 2").join(label, "rep", "left").select("key", "band", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = rest.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    # Sets that are similar enough are in the same or in neighbouring steps of the size scale.
    # A cell holds a step's own sets and those of the step below; only cells of several components get their rows.
    step = F.floor(F.log(F.col("n")) / float(-np.log(percent / 100))).cast("int")
    rest = rest.join(mixed, "key").select("key", "band", "rep", "component", step.alias("step"))
    steps = rest.groupBy("key", "step").agg(F.count("*").alias("c"), F.min("component").alias("x"), F.max("component").alias("y"))
    both = F.explode(F.array(F.struct(F.col("step").alias("cell"), F.lit(True).alias("own")), F.struct((F.col("step") + 1).alias("cell"), F.lit(False).alias("own"))))
    cells = steps.select("key", "c", "x", "y", both.alias("at")).groupBy("key", "at.cell").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("blocks"), F.min("x").alias("x"), F.max("y").alias("y"), F.bool_or("at.own").alias("own"))
    back = F.explode(F.array(F.struct(F.col("cell").alias("step"), F.lit(True).alias("own")), F.struct((F.col("cell") - 1).alias("step"), F.lit(False).alias("own"))))
    places = cells.where("x <> y and own").select("key", "cell", "blocks", back.alias("at")).select("key", "cell", "blocks", "at.*")
    rest = rest.join(places, ["key", "step"])
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    rest = rest.withColumn("block", block).withColumn("pair", F.explode(pairs)).join(reps.select("rep", "n", "registers"), "rep")
    spot = F.xxhash64("key", "cell", "pair.i", "pair.j")
    rest = rest.select(spot.alias("spot"), "band", "rep", "component", "n", "own", "block", "registers").repartition("spot").sortWithinPartitions("spot")
    second = rest.mapInPandas(lambda it: _compared(it, percent), "a long, b long").distinct().join(links, ["a", "b"], "left_anti")
    return written(links.unionByName(_verified(second, docs, size, percent)))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of each class that has a register; the key is a hash of the band and its registers."""
    for batch in batches:
        rep, n = (batch.column(c).to_numpy() for c in ("rep", "n"))
        parts = bands(np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS))
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
        for k in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
        row, band = np.nonzero(parts.any(axis=2))
        yield pa.RecordBatch.from_arrays([pa.array(rep[row]), pa.array(n[row]), pa.array(band.astype(np.int32)), pa.array(key[row, band].view(np.int64))], ["rep", "n", "band", "key"])


def _least(percent: int) -> float:
    j = percent / 100
    return j - SLACK * float(np.sqrt(j * (1 - j) / BUCKETS))


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs of a written table that can be similar enough by their registers."""

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                a, b = (np.frombuffer(b"".join(x[c]), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
                yield x.loc[_passes(a, b, x["na"].to_numpy(), x["nb"].to_numpy(), percent), ["a", "b"]]

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    own = written(chosen(reps.select("rep", "n", "registers"), ids, "rep"))
    one = own.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    two = own.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ra", "rb").mapInPandas(kept, "a long, b long").distinct()


def _passes(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs can be similar enough.

    Each element of one set alone changes one register at most, so registers that differ are bounded by the largest
    symmetric difference of similar sets. That is exact, and decides for small sets; for others the estimate does too.
    """
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    differ = (a != b).sum(axis=-1)
    bound = (n + m) * (100 - percent) / (100 + percent)
    return (differ <= bound + 1e-9) & ((used < BUCKETS // 4) | (estimate(a, b, n, m) >= _least(percent)))


def _compared(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Likely pairs of different components within each pair of blocks."""
    for x in runs(batches, ["spot"]):
        rep, comp, n, own, block = (x[c].to_numpy() for c in ("rep", "component", "n", "own", "block"))
        reg = np.frombuffer(b"".join(x["registers"]), np.uint16).reshape(-1, BUCKETS)
        band, parts = x["band"].iat[0], bands(reg)
        split = block[0] != block[-1] or (block != block[0]).any()
        for i, j in _blocks(len(x)):
            some = (comp[i] != comp[j]) & (own[i] | own[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            if split:
                some &= block[i] != block[j]
            i, j = i[some], j[some]
            for at in range(0, len(i), AT_ONCE):
                p, q = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
                ok = _passes(reg[p], reg[q], n[p], n[q], percent)
                p, q = p[ok], q[ok]
                shared = (parts[p] == parts[q]).all(axis=2) & parts[p].any(axis=2)
                ours = shared.argmax(axis=1) == band  # a pair that meets in several bands is given in the first
                if ours.any():
                    p, q = rep[p[ours]], rep[q[ours]]
                    yield pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)})


def _blocks(size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of ``size`` rows, some rows of i at a time."""
    lines = max(1, (1 << 18) // size)
    for at in range(0, size - 1, lines):
        i, j = np.meshgrid(np.arange(at, min(at + lines, size - 1)), np.arange(at + 1, size), indexing="ij")
        some = i < j
        yield i[some], j[some]


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough. Only documents in some pair are shingled again."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"id": x["doc_id"], "set": [shingles(words_of(t), size).tobytes() for t in x["text"]]})

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            same = []
            for p, q in zip(x["sa"], x["sb"], strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                same.append(100 * both >= percent * (len(p) + len(q) - both))
            yield x.loc[np.array(same, bool), ["a", "b"]]

    pairs = written(pairs)
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    full = written(chosen(docs, ids, "doc_id").mapInPandas(sets, "id long, set binary"))
    one = full.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    two = full.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    out = written(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInPandas(kept, "a long, b long").distinct())
    discard(full)
    discard(pairs)
    return out


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that ``near_duplicates`` keeps: those with the smallest id
    of their group.

    Of exactly repeated rows all stay, as they share one id. Null, empty and wordless texts are in no group and stay; so
    do rows with a null id. An empty table gives no row.
    """
    own = fresh(docs, "__id")[0]
    gone = near_duplicates(docs, id_col, text_col, size, percent).where("not kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(own), "left_anti")
