"""Packing of documents into token sequences along a Hilbert curve.

A document becomes a vector of hashed token counts; random projections take it to a few dimensions, whose quantised
coordinates give its place on a Hilbert curve. Documents are tokenised and placed once and written as ids, two bytes
each, which is all that the sort moves. Spark range-sorts them by place, so each partition holds a stretch of the curve,
and each partition cuts its stretch into sequences: neighbours share them. Only the last tokens of a partition don't
fill a sequence; they go to sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import slices
from recallgrid.tables import written

DIMENSIONS, BITS, CELLS = 4, 10, 4096
LENGTH, END = 4096, 2
#: Words whose ids a Python worker remembers, bytes of text that it tokenises and documents that it places at once.
REMEMBERED, GATHERED, TOGETHER = 600_000, 1 << 23, 64
VOCABULARY = "word_bpe_49k.json"
#: The rules of a vocabulary whose texts can be cut at ASCII white space, as its file states them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def projection(cells: int = CELLS, dimensions: int = DIMENSIONS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((cells, dimensions)).astype(np.float32)


def coordinates(ids: np.ndarray, sizes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Quantised projections of the square roots of hashed token frequencies, for documents of ``sizes`` ids one after another."""
    cells, shift = len(matrix), np.uint32(32 - int(np.log2(len(matrix))))
    ends = np.cumsum(sizes)
    out = np.empty((len(sizes), matrix.shape[1]), np.int64)
    for at in range(0, len(sizes), TOGETHER):
        some = sizes[at : at + TOGETHER]
        cell = ids[ends[at] - sizes[at] : ends[at + len(some) - 1]].astype(np.uint32) * np.uint32(2654435761) >> shift
        own = cell.astype(np.int64) + np.repeat(np.arange(0, cells * len(some), cells), some)
        vectors = np.sqrt(np.bincount(own, minlength=cells * len(some)).astype(np.float32).reshape(len(some), cells))
        scaled = (vectors @ matrix / np.sqrt(np.maximum(some, 1))[:, None] + 4) / 8 * (1 << BITS)  # a unit vector's projections are standard normal
        out[at : at + len(some)] = np.clip(scaled, 0, (1 << BITS) - 1)
    return out


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of coordinates (Skilling's transposed Gray code), as int64."""
    x = points.T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Ids:
    """Token ids of whole texts.

    Where the vocabulary's file states the rules above, which never join across white space, a text's ids are those of
    its words one after another: Arrow cuts the texts and looks the words up among those that the worker remembers, and
    new ones are tokenised once, those of letters alone by the tokenizer's model. For any other vocabulary the tokenizer takes whole texts.
    """

    plain = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+[,.]?$"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        rules = json.loads(self.tokenizer.to_str())
        same = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER and rules["post_processor"] is None
        added = (t["content"] for t in rules["added_tokens"])
        self.by_word = same and not any(re.search(r"\s", x) for x in added)
        self.kind = pa.from_numpy_dtype(self.code)
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(self.kind))  # what is remembered
        self.again = np.zeros(0, bool)  # whether a word came again since it was learnt
        self.marks = {x: self.tokenizer.encode(x, add_special_tokens=False).ids[0] for x in ",."} if self.by_word else {}
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [c for c in range(256) if c not in printed]
        self.alphabet = {c: c for c in printed} | {c: 256 + i for i, c in enumerate(others)}

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and how many each text has."""
        texts = texts.fill_null("")
        if not self.by_word:
            found = [np.array(e.ids, self.code) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, self.code), *found]), np.array([len(x) for x in found], np.int64)
        cut = pc.ascii_split_whitespace(texts)
        words = cut.flatten()
        place = pc.index_in(words, self.words)
        unseen = words.filter(place.is_null())
        place = place.fill_null(-1).to_numpy().copy()
        self.again[place[place >= 0]] = True
        if len(unseen):
            new = unseen.unique()
            place[place < 0] = pc.index_in(unseen, new).to_numpy() + np.int32(len(self.words))
            self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, self._learned(new)])
            self.again = np.append(self.again, np.zeros(len(new), bool))
        ids = self.ids.take(pa.array(place))
        if len(self.words) > REMEMBERED:  # words that came once are forgotten; the others must come again to stay
            kept = pa.array(np.flatnonzero(self.again))
            self.words, self.ids, self.again = self.words.take(kept), self.ids.take(kept), np.zeros(len(kept), bool)
        ends = ids.offsets.to_numpy()
        return ids.flatten().to_numpy(), np.diff(ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()])

    def _learned(self, words: pa.Array) -> pa.ListArray:
        """The ids of each word."""
        plain = pc.match_substring_regex(words, self.plain)
        some = words.filter(plain)
        ends = pc.utf8_slice_codeunits(some, -1)
        stems = pc.utf8_lower(pc.utf8_rtrim(some, ",.")).dictionary_encode()
        found = self._stems(stems.dictionary).take(stems.indices)
        ids, sizes = found.flatten().to_numpy(), np.diff(found.offsets.to_numpy())
        for mark, own in self.marks.items():  # a run of its own after a letter
            after = pc.equal(ends, mark).to_numpy(zero_copy_only=False)
            ids = np.insert(ids, np.cumsum(sizes)[after], own)
            sizes = sizes + after
        rest = [np.array(e.ids, self.code) for e in self.tokenizer.encode_batch_fast(words.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)]
        every = self._lists(np.concatenate([ids, *rest]), np.append(sizes, [len(x) for x in rest]))
        place, plain = np.empty(len(words), np.int64), plain.to_numpy(zero_copy_only=False)
        place[plain], place[~plain] = np.arange(len(some)), np.arange(len(some), len(words))
        return every.take(pa.array(place))

    def _stems(self, words: pa.Array) -> pa.ListArray:
        """The ids of lower-case words of letters alone, straight from the model in its byte alphabet."""
        tokenize, alphabet = self.tokenizer.model.tokenize, self.alphabet
        ids: list[int] = []
        sizes: list[int] = []
        for w in words.to_pylist():
            own = [x.id for x in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(alphabet))]
            ids += own
            sizes.append(len(own))
        return self._lists(np.array(ids, self.code), np.array(sizes, np.int64))

    def _lists(self, ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids, self.kind))


_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One tokenizer, with its memory, for each worker process and vocabulary file."""
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def vocabulary_file(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, hilbert long"


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, hilbert[, ids]).

    A document is its token ids and the end id. Sequences hold ``length`` ids without gaps, except the last of each
    stretch of the curve, which have a power of two. A null or empty text is the end id alone. A text of any length is
    cut over as many sequences as it needs; a task holds one batch of documents. Documents with equal texts are
    neighbours; rows with a null or repeated id are packed like any other; other columns, whatever their names, are
    ignored. An empty table gives no row. ``vocabulary`` is the tokenizer file's path on the executors; None takes the
    installed one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    placed = written(rows.mapInArrow(lambda it: _placed(it, vocabulary), "hilbert long, doc_id long, ids binary"))
    # The hash parts documents of one place, so that a large group of copies can be cut anywhere.
    along = placed.withColumn("part", F.xxhash64("doc_id", "hilbert")).repartitionByRange("hilbert", "part").sortWithinPartitions("hilbert", "part", "doc_id")
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return along.select("hilbert", "doc_id", "ids").mapInArrow(lambda it: _cut(it, length, vocabulary, with_ids), schema)


def gathered(batches: Iterator[pa.RecordBatch], most: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """Small batches together, up to ``most`` bytes, so that the remembered words are indexed less often."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches):
        if held and size + batch.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if size:
        yield pa.concat_batches(held)


def _placed(batches: Iterator[pa.RecordBatch], vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    """(place on the curve, doc_id, ids with the end id) of each document."""
    tokens, matrix = ids_of(vocabulary_file(vocabulary)), projection()
    for batch in gathered(batches):
        ids, sizes = tokens.of(batch.column("text"))
        place = hilbert(coordinates(ids, sizes, matrix))
        ids = np.insert(ids, np.cumsum(sizes), END)
        cuts = np.append(0, np.cumsum(sizes + 1)) * ids.itemsize
        data = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(ids)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("doc_id"), data], ["hilbert", "doc_id", "ids"])
        del batch, ids, data
        pa.default_memory_pool().release_unused()  # the worker process goes on to other stages


def _cut(batches: Iterator[pa.RecordBatch], length: int, vocabulary: str | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Cuts a partition's documents, one after another, at each multiple of ``length`` ids, and its end at powers of two."""
    code = ids_of(vocabulary_file(vocabulary)).code
    sequence = TaskContext.get().partitionId() << 40
    #: What doesn't fill a sequence yet: ids, and for each document its columns, ids here, ids before, ids in all.
    held, rest = np.zeros(0, "<u4"), [np.zeros((5, 0), np.int64), np.zeros(0, bool)]
    for batch in slices(batches):
        binary = batch.column("ids").cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]) // np.dtype(code).itemsize
        at = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset]
        ids = np.frombuffer(binary.buffers()[2], code, int(sizes.sum()), int(at)).astype("<u4")
        of, known = batch.column("doc_id"), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        new = np.stack([of.fill_null(0).to_numpy(), batch.column("hilbert").to_numpy(), sizes, np.zeros_like(sizes), sizes])
        held, rest = np.concatenate([held, ids]), [np.concatenate([rest[0], new], axis=1), np.append(rest[1], known)]
        if full := len(held) // length:
            ends = np.arange(1, full + 1) * length
            out, held, rest = _pieces(held, rest, ends, sequence, with_ids)
            sequence += full
            yield out
    left, ends = len(held), []
    while left:
        ends.append((ends[-1] if ends else 0) + (1 << left.bit_length() - 1))
        left -= 1 << left.bit_length() - 1
    if ends:
        yield _pieces(held, rest, np.array(ends), sequence, with_ids)[0]


def _pieces(held: np.ndarray, rest: list[np.ndarray], ends: np.ndarray, sequence: int, with_ids: bool) -> tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]:
    """The pieces of sequences that end at ``ends``, and what is held after the last."""
    (doc_id, place, sizes, before, total), known = rest
    stop = int(ends[-1])
    first = np.cumsum(sizes) - sizes
    starts = np.union1d(first[first < stop], np.append(0, ends[:-1]))
    of, where = np.searchsorted(first, starts, "right") - 1, np.searchsorted(ends, starts, "right")
    lengths = np.diff(np.append(starts, stop))
    view = memoryview(held.tobytes())
    crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    columns = starts - first[of] + before[of], lengths, crc, total[of], sequence + where, starts - np.append(0, ends)[where], place[of]
    arrays = [pa.array(doc_id[of], pa.int64(), mask=~known[of]), *(pa.array(c, pa.int64()) for c in columns)]
    names = [x.split()[0] for x in PIECES.split(", ")]
    if with_ids:
        names.append("ids")
        arrays.append(pa.ListArray.from_arrays(pa.array(np.append(starts, stop), pa.int32()), pa.array(held[:stop].astype(np.int32))))
    on = first + sizes > stop
    left = np.stack([doc_id, place, np.minimum(sizes, first + sizes - stop), before + np.maximum(stop - first, 0), total])[:, on]
    return pa.RecordBatch.from_arrays(arrays, names), held[stop:].copy(), [left, known[on]]
