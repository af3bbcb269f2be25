import itertools
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from recallgrid.llm import packing as pk
from tests.llm.conftest import sentence

ODD = [None, "", "  ", "it's, I'LL\tdon't\n\n", "a b c\x1fd\x85e", "İstanbul ΑΣ.", "<|endoftext|> x", "日本 \U0001f600a", "12 345 6.7 $$$", "é ﬁ ßx", "a.,. b., c,"]


def direct(text):
    t = Tokenizer.from_file(public_tokenizers.path(pk.VOCABULARY))
    return [*t.encode(text or "", add_special_tokens=False).ids, pk.END]


def test_pieces_give_back_every_id(spark, frame, rng):
    texts = [*ODD, *(sentence(rng, rng.randrange(0, 400)) for _ in range(60)), sentence(rng, 9000), *["copy of one text"] * 30]
    rows = pk.packed(frame(texts), with_ids=True).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        want = direct(text)
        assert [x for r in own for x in r["ids"]] == want and all(r["doc_tokens"] == len(want) for r in own)
        assert [r["start"] for r in own] == list(itertools.accumulate([0] + [r["length"] for r in own]))[:-1]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in own)
    padding = 0
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at <= pk.LENGTH
        padding += 0 if at & (at - 1) == 0 else pk.LENGTH - at
    assert padding == 0


def test_ids_after_the_memory_was_full(monkeypatch, rng):
    monkeypatch.setattr(pk, "REMEMBERED", 50)
    ids = pk.Ids(public_tokenizers.path(pk.VOCABULARY))
    texts = [sentence(rng, 40) for _ in range(20)] + ["The word, the Word."] * 3
    for _ in range(3):
        for t in texts:
            assert [*ids.of(pa.array([t]))[0].tolist(), pk.END] == direct(t)


def test_hilbert_neighbours_touch():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    key = pk.hilbert(points, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def test_empty_table_and_null_ids(frame):
    assert pk.packed(frame([])).count() == 0
    assert [(r["doc_id"], r["length"]) for r in pk.packed(frame(["", ""], [None, None])).collect()] == [(None, 1), (None, 1)]


def test_a_vocabulary_with_other_rules_takes_whole_texts(frame, rng):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, texts = Tokenizer.from_file(path), [*ODD, *(sentence(rng, rng.randrange(0, 400)) for _ in range(20))]
    rows = pk.packed(frame(texts), vocabulary=path, with_ids=True).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == [*whole.encode(text or "", add_special_tokens=False).ids, pk.END]


def test_pieces_follow_the_curve(spark, frame, rng):
    """In the order of sequences and offsets the places on the curve never fall, and are those of the documents' ids."""
    texts = [*ODD, *(sentence(rng, rng.randrange(0, 300)) for _ in range(150)), *["copy of one text"] * 20]
    rows = pk.packed(frame(texts).repartition(7)).collect()
    order = [r["hilbert"] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert order == sorted(order) and len(set(order)) > 100
    matrix = pk.projection()
    for r in rows:
        ids = np.array(direct(texts[r["doc_id"]])[:-1], np.uint16)
        assert r["hilbert"] == pk.hilbert(pk.coordinates(ids, np.array([len(ids)]), matrix))[0]
