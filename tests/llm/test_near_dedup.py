import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from recallgrid.llm import near_dedup as nd
from tests.llm.conftest import reachable, sentence


def shingles(text, size):
    w = nd.words_of(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def variants(rng, text, n):
    out = []
    for _ in range(n):
        words = text.split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        out.append(" ".join(words))
    return out


def test_equals_brute_force(frame, rng):
    texts = [None, "", "  \n ", "one", "one", "One two", "x" * 50_000 + " y"]
    for words in (5, 9, 20, 60, 200):
        texts += variants(rng, sentence(rng, words), 14)
    common = sentence(rng, 25)
    texts += [common + "\n" + sentence(rng, rng.randrange(1, 40)) for _ in range(60)]
    found = nd.near_duplicates(frame(texts), size=3, percent=85)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    sets = [shingles(t, 3) for t in texts]
    links = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    want = reachable(len(texts), links)
    got = {r["doc_id"]: r for r in found.collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def test_several_blocks_compare_all(frame, rng, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    base = sentence(rng, 40)
    texts = variants(rng, base, 60)
    sets = [shingles(t, 3) for t in texts]
    links = {(i, j) for i, j in itertools.combinations(range(60), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(frame(texts), size=3, percent=85).collect()}
    assert [got[i] for i in range(60)] == reachable(60, links)


def test_null_ids_repeated_rows_and_empty_tables(frame):
    text = "a b c d e f g h"
    rows = nd.near_duplicates(frame([text, text, text, "other words stand here now"], [7, 7, None, 3])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [("3", "3", True), ("7", "7", True), ("7", "7", True), ("None", "None", True)]
    assert nd.near_duplicates(frame([])).count() == 0


def test_filter_keeps_all_columns_and_one_of_each_group(frame):
    text = "a b c d e f g h i j"
    out = nd.without_near_duplicates(frame([text, text + " k", "", None, "something else entirely is written here"]))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3, 4]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 2**32))
def test_no_similar_pair_is_pruned_and_estimates_are_near(common, own, seed):
    x = np.random.default_rng(seed).integers(0, 2**64, common + 2 * own, dtype=np.uint64)
    a, b = np.unique(x[: common + own]), np.unique(np.concatenate([x[:common], x[common + own :]]))
    jaccard = common / (common + 2 * own)
    ra, rb, n, m = nd.registers(a)[None], nd.registers(b)[None], np.array([len(a)]), np.array([len(b)])
    if jaccard >= 0.85:
        assert nd._passes(ra, rb, n, m, 85).all()
        assert ((nd.bands(ra) == nd.bands(rb)).all(axis=2) & nd.bands(ra).any(axis=2)).any()
    if common > 300:
        assert abs(nd.estimate(ra, rb, n, m)[0] - jaccard) < 0.2
