from recallgrid.llm import decontaminate as dc
from tests.llm.conftest import sentence


def brute(text, items):
    words, hit, found = dc.words_of(text), set(), set()
    for item, own in items:
        own = dc.words_of(own)
        for i in range(max(1, len(own) - 9) if own else 0):
            w = own[i : i + 10]
            for at in range(len(words) - len(w) + 1):
                if words[at : at + len(w)] == w:
                    hit.update(range(at, at + len(w)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def fixture(rng):
    items = [(str(k), sentence(rng, n)) for k, n in enumerate((1, 2, 3, 9, 10, 11, 30, 60))] + [("dup", "dup words")] * 2 + [("none", ""), ("7", sentence(rng, 15))]
    texts = [None, "", "...", "ÉÀ-x9"]
    for _ in range(60):
        parts = [sentence(rng, rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(items)[1].split()
            at = rng.randrange(0, max(1, len(w) - 8))
            parts += [" ".join(w[at : at + rng.randrange(5, 25)]).upper().replace(" ", ", "), sentence(rng, rng.randrange(0, 9))]
        texts.append(" ".join(parts))
    return texts, items


def test_equals_brute_force_in_one_and_in_many_blocks(spark, frame, rng, monkeypatch):
    texts, items = fixture(rng)
    bench = spark.createDataFrame([*items, (None, "words of no item"), ("empty", None)], "item_id string, text string")
    for size in (dc.BLOCK_BYTES, 100):
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        got = {r["doc_id"]: r for r in dc.contamination(frame(texts), bench).collect()}
        for i, text in enumerate(texts):
            n, hit, found = brute(text, items)
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["items"], r["n_items"]) == (n, hit, found, len(found))
            assert sum(s["end"] - s["start"] for s in r["spans"]) == hit
        kept = dc.without_contaminated(frame(texts), bench)
        assert kept.columns == frame([]).columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute(t, items)[1]}


def test_empty_tables_and_the_digest(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    r = dc.report(frame(["a b"]), none).first()
    assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (2, 0, 0, False)
    assert r["items_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert dc.report(frame([]), none).count() == 0
