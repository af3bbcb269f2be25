import zlib

import numpy as np
import pytest

from recallgrid.llm import langid as li

BLOCKS = {"en": "the ing tion and er st re".split(), "fr": "le eau oui que ai on é".split(), "de": "sch ung ein ä keit zu ö".split()}


def document(rng, lang):
    return " ".join("".join(rng.choice(BLOCKS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(40, 120)))


@pytest.fixture
def docs(spark, rng):
    rows = [(i, document(rng, lang), lang, "s", 0) for i, lang in enumerate(["en", "fr", "de"] * 90)]
    odd = [(1000, None, "en", "s", 0), (1001, "", "fr", "s", 0), (1002, "12 % ²", "de", "s", 0), (1003, "the and tion", None, "s", 0), (None, document(rng, "fr"), "fr", "s", 0)]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_accuracy_and_odd_rows(docs):
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = li.report(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 1000 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    assert np.mean([want[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.97
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (1000, 1001, 1002)] == [(li.UNKNOWN, 0.0)] * 3
    assert by[1003]["lang_pred"] == "en" and by[None]["held_out"] is False and by[None]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_labels_are_never_read(docs):
    from pyspark.sql import functions as F

    wrong = docs.withColumn("lang", F.when(li.held_out(), "xx").otherwise(F.col("lang")))
    assert {r["lang_pred"] for r in li.report(wrong).collect()} == {"en", "fr", "de", li.UNKNOWN}


def test_without_labels_or_rows(docs):
    assert {r["lang_pred"] for r in li.report(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {li.UNKNOWN}
    assert li.report(docs.limit(0)).count() == 0
    kept = li.with_language(docs)
    assert kept.columns == docs.columns and {1000, 1001, 1002}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_windows_label_every_position():
    net = li.Network(["a", "b"])
    net.start()
    texts = [b"x" * n for n in (1, 127, 128, 129, 300)] + [b""]
    alone = np.concatenate([net.probabilities([t]) for t in texts])
    assert np.allclose(net.probabilities(texts), alone, atol=1e-5) and np.allclose(alone.sum(axis=1), [1, 1, 1, 1, 1, 0], atol=1e-5)
    parts = net.probabilities([texts[4][:128], texts[4][128:256], texts[4][256:]])
    assert np.allclose(alone[4], (parts[0] * 128 + parts[1] * 128 + parts[2] * 44) / 300, atol=1e-5)


def test_gradients():
    net, rng = li.Network(["a", "b", "c"], hidden=4), np.random.default_rng(0)
    net.start(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w, y = rng.integers(0, 256, (5, 7)), rng.integers(0, 3, 5)

    def loss():
        steps, total = np.ascontiguousarray(w.T), 0.0
        for (_, x, *_), (_, z, *_) in zip(net._read(steps, "0"), net._read(steps[::-1], "1")[::-1], strict=True):
            g = net.p["o0"] @ x + net.p["o1"] @ z + net.p["b"]
            total -= (g[y, np.arange(5)] - np.log(np.exp(g).sum(axis=0))).sum()
        return total / w.size

    grad = net.gradients(w, y)
    for k, v in net.p.items():
        at = (1, int(w[0, 0])) if k[0] == "x" else (1, 0)
        old = v[at]
        v[at] = old + 1e-5
        up = loss()
        v[at] = old - 1e-5
        assert abs((up - loss()) / 2e-5 - grad[k][at]) < 1e-6
        v[at] = old


def test_every_count_has_a_share_of_places():
    assert all(li.sample_share(n) * li.PLACES >= 1 for n in (1, 300, 3 * 10**8, 10**10, 10**13)) and li.sample_share(10**10) * 10**10 == pytest.approx(300)


def test_labels_against_a_plain_forward_pass(docs):
    """Each document's label and score by stepping its whole text position by position."""
    network = li.trained(docs)
    sigmoid = lambda x: np.clip(0.2 * x + 0.5, 0, 1)
    h = network.hidden

    def states(raw, d):
        state, out = np.zeros(h), []
        for byte in raw:
            x, u = network.p["x" + d][:, byte], network.p["u" + d] @ state
            r, z = sigmoid(x[:h] + u[:h]), sigmoid(x[h : 2 * h] + u[h : 2 * h])
            new = np.tanh(x[2 * h :] + r * u[2 * h :])
            state = (1 - z) * new + z * state
            out.append(state)
        return np.array(out)

    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id % 27 = 0").collect()}
    for r in li.report(docs).where("doc_id % 27 = 0").collect():
        total = np.zeros(len(network.languages))
        raw = texts[r["doc_id"]].encode()
        for at in range(0, len(raw), li.WINDOW):
            part = raw[at : at + li.WINDOW]
            logits = states(part, "0") @ network.p["o0"].T + states(part[::-1], "1")[::-1] @ network.p["o1"].T + network.p["b"].T
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            total += (e / e.sum(axis=1, keepdims=True)).sum(axis=0)
        total /= len(raw)
        assert network.languages[int(total.argmax())] == r["lang_pred"] and r["score"] == pytest.approx(total.max(), abs=1e-4)
