import itertools

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recallgrid.llm import line_dedup as ld
from tests.llm.conftest import reachable, sentence


def distance(a, b):
    row = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        new = [j]
        for i, x in enumerate(a, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abcé", max_size=30), st.text("abcé", max_size=30), st.integers(1, 3))
def test_banded_distance(a, b, tau):
    assert ld.within(a, b, tau) == (distance(a, b) <= tau)


def edited(rng, line, n):
    s = list(line)
    for _ in range(n):
        k = rng.randrange(len(s))
        s[k : k + rng.randrange(0, 2)] = rng.choice(["", "x", "é", "日"])
    return "".join(s)


@pytest.mark.parametrize("hot", [2048, 3])
def test_report_equals_brute_force(frame, rng, monkeypatch, hot):
    monkeypatch.setattr(ld, "HOT", hot)
    bases = [sentence(rng, n) for n in (2, 4, 6, 12, 40)]
    texts = [None, "", "\n\n", "short", "short\n short \t"]
    texts += ["\n".join(edited(rng, rng.choice(bases), rng.randrange(0, 4)) for _ in range(4)) for _ in range(20)]
    lines = [(d, k, " ".join(line.split())) for d, t in enumerate(texts) if t for k, line in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    bodies = list(dict.fromkeys(x[2] for x in lines))
    near = {(i, j) for i, j in itertools.combinations(range(len(bodies)), 2) if min(len(bodies[i]), len(bodies[j])) >= ld.LEAST and distance(bodies[i], bodies[j]) <= ld.TAU}
    root = reachable(len(bodies), near)  # bodies stand in the order of their first places
    first = {b: min((d, k) for d, k, x in lines if x == b) for b in bodies}
    got = {(r["doc_id"], r["line_no"]): r for r in ld.line_report(frame(texts)).collect()}
    assert len(got) == len(lines)
    for d, k, body in lines:
        r, i = got[d, k], bodies.index(body)
        head = first[bodies[root[i]]]
        assert (r["head_doc"], r["head_line"]) == head and r["kept"] == ((d, k) == head)
        assert r["n_copies"] == sum(x[2] == body for x in lines) and r["n_links"] == sum(i in p for p in near)


def test_repeated_lines_are_cut(frame):
    shared, other = "a line that stands in many documents", "another line that is quite long too"
    texts = [f"{shared}\n{other}", f"{shared}\nIt.", shared, f"It.\n{other}x\nIt.", None, "", "It."]
    out = {r["doc_id"]: r for r in ld.without_repeated_lines(frame(texts)).collect()}
    assert {i: r["text"] for i, r in out.items()} == {0: texts[0], 1: "It.", 3: "It.\nIt.", 4: None, 5: "", 6: "It."}
    assert out[1]["n_chars"] == 3 and out[0]["n_chars"] == len(texts[0])
    assert ld.without_repeated_lines(frame([])).count() == 0


def test_null_ids_and_repeated_rows(frame):
    line = "the very same line of some length"
    rows = ld.line_report(frame([line, line, line], [4, 4, None])).collect()
    assert {(r["doc_id"], r["n_copies"], r["head_doc"]) for r in rows} == {(4, 3, None), (None, 3, None)}


@pytest.mark.parametrize(("hot", "rows"), [(3, 2), (2, 1), (5, 4), (2048, 3)])
def test_keys_over_many_batches_lose_no_pair(rng, monkeypatch, hot, rows):
    monkeypatch.setattr(ld, "HOT", hot)
    entries = [(2 * k + rng.randrange(2), rng.randrange(9), 0) for k in range(12) for _ in range(rng.randrange(1, 25))]
    entries += [(2 * 50 + 1, i, 0) for i in range(20)] + [(2 * 60 + 1, i, 0) for i in range(20)] + [(2 * 60, 7, 0)]
    entries.sort()
    want = {(min(i, j), max(i, j)) for k, i, _ in entries for m, j, _ in entries if k & 1 == 0 and k >> 1 == m >> 1 and i != j}
    split = (entries[at : at + rows] for at in range(0, len(entries), rows))
    batches = (pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*part, strict=True)], ["key", "line_id", "bag"]) for part in split)
    found = [r for b in ld._candidates(batches, ld.TAU) for r in b.to_pylist()]
    given_back = [r for r in found if r["key"] is not None]
    got = {(r["a"], r["b"]) for r in found if r["key"] is None}
    got |= {(min(x["a"], y["a"]), max(x["a"], y["a"])) for x in given_back for y in given_back if x["key"] & 1 == 0 and x["key"] >> 1 == y["key"] >> 1 and x["a"] != y["a"]}
    assert got == want and bool(given_back) == (hot < 2048)


def test_one_common_segment_over_many_batches(spark, frame, rng):
    """More lines with one middle segment than HOT and than a batch; each has one partner, with which it shares no other segment."""
    lines = []
    for _ in range(1600):
        head = "".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(10))
        lines.append(f"{head} the same middle {head[::-1]}")
    partners = [f"x{line[1:-1]}y" for line in lines]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        got = {r["doc_id"]: (r["n_links"], r["head_doc"]) for r in ld.line_report(frame(lines + partners)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {i: (1, i % 1600) for i in range(3200)}


@pytest.mark.parametrize("tau", [1, 2, 8])
def test_hot_pairs_equal_brute_force(spark, rng, tau):
    def sketch(bag, edits):
        for _ in range(edits):
            i, step = rng.randrange(16), rng.choice((-1, 1))
            bag = bag & ~(15 << 4 * i) | ((bag >> 4 * i) + step & 15) << 4 * i
        return bag

    bases = [rng.getrandbits(64) for _ in range(3)]
    entries = [(i, 2 * rng.randrange(2) + rng.randrange(2), sketch(rng.choice(bases), rng.randrange(2 * tau + 3))) for i in range(120)]
    entries = [(i, key, bag - (1 << 64) if bag >> 63 else bag) for i, key, bag in entries]
    near = lambda x, y: bool(ld.bags_within(np.array([x]), np.array([y]), tau)[0])
    want = {(min(x, y), max(x, y)) for x, k, p in entries for y, m, q in entries if k & 1 == 0 and k >> 1 == m >> 1 and x != y and near(p, q)}
    frame = spark.createDataFrame(entries, "a long, key long, bag long")
    assert want and {(r["a"], r["b"]) for r in ld._hot_pairs(frame, tau).collect()} == want


def test_rows_that_share_an_id_lose_only_their_own_repeats(spark, frame):
    """What stands nowhere else stays, whether ids repeat or are missing."""
    shared = "a line that all of these texts have"
    texts = [f"{shared}\nfirst text, its own second line", f"{shared}\n{shared}\nfirst own line of the second text\nother text with this id, its second line", f"own first line of the third text\n{shared}", None]
    for ids in ([5, 5, 5, 5], [None] * 4, [5, None, 5, None], [1, 2, 3, 4]):
        got = [r["text"] for r in ld.without_repeated_lines(frame(texts, ids)).collect()]
        lines = [line for t in got if t for line in t.split("\n")]
        want = {line for t in texts if t for line in t.split("\n")}
        assert set(lines) == want and got.count(None) == 1
        own = [line for line in lines if line != shared]
        assert len(own) == len(set(own))
