"""The prefix trie against a plain one, over many partitions and with groups that go over their edges."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from recallgrid.llm import prefix_trie, registry

FOLDER = "/root/testdata/sf0.001"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(conversations):
    """The rows of all nodes from the definition."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(conversations[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_conversations(rng, n):
    """Few texts, so that prefixes are shared, and a third of all conversations the same."""
    texts = ["", "a", "éé", "long text", "ab"]
    out = []
    for c in range(-20, n - 20):
        if c % 3 == 0:
            out += [(c, i, "user", "same") for i in range(3)]
            continue
        out += [(c, i if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice([*texts, None])) for i in range(1 + min(rng.randrange(9), 5))][:6]
    return [r for i, r in enumerate(out) if r[1] is not None or not any(x[0] == r[0] and x[1] is None for x in out[:i])]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_nodes_equal_a_plain_trie(spark, rng, parts):
    rows = random_conversations(rng, 400)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", depth int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert rows_of(prefix_trie.report(df)) == plain(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_copies_chains_and_long_lists_over_edges(spark, monkeypatch):
    """All the same, all a prefix of the next, and lists of ids in several pieces: each over many partitions."""
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    same = {c: [("u", "x"), ("a", "yy")] for c in range(100, 400)}
    chain = {c: [("u", str(i)) for i in range(c)] for c in range(60)}
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    try:
        for conversations in (same, chain, same | chain, {5: []}, {5: [], 9: []}):
            path = [(c, b"".join(hashlib.sha256(repr(t).encode()).digest()[:16] for t in turns), [len(t[1]) for t in turns]) for c, turns in conversations.items()]
            df = spark.createDataFrame(path, "conv_id long, path binary, sizes array<long>")
            assert rows_of(prefix_trie.prefix_nodes(df)) == plain(conversations)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_sparse_table_searches(rng):
    values = np.array([-1, *(rng.randrange(5) for _ in range(200)), -1])
    minima = prefix_trie.Minima(values)
    for _ in range(300):
        i, d = rng.randrange(201), rng.randrange(6)
        right = next(r for r in range(i, 201) if values[r + 1] < d)
        left = next(x for x in range(i, -1, -1) if values[x] < d)
        assert minima.right(np.array([i]), np.array([d]))[0] == right and minima.left(np.array([i]), np.array([d]))[0] == left
        a, b = sorted((rng.randrange(202), rng.randrange(202)))
        assert minima.of(np.array([a]), np.array([b]))[0] == values[a : b + 1].min()


def test_edge_cases(spark):
    assert rows_of(prefix_trie.report(spark.createDataFrame([], SCHEMA))) == []
    rows = [(None, 0, "user", "no id"), (7, None, None, None), (7, 3, "user", "x" * 100_000), (7, 3, "user", "x" * 100_000), (8, 0, "a", "b:c"), (9, 0, "a:b", "c")]
    got = rows_of(prefix_trie.prefix_nodes(prefix_trie.paths(spark.createDataFrame(rows, SCHEMA))))
    want = {7: [("", ""), ("user", "x" * 100_000), ("user", "x" * 100_000)], 8: [("a", "b:c")], 9: [("a:b", "c")]}
    assert got == plain(want)
    assert rows_of(prefix_trie.report(spark.createDataFrame(rows[:1], SCHEMA))) == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_query_equals_its_sql_and_the_plain_trie(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    got = rows_of(registry.QUERIES["op13_prefix_trie"](spark, FOLDER))
    cursor = db.execute(registry.ORACLES["op13_prefix_trie"])
    assert [c[0] for c in cursor.description] == NAMES
    assert got == sorted(map(tuple, cursor.fetchall()), key=str)
    assert got == plain(rebuilt(db.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()))
