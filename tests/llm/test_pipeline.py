import re

import corpus_pipeline as cp
from recallgrid.llm import langid, line_dedup
from tests.llm.test_langid import document
from tests.llm.test_packing import direct


def edits(a, b):
    row = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        new = [j]
        for i, x in enumerate(a, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (x != y)))
        row = new
    return row[-1]


def near_lines(a, b):
    return abs(len(a) - len(b)) <= line_dedup.TAU and edits(a, b) <= line_dedup.TAU


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def has_window(text, item):
    words, own = (re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower()) for x in (text, item))
    joined = f" {' '.join(words)} "
    return any(f" {' '.join(own[i : i + 10])} " in joined for i in range(max(1, len(own) - 9)))


def test_stages_equal_brute_force(spark, rng, tmp_path):
    texts = [document(rng, lang) for lang in ["en", "fr", "de"] * 40]
    leak = document(rng, "en")
    texts += ["%%% 12", None, "", texts[0], texts[1] + " eau", texts[2] + "\n" + texts[3], leak + " tion the", "the\nthe"]
    rows = [(i, t, ["en", "fr", "de"][i % 3] if i < 120 else None, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        steps[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {name: {r["doc_id"]: r["text"] for r in df.collect()} for name, df in steps.items() if name != "packing"}
    assert set(range(120)) <= got["language"].keys() and {120, 121, 122}.isdisjoint(got["language"])
    # Lines: the first of equal ones by (id, line) stays; whole documents are one line each here but for 125 and 127.
    kept, seen = {}, []
    for i in sorted(got["language"]):
        lines = []
        for line in got["language"][i].split("\n"):
            body = " ".join(line.split())
            near = len(body) >= line_dedup.LEAST and any(near_lines(body, s) for s in seen)
            if not near:
                lines.append(line)
                seen += [body] if len(body) >= line_dedup.LEAST else []
        if lines:
            kept[i] = "\n".join(lines)
    assert got["lines"] == kept and 123 not in kept
    sets = {i: five_words(t) for i, t in kept.items()}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    unique = {i: t for i, t in kept.items() if not any(j < i and alike(i, j) for j in kept)}
    assert got["near_duplicates"] == unique and 124 not in unique
    clean = {i: t for i, t in unique.items() if not has_window(t, leak)}
    assert got["benchmark"] == clean and 126 not in clean
    pieces = steps["packing"].collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == {i: len(direct(t)) for i, t in clean.items()}
    assert sorted(tuple(r) for r in cp.run(spark, folder).select("doc_id", "start", "length").collect()) == sorted((r["doc_id"], r["start"], r["length"]) for r in pieces)
    assert langid.UNKNOWN not in got["benchmark"]


def test_stages_on_empty_tables_and_clashing_names(spark, tmp_path):
    folder, schema = str(tmp_path), "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    more = {"__id": "int", "__gone": "int", "__lang": "int", "__score": "int", "__spans": "int", "__items": "int", "__n_words": "int"}
    wide = schema + "".join(f", {k} {v}" for k, v in more.items())
    rows = [(1, None, None, None, None, *range(7)), (None, "a line that repeats, and is long", None, "s", 32, *range(7)), (2, "a line that repeats, and is long", "en", "s", 32, *range(7))]
    for name, stage in cp.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), folder).count() == 0
        out = stage(spark, spark.createDataFrame(rows, wide), folder)
        found = sorted({r["doc_id"] for r in out.collect()}, key=lambda x: (x is not None, x))
        assert found == {"language": [], "lines": [None, 1], "near_duplicates": [None, 1, 2], "benchmark": [None, 1, 2], "packing": [None, 1, 2]}[name]
        assert name == "packing" or out.columns == wide.replace(", ", " ").split()[::2]
