import random

import pytest

from recallgrid.llm import licenses as ls


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(60))
def test_alignment_equals_the_common_subsequence(seed):
    rng = random.Random(seed)
    template = [f"w{rng.randrange(40)}" for _ in range(30)]
    own = list(template)
    for _ in range(rng.randrange(6)):
        k = rng.randrange(len(own))
        own[k : k + rng.randrange(0, 2)] = rng.choice([[], ["w1"], ["new"]])
    text = "before it " + " ".join(own) + " after"
    index = ls.Index({"t": " ".join(template)})
    found = index.matches(ls.word_hashes(ls.words_of(text)[0]), 0.5)
    assert len(found) == 1 and found[0][1] == longest(template, own)


def test_spans_and_odd_rows(frame):
    mit = ls.TEMPLATES["MIT"].replace("free of charge", "at no cost").replace("sublicense, and/or", "")
    text = f"Intro. {mit} Then more.\nReleased under the MIT License. End"
    texts = [text, None, "", "no licence at all", "licensed UNDER the apache license version 2.0", "x " * 40_000 + ls.TEMPLATES["MPL-2.0"]]
    rows = {r["doc_id"]: r for r in ls.licenses(frame(texts)).collect()}
    first, second = rows[0]["matches"]
    assert first["template"] == "MIT" and 0.9 < first["coverage"] < 1 and text[first["start"] :].startswith("Permission is") and text[: first["end"]].endswith("of the Software")
    assert second["template"] == "MIT-line" and text[second["start"] : second["end"]] == "Released under the MIT License"
    assert [rows[i]["n_matches"] for i in range(6)] == [2, 0, 0, 0, 1, 1] and rows[4]["matches"][0]["coverage"] == 1
    best = {r["doc_id"]: r["license"] for r in ls.report(frame(texts)).collect()}
    assert best == {0: "MIT", 1: None, 2: None, 3: None, 4: "Apache-2.0-line", 5: "MPL-2.0"}
    assert ls.licenses(frame([])).count() == 0 and ls.licenses(frame(["a"]), {}).first()["n_matches"] == 0


def test_many_repeats_of_one_line():
    index = ls.Index(ls.TEMPLATES)
    text = "Released under the MIT License. " * 500
    assert len(index.matches(ls.word_hashes(ls.words_of(text)[0]), ls.LEAST)) >= 499


def test_every_match_is_a_row(frame):
    text = f"{ls.TEMPLATES['MIT']} Or else: {ls.TEMPLATES['CC-BY-4.0-line']}"
    rows = [(r["doc_id"], r["n_matches"], r["license"]) for r in ls.every_match(frame([text, "none", None])).collect()]
    assert sorted(rows, key=str) == [(0, 2, "CC-BY-4.0-line"), (0, 2, "MIT"), (1, 0, None), (2, 0, None)]


RELATIVES = ["GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "BSD-line", "BSD-2-Clause", "BSD-3-Clause"]


@pytest.mark.parametrize("name", RELATIVES)
def test_close_relatives_are_told_apart(name):
    found = ls.Index(ls.TEMPLATES).matches(ls.word_hashes(ls.words_of(f"Intro. {ls.TEMPLATES[name]} The end")[0]), ls.LEAST)
    assert [(m[0], m[2]) for m in found] == [(name, 1.0)]


def test_query_equals_comparing_every_template_with_every_passage(frame, rng):
    """Documents of filler and passages, some of them changed: each passage goes to the template with the longest common
    subsequence of all, as plain comparison finds it."""
    names, texts, want = sorted(ls.TEMPLATES), [], []
    words = {n: [w.decode() for w in ls.words_of(ls.TEMPLATES[n])[0]] for n in names}
    for i in range(40):
        parts, expected = [], []
        for k in range(rng.randrange(4)):
            own = list(words[names[(i * 3 + k) % len(names)]])
            for _ in range(rng.randrange(len(own) // 12 + 1)):
                del own[rng.randrange(len(own))]
            parts += [" ".join(f"filler{rng.randrange(10**6)}" for _ in range(30)), " ".join(own)]
            scored = [(longest(words[n], own), longest(words[n], own) / len(words[n]), n) for n in names]
            good = [s for s in scored if s[1] >= ls.LEAST]
            if good:
                most = max(s[:2] for s in good)
                at = len(" ".join(parts)) - len(parts[-1])
                expected.append((min(s[2] for s in good if s[:2] == most), *most, at, at + len(parts[-1])))
        texts.append(" ".join(parts))
        want.append(expected)
    found = {}
    for r in ls.every_match(frame(texts)).collect():
        found.setdefault(r["doc_id"], []).extend([(r["license"], r["matched_words"], r["coverage"], r["start"], r["end"])] if r["license"] else [])
    for i, expected in enumerate(want):
        own = sorted(found[i], key=lambda m: m[3])
        assert [m[:3] for m in own] == [m[:3] for m in expected], (i, own, expected)
        assert all(a[3] <= m[3] and m[4] <= a[4] for m, a in zip(own, expected, strict=True))


def test_repeated_rows_and_a_clashing_column(frame):
    docs = frame([ls.TEMPLATES["MIT"]] * 2, [3, 3]).withColumnRenamed("source", "matches")
    assert [(r["doc_id"], r["n_matches"]) for r in ls.licenses(docs).collect()] == [(3, 1), (3, 1)]
