import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(words))


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def frame(spark):
    """Documents from texts, with an extra column whose name clashes with results."""

    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t), True) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS + ", kept boolean")

    return make


def reachable(n: int, links: set[tuple[int, int]]) -> list[int]:
    """The smallest index reachable from each, by plain union-find."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return [root(i) for i in range(n)]
