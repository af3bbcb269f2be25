"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction is a gated recurrent unit that reads one byte a step; the states of both directions at a position give
that position's language probabilities, and a document's are the mean over all its positions. The network is trained in
numpy by backpropagation through time, on the driver, from a sample of a documented bound. Whole texts are labelled on
the executors: a text is cut into windows of equal length whose positions are all labelled, and all windows of a batch
step together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import fresh

#: Bounds of the training sample: documents of each language (1.5 times that at most in expectation) and windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_BYTES = 240, 8, 64
HIDDEN, WINDOW, UNKNOWN = 8, 128, "und"
#: Windows that step together: 512 kB of text.
TOGETHER = 4096


@dataclass
class Network:
    """Parameters by name; direction 0 reads forward, 1 backward. Arrays are (unit, row), so that rows are contiguous."""

    languages: list[str]
    hidden: int = HIDDEN
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int = 5) -> None:
        rng, h, c = np.random.default_rng(seed), self.hidden, len(self.languages)
        for d in "01":
            self.p["x" + d] = rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(h), (3 * h, h)).astype(np.float32)
            self.p["o" + d] = rng.normal(0, 1 / np.sqrt(h), (c, h)).astype(np.float32)
        self.p["b"] = np.zeros((c, 1), np.float32)

    def step(self, state: np.ndarray, read: np.ndarray, d: str) -> tuple[np.ndarray, ...]:
        """(new state, recurrent part of the candidate, gates, candidate) after one byte of each row."""
        h = self.hidden
        given = np.take(self.p["x" + d], read, axis=1)
        own = self.p["u" + d] @ state
        gates = given[: 2 * h]
        gates += own[: 2 * h]
        gates *= 0.2
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        new = gates[:h] * own[2 * h :]
        new += given[2 * h :]
        np.tanh(new, out=new)
        after = state - new
        after *= gates[h:]
        after += new
        return after, own[2 * h :], gates, new

    def logits(self, steps: np.ndarray, active: np.ndarray, d: str) -> np.ndarray:
        """(step, language, row) parts of the logits; the first ``active[t]`` rows take step t."""
        out = np.zeros((len(steps), len(self.languages), steps.shape[1]), np.float32)
        state = np.zeros((self.hidden, steps.shape[1]), np.float32)
        for t, n in enumerate(active):
            state = self.step(np.ascontiguousarray(state[:, :n]), steps[t, :n], d)[0]
            out[t, :, :n] = self.p["o" + d] @ state
        return out

    def _read(self, steps: np.ndarray, d: str) -> list[tuple[np.ndarray, ...]]:
        """For each step: the state before, then what ``step`` gives."""
        state, kept = np.zeros((self.hidden, steps.shape[1]), np.float32), []
        for read in steps:
            kept.append((state, *self.step(state, read, d)))
            state = kept[-1][1]
        return kept

    def _back(self, steps: np.ndarray, d: str, kept: list[tuple[np.ndarray, ...]], wanted: list[np.ndarray], grad: dict[str, np.ndarray]) -> None:
        """The gradients of one direction's parameters, given those of its states."""
        h, u = self.hidden, self.p["u" + d]
        gu, carry, given = np.zeros_like(u), np.zeros_like(wanted[0]), []
        for t in range(len(steps) - 1, -1, -1):
            state, _, own, gates, new = kept[t]
            g = wanted[t] + carry
            r, z = gates[:h], gates[h:]
            g_new = g * (1 - z) * (1 - new * new)
            g_z = g * (state - new) * 0.2 * ((z > 0) & (z < 1))
            g_r = g_new * own * 0.2 * ((r > 0) & (r < 1))
            g_own = np.concatenate([g_r, g_z, g_new * r])
            given.append(np.concatenate([g_r, g_z, g_new]))
            gu += g_own @ state.T
            carry = g * z + u.T @ g_own
        flat = np.concatenate(given[::-1], axis=1)
        grad["x" + d] = np.stack([np.bincount(steps.ravel(), row, 256) for row in flat]).astype(np.float32)
        grad["u" + d] = gu

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over all positions of full windows, by backpropagation through time."""
        steps = np.ascontiguousarray(windows.T)
        f, b = self._read(steps, "0"), self._read(steps[::-1], "1")[::-1]
        grad: dict[str, np.ndarray] = {"o0": np.zeros_like(self.p["o0"]), "o1": np.zeros_like(self.p["o1"]), "b": np.zeros_like(self.p["b"])}
        wanted: tuple[list, list] = ([], [])
        for (_, x, *_), (_, y, *_) in zip(f, b, strict=True):
            g = self.p["o0"] @ x + self.p["o1"] @ y + self.p["b"]
            g = np.exp(g - g.max(axis=0))
            g /= g.sum(axis=0)
            g[labels, np.arange(len(labels))] -= 1
            g /= windows.size
            grad["b"] += g.sum(axis=1, keepdims=True)
            for d, state, to in (("0", x, wanted[0]), ("1", y, wanted[1])):
                grad["o" + d] += g @ state.T
                to.append(self.p["o" + d].T @ g)
        self._back(steps, "0", f, wanted[0], grad)
        self._back(steps[::-1], "1", b[::-1], wanted[1][::-1], grad)
        return grad

    def fit(self, windows: np.ndarray, labels: np.ndarray, rounds: int = 200, batch: int = 128, rate: float = 0.02, seed: int = 7) -> None:
        """Adam over random batches, the rate falling to nothing in the second half."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, rounds + 1):
            pick = rng.integers(0, len(windows), batch)
            pace = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
            for k, v in self.gradients(windows[pick], labels[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                self.p[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean of the positions' probabilities for each text; all zero for an empty one."""
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = -(-sizes // WINDOW)
        total = np.zeros((len(texts), len(self.languages)))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        owner = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.repeat(np.cumsum(sizes) - sizes, counts) + number * WINDOW
        length = np.minimum(WINDOW, sizes[owner] - number * WINDOW)
        by = np.argsort(-length, kind="stable")
        for at in range(0, len(by), TOGETHER):
            rows = by[at : at + TOGETHER]
            n = length[rows]
            t = np.arange(n[0])[:, None]
            active = np.searchsorted(-n, -t[:, 0], side="left")  # rows longer than t, as they are sorted by length
            f = self.logits(raw[np.minimum(start[rows] + t, len(raw) - 1)], active, "0")
            b = self.logits(raw[np.maximum(start[rows] + n - 1 - t, 0)], active, "1")
            whole = int(np.searchsorted(-n, -n[0], side="right"))
            f[:, :, :whole] += b[::-1, :, :whole]
            for i in range(whole, len(rows)):
                f[: n[i], :, i] += b[: n[i], :, i][::-1]
            f += self.p["b"]
            f -= f.max(axis=1, keepdims=True)
            np.exp(f, out=f)
            weight = (t < n) / f.sum(axis=1)
            np.add.at(total, owner[rows], np.einsum("tcn,tn->nc", f, weight.astype(np.float32)))
        return total / np.maximum(sizes, 1)[:, None]


#: Places of a hash: so many that a share of any count of rows is told apart.
PLACES = 1 << 52


def sample_share(count: int) -> float:
    """The share of a language's rows that the sample takes; above 0 for every count."""
    return min(1.0, SAMPLE_DOCS * 1.25 / max(count, 1))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network fitted to a bounded sample of the labelled rows that are not held out; None if there is none.

    The sample has about SAMPLE_DOCS documents of each language, chosen by a hash of their id and text, equal texts once,
    with up to SAMPLE_WINDOWS windows of SAMPLE_BYTES bytes from places all over each text. Texts of fewer bytes are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(False)) & (F.octet_length("text") >= SAMPLE_BYTES))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, sample_share(n))])
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(PLACES)) / PLACES
    chosen = rows.where(place < share[F.col("lang")]).select("lang", "text").distinct()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rng = np.random.default_rng(zlib.crc32(raw))
                for at in rng.integers(0, len(raw) - SAMPLE_BYTES + 1, min(SAMPLE_WINDOWS, len(raw) // SAMPLE_BYTES)).tolist():
                    langs.append(lang)
                    parts.append(raw[at : at + SAMPLE_BYTES])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])

    sample = sorted((r["lang"], bytes(r["part"])) for r in chosen.mapInArrow(windows, "lang string, part binary").collect())
    network = Network(sorted({lang for lang, _ in sample}))
    network.start()
    data = np.frombuffer(b"".join(part for _, part in sample), np.uint8).reshape(-1, SAMPLE_BYTES)
    network.fit(data, np.array([network.languages.index(lang) for lang, _ in sample]))
    return network


def languages(docs: DataFrame, network: Network | None, text_col: str = "text", lang: str = "__lang", score: str = "__score") -> DataFrame:
    """``docs`` with columns ``lang`` and ``score``: the most probable language of each whole text and its mean probability.

    A null text, one without a letter, and every text if there is no network, are UNKNOWN with score 0. Texts of any
    length are read to their end, a bounded number of windows at a time. Repeated rows each get theirs.
    """

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if network else []
            found, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
            at = 0
            while at < len(lettered):
                part, size = [], 0
                while at < len(lettered) and size < WINDOW * TOGETHER:
                    part.append(lettered[at])
                    size += len(texts[lettered[at]])
                    at += 1
                for i, row in zip(part, network.probabilities([texts[i].encode("utf-8", "surrogatepass") for i in part]), strict=True):
                    found[i], sure[i] = network.languages[int(row.argmax())], min(1.0, float(row.max()))
            out = [*batch.columns, pa.array(found, pa.string()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names, lang, score])

    schema = docs.select("*", F.lit("").alias(lang), F.lit(0.0).alias(score)).schema
    return docs.mapInArrow(labelled, schema)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row. Rows with a null id are not held out; repeated rows each count.

    Labels that are null or wrong are never read for a prediction. An empty table gives no row.
    """
    network = trained(docs)
    out = languages(docs.select("doc_id", "text"), network)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def with_language(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose language is known with a score of at least ``least``.

    Null texts and those without a letter go; if no row is labelled there is no known language and all rows go. Rows
    with a null id or label are judged by their text like any other; repeated rows stay or go together. An empty table
    gives no row.
    """
    lang, score = fresh(docs, "__lang", "__score")
    return languages(docs, trained(docs), lang=lang, score=score).where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)
