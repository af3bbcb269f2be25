"""Secret scans: fixed patterns, and strings that a tokenizer's vocabulary can't shorten.

A byte-pair vocabulary holds what is frequent in written text, so words, code and identifiers take several characters a
token and a random string takes hardly more than one. A run of key-like characters whose characters per token stay under
a bound is a secret, unless it is a digest of a known length, a universally unique identifier, inlined data, a number or an
identifier made of words. The scan is one pass of maps over whole texts; nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import fresh, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Shortest run that is tested, characters per token under which it is random, and characters that are tokenised at once.
LEAST, RATIO, PIECE = 16, 2.0, 512
#: The base patterns, and the kinds in the order in which spans with one start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
#: Hexadecimal digits of the usual digests (MD5, SHA-1, SHA-224 to SHA-512).
DIGESTS = frozenset({32, 40, 56, 64, 96, 128})

RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_INTEGRITY = re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/]+=*")
_BREAK = re.compile(r"[+/_=-]+")
#: A part of an identifier: a number, or words in lower, upper, title or camel case with a short number after them.
_WORDS = re.compile(r"\d+|(?:[A-Z]?[a-z]+|[A-Z]+|(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,5}+)++)\d{0,4}")
SPANS = "array<struct<kind:string,start:long,end:long,ratio:double>>"


def known(run: str, before: str) -> bool:
    """Whether a run is no secret whatever its tokens are; ``before`` is what stands before it."""
    if _HEX.fullmatch(run) and len(run) in DIGESTS or _UUID.fullmatch(run) or _INTEGRITY.fullmatch(run):
        return True
    if before.endswith("base64,"):
        return True
    return all(_WORDS.fullmatch(part) for part in _BREAK.split(run) if part)


class Vocabulary:
    """The tokenizer of a vocabulary file in ranks."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, run: str) -> float:
        """Characters per token; a long run is tokenised in pieces, so that its time grows with its length."""
        pieces = [run[at : at + PIECE] for at in range(0, len(run), PIECE)]
        return len(run) / sum(len(self.encoding.encode_ordinary(p)) for p in pieces)


_vocabularies: dict[str | None, Vocabulary] = {}


def vocabulary(path: str | None) -> Vocabulary:
    """One tokenizer for each worker process and file."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the matches of the base patterns, leftmost first and without overlaps of one kind.

    A match that is too short is dropped after it was found, so what it covers is not searched again.
    """
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def random_spans(text: str, taken: list[tuple[int, int, str]], words: Vocabulary, most: float = RATIO) -> Iterator[tuple[int, int, float]]:
    """(start, end, ratio) of the random runs that no span of ``taken`` covers."""
    starts = sorted(s for s, _, _ in taken)
    ends = list(accumulate((e for _, e, _ in sorted(taken)), max))  # the furthest end of those that start up to here
    for m in RUN.finditer(text):
        run, before = m.group(), bisect_right(starts, m.start())
        if before and ends[before - 1] >= m.end() or known(run, text[max(0, m.start() - 8) : m.start()]):
            continue
        ratio = words.ratio(run)
        if ratio < most:
            yield m.start(), m.end(), ratio


def found_in(text: str | None, words: Vocabulary, most: float = RATIO) -> list[dict]:
    """All spans of a text, by start and then by kind."""
    if not text:
        return []
    base = base_spans(text)
    spans = [(s, KINDS.index(kind), e, None) for s, e, kind in base] + [(s, len(KINDS) - 1, e, r) for s, e, r in random_spans(text, base, words, most)]
    return [{"kind": KINDS[kind], "start": s, "end": e, "ratio": r} for s, kind, e, r in sorted(spans, key=lambda x: x[:3])]


def secret_spans(docs: DataFrame, text_col: str = "text", most: float = RATIO, vocabulary_path: str | None = None) -> DataFrame:
    """``docs`` with the column ``secrets``: an array of (kind, start, end, ratio) over each whole text.

    Start and end are in code points, the end exclusive; kind is assign, access, hex or random, ratio the characters per
    token of random ones. Spans of base kinds always stay; a random run inside one of them is not given again. A null or
    empty text has no spans. Repeated rows and rows with null ids are scanned like any other, other columns stay as they
    are; where ``docs`` has a column ``secrets`` the new one gets underscores before its name. An empty table gives no
    row. ``most`` is the bound of characters per token, ``vocabulary_path`` the vocabulary's file on the executors (None:
    the installed one). A task holds a batch of texts.
    """
    (name,) = fresh(docs, "secrets")
    rows = docs.select("*", F.array().cast(SPANS).alias(name))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(vocabulary_path)
        for batch in slices(batches):
            at = batch.schema.get_field_index(name)
            found = [found_in(t, words, most) for t in batch.column(text_col).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(found, batch.schema.field(at).type))

    return rows.mapInArrow(scan, rows.schema)


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", most: float = RATIO) -> DataFrame:
    """``docs`` with each run of overlapping or touching secrets in a text replaced by ``mask``; null texts stay null."""
    (name,) = fresh(docs, "secrets")
    rows = secret_spans(docs, text_col, most)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, out = batch.schema.get_field_index(text_col), []
            for text, spans in zip(batch.column(text_col).to_pylist(), batch.column(name).to_pylist(), strict=True):
                parts, end = [], 0
                for s in sorted(spans, key=lambda x: x["start"]):
                    if s["start"] > end or not parts:
                        parts += [text[end : s["start"]], mask]
                    end = max(end, s["end"])
                out.append("".join([*parts, text[end:]]) if spans else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return rows.mapInArrow(cut, rows.schema).drop(name)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): counts and digest of the base spans, and all spans as text."""
    rows = secret_spans(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return rows.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"), n("random"))
