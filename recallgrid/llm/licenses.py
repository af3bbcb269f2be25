"""License scans: winnowed fingerprints pick candidate templates, banded alignment measures them.

Each template's words are fingerprinted by winnowing: of each window of consecutive word-gram hashes the smallest is kept, so
any shared run of WINDOW + GRAM - 1 words is sure to share a fingerprint. The fingerprints of all templates form an
inverted index, a small table of a size that the templates bound. A document's word grams that hit it vote for
(template, diagonal); around neighbouring voted diagonals a banded alignment of words gives the matched words, the coverage of
the template and the span in the document.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import mix, word_hashes

GRAM, WINDOW, BAND = 3, 4, 8
#: Coverage of a template from which on it is reported.
LEAST = 0.8
_WORD = re.compile(r"[^\W_]+")

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Notices, as their licences ask for them (fixed values).
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "LGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "BSD-line": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "BSD-2-Clause": f"{_BSD} {_AS_IS}",
    "BSD-3-Clause": (
        f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        f"from this software without specific prior written permission. {_AS_IS}"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
}


def words_of(text: str | None) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Lower-cased runs of letters and digits, and their places in the text."""
    found = list(_WORD.finditer(text or ""))
    return [m[0].lower().encode("utf-8", "surrogatepass") for m in found], [m.span() for m in found]


def grams(hashes: np.ndarray) -> np.ndarray:
    """A hash for each run of GRAM words, or for the whole of fewer."""
    n = max(1, min(GRAM, len(hashes)))
    out = np.full(max(0, len(hashes) - n + 1), np.uint64(n))
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k])
    return out


def winnowed(values: np.ndarray) -> np.ndarray:
    """Places of the smallest value of each window, the last of equal ones; short lists have smaller windows."""
    if not len(values):
        return np.zeros(0, np.int64)
    n = max(1, min(WINDOW, len(values) // 2))
    windows = np.lib.stride_tricks.sliding_window_view(values, n)[:, ::-1]
    return np.unique(np.arange(len(windows)) + n - 1 - windows.argmin(axis=1))


class Index:
    """Fingerprints of the templates: hash to (template, place)."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.hashes = [word_hashes(words_of(templates[n])[0]) for n in self.names]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, hashes in enumerate(self.hashes):
            values = grams(hashes)
            for at in winnowed(values).tolist():
                self.places[int(values[at])].append((t, at))
        self.keys = np.array(sorted(self.places), np.uint64)

    def matches(self, hashes: np.ndarray, least: float) -> list[tuple[str, int, float, int, int]]:
        """(template, matched words, coverage, first word, end word) of the document's matches; of overlapping ones the best."""
        values = grams(hashes)
        if not len(values) or not len(self.keys):
            return []
        at = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[at] == values)  # template prints that stand anywhere, a superset of winnowed ones
        diagonals: dict[int, set[int]] = defaultdict(set)
        for place in hits.tolist():
            for template, own in self.places[int(values[place])]:
                diagonals[template].add(place - own)
        found = []
        for template, votes in diagonals.items():
            size = len(self.hashes[template])
            slack = max(1, min(BAND, size // 4))  # how far words may be shifted around a voted diagonal
            low = high = None
            for d in [*sorted(votes), None]:
                if low is not None and (d is None or d - high > slack or d - low > 4 * BAND):
                    m = self._aligned(template, hashes, low - slack, high + slack + 1)
                    if m and m[0] >= least * size:
                        found.append((self.names[template], m[0], m[0] / size, m[1], m[2]))
                    low = None
                low, high = (d if low is None else low), d
        found.sort(key=lambda m: (-m[1], -m[2], m[3], m[0]))
        out: list[tuple[str, int, float, int, int]] = []
        for m in found:
            at = bisect_left(out, m[3], key=lambda o: o[3])  # those taken don't overlap, so only its neighbours can
            if (at == 0 or out[at - 1][4] <= m[3]) and (at == len(out) or m[4] <= out[at][3]):
                out.insert(at, m)
        return out

    def _aligned(self, template: int, hashes: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
        """(matched words, first, end) of the longest common subsequence on diagonals low to high of the document."""
        own = self.hashes[template]
        width = high - low
        best = np.zeros(width + 1, np.int64)
        first = np.full(width + 1, -1, np.int64)
        end = np.full(width + 1, -1, np.int64)
        for i, word in enumerate(own):
            places = i + low + np.arange(width)
            inside = (places >= 0) & (places < len(hashes))
            same = np.zeros(width, bool)
            same[inside] = hashes[places[inside]] == word
            # A cell's diagonal keeps its index from word to word; one to the right is the same place without this word.
            up, up_first, up_end = best[1:], first[1:], end[1:]
            score = np.where(same, best[:-1] + 1, up)
            start = np.where(same & (best[:-1] == 0), places, np.where(same, first[:-1], up_first))
            stop = np.where(same, places + 1, up_end)
            for k in range(1, width):  # the place to the left in this row
                if score[k - 1] > score[k] or (score[k - 1] == score[k] and start[k - 1] > start[k]):
                    score[k], start[k], stop[k] = score[k - 1], start[k - 1], stop[k - 1]
            best[:-1], first[:-1], end[:-1] = score, start, stop
            best[-1], first[-1], end[-1] = 0, -1, -1
        k = int(np.lexsort((end - first, -best))[0])
        return (int(best[k]), int(first[k]), int(end[k])) if best[k] else None


MATCHES = "array<struct<template:string,matched_words:int,coverage:double,start:int,end:int>>"


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, n_matches, matches) for each row: template, matched words, coverage of the template, span in code points.

    Matches of a document don't overlap; of those that would, the one with more matched words stays. A null or empty
    text, and one without a template, has none. Templates are a dictionary of names and texts, whose index goes along
    with the tasks, so it must be small; a template without words never matches. Repeated rows each get their row.
    """
    index = Index(TEMPLATES if templates is None else templates)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words, spans = words_of(text)
                found = index.matches(word_hashes(words), least)
                out.append([{"template": t, "matched_words": n, "coverage": c, "start": spans[i][0], "end": spans[j - 1][1]} for t, n, c, i, j in found])
            kind = pa.list_(pa.struct([("template", pa.string()), ("matched_words", pa.int32()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in out], pa.int64()), pa.array(out, kind)], [id_col, "n_matches", "matches"])

    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_matches long, matches {MATCHES}"
    return rows.mapInArrow(scanned, schema)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_matches, license, coverage, start, end): the match of each document with the most matched words."""
    best = F.array_sort("matches", lambda a, b: F.when(a["matched_words"] == b["matched_words"], a["start"] - b["start"]).otherwise(b["matched_words"] - a["matched_words"]))
    found = licenses(docs).withColumn("best", F.get(best, F.lit(0)))
    return found.select("doc_id", "n_matches", F.col("best.template").alias("license"), F.col("best.coverage").alias("coverage"), F.col("best.start").alias("start"), F.col("best.end").alias("end"))


def every_match(docs: DataFrame) -> DataFrame:
    """(doc_id, n_matches, license, matched_words, coverage, start, end): a row for each match, and one with nulls for none."""
    found = licenses(docs).select("doc_id", "n_matches", F.explode_outer("matches").alias("m"))
    return found.select("doc_id", "n_matches", F.col("m.template").alias("license"), "m.matched_words", "m.coverage", "m.start", "m.end")
