"""Licence scans: Dice coefficient over word bigrams against licence templates.

A segment is a whole text, one of its lines, or a passage: any run of neighbouring words, over line ends too.
Normalised, it is its runs of ASCII letters and digits in lower case; its bigrams are all its pairs of neighbouring
words, repeats counted. A segment matches a template when 2 * common / (bigrams of both) is at least ``LEAST``. That
bounds the sizes: with s and t bigrams the coefficient is at most 2 * min(s, t) / (s + t), so a segment is compared
only with templates whose size lies within [s * LEAST / (2 - LEAST), s * (2 - LEAST) / LEAST]. It also bounds what
is common from below, by t * LEAST / (2 - LEAST): a document in which no stretch of the largest size holds so many
of a template's bigrams has no matching segment of any kind, and nothing of it is compared.

Defined results: one row per document and licence found, with the best coefficient of the whole text and the lines,
the number of matching lines and whether the whole text matches; a licence that neither shows has the best
coefficient of its passages, no line and no whole text. Null and empty texts and texts without a match have no row;
repeated rows have rows each; an empty table gives an empty result; other columns of the input are ignored. A very long
text is one row's work, in memory proportional to it. The SQL twin knows whole texts and lines only.
"""

from __future__ import annotations

import math
import pkgutil
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import slices, text_bytes
from ._store import read_table

LEAST = 0.8


def _full(name: str) -> str:
    return pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode()


_BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_CLOSING = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
)

# The wording of public licences and of their customary notices.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("ISC", _ISC),
    (
        "ISC",
        _ISC + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-2-Clause", _BSD_OPENING + _BSD_CLOSING),
    ("BSD-3-Clause", _BSD_OPENING + _BSD_NAMES + _BSD_CLOSING),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
        "rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ),
    ("Apache-2.0", _full("Apache-2.0")),
    ("CC0-1.0", _full("CC0-1.0")),
    ("GPL-2.0", _full("GPL-2")),
    ("GPL-3.0", _full("GPL-3")),
    ("LGPL-2.1", _full("LGPL-2.1")),
    ("LGPL-3.0", _full("LGPL-3")),
    ("MPL-2.0", _full("MPL-2.0")),
]

_FOLD = np.full(256, 0x20, np.uint8)
for _c in range(128):
    if chr(_c).isalnum():
        _FOLD[_c] = ord(chr(_c).lower())
_NEWLINE = 0x0A


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


# Hashes only choose what is compared: unlike words with one hash cost a comparison, nothing else.
_SPREAD = np.random.default_rng(9).integers(0, 1 << 63, (64, 256), np.uint64) * 2 + 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hashes(fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``fold`` begins, and the hash of each pair of neighbours."""
    solid = np.flatnonzero(fold != 0x20)
    if not len(solid):
        return solid, np.empty(0, np.uint64)
    first = np.flatnonzero(np.diff(solid, prepend=-2) > 1)
    begin = solid[first]
    place = solid - np.repeat(begin, np.diff(first, append=len(solid)))
    word = np.add.reduceat(_SPREAD[place & 63, fold[solid]], first)
    return begin, (word[:-1] * _FACTOR) ^ word[1:]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], least: float):
        self.least = least
        self.templates = []
        pairs = []
        for name, text in templates:
            fold = _FOLD[np.frombuffer(text.encode(), np.uint8)]
            words = fold.tobytes().split()
            if len(words) > 1:
                self.templates.append((name, bigrams(words), len(words) - 1))
                pairs.append(np.unique(_hashes(fold)[1]))
        self.known = np.unique(np.concatenate(pairs))
        self.among = np.zeros(1 << 16, bool)
        self.among[self.known >> np.uint64(48)] = True
        self.has = np.stack([np.isin(self.known, own) for own in pairs])

    def possible(self, data: np.ndarray, row_begin: np.ndarray) -> dict[int, list[int]]:
        """Templates that a segment of each row can match; rows are folded, with a space before each."""
        begin, pair = _hashes(data)
        row = np.searchsorted(row_begin, begin, side="right") - 1
        at = np.flatnonzero(self.among[pair >> np.uint64(48)] & (row[:-1] == row[1:])) if len(pair) else np.empty(0, np.int64)
        which = np.minimum(np.searchsorted(self.known, pair[at]), len(self.known) - 1)
        sure = self.known[which] == pair[at]
        at, which, row = at[sure], which[sure], row[at[sure]]
        out: dict[int, list[int]] = {}
        for t, (_, _, n) in enumerate(self.templates):
            own = np.flatnonzero(self.has[t][which])
            few, long = self.common_least(n), self.size_most(n)
            a, b = own[: max(0, len(own) - few + 1)], own[few - 1 :]
            for k in np.unique(row[a][(at[b] - at[a] < long) & (row[a] == row[b])]).tolist():
                out.setdefault(k, []).append(t)
        return out

    def common_least(self, n: int) -> int:
        return max(1, math.ceil(n * self.least / (2 - self.least) - 1e-9))

    def size_most(self, n: int) -> int:
        return math.floor(n * (2 - self.least) / self.least + 1e-9)

    def matches(self, words: list[bytes], among: list[int]) -> list[tuple[str, float]]:
        own, size, out = None, len(words) - 1, []
        for name, grams, n in (self.templates[t] for t in among):
            if size >= 1 and 2 * min(size, n) >= self.least * (size + n):
                own = own or bigrams(words)
                score = 2 * sum((own & grams).values()) / (size + n)
                if score >= self.least:
                    out.append((name, score))
        return out

    def passage(self, words: list[bytes], t: int) -> float:
        """The best coefficient of any run of ``words`` with template ``t``; 0 where none reaches the least.

        The best run begins and ends with a bigram of the template: without its other ends it is better still."""
        _, grams, n = self.templates[t]
        local = {g: k for k, g in enumerate(grams)}
        cap = np.array(list(grams.values()))
        found = [(k, local[g]) for k, g in enumerate(zip(words, words[1:], strict=False)) if g in local]
        at, gram = np.array(found, np.int64).reshape(-1, 2).T
        seen, turn = np.zeros(len(cap), np.int64), np.empty(len(at), np.int64)
        for k, g in enumerate(gram.tolist()):  # the how-manieth of its kind
            turn[k] = seen[g]
            seen[g] += 1
        few, best = self.common_least(n), 0.0
        stop = np.searchsorted(at, at + self.size_most(n))
        gone = np.zeros(len(cap), np.int64)
        for k, end in enumerate(stop.tolist()):
            most = end - k
            if most >= few and 2 * most / (most + n) > best:
                common = np.cumsum(turn[k:end] - gone[gram[k:end]] < cap[gram[k:end]])
                best = max(best, float(np.max(2 * common / (at[k:end] - at[k] + 1 + n))))
                if best == 1.0:
                    break
            gone[gram[k]] += 1
        return best if best >= self.least else 0.0


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, licence, score, lines, whole) of every licence found in ``docs`` (doc_id, text)."""
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        scanner = Scanner(templates, least)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows = []
            ids = batch.column(0).to_pylist()
            for a, b in slices(offsets):
                base, stop = int(offsets[a]), int(offsets[b])
                raw = data[base:stop]
                fold = _FOLD[raw]
                bounds = offsets[a : b + 1] - base
                for k, among in sorted(scanner.possible(_apart(fold, bounds), bounds[:-1] + np.arange(b - a)).items()):
                    found: dict[str, list] = {}
                    text, breaks = fold[bounds[k] : bounds[k + 1]].tobytes(), np.flatnonzero(raw[bounds[k] : bounds[k + 1]] == _NEWLINE).tolist()
                    for i, j in zip([0, *(x + 1 for x in breaks)], [*breaks, len(text)], strict=True):
                        best: dict[str, float] = {}
                        for name, score in scanner.matches(text[i:j].split(), among):
                            best[name] = max(score, best.get(name, 0))
                        for name, score in best.items():
                            own = found.setdefault(name, [0.0, 0, False])
                            own[0], own[1] = max(own[0], score), own[1] + 1
                    words = text.split()
                    for name, score in scanner.matches(words, among):
                        own = found.setdefault(name, [0.0, 0, False])
                        own[0], own[2] = max(own[0], score), True
                    shown = set(found)
                    for t in among:
                        name = scanner.templates[t][0]
                        if name not in shown and (score := scanner.passage(words, t)):
                            own = found.setdefault(name, [0.0, 0, False])
                            own[0] = max(own[0], score)
                    rows += [(ids[a + k], name, *own) for name, own in sorted(found.items())]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["doc_id", "licence", "score", "lines", "whole"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, licence string, score double, lines long, whole boolean")


def _apart(fold: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The rows with one space before each, so that no word reaches from one row into the next."""
    out = np.full(len(fold) + len(bounds) - 1, 0x20, np.uint8)
    size = np.diff(bounds)
    out[np.arange(len(fold)) + np.repeat(np.arange(1, len(bounds)), size)] = fold
    return out


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quoted = ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(TEMPLATES))
    words = "string_split(trim(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
        WITH segments AS (
            SELECT doc_id, row_number() OVER () AS r, 0 AS line, text AS s FROM documents
            UNION ALL
            SELECT doc_id, r, line, unnest(string_split(text, chr(10))) AS s FROM
                (SELECT doc_id, text, row_number() OVER () AS r, 1 AS line FROM documents)
        ), worded AS (
            SELECT doc_id, r, line, {words.format("s")} AS w FROM segments
        ), templates(t, licence, body) AS (VALUES {quoted}),
        shapes AS (
            SELECT t, licence, len(w) - 1 AS n, {pairs} AS grams FROM
                (SELECT t, licence, {words.format("body")} AS w FROM templates)
        ), close AS (
            SELECT doc_id, r, line, row_number() OVER () AS seg, t, licence, n, grams, len(w) - 1 AS size, w
            FROM worded JOIN shapes ON 2 * least(len(w) - 1, n) >= {LEAST} * (len(w) - 1 + n) AND len(w) >= 2
        ), pooled AS (
            SELECT seg, g, sum(a) AS a, sum(b) AS b FROM (
                SELECT seg, unnest({pairs}) AS g, 1 AS a, 0 AS b FROM close
                UNION ALL
                SELECT seg, unnest(grams) AS g, 0 AS a, 1 AS b FROM close
            ) GROUP BY seg, g
        ), scored AS (
            SELECT seg, sum(least(a, b)) AS common FROM pooled GROUP BY seg
        ), matched AS (
            SELECT doc_id, r, line, licence, w, max(2 * common::DOUBLE / (size + n)) AS score
            FROM close JOIN scored USING (seg) WHERE 2 * common::DOUBLE / (size + n) >= {LEAST}
            GROUP BY doc_id, r, line, licence, w, seg, t
        )
        SELECT doc_id, licence, max(score) AS score, sum(line)::BIGINT AS lines, bool_or(line = 0) AS whole
        FROM matched GROUP BY doc_id, r, licence
    """


QUERIES = {"op9_licences": op9_licences}
ORACLES = {"op9_licences": _oracle()}
