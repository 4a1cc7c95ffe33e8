"""License scans: winnowed template fingerprints pick candidates, banded alignment confirms them.

Words are runs of ASCII letters and digits (letters lowered) and of non-ASCII bytes. Templates are whole public
license texts (the files of the folder `licenses`), their headers and notices. The hashes of every KGRAM words
of a template are winnowed: of each WINDOW neighbours the least is a fingerprint, so any run of KGRAM + WINDOW - 1
of its words holds one. A template of under SHORT words has all its pairs of words as fingerprints instead. The
fingerprints are an inverted index (hash -> template, position), a constant of this module, in which every
KGRAM words, and every pair, of a text are looked up. So a template is a candidate wherever 4 of its words
(2 of a short one) stand in a row, as they do if one in five is replaced, dropped or preceded by another.

Hits are gathered by diagonal (place in the text less place in the template), within a quarter of the template's
length or BAND words, whichever is less. A gathering with fewer hits than so many runs would give, or whose
stretch of text holds too few of the template's words, goes; the others are aligned with the template within that distance of their diagonals. Words at the ends go where
that raises the coverage (matched words over those of the template or of the span, whichever are more). What has
MIN_COVERAGE is reported with its matched words, coverage and character span; of overlapping ones the one with
the most matched words, less those of the template and the span that have no partner. An insertion of over
BAND words, or a quarter of the template's, thus ends an alignment.

Each text is scanned by itself, whatever its neighbours in a batch. The scan is a map over whole texts: no
exchange; its work grows with a text's length and its hits. Null and empty texts match nothing. Repeated rows
report alike, and so do repeated notices of a text, each at its place; a null key is reported as such. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from provender.llm.common import chunks
from provender.llm.pretokens import mix, span_hashes

KGRAM, WINDOW, SHORT, BAND, MIN_COVERAGE = 3, 2, 16, 64, 0.8

#: Public license notices and headers.
NOTICES = {
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-2.0-or-later-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}


@cache
def templates() -> dict[str, str]:
    """Notices, headers and whole texts by name."""
    texts = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in files("provender.llm").joinpath("licenses").iterdir() if f.name.endswith(".txt")}
    return NOTICES | dict(sorted(texts.items()))


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_Q = np.random.default_rng(7).integers(0, 1 << 63, KGRAM, np.uint64) << np.uint64(1) | np.uint64(1)


class Words:
    """The words of some texts, as hashes and byte spans; first[k] is the number of text k's first word."""

    def __init__(self, texts: list[str]):
        self.parts = [t.encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"\n".join([*[p.lower() for p in self.parts], b""]), np.uint8)
        edge = np.diff(np.concatenate([[False], _WORD[data], [False]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = span_hashes(data, self.start, self.end)
        self.base = np.append(0, np.cumsum([len(p) + 1 for p in self.parts]))
        self.first = np.searchsorted(self.start, self.base)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of every k words that stand in one text, and the number of the first word of each."""
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n, np.uint64)
        for i in range(k if n else 0):
            out += self.hash[i : i + n] * _Q[i]
        at = np.arange(n)
        at = at[np.searchsorted(self.first, at, side="right") == np.searchsorted(self.first, at + k - 1, side="right")]
        return mix(out[at] + np.uint64(k)), at


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """The places of the least hash of each WINDOW neighbours (of all, if there are fewer)."""
    if len(hashes) <= WINDOW:
        return np.array([int(hashes.argmin())]) if len(hashes) else np.zeros(0, np.int64)
    n = len(hashes) - WINDOW + 1
    return np.unique(np.arange(n) + np.stack([hashes[k : n + k] for k in range(WINDOW)]).argmin(axis=0))


class Index:
    """Sorted fingerprints with their postings (template, place), the templates' word hashes and their names."""

    def __init__(self, named: dict[str, str]):
        self.names, self.words = list(named), [Words([t]).hash for t in named.values()]
        found = []
        for t, text in enumerate(named.values()):
            grams, at = Words([text]).grams(2 if len(self.words[t]) < SHORT else KGRAM)
            picked = np.arange(len(grams)) if len(self.words[t]) < SHORT else winnowed(grams)
            found += [(int(grams[i]), t, int(at[i])) for i in picked.tolist()]
        found.sort()
        every = np.array([f[0] for f in found], np.uint64)
        self.keys, self.begin = np.unique(every, return_index=True)
        self.count = np.diff(np.append(self.begin, len(every)))
        self.template, self.place = (np.array([f[i] for f in found], np.int64) for i in (1, 2))

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each shared fingerprint: the text, the template, and the diagonal."""
        out = [np.zeros((3, 0), np.int64)]
        for k in (2, KGRAM):
            grams, at = words.grams(k)
            key = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[key] == grams)
            n = self.count[key[hit]]
            posting = np.repeat(self.begin[key[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            word = np.repeat(at[hit], n)
            text = np.searchsorted(words.first, word, side="right") - 1
            out.append(np.stack([text, self.template[posting], word - words.first[text] - self.place[posting]]))
        return tuple(np.concatenate(out, axis=1))


@cache
def index() -> Index:
    return Index(templates())


def band_of(length: int) -> int:
    """How far, in words, an alignment with a template of this length may drift."""
    return max(1, min(length // 4, BAND))


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Matched (template word, text word) of a longest monotone alignment in which word j meets text words j + low .. j + high."""
    n, width = len(template), high - low + 1
    best = np.zeros((n + 1, width + 1), np.int32)
    padded = np.zeros(n + width, np.uint64)
    known = np.zeros(n + width, bool)
    a, b = max(0, -low), max(0, min(n + width, len(text) - low))
    padded[a:b], known[a:b] = text[a + low : b + low], True
    for j in range(n):
        same = (padded[j : j + width] == template[j]) & known[j : j + width]
        row = np.maximum(best[j, 1:], best[j, :-1] + same)
        best[j + 1, :-1] = np.maximum.accumulate(row)
    out, j = [], n
    d = int(best[n, :-1].argmax())  # the first place that has them all
    while j > 0 and best[j, d] > 0:
        if known[j - 1 + d] and padded[j - 1 + d] == template[j - 1] and best[j, d] == best[j - 1, d] + 1:
            out.append((j - 1, j - 1 + d + low))
            j -= 1
        elif best[j, d] == best[j - 1, d + 1]:
            j, d = j - 1, d + 1
        else:
            d -= 1
    return out[::-1]


def trimmed(places: np.ndarray, length: int) -> tuple[int, int, float]:
    """The first and last of the matched text words that give the best coverage of a template of that length, and it."""
    n = len(places)
    most = n - max(1, int(np.ceil(MIN_COVERAGE * length))) + 1 if places[-1] - places[0] >= length else 1
    cut = np.arange(max(1, min(most, 256)))
    a, b = np.meshgrid(cut, n - 1 - cut, indexing="ij")
    ok = b >= a
    a, b = a[ok], b[ok]
    coverage = (b - a + 1) / np.maximum(length, places[b] - places[a] + 1)
    at = int(coverage.argmax())
    return int(a[at]), int(b[at]), float(coverage[at])


def matches(texts: list[str], known: Index | None = None) -> list[list[tuple[str, int, float, int, int]]]:
    """Of each text: template, matched words, coverage, and the span's first and one-past-last character."""
    known = known or index()
    words = Words(texts)
    out: list[list[tuple[str, int, float, int, int]]] = [[] for _ in texts]
    text, template, diagonal = known.hits(words)
    order = np.lexsort((diagonal, template, text))
    text, template, diagonal = (c[order].tolist() for c in (text, template, diagonal))
    gathered: list[list[int]] = []
    ends: dict[tuple[int, int], tuple[int, int]] = {}  # where the hits of a text and template stand
    for i, (x, t, d) in enumerate(zip(text, template, diagonal, strict=True)):
        ends[x, t] = ends.get((x, t), (i,))[0], i + 1
        if gathered and gathered[-1][:2] == [x, t] and d - gathered[-1][2] <= band_of(len(known.words[t])):
            gathered[-1][3] = d
        else:
            gathered.append([x, t, d, d])
    found: dict[int, list[tuple]] = {}
    for x, t, first, last in gathered:
        own, wanted = words.hash[words.first[x] : words.first[x + 1]], known.words[t]
        band = band_of(len(wanted))
        low, high = first - band, last + band
        # Four fifths of the words in at most a fifth as many runs: each run of r words has (r - 3) / WINDOW hits at least.
        a, b = ends[x, t]
        if bisect_right(diagonal, high, a, b) - bisect_left(diagonal, low, a, b) < (0.8 - 0.2 * KGRAM) / WINDOW * len(wanted) - 2:
            continue
        # No alignment matches more words than occur in the stretch at all.
        if np.isin(wanted, own[max(0, low) : max(0, high + len(wanted))]).sum() < MIN_COVERAGE * len(wanted):
            continue
        pairs = align(wanted, own, low, high)
        if len(pairs) < MIN_COVERAGE * len(wanted):
            continue
        places = np.array([i for _, i in pairs])
        a, b, coverage = trimmed(places, len(wanted))
        if coverage >= MIN_COVERAGE:
            n, i, j = b - a + 1, int(places[a]), int(places[b])
            found.setdefault(x, []).append((len(wanted) + (j - i + 1) - 3 * n, -coverage, known.names[t], i, j, n))
    for x, candidates in found.items():
        data, base, a = words.parts[x], int(words.base[x]), int(words.first[x])
        chosen: list[tuple] = []
        for c in sorted(candidates):
            if all(c[4] < o[3] or c[3] > o[4] for o in chosen):
                chosen.append(c)
        for _, lost, name, i, j, n in sorted(chosen, key=lambda c: c[3]):
            start, end = (len(data[: int(at) - base].decode("utf-8", "ignore")) for at in (words.start[a + i], words.end[a + j]))
            out[x].append((name, n, -lost, start, end))
    return out


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, template, matched_words, coverage, span_start, span_end: a row for each match."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            rows = [(i, *m) for i, ms in enumerate(matches(texts)) for m in ms]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            keys = batch.column(0).take(pa.array(columns[0], pa.int64()))
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]], ["key", "template", "matched_words", "coverage", "span_start", "span_end"])

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, template string, matched_words int, coverage double, span_start int, span_end int"
    return df.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, schema).withColumnRenamed("key", key)
