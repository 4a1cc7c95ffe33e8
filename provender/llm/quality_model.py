"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed on arrays over many texts at once. The trees are trained on the
driver, on at most TRAIN_ROWS labelled documents (those with the smallest hash of their identifier), which is
the only sample taken; the model is some kilobytes of flat arrays, walked down by all rows at once, level by
level. Scoring is a map over the rows: no exchange.

A null or empty text is scored as one without characters. Without labels of both kinds every score is the
share of label 1 (0.5 without any). A label that is null is not used; a document with several labels counts
with each. A null identifier is scored, and not held out. Repeated rows score alike. Extra columns are
ignored by scores(). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.llm.common import chunks, mapped
from provender.llm.near_dup import _WHITE
from provender.llm.pretokens import LETTER, NUMBER, classes, span_hashes

TRAIN_ROWS = 12_000
#: Characters of text whose statistics a worker computes at once.
CHARS = 400_000
BINS, DEPTH, TREES, RATE, LEAST, L2 = 48, 4, 60, 0.2, 20, 2.0
THRESHOLD = 0.3
FEATURES = ("log_chars", "letters", "upper", "digits", "white", "symbols", "bangs", "other", "non_ascii", "line_rate", "word_length", "log_words", "distinct_words", "top_word", "distinct_lines", "distinct_grams", "longest_word")


def statistics(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    n = np.array([len(t) for t in texts])
    first = np.cumsum(n + 1) - n - 1
    kind = classes()[code]
    white = (code < 33) & _WHITE[np.minimum(code, 255)]

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), first)

    chars = np.maximum(n, 1)
    letters, numbers = kind == LETTER, kind == NUMBER
    symbols = np.isin(code, [ord(c) for c in "#*$%&|<>@{}[]\\^~_=+"])
    bangs = np.isin(code, [33, 63])
    out[:, 0] = np.log1p(n)
    out[:, 1] = total(letters) / chars
    out[:, 2] = total((code >= 65) & (code <= 90) | (code >= 0xC0) & (code <= 0xDE)) / np.maximum(total(letters), 1)
    out[:, 3] = total(numbers) / chars
    out[:, 4] = (total(white) - 1) / chars
    out[:, 5] = total(symbols) / chars
    out[:, 6] = total(bangs) / chars
    out[:, 7] = total(~(letters | numbers | white | symbols | bangs)) / chars
    out[:, 8] = total(code > 127) / chars
    out[:, 9] = (total(code == 10) - 1) / chars
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = span_hashes(code, start, end)
    at = np.append(np.searchsorted(start, first), len(start))
    breaks = np.flatnonzero(code == 10)
    line_start = np.append(0, breaks[:-1] + 1) if len(breaks) else np.zeros(0, np.int64)
    line = span_hashes(code, line_start, breaks)
    line_at = np.append(np.searchsorted(line_start, first), len(line_start))
    gram = word[:-2] * np.uint64(3) + word[1:-1] * np.uint64(5) + word[2:] * np.uint64(7) if len(word) > 2 else word[:0]
    length = end - start
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b <= a:
            continue
        _, times = np.unique(word[a:b], return_counts=True)
        out[i, 10] = length[a:b].mean()
        out[i, 11] = np.log1p(b - a)
        out[i, 12] = len(times) / (b - a)
        out[i, 13] = times.max() / (b - a)
        out[i, 14] = len(np.unique(line[line_at[i] : line_at[i + 1]])) / (line_at[i + 1] - line_at[i])
        out[i, 15] = len(np.unique(gram[a : b - 2])) / (b - a - 2) if b - a > 2 else 1
        out[i, 16] = np.log1p(length[a:b].max())
    return out


@dataclass
class Trees:
    """All trees in flat arrays: node i sends a row to 2 * i + 1 or, above the threshold, 2 * i + 2 (per tree); leaves are level DEPTH."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        inner, leaves = 2**DEPTH - 1, 2**DEPTH
        trees = len(self.value) // leaves
        rows = np.arange(len(x))[:, None]
        tree = np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(DEPTH):
            flat = tree * inner + node
            node = 2 * node + 1 + (x[rows, self.feature[flat]] > self.threshold[flat])
        raw = self.base + self.value[tree * leaves + node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, quantile histograms, trees of fixed depth whose empty splits send every row left."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    base = np.log(share / (1 - share))
    empty = Trees(base, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    if not len(y) or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    raw = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            own = node - first
            gains = np.zeros(n)
            for f in range(x.shape[1]):
                size = len(edges[f]) + 1
                if size < 2:
                    continue
                flat = own * size + binned[:, f]
                gs, hs, cs = (np.bincount(flat, w, n * size).reshape(n, size).cumsum(axis=1) for w in (g, h, np.ones(len(y))))
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(cs < LEAST) | (ct - cs < LEAST)] = 0
                gain = gain[:, :-1]
                at = gain.argmax(axis=1)
                top = gain[np.arange(n), at]
                better = top > gains + 1e-9
                gains[better] = top[better]
                feature[first : first + n][better] = f
                threshold[first : first + n][better] = edges[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - (2**DEPTH - 1)
        gs, hs = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
        value = -RATE * gs / (hs + L2)
        raw += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, np.concatenate(features), np.concatenate(thresholds), np.concatenate(values))


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """Trains on at most TRAIN_ROWS labelled documents that are not held out."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    chosen = usable.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("k"), "k", "y").limit(TRAIN_ROWS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, limit=CHARS):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(statistics(texts)), pa.list_(pa.float64()))], ["k", "y", "x"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").select("k", "text", "y")
    kind = rows.schema["k"].dataType.simpleString()
    # Repeated identifiers make more rows of one label; these, too, are TRAIN_ROWS at most.
    found = mapped(rows, run, f"k {kind}, y int, x array<double>").orderBy(F.xxhash64("k"), "k", "y", "x").limit(TRAIN_ROWS).collect()
    found.sort(key=lambda r: (r.k, r.y, r.x))
    return train(np.array([r.x for r in found]).reshape(-1, len(FEATURES)), np.array([r.y for r in found], float))


def scored(df: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, limit=CHARS):
            score = model.score(statistics(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["key", "held_out", "score", "predicted"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), held_out(key).alias("held_out"))
    return mapped(rows, run, f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def accepted(df: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """The rows that the model doesn't reject, with their columns as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text, CHARS):
            yield batch.filter(pa.array(model.score(statistics(texts)) >= THRESHOLD))

    return mapped(df, run, df.schema)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))
