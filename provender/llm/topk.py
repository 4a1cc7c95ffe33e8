"""Exact top-k inner products over an impact-ordered index, score at a time.

Components become integers floor(256 x). Rows are dealt once into shards of about ROWS rows (by hash, so a
common vector is no hot group), a record of a written table each. Queries go to the shards in blocks of about
BLOCK_BYTES, and a shard is indexed once for a block: a posting segment holds the rows whose component of one
dimension lies in one quantised band. A query takes segments by descending quantised impact (the most that a
segment adds to a score), adding each segment's least contribution to its rows. What the segments not yet
taken, and the width of bands, could add at most is known; once only few rows can still be among the best by
that bound, they are rescored with exact integer inner products. Shards return their k best, ties to the
smaller identifier, and a window the overall ones. The work grows with rows times queries; blocks beyond the
first read the shards again and move nothing.

The index holds vectors whose components are at most NARROW (that is, 4096 before they become integers): no sum
of their products loses a bit. Pairs with another vector are scored one by one with integers of any size; their
order is exact, and a score beyond 64 bits is given as the nearest long.

Vectors that are null or hold null or non-finite components, and those without identifier, take no part. Rows
with the query's identifier are its own; rows that repeat an identifier each ask and answer. Shorter vectors
count as padded with zeros. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender.llm.common import stored

ROWS, BANDS = 8192, 32
#: Bytes of the queries that are sent to all executors at once.
BLOCK_BYTES = 32 << 20
#: Components, and numbers of them, of which 64-bit and double sums of products are exact.
NARROW, NARROW_DIMS = 1 << 20, 1 << 12
#: A round takes the segments of at least this share of the largest impact; the last one takes the rest.
ROUNDS = (0.5, 0.3, 0.2, 0.12, 0.06, 0.02, 0.0)
#: Rows that may still be among the best at which the search ends and rescores.
RESCORE = 256


class Impacts:
    """Posting segments of some vectors: dimension by dimension, in bands of equal width."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, dims = vectors.shape
        low = vectors.min(axis=0)
        width = np.maximum(1, -(-(vectors.max(axis=0) - low + 1) // BANDS))
        band = (vectors - low) // width
        self.rows = np.argsort(band, axis=0, kind="stable").T.ravel()  # of each dimension, by band
        sizes = np.stack([np.bincount(band[:, d], minlength=BANDS) for d in range(dims)])
        self.length = sizes.ravel()
        self.offset = (np.arange(dims)[:, None] * n + np.cumsum(sizes, axis=1) - sizes).ravel()
        self.low = (low[:, None] + np.arange(BANDS) * width[:, None]).astype(np.int64)
        self.high = self.low + width[:, None] - 1
        self.exists = sizes > 0

    def best(self, query: np.ndarray, k: int, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows whose id is not `own`, ties to the smaller id."""
        n, dims = self.vectors.shape
        ends = query[:, None] * self.low, query[:, None] * self.high
        least, most = np.minimum(*ends), np.maximum(*ends)
        floor = np.where(self.exists, least, np.iinfo(np.int64).max).min(axis=1)
        gain = np.where(self.exists, least - floor[:, None], 0)  # what a segment adds for certain
        impact = np.where(self.exists, most - floor[:, None], 0)  # and at most
        blur = np.where(self.exists, most - least, 0).max(axis=1)
        flat_gain, flat_impact = gain.ravel(), impact.ravel()
        order = np.argsort(-flat_impact, kind="stable")
        order = order[self.length[order] > 0]
        steps = flat_impact[order]
        score = np.zeros(n)
        others = ids != own
        wanted = min(k, int(others.sum()))
        if not wanted:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, members = 0, np.flatnonzero(others)
        for share in ROUNDS:
            upto = int(np.searchsorted(-steps, -share * steps[0], side="right")) if share else len(order)
            if upto > done:
                taken = order[done:upto]
                n_rows = self.length[taken]
                index = np.repeat(self.offset[taken] - np.cumsum(n_rows) + n_rows, n_rows) + np.arange(n_rows.sum())
                score += np.bincount(self.rows[index], np.repeat(flat_gain[taken], n_rows), n)
                done = upto
            rest = np.zeros(dims, np.int64)
            np.maximum.at(rest, order[done:] // BANDS, steps[done:])
            slack = np.maximum(rest, blur).sum()  # no row gets more than this besides its score so far
            own_score = np.where(others, score, -np.inf)
            bar = np.partition(own_score, n - wanted)[n - wanted]
            members = np.flatnonzero(others & (score + slack >= bar))
            if len(members) <= RESCORE:
                break
        exact = self.vectors[members] @ query
        top = np.lexsort((ids[members], -exact))[:wanted]
        return members[top], exact[top]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors as rows of doubles, shorter ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy().astype(np.int64)
    n = np.diff(at)
    out = np.zeros((len(n), dims))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(at[0], at[-1]) - np.repeat(at[:-1], n)] = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    return out


def _split(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 x) of each component as integers, and of which rows sums of products are exact that way."""
    with np.errstate(over="ignore"):
        whole = np.floor(vectors * 256)
    narrow = (np.abs(whole) <= NARROW).all(axis=1) if vectors.shape[1] <= NARROW_DIMS else np.zeros(len(vectors), bool)
    return np.where(narrow[:, None], whole, 0).astype(np.int64), narrow


def _exact(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) as Python integers."""
    return np.array([[math.floor(Fraction(x) * 256) for x in row] for row in vectors.tolist()], object).reshape(vectors.shape)


def sortable(score: int) -> str:
    """A string that sorts as the integer does."""
    digits = f"{abs(score):x}"
    return f"1{len(digits):04d}{digits}" if score >= 0 else f"0{9999 - len(digits):04d}{digits.translate(_INVERTED)}"


_INVERTED = str.maketrans("0123456789abcdef", "fedcba9876543210")


def best_of_shard(ids: np.ndarray, raw: np.ndarray, asking: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(number of the query, id, score): the k best rows of the shard for each query."""
    vectors, narrow = _split(raw)
    whole, simple = _split(queries)
    wide = np.flatnonzero(~narrow)
    index = Impacts(vectors[narrow]) if narrow.any() else None
    own_ids, wide_rows, every = ids[narrow], _exact(raw[wide]), None
    for q, own in enumerate(asking.tolist()):
        found: list[tuple[int, int]] = []
        if simple[q]:
            if index is not None:
                places, scores = index.best(whole[q], k, own_ids, own)
                found = list(zip((-scores).tolist(), own_ids[places].tolist(), strict=True))
            rows, names = wide_rows, ids[wide]
        else:
            every = _exact(raw) if every is None else every
            rows, names = every, ids
        if len(rows):
            asked = _exact(queries[q : q + 1])[0]
            found += [(-sum(map(mul, row, asked)), name) for row, name in zip(rows.tolist(), names.tolist(), strict=True) if name != own]
        for score, name in heapq.nsmallest(k, found):
            yield q, name, -score


def search(df: DataFrame, query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, <key>, score for the rows for which `query` holds, against all rows."""
    spark = df.sparkSession
    finite = F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = df.filter(F.col(key).isNotNull()).filter(finite).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("asks"))
    rows, asked, dims = usable.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first()
    dims = max(1, dims or 0)

    def build(group: pa.Table) -> pa.Table:
        ids, vectors = group.column("id").to_numpy(), _matrix(group.column("v"), dims)
        return pa.table({"ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([vectors.astype("<f8").tobytes()], pa.binary())})

    # Each row moves once, to its shard.
    shards = usable.select(F.pmod(F.xxhash64("id", "v"), F.lit(max(1, math.ceil(rows / ROWS)))).alias("shard"), "id", "v")
    shards = stored(shards.groupBy("shard").applyInArrow(build, "ids binary, vectors binary"), "shards")

    blocks = max(1, math.ceil(asked * dims * 8 / BLOCK_BYTES))
    found = None
    for b in range(blocks):
        asking = usable.filter("asks").filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "v").toArrow()  # about BLOCK_BYTES
        block = spark.sparkContext.broadcast((asking.column("id").to_numpy(), _matrix(asking.column("v"), dims) if len(asking) else np.zeros((0, dims))))

        def score(batches: Iterable[pa.RecordBatch], block=block, b=b) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids = np.frombuffer(batch.column(0)[i].as_py(), "<i8")
                    raw = np.frombuffer(batch.column(1)[i].as_py(), "<f8").reshape(-1, dims)
                    best = list(best_of_shard(ids, raw, *block.value, k))
                    q, names, scores = zip(*best, strict=True) if best else ((), (), ())
                    columns = [pa.array(block.value[0][list(q)] if q else [], pa.int64()), pa.array(q, pa.int64()), pa.array(names, pa.int64())]
                    columns += [pa.array([max(-(1 << 63), min(s, (1 << 63) - 1)) for s in scores], pa.int64()), pa.array(map(sortable, scores), pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "nth", "id", "score", "place"])

        part = stored(shards.mapInArrow(score, "query_id bigint, nth bigint, id bigint, score bigint, place string"), "best")
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id", "nth").orderBy(F.desc("place"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) WHERE rank <= 5
"""
