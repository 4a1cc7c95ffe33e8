"""Byte-level BPE encoding and decoding.

Pre-tokens come from class arrays and an associative scan (pretokens.py); each distinct one is merged pair
by pair once and kept. Encoding keeps the byte offset of every token, so that spans of the text can be cut
out and decoded. The work is a map over the rows: no shuffle, whole texts, bounded chunks.

A null or empty text has no tokens and decodes to nothing. Extra columns of the input are ignored by the
digests and are no hindrance to encode(), which returns its key column, ids and offsets only. Repeated rows
give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from provender.llm.common import chunks
from provender.llm.pretokens import RankEncoder

_ENCODERS: dict[str, RankEncoder] = {}


def encoder(path: str) -> RankEncoder:
    """This process's encoder for a rank file; the file is read where the work is done."""
    if path not in _ENCODERS:
        _ENCODERS[path] = RankEncoder(path)
    return _ENCODERS[path]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>, byte_offsets array<int> (where each token's bytes begin in the UTF-8 text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch, texts in chunks(batches):
            ids = bpe.encode(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids), _lists([bpe.decode(i)[1] for i in ids])], ["key", "ids", "byte_offsets"])

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, f"key {kind}, ids array<int>, byte_offsets array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, decoded binary: the bytes of the ids (null: none)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            out = [bpe.decode(np.array(x.as_py() or [], np.int64))[0] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` AS key", f"`{ids}` AS ids").mapInArrow(run, f"key {kind}, decoded binary").withColumnRenamed("key", key)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """encode() and decode() in one pass: key, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        decimal = [str(i) for i in range(len(bpe.bytes_of))]
        for batch, texts in chunks(batches):
            n, named, decoded = [], [], []
            for ids in bpe.encode(texts):
                n.append(len(ids))
                named.append(hashlib.sha256(",".join([decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)[0]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(named), pa.array(decoded)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.selectExpr(f"`{key}` AS key", f"`{text}` AS text")
    return rows.mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
