"""Token-id output as sorted-string-table shards, and their reader.

A shard is a file: data blocks, a sparse block index, a Bloom filter and a fixed-size footer. Keys are
document identifiers in an order-preserving binary form; within a block, a key is stored as the length it
shares with the one before it and the rest. Look-up is: Bloom filter, binary search in the block index,
scan of one block.

    block   := crc32 u32, zstd( n u32, n * (shared u8, rest u8, n_ids u32), key rests, ids )
    index   := n u32, n * (offset u64, length u32, tokens before u64, key length u8, last key)
    bloom   := bits
    footer  := index offset u64, index length u64, bloom offset u64, bloom length u64, documents u64,
               tokens u64, part u32, number in part u32, id width u8, 6 zero bytes, b"PVSST01\\n"

Shards are written by Spark's own file writer, under its commit protocol, to any file system Spark knows: a
shard is one record of the text format, whose final line break is the last byte of the footer. A lost
executor's task is run again, and only committed files count. Documents reach the shards through one range
exchange on the key, so shards in order of (part, number in part) are in ascending order of keys.

A null or empty text holds the end id alone. A null key sorts first, as the empty key. Repeated keys stay,
beside each other; get() returns the first. An empty table gives no shard and no row.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provender.llm.common import chunks, new_path, stored
from provender.llm.pretokens import LibraryEncoder

MAGIC = b"PVSST01\n"
_FOOTER = struct.Struct("<QQQQQQIIB6x8s")
_HEAD = struct.Struct("<BBI")
_INDEX = struct.Struct("<QIQB")
#: Ids in a block, and bytes of blocks in a shard, before the next one is begun.
BLOCK_IDS = 1 << 16
SHARD_BYTES = 6 << 20
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7

_ENCODERS: dict[tuple, LibraryEncoder] = {}


def encoder(path: str, end_id: int) -> LibraryEncoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = LibraryEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def key_bytes(key: int | None) -> bytes:
    return b"" if key is None else struct.pack(">Q", key + (1 << 63))


def key_value(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Builds the bytes of one shard from documents in ascending order of keys."""

    def __init__(self, part: int, number: int, dtype: np.dtype):
        self.part, self.number, self.dtype = part, number, dtype
        self.blocks: list[bytes] = []
        self.index: list[tuple[int, int, int, bytes]] = []
        self.keys: list[bytes] = []
        self.size = self.tokens = self.before = 0
        self.rows: list[tuple[bytes, np.ndarray]] = []
        self.held = 0
        self.compressor = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        self.rows.append((key, ids))
        self.keys.append(key)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            self._end_block()

    def _end_block(self) -> None:
        if not self.rows:
            return
        heads, rests, previous = [], [], b""
        for key, ids in self.rows:
            shared = next((i for i, (x, y) in enumerate(zip(key, previous, strict=False)) if x != y), min(len(key), len(previous)))
            heads.append(_HEAD.pack(shared, len(key) - shared, len(ids)))
            rests.append(key[shared:])
            previous = key
        raw = b"".join([struct.pack("<I", len(self.rows)), *heads, *rests, *[ids.astype(self.dtype).tobytes() for _, ids in self.rows]])
        packed = self.compressor.compress(raw)
        block = struct.pack("<I", zlib.crc32(packed)) + packed
        self.index.append((self.size, len(block), self.before, previous))
        self.blocks.append(block)
        self.size += len(block)
        self.before += self.held
        self.rows, self.held = [], 0

    def finish(self) -> bytes:
        self._end_block()
        index = struct.pack("<I", len(self.index)) + b"".join(_INDEX.pack(o, n, t, len(k)) + k for o, n, t, k in self.index)
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        held = struct.pack("<Q", bits) + bloom.tobytes()
        footer = _FOOTER.pack(self.size, len(index), self.size + len(index), len(held), len(self.keys), self.before, self.part, self.number, self.dtype.itemsize, MAGIC)
        return b"".join([*self.blocks, index, held, footer])


class Reader:
    """Reads one shard."""

    def __init__(self, data: bytes):
        self.data = data
        index_at, index_n, bloom_at, bloom_n, self.documents, self.tokens, self.part, self.number, width, magic = _FOOTER.unpack(data[-_FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.dtype = np.dtype(f"<u{width}")
        at, end = index_at + 4, index_at + index_n
        self.index = []
        while at < end:
            offset, length, before, n = _INDEX.unpack_from(data, at)
            at += _INDEX.size
            self.index.append((offset, length, before, data[at : at + n]))
            at += n
        self.last_keys = [x[3] for x in self.index]
        self.bits = struct.unpack_from("<Q", data, bloom_at)[0] if bloom_n else 0
        self.bloom = data[bloom_at + 8 : bloom_at + bloom_n]

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def block(self, number: int) -> Iterator[tuple[bytes, np.ndarray, int]]:
        """key, ids and ids of the shard before them, of each document of a block."""
        offset, length, before, _ = self.index[number]
        packed = self.data[offset + 4 : offset + length]
        if zlib.crc32(packed) != struct.unpack_from("<I", self.data, offset)[0]:
            raise ValueError(f"block {number} is damaged")
        raw = zstandard.ZstdDecompressor().decompress(packed)
        (n,) = struct.unpack_from("<I", raw)
        heads = [_HEAD.unpack_from(raw, 4 + i * _HEAD.size) for i in range(n)]
        at, key, keys = 4 + n * _HEAD.size, b"", []
        for shared, rest, _ in heads:
            key = key[:shared] + raw[at : at + rest]
            keys.append(key)
            at += rest
        ids, i = np.frombuffer(raw, self.dtype, offset=at), 0
        for key, (_, _, count) in zip(keys, heads, strict=True):
            yield key, ids[i : i + count], before + i
            i += count

    def scan(self) -> Iterator[tuple[bytes, np.ndarray, int]]:
        for number in range(len(self.index)):
            yield from self.block(number)

    def get(self, key: int | None) -> np.ndarray | None:
        """The ids of a document, by Bloom filter, block index and one block; None if it isn't here."""
        wanted = key_bytes(key)
        if not self.index or not self.may_hold(wanted):
            return None
        number = bisect.bisect_left(self.last_keys, wanted)
        return next((ids for k, ids, _ in self.block(number) if k == wanted), None) if number < len(self.index) else None


def write(df: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encodes the texts, each with end_id after it, and writes shards in ascending order of keys to the folder `path`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part, number, shard = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0, None
        end = np.array([end_id], library.dtype)
        for batch, texts in chunks(batches):
            for k, ids in zip(batch.column(0).to_pylist(), library.encode(texts), strict=True):
                shard = shard or Writer(part, number, library.dtype)
                shard.add(key_bytes(k), np.concatenate([ids, end]))
                if shard.size >= SHARD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([shard.finish()[:-1]], pa.binary())], ["data"])
                    number, shard = number + 1, None
        if shard:
            yield pa.RecordBatch.from_arrays([pa.array([shard.finish()[:-1]], pa.binary())], ["data"])

    rows = df.selectExpr(f"CAST(`{key}` AS BIGINT) AS key", f"`{text}` AS text")
    shards = rows.repartitionByRange("key").sortWithinPartitions("key", "text").mapInArrow(run, "data binary")
    # The writer adds the line break that ends the footer.
    shards.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, number, key, start (ids of the shard before it), n_tokens, ids, from the files."""
    return _scan(spark, path, "ids array<int>", lambda ids: pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))


def _scan(spark: SparkSession, path: str, column: str, make) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                shard = Reader(value.as_py())
                for number in range(len(shard.index)):
                    rows = list(shard.block(number))
                    ids = [r[1] for r in rows]
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard.part] * n, pa.int32()), pa.array([shard.number] * n, pa.int32()), pa.array([key_value(r[0]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([len(i) for i in ids], pa.int64()), make(ids)],
                        ["part", "number", "key", "start", "n_tokens", column.split(" ")[0]],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, f"part int, number int, key bigint, start bigint, n_tokens bigint, {column}")


def digests(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards, reads them back: key, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = df.sparkSession
    path = new_path(spark, "shards")
    write(df, path, tokenizer, end_id, key, text)
    crc = lambda ids: pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())
    rows = stored(_scan(spark, path, "ids_crc32 bigint", crc), "shard-rows")
    # Sums of shards within their part; across parts, a row for each part.
    sums = stored(rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n")), "shard-sums")
    before = lambda w, *order: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window, "part")), F.lit(0)).alias("ahead"))
    own = F.coalesce(F.sum("n").over(before(Window.partitionBy("part"), "number")), F.lit(0))
    bases = sums.select("part", "number", own.alias("own")).join(parts, "part").select("part", "number", (F.col("ahead") + F.col("own")).alias("base"))
    return rows.join(bases, ["part", "number"]).select(F.col("key").alias(key), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
