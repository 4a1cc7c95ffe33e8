"""Encoding, token tables and packing against the public tokenizer libraries and brute force."""

import base64
import hashlib
import itertools
import os
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from provender.llm import byte_bpe, packing, pretokens, token_tables
from provender.llm.catalogue import tokenizer_path
from provender.llm.common import BATCH_BYTES, chunks, new_path
from provender.llm.pretokens import LibraryEncoder, RankEncoder, monoid, states

public = pytest.importorskip("public_tokenizers")
RANKS, BYTES, WORDS = (tokenizer_path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))


def texts(n=3000):
    rng = random.Random(5)
    alphabet = list(" \n\t  　abEsltmvd''1.,é#") + ["Σ", "İ", "²", "日", "٣", "\U0001f600", "́", "\x85", "\x1c"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16))) for _ in range(n)] + ["", "a" * 5000, "!" * 999, " " * 300 + "x"]


def reference():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_scan_equals_stepping():
    rng = np.random.default_rng(1)
    for grammar in ("spaced", "spaceless"):
        kinds = rng.integers(0, 10, 5000).astype(np.uint8)
        apply, state, want = monoid(grammar)[1], 0, []
        for k in kinds.tolist():
            want.append(state)
            state = int(apply[k, state])
        assert states(kinds, grammar).tolist() == want


def test_ranks_equal_library():
    own, library = RankEncoder(RANKS), reference()
    every = texts()
    for text, ids in zip(every, own.encode(every), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert own.decode(ids)[0] == text.encode()


def regular(n):
    """A regular word and its complement: polynomial hashes modulo 2^64 take them for one."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return [word, word.translate(str.maketrans("ab", "ba"))]


def test_tokens_are_told_apart_by_content(monkeypatch):
    pair = [*regular(1024), *regular(2048)]
    every = [" ".join(pair), pair[1], "one two one", ""]
    library = reference()

    def check():
        for text, ids in zip(every, RankEncoder(RANKS).encode(every), strict=True):
            assert ids.tolist() == library.encode_ordinary(text)
        for path in (BYTES, WORDS):
            own = LibraryEncoder(path)
            for ids, want in zip(own.encode(every), own.tokenizer.encode_batch(every, add_special_tokens=False), strict=True):
                assert ids.tolist() == want.ids

    check()
    # A hash that takes all tokens for one changes nothing.
    monkeypatch.setattr(pretokens, "span_hashes", lambda v, a, b: np.full(len(a), 7, np.uint64))
    check()


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_cached_equals_library(path):
    own = LibraryEncoder(path)
    every = texts()
    for text, ids, want in zip(every, own.encode(every), own.tokenizer.encode_batch(every, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, text


class Spelling(pretokens.Encoder):
    """A token's ids are its codepoints; it counts what it is asked to make."""

    dtype, asked = np.dtype("<u4"), 0

    def make(self, tokens):
        self.asked += len(tokens)
        return [t.encode("utf-32-le") for t in tokens]


def test_cache_holds_the_tokens_of_many_texts():
    own = Spelling()
    every = [" ".join(format(i, "x").translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(k, k + 100_000)) for k in range(0, 400_000, 100_000)]
    for text in every * 2:
        assert "".join(map(chr, own.encode([text])[0].tolist())) == text
    assert own.asked < 400_010


@pytest.mark.parametrize("limit", [2, 30, 400])
def test_full_cache(limit):
    """Tokens that go, come back, find no room or are long."""
    rng = random.Random(limit)
    own, library = Spelling(), LibraryEncoder(BYTES)
    for encoder in (own, library):
        encoder.kept = pretokens.Kept(encoder.dtype, limit)
    for _ in range(60):
        every = ["".join(rng.choice([" ", "a", "bc", "é", "1", "\n", "d" * 50]) for _ in range(rng.randint(0, 90))) for _ in range(4)]
        assert ["".join(map(chr, ids.tolist())) for ids in own.encode(every)] == every
        assert [ids.tolist() for ids in library.encode(every)] == [e.ids for e in library.tokenizer.encode_batch(every, add_special_tokens=False)]
        assert own.kept.n <= limit and library.kept.n <= limit


def test_digests(odd_docs, no_docs):
    library = reference()
    rows = byte_bpe.digests(odd_docs, RANKS).collect()
    want = []
    for r in odd_docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert byte_bpe.digests(no_docs, RANKS).count() == 0
    encoded = byte_bpe.encode(odd_docs, RANKS)
    decoded = {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.decode(encoded, RANKS).collect()}
    assert decoded == {r.doc_id: r.text or "" for r in odd_docs.collect()}
    one = next(r for r in encoded.collect() if r.doc_id == 1)
    assert one.byte_offsets[0] == 0 and one.byte_offsets == sorted(one.byte_offsets)


def test_token_tables(spark, odd_docs, no_docs):
    library = LibraryEncoder(BYTES)
    docs = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start, want = 0, []
    for r in docs:
        ids = [*library.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_tables.digests(odd_docs, BYTES, 2).collect()), key=str) == sorted(want, key=str)
    assert token_tables.digests(no_docs, BYTES, 2).count() == 0
    path = new_path(spark, "shards")
    token_tables.write(odd_docs, path, BYTES, 2)
    rows = {r.key: r.ids for r in token_tables.read(spark, path).collect()}
    assert rows[3] == [2] and rows[None][-1] == 2


def test_shard_lookup():
    writer = token_tables.Writer(0, 0, np.dtype("<u2"))
    rng = np.random.default_rng(0)
    docs = {k: rng.integers(0, 50000, int(rng.integers(0, 9000))) for k in range(-50, 500, 3)}
    for k, ids in docs.items():
        writer.add(token_tables.key_bytes(k), ids)
    data = writer.finish()
    reader = token_tables.Reader(data)
    assert len(reader.index) > 3 and data.endswith(b"\n")
    for k in range(-60, 510):
        got = reader.get(k)
        assert (got is None) == (k not in docs) and (got is None or got.tolist() == docs[k].tolist())
    damaged = bytearray(data)
    damaged[10] ^= 1
    with pytest.raises(ValueError):
        list(token_tables.Reader(bytes(damaged)).scan())


def check_plan(histogram, capacity, fill):
    used: dict[int, int] = {}
    for filling, n in fill:
        assert sum(filling) <= capacity and n > 0
        for x in filling:
            used[x] = used.get(x, 0) + n
    assert used == {k: v for k, v in histogram.items() if v}


def least_bins(items, capacity):
    """Brute force: the fewest bins, by subsets."""
    n = len(items)
    sums = [sum(items[i] for i in range(n) if m >> i & 1) for m in range(1 << n)]
    best = [99] * (1 << n)
    best[0] = 0
    for m in range(1, 1 << n):
        low, sub = m & -m, m
        while sub:
            if sub & low and sums[sub] <= capacity:
                best[m] = min(best[m], best[m ^ sub] + 1)
            sub = (sub - 1) & m
    return best[-1]


def test_plan_small_is_optimal():
    rng = random.Random(2)
    for _ in range(25):
        items = [rng.randint(1, 20) for _ in range(9)]
        histogram = {x: items.count(x) for x in items}
        fill, bound = packing.plan(histogram, 20)
        check_plan(histogram, 20, fill)
        bins = sum(n for _, n in fill)
        assert bound <= least_bins(items, 20) == bins


def test_plan_large():
    rng = random.Random(3)
    histogram: dict[int, int] = {}
    for _ in range(4000):
        x = min(4096, int(rng.lognormvariate(6, 1.2)) + 1)
        histogram[x] = histogram.get(x, 0) + 1
    histogram[4096] = histogram.get(4096, 0) + 100_000
    fill, bound = packing.plan(histogram, 4096)
    check_plan(histogram, 4096, fill)
    assert sum(n for _, n in fill) <= bound + 1
    assert packing.plan({}, 4096) == ([], 0)
    assert packing.dominates((5,), (3, 2)) and not packing.dominates((4, 1), (5,))


def test_packing(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, WORDS, 1, 64).collect()
    library = LibraryEncoder(WORDS)
    want = []
    for r in odd_docs.collect():
        ids = [*library.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want += [(r.doc_id, i, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for i, a in enumerate(range(0, len(ids), 64))]
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack_documents(no_docs, WORDS, 1).count() == 0


def test_packing_takes_bounded_batches(spark, monkeypatch):
    """Rows of 30 MB in one partition come by batches of BATCH_BYTES, but for the row that passes it."""

    def watched(batches, **options):
        for batch in batches:
            assert batch.nbytes <= BATCH_BYTES + 20_000, batch.nbytes
            yield from chunks([batch], **options)

    monkeypatch.setattr(packing, "chunks", watched)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 909) AS text")
    found = packing.pieces(docs, WORDS, 1).selectExpr("count(DISTINCT doc_id) AS n", "sum(length) AS tokens").first()
    assert (found.n, found.tokens) == (3000, 3000 * (2 * 909 + 1))


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory is read from /proc")
def test_chunks_give_memory_back():
    """What a task's arrays took is no longer the worker's, though a few that stay lie between them."""

    def mb() -> float:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    for _ in chunks([pa.RecordBatch.from_pydict({"text": ["x"]})]):
        arrays = [np.ones(8192) for _ in range(2000)]
        stay, most = arrays[::50], mb()
        del arrays
    assert len(stay) == 40 and most - mb() > 100
