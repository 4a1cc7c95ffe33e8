"""Best-fit packing of token sequences by bin completion.

How many pieces there are of each length is all that packing needs, and there are no more lengths than
tokens in a sequence: that histogram, however large the corpus, goes to the driver (at most `capacity`
rows). There a branch and bound fills one sequence after the other around the longest piece left: it
enumerates fillings of the space beside it that no other filling dominates, takes the least wasteful, and
uses a filling as often as the counts allow, so each decision uses up a length. A branch ends when its waste
leaves no way to beat the incumbent (best-fit, then the best solution found), the search when the incumbent
meets the lower bound. Its budgets (NODES looked at for a filling, FILLINGS kept of them, BACKTRACKS to another
filling) grow fourfold, DEEPER times, while it is above the bound; then the incumbent stands, and plan() gives both.

The plan is a table of slots: (length, from rank, copies in a sequence, sequences) with a first sequence and
an offset. Pieces get their rank among those of their length without gathering a length in one task: a hot
length is dealt over salted groups, whose counts are summed up.

A null or empty text is the end id alone. Repeated rows are packed as often as they come. Extra columns are
ignored. An empty table gives an empty result. Null keys are packed like others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provender.llm.common import chunks, mapped, stored
from provender.llm.token_tables import encoder

#: Characters of text that a worker encodes at once.
CHARS = 400_000
#: Groups over which the pieces of one length are dealt when they get their ranks.
SALT = 256
#: The first budgets of the search, and how often they are raised.
NODES, FILLINGS, BACKTRACKS, DEEPER = 400, 4, 40, 2


def pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids, if asked for) of each piece; only texts longer than capacity are cut."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer, end_id)
        for batch, texts in chunks(batches, limit=CHARS):
            keys, at, number, start, length, crc, cut = batch.column(0), [], [], [], [], [], []
            for row, ids in enumerate(library.encode(texts)):
                ids = np.append(ids, library.dtype.type(end_id)).astype("<u4")
                for n, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    at.append(row)
                    number.append(n)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        cut.append(part.astype(np.int32))
            columns = [keys.take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.list_(pa.int32()))] if with_ids else columns, [*names, "ids"] if with_ids else names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return mapped(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text"), run, schema).withColumnRenamed("key", key)


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of b fit into those of a, several into one if need be."""
    if not b:
        return True
    first, rest = b[0], b[1:]
    tried = set()
    for i, x in enumerate(a):
        if x >= first and x not in tried:
            tried.add(x)
            if dominates((*a[:i], x - first, *a[i + 1 :]), rest):
                return True
    return False


def best_fit(counts: np.ndarray, room: int) -> tuple[int, ...]:
    """The filling that always takes the largest item that fits."""
    left, out = {}, []
    while room > 0:
        fits = np.flatnonzero(counts[: room + 1])
        item = next((int(x) for x in fits[::-1] if counts[x] > left.get(int(x), 0)), 0)
        if not item:
            break
        take = min(int(counts[item]) - left.get(item, 0), room // item)
        left[item] = left.get(item, 0) + take
        out += [item] * take
        room -= item * take
    return tuple(out)


def fillings(counts: np.ndarray, room: int, nodes: int = NODES, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated fillings of the room from the items counted, least waste first."""
    if room <= 0:
        return [()]
    if counts[room] > 0:
        return [(room,)]  # dominates every other
    have = counts[: room + 1] > 0
    have[0] = False
    # Two that fill it: the pair with the larger first item.
    other = have[1:room][::-1]
    pairs = np.flatnonzero(have[1:room] & other) + 1
    pairs = pairs[pairs * 2 >= room]
    if len(pairs) and room % 2 == 0 and pairs[0] * 2 == room and counts[room // 2] < 2:
        pairs = pairs[1:]
    found: list[tuple[int, tuple[int, ...]]] = []
    if len(pairs):
        a = int(pairs[-1])
        found.append((0, (a, room - a)))
        if len(pairs) > 1:
            a = int(pairs[0])
            found.append((0, (a, room - a)))
        return [f for _, f in found]
    incumbent = best_fit(counts, room)
    best = room - sum(incumbent)
    found.append((best, incumbent))
    items = np.flatnonzero(have)[::-1]
    budget = nodes

    def go(at: int, left: int, chosen: tuple[int, ...]) -> None:
        nonlocal best, budget
        for i in range(at, len(items)):
            item = int(items[i])
            if item > left:
                continue
            if budget <= 0 or best == 0:
                return
            budget -= 1
            if chosen.count(item) >= counts[item]:
                continue
            rest = left - item
            if rest == 0 or not counts[1 : min(rest, item) + 1].any():
                if rest <= best:
                    best = rest
                    found.append((rest, (*chosen, item)))
                continue
            if rest <= item and counts[rest] > (1 if rest == item else 0) + chosen.count(rest):
                best = 0
                found.append((0, (*chosen, item, rest)))
                return
            go(i, rest, (*chosen, item))

    go(0, room, ())
    found = sorted(set(found), key=lambda x: (x[0], len(x[1]), [-y for y in x[1]]))
    out: list[tuple[int, ...]] = []
    for _, filling in found[: 4 * most]:
        if len(out) < most and not any(len(f) <= 6 and len(filling) <= 6 and dominates(f, filling) for f in out):
            out.append(filling)
    return out


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by tokens, and by pairs of pieces that can't share one."""
    sizes = np.arange(len(counts))
    total, best = int((counts * sizes).sum()), 0
    for k in (0, *np.unique(np.linspace(1, capacity // 2, 64).astype(int)).tolist()):
        large = int(counts[capacity - k + 1 :].sum()) if k else 0
        middle = counts[capacity // 2 + 1 : capacity - k + 1]
        at = sizes[capacity // 2 + 1 : capacity - k + 1]
        small = counts[k : capacity // 2 + 1] * sizes[k : capacity // 2 + 1]
        room = int((middle * (capacity - at)).sum())
        best = max(best, large + int(middle.sum()) + max(0, -(-(int(small.sum()) - room) // capacity)))
    return max(best, -(-total // capacity))


def plan(histogram: dict[int, int], capacity: int = 4096) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Fillings with how often each is used, and the lower bound. Every piece is packed; sequences hold capacity at most."""
    start = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        start[length] = n
    total, bound = int((start * np.arange(capacity + 1)).sum()), lower_bound(start, capacity)
    if not total:
        return [], 0

    def dive(counts: np.ndarray, used: list, bins: int, waste: int, allowed: int, trail: list | None, choice: list[int], scale: int) -> tuple[list, int] | None:
        """Goes down to a whole solution; None once its waste can't be made up for. trail: gets where another choice was open."""
        used = list(used)
        turn = 0
        while len(left := np.flatnonzero(counts)):
            longest = int(left[-1])
            counts[longest] -= 1
            open_ = fillings(counts, capacity - longest, NODES * scale, FILLINGS * scale)
            counts[longest] += 1
            pick = choice[turn] if turn < len(choice) else 0
            if trail is not None and len(open_) > 1 and turn >= len(choice):
                trail.append((turn, len(open_)))
            filling = (longest, *open_[min(pick, len(open_) - 1)])
            turn += 1
            sizes, times = np.unique(filling, return_counts=True)
            n = int((counts[sizes] // times).min())
            counts[sizes] -= times * n
            used.append((filling, n))
            bins += n
            waste += n * (capacity - sum(filling))
            if waste > allowed:
                return None
        return used, bins

    # Best-fit as the first incumbent.
    counts, best, best_bins = start.copy(), [], 0
    while len(left := np.flatnonzero(counts)):
        longest = int(left[-1])
        counts[longest] -= 1
        filling = (longest, *best_fit(counts, capacity - longest))
        counts[longest] += 1
        sizes, times = np.unique(filling, return_counts=True)
        n = int((counts[sizes] // times).min())
        counts[sizes] -= times * n
        best.append((filling, n))
        best_bins += n
    for scale in (4**k for k in range(DEEPER + 1)):
        if best_bins <= bound:
            break
        trail: list = []
        if found := dive(start.copy(), [], 0, 0, (best_bins - 1) * capacity - total, trail, [], scale):
            best, best_bins = found
        # Other choices, the last ones first: late decisions are where waste arises.
        for turn, n in reversed(trail[-BACKTRACKS * scale :]):
            if best_bins <= bound:
                break
            for pick in range(1, n):
                if found := dive(start.copy(), [], 0, 0, (best_bins - 1) * capacity - total, None, [0] * turn + [pick], scale):
                    best, best_bins = found
    return best, bound


def slots(fill: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as columns, in order of (length, from_rank). At most as many rows as decisions times distinct lengths in a sequence."""
    rows, used, sequence = [], {}, 0
    for filling, n in fill:
        offset = 0
        sizes, times = np.unique(filling, return_counts=True)
        for length, copies in zip(sizes.tolist(), times.tolist(), strict=True):
            rows.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * n
            offset += copies * length
        sequence += n
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "from_rank", "copies", "sequence", "offset"), columns, strict=True))


def ranked(df: DataFrame, key: str) -> DataFrame:
    """Adds rank, from 0 without gaps within each length."""
    salted = df.withColumn("salt", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(SALT)).cast("int"))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy(key, "piece", "start", "ids_crc32")
    return salted.withColumn("own", F.row_number().over(own) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own"))


def pack(cut: DataFrame, capacity: int = 4096, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (key, piece, start, length, ids_crc32), which is read twice."""
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    table = slots(plan(histogram, capacity)[0])
    wide = (1 << 62) // (capacity + 1)
    starts = table["length"] * wide + table["from_rank"] if table["length"].size else np.zeros(0, np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            slot = np.searchsorted(starts, length * wide + rank, side="right") - 1
            ahead = rank - table["from_rank"][slot]
            copies = table["copies"][slot]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("key", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(table["sequence"][slot] + ahead // copies), pa.array(table["offset"][slot] + ahead % copies * length)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = ranked(cut, key).select(F.col(key).alias("key"), "piece", "start", "length", "ids_crc32", "rank")
    kind = cut.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return mapped(rows, run, schema).withColumnRenamed("key", key)


def pack_documents(df: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cuts, encodes and packs documents: key, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(pieces(df, tokenizer, end_id, capacity, key, text), "pieces"), capacity, key)
