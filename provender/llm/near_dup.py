"""Near-duplicate classes by a chosen-path set similarity join.

A document is the set of its distinct 5-word shingles (with fewer words, the whole sequence as one). Its
sketch is the minimum of each of many hash functions over the set. A tree's root sends a document down the
path chosen by one function, to the node of those with the same minimum there; a node chooses its functions
by its own path, so all its documents are sent on alike. Independent trees are repeated so that a pair at
the threshold shares no node with a probability below 1e-5.

Nodes are not paired blindly. First each document is compared with the smallest one of its node, and what
is confirmed is connected; only nodes in which several components still meet go on. Those of a few documents
are paired across components. A larger one branches if that pays: if the pairs within the children that its
chosen functions make are at most a PAYS-th of its own. Otherwise, and at the last level, it is compared
in blocks, on full sets: documents outside the block's largest component against all, at the first tree that
compares the two, and one link to each other component is emitted. Every link is confirmed on the shingles of the texts.

Same word sequences collapse first (by a 128-bit digest), so copies are never paired. Links and labels stay
distributed: connected components alternate large-star and small-star rounds over written tables.

Null and empty texts, and texts without words, are linked with nothing. Rows that repeat an identifier are one
document with several texts: it is linked with whatever one of them is linked with. first_of_class(), which
removes rows, takes unlike texts of an identifier as documents of their own, so no text is lost. A null
identifier is linked with nothing: its component is null and it is kept. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender.llm.common import HOT, Stored, chunks, few, made, mapped, release, remove_made_since, stored
from provender.llm.pretokens import equal_spans, mix, span_hashes

#: Functions of a sketch; trees (the first functions); functions that a node chooses; levels below the roots.
SKETCH, TREES, BRANCHES, LEVELS = 64, 10, 4, 3
#: Agreeing functions from which a pair is looked at: at the threshold 48 of 64 agree on average, with a deviation of 3.5.
AGREE = 32
#: Documents of a node that are paired at once, of a block, and of a node that may branch; shingles of a block.
SMALL, BLOCK, WIDE, MASS = 24, 2048, 192, 600_000
#: Characters of text whose shingles a worker makes at once.
CHARS = 300_000
#: A node branches if its children have at most one in PAYS of its pairs.
PAYS = 4

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, SKETCH, np.uint64) << np.uint64(1) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, SKETCH, np.uint64)
_Q = _rng.integers(0, 1 << 63, 5, np.uint64) << np.uint64(1) | np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def words_of(text: str | None) -> list[bytes]:
    """Words between white space of ASCII, A-Z lowered; bytes.lower and bytes.split know no other letters and spaces."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], k: int = 5) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def shingle_hashes(texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
    """The distinct 64-bit shingle hashes of each text, and how many distinct shingles it has: equal hashes are compared by their words."""
    parts = [t.encode().lower() for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    white = _WHITE[data]
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = span_hashes(data, start, end)
    first = np.append(0, np.searchsorted(start, np.cumsum([len(p) + 1 for p in parts])))
    rolled = np.zeros(max(0, len(word) - 4), np.uint64)
    for k in range(5):
        rolled += word[k : k + len(rolled)] * _Q[k]
    rolled = mix(rolled)
    out, twins = [], []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= 5:
            order = np.argsort(rolled[a : b - 4], kind="stable") + a
            ordered = rolled[order]
            fresh = np.append(True, ordered[1:] != ordered[:-1])
            twins.append(np.stack([order[:-1][~fresh[1:]], order[1:][~fresh[1:]]]))
            out.append(ordered[fresh])
        else:
            out.append(mix(np.array([(word[a:b] * _Q[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)) if b > a else np.zeros(0, np.uint64))
    counts = list(map(len, out))
    x, y = np.concatenate(twins, axis=1) if twins else np.zeros((2, 0), np.int64)
    length = end - start
    bad = np.zeros(len(x), bool)
    for k in range(5 if len(x) else 0):
        same = length[x + k] == length[y + k]
        same[same] = equal_spans(data, start[x + k][same], start[y + k][same], length[x + k][same])
        bad |= ~same
    for i in np.unique(np.searchsorted(first, x[bad], side="right") - 1).tolist():
        counts[i] = len(shingles(words_of(texts[i])))
    return out, counts


def sketch(hashes: np.ndarray) -> np.ndarray:
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 8192):
        least = np.minimum(least, ((hashes[None, a : a + 8192] * _A[:, None]) ^ _B[:, None]).min(axis=1))
    return (least >> np.uint64(20)).astype(np.uint32).view(np.int32)


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (shingles), digest of the words, sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, limit=CHARS):
            sets, counts = shingle_hashes(texts)
            digest = [hashlib.blake2b(b" ".join(words_of(t)), digest_size=16).digest() for t in texts]
            sketches = pa.array([sketch(s) if len(s) else np.zeros(0, np.int32) for s in sets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digest, pa.binary()), sketches], ["id", "n", "digest", "sketch"])

    rows = df.selectExpr(f"CAST(`{key}` AS BIGINT) AS id", f"`{text}` AS text")
    return mapped(rows, run, "id bigint, n bigint, digest binary, sketch array<int>")


def agreeing(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs a < b whose sizes allow the similarity and whose sketches agree enough."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("asketch"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("bsketch"))
    both = pairs.join(left, "a").join(right, "b")
    fits = 100 * F.least("an", "bn") >= 75 * F.greatest("an", "bn")
    return both.filter(fits).filter(agreeing("asketch", "bsketch") >= AGREE).select("a", "b").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that share enough shingles, on their texts; pairs is a written table."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = stored(docs.join(F.broadcast(ids) if few(ids) else ids, "id", "left_semi"), "texts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[str, set]] = {}

        def of(number: int, text: str) -> set:
            if number not in held or held[number][0] != text:
                while len(held) >= 16:
                    held.pop(next(iter(held)))
                held[number] = (text, shingles(words_of(text)))
            return held[number][1]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                s, t = of(x, batch.column(2)[i].as_py()), of(y, batch.column(3)[i].as_py())
                both = len(s & t)
                good.append(100 * both >= 75 * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))
        release()

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("btext")), "b")
    with_a = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("atext")), "a")
    return mapped(with_a.select("a", "b", "atext", "btext"), run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """id, comp (the smallest id reachable) for every id of the edges a, b. Nothing is collected."""
    now = Stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = None
    while True:
        # Large star: each neighbour above u is linked with the smallest of u and its neighbours.
        two = now.df.union(now.df.select("b", "a"))
        least = two.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = two.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = Stored(large.filter("a <> b").distinct(), "links")
        # Small star: u and its neighbours below are linked with the smallest of them.
        least = large.df.groupBy("a").agg(F.min("b").alias("m"))
        small = large.df.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        then = Stored(small.filter("a <> b").distinct(), "links")
        sums = then.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        now.drop()
        large.drop()
        now = then
        if (state := (sums.n, sums.h)) == seen:
            break
        seen = state
    return now.df.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(now.df.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "id", "left").select("node", "tree", "id", "n", F.coalesce("comp", "id").alias("comp"))


def _hot(rows: DataFrame) -> DataFrame | None:
    """The nodes of HOT rows or more, if there are any and so few that they can be named; their number is bounded by the rows over HOT."""
    hot = rows.groupBy("node").agg(F.count("*").alias("size")).filter(F.col("size") >= HOT).select("node")
    if hot.isEmpty():
        return None
    hot = stored(hot, "hot")
    return hot if few(hot) else None


def _open(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The rows of nodes in which several components meet, with the node's documents (size) and shingles (mass). Those of hot nodes aren't gathered."""
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("mass"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    nodes = nodes.filter("low <> high").select("node", "size", "mass")
    if hot is None:
        return rows.join(nodes, "node")
    others = rows.join(F.broadcast(hot), "node", "left_anti").join(nodes, "node")
    return rows.join(F.broadcast(nodes.join(F.broadcast(hot), "node", "left_semi")), "node").select(*others.columns).union(others)


def _pairs(rows: DataFrame) -> DataFrame:
    """All pairs across components, of nodes of at most SMALL documents."""
    groups = rows.groupBy("node").agg(F.collect_list(F.struct("id", "comp")).alias("m"))
    pairs = F.expr("flatten(transform(m, x -> transform(filter(m, y -> y.id > x.id AND y.comp <> x.comp), y -> struct(x.id AS a, y.id AS b))))")
    return groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def _set_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, hashes (of its shingles) of the documents named."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, limit=CHARS):
            hashes = [h.view(np.int64) for h in shingle_hashes(texts)[0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64()))], ["id", "hashes"])

    return mapped(docs.join(F.broadcast(ids) if few(ids) else ids, "id", "left_semi"), run, "id bigint, hashes array<bigint>")


def linked_in_block(ids: np.ndarray, comp: np.ndarray, trees: np.ndarray, whole: np.ndarray, sets: tuple[np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Of each document of left outside the commonest component: a link to each other component of right, if there is one.

    trees: the first sketch values; two that agree in a tree before this one were compared there, if that root didn't branch (whole). sets: all shingle numbers, and where each document's begin.
    """
    values, at = sets
    size = np.diff(at)
    names, times = np.unique(comp[np.concatenate([left, right])], return_counts=True)
    giant = names[times.argmax()]
    marked = np.zeros(int(values.max()) + 1 if len(values) else 1, np.int8)
    out = []
    for i in left[comp[left] != giant].tolist():
        near = right[(comp[right] != comp[i]) & (100 * np.minimum(size[right], size[i]) >= 75 * np.maximum(size[right], size[i]))]
        if trees.shape[1]:
            near = near[~((trees[near] == trees[i]) & whole[i]).any(axis=1)]
        if not len(near):
            continue
        own = values[at[i] : at[i + 1]]
        marked[own] = 1
        n = size[near]
        first = np.cumsum(n) - n
        both = np.add.reduceat(marked[values[np.repeat(at[near] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
        marked[own] = 0
        near = near[100 * both >= 75 * (n + size[i] - both)]
        for j in near[np.unique(comp[near], return_index=True)[1]].tolist():
            out.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
    return out


def _blocks(rows: DataFrame, reps: DataFrame, docs: DataFrame, branched: DataFrame | None) -> DataFrame:
    """Links across components in nodes of any size: blocks against blocks, on full sets of shingle hashes. branched: id, trees (bits) whose roots branched."""
    sized = rows.withColumn("parts", F.greatest(F.ceil(F.col("size") / F.lit(BLOCK)), F.ceil(F.col("mass") / F.lit(MASS))).cast("int"))
    sized = sized.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.expr("transform(sequence(0, parts - 1), o -> struct(least(part, o) AS p, greatest(part, o) AS q))")
    facts = reps.select("id", F.slice("sketch", 1, TREES).alias("least")).join(_set_table(docs, rows.select("id").distinct()), "id")
    facts = facts.withColumn("bits", F.lit(0)) if branched is None else facts.join(branched, "id", "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    dealt = sized.join(facts, "id").withColumn("cell", F.explode(other)).select("node", "tree", "cell.p", "cell.q", "part", "id", "comp", "least", "bits", "hashes")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, comp, part, bits = (group.column(c).to_numpy() for c in ("id", "comp", "part", "bits"))
        p, q, tree = (group.column(c)[0].as_py() for c in ("p", "q", "tree"))
        trees = np.stack(group.column("least").to_numpy())[:, :tree]
        whole = (bits[:, None] >> np.arange(tree)) & 1 == 0
        column = pa.concat_arrays(group.column("hashes").chunks)
        at = column.offsets.to_numpy().astype(np.int64)
        values = np.unique(column.values.to_numpy()[at[0] : at[-1]], return_inverse=True)[1]
        at -= at[0]
        left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
        found = linked_in_block(ids, comp, trees, whole, (values, at), left, right)
        if p != q:
            found += linked_in_block(ids, comp, trees, whole, (values, at), right, left)
        a, b = zip(*set(found), strict=True) if found else ((), ())
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("node", "p", "q").applyInArrow(run, "a bigint, b bigint").distinct()


def _children(wide: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of nodes sent on by the functions that each node chooses (with the node they come from), and the nodes for which that pays."""
    chosen = F.array(*[F.pmod(F.xxhash64("node", F.lit(j)), F.lit(SKETCH)).cast("int") for j in range(BRANCHES)])
    sent = wide.join(reps.select("id", "sketch"), "id").withColumn("f", F.explode(F.array_distinct(chosen)))
    sent = sent.select(F.col("node").alias("parent"), "size", "tree", F.xxhash64("node", "f", F.col("sketch")[F.col("f")]).alias("node"), "id", "n", "comp")
    sent = stored(sent, "children")
    pairs = sent.groupBy("parent", "size", "node").agg(F.count("*").alias("m"))
    pays = pairs.groupBy("parent", "size").agg(F.sum(F.col("m") * F.col("m")).alias("after")).filter(F.col("after") * PAYS <= F.col("size") * F.col("size"))
    return sent, stored(pays.select(F.col("parent").alias("node"), "size"), "branching")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept of each row."""
    before = made()
    docs = df.selectExpr(f"CAST(`{key}` AS BIGINT) AS id", f"`{text}` AS text")
    signed = stored(signatures(df, key, text), "signatures")
    sets = signed.filter("n > 0 AND id IS NOT NULL")
    firsts = sets.groupBy("digest").agg(F.min("id").alias("id"))
    reps = stored(sets.join(firsts, ["digest", "id"], "left_semi").select("id", "n", "sketch"), "representatives")

    roots = reps.select("id", "n", F.posexplode(F.slice("sketch", 1, TREES)).alias("tree", "least"))
    roots = roots.select(F.xxhash64("tree", "least").alias("node"), "tree", "id", "n")
    # First each document of a node against the smallest one.
    pivots = roots.groupBy("node").agg(F.min("id").alias("a"), F.max("id").alias("high")).filter("a <> high").select("node", "a")
    shared = Stored(roots.join(pivots, "node").select("node", "tree", "id", "n", "a"), "nodes")
    star = stored(likely(shared.df.filter("id <> a").select("a", F.col("id").alias("b")).distinct(), reps), "star")
    links = stored(confirmed(star, docs), "confirmed")
    comps = stored(components(links), "components")

    # Then what the stars left open.
    rows = stored(_open(_labelled(shared.df.select("node", "tree", "id", "n"), comps), _hot(shared.df)), "open")
    shared.drop()
    pairs, blocks, branched = _pairs(rows.filter(F.col("size") <= SMALL)), [], None
    for level in range(LEVELS + 1):
        middle = rows.filter(F.col("size") > SMALL)
        wide = rows.filter(F.col("size") > WIDE)
        if level == LEVELS or wide.isEmpty():
            pays = None
        else:
            sent, pays = _children(wide, reps)
            if pays.isEmpty():
                pays = None
            else:
                named = pays.select("node")
                named = F.broadcast(named) if few(pays) else named
                middle = middle.join(named, "node", "left_anti")
                going = sent.join(named.withColumnRenamed("node", "parent"), "parent", "left_semi")
                if level == 0:
                    # Pairs of a root that branches may be missed there, so no later tree leaves them to it.
                    bits = wide.join(named, "node", "left_semi").groupBy("id").agg(F.bit_or(F.expr("shiftleft(1, tree)")).alias("bits"))
                    branched = stored(bits, "branched")
        if not middle.isEmpty():
            blocks.append(_blocks(middle, reps, docs, branched))
        if pays is None:
            break
        # Below the roots, nodes of different trees and functions are told apart by their hashes alone.
        going = going.select("node", F.lit(0).alias("tree"), "id", "n", "comp").distinct()
        rows = stored(_open(going, _hot(going)), "open")
        pairs = pairs.union(_pairs(rows.filter(F.col("size") <= SMALL)))
    found = likely(pairs.distinct(), reps)
    for block in blocks:
        found = found.union(block)
    rest = stored(found.distinct(), "rest")
    late = None if rest.isEmpty() else stored(confirmed(rest, docs), "confirmed")
    # The texts of a repeated identifier belong together.
    several = signed.filter("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("id")
    if not several.isEmpty():
        own = sets.join(several, "id", "left_semi").select("id", "digest").distinct().join(firsts.withColumnRenamed("id", "rep"), "digest")
        own = own.select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()
        late = own if late is None else late.union(own)
    if late is not None and not late.isEmpty():
        comps = stored(components(links.union(late)), "components")
    remove_made_since(df.sparkSession, before, signed, comps)

    label = firsts.select("digest", F.col("id").alias("rep")).join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("class"))
    found = signed.select("id", "n", "digest").join(label, "digest", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.least("class", "id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _told_apart(rows: DataFrame, text: Column) -> DataFrame:
    """Adds v, a number for each identifier, or for each text of one that is repeated with unlike texts; no two share one."""
    rows = rows.withColumn("h", F.xxhash64(text))
    several = rows.filter("k IS NOT NULL").groupBy("k").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("k")
    if several.isEmpty():
        return rows.withColumn("v", F.col("k"))
    several = stored(several, "repeated")
    marked = rows.join(several.withColumn("several", F.lit(True)), "k", "left")
    for seed in range(100):
        numbered = marked.withColumn("v", F.when(F.col("several"), F.xxhash64(F.lit(seed), "k", text)).otherwise(F.col("k"))).drop("several")
        made = marked.filter("several").select("k", text.alias("t")).distinct().select(F.xxhash64(F.lit(seed), "k", "t").alias("v"))
        twice = made.groupBy("v").count().filter("count > 1").select("v").union(made.join(rows.select(F.col("k").alias("v")), "v", "left_semi"))
        if twice.isEmpty():
            return numbered
    raise ValueError("no seed tells the texts apart")


def first_of_class(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with their columns: one document of each class, one row of equal ones; rows without words or identifier stay."""
    body = F.col("row")[text]
    rows = _told_apart(df.select(F.col(key).cast("bigint").alias("k"), F.struct("*").alias("row")), body)
    gone = classes(rows.select(F.col("v"), body.alias("t")), "v", "t").filter(~F.col("kept")).select(F.col("v").alias("gone")).distinct()
    named = rows.filter("v IS NOT NULL").join(gone, F.col("v") == F.col("gone"), "left_anti")
    # The exchange of the join serves the window, too.
    first = named.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy(body))).filter("place = 1").select("row")
    return first.union(rows.filter("v IS NULL").select("row")).select(*[F.col("row")[c].alias(c) for c in df.columns])


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, i, i + 4), ' ') END AS t
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.doc_id = w.doc_id
"""
