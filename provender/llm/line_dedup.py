"""Line dedup by content-defined chunks, in DataFrame operations only.

Blank lines apart, each line has a hash. Two families of chunks of lines are cut where the content says, never
the position, so that both are found again wherever a passage is moved:

* chunks between boundaries: a rolling hash over the hashes of a line and the one before it ends a chunk where it
  is divisible by MODULUS, and a line of more than LONG_WORDS words stands alone. They count if they have several
  lines and MIN_WORDS words;
* runs of more than LONG_WORDS words: the shortest such run from each line on, and the shortest up to each line. A
  repeated passage of more than LONG_WORDS words is a union of them, however short its lines are.

A line goes if it stands in a chunk whose bytes came before, in order of (identifier, line). Each line that goes
thus equals an earlier one, and the first of them stays. Hashes only find candidates: repeats of neighbouring
chunks in the same document are joined to maximal passages, and a passage goes after its bytes were compared with
those of the first occurrence. Blank lines go between lines of one passage that go.

The corpus moves once, by identifier; besides it only chunk hashes (one to two for a line), and the bytes of
repeated passages, do. A hot chunk is counted by partial aggregation, meets its occurrences where they lie, and
its bytes go to salted groups.

Null texts stay null, empty ones empty; a text of which nothing is left becomes empty. Rows that repeat an
identifier are one document: they are not compared with each other. A null identifier is a document that
comes first. Extra columns are kept, whatever their names. Long texts take work in proportion. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender.llm.common import few, made, meet, remove_made_since, stored

MODULUS, LONG_WORDS, MIN_WORDS = 4, 50, 10
#: Occurrences that one group compares with the bytes of a passage; of more, each group gets the bytes.
GROUP = 1024
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where body uses it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def numbered(text: Column) -> Column:
    """array<struct<i, x>>: the lines that aren't blank, with their places among all lines."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.rlike(s["x"], F.lit(WORD)))


def chunks(text: Column) -> Column:
    """array<struct<pos, lines, h>> of the chunks and runs; pos is the first line's number among those that aren't blank."""

    def of(lines: Column) -> Column:
        facts = F.transform(lines, lambda s: F.struct(line_hash(s["x"]).alias("h"), F.regexp_count(s["x"], F.lit(WORD)).alias("w")))
        return let(F.transform(lines, lambda s: F.xxhash64(s["x"])), lambda hs: let(facts, lambda f: F.concat(bounded(hs, f), runs(hs, f))))

    def span(hs: Column, start: Column, n: Column) -> Column:
        return F.struct(start.cast("int").alias("pos"), n.cast("int").alias("lines"), F.xxhash64(F.slice(hs, start + 1, n)).alias("h"))

    def bounded(hs: Column, f: Column) -> Column:
        def begins(i: Column) -> Column:
            last, earlier = F.get(f, i - 1), F.get(f, i - 2)
            rolling = last["h"] * 3 + F.coalesce(earlier["h"], F.lit(0))
            return (i == 0) | (F.get(f, i)["w"] > LONG_WORDS) | (last["w"] > LONG_WORDS) | (rolling % MODULUS == 0)

        def counts(c: Column) -> Column:
            words = F.aggregate(F.slice(f, c["p"] + 1, c["n"]), F.lit(0), lambda a, x: a + x["w"])
            ends = F.greatest(F.get(f, c["p"])["w"], F.get(f, c["p"] + c["n"] - 1)["w"])
            # One that is a run is among the runs.
            return (c["n"] > 1) & let(words, lambda n: (n >= MIN_WORDS) & ((n <= LONG_WORDS) | (n - ends > LONG_WORDS)))

        starts = F.filter(F.sequence(F.lit(0), F.size(f) - 1), begins)
        cut = let(starts, lambda s: F.transform(s, lambda p, k: F.struct(p.alias("p"), (F.coalesce(F.get(s, k + 1), F.size(f)) - p).alias("n"))))
        return F.transform(F.filter(cut, counts), lambda c: span(hs, c["p"], c["n"]))

    def runs(hs: Column, f: Column) -> Column:
        def reach(i: Column) -> Column:
            """The last line of the shortest run from line i on; as each line has a word, it is short."""
            took = F.aggregate(F.slice(f, i + 1, LONG_WORDS + 1), F.struct(F.lit(0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.when(a["s"] > LONG_WORDS, a).otherwise(F.struct((a["s"] + x["w"]).alias("s"), (a["n"] + 1).alias("n"))))
            return let(took, lambda t: F.when(t["s"] > LONG_WORDS, i + t["n"] - 1))

        def of(ends: Column) -> Column:
            # The shortest runs up to the lines before the next run's end begin here, too.
            at = lambda e, p: F.transform(F.sequence(e, F.greatest(e, F.coalesce(F.get(ends, p + 1), F.size(f)) - 1)), lambda z: span(hs, p, z - p + 1))
            return F.flatten(F.transform(F.filter(F.transform(ends, lambda e, p: F.struct(e.alias("e"), p.alias("p"))), lambda s: s["e"].isNotNull()), lambda s: at(s["e"], s["p"])))

        return let(F.transform(F.sequence(F.lit(0), F.size(f) - 1), lambda i: F.when(F.get(f, i)["w"] > LONG_WORDS, i).otherwise(reach(i))), of)

    return let(numbered(text), lambda lines: F.when(F.size(lines) > 0, of(lines)))


def passages(found: DataFrame) -> DataFrame:
    """k, start, lines (a maximal passage that came before), fk, first (where), groups (over which its occurrences are dealt)."""
    repeated = stored(found.groupBy("h", "lines").agg(F.count("*").alias("size"), F.min(F.struct("k", "pos")).alias("first")).filter("size > 1"), "repeated")
    later = meet(found, repeated, ["h", "lines"]).filter(~F.struct("k", "pos").eqNullSafe(F.col("first")))
    later = later.select("k", "pos", (F.col("pos") + F.col("lines")).alias("end"), F.col("first.k").alias("fk"), (F.col("pos") - F.col("first.pos")).alias("shift"), "size").repartition("k")
    same = Window.partitionBy("k", "fk", "shift").orderBy("pos", "end")
    later = later.withColumn("opens", F.coalesce(F.col("pos") > F.max("end").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    later = later.withColumn("number", F.sum(F.col("opens").cast("int")).over(same.rowsBetween(Window.unboundedPreceding, 0)))
    joined = later.groupBy("k", "fk", "shift", "number").agg(F.min("pos").alias("start"), F.max("end").alias("end"), F.max("size").alias("size"))
    groups = F.ceil(F.col("size") / F.lit(GROUP)).cast("int")
    return joined.select("k", "start", (F.col("end") - F.col("start")).alias("lines"), "fk", (F.col("start") - F.col("shift")).alias("first"), groups.alias("groups"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", facts_as: str | None = "line_dedup") -> DataFrame:
    """The rows with their texts cleaned, and a column of facts: struct<n_lines, n_removed, removed array<line>>; none, if facts_as is None."""
    rows = df.select(F.col(key).alias("k"), F.struct("*").alias("row"))
    body, before = F.col("row")[text], made()
    found = stored(rows.select("k", F.explode(chunks(body)).alias("c")).select("k", "c.pos", "c.lines", "c.h"), "chunks")
    again = stored(passages(found), "passages")

    # The bytes of first occurrences: their documents are picked where they lie, if those are few enough to be named.
    wanted = again.select("fk", "first", "lines", "groups").distinct()
    by_key = wanted.groupBy("fk").agg(F.collect_list(F.struct("first", "lines", "groups")).alias("wanted"))
    first = rows.join(F.broadcast(by_key) if few(wanted) else by_key, rows.k.eqNullSafe(by_key.fk))
    bytes_of = lambda lines, p, n: F.array_join(F.transform(F.slice(lines, p + 1, n), lambda s: s["x"]), "\n")
    bodies = first.select("fk", F.explode(let(numbered(body), lambda lines: F.transform("wanted", lambda c: F.struct(c["first"].alias("first"), c["lines"].alias("lines"), c["groups"].alias("groups"), bytes_of(lines, c["first"], c["lines"]).alias("body"))))).alias("c"))
    bodies = bodies.select("fk", "c.*").dropDuplicates(["fk", "first", "lines", "groups"]).select("*", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))
    bodies = stored(bodies, "bodies")
    remove_made_since(df.sparkSession, before, again, bodies)

    salted = again.withColumn("salt", F.pmod(F.xxhash64("k"), F.col("groups")).cast("int"))
    same = [salted[c].eqNullSafe(bodies[c]) for c in ("fk", "first", "lines", "groups", "salt")]
    doubted = salted.join(bodies, same).groupBy(salted.k.alias("lk")).agg(F.collect_set(F.struct(salted.start.alias("pos"), salted.lines.alias("lines"), "body")).alias("doubted"))

    joined = rows.join(doubted, rows.k.eqNullSafe(doubted.lk), "left")
    lines = F.split(body, "\n")
    # What goes, as [a, b) of all lines; spans may overlap.
    true = lambda full: F.filter(F.col("doubted"), lambda d: bytes_of(full, d["pos"], d["lines"]) == d["body"])
    spans = let(numbered(body), lambda full: F.transform(true(full), lambda d: F.struct(F.get(full, d["pos"])["i"].alias("a"), (F.get(full, d["pos"] + d["lines"] - 1)["i"] + 1).alias("b"))))
    none = F.array().cast("array<struct<a:int,b:int>>")

    def union(m: Column, s: Column) -> Column:
        last = F.get(m, F.size(m) - 1)
        return F.when(s["a"] <= last["b"], F.concat(F.slice(m, 1, F.size(m) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))).otherwise(F.concat(m, F.array(s)))

    gone = F.when(F.col("doubted").isNull(), none).otherwise(F.aggregate(F.array_sort(spans), none, union))
    marked = joined.withColumn("gone", gone)

    def stay(ls: Column, sp: Column, s: Column, i: Column) -> Column:
        start = F.coalesce(F.get(sp, i - 1)["b"], F.lit(0))
        return F.slice(ls, start + 1, s["a"] - start)

    rest = F.concat(F.col("gone"), F.array(F.struct(F.size(lines).alias("a"), F.size(lines).alias("b"))))
    kept = let(lines, lambda ls: let(rest, lambda sp: F.flatten(F.transform(sp, lambda s, i: stay(ls, sp, s, i)))))

    cleaned = F.when(F.size("gone") == 0, body).otherwise(F.array_join(kept, "\n"))
    removed = F.flatten(F.transform("gone", lambda g: F.sequence(g["a"], g["b"] - 1)))
    facts = F.struct(F.when(body.isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.size(removed).alias("n_removed"), removed.alias("removed"))
    out = marked.select("row", cleaned.alias("cleaned"), facts.alias("facts"))
    return out.select(*[F.col("cleaned").alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns], *([F.col("facts").alias(facts_as)] if facts_as else []))


ORACLE = f"""
WITH a AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '{WORD}')) AS w, n FROM (
    SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
), l AS (
  SELECT doc_id, i, line, w, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, row_number() OVER d - 1 AS p, sum(w) OVER d AS upto FROM a WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), b AS (
  SELECT *, CASE WHEN p = 0 OR w > {LONG_WORDS} OR lag(w) OVER d > {LONG_WORDS} OR (lag(h) OVER d * 3 + coalesce(lag(h, 2) OVER d, 0)) % {MODULUS} = 0 THEN 1 ELSE 0 END AS begins FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), c AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY p) AS chunk FROM b),
spans AS (
  SELECT doc_id, min(p) AS p, max(p) AS e FROM c GROUP BY doc_id, chunk HAVING count(*) > 1 AND sum(w) >= {MIN_WORDS}
  UNION SELECT x.doc_id, x.p, min(y.p) FROM l x JOIN l y ON y.doc_id = x.doc_id AND y.p BETWEEN x.p AND x.p + {LONG_WORDS} AND y.upto - x.upto + x.w > {LONG_WORDS} GROUP BY x.doc_id, x.p
  UNION SELECT y.doc_id, max(x.p), y.p FROM l x JOIN l y ON y.doc_id = x.doc_id AND x.p BETWEEN y.p - {LONG_WORDS} AND y.p AND y.upto - x.upto + x.w > {LONG_WORDS} GROUP BY y.doc_id, y.p
), g AS (
  SELECT s.doc_id, s.p, s.e, min(l.i) AS i, max(l.i) AS j, string_agg(l.line, chr(10) ORDER BY l.p) AS body FROM spans s JOIN l ON l.doc_id = s.doc_id AND l.p BETWEEN s.p AND s.e GROUP BY s.doc_id, s.p, s.e
), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, p) AS nth FROM g) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM r),
k AS (
  SELECT a.doc_id, max(a.n) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(a.line, chr(10) ORDER BY a.i) FILTER (WHERE gone.i IS NULL), '') AS cleaned
  FROM a LEFT JOIN gone ON gone.doc_id = a.doc_id AND gone.i = a.i GROUP BY a.doc_id
)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed, CAST(length(cleaned) AS INTEGER) AS n_chars_kept, md5(cleaned) AS cleaned_md5
FROM documents LEFT JOIN k ON k.doc_id = documents.doc_id
"""


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.length("text").alias("n_chars_kept"), F.md5("text").alias("cleaned_md5"))
