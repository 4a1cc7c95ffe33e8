"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Counts of each text are computed in its row, without exchange: repeated 8-word windows are found by sorting
window hashes within the row, and only where some hash repeats. The cutoffs are then chosen on labelled
documents: for each rule and stratum (language), the strictest cutoff of a grid for which the exact binomial
(Clopper-Pearson) bound says that at most ALPHA of good documents are rejected, at a confidence of
1 - DELTA over all cutoffs, rules and strata tried together (Bonferroni). A stratum with too few labels for
any guarantee has no cutoff for that rule, and its documents are kept unless the base rules fail.

A null or empty text has no words and fails the base rules. A null stratum is a stratum. A document with
several labels is good if all say so. Repeated rows are each judged; a null identifier has no label. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender.llm.common import stored
from provender.llm.line_dedup import let

ALPHA, DELTA = 0.01, 0.05
#: Cutoffs tried, in thousandths: a text is rejected above one.
GRID = (5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 600)
RULES = {"symbols": "1000 * n_symbols div greatest(word_chars, 1)", "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)", "repeats": "1000 * n_repeat_words div greatest(n_words, 1)"}
SPACES = r"[\x20\x09-\x0D]+"
#: ASCII white space, and the characters that count as symbols.
WHITE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words that stand in a window found twice or more, the first time included."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(ordered, lambda o: F.transform(o, lambda s, i: F.when((F.get(o, i - 1)["x"] == s["x"]) | (F.get(o, i + 1)["x"] == s["x"]), s["i"])))
        return let(F.array_sort(F.array_compact(twice)), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x))

    counted = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs))))
    return F.when(F.size(words) > window, counted).otherwise(F.lit(0))


def counts(df: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """key, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, WHITE, "") != "")

    def of(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).cast("long").alias("n_repeat_words"))

    by_words = let(F.filter(F.split(t, SPACES), lambda w: w != ""), of)
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")
    rows = df.select(F.col(key).alias("k"), F.col(stratum).alias("s"), by_words.alias("w"), F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"), symbols.alias("n_symbols"), by_lines.alias("l"))
    out = rows.select("k", "s", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")
    return out.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


def tail(n: str, k: str, p: float) -> Column:
    """P(X <= k) of a binomial distribution, term by term in logarithms; 1 where k is at its mean or above."""
    step = f"(s, j) -> struct(s.lp + ln(({n} - j) / (j + 1D)) + {math.log(p / (1 - p))!r}D AS lp, s.total + exp(s.lp + ln(({n} - j) / (j + 1D)) + {math.log(p / (1 - p))!r}D) AS total)"
    first = f"{n} * {math.log1p(-p)!r}D"
    terms = f"CASE WHEN {k} > 0 THEN sequence(0L, {k} - 1) ELSE cast(array() AS array<bigint>) END"
    return F.expr(f"CASE WHEN {k} >= {n} * {p!r}D THEN 1D ELSE aggregate({terms}, struct({first} AS lp, exp({first}) AS total), {step}, s -> s.total) END")


def cutoffs(counted: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """s (stratum) and, for each rule, the cutoff (null: none is safe). One row a stratum."""
    good = labels.groupBy(F.col(key).alias("k")).agg(F.min(label).alias("q")).filter("q = 1").select("k")
    held = counted.join(good, "k").filter("NOT base_failed")
    sums = [F.count_if(F.expr(f"({e}) > {c}")).alias(f"{r}_{c}") for r, e in RULES.items() for c in GRID]
    # One row a stratum: its size, and how many good documents each cutoff would reject.
    table = held.groupBy("s").agg(F.count("*").alias("n"), *sums)
    table = table.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(1))))  # a row a stratum
    tries = F.col("strata") * len(RULES) * len(GRID)
    safe = {r: F.coalesce(*[F.when(tail("n", f"{r}_{c}", ALPHA) <= DELTA / tries, F.lit(c)) for c in GRID]) for r in RULES}
    return table.select("s", *[safe[r].alias(f"{r}_cutoff") for r in RULES])


def verdicts(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """key, the counts, base_failed, kept."""
    counted = stored(counts(df, key, text, stratum), "counts")
    chosen = stored(cutoffs(counted, labels, key), "cutoffs")
    few = chosen.limit(100_001).count() <= 100_000
    side = F.broadcast(chosen) if few else chosen
    judged = counted.join(side.withColumnRenamed("s", "cs"), F.col("s").eqNullSafe(F.col("cs")), "left")
    above = " OR ".join(f"coalesce(({e}) > {r}_cutoff, false)" for r, e in RULES.items())
    out = judged.withColumn("kept", F.expr(f"NOT base_failed AND NOT ({above})"))
    return out.select(F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "kept")


_REJECTED = ", ".join(f"sum(CASE WHEN {r}_m > {c} THEN 1 ELSE 0 END) AS {r}_{c}" for r in RULES for c in GRID)


def _duck_safe(rule: str) -> str:
    """The strictest cutoff whose binomial tail is small enough, as DuckDB SQL over the row of a stratum."""
    tests = []
    for c in GRID:
        k = f"{rule}_{c}"
        term = f"exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA}))"
        tests.append(f"CASE WHEN {k} < n * {ALPHA} AND list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda j: {term})) <= {DELTA} / (strata * {len(RULES) * len(GRID)}) THEN {c} END")
    return f"coalesce({', '.join(tests)}) AS {rule}_cutoff"


ORACLE = f"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents
), v AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), t AS (SELECT doc_id, g FROM v GROUP BY doc_id, g HAVING count(*) > 1),
p AS (SELECT v.doc_id, v.i, lead(v.i) OVER (PARTITION BY v.doc_id ORDER BY v.i) AS nxt FROM v JOIN t ON t.doc_id = v.doc_id AND t.g = v.g),
r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words FROM p GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines FROM w LEFT JOIN r ON r.doc_id = w.doc_id
), m AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 1000 * n_symbols // greatest(word_chars, 1) AS symbols_m,
    1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines_m, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats_m FROM c
), good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
h AS (SELECT lang, count(*) AS n, count(*) OVER () AS strata, {_REJECTED} FROM m JOIN good ON good.doc_id = m.doc_id WHERE NOT base_failed GROUP BY lang),
k AS (SELECT lang, {", ".join(map(_duck_safe, RULES))} FROM h)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
  NOT base_failed AND NOT (coalesce(symbols_m > symbols_cutoff, false) OR coalesce(dup_lines_m > dup_lines_cutoff, false) OR coalesce(repeats_m > repeats_cutoff, false)) AS kept
FROM m LEFT JOIN k ON k.lang IS NOT DISTINCT FROM m.lang
"""
