"""Morphological name scores, identity gates, fit and confidence of a candidate, as Column expressions over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.functions import similarity, text

NGRAM = 4


def english_match(a: Column, b: Column) -> Column:
    """Equal, or one is the other's plural."""
    plural = [x == F.concat(y, F.lit(e)) for x, y in ((a, b), (b, a)) for e in ("s", "es")]
    return (a == b) | plural[0] | plural[1] | plural[2] | plural[3]


def evidenced(core: Column, toks: Column, match=english_match) -> Column:
    """The core's tokens of three letters at least that some token matches."""
    return F.filter(core, lambda c: (F.length(c) >= 3) & F.exists(toks, lambda t: match(c, t)))


def long_tokens(core: Column) -> Column:
    return F.filter(core, lambda c: F.length(c) >= 3)


def german_evidence(c: Column, t: Column) -> Column:
    """Held by the token, or inflected alike; compounds are split by the caller, who has all tokens."""
    return F.contains(t, c) | text.german_match(c, t)


def german_name_score(query: Column, names: Column) -> Column:
    """How well a record's name answers a query, both as tokens. In order:

    0.85 for an ordered prefix, of all or of the identity tokens. Where the record has one identity word more than the
    query at most, all of the query's in it: 0.85 if the first ones match, else 0.8. For a query of one identity word:
    0.6 if a longer token, by eight letters at most, ends with it or its stem (four letters at least), or if it is a
    compound whose halves the name has. Else 0.7 of the shared share of identity words. 0 without tokens.
    """
    bound = F.struct(query.alias("query"), names.alias("names"), text.identity_tokens(query).alias("q"), text.identity_tokens(names).alias("c"))
    return text.let(bound, lambda b: _german_name_score(b["query"], b["names"], b["q"], b["c"]))


def _german_name_score(query: Column, names: Column, q: Column, c: Column) -> Column:
    every = F.forall(q, lambda x: F.exists(c, lambda t: text.german_match(x, t)))
    explains = (F.size(c) <= F.size(q) + 1) & every
    first, head = F.get(q, F.lit(0)), F.get(c, F.lit(0))
    one = F.size(q) == 1
    heads = F.filter(F.array(first, text.german_stem(first)), lambda h: F.length(h) >= 4)
    ends = F.exists(names, lambda t: F.exists(heads, lambda h: t.endswith(h) & (F.length(t) > F.length(h)) & (F.length(t) <= F.length(h) + 8)))
    tail = one & (F.length(first) >= 4) & ends
    score = (
        F.when(similarity.ordered_prefix(query, names) | similarity.ordered_prefix(q, c), 0.85)
        .when(explains & text.german_match(first, head), 0.85)
        .when(explains, 0.8)
        .when(tail | (one & (text.compound_matches(first, names) | text.compound_matches(first, c))), 0.6)
        .otherwise(0.7 * similarity.jaccard(q, c))
    )
    return F.when((F.size(query) == 0) | (F.size(names) == 0), 0.0).otherwise(score)


def english_name_score(query: Column, names: Column) -> Column:
    """0.7 of the shared share of identity words: no prefixes and compounds."""
    return 0.7 * similarity.jaccard(text.identity_tokens(query), text.identity_tokens(names))


def best_name(query: Column, spellings: Column, english: Column) -> Column:
    """struct<score, name, english>: the spelling (array<struct<name, toks>>, in order) that scores best, then has the fewest
    identity words, then comes first; the English name (a struct, too) only where it scores more than all of them."""
    scored = F.transform(spellings, lambda s, i: F.struct(german_name_score(query, s["toks"]).alias("score"), (-F.size(text.identity_tokens(s["toks"]))).alias("words"), (-i).alias("ord"), s["name"].alias("name")))
    own, other = F.array_max(scored), F.coalesce(english_name_score(query, english["toks"]), F.lit(0.0))
    beaten = other > own["score"]
    return F.struct(F.greatest(other, own["score"]).alias("score"), F.when(beaten, english["name"]).otherwise(own["name"]).alias("name"), beaten.alias("english"))


def core_adjustment(core: Column, query: Column, names: Column) -> Column:
    """+8 for each modifier of the query that the name states, -35 for each word of the name that the query doesn't explain.

    Numbers, descriptors and words for an absence need no explanation.
    """
    modifiers = F.array_except(query, core)
    stated = F.size(F.filter(modifiers, lambda m: F.exists(names, lambda t: text.german_match(m, t))))
    foreign = F.filter(names, lambda t: ~F.exists(query, lambda q: text.german_match(q, t)) & ~t.rlike("^[0-9]") & ~t.isin(*text.DESCRIPTORS) & text.absence_stem(t).isNull())
    return 8 * F.least(stated, F.size(modifiers)) - 35 * F.size(foreign)


def morph_score(name_score: Column, adjustment: Column, kcal: Column, gated: Column) -> Column:
    return 70 * name_score + adjustment + F.when(kcal.isNotNull(), 15).otherwise(-50) - F.when(gated, 1000).otherwise(0)


def best_spelling(scored: DataFrame, record: list[str]) -> DataFrame:
    """Of a record's spellings the one that scores best, then has the fewest identity words, then comes first (ord)."""
    order = F.struct(F.col("score").alias("s"), (-F.col("n_words")).alias("w"), (-F.col("ord")).alias("o"))
    return scored.groupBy(*record).agg(F.max_by(F.struct("score", "ord"), order).alias("b")).select(*record, "b.score", F.col("b.ord").alias("ord"))


# Gates: true refuses the candidate. What is unknown passes, unless said otherwise.
def core_conflict(core: Column, toks: Column) -> Column:
    """No long token of the core is evidenced; a core without such tokens passes."""
    return (F.size(long_tokens(core)) > 0) & (F.size(evidenced(core, toks)) == 0)


def part_of_core(core: Column, toks: Column) -> Column:
    """Of several words of the core some are evidenced and some aren't."""
    found = F.size(evidenced(core, toks))
    return (F.size(long_tokens(core)) > 1) & (found > 0) & (found < F.size(long_tokens(core)))


def narrows(query: Column, toks: Column) -> Column:
    """The candidate adds a word that is neither the query's nor a descriptor."""
    return F.exists(toks, lambda t: ~F.exists(query, lambda q: english_match(q, t)) & ~t.isin(*text.DESCRIPTORS))


def derived_conflict(query: Column, toks: Column) -> Column:
    """The query names derived products, and the candidate none of them."""
    asked = text.classes_named(query, text.DERIVED)
    return (F.size(asked) > 0) & ~F.arrays_overlap(asked, text.classes_named(toks, text.DERIVED))


def carrier_conflict(query: Column, toks: Column) -> Column:
    """The query asks for a product derived from something that the candidate doesn't name."""
    named = [w for _, ws in text.DERIVED for w in ws]
    source = F.filter(query, lambda q: ~q.isin(*named))
    return (F.size(text.classes_named(query, text.DERIVED)) > 0) & (F.size(source) > 0) & ~F.exists(source, lambda s: F.exists(toks, lambda t: english_match(s, t)))


def type_conflict(query_type: Column, food_type: Column) -> Column:
    return F.coalesce((query_type != "composite") & (food_type == "composite"), F.lit(False))


def brand_evidence(brand: Column, source: Column) -> Column:
    """The brand stands in the source name; no brand has no evidence."""
    return F.coalesce((brand != "") & F.contains(F.lower(source), F.lower(brand)), F.lit(False))


# Fit and confidence.
def attribute_fit(asked: Column, stated: Column, exempt: tuple[str, ...] = ("fresh",)) -> Column:
    """2 if the record states what is asked, -1 if it is specific about what isn't asked; else 0."""
    return F.when(asked.isNotNull(), F.when(asked == stated, 2).otherwise(0)).when(stated.isNotNull() & ~stated.isin(*exempt), -1).otherwise(0)


def decisiveness(fit: Column, query_state: Column, state: Column) -> Column:
    known = (query_state != "unknown") & (state != "unknown")
    return fit + F.when(known & (query_state == state), 1).when(known, -1).otherwise(0)


def confidence(provider: Column, score: Column, has_core: Column, unmet: Column) -> Column:
    """By provider and score, less without evidence of the core, least with unmet claims."""
    german = F.least(F.when(score >= 70, 0.85).otherwise(0.75), F.when(has_core, 1.0).otherwise(0.6))
    english = F.least(F.when(score >= 55, 0.8).otherwise(0.7), F.when(has_core, 1.0).otherwise(0.55))
    retail = F.least(F.lit(0.95), score / 100)
    base = F.when(provider == "bls", german).when(provider == "usda-local", english).when(provider == "off", retail).when(provider == "own-recipe", 0.85).otherwise(0.35)
    return F.when(unmet, F.least(base, F.lit(0.55))).otherwise(base)


def preserves_identity(query: Column, before: Column, after: Column) -> Column:
    """Each token of the pick that the query supports survives in the replacement (as it is or in a compound)."""
    supported = F.filter(before, lambda b: F.exists(query, lambda q: english_match(q, b)))
    return F.forall(supported, lambda s: F.exists(after, lambda a: english_match(s, a) | ((F.length(s) >= 4) & F.contains(a, s))))


def contains_recall(needles: DataFrame, names: DataFrame, most: int = 120) -> DataFrame:
    """qid, fid of the names that hold the needle; none for a needle in more than `most` names, or shorter than NGRAM.

    A needle's first n-gram is looked up among the distinct ones of the names: an equi-join, filtered, not a product.
    """
    grams = F.transform(F.sequence(F.lit(1), F.length("name") - NGRAM + 1), lambda i: F.substring("name", i, F.lit(NGRAM)))
    index = names.filter(F.length("name") >= NGRAM).select("fid", "name", F.explode(F.array_distinct(grams)).alias("gram"))
    asked = needles.filter(F.length("needle") >= NGRAM).withColumn("gram", F.substring("needle", 1, NGRAM))
    hits = asked.join(index, "gram").filter(F.contains("name", "needle")).select("qid", "fid")
    few = hits.groupBy("qid").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    return hits.join(few.select("qid"), "qid", "left_semi")
