"""Candidate generation, ranking and resolution over tables of foods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender.functions import similarity, text


def blocking(queries: DataFrame, foods: DataFrame, most: int | None = None) -> DataFrame:
    """qid, fid that share an identity token, in singular or plural: an inverted index as an equi-join on spellings.

    A query without tokens finds nothing. most: tokens that stand in more records than that open no block of their own
    where the query has a rarer one, so that a word of all names doesn't pair everything; None: every token does.
    """
    left = queries.select("qid", F.explode(F.array_distinct("toks")).alias("token")).select("qid", "token", F.explode(text.english_spellings(F.col("token"))).alias("spelt"))
    right = foods.select("fid", F.explode(F.array_distinct("toks")).alias("spelt"))
    if most is not None:
        often = right.groupBy("spelt").agg(F.countDistinct("fid").alias("often"))
        left = left.join(often, "spelt")
        own = Window.partitionBy("qid")
        left = left.withColumn("least", F.min("often").over(own)).filter((F.col("often") <= most) | (F.col("often") == F.col("least")))
    return left.join(right, "spelt").select("qid", "fid").distinct()


def fuzzy_keys(toks: Column, record: bool) -> Column:
    """Keys of which a query and a record share one wherever the German name score isn't nought: equal words, stems, a plural
    with its singular, an end of a longer word (by eight letters at most), and the first three letters, as parts of a compound have."""
    of = lambda mark, xs: F.transform(xs, lambda x: F.concat(F.lit(mark), x))
    singular = F.flatten(F.transform(toks, lambda t: F.filter(F.array(t, *[F.when(t.endswith(e), F.substring(t, F.lit(1), F.length(t) - len(e))) for e in text.PLURALS]), lambda x: F.length(x) >= 4)))
    heads = F.flatten(F.transform(toks, lambda t: F.array(t, text.german_stem(t))))
    ends = F.flatten(F.transform(toks, lambda t: F.filter(F.transform(F.sequence(F.lit(2), F.lit(9)), lambda i: F.substring(t, i, F.length(t))), lambda x: F.length(x) >= 4)))
    first = F.transform(F.filter(toks, lambda t: F.length(t) >= 3), lambda t: F.substring(t, F.lit(1), F.lit(3)))
    return F.array_distinct(F.concat(of("w", toks), of("s", F.transform(toks, lambda t: text.german_stem(t))), of("m", singular), of("e", ends if record else heads), of("p", first)))


def fuzzy(queries: DataFrame, foods: DataFrame, score) -> DataFrame:
    """qid, fid, score of all pairs that score more than nought: an equi-join on keys in place of a comparison of all with all.

    queries: qid, toks; foods: fid, toks; score(query tokens, name tokens). Frequent beginnings make wide blocks; the score
    of each pair is computed once.
    """
    left = queries.select("qid", F.col("toks").alias("qtoks"))
    right = foods.select("fid", "toks")
    keyed = left.select("qid", F.explode(fuzzy_keys(F.col("qtoks"), False)).alias("key")).join(right.select("fid", F.explode(fuzzy_keys(F.col("toks"), True)).alias("key")), "key")
    pairs = keyed.select("qid", "fid").distinct()
    return pairs.join(left, "qid").join(right, "fid").select("qid", "fid", score(F.col("qtoks"), F.col("toks")).alias("score")).filter("score > 0")


def top_k(scored: DataFrame, group: str, order: list[Column], k: int = 1) -> DataFrame:
    """The k first of each group; the order must end with a unique column, so that ties are stable."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def generic_score(query_toks: Column, food_toks: Column, tier: Column, kcal: Column) -> Column:
    """60 for the name, the dataset's tier, complete nutrients."""
    tiers = F.when(tier == "Foundation", 20).when(tier == "SR Legacy", 15).otherwise(0)
    return 60 * similarity.name_similarity(query_toks, food_toks) + tiers + F.when(kcal.isNotNull(), 15).otherwise(-50)


def band_pick(scored: DataFrame, least: float = 50, band: float = 20) -> DataFrame:
    """Of those within `band` points of the group's best, the one that fits best, then scores best; nothing below `least`."""
    good = scored.filter(F.col("score") >= least).withColumn("top", F.max("score").over(Window.partitionBy("gid")))
    return top_k(good.filter(F.col("score") >= F.col("top") - band), "gid", [F.desc("fit"), F.desc("score"), F.asc("fid")])


def first_variant(hits: DataFrame) -> DataFrame:
    """Of ordered query variants, the pick of the first one that has any, and each food's best score."""
    return hits.groupBy("qid").agg(F.min_by("fid", F.struct("variant", "fid")).alias("pick"), F.min("variant").alias("variant"), F.max("score").alias("best"))


#: Providers in the order in which each route asks them; the first local one is where a curated preference enters.
ROUTES = {"generic": ("own-recipe", "override", "bls", "usda-local", "off", "llm-nutrient"), "branded": ("own-recipe", "override", "off", "bls", "usda-local", "llm-nutrient")}
LOCAL = ("bls", "usda-local")


def chain_position(route: Column, provider: Column, routes=ROUTES) -> Column:
    """The place of a provider in a route's chain, from 1; null for one that the route doesn't ask."""
    table = F.create_map(*[x for r, ps in routes.items() for i, p in enumerate(ps, 1) for x in (F.lit(f"{r}/{p}"), F.lit(i))])
    return F.element_at(table, F.concat_ws("/", route, provider))


def enters_at(route: Column, routes=ROUTES, local=LOCAL) -> Column:
    """The place at which a route asks its first local provider."""
    return F.element_at(F.create_map(*[x for r, ps in routes.items() for x in (F.lit(r), F.lit(min(i for i, p in enumerate(ps, 1) if p in local)))]), route)


def chain(candidates: DataFrame) -> DataFrame:
    """gid, picked: what the chain of providers ends with; a fold over each group's few candidates.

    Candidates: gid, pos, fid, unmet (claims that it doesn't answer), stated (claims that it does), refused (by a sanity or
    ambiguity gate: as if it weren't there), and of the group entry (the place of the first local provider) and forced (a
    preferred record that passed its own checks, or null). The first candidate without unmet claims wins; one with some is
    held as a shortfall, and from then on only one wins that leaves none of its own and states all that the first one held
    lacks. The preference wins once the chain comes to its entry, whether or not a candidate stands there. What is held
    wins if nothing else does.
    """
    listed = candidates.filter("NOT coalesce(refused, false) AND pos IS NOT NULL AND fid IS NOT NULL").groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("pos", "fid", "unmet", "stated"))).alias("c"))
    groups = candidates.groupBy("gid").agg(F.max("forced").alias("forced"), F.max("entry").alias("entry"))
    rows = groups.join(listed, "gid", "left")

    def step(acc: Column, x: Column) -> Column:
        enters = F.col("forced").isNotNull() & (x["pos"] >= F.col("entry"))
        whole = F.size(x["unmet"]) == 0
        wins = whole & (acc["held"].isNull() | (F.size(F.array_except(acc["lacks"], x["stated"])) == 0))
        picked = F.when(acc["picked"].isNotNull(), acc["picked"]).when(enters, F.col("forced")).when(wins, x["fid"])
        hold = acc["held"].isNull() & ~whole
        return F.struct(picked.alias("picked"), F.when(hold, x["fid"]).otherwise(acc["held"]).alias("held"), F.when(hold, x["unmet"]).otherwise(acc["lacks"]).alias("lacks"))

    kinds = {f.name: f.dataType for f in candidates.schema}
    none = F.lit(None).cast(kinds["fid"])
    start = F.struct(none.alias("picked"), none.alias("held"), F.array().cast(kinds["unmet"]).alias("lacks"))
    empty = F.array().cast(rows.schema["c"].dataType)
    ended = F.aggregate(F.coalesce("c", empty), start, step)
    return rows.withColumn("end", ended).select("gid", F.coalesce("end.picked", "forced", "end.held").alias("picked"))


def unambiguous(vocabulary: DataFrame) -> DataFrame:
    """Entries whose alias is used in one language only, the first of each alias and language; collisions drop all copies."""
    w = Window.partitionBy("alias")
    seen = vocabulary.withColumn("languages", F.size(F.collect_set("lang").over(w))).filter("languages = 1").drop("languages")
    return top_k(seen, "alias", [F.asc("vid")]).drop("rank")


#: Providers and datasets by trust, where scores tie.
TRUST = ("own-recipe", "bls", "usda-local", "off", "llm-nutrient")
DATASETS = ("Foundation", "SR Legacy")


def _rank(value: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)), F.lit(len(order) + 1))


def ordered_candidates(scored: DataFrame) -> DataFrame:
    """One row a folded name and energy in each group, the best one; place is its number: by score, provider, dataset (tier), id, name."""
    same = Window.partitionBy("gid", F.lower("name"), "kcal")
    order = [F.desc("score"), _rank(F.col("provider"), TRUST), _rank(F.col("tier"), DATASETS), F.asc("fid"), F.asc("name")]
    kept = scored.withColumn("copy", F.row_number().over(same.orderBy(*order))).filter("copy = 1").drop("copy")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("gid").orderBy(*order)))


def shortlist(ordered: DataFrame, limit: int = 12) -> DataFrame:
    """At most half of the places for those that bear the property, a quarter for retail ones, the rest by order."""
    tier = Window.partitionBy("gid", "kind").orderBy("place")
    ranked = ordered.withColumn("nth", F.row_number().over(tier))
    quota = F.when(F.col("kind") == "property", limit // 2).when(F.col("kind") == "retail", limit // 4).otherwise(limit)
    chosen = ranked.withColumn("reserved", ((F.col("kind") != "plain") & (F.col("nth") <= quota)).cast("int"))
    return top_k(chosen, "gid", [F.desc("reserved"), F.asc("place")], limit)


#: What of a candidate a pool's fingerprint covers: all that a judge is shown, and no score.
SHOWN = ("fid", "name", "provider", "tier", "brand", "category", "state", "form", "preservation", "kcal", "protein", "carbs", "fat")


def fingerprint(ordered: DataFrame, shown: tuple[str, ...] = SHOWN) -> DataFrame:
    """A hash of each group's ordered pool; a field that is null or absent counts as such."""
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")) if c in ordered.columns else F.lit("-")
    line = F.concat_ws(":", *[field(c) for c in shown])
    return ordered.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l")).select("gid", F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), "|"), 256).alias("fingerprint"))


def identity(name: Column) -> Column:
    return text.identity_tokens(text.tokens(name))
