"""What a model's reply may decide: replies are tables with keys, so results don't depend on a model's mood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rerank_verdict(index: Column, offered: Column, confidence: Column, same_identity: Column, preserved: Column, decline_refuses: Column) -> Column:
    """What becomes of the deterministic pick: replaced, kept, refused (none), or kept for a reply that is no answer."""
    valid = index.between(1, offered)
    declined = F.when(decline_refuses, "none").otherwise("kept-declined")
    return (
        F.when(index.isNull(), "kept-unanswered")
        .when(index == 0, declined)
        .when(~valid, "kept-malformed")
        .when(F.coalesce(confidence, F.lit(0.0)) < 0.6, "kept-unsure")
        .when(same_identity, "kept-same")
        .when(~preserved, "kept-identity")
        .otherwise("replaced")
    )


def grams_of_reply(unit_is_volume: Column, reply: Column, quantity: Column) -> Column:
    """Volumes are asked for by 100 ml, and a density beyond 0.05 to 5 g/ml is no answer; other units by piece."""
    density = reply / 100
    return F.when(unit_is_volume, F.when(density.between(0.05, 5), quantity * density)).otherwise(F.when(reply > 0, quantity * reply))


def nutrients_of_reply(kcal: Column, others: list[Column]) -> Column:
    """estimated or unresolved: energy is needed, zero is a value, and nothing is negative."""
    bad = F.lit(False)
    for o in others:
        bad = bad | F.coalesce(o < 0, F.lit(False))
    return F.when(kcal.isNull() | (kcal < 0) | bad, "unresolved").otherwise("estimated")


def fallback_of(provider: Column, known: tuple[str, ...] = ("bls", "usda-local", "off", "own-recipe", "override", "llm-nutrient")) -> Column:
    """record, estimate or unresolved; a provider that isn't known is unresolved."""
    return F.when(provider == "llm-nutrient", "estimate").when(provider.isin(*known), "record").otherwise("unresolved")


def retail_routing(may_query: Column, has_brand: Column, local_found: Column) -> Column:
    """Why retail records are asked: a brand, a proxy for what local tables lack, or not at all."""
    return F.when(~may_query, "refused").when(has_brand, "branded").when(~local_found, "last-resort").otherwise("proxy")


def exact_label(hits: DataFrame, group: str, label: Column, asked: Column) -> DataFrame:
    """Where exactly one label of the group equals the one asked for, only that one stays; else all do."""
    equal = hits.withColumn("equal", F.coalesce(F.lower(label) == F.lower(asked), F.lit(False)))
    n = F.sum(F.col("equal").cast("int")).over(Window.partitionBy(group))
    return equal.withColumn("n_equal", n).filter((F.col("n_equal") != 1) | F.col("equal")).drop("equal", "n_equal")


def by_index(asked: DataFrame, replies: DataFrame, key: list[str]) -> DataFrame:
    """asked with the fields of the first reply of its key (ord); later ones, and those of keys not asked, are ignored."""
    fields = [c for c in replies.columns if c not in (*key, "ord")]
    first = replies.groupBy(*key).agg(F.min_by(F.struct(*fields), "ord").alias("reply"))
    return asked.join(first, key, "left")


def may_query_retail(english: Column, core: Column, brand: Column) -> Column:
    """A brand, or an English name together with its core."""
    return brand | (english & core)


def evidence_key(english: Column, core: Column, brand: Column) -> Column:
    return F.concat(*[F.when(c, m).otherwise("-") for c, m in ((english, "E"), (core, "C"), (brand, "B"))])


def ownership(kcal: Column, provenance: Column, sticky: Column, fingerprint: Column, recorded: Column) -> Column:
    """Whose nutrition a recipe has: a person's (stored without provenance, or claimed as such), ours with the fingerprint changed by another, ours, or nobody's."""
    manual = F.coalesce(sticky, F.lit(False)) | (kcal.isNotNull() & provenance.isNull())
    return F.when(manual, "manual").when(kcal.isNull(), "none").when(~fingerprint.eqNullSafe(recorded), "drifted").otherwise("owned")


def outcome(tagged: Column, same_hash: Column, tags_complete: Column, manual: Column, force: Column) -> Column:
    """What a recipe's run comes to, before anything is estimated; a person's nutrition outlasts force."""
    return F.when(~tagged, "not-tagged").when(same_hash & ~force, F.when(tags_complete, "unchanged").otherwise("tags-updated")).when(manual, "manual").otherwise("estimate")


def should_estimate(strategy: str, tags: Column, wanted: str) -> Column:
    """All recipes, or those with the tag, by its slug or name."""
    return F.lit(True) if strategy == "all" else F.exists(tags, lambda t: F.lower(t).isin(wanted.lower(), wanted.lower().replace(" ", "-")))


def merged_tags(own: Column, old: Column, new: Column) -> Column:
    """A person's tags (those that weren't ours), then the new ones."""
    return F.concat(F.filter(own, lambda t: ~F.array_contains(old, t)), new)


def tags_complete(own: Column, old: Column) -> Column:
    return (F.size(old) > 0) & (F.size(F.array_except(old, own)) == 0)


def usable(ingredients: DataFrame, name: str = "name", quantity: str = "qty") -> DataFrame:
    """Ingredients with a name and more than none of them."""
    return ingredients.filter((F.coalesce(F.col(name), F.lit("")) != "") & (F.col(quantity) > 0))


def per_100g(per_serving: Column, servings: Column, yield_grams: Column, energy: Column, digits: int = 3) -> Column:
    """A recipe's nutrient in 100 g; null without energy, servings, or a mass of 1 g to 100 kg."""
    ok = (energy > 0) & (servings > 0) & yield_grams.between(1, 100_000)
    scale = 10.0**digits
    return F.when(ok, F.floor(F.round(per_serving * servings * 100 / yield_grams * scale, 6) + 0.5) / scale)
