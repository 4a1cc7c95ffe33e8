"""Recipe totals and grades: one aggregation by recipe, in the order of the rows where that is known (column row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender.functions import nutrition
from provender.sources.domain import NUTRIENTS

#: Nutrients that are given as fractions.
FRACTIONS = ("sodium", "cholesterol")
#: name -> aggregate that both engines read alike. A sum is null only if all its inputs are.
TOTALS = {
    **{f"{n}_total": f"sum(CASE WHEN matched THEN {n} * grams / 100 END)" for n in NUTRIENTS},
    "known_weight": "sum(grams)",
    "resolved_weight": "sum(CASE WHEN matched THEN grams END)",
    "n_matched": "sum(CASE WHEN matched THEN 1 ELSE 0 END)",
    "n_unmatched": "sum(CASE WHEN matched THEN 0 ELSE 1 END)",
    "abs_kcal": "sum(CASE WHEN matched THEN abs(kcal * grams / 100) END)",
    "estimated_kcal": "sum(CASE WHEN matched AND provider = 'llm-nutrient' THEN abs(kcal * grams / 100) END)",
    "weighted_confidence": "sum(CASE WHEN matched THEN confidence * abs(kcal * grams / 100) END)",
}


def totals(ingredients: DataFrame) -> DataFrame:
    """TOTALS by slug. With the column row, doubles are added in its order, as a sum's last digit decides where halves go.

    Rows are then dealt by slug and sorted once. The greatest row, of a type that no hash table holds, makes Spark read
    sorted groups one by one: no group's sum is made of parts, and none is held in memory.
    """
    sums = [F.expr(e).alias(n) for n, e in TOTALS.items()]
    if "row" not in ingredients.columns:
        return ingredients.groupBy("slug").agg(*sums)
    dealt = ingredients.repartition("slug").sortWithinPartitions("slug", "row")
    return dealt.groupBy("slug").agg(*sums, F.max("row").alias("last")).filter("last IS NOT NULL").drop("last")


def per_serving(graded: DataFrame) -> DataFrame:
    """Totals divided by servings once, sodium and cholesterol to the fraction; null for none or no known number of them, or where the result is withheld."""
    share = "CASE WHEN completeness = 'withheld' OR servings IS NULL OR servings <= 0 THEN NULL ELSE {} END"
    out = graded
    return out.withColumns({f"{n}_serving": F.expr(share.format(nutrition.half_up(f"{n}_total / servings") if n not in FRACTIONS else f"{n}_total / servings")) for n in NUTRIENTS})


def graded(ingredients: DataFrame, recipes: DataFrame) -> DataFrame:
    """Every recipe, also one without ingredients, with totals, completeness, evidence, quality and tags."""
    out = recipes.join(totals(ingredients), "slug", "left").fillna(0, ["n_matched", "n_unmatched"])
    out = out.withColumn("completeness", F.expr(nutrition.completeness("n_unmatched", "n_matched", "resolved_weight", "known_weight")))
    out = out.withColumn("completeness_reason", F.expr(nutrition.completeness_reason("n_unmatched", "n_matched", "resolved_weight", "known_weight", nutrition.spark_round).format(text="STRING")))
    out = out.withColumn("evidence", F.expr(nutrition.evidence("n_matched", "estimated_kcal", "abs_kcal")))
    out = per_serving(out)
    return out.withColumn("calorie_tag", F.expr(nutrition.calorie_tag("kcal_serving"))).withColumn("digest_tag", F.expr(nutrition.digest_tag("kcal_serving", "fat_serving")))


def risk(low: float = 0.6) -> Column:
    """Why a matched ingredient's figure is doubtful: the most specific cause; null if it isn't."""
    return F.when(F.col("matched"), F.when(F.col("unmet").isNotNull(), "unmet").when(F.coalesce("confidence", F.lit(0)) < low, "low-confidence").when(F.col("grams_estimated"), "weight-estimated"))


def match_quality(recipes: DataFrame, ingredients: DataFrame, low=0.6, high_mean=0.75, low_mean=0.55, dominant=0.2) -> DataFrame:
    """slug, n, match_quality, reason and the doubtful ingredients, of every recipe.

    Confidence is weighted by energy (by rows, where there is none). The first doubtful ingredient with a large share can't
    be outvoted, and names itself. Without an energy-bearing row the grade is low. One exchange, by recipe. With the column row (a place in the table),
    doubles are added in its order, and it parts doubtful ingredients of the same place and food.
    """
    part = F.when(F.col("matched"), F.abs(F.col("kcal") * F.col("grams") / 100))
    place = ["row"] if "row" in ingredients.columns else []
    rows = ingredients.select("slug", "idx", "food_id", "name", *place, part.cast("double").alias("part"), F.coalesce("confidence", F.lit(0)).cast("double").alias("sure"), risk(low).alias("risk"))
    of = Window.partitionBy("slug").orderBy(*place or ["idx", "food_id"]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = {"every": F.sum("part"), "wc": F.sum(F.col("sure") * F.col("part")), "mean": F.avg(F.when(F.col("part").isNotNull(), F.col("sure")))}
    rows = rows.withColumns({n: f.over(of) for n, f in whole.items()})
    heavy = (F.col("every") > 0) & (F.col("part") > dominant * F.col("every")) & F.col("risk").isNotNull()
    doubtful = F.collect_list(F.when(F.col("risk").isNotNull(), F.struct("idx", "food_id", "name")))
    sums = rows.groupBy("slug").agg(
        F.count("part").alias("n"), *[F.max(n).alias(n) for n in whole],
        F.min(F.when(heavy, F.struct("idx", "food_id", *place, "name", "risk", (F.col("part") / F.col("every")).alias("share")))).alias("doubt"), F.array_sort(doubtful).alias("doubtful"),
    )
    weighted = F.expr(nutrition.spark_round("CASE WHEN every > 0 THEN wc / every ELSE mean END", 9))
    out = recipes.select("slug").join(sums, "slug", "left").withColumn("weighted", weighted)
    none = F.coalesce(F.col("n"), F.lit(0)) == 0
    grade = F.when(none, "low").when(F.col("doubt").isNotNull(), F.when(F.col("weighted") < low_mean, "low").otherwise("mixed")).when(F.col("weighted") >= high_mean, "high").when(F.col("weighted") < low_mean, "low").otherwise("mixed")
    share = F.expr(f"CAST(floor({nutrition.spark_round('doubt.share * 100', 6)} + 0.5) AS STRING)")
    why = F.when(none, "no energy").when(F.col("doubt").isNotNull(), F.concat(F.col("doubt.name"), F.lit(": "), F.col("doubt.risk"), F.lit(", "), share, F.lit("%"))).when(F.col("weighted") < high_mean, "mean confidence")
    names = F.array_join(F.transform(F.coalesce("doubtful", F.array().cast("array<struct<idx:int,food_id:bigint,name:string>>")), lambda x: x["name"]), "|")
    return out.select("slug", F.coalesce("n", F.lit(0)).alias("n"), grade.alias("match_quality"), why.alias("reason"), names.alias("doubtful"))


def listed(recipes: DataFrame, ingredients: DataFrame) -> DataFrame:
    """slug, matched, unmatched: the names of each kind, in the order of the recipe."""
    of = lambda yes: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("matched") == yes, F.struct("idx", "food_id", "name")))), lambda x: x["name"]), "|")
    names = ingredients.groupBy("slug").agg(of(True).alias("matched"), of(False).alias("unmatched"))
    return recipes.select("slug").join(names, "slug", "left").fillna("", ["matched", "unmatched"])
