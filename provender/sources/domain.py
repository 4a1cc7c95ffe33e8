"""The domain's tables, projected from the generic star schema (recipes from orders, foods from parts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provender.functions import nutrition

#: column -> expression that both engines read alike.
FOOD = {
    "food_id": "p_partkey",
    "name": "p_name",
    "brand": "p_brand",
    "category": "p_type",
    "tier": "CASE WHEN p_type LIKE 'STANDARD%' THEN 'Foundation' WHEN p_type LIKE 'SMALL%' THEN 'SR Legacy' ELSE 'Other' END",
    "kcal": "CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size * 12.0 END",
    "protein": "(p_size % 23) * 1.0",
    "carbs": "(p_size % 41) * 1.0",
    "fat": "(p_size % 37) * 1.0",
    "saturated": "(p_partkey % 19) * 1.0",
    "sugar": "(p_partkey % 43) * 1.0",
    "sodium": "(p_partkey % 31) * 1.0",
    "trans": "(p_partkey % 3) * 1.0",
    "unsaturated": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey % 13) * 1.0 END",
    "fiber": "(p_partkey % 17) * 1.0",
    "cholesterol": "(p_partkey % 11) / 10.0",
    "polyols": "CASE WHEN p_partkey % 4 = 0 THEN (p_partkey % 29) * 1.0 END",
}
#: Nutrients of 100 g that are added up for a recipe; the last two are small, and kept to the fraction.
NUTRIENTS = ("kcal", "protein", "carbs", "fat", "saturated", "trans", "unsaturated", "fiber", "sugar", "sodium", "cholesterol")
INGREDIENT = {
    "slug": "l_orderkey",
    "idx": "l_linenumber",
    "qty": "l_quantity",
    "price": "l_extendedprice",
    "unit": "CASE l_linenumber WHEN 1 THEN 'g' WHEN 2 THEN 'oz' WHEN 3 THEN 'tbsp' WHEN 4 THEN 'ml' WHEN 5 THEN 'piece' WHEN 6 THEN 'pinch' ELSE 'box' END",
    "provider": "CASE l_suppkey % 4 WHEN 0 THEN 'bls' WHEN 1 THEN 'usda-local' WHEN 2 THEN 'off' ELSE 'llm-nutrient' END",
    "confidence": "CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE (35 + l_partkey % 60) / 100.0 END",
    "unmet": "CASE WHEN l_partkey % 23 = 0 THEN 'lean' END",
    "grams_estimated": "l_linenumber = 5",
    "matched": "l_suppkey % 9 <> 0",
}
RECIPE = {
    "slug": "o_orderkey",
    "household": "o_custkey",
    "servings": "CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE 1.0 + o_custkey % 6 END",
    "strategy_tag": "o_orderpriority",
    "total": "o_totalprice",
    "status": "o_orderstatus",
}


def select_sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


#: The same projections for an engine that has the tables as views.
FOODS_SQL = f"foods AS (SELECT {select_sql(FOOD)} FROM part)"
RECIPES_SQL = f"recipes AS (SELECT {select_sql(RECIPE)} FROM orders)"
INGREDIENTS_SQL = f"""{FOODS_SQL}, ing AS (SELECT i.*, f.* , {nutrition.grams('i.qty', 'i.unit', 'f.name')} AS grams FROM (SELECT l_partkey, {select_sql(INGREDIENT)} FROM lineitem) i JOIN foods f ON f.food_id = i.l_partkey)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def foods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(*[f"{e} AS {c}" for c, e in FOOD.items()])


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in RECIPE.items()])


def ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an ingredient, with its food, grams and place in the table (row); the optimizer broadcasts the foods only if they are small."""
    row = "struct(_metadata.file_name AS file, _metadata.row_index AS nth) AS row"
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_partkey", row, *[f"{e} AS {c}" for c, e in INGREDIENT.items()])
    joined = rows.join(foods(spark, sf_dir), F.col("l_partkey") == F.col("food_id"))
    return joined.withColumn("grams", F.expr(nutrition.grams("qty", "unit", "name")))
