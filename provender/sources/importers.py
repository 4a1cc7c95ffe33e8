"""Reference tables from long nutrient lists: pivot by precedence, checks, and vocabulary validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provender.functions import text


def pivot_nutrients(long: DataFrame, precedence: dict[str, list[int]], scale: dict[str, float]) -> DataFrame:
    """One row a food: the first present of each nutrient's ids, scaled, half-even to 4 digits."""
    ids = sorted({i for own in precedence.values() for i in own})
    wide = long.groupBy("food_id").agg(*[F.max(F.when(F.col("nutrient_id") == i, F.col("amount"))).alias(f"n{i}") for i in ids])
    return wide.select("food_id", *[F.bround(F.coalesce(*[F.col(f"n{i}") for i in own]) * scale.get(name, 1.0), 4).alias(name) for name, own in precedence.items()])


def validated(entries: DataFrame) -> DataFrame:
    """Vocabulary entries with the reason why one is rejected (null: it isn't)."""
    reason = F.when(F.col("alias").isNull() | (F.trim("alias") == ""), "empty").when(~F.col("lang").isin("de", "en"), "language")
    return entries.withColumn("reject_reason", reason)


def require_rows(df: DataFrame, least: int, what: str) -> DataFrame:
    """Fails early if a source is short of rows."""
    if df.limit(least).count() < least:
        raise ValueError(f"{what}: fewer than {least} rows")
    return df


def resolved_columns(names: list[str], prefixes: dict[str, str]) -> dict[str, str]:
    """The only header that starts with each prefix; none or several are an error."""
    found = {}
    for field, prefix in prefixes.items():
        own = [n for n in names if n.lower().startswith(prefix.lower())]
        if len(own) != 1:
            raise ValueError(f"{field}: {len(own)} columns start with {prefix!r}")
        found[field] = own[0]
    return found


def wide_table(df: DataFrame, code: str, name: str, prefixes: dict[str, str], scale: dict[str, float], traces: tuple[str, ...] = ("tr", "sp", "+")) -> DataFrame:
    """A sheet of texts as foods: - and empty are null, traces zero, decimal commas allowed; another text fails the job.

    food_type is composite for codes that start with X or Y.
    """
    fields = resolved_columns(df.columns, prefixes)

    def number(column: str):
        cell = F.lower(F.trim(F.col(f"`{column}`")))
        value = F.replace(cell, F.lit(","), F.lit(".")).try_cast("double")
        wrong = F.raise_error(F.concat(F.lit(f"{column}: not a number: "), cell)).cast("double")
        return F.when(cell.isNull() | cell.isin("", "-"), F.lit(None).cast("double")).when(cell.isin(*traces), 0.0).when(value.isNotNull(), value).otherwise(wrong)

    kind = F.when(F.upper(F.substring(code, 1, 1)).isin("X", "Y"), "composite").otherwise("simple")
    return df.select(F.col(code).alias("code"), F.col(name).alias("name"), kind.alias("food_type"), *[(number(c) * scale.get(f, 1.0)).alias(f) for f, c in fields.items()])


def reference_table(df: DataFrame, version: int, understood: tuple[int, ...] = (1,)) -> DataFrame:
    """Foods with what is derived from their names and fats; a table of another version is refused."""
    if version not in understood:
        raise ValueError(f"schema version {version} is not understood")
    toks = text.tokens(F.col("name"))
    rest = F.bround(F.greatest(F.lit(0.0), F.col("fat") - F.coalesce("saturated", F.lit(0.0)) - F.coalesce("trans", F.lit(0.0))), 4)
    derived = df.withColumn("toks", toks).withColumn("unsaturated", F.when(F.col("fat").isNotNull(), rest))
    identity = text.identity_tokens(F.col("toks"))
    return derived.withColumns({"identity": text.identity_key(identity), "state": text.state_of(F.col("toks")), "part": text.first_part(F.col("toks"))})
