"""Overrides as a log of operations, their preview and suggestions, tags that are fetched or made, stale sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(log: DataFrame, key: str = "override_key") -> DataFrame:
    """The overrides that a log of set and delete leaves: the last set's target, created_at from the first set after the last delete."""
    gone = F.max(F.when(F.col("op") == "delete", F.col("seq")))
    dropped = log.groupBy(key).agg(gone.alias("gone"))
    alive = log.join(dropped, key).filter((F.col("op") == "set") & F.coalesce(F.col("seq") > F.col("gone"), F.lit(True)))
    return alive.groupBy(key).agg(F.max_by("target", "seq").alias("target"), F.min_by("ts", "seq").alias("created_at"), F.max_by("ts", "seq").alias("updated_at"), F.max("seq").alias("seq"))


def described(overrides: DataFrame, records: DataFrame, now: Column, stale_days: int = 180) -> DataFrame:
    """ok, broken (its record is gone) or stale (not touched for long)."""
    known = records.select(F.col("food_id").alias("target"), F.lit(True).alias("there")).distinct()
    old = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("updated_at").cast("timestamp")) > stale_days * 86400
    status = F.when(F.col("there").isNull(), "broken").when(old, "stale").otherwise("ok")
    return overrides.join(known, "target", "left").withColumn("status", status).drop("there")


def listed(overrides: DataFrame) -> DataFrame:
    """The overrides with their place, the one touched last first."""
    return overrides.withColumn("place", F.row_number().over(Window.orderBy(F.desc("updated_at"), "override_key")))  # a person's list


def targets(overrides: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """overrides (provider, target) with the live record (name, kcal) of whichever provider's table holds it; tables have id, name and kcal."""
    out = overrides
    for provider, records in tables.items():
        out = out.join(records.select(F.lit(provider).alias("provider"), F.col("id").alias("target"), F.struct("name", "kcal").alias(f"from_{provider}")), ["provider", "target"], "left")
    found = F.coalesce(*[F.col(f"from_{p}") for p in tables])
    return out.select(*overrides.columns, found["name"].alias("name"), found["kcal"].alias("kcal"))


def preview(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """What each row resolves to with and without overrides; one that names its own record changes nothing."""
    both = rows.join(overrides.select("override_key", F.col("target").alias("forced")), "override_key", "left")
    return both.withColumn("after", F.coalesce("forced", "before")).withColumn("changes", ~F.col("after").eqNullSafe(F.col("before"))).drop("forced")


def tags_for(wanted: DataFrame, known: DataFrame, makeable: Column) -> DataFrame:
    """slug, tag_id: known tags by folded name, new ones by 60 bits of a hash of it (the same wherever they are made); what can't be made is dropped."""
    dim = known.groupBy(F.lower("name").alias("folded")).agg(F.min("tag_id").alias("tag_id"))
    rows = wanted.withColumn("folded", F.lower("name")).join(dim, "folded", "left")
    made = F.when(makeable, -F.conv(F.substring(F.md5("folded"), 1, 15), 16, 10).cast("bigint") - 1)
    return rows.withColumn("id", F.coalesce("tag_id", made)).filter("id IS NOT NULL").select("slug", F.col("id").alias("tag_id")).distinct()


def stale(recorded: DataFrame, sources: DataFrame) -> DataFrame:
    """Recipes with a recorded source whose fingerprint is another now; the recipe itself and unreadable sources don't count."""
    now = sources.select(F.col("slug").alias("source"), F.col("fingerprint").alias("current"))
    both = recorded.filter("source <> slug").join(now, "source").filter("current IS NOT NULL")
    return both.groupBy("slug").agg(F.max(F.col("current") != F.col("fingerprint")).alias("stale"))
