"""Keyed state as tables: latest value, expiry, misses, overrides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Last write wins: an idempotent upsert of a log."""
    return log.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("nth = 1").drop("nth")


def fresh(state: DataFrame, now: Column, hours: float) -> DataFrame:
    return state.filter((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) < hours * 3600)


def two_horizons(age_hours: Column, found: Column, ttl: float = 24, grace: float = 24 * 7) -> Column:
    """fresh, refetch (and serve stale while that fails), or gone; what is known to be absent is so until its time is up."""
    return F.when(age_hours < ttl, F.when(found, "fresh").otherwise("absent")).when(age_hours < ttl + grace, F.when(found, "stale").otherwise("refetch")).otherwise("refetch")


def misses(asked: DataFrame, cached: DataFrame, key: list[str], group: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """What the cache can't answer; with a group and an order, numbered anew from 0 within its group (asked_as)."""
    left = asked.join(cached.select(*key).distinct(), key, "left_anti")
    return left if group is None else left.withColumn("asked_as", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: the rows of each table, counted in one plan."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.union, counts)
