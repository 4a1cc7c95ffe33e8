"""Set and name similarity, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; 0 if either has none."""
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / every)


def name_similarity(a: Column, b: Column) -> Column:
    """jaccard, or 0.5 if one name holds the other."""
    x, y = F.array_join(a, " "), F.array_join(b, " ")
    held = (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))
    return F.greatest(jaccard(a, b), F.when(held, 0.5).otherwise(0.0))


def ordered_prefix(prefix: Column, full: Column) -> Column:
    return F.slice(full, F.lit(1), F.greatest(F.size(prefix), F.lit(1))) == prefix


def fat_tolerance(asked: Column) -> Column:
    return F.greatest(F.lit(2.0), asked * 0.15)


def fat_conflict(asked: Column, offered: Column) -> Column:
    return F.coalesce(F.abs(asked - offered) > fat_tolerance(asked), F.lit(False))


def materially_different(a: Column, b: Column) -> Column:
    gap, top = F.abs(a - b), F.greatest(F.abs(a), F.abs(b))
    return F.coalesce((gap >= 30) & (gap > 0.25 * top), F.lit(False))
