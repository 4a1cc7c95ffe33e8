"""What a judge is asked about and told, as columns and tables: reasons, keys of replies, verdicts, batches of classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender.functions import similarity

#: Reasons to ask, in the order in which they are given.
REASONS = ("no-database-record", "gate-suppressed-pool", "unsatisfied-numeric-modifier", "unmet-attribute", "unresolved-specificity", "partial-core-identity", "material-rival", "retail-variant-proxy")
RECORDS = ("own-recipe", "bls", "usda-local", "off")


def fat_approximate(asked: Column, measured: Column, exact: float = 0.5) -> Column:
    """Within the tolerance, and not what was asked for."""
    gap = F.abs(measured - asked)
    return F.coalesce((gap > exact) & (gap <= similarity.fat_tolerance(asked)), F.lit(False))


def need(provider: Column, unmet: Column, fat_asked: Column, fat: Column, kept_asked: Column, kept: Column, partial_core: Column, processed: Column, claims: Column, rival: Column, survivors: Column, below: Column) -> Column:
    """array of the reasons to ask a judge about a match, in order; empty: none.

    provider null: no match. unmet and claims: whether the match leaves a claim open, and whether the ingredient makes one.
    kept_asked and kept: preservation, asked for and of the record. rival, survivors, below: of the set of candidates.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    there = yes(provider.isin(*RECORDS))
    number = there & fat_asked.isNotNull() & (fat.isNull() | fat_approximate(fat_asked, fat))
    other = there & yes((kept_asked != "unknown") & (kept != "unknown") & (kept_asked != kept))
    claimed = there & yes(unmet)
    open_ = claimed | number | (~there & (fat_asked.isNotNull() | yes(claims)))
    found = {
        "no-database-record": ~there, "gate-suppressed-pool": ~there & yes((survivors > 0) & (below > 0)), "unsatisfied-numeric-modifier": number, "unmet-attribute": claimed,
        "unresolved-specificity": other, "partial-core-identity": there & yes(partial_core), "material-rival": yes(rival), "retail-variant-proxy": yes(processed) & open_,
    }
    return F.array_compact(F.array(*[F.when(found[r], F.lit(r)) for r in REASONS]))


def verdict(reply: Column, offered: Column, confidence: Column, sane: Column, has_record: Column, least: float = 0.6) -> Column:
    """What becomes of a judge's reply: it never replaces a record, and picks only what it was offered."""
    return F.when(reply.isNull(), "malformed").when(~reply.between(1, offered), "out-of-range").when(F.coalesce(confidence, F.lit(0.0)) < least, "low-confidence").when(~sane, "implausible").when(has_record, "kept-record").otherwise("accepted")


def classified(asked: DataFrame, replies: DataFrame, valid: Column, enough: float = 0.8) -> DataFrame:
    """asked (batch, idx) with the fields of its reply, and origin: first, retry or fallback (no valid reply: fields are null).

    replies: batch, attempt (1, 2), idx and fields. A reply counts if it is `valid`, its index was asked for, and no other
    reply of the attempt gives that index. The second attempt is heard where the first one covers less than `enough` of the
    batch, and only for what the first one leaves open: what it said stays.
    """
    fields = [c for c in replies.columns if c not in ("batch", "attempt", "idx")]
    alone = F.count("*").over(Window.partitionBy("batch", "attempt", "idx")) == 1
    good = replies.withColumn("alone", alone).filter(F.col("alone") & F.coalesce(valid, F.lit(False)))
    by = lambda n: good.filter(F.col("attempt") == n).select("batch", "idx", F.struct(*fields).alias(f"r{n}"))
    rows = asked.join(by(1), ["batch", "idx"], "left")
    share = F.avg(F.col("r1").isNotNull().cast("int")).over(Window.partitionBy("batch"))
    rows = rows.withColumn("again", share < enough).join(by(2), ["batch", "idx"], "left")
    second = F.when(F.col("again"), F.col("r2"))
    picked = F.coalesce("r1", second)
    origin = F.when(F.col("r1").isNotNull(), "first").when(second.isNotNull(), "retry").otherwise("fallback")
    return rows.select(*asked.columns, *[picked[f].alias(f) for f in fields], origin.alias("origin"))
