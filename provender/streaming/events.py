"""Recipe events: parsing, de-duplication by content hash, expiry; the same functions for batches and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parsed(events: DataFrame) -> DataFrame:
    """slug, kind, a value from the JSON payload, and why an event is refused (null: it isn't)."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    refused = F.when(F.col("user_id").isNull(), "no-slug").when(~F.col("event_type").isin("purchase", "view", "click", "signup", "login", "error", "scroll"), "other-kind")
    return events.select("event_id", "ts", F.col("user_id").alias("slug"), F.col("event_type").alias("kind"), k.alias("k"), F.col("value"), refused.alias("refused"))


def changed(log: DataFrame) -> DataFrame:
    """The first event of each content: later ones with the same hash change nothing."""
    content = F.sha2(F.concat_ws("|", F.col("slug").cast("string"), "kind"), 256)
    return log.withColumn("hash", content)


def dedupe_batch(log: DataFrame) -> DataFrame:
    return changed(log).groupBy("slug", "kind", "hash").agg(F.min("event_id").alias("event_id"))


def dedupe_stream(stream: DataFrame) -> DataFrame:
    """As dedupe_batch, with the hashes seen as the stream's state."""
    return changed(stream).dropDuplicates(["slug", "kind", "hash"])


def upsert(path: str, key: list[str], newest: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: one writer a key and batch; a batch written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in key]), newest).alias("last"))
        last.select(*key, "last.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def runnable(pending: DataFrame, running: DataFrame, limit: int = 2) -> DataFrame:
    """The jobs to start, first come first served: one a slug, none whose slug runs, as many as running ones leave of the limit.

    A job that fails leaves `running`, and so its place. The free places are counted in the plan; at most `limit` rows result.
    """
    waiting = pending.join(running.select("slug").distinct(), "slug", "left_anti")
    heads = waiting.groupBy("slug").agg(F.min("seq").alias("seq")).orderBy("seq").limit(limit)
    taken = running.agg(F.count("*").alias("taken"))
    nth = heads.withColumn("nth", F.row_number().over(Window.orderBy("seq")))  # of `limit` rows
    return nth.join(F.broadcast(taken), F.col("nth") <= F.lit(limit) - F.col("taken")).select("slug", "seq")


def once_within(stream: DataFrame, key: list[str], ttl: str, time: str = "ts") -> DataFrame:
    """The first row of each key; the key is forgotten when `ttl` has passed, so state is bounded. Later ones are dropped."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark(key)
