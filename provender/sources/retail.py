"""Retail products from an offline dump: search, barcodes, and the filter of what may answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender.functions import similarity, text


def search(queries: DataFrame, products: DataFrame, limit: int = 10) -> DataFrame:
    """qid, code, rank: the products that share most words with a query, at most `limit` (a page); status says absent or failed.

    queries: qid, text, available (false: the source can't be reached, which confirms nothing). A query without hits has one
    row with a null code.

    Products with the same asked words differ by code alone, and queries with the same words in stock not at all. So kinds
    meet kinds: before one of a query's first products stand the first products of fewer than `limit` other kinds and
    fewer than `limit` of its own kind. A word that all queries and products share costs no pairs of them.
    """
    words = lambda c: F.explode(F.array_distinct(text.ascii_tokens(F.col(c)))).alias("word")
    bag = F.array_sort(F.collect_list("word"))
    upto = lambda rows, name, kind, *order: rows.withColumn(name, F.row_number().over(Window.partitionBy(kind).orderBy(*order))).filter(F.col(name) <= limit)
    asked = queries.filter("available").select("qid", words("text"))
    there = products.select("code", words("name")).join(asked.select("word").distinct(), "word", "left_semi")
    shelf = upto(there.groupBy("code").agg(bag.alias("has")), "nth", "has", F.asc_nulls_last("code"))
    kinds = shelf.filter("nth = 1").select("has", F.col("code").alias("least"), F.explode("has").alias("word"))
    wanted = asked.join(kinds.select("word").distinct(), "word", "left_semi").groupBy("qid").agg(bag.alias("wants"))
    shared = wanted.select("wants").distinct().select("wants", F.explode("wants").alias("word")).join(kinds, "word").groupBy("wants", "has", "least").agg(F.count("*").alias("shared"))
    best = upto(shared, "place", "wants", F.desc("shared"), F.asc_nulls_last("least")).select("wants", "has", "shared")
    first = upto(best.join(shelf, "has"), "rank", "wants", F.desc("shared"), F.asc_nulls_last("code"))
    status = F.when(~F.col("available"), "failed").when(F.col("code").isNull(), "absent").otherwise("ok")
    found = queries.join(wanted.join(first, "wants").select("qid", "code", "rank"), "qid", "left")
    return found.select("qid", "code", "rank", status.alias("status"))


def barcode(asked: DataFrame, products: DataFrame) -> DataFrame:
    """asked (code) with name, kcal and status: ok, or absent for a code without record, name or energy."""
    one = products.groupBy("code").agg(F.min_by(F.struct("name", "kcal"), F.struct("name", "kcal")).alias("p"))
    rows = asked.join(one, "code", "left")
    ok = (F.trim(F.col("p.name")) != "") & F.col("p.kcal").isNotNull()
    status = F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("absent")
    return rows.select(*asked.columns, F.when(status == "ok", F.col("p.name")).alias("name"), F.when(status == "ok", F.col("p.kcal")).alias("kcal"), status.alias("status"))


def drop_reason(name: Column, kcal: Column, fat: Column, category: Column, core: Column, identity: Column, fat_asked: Column, last_resort: Column, excluded: tuple[str, ...]) -> Column:
    """The first reason why a product can't answer; null: it can. core and identity are texts.

    It must report energy and have a name. The name must hold a word of the core of four letters at least or, as a last
    resort, the ingredient's most distinctive word. Its category must not be excluded, and its measured fat must fit.
    """
    words = text.ascii_tokens(name)
    meets = lambda wanted: F.exists(wanted, lambda w: F.exists(words, lambda t: F.contains(t, w) | F.contains(w, t)))
    cores = F.filter(text.ascii_tokens(core), lambda w: F.length(w) > 3)
    own = text.distinctive_tokens(F.coalesce(identity, F.lit("")))
    lacks = lambda wanted: (F.size(wanted) > 0) & ~meets(wanted)
    return (
        F.when(kcal.isNull(), "energy").when(F.coalesce(F.trim(name), F.lit("")) == "", "name")
        .when(last_resort & lacks(own), "distinctive").when(~last_resort & lacks(cores), "core").when(F.coalesce(category.isin(*excluded), F.lit(False)), "category")
        .when(fat_asked.isNotNull() & fat.isNull(), "no-fat").when(similarity.fat_conflict(fat_asked, fat), "fat")
    )


def kept(hits: DataFrame, reason: Column) -> DataFrame:
    """The hits that may answer."""
    return hits.filter(reason.isNull())


def dropped(hits: DataFrame, reason: Column) -> DataFrame:
    """reason, n: how many hits went, and why."""
    return hits.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).filter("reason IS NOT NULL")
