"""Operators by tables of cases, and every query against its SQL."""

import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from provender.config import Config
from provender.functions import nutrition, similarity, text
from provender.operators import aggregate, linkage, state
from provender.plans import catalogue, resolution  # noqa: F401 (registers its queries)
from provender.sources import importers
from provender.sources.domain import NUTRIENTS
from provender.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    return x if isinstance(x, str | bool) else round(float(x), 6)


def rows(df):
    return sorted((str(tuple(map(plain, r))) for r in df[sorted(df.columns)].itertuples(index=False)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("token,stem", [("zwiebeln", "zwiebel"), ("tomaten", "tomat"), ("bohne", "bohne"), ("mehle", "mehle"), ("kartoffel", "kartoffel")])
def test_stem(spark, token, stem):
    assert value(spark, text.german_stem(F.lit(token))) == stem


@pytest.mark.parametrize("said,want", [("4-6 Portionen", 5.0), ("1,5 l", 1.5), ("3-4", 4.0), ("viele", None), (None, None)])
def test_yield(spark, said, want):
    assert value(spark, text.parse_yield(F.lit(said).cast("string"))) == want


def test_normalizers_differ(spark):
    assert value(spark, text.normalize_identity(F.lit("  Süße  Öl-Soße! "))) == "suesse oel sosse"
    assert value(spark, text.normalize_ascii(F.lit("Öl é"))) == "ol e"


def test_compounds(spark):
    assert value(spark, F.size(text.compound_segments(F.lit("kurz")))) == 0
    assert [s.head for s in value(spark, text.compound_segments(F.lit("rindfleisch")))] == ["rind", "rindf", "rindfl", "rindfle"]
    assert value(spark, text.compound_matches(F.lit("tomatenmark"), F.array(F.lit("mark"), F.lit("tomaten"))))
    assert value(spark, text.compound_specifier(F.lit("olivenoel"), F.lit("oel"))) == "oliven"
    assert value(spark, text.absence_stem(F.lit("glutenfrei"))) == "gluten" and value(spark, text.absence_stem(F.lit("zuckerfrei"))) is None


@pytest.mark.parametrize("kcal,tag", [("349.9", "Light"), ("350", "Moderate"), ("600", "Moderate"), ("850", "Hearty"), ("851", "Heavy")])
def test_calorie_tags(spark, kcal, tag):
    assert value(spark, F.expr(nutrition.calorie_tag(kcal))) == f"Calories:{tag}"


@pytest.mark.parametrize("kcal,fat,tag", [("0.0", "1.0", "Slow"), ("0.0", "0.0", "Moderate"), ("100.0", "1.0", "Easy"), ("100.0", "5.0", "Slow"), ("700.0", "1.0", "Moderate"), ("NULL", "1.0", "Unknown")])
def test_digest_tags(spark, kcal, fat, tag):
    assert value(spark, F.expr(nutrition.digest_tag(f"CAST({kcal} AS DOUBLE)", fat))) == f"Digest:{tag}"


@pytest.mark.parametrize("unmatched,matched,resolved,known,want", [(0, 0, "NULL", "NULL", "complete"), (1, 0, 0, 10, "withheld"), (1, 2, 7, 10, "partial"), (1, 2, 6.9, 10, "withheld"), (1, 2, "NULL", "NULL", "withheld")])
def test_completeness(spark, unmatched, matched, resolved, known, want):
    number = lambda x: f"CAST({x} AS DECIMAL(9, 2))"
    assert value(spark, F.expr(nutrition.completeness(str(unmatched), str(matched), number(resolved), number(known)))) == want


def test_half_up(spark):
    assert value(spark, F.expr(nutrition.half_up("-2.5D"))) == -2 and value(spark, F.expr(nutrition.half_up("2.5D"))) == 3


def test_grams(spark):
    for unit, name, want in (("kg", "x", 2000.0), ("tbsp", "x", 24.0), ("tbsp", "copper pan", 28.0), ("ml", "x", None), ("box", "x", None), ("piece", "tin can", 120.0)):
        got = value(spark, F.expr(nutrition.grams("2D", f"'{unit}'", f"'{name}'")).cast("double"))
        assert got == want, unit


def test_similarity(spark):
    a, b = F.array(F.lit("red"), F.lit("onion")), F.array(F.lit("onion"))
    assert value(spark, similarity.name_similarity(a, b)) == 0.5 and value(spark, similarity.jaccard(a, F.array().cast("array<string>"))) == 0
    assert value(spark, similarity.ordered_prefix(F.array(F.lit("red")), a)) and not value(spark, similarity.ordered_prefix(b, a))


def literal_chain(candidates, route, forced):
    """The chain of providers told as a loop over the route, for comparison with the fold."""
    held, asked = None, False
    for provider in linkage.ROUTES[route]:
        if provider in linkage.LOCAL and not asked:
            asked = True
            if forced is not None:
                return forced
        c = candidates.get(provider)
        if c is None or c["refused"]:
            continue
        if not c["unmet"]:
            if held is None:
                return c["fid"]
            if set(held["unmet"]) - set(c["stated"]):
                continue
            return c["fid"]
        if held is None:
            held = c
    return held["fid"] if held else None


def test_chain_equals_loop(spark):
    rng = random.Random(1)
    claims = [[], ["a"], ["b"], ["a", "b"]]
    table, want = [], {}
    for g in range(1500):
        forced, route = rng.choice([None, None, -1]), rng.choice(list(linkage.ROUTES))
        there = {}
        for i, provider in enumerate(rng.sample(linkage.ROUTES["generic"], rng.randint(1, 6))):
            there[provider] = {"gid": g, "provider": provider, "fid": g * 10 + i, "unmet": rng.choice(claims), "stated": rng.choice(claims), "refused": rng.choice([None, False, False, False, True]), "route": route, "forced": forced}
        table += there.values()
        want[g] = literal_chain(there, route, forced)
    df = spark.createDataFrame(table, "gid long, provider string, fid long, unmet array<string>, stated array<string>, refused boolean, route string, forced long")
    df = df.withColumns({"pos": linkage.chain_position(F.col("route"), F.col("provider")), "entry": linkage.enters_at(F.col("route"))})
    assert {r.gid: r.picked for r in linkage.chain(df).collect()} == want
    assert None in want.values() and -1 in want.values()
    # A held shortfall gives way to the preference, and a preference enters though no local provider answers.
    for there, forced, picked in (({"own-recipe": ["a"]}, -1, -1), ({"off": []}, -1, -1), ({"own-recipe": []}, -1, 0), ({"own-recipe": ["a"], "bls": []}, None, 0)):
        rows = [(1, p, i, u, [], False, "generic", forced) for i, (p, u) in enumerate(there.items())]
        one = spark.createDataFrame(rows, df.drop("pos", "entry").select("gid", "provider", "fid", "unmet", "stated", "refused", "route", "forced").schema)
        one = one.withColumns({"pos": linkage.chain_position(F.col("route"), F.col("provider")), "entry": linkage.enters_at(F.col("route"))})
        assert linkage.chain(one).first().picked == picked


def test_rankings_do_not_depend_on_order(spark):
    table = [(1, i, f"n{i % 5}", float(i % 3), "bls", 10.0 * (i % 4), i % 2, ["plain", "property", "retail"][i % 3], ["Foundation", "SR Legacy", None][i % 3]) for i in range(40)]
    schema = "gid int, fid int, name string, score double, provider string, kcal double, fit int, kind string, tier string"
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(table)
        df = spark.createDataFrame(table, schema)
        ordered = linkage.ordered_candidates(df)
        seen.add((str(sorted(ordered.collect())), str(sorted(linkage.shortlist(ordered).collect())), linkage.fingerprint(ordered).first().fingerprint))
    assert len(seen) == 1


def test_state(spark):
    ages = [(1, True), (30, True), (30, False), (1, False), (500, True)]
    got = spark.createDataFrame(ages, "age int, found boolean").select(state.two_horizons(F.col("age"), F.col("found")).alias("x")).collect()
    assert [r.x for r in got] == ["fresh", "stale", "refetch", "absent", "refetch"]


def test_importers(spark):
    long = spark.createDataFrame([(1, 10, 5.00005), (1, 20, 7.0), (2, 20, 1.0)], "food_id int, nutrient_id int, amount double")
    got = {r.food_id: r.energy for r in importers.pivot_nutrients(long, {"energy": [10, 20]}, {}).collect()}
    assert got[2] == 1.0 and abs(got[1] - 5.0) < 1e-3
    with pytest.raises(ValueError):
        importers.require_rows(long, 9, "foods")


def test_config():
    with pytest.raises(ValueError):
        Config(concurrency=0)


def test_stream_equals_batch(spark, tmp_path):
    """The event stream, read file by file, leaves what the batch leaves."""
    log = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    log.repartition(3, "event_id").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = events.dedupe_stream(events.parsed(live)).select("slug", "kind")
    q = out.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = events.dedupe_batch(events.parsed(log)).select("slug", "kind")
    assert sorted(spark.table("live").collect()) == sorted(want.collect())


def test_upsert_sink(spark, tmp_path):
    batch = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c")], "slug int, at int, v string")
    write = events.upsert(str(tmp_path), ["slug"], "at")
    write(batch, 0)
    write(batch, 0)
    assert sorted((r.slug, r.v) for r in spark.read.parquet(str(tmp_path)).collect()) == [(1, "b"), (2, "c")]


@pytest.mark.parametrize("name", ["recipe_totals", "completeness_status", "serving_nutrients", "evidence_shares", "calorie_tags", "digest_tags", "patch_output"])
def test_graded_of_many_rows(spark, name):
    """On a table of several splits, against the SQL on one thread: it adds in the order of the table, on more it differs from itself."""
    big = "/root/testdata/sf0.1"
    duck = duckdb.connect(config={"threads": 1})
    for t in ("part", "orders", "lineitem"):
        duck.execute(f"create view {t} as select * from read_parquet('{big}/{t}.parquet')")
    got, want = entry.queries()[name](spark, big).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    merged = got.merge(want, how="outer", on=list(want.columns), indicator=True)
    assert len(got) == len(want) == len(merged) and (merged["_merge"] == "both").all()


@pytest.mark.parametrize("known,kcal", [([0.1, 0.2, 0.7], [200.1, 200.2, 200.2]), ([0.3, 0.6, 0.1], [100.1, 400.2, 100.2]), ([0.7, 0.1, 0.2], [0.1, 0.2, 600.2])])
def test_sums_in_order(spark, known, kcal):
    """Every order of three rows, whatever the order in which they arrive; the last digit decides two tags and what is withheld."""
    from itertools import permutations

    zero = {n: 0.0 for n in NUTRIENTS}
    data, recipes, want = [], [], {}
    for slug, order in enumerate(permutations(range(3))):
        total = {"kcal": 0.0, "known": 0.0, "resolved": 0.0}
        for row, i in enumerate(order):
            matched = i != 0 or known[0] not in (0.3, 0.7)
            grams, k = known[i] * 1.0, kcal[i] * 100 / (known[i] * 1.0)
            data.append({"slug": slug, "row": row, "matched": matched, "provider": "bls", "confidence": 0.9, "grams": grams, **zero, "kcal": k})
            total["known"] += grams
            if matched:
                total["resolved"] += grams
                total["kcal"] += k * grams / 100
        missing = (total["known"] - total["resolved"]) / total["known"]
        want[slug] = (total["kcal"], total["known"], total["resolved"], "complete" if known[0] not in (0.3, 0.7) else "withheld" if missing > 0.3 else "partial")
        recipes.append((slug, 1.0))
    random.Random(1).shuffle(data)
    ingredients = spark.createDataFrame(pd.DataFrame(data)).repartition(3)
    got = aggregate.graded(ingredients, spark.createDataFrame(recipes, "slug long, servings double")).collect()
    assert {r.slug: (r.kcal_total, r.known_weight, r.resolved_weight, r.completeness) for r in got} == want
    for r in got:
        if r.completeness != "withheld":
            whole = math.floor(want[r.slug][0] + 0.5)
            assert (r.kcal_serving, r.calorie_tag, r.digest_tag) == (whole, "Calories:Light" if whole < 350 else "Calories:Moderate" if whole <= 600 else "Calories:Hearty", "Digest:Easy" if whole <= 600 else "Digest:Moderate")
    assert len({v[0] for v in want.values()} | {v[1] for v in want.values()}) > 2


def test_rounding_alike(spark):
    near = [k / 1000 + 0.0005 for k in range(0, 3000, 7)] + [0.285, 1.005, 2.675, 0.95625, -1.005, 0.23125, 1e15 + 0.125]
    got = spark.createDataFrame([(x,) for x in near], "x double").select(*[F.expr(nutrition.spark_round("x", d)) for d in (2, 3, 4)]).collect()
    assert [tuple(r) for r in got] == [duckdb.execute("select round(?::double, 2), round(?::double, 3), round(?::double, 4)", [x] * 3).fetchone() for x in near]
