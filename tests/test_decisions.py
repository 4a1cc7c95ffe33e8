"""Batches of classifications, reasons, keys, provenance, retail products and gates against cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from provender.functions import text
from provender.operators import aggregate, judge, keys, linkage, replies, rules, scoring
from provender.sources import retail


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_classified(spark):
    asked = spark.createDataFrame([(b, i) for b in (1, 2, 3) for i in range(5)], "batch int, idx int")
    said = [(1, 1, i, f"first{i}") for i in range(4)] + [(1, 2, 4, "late")]  # 80 %: the retry isn't heard
    said += [(2, 1, 0, "first0"), (2, 1, 1, "x"), (2, 1, 1, "y"), (2, 1, 9, "beyond"), (2, 2, 0, "late0"), (2, 2, 1, "late1"), (2, 2, 2, None)]
    replies_ = spark.createDataFrame(said, "batch int, attempt int, idx int, name string")
    got = {(r.batch, r.idx): (r.name, r.origin) for r in judge.classified(asked, replies_, F.col("name").isNotNull()).collect()}
    assert [got[1, i] for i in range(5)] == [(f"first{i}", "first") for i in range(4)] + [(None, "fallback")]
    assert [got[2, i] for i in range(3)] == [("first0", "first"), ("late1", "retry"), (None, "fallback")]
    assert all(got[3, i] == (None, "fallback") for i in range(5)) and len(got) == 15


@pytest.mark.parametrize(
    "case,want",
    [
        ({}, []),
        ({"provider": None}, ["no-database-record"]),
        ({"provider": "llm-nutrient", "survivors": 3, "below": 1, "rival": True}, ["no-database-record", "gate-suppressed-pool", "material-rival"]),
        ({"unmet": True, "processed": True}, ["unmet-attribute", "retail-variant-proxy"]),
        ({"asked": 15.0, "fat": 15.4}, []), ({"asked": 15.0, "fat": 16.5}, ["unsatisfied-numeric-modifier"]), ({"asked": 15.0, "fat": None}, ["unsatisfied-numeric-modifier"]),
        ({"kept_asked": "fresh", "kept": "canned", "part": True}, ["unresolved-specificity", "partial-core-identity"]),
        ({"kept_asked": "fresh", "kept": "unknown", "processed": True}, []),
        ({"provider": None, "processed": True, "claims": True}, ["no-database-record", "retail-variant-proxy"]),
    ],
)
def test_judge_need(spark, case, want):
    base = {"provider": "bls", "unmet": False, "asked": None, "fat": 10.0, "kept_asked": "unknown", "kept": "unknown", "part": False, "processed": False, "claims": False, "rival": False, "survivors": 0, "below": 0} | case
    kinds = ("string", "boolean", "double", "double", "string", "string", "boolean", "boolean", "boolean", "boolean", "int", "int")
    columns = [F.lit(v).cast(k) for v, k in zip(base.values(), kinds, strict=True)]
    assert one(spark, judge.need(*columns)) == want


def test_keys(spark):
    lit = F.lit
    assert one(spark, keys.query_key(lit("Öl, fein"), lit(None).cast("string"))) == "oel fein|" and one(spark, keys.query_key(lit("oel fein"), lit("A"))) == "oel fein|a"
    assert one(spark, keys.grams_key(lit("ml"), lit("Milch"))) == one(spark, keys.grams_key(lit("l"), lit("milch"))) != one(spark, keys.grams_key(lit("cup"), lit("milch")))
    none = F.array().cast("array<string>")
    assert one(spark, keys.provenance(lit(False), lit(""), none)) is None
    held = one(spark, keys.provenance_read(keys.provenance(lit(True), lit("why"), F.array(lit("lean")))))
    assert (held.reranked, held.reason, held.unmet) == (True, "why", ["lean"])
    torn = one(spark, keys.provenance_read(lit('{"reranked": tr')))
    assert torn is None or (torn.reranked, torn.reason, torn.unmet) == (None, None, None)
    assert [one(spark, keys.is_miss(lit(s))) for s in ("absent", "failed", "skipped")] == [True, False, False]


def test_retail(spark):
    products = spark.createDataFrame([(1, "Rote Linsen", 300.0), (2, "Linsen Suppe", None), (3, " ", 5.0), (4, "Rote Linsen", 310.0)], "code int, name string, kcal double")
    asked = spark.createDataFrame([("a", "rote linsen", True), ("b", "kaese", True), ("c", "linsen", False)], "qid string, text string, available boolean")
    got = [(r.qid, r.code, r.rank, r.status) for r in retail.search(asked, products, 2).orderBy("qid", "rank").collect()]
    assert got == [("a", 1, 1, "ok"), ("a", 4, 2, "ok"), ("b", None, None, "absent"), ("c", None, None, "failed")]
    codes = spark.createDataFrame([(1,), (2,), (3,), (9,)], "code int")
    assert [(r.code, r.status, r.kcal) for r in retail.barcode(codes, products).orderBy("code").collect()] == [(1, "ok", 300.0), (2, "absent", None), (3, "absent", None), (9, "absent", None)]
    why = retail.drop_reason(F.col("name"), F.col("kcal"), F.lit(None).cast("double"), F.lit("x"), F.lit("linsen"), F.lit(""), F.lit(None).cast("double"), F.lit(False), ("dish",))
    assert {r.reason: r.n for r in retail.dropped(products, why).collect()} == {"energy": 1, "name": 1} and retail.kept(products, why).count() == 2


@pytest.mark.parametrize("query,name,refused", [(["oil"], ["olive", "oil"], True), (["oil"], ["oil"], False), (["olive", "oil"], ["almond", "oil"], False), (["oil"], ["olive"], False), (["frying", "oel"], ["oil", "rape"], True)])
def test_unspecific(spark, query, name, refused):
    arrays = [F.array(*map(F.lit, x)) for x in (query, name)]
    assert one(spark, rules.unspecific_conflict(*arrays)) is refused
    table = (("rice",), ("white",))
    assert one(spark, rules.unspecific_conflict(F.array(F.lit("white"), F.lit("rice")), F.array(F.lit("rice"), F.lit("basmati")), table))


@pytest.mark.parametrize("a,b,refused", [("fresh", "dried", True), ("dried", "fresh", True), ("unknown", "dried", False), ("fresh", "fresh", False), ("fresh", "frozen", False)])
def test_stated_conflicts(spark, a, b, refused):
    assert one(spark, rules.stated_conflict(F.lit(a), F.lit(b), rules.PRESERVATION_PAIRS)) is refused
    assert one(spark, rules.processed_conflict(F.lit("fresh"), F.lit("powder"))) and not one(spark, rules.processed_conflict(F.lit("dried"), F.lit("powder")))


def test_small_rules(spark):
    assert one(spark, text.tokens_with_hyphens(F.lit("Öl-Saat, (fein)"))) == ["oel-saat", "fein"]
    assert one(spark, scoring.type_conflict(F.lit("simple"), F.lit("composite"))) and not one(spark, scoring.type_conflict(F.lit("composite"), F.lit("composite")))
    assert one(spark, replies.ownership(F.lit(1.0), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(1), F.lit(1))) == "manual"
    assert one(spark, replies.outcome(F.lit(True), F.lit(True), F.lit(False), F.lit(True), F.lit(False))) == "tags-updated"
    assert one(spark, replies.outcome(F.lit(True), F.lit(True), F.lit(True), F.lit(True), F.lit(True))) == "manual"
    assert [one(spark, linkage.chain_position(F.lit(r), F.lit("off"))) for r in ("generic", "branded")] == [5, 3]


@pytest.mark.parametrize("kcal,carbs,polyols,name,want", [(0.0, 100.0, None, "Erythrit", None), (900.0, 100.0, None, "Erythrit", "macros"), (240.0, 100.0, None, "Xylit", None), (0.0, 100.0, None, "Xylit", "macros"), (240.0, 100.0, 100.0, "sweet", None), (400.0, 100.0, None, "isomaltulose", None), (250.0, 0.0, None, "Rum", None), (250.0, 0.0, None, "drum", "macros"), (230.0, 0.0, None, "Weißwein", None)])
def test_sanity(spark, kcal, carbs, polyols, name, want):
    zero = ("protein", "fat", "saturated", "sugar", "sodium", "trans", "unsaturated", "fiber", "cholesterol")
    rows = spark.createDataFrame([(name, kcal, carbs, polyols, *[0.0] * len(zero))], "name string, kcal double, carbs double, polyols double, " + ", ".join(f"{z} double" for z in zero))
    assert rules.with_sanity(rows).first().insane == want


def test_match_quality(spark):
    schema = "slug int, idx int, food_id long, name string, matched boolean, kcal double, grams double, confidence double, unmet string, grams_estimated boolean"
    rows = [
        (1, 1, 1, "a", True, 100.0, 100.0, 0.9, None, False), (1, 2, 2, "b", True, 10.0, 100.0, 0.4, None, False),  # a small doubt
        (2, 1, 1, "a", True, 100.0, 100.0, 0.9, None, False), (2, 2, 2, "b", True, 100.0, 100.0, 0.9, "lean", False),  # a large one
        (3, 1, 1, "a", True, None, 100.0, None, None, False), (4, 1, 1, "w", True, 0.0, 100.0, 0.8, None, True), (5, 1, 1, "x", False, 100.0, 100.0, 0.9, None, False),
        (6, 1, 1, "n", True, 100.0, 100.0, None, None, False),
    ]
    recipes = spark.createDataFrame([(i,) for i in range(1, 8)], "slug int")
    got = {r.slug: (r.n, r.match_quality, r.reason, r.doubtful) for r in aggregate.match_quality(recipes, spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (2, "high", None, "b"), 2: (2, "mixed", "b: unmet, 50%", "b"), 3: (0, "low", "no energy", "a"), 4: (1, "high", None, "w"), 5: (0, "low", "no energy", ""), 6: (1, "low", "n: low-confidence, 100%", "n"), 7: (0, "low", "no energy", "")}


def most_joined(df):
    """The most rows that a join of a collected DataFrame put out."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        children = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        return max([node.metrics().apply("numOutputRows").value() if "Join" in kind else 0, *map(walk, children)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_search_of_frequent_words(spark):
    draw = random.Random(4)
    said = [(q, "oil " + " ".join(draw.choices("abcde", k=2)) + f" {q}", q % 7 > 0) for q in range(60)] + [(3, "a b", True)]
    sold = [(10 * (c % 280), "oil " + " ".join(draw.choices("abcdefg", k=draw.randrange(4)))) for c in range(300)]
    df = retail.search(spark.createDataFrame(said, "qid int, text string, available boolean"), spark.createDataFrame(sold, "code int, name string"), 4)
    got = Counter(tuple(r) for r in df.collect())
    asked = {}
    for q, words, available in said:
        if available:
            asked.setdefault(q, []).extend(set(words.split()))
    want = Counter()
    for q, _, available in said:
        shared = Counter()
        for code, name in sold:
            shared[code] += sum(asked.get(q, []).count(w) for w in set(name.split()))
        first = sorted((-n, code) for code, n in shared.items() if n)[:4]
        want.update([(q, code, i, "ok" if available else "failed") for i, (_, code) in enumerate(first, 1)] or [(q, None, None, "absent" if available else "failed")])
    assert got == want and most_joined(df) < 3000  # 60 * 300 pairs share a word


def test_match_quality_in_order(spark):
    """Of doubtful ingredients at one place with one food the first row counts; shares are of a sum in the order of the rows."""
    from itertools import permutations

    schema = "row int, slug int, idx int, food_id long, name string, matched boolean, kcal double, grams double, confidence double, unmet string, grams_estimated boolean"
    rows = [(1, 0, 1, 1, "a", True, 70.0, 100.0, 0.9, "lean", False), (2, 0, 1, 1, "a", True, 30.0, 100.0, 0.9, "lean", False)]
    want = {0: (2, "mixed", "a: unmet, 70%", "a|a")}
    for slug, order in enumerate(permutations([0.035, 0.03, 0.03, 0.08]), 1):  # 0.035 is a fifth of all, or hardly more
        every = 0.0
        for row, part in enumerate(order):
            every += part * 100.0 / 100
            rows.append((row, slug, 1 if part == 0.035 else 2, 1, "d" if part == 0.035 else "s", True, part, 100.0, 0.9, "lean" if part == 0.035 else None, False))
        want[slug] = (4, "mixed", "d: unmet, 20%", "d") if 0.035 * 100.0 / 100 > 0.2 * every else (4, "high", None, "d")
    random.Random(2).shuffle(rows)
    recipes = spark.createDataFrame([(i,) for i in want], "slug int")
    got = {r.slug: (r.n, r.match_quality, r.reason, r.doubtful) for r in aggregate.match_quality(recipes, spark.createDataFrame(rows, schema).repartition(3)).collect()}
    assert got == want and len(set(want.values())) == 3
