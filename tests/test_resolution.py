"""Scores, gates, replies and overrides against tables of cases and loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from provender.functions import text
from provender.functions.text import DESCRIPTORS, ENERGY
from provender.operators import overrides, replies, rules, scoring
from provender.sources import importers
from provender.streaming import events

WORDS = ["zwiebel", "zwiebeln", "suppe", "zwiebelsuppe", "rote", "rot", "kartoffel", "kartoffeln", "salz", "zuckerfrei", "fresh", "3"]


def stem(t):
    if len(t) <= 5:
        return t
    return t[:-2] if t.endswith("en") else t[:-1] if t[-1] in "ne" else t


def german(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return a == b or stem(a) == stem(b) or (len(short) >= 5 and long in [short + e for e in ("n", "en", "e", "s")])


def half(h, toks):
    return len(h) >= 3 and any(len(t) >= 3 and (t.startswith(h) or h.startswith(t) or german(t, h)) for t in toks)


def split(token, toks):
    for i in range(4, len(token) - 3):
        tails = [token[i + len(m) :] for m in ("", "e", "en", "er", "es", "n", "s") if token[i:].startswith(m)]
        if half(token[:i], toks) and any(half(t, toks) for t in tails):
            return True
    return False


def identity(toks):
    return [t for t in toks if len(t) >= 3 and not t[0].isdigit() and t not in DESCRIPTORS] or toks


def looped_score(q, c):
    if not q or not c:
        return 0.0
    qi, ci = identity(q), identity(c)
    if c[: len(q)] == q or ci[: len(qi)] == qi:
        return 0.85
    explains = len(ci) <= len(qi) + 1 and all(any(german(x, t) for t in ci) for x in qi)
    if explains:
        return 0.85 if german(qi[0], ci[0]) else 0.8
    if len(qi) == 1:
        heads = [h for h in (qi[0], stem(qi[0])) if len(h) >= 4]
        if len(qi[0]) >= 4 and any(t.endswith(h) and len(h) < len(t) <= len(h) + 8 for t in c for h in heads):
            return 0.6
        if split(qi[0], c) or split(qi[0], ci):
            return 0.6
    return 0.7 * len(set(qi) & set(ci)) / len(set(qi) | set(ci))


def absent(t):
    for end in ("frei", "free"):
        if t.endswith(end) and len(t) > len(end) + 1:
            stem_ = t[: -len(end)].rstrip("- ")
            return stem_ if len(stem_) >= 2 and stem_ not in ENERGY else None
    return None


def looped_adjustment(core, q, c):
    modifiers = set(q) - set(core)
    stated = sum(any(german(m, t) for t in c) for m in modifiers)
    foreign = [t for t in c if not any(german(x, t) for x in q) and not t[0].isdigit() and t not in DESCRIPTORS and absent(t) is None]
    return 8 * min(stated, len(modifiers)) - 35 * len(foreign)


@pytest.mark.parametrize(
    "q,c,want",
    [
        (["apfel", "zimt"], ["apfel", "torte", "zimt", "nuss", "kirsch"], 0.7 * 2 / 5),
        (["gruen", "haehnchenbrust"], ["haehnchen", "brustfilet", "roh"], 0.0),
        (["haehnchenbrust"], ["haehnchen", "brustfilet", "roh"], 0.6),
        (["zwiebeln"], ["speisezwiebel", "roh"], 0.6),
        (["ei"], ["teigwaren", "eifrei"], 0.0),
        (["cheddar"], ["chester", "cheddar"], 0.8),
    ],
)
def test_german_name_score(spark, q, c, want):
    assert one(spark, scoring.german_name_score(F.col("q"), F.col("c")), q=q, c=c) == pytest.approx(want)


@pytest.mark.parametrize(
    "column,want",
    [
        (lambda: text.compound_matches(F.lit("rinderhackfleisch"), F.array(F.lit("rindfleisch"), F.lit("hackfleisch"))), True),
        (lambda: text.absence_stem(F.lit("glutenfree")), "gluten"), (lambda: text.absence_stem(F.lit("ei-frei")), "ei"), (lambda: text.absence_stem(F.lit("afrei")), None), (lambda: text.absence_stem(F.lit("zuckerfrei")), None),
        (lambda: text.compound_specifier(F.lit("backerbsen"), F.lit("erbse")), "back"), (lambda: text.compound_specifier(F.lit("lightsmilch"), F.lit("milch")), None), (lambda: text.compound_specifier(F.lit("milchreis"), F.lit("milch")), None),
        (lambda: text.specifier_conflict(F.lit("gerstenmehl"), F.lit("weizenmehl")), True), (lambda: text.specifier_conflict(F.lit("basmatireis"), F.lit("reis")), False), (lambda: text.specifier_conflict(F.lit("weizenmehle"), F.lit("weizenmehl")), False),
        (lambda: text.shares_leading(F.lit("koriandergruen"), F.lit("korianderblatt")), True), (lambda: text.shares_leading(F.lit("gerstenmehl"), F.lit("weizenmehl")), False),
        (lambda: F.array_join(text.name_alternates(F.lit("Karotte/Möhre")), "|"), "Karotte|Möhre"), (lambda: F.array_join(text.name_alternates(F.lit("Chester (Cheddar) mind. 45 % Fett")), "|"), "Cheddar"), (lambda: F.array_join(text.name_alternates(F.lit("Gemüse (ohne Salz)")), "|"), "Gemüse"),
        (lambda: text.base_identity(F.lit("rote Paprika")), "Paprika"), (lambda: text.base_identity(F.lit("Paprika")), None), (lambda: text.base_identity(F.lit("grüner")), None),
        (lambda: text.lemma(F.lit("Soda-Pulver"), {"sodapulver": "natron"}), "natron"), (lambda: text.lemma(F.lit("Soda"), {"sodapulver": "natron"}), None),
        (lambda: F.array_join(text.recall_needles(F.lit("Bohnen")), ","), "bohnen,bohne,bohnenn,bohnenen,bohnene,bohnens"), (lambda: F.size(text.recall_needles(F.lit("Ei"))), 0),
        (lambda: text.dry_matter_fat(F.lit("Gouda 48,5 % Fett i. Tr.")), 48.5), (lambda: text.reconcile_fat(F.lit("Gouda 48 % Fett i. Tr."), F.lit(48.0)), None), (lambda: text.reconcile_fat(F.lit("Gouda 48 % Fett i. Tr. 30 % Fett"), F.lit(30.0)), 30.0),
        (lambda: text.parse_bool(F.lit("1")), True), (lambda: text.parse_bool(F.lit(None).cast("string")), False), (lambda: text.number_or_null(F.lit("NaN")), None), (lambda: text.number_or_null(F.lit("2.5")), 2.5), (lambda: text.two_places(F.lit(1.005 + 1e-9)), 1.01),
        (lambda: text.brand_of(F.array(F.lit(" "), F.lit("A"), F.lit("B"))), "A, B"), (lambda: text.brand_of(F.array(F.lit(""))), None),
    ],
)
def test_morphology(spark, column, want):
    assert spark.range(1).select(column().alias("x")).first().x == want


def test_morph_score_against_a_loop(spark):
    rng = random.Random(5)
    cases = [([], ["salz"]), (["salz"], [])]
    cases += [(list(q), list(c)) for q, c in itertools.product([("zwiebelsuppe",), ("suppe",), ("zwiebel",)], [("zwiebel", "suppe"), ("zwiebelsuppe",), ("rote", "zwiebeln")])]
    cases += [(rng.sample(WORDS, rng.randint(1, 3)), rng.sample(WORDS, rng.randint(1, 4))) for _ in range(400)]
    df = spark.createDataFrame([(i, q, c) for i, (q, c) in enumerate(cases)], "i int, q array<string>, c array<string>")
    got = df.select("i", scoring.german_name_score(F.col("q"), F.col("c")).alias("s"), scoring.core_adjustment(F.slice(F.col("q"), F.greatest(F.size("q"), F.lit(1)), F.lit(1)), F.col("q"), F.col("c")).alias("a")).collect()
    for row in got:
        q, c = cases[row.i]
        assert row.s == pytest.approx(looped_score(q, c)), (q, c)
        assert row.a == looped_adjustment(q[-1:], q, c), (q, c)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "gate,q,t,refused",
    [
        (scoring.core_conflict, ["onion"], ["onions", "dried"], False),
        (scoring.core_conflict, ["onion"], ["garlic"], True),
        (scoring.core_conflict, ["ab"], ["garlic"], False),
        (scoring.core_conflict, ["onion"], [], True),
        (scoring.part_of_core, ["onion", "soup"], ["soup"], True),
        (scoring.part_of_core, ["onion", "soup"], ["soup", "onions"], False),
        (scoring.part_of_core, ["soup"], ["soup"], False),
        (scoring.narrows, ["onion"], ["onions", "fresh"], False),
        (scoring.narrows, ["onion"], ["onion", "soup"], True),
        (scoring.derived_conflict, ["olive", "oil"], ["olives"], True),
        (scoring.derived_conflict, ["olive", "oil"], ["olive", "oil"], False),
        (scoring.derived_conflict, ["olive"], ["olive", "oil"], False),
        (scoring.carrier_conflict, ["olive", "oil"], ["sunflower", "oil"], True),
        (scoring.carrier_conflict, ["olive", "oil"], ["olives", "oil"], False),
        (scoring.carrier_conflict, ["oil"], ["sunflower", "oil"], False),
    ],
)
def test_gates(spark, gate, q, t, refused):
    assert one(spark, gate(F.col("q"), F.col("t")), q=q, t=t) is refused


@pytest.mark.parametrize("before,after,kept", [(["onion"], ["onions"], True), (["onion", "big"], ["onion"], True), (["onion"], ["garlic"], False), (["onion"], ["springonion"], True), ([], ["garlic"], True)])
def test_identity_is_preserved(spark, before, after, kept):
    assert one(spark, scoring.preserves_identity(F.col("q"), F.col("b"), F.col("a")), q=["onion"], b=before, a=after) is kept


@pytest.mark.parametrize("a,b,want", [("lean", "lean", 2), ("lean", "smoked", 0), ("lean", None, 0), (None, "smoked", -1), (None, "fresh", 0), (None, None, 0)])
def test_attribute_fit(spark, a, b, want):
    assert one(spark, scoring.attribute_fit(F.col("a"), F.col("b")), a=a, b=b) == want


def test_recall_of_common_and_short_needles(spark):
    names = spark.createDataFrame([(i, f"name{i:03d} common") for i in range(130)] + [(900, "abc"), (901, None)], "fid int, name string")
    needles = spark.createDataFrame([(1, "common"), (2, "e007 c"), (3, "abc"), (4, "nowhere"), (5, None)], "qid int, needle string")
    assert [tuple(r) for r in scoring.contains_recall(needles, names).collect()] == [(2, 7)]
    assert scoring.contains_recall(needles, names, 130).count() == 131


def test_spelling_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([(1, 50.0, 2, 0), (1, 50.0, 1, 1), (1, 50.0, 1, 2), (2, 9.0, 1, 0), (2, 10.0, 5, 1)], "fid int, score double, n_words int, ord int")
    assert sorted(tuple(r) for r in scoring.best_spelling(rows, ["fid"]).collect()) == [(1, 50.0, 1), (2, 10.0, 1)]


def test_override_log_against_a_loop(spark):
    rng = random.Random(3)
    log = [(i, rng.choice("abcde"), rng.choice(["set", "set", "delete"]), rng.randint(0, 9), i * 10) for i in range(60)]
    want = {}
    for seq, key, op, target, ts in log:
        if op == "delete":
            want.pop(key, None)
        else:
            want[key] = (target, want[key][1] if key in want else ts, ts)
    rng.shuffle(log)
    got = overrides.current(spark.createDataFrame(log, "seq int, override_key string, op string, target int, ts int"))
    assert {r.override_key: (r.target, r.created_at, r.updated_at) for r in got.collect()} == want


def test_exact_label_needs_exactly_one(spark):
    hits = spark.createDataFrame([(1, "A"), (1, "b"), (2, "a"), (2, "a"), (2, "c"), (3, None), (3, "z")], "g int, label string")
    assert sorted(r.g for r in replies.exact_label(hits, "g", F.col("label"), F.lit("a")).collect()) == [1, 2, 2, 2, 3, 3]


@pytest.mark.parametrize("index,sure,same,kept,verdict", [(None, 1, 0, 1, "kept-unanswered"), (0, 1, 0, 1, "none"), (9, 1, 0, 1, "kept-malformed"), (2, None, 0, 1, "kept-unsure"), (2, 0.6, 1, 1, "kept-same"), (2, 0.6, 0, 0, "kept-identity"), (2, 0.6, 0, 1, "replaced")])
def test_rerank_verdict(spark, index, sure, same, kept, verdict):
    row = spark.createDataFrame([(index, sure and float(sure), bool(same), bool(kept))], "i int, c double, s boolean, k boolean")
    assert row.select(replies.rerank_verdict(F.col("i"), F.lit(8), F.col("c"), F.col("s"), F.col("k"), F.lit(True)).alias("x")).first().x == verdict


def test_empty_tables(spark):
    log = spark.createDataFrame([], "seq int, override_key string, op string, target int, ts int")
    assert overrides.current(log).count() == 0
    names = spark.createDataFrame([], "fid int, name string")
    assert scoring.contains_recall(names.selectExpr("fid AS qid", "name AS needle"), names).count() == 0


@pytest.mark.parametrize(
    "q,n,reason",
    [
        ("Ginger", "ginger ale", "drink"),
        ("ginger ale", "Ginger Ale", None),
        ("oil", "olive oil", "unspecific"),
        ("Öl", "Öl", None),
        ("oil", "vegetable oil", None),
        ("olive oil", "oil, almond", None),
        ("apple", "apple", None),
        ("gingerbread", "ginger ale", None),
    ],
)
def test_mismatch(spark, q, n, reason):
    assert one(spark, rules.mismatch(F.col("q"), F.col("n")), q=q, n=n) == reason


def test_parts_are_ambiguous_in_a_set(spark):
    rows = spark.createDataFrame(
        [(1, ["dill"], ["dill", "seed"]), (1, ["dill"], ["dill", "leaf"]), (2, ["cumin"], ["cumin", "seed"]), (2, ["cumin"], ["bean", "leaf"]), (3, ["dill", "seed"], ["dill", "seed"]), (3, ["dill", "seed"], ["dill", "seed", "leaf"])],
        "g int, q array<string>, t array<string>",
    )
    got = rules.part_conflict(rows, "g", F.col("q"), F.col("t"))
    assert {(r.g, r.part_conflict) for r in got.collect()} == {(1, True), (2, False), (3, False)}


@pytest.mark.parametrize("name,brand,want", [("Acme Rye Bread", "acme", True), ("Acmes Rye Bread", "acme", False), ("Rye Bread", "", False), ("Rye Bread", None, False)])
def test_exact_branded_name(spark, name, brand, want):
    assert one(spark, rules.exact_branded_name(F.lit(True), F.col("n"), F.col("n"), F.col("b")), n=name, b=brand) is want


def test_wide_table(spark):
    sheet = spark.createDataFrame([("B1", "Brot", "1,5", "200", "-"), ("X2", "Eintopf", "tr", "", None)], ["code", "name", "FAT fett [g]", "NA natrium [mg]", "ENER energie"])
    prefixes = {"fat": "fat", "sodium": "NA ", "kcal": "ENER"}
    got = importers.wide_table(sheet, "code", "name", prefixes, {"sodium": 0.001}).collect()
    assert [tuple(r) for r in got] == [("B1", "Brot", "simple", 1.5, 0.2, None), ("X2", "Eintopf", "composite", 0.0, None, None)]
    with pytest.raises(ValueError):
        importers.resolved_columns(["FAT a", "FAT b"], {"fat": "FAT"})
    wrong = spark.createDataFrame([("B1", "Brot", "much")], ["code", "name", "FAT"])
    with pytest.raises(Exception, match="not a number"):
        importers.wide_table(wrong, "code", "name", {"fat": "FAT"}, {}).collect()


def test_reference_table(spark):
    foods = spark.createDataFrame([("dried dill seed", 10.0, 3.0, None), ("raw egg", 1.0, 2.0, 0.5), ("", None, None, None)], "name string, fat double, saturated double, trans double")
    got = importers.reference_table(foods, 1).collect()
    assert [(r.state, r.part, r.unsaturated) for r in got] == [("dried", "seed", 7.0), ("raw", None, 0.0), ("unknown", None, None)]
    with pytest.raises(ValueError):
        importers.reference_table(foods, 2)


def test_queue_leaves_no_slug_twice(spark):
    pending = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("d", 5)], "slug string, seq int")
    none = spark.createDataFrame([], "slug string")
    assert sorted(tuple(r) for r in events.runnable(pending, none).collect()) == [("a", 1), ("b", 3)]
    assert [tuple(r) for r in events.runnable(pending, spark.createDataFrame([("a",)], "slug string")).collect()] == [("b", 3)]
    assert events.runnable(pending, spark.createDataFrame([("x",), ("y",)], "slug string")).count() == 0


def test_keys_are_forgotten_after_their_time(spark, tmp_path):
    schema = "slug string, ts timestamp"
    for i, rows in enumerate([[("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:30:00")], [("b", "2024-01-01 09:00:00")], [("a", "2024-01-01 09:30:00")]]):
        df = spark.createDataFrame(rows, "slug string, ts string").select("slug", F.col("ts").cast("timestamp").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = events.once_within(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["slug"], "1 hour")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.slug for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "a", "b"]
