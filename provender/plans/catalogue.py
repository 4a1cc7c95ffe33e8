"""Named queries of the engine and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provender.functions import nutrition, similarity, text
from provender.operators import aggregate, judge, linkage, rules, state
from provender.sources import domain, importers
from provender.sources.domain import FOOD, FOODS_SQL, INGREDIENTS_SQL, NUTRIENTS, RECIPES_SQL, foods, ingredients, read, recipes, select_sql
from provender.streaming import events as stream

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "recipe_totals"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(x: str, digits: int = 2, rounded=nutrition.sql_round) -> str:
    return rounded(f"CAST({x} AS DOUBLE)", digits)


# SQL of the text functions, for engines with lambdas written `lambda x: ..`.
def ng(x: str) -> str:
    return f"replace(replace(replace(replace(lower({x}), 'ß', 'ss'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')"


def nid(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({ng(x)}, '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def tk(x: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace({ng(f"coalesce({x}, '')")}, '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"


def words(items) -> str:
    return ", ".join(f"'{w}'" for w in items)


def itk(x: str) -> str:
    kept = f"list_filter({tk(x)}, lambda y: length(y) >= 3 AND NOT regexp_matches(y, '^[0-9]') AND y NOT IN ({words(text.DESCRIPTORS)}))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {tk(x)} END"


def stem(x: str) -> str:
    cut = f"CASE WHEN {x} LIKE '%en' AND length({x}) >= 6 THEN 2 WHEN {x} LIKE '%n' OR {x} LIKE '%e' THEN 1 ELSE 0 END"
    return f"CASE WHEN length({x}) <= 5 THEN {x} ELSE substr({x}, 1, length({x}) - ({cut})) END"


def first_state(t: str) -> str:
    return "CASE " + " ".join(f"WHEN list_has_any({t}, [{words(ws)}]) THEN '{v}'" for v, ws in text.STATES) + " ELSE 'unknown' END"


def german_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").filter("lang = 'de'")
    return docs.select(F.explode(text.tokens(F.col("text"))).alias("token")).distinct()


GERMAN = f"de AS (SELECT DISTINCT unnest({tk('text')}) AS token FROM documents WHERE lang = 'de')"
NAMES = f"names AS (SELECT min(food_id) AS fid, name, {itk('name')} AS toks FROM foods GROUP BY name)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foods(spark, sf_dir).groupBy("name").agg(F.min("food_id").alias("fid")).withColumn("toks", linkage.identity(F.col("name")))


# Totals and grades.
_TOTALS = ", ".join(f"{e} AS {n}" for n, e in aggregate.TOTALS.items())
_GRADED = f"""{INGREDIENTS_SQL}, {RECIPES_SQL}, t AS (SELECT slug AS s, {_TOTALS} FROM ing GROUP BY slug),
a AS (SELECT r.*, t.*, coalesce(n_matched, 0) AS nm, coalesce(n_unmatched, 0) AS nu FROM recipes r LEFT JOIN t ON t.s = r.slug),
b AS (SELECT *, {nutrition.completeness('nu', 'nm', 'resolved_weight', 'known_weight')} AS completeness, {nutrition.completeness_reason('nu', 'nm', 'resolved_weight', 'known_weight').format(text='VARCHAR')} AS completeness_reason, {nutrition.evidence('nm', 'estimated_kcal', 'abs_kcal')} AS evidence FROM a),
c AS (SELECT *, {', '.join(f"CASE WHEN completeness = 'withheld' OR servings IS NULL OR servings <= 0 THEN NULL ELSE {nutrition.half_up(f'{n}_total / servings') if n not in aggregate.FRACTIONS else f'{n}_total / servings'} END AS {n}_serving" for n in NUTRIENTS)} FROM b),
graded AS (SELECT *, {nutrition.calorie_tag('kcal_serving')} AS calorie_tag, {nutrition.digest_tag('kcal_serving', 'fat_serving')} AS digest_tag FROM c)"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.graded(ingredients(spark, sf_dir), recipes(spark, sf_dir))


def mg(x: str, rounded) -> str:
    """Whole milligrams; rounded before halves go up, as sums differ in their last digits."""
    return f"CAST(floor({rounded(f'CAST({x} AS DOUBLE) * 1000', 4)} + 0.5) AS BIGINT)"


def _of_graded(name: str, columns) -> None:
    """columns: the list of columns, by the engine's rounding."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graded(spark, sf_dir).selectExpr(*columns(nutrition.spark_round))

    run.__name__ = name
    query(f"WITH {_GRADED} SELECT {', '.join(columns(nutrition.sql_round)).replace('n_matched', 'nm').replace('n_unmatched', 'nu')} FROM graded")(run)


_of_graded("recipe_totals", lambda rd: ["slug", f"{r('kcal_total', 2, rd)} AS kcal_total", f"{r('known_weight', 2, rd)} AS known_weight", "kcal_serving", "fat_serving", "calorie_tag", "digest_tag"])
_of_graded("completeness_status", lambda rd: ["slug", "CAST(n_matched AS BIGINT) AS matched_rows", "completeness", "completeness_reason", f"{r('resolved_weight', 2, rd)} AS resolved_weight"])
_of_graded("serving_nutrients", lambda rd: ["slug", *[f"{n}_serving AS {n}" if n not in aggregate.FRACTIONS else f"{mg(f'{n}_serving', rd)} AS {n}_mg" for n in NUTRIENTS]])
_of_graded("evidence_shares", lambda rd: ["slug", "evidence", f"{r('CASE WHEN abs_kcal > 0 THEN coalesce(estimated_kcal, 0) / abs_kcal END', 4, rd)} AS estimated_share"])
_of_graded("calorie_tags", lambda rd: ["slug", "kcal_serving", "calorie_tag"])
_of_graded("digest_tags", lambda rd: ["slug", "digest_tag"])


_RISK = "CASE WHEN matched THEN CASE WHEN unmet IS NOT NULL THEN 'unmet' WHEN coalesce(confidence, 0) < 0.6 THEN 'low-confidence' WHEN grams_estimated THEN 'weight-estimated' END END"


@query(f"""WITH {INGREDIENTS_SQL}, {RECIPES_SQL}, m AS (SELECT *, CASE WHEN matched THEN CAST(abs(kcal * grams / 100) AS DOUBLE) END AS part, CAST(coalesce(confidence, 0) AS DOUBLE) AS sure, {_RISK} AS risk FROM ing),
s AS (SELECT slug, sum(part) AS every, sum(sure * part) AS wc, avg(sure) FILTER (WHERE part IS NOT NULL) AS mean, count(part) AS n, string_agg(name, '|' ORDER BY idx, food_id) FILTER (WHERE risk IS NOT NULL) AS doubtful FROM m GROUP BY slug),
d AS (SELECT m.slug, arg_min(name || ': ' || risk || ', ' || CAST(CAST(floor(round(part / every * 100, 6) + 0.5) AS BIGINT) AS VARCHAR) || '%', (idx, food_id)) AS doubt FROM m JOIN s ON s.slug = m.slug WHERE risk IS NOT NULL AND every > 0 AND part > 0.2 * every GROUP BY m.slug),
q AS (SELECT r.slug, coalesce(n, 0) AS n, doubt, coalesce(doubtful, '') AS doubtful, round(CASE WHEN every > 0 THEN wc / every ELSE mean END, 9) AS w FROM recipes r LEFT JOIN s ON s.slug = r.slug LEFT JOIN d ON d.slug = r.slug)
SELECT slug, n, CASE WHEN n = 0 THEN 'low' WHEN doubt IS NOT NULL THEN CASE WHEN w < 0.55 THEN 'low' ELSE 'mixed' END WHEN w >= 0.75 THEN 'high' WHEN w < 0.55 THEN 'low' ELSE 'mixed' END AS match_quality,
CASE WHEN n = 0 THEN 'no energy' WHEN doubt IS NOT NULL THEN doubt WHEN w < 0.75 THEN 'mean confidence' END AS reason, doubtful FROM q""")
def match_quality(spark, sf_dir):
    return aggregate.match_quality(recipes(spark, sf_dir), ingredients(spark, sf_dir))


@query(f"""WITH {INGREDIENTS_SQL}, {RECIPES_SQL}, l AS (SELECT slug, string_agg(name, '|' ORDER BY idx, food_id) FILTER (WHERE matched) AS m, string_agg(name, '|' ORDER BY idx, food_id) FILTER (WHERE NOT matched) AS u FROM ing GROUP BY slug)
SELECT r.slug, coalesce(m, '') AS matched, coalesce(u, '') AS unmatched FROM recipes r LEFT JOIN l ON l.slug = r.slug""")
def matched_lists(spark, sf_dir):
    return aggregate.listed(recipes(spark, sf_dir), ingredients(spark, sf_dir))


@query(f"WITH {INGREDIENTS_SQL} SELECT unit, count(*) AS n, count(grams) AS n_grams, {r('sum(grams)')} AS grams FROM ing GROUP BY unit")
def unit_grams(spark, sf_dir):
    return ingredients(spark, sf_dir).groupBy("unit").agg(F.count("*").alias("n"), F.count("grams").alias("n_grams"), F.round(F.sum("grams").cast("double"), 2).alias("grams"))


# Text.
@query(f"SELECT doc_id, md5({ng('text')}) AS german, md5({nid('text')}) AS identity FROM documents")
def normalize_identity(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_german(t)).alias("german"), F.md5(text.normalize_identity(t)).alias("identity"))


@query("SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'))) AS folded FROM documents")
def normalize_ascii(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_ascii(F.col("text"))).alias("folded"))


@query(f"SELECT doc_id, len({tk('text')}) AS n_tokens, len({itk('text')}) AS n_identity, md5(array_to_string(list_sort({itk('text')}), ' ')) AS identity_key FROM documents")
def tokens(spark, sf_dir):
    t = text.tokens(F.col("text"))
    rows = read(spark, sf_dir, "documents").select("doc_id", t.alias("t")).withColumn("i", text.identity_tokens(F.col("t")))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size("i").cast("long").alias("n_identity"), F.md5(text.identity_key(F.col("i"))).alias("identity_key"))


@query(f"WITH {GERMAN} SELECT token, {stem('token')} AS stem FROM de")
def german_stem(spark, sf_dir):
    return german_tokens(spark, sf_dir).select("token", text.german_stem(F.col("token")).alias("stem"))


@query(f"WITH {GERMAN}, f AS (SELECT token, CASE WHEN {stem('token')} = token THEN token ELSE {stem('token')} END AS root FROM de) SELECT a.token AS token, b.token AS plural FROM f a JOIN f b ON a.root = b.root AND length(a.token) < length(b.token)")
def plural_match(spark, sf_dir):
    a = german_tokens(spark, sf_dir).withColumn("root", text.german_stem(F.col("token")))
    b = a.select(F.col("token").alias("plural"), "root")
    return a.join(b, "root").filter(F.length("token") < F.length("plural")).filter(text.german_match(F.col("token"), F.col("plural"))).select("token", "plural")


@query(f"WITH {GERMAN} SELECT token, CASE WHEN length(token) >= 8 THEN len(list_filter(range(4, CAST(length(token) AS BIGINT) - 3), lambda i: true)) ELSE 0 END AS n, CASE WHEN length(token) >= 8 THEN substr(token, 1, 4) END AS head, CASE WHEN length(token) >= 8 THEN substr(token, 5) END AS tail FROM de")
def compound_segments(spark, sf_dir):
    seg = text.compound_segments(F.col("token"))
    return german_tokens(spark, sf_dir).select("token", seg.alias("s")).select("token", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0))["head"].alias("head"), F.get("s", F.lit(0))["tail"].alias("tail"))


def _fam(t: str, table) -> str:
    return "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN list_has_any({t}, [{words(w)}]) THEN '{n}' END" for n, w in table) + "], lambda x: x IS NOT NULL)), ',')"


@query(f"WITH {FOODS_SQL}, n AS (SELECT DISTINCT name, {tk('name')} AS t FROM foods) SELECT name, {first_state('t')} AS state, CASE WHEN {first_state('t')} <> 'unknown' THEN {first_state('t')} ELSE 'unknown' END AS reconciled, {_fam('t', text.FAMILIES)} AS families, {_fam('t', text.DERIVED)} AS derived, coalesce({', '.join(f"CASE WHEN list_contains(t, '{p}') THEN '{p}' END" for p in text.PARTS)}, '-') AS part FROM n")
def infer_attributes(spark, sf_dir):
    t = F.col("t")
    rows = foods(spark, sf_dir).select("name").distinct().withColumn("t", text.tokens(F.col("name")))
    return rows.select("name", text.state_of(t).alias("state"), text.reconcile_state(F.lit("cooked"), t).alias("reconciled"), F.array_join(text.classes_named(t, text.FAMILIES), ",").alias("families"), F.array_join(text.classes_named(t, text.DERIVED), ",").alias("derived"), F.coalesce(text.first_part(t), F.lit("-")).alias("part"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '([0-9]+(?:[.,][0-9]+)?)\s*%', 1)) AS n_percentages, CASE WHEN regexp_matches(html, '[0-9]+\s*[-–]\s*[0-9]+') THEN CAST(floor((TRY_CAST(regexp_extract(html, '([0-9]+)\s*[-–]\s*([0-9]+)', 1) AS DOUBLE) + TRY_CAST(regexp_extract(html, '([0-9]+)\s*[-–]\s*([0-9]+)', 2) AS DOUBLE)) / 2 + 0.5) AS DOUBLE) ELSE TRY_CAST(replace(regexp_extract(html, '([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS DOUBLE) END AS yield FROM pages")
def percentages(spark, sf_dir):
    html = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", F.size(text.percentages(html)).cast("long").alias("n_percentages"), text.parse_yield(html).alias("yield"))


@query(f"WITH {RECIPES_SQL} SELECT slug, sha256(concat_ws('|', CAST(slug AS VARCHAR), coalesce(strategy_tag, '-'), coalesce(CAST(household AS VARCHAR), '-'))) AS fingerprint, concat_ws('|', coalesce(status, '-'), coalesce(strategy_tag, '-')) AS context_key FROM recipes")
def fingerprints(spark, sf_dir):
    key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("-")) for c in ("status", "strategy_tag")])
    return recipes(spark, sf_dir).select("slug", text.canonical_hash(F.col("slug"), F.col("strategy_tag"), F.col("household")).alias("fingerprint"), key.alias("context_key"))


@query(rf"WITH {FOODS_SQL} SELECT DISTINCT name, array_to_string(list_sort(list_distinct([name, name || 's', name || 'es', regexp_replace(name, 's$', ''), regexp_replace(name, 'es$', '')])), ',') AS spellings FROM foods")
def scalar_misc(spark, sf_dir):
    return foods(spark, sf_dir).select("name").distinct().select("name", F.array_join(text.english_spellings(F.col("name")), ",").alias("spellings"))


# Similarity, gates, plausibility.
_JACCARD = "CASE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0.0 ELSE CAST(len(list_intersect(a.toks, b.toks)) AS DOUBLE) / len(list_distinct(list_concat(a.toks, b.toks))) END"
_HELD = "CASE WHEN contains(array_to_string(a.toks, ' '), array_to_string(b.toks, ' ')) OR contains(array_to_string(b.toks, ' '), array_to_string(a.toks, ' ')) THEN 0.5 ELSE 0.0 END"
_BLOCK = "blocked AS (SELECT DISTINCT x.fid AS qid, y.fid AS fid FROM (SELECT fid, unnest([t, t || 's', t || 'es', regexp_replace(t, 's$', ''), regexp_replace(t, 'es$', '')]) AS t FROM (SELECT fid, unnest(toks) AS t FROM names)) x JOIN (SELECT fid, unnest(toks) AS t FROM names) y ON x.t = y.t)"


def blocked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = names(spark, sf_dir)
    return n, linkage.blocking(n.withColumnRenamed("fid", "qid"), n)


@query(f"WITH {FOODS_SQL}, {NAMES}, {_BLOCK} SELECT qid, fid FROM blocked")
def blocking_candidates(spark, sf_dir):
    return blocked(spark, sf_dir)[1]


def pairs(spark, sf_dir) -> DataFrame:
    n, b = blocked(spark, sf_dir)
    return b.join(n.select(F.col("fid").alias("qid"), F.col("toks").alias("qtoks"), F.col("name").alias("qname")), "qid").join(n, "fid")


@query(f"WITH {FOODS_SQL}, {NAMES}, {_BLOCK} SELECT qid, k.fid, round({_JACCARD}, 6) AS jaccard, round(greatest({_JACCARD}, {_HELD}), 6) AS similarity, list_slice(b.toks, 1, greatest(len(a.toks), 1)) = a.toks AS prefix FROM blocked k JOIN names a ON a.fid = qid JOIN names b ON b.fid = k.fid")
def name_similarity(spark, sf_dir):
    q, f = F.col("qtoks"), F.col("toks")
    return pairs(spark, sf_dir).select("qid", "fid", F.round(similarity.jaccard(q, f), 6).alias("jaccard"), F.round(similarity.name_similarity(q, f), 6).alias("similarity"), similarity.ordered_prefix(q, f).alias("prefix"))


def duck_matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


_LABEL = "concat(name, CASE food_id % 16 WHEN 0 THEN ' xylit' WHEN 1 THEN ' Rum' WHEN 2 THEN ' drum' WHEN 3 THEN ' salt' WHEN 4 THEN ' Rotwein' WHEN 5 THEN ' Erythritol' WHEN 6 THEN ' salted' WHEN 7 THEN ' isomaltulose' ELSE '' END)"
_SANE = f"sane AS (SELECT *, {nutrition.implausible()} AS insane FROM (SELECT *, {select_sql(nutrition.facts_of_name(_LABEL, duck_matches))} FROM foods))"


@query(f"WITH {FOODS_SQL}, {_SANE} SELECT food_id, coalesce(insane, 'ok') AS reason FROM sane")
def sanity_check(spark, sf_dir):
    return rules.with_sanity(foods(spark, sf_dir), _LABEL).select("food_id", F.coalesce("insane", F.lit("ok")).alias("reason"))


@query(f"""WITH {FOODS_SQL}, n AS (SELECT food_id AS qid, fat, kcal, tier, lead(food_id) OVER w AS fid, lead(fat) OVER w AS f2, lead(kcal) OVER w AS k2, lead(tier) OVER w AS t2 FROM foods WINDOW w AS (PARTITION BY brand, category ORDER BY food_id))
SELECT qid, fid, abs(fat - f2) > greatest(2.0, fat * 0.15) AS fat_conflict, abs(fat - f2) > 0.5 AND abs(fat - f2) <= greatest(2.0, fat * 0.15) AS fat_close, coalesce(abs(kcal - k2) >= 30 AND abs(kcal - k2) > 0.25 * greatest(abs(kcal), abs(k2)), false) AS differs, tier <> t2 AND tier <> 'Other' AND t2 <> 'Other' AS state_conflict FROM n WHERE fid IS NOT NULL""")
def attribute_gates(spark, sf_dir):
    """Each record against the next one of its brand and category: as many pairs as records."""
    w = Window.partitionBy("brand", "category").orderBy("food_id")
    nexts = {n: F.lead(c).over(w) for n, c in (("fid", "food_id"), ("f2", "fat"), ("k2", "kcal"), ("t2", "tier"))}
    both = foods(spark, sf_dir).withColumns(nexts).filter("fid IS NOT NULL")
    state_conflict = (F.col("tier") != F.col("t2")) & (F.col("tier") != "Other") & (F.col("t2") != "Other")
    fat, kcal = (F.col("fat").cast("double"), F.col("f2").cast("double")), (F.col("kcal").cast("double"), F.col("k2").cast("double"))
    return both.select(F.col("food_id").alias("qid"), "fid", similarity.fat_conflict(*fat).alias("fat_conflict"), judge.fat_approximate(*fat).alias("fat_close"), similarity.materially_different(*kcal).alias("differs"), state_conflict.alias("state_conflict"))


_SCORED = f"{FOODS_SQL}, {NAMES}, {_BLOCK}, scored AS (SELECT qid, k.fid, 60 * greatest({_JACCARD}, {_HELD}) + CASE g.tier WHEN 'Foundation' THEN 20 WHEN 'SR Legacy' THEN 15 ELSE 0 END + CASE WHEN g.kcal IS NOT NULL THEN 15 ELSE -50 END AS score, g.kcal AS kcal FROM blocked k JOIN names a ON a.fid = qid JOIN names b ON b.fid = k.fid JOIN foods g ON g.food_id = k.fid)"


def scored(spark, sf_dir) -> DataFrame:
    rows = pairs(spark, sf_dir).join(foods(spark, sf_dir).select(F.col("food_id").alias("fid"), "tier", "kcal"), "fid")
    return rows.select("qid", "fid", "kcal", linkage.generic_score(F.col("qtoks"), F.col("toks"), F.col("tier"), F.col("kcal")).alias("score"))


@query(f"WITH {_SCORED} SELECT qid, fid, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, fid) AS n FROM scored) WHERE n = 1 AND score >= 30 AND kcal IS NOT NULL")
def rank_top1(spark, sf_dir):
    best = linkage.top_k(scored(spark, sf_dir), "qid", [F.desc(F.round("score", 6)), F.asc("fid")])
    return best.filter("score >= 30 AND kcal IS NOT NULL").select("qid", "fid", F.round("score", 4).alias("score"))


@query(f"WITH {_SCORED} SELECT qid, fid, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, fid) AS n FROM scored) WHERE n <= 8")
def rank_topk(spark, sf_dir):
    return linkage.top_k(scored(spark, sf_dir), "qid", [F.desc(F.round("score", 6)), F.asc("fid")], 8).select("qid", "fid", "rank")


_GROUPS = f"{FOODS_SQL}, grp AS (SELECT brand AS gid, food_id AS fid, name, kcal, tier, brand, category, protein, carbs, fat, CAST((food_id * 7) % 100 AS DOUBLE) AS score, food_id % 5 AS fit, CASE food_id % 4 WHEN 0 THEN 'bls' WHEN 1 THEN 'usda-local' WHEN 2 THEN 'off' ELSE 'own-recipe' END AS provider, CASE food_id % 3 WHEN 0 THEN 'property' WHEN 1 THEN 'retail' ELSE 'plain' END AS kind FROM foods)"


def groups(spark, sf_dir) -> DataFrame:
    provider = F.expr("CASE food_id % 4 WHEN 0 THEN 'bls' WHEN 1 THEN 'usda-local' WHEN 2 THEN 'off' ELSE 'own-recipe' END")
    kind = F.expr("CASE food_id % 3 WHEN 0 THEN 'property' WHEN 1 THEN 'retail' ELSE 'plain' END")
    return foods(spark, sf_dir).select(F.col("brand").alias("gid"), F.col("food_id").alias("fid"), "name", "kcal", "tier", "brand", "category", "protein", "carbs", "fat", F.expr("CAST((food_id * 7) % 100 AS DOUBLE)").alias("score"), F.expr("food_id % 5").alias("fit"), provider.alias("provider"), kind.alias("kind"))


@query(f"WITH {_GROUPS}, t AS (SELECT *, max(score) OVER (PARTITION BY gid) AS top FROM grp WHERE score >= 50) SELECT gid, fid, score FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY fit DESC, score DESC, fid) AS n FROM t WHERE score >= top - 20) WHERE n = 1")
def band_pick(spark, sf_dir):
    return linkage.band_pick(groups(spark, sf_dir)).select("gid", "fid", "score")


@query(f"WITH {_GROUPS} SELECT gid, arg_min(fid, (fit, fid)) AS pick, min(fit) AS variant, max(score) AS best FROM grp GROUP BY gid")
def variant_first_hit(spark, sf_dir):
    hits = groups(spark, sf_dir).select(F.col("gid").alias("qid"), "fid", F.col("fit").alias("variant"), "score")
    return linkage.first_variant(hits).select(F.col("qid").alias("gid"), "pick", "variant", "best")


_TRUST = "CASE provider WHEN 'own-recipe' THEN 1 WHEN 'bls' THEN 2 WHEN 'usda-local' THEN 3 ELSE 4 END, CASE tier WHEN 'Foundation' THEN 1 WHEN 'SR Legacy' THEN 2 ELSE 3 END, fid"
_ORDERED = f"{_GROUPS}, cand AS (SELECT *, row_number() OVER (PARTITION BY gid, lower(name), kcal ORDER BY score DESC, {_TRUST}) AS copy FROM grp), ordered AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY score DESC, {_TRUST}) AS place FROM cand WHERE copy = 1)"


@query(f"WITH {_ORDERED} SELECT gid, fid, CAST(place AS INTEGER) AS place FROM ordered")
def order_candidates(spark, sf_dir):
    return linkage.ordered_candidates(groups(spark, sf_dir)).select("gid", "fid", "place")


_SHOWN = " || ':' || ".join(f"coalesce({c}, '-')" if c in ("name", "provider", "tier", "brand", "category") else "'-'" if c in ("state", "form", "preservation") else f"coalesce(CAST({c} AS VARCHAR), '-')" for c in linkage.SHOWN)


@query(f"WITH {_ORDERED} SELECT gid, sha256(string_agg({_SHOWN}, '|' ORDER BY place)) AS fingerprint FROM ordered GROUP BY gid")
def pool_fingerprint(spark, sf_dir):
    return linkage.fingerprint(linkage.ordered_candidates(groups(spark, sf_dir)))


@query(f"WITH {_ORDERED}, k AS (SELECT *, row_number() OVER (PARTITION BY gid, kind ORDER BY place) AS nth FROM ordered), c AS (SELECT *, CASE WHEN kind = 'property' AND nth <= 6 OR kind = 'retail' AND nth <= 3 THEN 1 ELSE 0 END AS reserved FROM k) SELECT gid, fid FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY reserved DESC, place) AS n FROM c) WHERE n <= 12")
def shortlist(spark, sf_dir):
    return linkage.shortlist(linkage.ordered_candidates(groups(spark, sf_dir))).select("gid", "fid")


_PLACES = "CASE provider " + " ".join(f"WHEN '{p}' THEN CASE route WHEN 'generic' THEN {g} ELSE {b} END" for p, g, b in (("own-recipe", 1, 1), ("override", 2, 2), ("bls", 3, 4), ("usda-local", 4, 5), ("off", 5, 3), ("llm-nutrient", 6, 6))) + " END"
_CHAIN = {
    "gid": "concat(brand, '/', category, '/', CAST(food_id % 40 AS {text}))",
    "route": "CASE WHEN food_id % 40 % 3 = 0 THEN 'branded' ELSE 'generic' END",
    "provider": "CASE (food_id * 7 + p_size) % 6 WHEN 0 THEN 'bls' WHEN 1 THEN 'usda-local' WHEN 2 THEN 'off' WHEN 3 THEN 'own-recipe' WHEN 4 THEN 'override' ELSE 'llm-nutrient' END",
    "refused": "food_id % 11 = 0 OR kcal IS NULL",
    "forced": "CASE WHEN food_id % 40 % 4 = 0 THEN -1 END",
}


@query(f"""WITH f AS (SELECT *, p_size FROM (SELECT {select_sql(FOOD)}, p_size FROM part)), k AS (SELECT food_id AS fid, {", ".join(f"{e.format(text='VARCHAR')} AS {c}" for c, e in _CHAIN.items())},
CASE food_id % 5 WHEN 0 THEN ['lean'] WHEN 1 THEN ['lean', 'smoked'] ELSE [] END AS unmet, CASE food_id % 3 WHEN 0 THEN ['lean'] WHEN 1 THEN ['lean', 'smoked'] ELSE [] END AS stated FROM f),
g AS (SELECT gid, max(forced) AS forced, max(CASE route WHEN 'generic' THEN 3 ELSE 4 END) AS entry FROM k GROUP BY gid),
v AS (SELECT k.*, {_PLACES} AS pos, g.entry, g.forced AS gforced FROM k JOIN g ON g.gid = k.gid WHERE NOT coalesce(refused, false)),
r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY pos, fid) AS nth FROM v WHERE gforced IS NULL OR pos < entry),
one AS (SELECT gid, fid AS first, unmet AS lacks FROM r WHERE nth = 1),
two AS (SELECT r.gid, arg_min(fid, nth) AS later FROM r JOIN one ON one.gid = r.gid WHERE len(unmet) = 0 AND (len(lacks) = 0 OR len(list_filter(lacks, lambda x: NOT list_contains(stated, x))) = 0) GROUP BY r.gid)
SELECT g.gid, CAST(CASE WHEN later IS NOT NULL THEN later WHEN g.forced IS NOT NULL THEN g.forced ELSE first END AS BIGINT) AS picked FROM g LEFT JOIN one ON one.gid = g.gid LEFT JOIN two ON two.gid = g.gid""")
def chain_resolve(spark, sf_dir):
    """The chain of providers, by route: the SQL looks for the first whole answer before the preference enters, and for what is held."""
    rows = read(spark, sf_dir, "part").selectExpr("p_size", *[f"{e} AS {c}" for c, e in FOOD.items()])
    k = rows.selectExpr("food_id AS fid", *[f"{e.format(text='STRING')} AS {c}" for c, e in _CHAIN.items()], "CASE food_id % 5 WHEN 0 THEN array('lean') WHEN 1 THEN array('lean', 'smoked') ELSE array() END AS unmet", "CASE food_id % 3 WHEN 0 THEN array('lean') WHEN 1 THEN array('lean', 'smoked') ELSE array() END AS stated")
    k = k.withColumns({"pos": linkage.chain_position(F.col("route"), F.col("provider")), "entry": linkage.enters_at(F.col("route")), "forced": F.col("forced").cast("bigint")})
    return linkage.chain(k)


_VOCABULARY = f"{FOODS_SQL}, voc AS (SELECT food_id AS vid, {nid("name || ' ' || brand || ' ' || category")} AS alias, CASE food_id % 5 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE 'en' END AS lang FROM foods)"


def vocabulary(spark, sf_dir) -> DataFrame:
    lang = F.expr("CASE food_id % 5 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE 'en' END")
    return foods(spark, sf_dir).select(F.col("food_id").alias("vid"), text.normalize_identity(F.concat_ws(" ", "name", "brand", "category")).alias("alias"), lang.alias("lang"))


@query(f"WITH {_VOCABULARY}, u AS (SELECT alias, min(vid) AS vid FROM voc WHERE lang <> 'fr' GROUP BY alias HAVING count(DISTINCT lang) = 1), n AS (SELECT food_id, {nid("name || ' ' || brand || ' ' || category")} AS alias FROM foods) SELECT food_id, vid FROM n LEFT JOIN u ON u.alias = n.alias")
def vocabulary_lookup(spark, sf_dir):
    valid = importers.validated(vocabulary(spark, sf_dir)).filter("reject_reason IS NULL").drop("reject_reason")
    every = foods(spark, sf_dir).select("food_id", text.normalize_identity(F.concat_ws(" ", "name", "brand", "category")).alias("alias"))
    return every.join(linkage.unambiguous(valid).select("alias", "vid"), "alias", "left").select("food_id", "vid")


@query(f"WITH {_VOCABULARY} SELECT CASE WHEN lang = 'fr' THEN 'language' ELSE 'ok' END AS reason, count(*) AS n FROM voc GROUP BY 1")
def vocabulary_conflicts(spark, sf_dir):
    return importers.validated(vocabulary(spark, sf_dir)).groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {FOODS_SQL}, {RECIPES_SQL}, o AS (SELECT 'v1|' || name || '|' || brand AS override_key, max(food_id) AS target FROM foods WHERE food_id % 7 = 0 GROUP BY 1) SELECT food_id, coalesce(target, food_id) AS resolved, target IS NOT NULL AS overridden FROM foods LEFT JOIN o ON o.override_key = 'v1|' || name || '|' || brand")
def override_resolve(spark, sf_dir):
    key = F.concat_ws("|", F.lit("v1"), "name", "brand")
    rows = foods(spark, sf_dir).withColumn("key", key)
    overrides = rows.filter("food_id % 7 = 0").groupBy("key").agg(F.max("food_id").alias("target"))
    return rows.join(overrides, "key", "left").select("food_id", F.coalesce("target", "food_id").alias("resolved"), F.col("target").isNotNull().alias("overridden"))


@query(f"WITH {RECIPES_SQL}, a AS (SELECT slug, (slug % 400) * 1.0 AS age, household % 3 <> 0 AS found FROM recipes) SELECT slug, CASE WHEN age < 24 THEN CASE WHEN found THEN 'fresh' ELSE 'absent' END WHEN age < 192 THEN CASE WHEN found THEN 'stale' ELSE 'refetch' END ELSE 'refetch' END AS status FROM a")
def override_ttl(spark, sf_dir):
    return recipes(spark, sf_dir).select("slug", state.two_horizons(F.col("slug") % 400, F.col("household") % 3 != 0).alias("status"))


@query(f"WITH {RECIPES_SQL}, p AS (SELECT a.household, a.slug, min(b.slug) AS source FROM recipes a JOIN recipes b ON b.household = a.household AND b.slug <> a.slug AND b.strategy_tag = a.strategy_tag GROUP BY 1, 2) SELECT slug, source FROM p")
def own_recipe_source(spark, sf_dir):
    """The smallest other recipe of the household and tag: each group's two smallest say it for all, without a self-join."""
    rows = recipes(spark, sf_dir).select("household", "strategy_tag", "slug")
    group = ["household", "strategy_tag"]
    least = rows.groupBy(*group).agg(F.min("slug").alias("one"))
    second = rows.join(least, group).filter("slug <> one").groupBy(*group).agg(F.min("one").alias("one"), F.min("slug").alias("two"))
    return rows.join(second, group).select("slug", F.when(F.col("slug") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("source"))


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def cache_latest(spark, sf_dir):
    return state.latest(read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n FROM events WHERE epoch(TIMESTAMP '2030-01-01') - epoch(date_trunc('second', ts)) >= 0 AND epoch(date_trunc('second', ts)) > (SELECT epoch(date_trunc('second', max(ts))) FROM events) - 86400 GROUP BY event_type")
def cache_ttl(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    clocked = rows.join(F.broadcast(rows.agg(F.max("ts").alias("now"))), how="cross")  # one row: the batch's clock
    return state.fresh(clocked, F.col("now"), 24).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id AS slug, event_type AS kind, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def webhook_parse(spark, sf_dir):
    return stream.parsed(read(spark, sf_dir, "events")).select("event_id", "slug", "kind", "k")


@query("SELECT user_id AS slug, event_type AS kind, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def webhook_dedupe(spark, sf_dir):
    return stream.dedupe_batch(stream.parsed(read(spark, sf_dir, "events"))).select("slug", "kind", "event_id")


@query("SELECT l_orderkey AS food_id, round(coalesce(max(CASE WHEN l_linenumber = 1 THEN l_quantity END), max(CASE WHEN l_linenumber = 2 THEN l_quantity END)) * 1.0, 4) AS energy, round(max(CASE WHEN l_linenumber = 3 THEN l_quantity END) * 0.001, 4) AS sodium FROM lineitem GROUP BY l_orderkey")
def nutrient_pivot(spark, sf_dir):
    long = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("food_id"), F.col("l_linenumber").alias("nutrient_id"), F.col("l_quantity").alias("amount"))
    return importers.pivot_nutrients(long, {"energy": [1, 2], "sodium": [3]}, {"sodium": 0.001})


@query(f"WITH {FOODS_SQL} SELECT food_id, fid FROM (SELECT a.food_id, b.food_id AS fid, row_number() OVER (PARTITION BY a.food_id ORDER BY CASE WHEN b.kcal IS NULL THEN 1 ELSE 0 END, b.food_id) AS n FROM foods a JOIN foods b ON a.name = b.name AND a.brand = b.brand) WHERE n = 1")
def exact_lookup(spark, sf_dir):
    """The first record of a name, one with energy before others: one pass over the names, not a self-join of copies."""
    rows = foods(spark, sf_dir)
    first = rows.groupBy("name", "brand").agg(F.min(F.struct(F.col("kcal").isNull().alias("none"), F.col("food_id").alias("fid"))).alias("f"))
    return rows.join(first, ["name", "brand"]).select("food_id", "f.fid")


__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "domain"]
