"""Queries on scores, gates, replies, overrides, tags and write-back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from provender.functions import nutrition, text
from provender.operators import aggregate, linkage, overrides, replies, rules, scoring
from provender.plans import catalogue
from provender.plans.catalogue import _BLOCK, _GRADED, _GROUPS, _JACCARD, _LABEL, _SANE, NAMES, graded, groups, mg, names, pairs, query, words
from provender.sources.domain import FOODS_SQL, INGREDIENTS_SQL, NUTRIENTS, RECIPES_SQL, foods, ingredients, read, recipes
from provender.streaming import events as stream


def _same(a: str, b: str) -> str:
    return f"({a} = {b} OR {a} = {b} || 's' OR {a} = {b} || 'es' OR {b} = {a} || 's' OR {b} = {a} || 'es')"


def _has(toks: str, x: str) -> str:
    return f"len(list_filter({toks}, lambda t: {_same(x, 't')})) > 0"


_LONG = "len(list_filter(a.toks, lambda c: length(c) >= 3))"
_FOUND = f"len(list_filter(a.toks, lambda c: length(c) >= 3 AND {_has('b.toks', 'c')}))"
_CORE = "list_filter(list_slice(a.toks, len(a.toks), len(a.toks)), lambda c: length(c) >= 3)"


@query(f"""WITH {FOODS_SQL}, {NAMES}, {_BLOCK} SELECT qid, k.fid, len({_CORE}) > 0 AND len(list_filter({_CORE}, lambda c: {_has('b.toks', 'c')})) = 0 AS core_conflict,
{_LONG} > 1 AND {_FOUND} > 0 AND {_FOUND} < {_LONG} AS part_of_core, len(list_filter(b.toks, lambda x: NOT ({_has('a.toks', 'x')}) AND x NOT IN ({words(text.DESCRIPTORS)}))) > 0 AS narrows, {_JACCARD} < 0.34 AS unlike,
contains(lower(b.name), split_part(a.name, ' ', 1)) AS brand_evidence FROM blocked k JOIN names a ON a.fid = qid JOIN names b ON b.fid = k.fid""")
def gates_misc(spark, sf_dir):
    q, t = F.col("qtoks"), F.col("toks")
    unlike = linkage.similarity.jaccard(q, t) < 0.34
    return pairs(spark, sf_dir).select("qid", "fid", scoring.core_conflict(F.slice(q, F.size(q), F.lit(1)), t).alias("core_conflict"), scoring.part_of_core(q, t).alias("part_of_core"), scoring.narrows(q, t).alias("narrows"), unlike.alias("unlike"), scoring.brand_evidence(F.split_part("qname", F.lit(" "), F.lit(1)), F.col("name")).alias("brand_evidence"))


_ASKED, _STATED = "CASE fid % 3 WHEN 0 THEN 'lean' WHEN 1 THEN 'smoked' END", "CASE fid % 5 WHEN 0 THEN 'lean' WHEN 1 THEN 'smoked' WHEN 2 THEN 'fresh' END"
_QSTATE, _FSTATE = "CASE fid % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'dried' ELSE 'unknown' END", "CASE fid % 7 WHEN 0 THEN 'raw' WHEN 1 THEN 'dried' ELSE 'unknown' END"


@query(f"""WITH {_GROUPS}, f AS (SELECT *, {_ASKED} AS asked, {_STATED} AS stated, {_QSTATE} AS qs, {_FSTATE} AS fs FROM grp),
g AS (SELECT *, CASE WHEN asked IS NULL AND stated IS NOT NULL AND stated <> 'fresh' THEN -1 WHEN asked = stated THEN 2 ELSE 0 END AS afit FROM f)
SELECT fid, afit AS fit, afit + CASE WHEN qs = 'unknown' OR fs = 'unknown' THEN 0 WHEN qs = fs THEN 1 ELSE -1 END AS decisive,
round(least(CASE provider WHEN 'bls' THEN least(CASE WHEN score >= 70 THEN 0.85 ELSE 0.75 END, CASE WHEN fid % 2 = 0 THEN 1 ELSE 0.6 END) WHEN 'usda-local' THEN least(CASE WHEN score >= 55 THEN 0.8 ELSE 0.7 END, CASE WHEN fid % 2 = 0 THEN 1 ELSE 0.55 END) WHEN 'off' THEN least(0.95, score / 100) ELSE 0.85 END, CASE WHEN fid % 11 = 0 THEN 0.55 ELSE 1 END), 4) AS confidence FROM g""")
def fit_and_rivals(spark, sf_dir):
    rows = groups(spark, sf_dir).select("*", *[F.expr(e).alias(n) for n, e in (("asked", _ASKED), ("stated", _STATED), ("qs", _QSTATE), ("fs", _FSTATE))])
    fit = scoring.attribute_fit(F.col("asked"), F.col("stated"))
    sure = scoring.confidence(F.col("provider"), F.col("score"), F.expr("fid % 2 = 0"), F.expr("fid % 11 = 0"))
    return rows.select("fid", fit.alias("fit"), scoring.decisiveness(fit, F.col("qs"), F.col("fs")).alias("decisive"), F.round(sure.cast("double"), 4).alias("confidence"))


@query(f"WITH {FOODS_SQL}, n AS (SELECT min(food_id) AS fid, name FROM foods GROUP BY name), q AS (SELECT fid AS qid, substr(name, 2, 5) AS needle FROM n), h AS (SELECT qid, fid, count(*) OVER (PARTITION BY qid) AS hits FROM q JOIN n ON contains(n.name, q.needle)) SELECT qid, fid FROM h WHERE hits <= 120")
def contains_recall(spark, sf_dir):
    rows = foods(spark, sf_dir).groupBy("name").agg(F.min("food_id").alias("fid"))
    return scoring.contains_recall(rows.select(F.col("fid").alias("qid"), F.substring("name", 2, 5).alias("needle")), rows)


@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN k IS NULL THEN 'kept-unanswered' WHEN k = 0 THEN CASE WHEN event_type = 'view' THEN 'none' ELSE 'kept-declined' END WHEN k < 1 OR k > 60 THEN 'kept-malformed'
WHEN value < 60 THEN 'kept-unsure' WHEN user_id % 5 = 0 THEN 'kept-same' WHEN user_id % 7 = 0 THEN 'kept-identity' ELSE 'replaced' END AS verdict FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)) GROUP BY 1""")
def rerank_gate(spark, sf_dir):
    rows = stream.parsed(read(spark, sf_dir, "events"))
    verdict = replies.rerank_verdict(F.col("k"), F.lit(60), F.col("value") / 100, F.col("slug") % 5 == 0, F.col("slug") % 7 != 0, F.col("kind") == "view")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, round(CASE WHEN event_type = 'view' THEN CASE WHEN k / 100.0 BETWEEN 0.05 AND 5 THEN value * k / 100.0 END WHEN k > 0 THEN value * k END, 4) AS grams,
CASE WHEN k IS NULL OR value - 5 < 0 THEN 'unresolved' ELSE 'estimated' END AS nutrients FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def reply_guards(spark, sf_dir):
    rows = stream.parsed(read(spark, sf_dir, "events"))
    grams = replies.grams_of_reply(F.col("kind") == "view", F.col("k"), F.col("value"))
    return rows.select("event_id", F.round(grams, 4).alias("grams"), replies.nutrients_of_reply(F.col("k"), [F.col("value") - 5]).alias("nutrients"))


@query(f"WITH {INGREDIENTS_SQL} SELECT CASE WHEN idx % 4 = 0 THEN 'refused' WHEN brand = 'Brand#1' THEN 'branded' WHEN NOT matched THEN 'last-resort' ELSE 'proxy' END AS route, CASE WHEN provider = 'llm-nutrient' THEN 'estimate' ELSE 'record' END AS fallback, count(*) AS n FROM ing GROUP BY 1, 2")
def off_routing(spark, sf_dir):
    route = replies.retail_routing(F.col("idx") % 4 != 0, F.col("brand") == "Brand#1", F.col("matched"))
    return ingredients(spark, sf_dir).groupBy(route.alias("route"), replies.fallback_of(F.col("provider")).alias("fallback")).agg(F.count("*").alias("n"))


@query(f"WITH {_GROUPS}, e AS (SELECT gid, fid, name = 'red bolt' AS eq FROM grp), n AS (SELECT gid, sum(CASE WHEN eq THEN 1 ELSE 0 END) AS k FROM e GROUP BY gid) SELECT e.gid, fid FROM e JOIN n ON n.gid = e.gid WHERE k <> 1 OR eq")
def exact_label(spark, sf_dir):
    return replies.exact_label(groups(spark, sf_dir), "gid", F.col("name"), F.lit("Red Bolt")).select("gid", "fid")


@query(f"WITH {INGREDIENTS_SQL}, c AS (SELECT slug, idx, arg_min(k, event_id) AS k FROM (SELECT user_id AS slug, event_id % 7 AS idx, event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1, 2) SELECT CASE WHEN c.k IS NOT NULL THEN 'classified' WHEN brand = 'Brand#2' THEN 'vocabulary' ELSE 'plain' END AS origin, count(*) AS n, CAST(sum(c.k) AS DOUBLE) AS k_total FROM ing LEFT JOIN c ON c.slug = ing.slug AND c.idx = ing.idx GROUP BY 1")
def resolver_query(spark, sf_dir):
    """A classifier's reply, joined by recipe and index, comes before what the vocabulary says."""
    said = stream.parsed(read(spark, sf_dir, "events")).select("slug", (F.col("event_id") % 7).alias("idx"), "k", F.col("event_id").alias("ord"))
    rows = replies.by_index(ingredients(spark, sf_dir), said, ["slug", "idx"])
    origin = F.when(F.col("reply.k").isNotNull(), "classified").when(F.col("brand") == "Brand#2", "vocabulary").otherwise("plain")
    return rows.groupBy(origin.alias("origin")).agg(F.count("*").alias("n"), F.sum("reply.k").cast("double").alias("k_total"))


_LOG = "log AS (SELECT event_id AS seq, ts, user_id AS override_key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op, event_id % 300 AS target FROM events)"
_ALIVE = f"{_LOG}, gone AS (SELECT override_key, max(seq) AS g FROM log WHERE op = 'delete' GROUP BY 1), cur AS (SELECT l.override_key, arg_max(target, seq) AS target, arg_min(ts, seq) AS created_at, arg_max(ts, seq) AS updated_at, max(seq) AS seq FROM log l LEFT JOIN gone ON gone.override_key = l.override_key WHERE op = 'set' AND seq > coalesce(g, -1) GROUP BY 1)"


def override_log(spark, sf_dir):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("set")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("override_key"), op.alias("op"), (F.col("event_id") % 300).alias("target"))


@query(f"WITH {FOODS_SQL}, {_ALIVE} SELECT override_key, target, CAST(floor(epoch(created_at)) AS BIGINT) AS created_s, CAST(floor(epoch(updated_at)) AS BIGINT) AS updated_s, CASE WHEN food_id IS NULL THEN 'broken' WHEN epoch(TIMESTAMP '2024-07-01') - floor(epoch(updated_at)) > 180 * 86400 THEN 'stale' ELSE 'ok' END AS status FROM cur LEFT JOIN foods ON food_id = target")
def override_admin(spark, sf_dir):
    found = overrides.described(overrides.current(override_log(spark, sf_dir)), foods(spark, sf_dir), F.lit("2024-07-01 00:00:00"))
    seconds = [F.unix_seconds(F.col(c).cast("timestamp")).alias(n) for c, n in (("created_at", "created_s"), ("updated_at", "updated_s"))]
    return found.select("override_key", "target", *seconds, "status")


@query(f"WITH {FOODS_SQL}, {_ALIVE}, f AS (SELECT food_id, food_id * 3 % 1000 AS override_key FROM foods) SELECT food_id, coalesce(target, food_id) AS after, coalesce(target <> food_id, false) AS changes FROM f LEFT JOIN cur ON cur.override_key = f.override_key")
def override_preview(spark, sf_dir):
    rows = foods(spark, sf_dir).select("food_id", F.col("food_id").alias("before"), F.expr("food_id * 3 % 1000").alias("override_key"))
    return overrides.preview(rows, overrides.current(override_log(spark, sf_dir))).select("food_id", "after", "changes")


@query(f"WITH {INGREDIENTS_SQL} SELECT food_id, count(*) AS n, CASE WHEN max(CASE WHEN provider = 'llm-nutrient' THEN 1 ELSE 0 END) = 1 THEN 'estimated' ELSE 'unmet' END AS why FROM ing WHERE matched AND (provider = 'llm-nutrient' OR confidence < 0.45) GROUP BY food_id")
def override_suggestions(spark, sf_dir):
    """Records that were used though made up or with unmet claims: worth an override."""
    doubted = ingredients(spark, sf_dir).filter("matched AND (provider = 'llm-nutrient' OR confidence < 0.45)")
    why = F.when(F.bool_or(F.col("provider") == "llm-nutrient"), "estimated").otherwise("unmet")
    return doubted.groupBy("food_id").agg(F.count("*").alias("n"), why.alias("why"))


_SHARE = nutrition.half_up("CASE WHEN abs_kcal > 0 THEN coalesce(estimated_kcal, 0) / abs_kcal ELSE 0 END", 4)


def _fields(rounded) -> list[str]:
    grams = [f"{n}_serving AS {n}" for n in NUTRIENTS if n not in aggregate.FRACTIONS]
    return grams + [f"CASE WHEN completeness <> 'withheld' THEN {mg(f'{n}_serving', rounded)} END AS {n}_mg" for n in aggregate.FRACTIONS]


@query(f"WITH {_GRADED} SELECT slug, {', '.join(_fields(nutrition.sql_round))}, concat_ws(',', 'completeness=' || completeness, 'reason=' || completeness_reason, 'evidence=' || evidence, CASE WHEN {_SHARE} > 0 THEN 'share=' || CAST(CAST(floor({_SHARE} * 10000 + 0.5) AS BIGINT) AS VARCHAR) END) AS extras FROM graded")
def patch_output(spark, sf_dir):
    """What is written back: fields of a withheld result are null; extras hold only what there is (share in 1/10000)."""
    rows = graded(spark, sf_dir).withColumn("share", F.expr(_SHARE))
    said = [F.concat(F.lit(f"{n}="), c) for n, c in (("completeness", "completeness"), ("reason", "completeness_reason"), ("evidence", "evidence"))]
    share = F.when(F.col("share") > 0, F.concat(F.lit("share="), F.floor(F.col("share") * 10000 + 0.5).cast("string")))
    return rows.select("slug", *[F.expr(f) for f in _fields(nutrition.spark_round)], F.concat_ws(",", *said, share).alias("extras"))


@query(f"WITH {RECIPES_SQL}, dim AS (SELECT lower(n_name) AS name, min(n_nationkey) AS id FROM nation GROUP BY 1), w AS (SELECT slug, unnest([strategy_tag, 'nation_' || CAST(household % 30 AS VARCHAR)]) AS tag FROM recipes) SELECT DISTINCT slug, CAST(CASE WHEN id IS NOT NULL THEN id ELSE -CAST('0x' || substr(md5(lower(tag)), 1, 15) AS BIGINT) - 1 END AS BIGINT) AS tag_id FROM w LEFT JOIN dim ON dim.name = lower(tag) WHERE id IS NOT NULL OR slug % 17 <> 0")
def tag_assembly(spark, sf_dir):
    known = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("tag_id"))
    tags = F.array("strategy_tag", F.concat(F.lit("nation_"), (F.col("household") % 30).cast("string")))
    return overrides.tags_for(recipes(spark, sf_dir).select("slug", F.explode(tags).alias("name")), known, F.col("slug") % 17 != 0).select("slug", F.col("tag_id").cast("bigint").alias("tag_id"))


@query(f"WITH {RECIPES_SQL}, s AS (SELECT slug, CASE WHEN slug % 9 <> 0 THEN household % 50 END AS fp FROM recipes), rec AS (SELECT slug, slug - slug % 4 AS source, household % 49 AS fp FROM recipes) SELECT rec.slug, bool_or(rec.fp <> s.fp) AS stale FROM rec JOIN s ON s.slug = rec.source WHERE rec.slug <> rec.source AND s.fp IS NOT NULL GROUP BY 1")
def stale_sources(spark, sf_dir):
    rows = recipes(spark, sf_dir)
    now = rows.select("slug", F.expr("CASE WHEN slug % 9 <> 0 THEN household % 50 END").alias("fingerprint"))
    recorded = rows.select("slug", F.expr("slug - slug % 4").alias("source"), F.expr("household % 49").alias("fingerprint"))
    return overrides.stale(recorded, now)


@query(f"WITH {FOODS_SQL}, {_SANE} SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN food_id IS NULL THEN 'miss' WHEN insane IS NOT NULL THEN 'insane' WHEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) > 40 AND kcal IS NULL THEN 'conflict' ELSE 'hit' END AS verdict FROM events LEFT JOIN sane ON food_id = event_id % 2500) GROUP BY 1")
def cache_revalidate(spark, sf_dir):
    """A stored match is a miss if its record is gone, implausible, or refused by a gate of today."""
    rows = stream.parsed(read(spark, sf_dir, "events")).withColumn("food_id", F.col("event_id") % 2500)
    both = rows.join(rules.with_sanity(foods(spark, sf_dir), _LABEL).withColumn("there", F.lit(True)), "food_id", "left")
    verdict = F.when(F.col("there").isNull(), "miss").when(F.col("insane").isNotNull(), "insane").when((F.col("k") > 40) & F.col("kcal").isNull(), "conflict").otherwise("hit")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


_OIL = "CASE WHEN FALSE THEN ''"
_WORN = " ".join(f"WHEN regexp_matches(lower(a.name), '{q}') AND regexp_matches(lower(b.name), '{c}') AND NOT regexp_matches(lower(a.name), '{c}') THEN '{why}'" for q, c, why in rules.MISMATCHES)


@query(f"""WITH {FOODS_SQL}, n AS (SELECT min(food_id) AS fid, name, min(category) AS category, min(brand) AS brand FROM foods GROUP BY name), {NAMES}, {_BLOCK}
SELECT qid, k.fid, coalesce({_OIL} {_WORN} END, 'none') AS mismatch, lower(a.category) IN ({words(rules.STRICT)}) AND contains(b.name, 'gizmo') AND NOT contains(a.name, 'gizmo') AS category_conflict,
qid % 3 <> 0 AND NOT contains(lower(b.name || ' ' || b.brand), lower(a.brand)) AS brand_conflict FROM blocked k JOIN n a ON a.fid = qid JOIN n b ON b.fid = k.fid""")
def gates_by_rule(spark, sf_dir):
    n = foods(spark, sf_dir).groupBy("name").agg(F.min("food_id").alias("fid"), F.min("category").alias("category"), F.min("brand").alias("brand"))
    asked = n.select(F.col("fid").alias("qid"), F.col("name").alias("qname"), F.col("category").alias("qcategory"), F.col("brand").alias("qbrand"))
    both = catalogue.blocked(spark, sf_dir)[1].join(asked, "qid").join(n, "fid")
    brand = rules.brand_conflict(F.col("qid") % 3 == 0, F.col("qbrand"), F.col("brand"), F.concat_ws(" ", "name", "brand"))
    return both.select("qid", "fid", F.coalesce(rules.mismatch(F.col("qname"), F.col("name")), F.lit("none")).alias("mismatch"), rules.category_conflict(F.col("qcategory"), F.col("qname"), F.col("name")).alias("category_conflict"), brand.alias("brand_conflict"))


@query("WITH w AS (SELECT user_id AS slug, min(event_id) AS seq FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 400 = 0) GROUP BY 1) SELECT slug, seq FROM w ORDER BY seq LIMIT (SELECT greatest(0, 20 - count(*)) FROM events WHERE event_type = 'error' AND event_id % 400 = 0)")
def queue_runnable(spark, sf_dir):
    """The limit is the feature: as many jobs as may run at once."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("slug"), F.col("event_id").alias("seq"), "event_type")
    return stream.runnable(rows.filter("event_type = 'view'"), rows.filter("event_type = 'error' AND seq % 400 = 0"), 20)


QUERIES, ORACLES = catalogue.QUERIES, catalogue.ORACLES
