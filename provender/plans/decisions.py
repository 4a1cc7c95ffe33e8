"""Queries on what is asked, answered, kept and keyed, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from provender.functions import text
from provender.operators import judge, keys, linkage, overrides, replies, rules, state
from provender.plans.catalogue import nid, query, words
from provender.plans.resolution import _ALIVE, override_log
from provender.plans.semantics import _DOCS, pairs
from provender.sources import retail
from provender.sources.domain import FOODS_SQL, INGREDIENTS_SQL, RECIPES_SQL, foods, ingredients, read, recipes
from provender.streaming import events as stream

_STATES = f"""{RECIPES_SQL}, o AS (SELECT slug, strategy_tag <> '5-LOW' AS tagged, slug % 3 = 0 AS same_hash, slug % 2 = 0 AS tags_complete, CASE WHEN slug % 7 <> 0 THEN total END AS kcal, CASE WHEN slug % 5 <> 0 THEN 'p' END AS provenance,
household % 10 = 0 AS sticky, household % 4 AS fingerprint, CASE WHEN slug % 11 <> 0 THEN household % 4 ELSE -1 END AS recorded, slug % 13 = 0 AS forced FROM recipes),
w AS (SELECT *, CASE WHEN sticky OR (kcal IS NOT NULL AND provenance IS NULL) THEN 'manual' WHEN kcal IS NULL THEN 'none' WHEN fingerprint <> recorded THEN 'drifted' ELSE 'owned' END AS ownership FROM o)"""


def states(spark, sf_dir):
    columns = ["slug", "strategy_tag <> '5-LOW' AS tagged", "slug % 3 = 0 AS same_hash", "slug % 2 = 0 AS tags_complete", "CASE WHEN slug % 7 <> 0 THEN total END AS kcal", "CASE WHEN slug % 5 <> 0 THEN 'p' END AS provenance", "household % 10 = 0 AS sticky", "household % 4 AS fingerprint", "CASE WHEN slug % 11 <> 0 THEN household % 4 ELSE -1 END AS recorded", "slug % 13 = 0 AS forced"]
    rows = recipes(spark, sf_dir).selectExpr(*columns)
    return rows.withColumn("ownership", replies.ownership(*[F.col(c) for c in ("kcal", "provenance", "sticky", "fingerprint", "recorded")]))


@query(f"WITH {_STATES} SELECT slug, ownership, CASE WHEN kcal IS NOT NULL THEN CAST(floor(round(CAST(kcal AS DOUBLE) * 1000, 4) + 0.5) AS BIGINT) END AS milligrams FROM w")
def manual_ownership(spark, sf_dir):
    return states(spark, sf_dir).select("slug", "ownership", F.expr("CASE WHEN kcal IS NOT NULL THEN CAST(floor(round(CAST(kcal AS DOUBLE) * 1000, 4) + 0.5) AS BIGINT) END").alias("milligrams"))


@query(f"WITH {_STATES} SELECT status, count(*) AS n FROM (SELECT CASE WHEN NOT tagged THEN 'not-tagged' WHEN same_hash AND NOT forced THEN CASE WHEN tags_complete THEN 'unchanged' ELSE 'tags-updated' END WHEN ownership = 'manual' THEN 'manual' ELSE 'estimate' END AS status FROM w) GROUP BY status")
def outcome_counts(spark, sf_dir):
    status = replies.outcome(F.col("tagged"), F.col("same_hash"), F.col("tags_complete"), F.col("ownership") == "manual", F.col("forced"))
    return states(spark, sf_dir).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_TAGS = "t AS (SELECT slug, list_filter(['user', CASE WHEN household % 2 = 0 THEN 'Calories:Light' END, CASE WHEN household % 3 = 0 THEN 'Digest:Easy' END, lower(strategy_tag)], lambda x: x IS NOT NULL) AS own, CASE WHEN household % 5 = 0 THEN [] ELSE ['Calories:Light', 'Digest:Easy'] END AS old, ['Calories:' || status] AS fresh FROM recipes)"


@query(f"WITH {RECIPES_SQL}, {_TAGS} SELECT slug, array_to_string(list_concat(list_filter(own, lambda x: NOT list_contains(old, x)), fresh), ',') AS merged, len(old) > 0 AND len(list_filter(old, lambda x: NOT list_contains(own, x))) = 0 AS complete, len(list_filter(own, lambda x: x IN ('2-high', 'user high'))) > 0 AS chosen FROM t")
def merge_tags(spark, sf_dir):
    own = F.array_compact(F.array(F.lit("user"), F.expr("CASE WHEN household % 2 = 0 THEN 'Calories:Light' END"), F.expr("CASE WHEN household % 3 = 0 THEN 'Digest:Easy' END"), F.lower("strategy_tag")))
    old = F.when(F.col("household") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Calories:Light"), F.lit("Digest:Easy")))
    rows = recipes(spark, sf_dir).select("slug", own.alias("own"), old.alias("old"), F.array(F.concat(F.lit("Calories:"), "status")).alias("fresh"))
    return rows.select("slug", F.array_join(replies.merged_tags(F.col("own"), F.col("old"), F.col("fresh")), ",").alias("merged"), replies.tags_complete(F.col("own"), F.col("old")).alias("complete"), replies.should_estimate("tag", F.col("own"), "2-high").alias("chosen"))


@query(f"WITH {INGREDIENTS_SQL} SELECT slug, count(*) AS n FROM (SELECT *, CASE WHEN idx = 3 THEN '' ELSE name END AS said, CASE WHEN idx = 4 THEN NULL ELSE qty - 5 END AS much FROM ing) WHERE said <> '' AND much > 0 GROUP BY slug")
def usable_ingredients(spark, sf_dir):
    rows = ingredients(spark, sf_dir).select("slug", F.expr("CASE WHEN idx = 3 THEN '' ELSE name END").alias("said"), F.expr("CASE WHEN idx = 4 THEN NULL ELSE qty - 5 END").alias("much"))
    return replies.usable(rows, "said", "much").groupBy("slug").agg(F.count("*").alias("n"))


@query(f"""WITH {RECIPES_SQL}, p AS (SELECT slug, CASE WHEN slug % 9 <> 0 THEN total END AS energy, servings, CAST((household * 37 % 120000) / 1.0 - 500 AS DOUBLE) AS yield_g FROM recipes)
SELECT slug, CASE WHEN energy > 0 AND servings > 0 AND yield_g BETWEEN 1 AND 100000 THEN floor(round(CAST(energy AS DOUBLE) * servings * 100 / yield_g * 1000, 6) + 0.5) / 1000 END AS per_100g FROM p""")
def source_per_100g(spark, sf_dir):
    rows = recipes(spark, sf_dir).selectExpr("slug", "CASE WHEN slug % 9 <> 0 THEN CAST(total AS DOUBLE) END AS energy", "servings", "CAST(household * 37 % 120000 AS DOUBLE) - 500 AS yield_g")
    return rows.select("slug", replies.per_100g(F.col("energy"), F.col("servings").cast("double"), F.col("yield_g"), F.col("energy")).alias("per_100g"))


_ASKS = """CASE WHEN NOT matched THEN NULL ELSE provider END AS p, unmet IS NOT NULL AS open, CASE WHEN food_id % 4 = 0 THEN CAST(fat + food_id % 5 - 2 AS DOUBLE) END AS fat_asked, CASE WHEN food_id % 9 <> 0 THEN CAST(fat AS DOUBLE) END AS fat_there,
CASE food_id % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN 'dried' ELSE 'unknown' END AS kept_asked, CASE food_id % 5 WHEN 0 THEN 'fresh' WHEN 1 THEN 'canned' ELSE 'unknown' END AS kept, food_id % 6 = 0 AS part, food_id % 2 = 0 AS processed, food_id % 7 = 0 AS claims, food_id % 8 = 0 AS rival, food_id % 10 AS survivors, food_id % 3 AS below"""
_THERE = "coalesce(p IN ('own-recipe', 'bls', 'usda-local', 'off'), false)"
_NUMBER = f"({_THERE} AND fat_asked IS NOT NULL AND (fat_there IS NULL OR abs(fat_there - fat_asked) > 0.5 AND abs(fat_there - fat_asked) <= greatest(2.0, fat_asked * 0.15)))"
_REASONS = f"""[CASE WHEN NOT {_THERE} THEN 'no-database-record' END, CASE WHEN NOT {_THERE} AND survivors > 0 AND below > 0 THEN 'gate-suppressed-pool' END, CASE WHEN {_NUMBER} THEN 'unsatisfied-numeric-modifier' END, CASE WHEN {_THERE} AND open THEN 'unmet-attribute' END,
CASE WHEN {_THERE} AND kept_asked <> 'unknown' AND kept <> 'unknown' AND kept <> kept_asked THEN 'unresolved-specificity' END, CASE WHEN {_THERE} AND part THEN 'partial-core-identity' END, CASE WHEN rival THEN 'material-rival' END,
CASE WHEN processed AND ({_THERE} AND open OR {_NUMBER} OR NOT {_THERE} AND (fat_asked IS NOT NULL OR claims)) THEN 'retail-variant-proxy' END]"""


@query(f"WITH {INGREDIENTS_SQL}, a AS (SELECT {_ASKS} FROM ing) SELECT reasons, count(*) AS n FROM (SELECT array_to_string(list_filter({_REASONS}, lambda x: x IS NOT NULL), ',') AS reasons FROM a) GROUP BY reasons")
def judge_need(spark, sf_dir):
    rows = ingredients(spark, sf_dir).selectExpr(*_split(_ASKS))
    why = judge.need(*[F.col(c) for c in ("p", "open", "fat_asked", "fat_there", "kept_asked", "kept", "part", "processed", "claims", "rival", "survivors", "below")])
    return rows.groupBy(F.array_join(why, ",").alias("reasons")).agg(F.count("*").alias("n"))


def _split(columns: str) -> list[str]:
    """The columns of a SELECT list: at commas outside of parentheses."""
    out, depth, own = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(own)
            own = ""
        else:
            own += c
    return [*out, own]


@query("SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN k IS NULL THEN 'malformed' WHEN k NOT BETWEEN 1 AND 60 THEN 'out-of-range' WHEN coalesce(value / 100, 0) < 0.6 THEN 'low-confidence' WHEN event_id % 7 = 0 THEN 'implausible' WHEN event_id % 3 = 0 THEN 'kept-record' ELSE 'accepted' END AS verdict FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)) GROUP BY 1")
def reply_validation(spark, sf_dir):
    rows = stream.parsed(read(spark, sf_dir, "events"))
    verdict = judge.verdict(F.col("k"), F.lit(60), F.col("value") / 100, F.col("event_id") % 7 != 0, F.col("event_id") % 3 == 0)
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


_REPLIES = "asked AS (SELECT DISTINCT user_id AS batch, event_id % 5 AS idx FROM events), rep AS (SELECT user_id AS batch, 1 + event_id % 2 AS attempt, event_id % 9 AS idx, event_type AS kind, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


@query(f"""WITH {_REPLIES}, one AS (SELECT *, count(*) OVER (PARTITION BY batch, attempt, idx) AS c FROM rep), g AS (SELECT * FROM one WHERE c = 1 AND kind IN ('view', 'click', 'purchase', 'login') AND k IS NOT NULL),
f AS (SELECT a.batch, a.idx, x.kind AS k1, x.k AS v1, y.kind AS k2, y.k AS v2, avg(CASE WHEN x.kind IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY a.batch) AS share FROM asked a LEFT JOIN g x ON x.batch = a.batch AND x.idx = a.idx AND x.attempt = 1 LEFT JOIN g y ON y.batch = a.batch AND y.idx = a.idx AND y.attempt = 2)
SELECT batch, idx, CASE WHEN k1 IS NOT NULL THEN k1 WHEN share < 0.8 THEN k2 END AS kind, CASE WHEN k1 IS NOT NULL THEN v1 WHEN share < 0.8 THEN v2 END AS k, CASE WHEN k1 IS NOT NULL THEN 'first' WHEN share < 0.8 AND k2 IS NOT NULL THEN 'retry' ELSE 'fallback' END AS origin FROM f""")
def classification(spark, sf_dir):
    """Batches of classifications: closed kinds, sound indexes, one retry, and a fallback for what is left."""
    rows = stream.parsed(read(spark, sf_dir, "events"))
    asked = rows.select(F.col("slug").alias("batch"), (F.col("event_id") % 5).alias("idx")).distinct()
    told = rows.select(F.col("slug").alias("batch"), (1 + F.col("event_id") % 2).alias("attempt"), (F.col("event_id") % 9).alias("idx"), "kind", "k")
    return judge.classified(asked, told, F.col("kind").isin("view", "click", "purchase", "login") & F.col("k").isNotNull())


_NAMED = "SELECT food_id, name, CASE WHEN food_id % 3 = 0 THEN NULL ELSE brand END AS brand, category, tier, CASE food_id % 3 WHEN 0 THEN 'whole' END AS form, CASE food_id % 4 WHEN 0 THEN 'fresh' WHEN 1 THEN 'dried' END AS kept, CASE WHEN food_id % 5 = 0 THEN CAST(food_id % 50 AS INTEGER) END AS fat, CASE food_id % 4 WHEN 0 THEN 'ml' WHEN 1 THEN 'l' ELSE 'piece' END AS unit FROM foods"
_ATTRIBUTES = "concat_ws('/', coalesce(form, 'unknown'), coalesce(kept, 'unknown'), coalesce(CAST(fat AS VARCHAR), ''))"


@query(f"""WITH {FOODS_SQL}, k AS ({_NAMED}), a AS (SELECT *, {nid('name')} AS n, coalesce({nid('brand')}, '') AS b, {_ATTRIBUTES} AS atts FROM k)
SELECT food_id, n || '|' || b AS query_key, atts AS attributes, 'g1:' || n || ',' || b || '|raw|' || atts AS german, 'u1:7:' || n || '|raw|' || atts || '|generic|' || coalesce(form, '') AS english, concat_ws('|', category, tier, coalesce(form, ''), 'EC-') AS context,
'v2:' || CASE WHEN unit IN ('ml', 'l') THEN 'density' ELSE unit END || '|' || n AS grams, 'v2:' || n AS nutrients, 'v1:bls|' || n || '|raw|' || atts || '|' || CAST(food_id AS VARCHAR) || ',7' AS rerank, 'j2|p3|m|' || n || '|' || b || '|' || md5(n) AS judge FROM a""")
def cache_keys(spark, sf_dir):
    rows = foods(spark, sf_dir).selectExpr(*_split(_NAMED.removeprefix("SELECT ").removesuffix(" FROM foods")))
    at = keys.attributes_key(F.col("form"), F.col("kept"), F.col("fat"))
    key, name = keys.query_key(F.col("name"), F.col("brand")), F.col("name")
    n = text.normalize_identity(name)
    variants = F.array(name, F.coalesce("brand", F.lit("")))
    return rows.select(
        "food_id", key.alias("query_key"), at.alias("attributes"), keys.german_key("g1", variants, F.lit("raw"), at).alias("german"), keys.english_key("u1", "7", F.array(name), F.lit("raw"), at, F.lit("generic"), F.col("form")).alias("english"),
        keys.miss_context(F.col("category"), F.col("tier"), F.col("form"), F.lit("EC-")).alias("context"), keys.grams_key(F.col("unit"), name).alias("grams"), keys.nutrients_key(name).alias("nutrients"),
        keys.rerank_key(F.lit("bls"), F.array(n), F.lit("raw"), at, F.array(F.col("food_id"), F.lit(7))).alias("rerank"), keys.judge_key("p3", "m", key, F.md5(n)).alias("judge"),
    )


@query(f"""WITH {FOODS_SQL}, k AS (SELECT food_id, food_id % 2 = 0 AS r, CASE WHEN food_id % 3 = 0 THEN 'none' ELSE '' END AS w, CASE WHEN food_id % 5 = 0 THEN ['lean', name] ELSE [] END AS u, food_id % 7 = 0 AS torn FROM foods)
SELECT food_id, r OR w <> '' OR len(u) > 0 AS written, CASE WHEN NOT torn AND r THEN 'yes' END AS reranked, CASE WHEN NOT torn AND w <> '' THEN w END AS reason, CASE WHEN NOT torn AND len(u) > 0 THEN array_to_string(u, '|') END AS unmet FROM k""")
def provenance(spark, sf_dir):
    """Written as JSON and read back; what was torn on the way is no provenance."""
    k = foods(spark, sf_dir).selectExpr("food_id", "food_id % 2 = 0 AS r", "CASE WHEN food_id % 3 = 0 THEN 'none' ELSE '' END AS w", "CASE WHEN food_id % 5 = 0 THEN array('lean', name) ELSE array() END AS u", "food_id % 7 = 0 AS torn")
    raw = k.withColumn("raw", keys.provenance(F.col("r"), F.col("w"), F.col("u")))
    back = raw.withColumn("held", keys.provenance_read(F.when(F.col("torn"), F.concat(F.lit("{"), F.coalesce("raw", F.lit("")))).otherwise(F.col("raw"))))
    return back.select("food_id", F.col("raw").isNotNull().alias("written"), F.when(F.col("held.reranked"), "yes").alias("reranked"), "held.reason", F.array_join("held.unmet", "|").alias("unmet"))


_ASCII = "list_distinct(list_filter(string_split(trim(regexp_replace(translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query(f"""WITH {FOODS_SQL}, q AS (SELECT page_id AS qid, regexp_extract(url, '([^/]+)/?$', 1) || ' ' || CASE page_id % 3 WHEN 0 THEN 'steel bolt' WHEN 1 THEN 'Rotor hot' ELSE 'zzz' END AS text, page_id % 11 <> 0 AS available FROM pages),
w AS (SELECT qid, unnest({_ASCII.format('text')}) AS word FROM q WHERE available), p AS (SELECT food_id AS code, unnest({_ASCII.format('name')}) AS word FROM foods),
h AS (SELECT qid, code, count(*) AS shared FROM w JOIN p ON p.word = w.word GROUP BY 1, 2), r AS (SELECT qid, code, row_number() OVER (PARTITION BY qid ORDER BY shared DESC, code) AS rank FROM h)
SELECT q.qid, code, CAST(rank AS INTEGER) AS rank, CASE WHEN NOT available THEN 'failed' WHEN code IS NULL THEN 'absent' ELSE 'ok' END AS status FROM q LEFT JOIN r ON r.qid = q.qid AND rank <= 10""")
def retail_search(spark, sf_dir):
    """A page of ten products for each query; what could not be asked isn't absent."""
    said = F.concat(F.regexp_extract("url", "([^/]+)/?$", 1), F.lit(" "), F.expr("CASE page_id % 3 WHEN 0 THEN 'steel bolt' WHEN 1 THEN 'Rotor hot' ELSE 'zzz' END"))
    queries = read(spark, sf_dir, "pages").select(F.col("page_id").alias("qid"), said.alias("text"), (F.col("page_id") % 11 != 0).alias("available"))
    return retail.search(queries, foods(spark, sf_dir).select(F.col("food_id").alias("code"), "name"))


@query(f"WITH {FOODS_SQL}, p AS (SELECT food_id AS code, CASE WHEN food_id % 13 = 0 THEN ' ' ELSE name END AS name, kcal FROM foods), a AS (SELECT event_id, event_id % 3000 AS code FROM events) SELECT event_id, CASE WHEN trim(name) <> '' AND kcal IS NOT NULL THEN name END AS name, CASE WHEN trim(name) <> '' AND kcal IS NOT NULL THEN 'ok' ELSE 'absent' END AS status FROM a LEFT JOIN p ON p.code = a.code")
def retail_barcode(spark, sf_dir):
    products = foods(spark, sf_dir).selectExpr("food_id AS code", "CASE WHEN food_id % 13 = 0 THEN ' ' ELSE name END AS name", "kcal")
    return retail.barcode(read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3000).alias("code")), products).select("event_id", "name", "status")


_MEETS = "len(list_filter({0}, lambda w: len(list_filter(words, lambda t: contains(t, w) OR contains(w, t))) > 0)) > 0"
_PRODUCTS = "SELECT food_id, name, kcal, CASE WHEN food_id % 17 <> 0 THEN CAST(fat AS DOUBLE) END AS fat, category, concat('old ', split_part(name, ' ', 1), ' xx') AS core, CASE WHEN food_id % 4 = 0 THEN 'bio sauce zzzzzz' ELSE name END AS identity, CASE WHEN food_id % 3 = 0 THEN CAST(fat + food_id % 7 AS DOUBLE) END AS asked, food_id % 2 = 0 AS last"


@query(f"""WITH {FOODS_SQL}, p AS ({_PRODUCTS} FROM foods), w AS (SELECT *, {_ASCII.format('name')} AS words, list_filter({_ASCII.format('core')}, lambda x: length(x) > 3) AS cores, list_filter({_ASCII.format('identity')}, lambda x: length(x) >= 4 AND x NOT IN ({words(text.LABEL_WORDS)})) AS own0 FROM p),
s AS (SELECT *, list_distinct(list_filter(list_concat(own0, flatten(list_transform(own0, lambda y: flatten(list_transform(range(5, greatest(5, CAST(length(y) AS BIGINT) - 4)), lambda i: [substr(y, 1, i), substr(y, i + 1)]))))), lambda x: x NOT IN ({words(text.LABEL_WORDS)}))) AS every FROM w),
d AS (SELECT *, list_filter(every, lambda t: length(t) >= list_max(list_transform(every, lambda z: length(z))) - 2) AS own FROM s)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN kcal IS NULL THEN 'energy' WHEN trim(name) = '' THEN 'name' WHEN last AND len(own) > 0 AND NOT {_MEETS.format('own')} THEN 'distinctive' WHEN NOT last AND len(cores) > 0 AND NOT {_MEETS.format('cores')} THEN 'core'
WHEN category IN ('SMALL BRASS', 'LARGE TIN') THEN 'category' WHEN asked IS NOT NULL AND fat IS NULL THEN 'no-fat' WHEN abs(fat - asked) > greatest(2.0, asked * 0.15) THEN 'fat' ELSE 'kept' END AS reason FROM d) GROUP BY reason""")
def off_filter_reasons(spark, sf_dir):
    p = foods(spark, sf_dir).selectExpr(*_split(_PRODUCTS.removeprefix("SELECT ")))
    why = retail.drop_reason(F.col("name"), F.col("kcal"), F.col("fat"), F.col("category"), F.col("core"), F.col("identity"), F.col("asked"), F.col("last"), ("SMALL BRASS", "LARGE TIN"))
    return p.groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {INGREDIENTS_SQL}, e AS (SELECT coalesce(confidence >= 0.5, false) AS en, coalesce(confidence >= 0.7, false) AS core, brand = 'Brand#1' OR idx % 3 = 0 AS br FROM ing) SELECT CASE WHEN en THEN 'E' ELSE '-' END || CASE WHEN core THEN 'C' ELSE '-' END || CASE WHEN br THEN 'B' ELSE '-' END AS evidence_key, NOT (en AND core) AS degraded, br OR (en AND core) AS may_query_off, count(*) AS n FROM e GROUP BY 1, 2, 3")
def evidence_routing(spark, sf_dir):
    e = ingredients(spark, sf_dir).selectExpr("coalesce(confidence >= 0.5, false) AS en", "coalesce(confidence >= 0.7, false) AS core", "brand = 'Brand#1' OR idx % 3 = 0 AS br")
    marks = [F.col(c) for c in ("en", "core", "br")]
    return e.groupBy(replies.evidence_key(*marks).alias("evidence_key"), (~(marks[0] & marks[1])).alias("degraded"), replies.may_query_retail(*marks).alias("may_query_off")).agg(F.count("*").alias("n"))


@query(f"""WITH {_DOCS}, c AS (SELECT doc_id, doc_id - doc_id % 6 AS g, CASE doc_id % 5 WHEN 0 THEN ['coriander', 'seed'] WHEN 1 THEN ['coriander', 'leaf', b] WHEN 2 THEN ['coriander'] WHEN 3 THEN ['leaf', a] ELSE ['coriander', 'root'] END AS t, CASE WHEN (doc_id - doc_id % 6) % 4 = 0 THEN ['coriander', 'seed'] ELSE ['coriander'] END AS q FROM p),
x AS (SELECT *, coalesce({', '.join(f"CASE WHEN list_contains(t, '{p}') THEN '{p}' END" for p in text.PARTS)}) AS part, len(list_filter(q, lambda w: NOT list_contains(t, w))) = 0 AS whole FROM c),
s AS (SELECT g, count(DISTINCT CASE WHEN whole THEN part END) AS offered FROM x GROUP BY g) SELECT doc_id, part IS NOT NULL AND offered > 1 AND NOT list_has_any(q, [{words(text.PARTS)}]) AS refused FROM x JOIN s ON s.g = x.g""")
def set_level_part(spark, sf_dir):
    """A part of a plant is refused where the candidates offer several and the query names none."""
    c = pairs(spark, sf_dir).selectExpr("doc_id", "doc_id - doc_id % 6 AS g", "CASE doc_id % 5 WHEN 0 THEN array('coriander', 'seed') WHEN 1 THEN array('coriander', 'leaf', b) WHEN 2 THEN array('coriander') WHEN 3 THEN array('leaf', a) ELSE array('coriander', 'root') END AS t", "CASE WHEN (doc_id - doc_id % 6) % 4 = 0 THEN array('coriander', 'seed') ELSE array('coriander') END AS q")
    return rules.part_conflict(c, "g", F.col("q"), F.col("t")).select("doc_id", F.col("part_conflict").alias("refused"))


@query(f"WITH {_DOCS} SELECT doc_id, CASE WHEN len(list_intersect(q, n)) = 0 AND NOT (contains(array_to_string(q, ' '), array_to_string(n, ' ')) OR contains(array_to_string(n, ' '), array_to_string(q, ' '))) AND doc_id % 3 = 0 THEN true ELSE false END AS refused FROM p")
def identity_evidence(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("core", F.when(F.col("doc_id") % 3 != 0, F.col("q")))
    return p.select("doc_id", rules.no_evidence(linkage.similarity.name_similarity(F.col("q"), F.col("n")), F.col("core")).alias("refused"))


@query(f"WITH {FOODS_SQL}, {_ALIVE}, o AS (SELECT override_key, target, updated_at, CASE override_key % 3 WHEN 0 THEN 'bls' WHEN 1 THEN 'usda-local' ELSE 'off' END AS provider FROM cur) SELECT override_key, provider, target, name, CAST(row_number() OVER (ORDER BY updated_at DESC, override_key) AS INTEGER) AS place FROM o LEFT JOIN foods ON food_id = target AND CASE provider WHEN 'bls' THEN food_id % 3 = 0 WHEN 'usda-local' THEN food_id % 3 = 1 ELSE food_id % 3 = 2 END")
def override_targets(spark, sf_dir):
    """Each override with the live record of the provider that it points to, the one touched last first."""
    provider = F.expr("CASE override_key % 3 WHEN 0 THEN 'bls' WHEN 1 THEN 'usda-local' ELSE 'off' END")
    own = overrides.listed(overrides.current(override_log(spark, sf_dir))).select("override_key", provider.alias("provider"), "target", "place")
    records = foods(spark, sf_dir).select(F.col("food_id").alias("id"), "name", "kcal")
    tables = {p: records.filter(F.col("id") % 3 == i) for i, p in enumerate(("bls", "usda-local", "off"))}
    return overrides.targets(own, tables).select("override_key", "provider", "target", "name", "place")


_COUNTED = ("nation", "region", "events", "orders", "part")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED))
def table_counts(spark, sf_dir):
    return state.row_counts({t: read(spark, sf_dir, t) for t in _COUNTED})


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS asked_as FROM (SELECT DISTINCT user_id, event_id FROM events WHERE event_type = 'view') v WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.event_id % 5 = 0 AND p.user_id = v.user_id)")
def cache_misses(spark, sf_dir):
    """What is asked of the classifier: what no cached reply covers, numbered anew for its batch."""
    rows = read(spark, sf_dir, "events")
    asked = rows.filter("event_type = 'view'").select("user_id", "event_id").distinct()
    return state.misses(asked, rows.filter("event_type = 'purchase' AND event_id % 5 = 0"), ["user_id"], ["user_id"], ["event_id"])
