"""Queries on morphology, spellings and stated attributes, over names made from every document's words, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provender.functions import text
from provender.operators import linkage, rules, scoring
from provender.plans.catalogue import _BLOCK, NAMES, names, query, stem, tk, words
from provender.plans.catalogue import pairs as blocked_pairs
from provender.sources.domain import FOODS_SQL, foods, read

# The rules once more, in the words of SQL.


def _same(a: str, b: str) -> str:
    inflected = lambda x, y: f"{y} IN ({', '.join(f'{x} || {e!r}' for e in text.PLURALS)})"
    return f"({a} = {b} OR ({stem(a)}) = ({stem(b)}) OR (least(length({a}), length({b})) >= 5 AND CASE WHEN length({a}) <= length({b}) THEN {inflected(a, b)} ELSE {inflected(b, a)} END))"


def _some(toks: str, name: str, body: str) -> str:
    return f"len(list_filter({toks}, lambda {name}: {body})) > 0"


def _identity(toks: str) -> str:
    kept = f"list_filter({toks}, lambda y: length(y) >= 3 AND NOT regexp_matches(y, '^[0-9]') AND y NOT IN ({words(text.DESCRIPTORS)}))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {toks} END"


def _splits(token: str, least: int = 4) -> str:
    return f"range({least}, greatest({least}, CAST(length({token}) AS BIGINT) - {least - 1}))"


def _half(part: str, toks: str) -> str:
    return f"(length({part}) >= 3 AND {_some(toks, 'h', f'length(h) >= 3 AND (starts_with(h, {part}) OR starts_with({part}, h) OR {_same("h", part)})')})"


def _compound(token: str, toks: str) -> str:
    links = "[" + words(text.LINKS) + "]"
    tail = _some(links, "g", f"starts_with(substr({token}, i + 1), g) AND {_half(f'substr({token}, i + 1 + length(g))', toks)}")
    return _some(_splits(token), "i", f"{_half(f'substr({token}, 1, i)', toks)} AND {tail}")


def _absent(token: str) -> str:
    found = rf"regexp_replace(regexp_extract({token}, '^(..+)(frei|free)$', 1), '[-\s]+$', '')"
    return f"CASE WHEN length({found}) >= 2 AND {found} NOT IN ({words(text.ENERGY)}) THEN {found} END"


#: Of every document: its first words, and names of records made from them.
_DOCS = f"""t AS (SELECT doc_id, list_filter({tk('text')}, lambda x: length(x) > 1) AS t FROM documents),
d AS (SELECT doc_id, t[1] AS a, t[2] AS b, t[3] AS c, t[4] AS e FROM t WHERE len(t) >= 4),
p AS (SELECT *, CASE WHEN doc_id % 4 = 3 THEN [a, b] ELSE [a] END AS q, CASE doc_id % 8 WHEN 0 THEN [a || 'n', b] WHEN 1 THEN [c, a] WHEN 2 THEN [e || a] WHEN 3 THEN [a, b, c, e] WHEN 4 THEN [b, c] WHEN 5 THEN [substr(a, 1, 4), substr(a, 5)] WHEN 6 THEN [substr(a, 1, 5), c, substr(a, 6)] ELSE [b, a] END AS n FROM d)"""


def pairs(spark, sf_dir) -> DataFrame:
    toks = F.filter(text.tokens(F.col("text")), lambda x: F.length(x) > 1)
    d = read(spark, sf_dir, "documents").select("doc_id", toks.alias("t")).filter("size(t) >= 4").selectExpr("doc_id", "t[0] AS a", "t[1] AS b", "t[2] AS c", "t[3] AS e")
    name = "CASE doc_id % 8 WHEN 0 THEN array(concat(a, 'n'), b) WHEN 1 THEN array(c, a) WHEN 2 THEN array(concat(e, a)) WHEN 3 THEN array(a, b, c, e) WHEN 4 THEN array(b, c) WHEN 5 THEN array(substr(a, 1, 4), substr(a, 5)) WHEN 6 THEN array(substr(a, 1, 5), c, substr(a, 6)) ELSE array(b, a) END AS n"
    return d.selectExpr("*", "CASE WHEN doc_id % 4 = 3 THEN array(a, b) ELSE array(a) END AS q", name)


def _name_score(q: str, n: str, qi: str, ci: str, explains: str) -> str:
    one = f"{qi}[1]"
    ends = _some(n, "t", _some(f"[{one}, {stem(one)}]", "h", "length(h) >= 4 AND ends_with(t, h) AND length(t) > length(h) AND length(t) <= length(h) + 8"))
    return f"""CASE WHEN len({q}) = 0 OR len({n}) = 0 THEN 0 WHEN list_slice({n}, 1, greatest(len({q}), 1)) = {q} OR list_slice({ci}, 1, greatest(len({qi}), 1)) = {qi} THEN 0.85 WHEN {explains} AND {_same(one, f'{ci}[1]')} THEN 0.85 WHEN {explains} THEN 0.8
WHEN len({qi}) = 1 AND (length({one}) >= 4 AND {ends} OR {_compound(one, n)} OR {_compound(one, ci)}) THEN 0.6
ELSE 0.7 * len(list_intersect({qi}, {ci})) / len(list_distinct(list_concat({qi}, {ci}))) END"""


def _explains(qi: str, ci: str) -> str:
    return f"len({ci}) <= len({qi}) + 1 AND len(list_filter({qi}, lambda w: NOT ({_some(ci, 't', _same('w', 't'))}))) = 0"


@query(f"""WITH {_DOCS}, s AS (SELECT doc_id, q, n, {_identity('q')} AS qi, {_identity('n')} AS ci FROM p),
x AS (SELECT *, {_explains('qi', 'ci')} AS explains FROM s) SELECT doc_id, round({_name_score('q', 'n', 'qi', 'ci', 'explains')}, 6) AS score FROM x""")
def german_score(spark, sf_dir):
    return pairs(spark, sf_dir).select("doc_id", F.round(scoring.german_name_score(F.col("q"), F.col("n")), 6).alias("score"))


@query(f"WITH {_DOCS} SELECT doc_id, {_compound('a', '[b, c, e, substr(a, 1, 5), substr(a, 6)]')} AS evidenced, {_compound('a || b', '[b, a]')} AS own FROM p")
def compound_evidence(spark, sf_dir):
    own = F.array("b", "c", "e", F.expr("substr(a, 1, 5)"), F.expr("substr(a, 6)"))
    return pairs(spark, sf_dir).select("doc_id", text.compound_matches(F.col("a"), own).alias("evidenced"), text.compound_matches(F.concat("a", "b"), F.array("b", "a")).alias("own"))


_UNLIKE = f"({stem('substr(l, i + 1)')}) = ({stem('substr(r, j + 1)')}) AND NOT {_same('substr(l, 1, i)', 'substr(r, 1, j)')} AND NOT starts_with(substr(l, 1, i), substr(r, 1, j)) AND NOT starts_with(substr(r, 1, j), substr(l, 1, i))"
_LEADS = "list_filter(list_concat([{0}, {1}], list_transform({2}, lambda i: substr({0}, 1, i))), lambda x: length(x) >= 5)"


def _leads(x: str) -> str:
    return _LEADS.format(x, stem(x), _splits(x, 5))


@query(f"WITH {_DOCS}, w AS (SELECT doc_id, a || b AS l, CASE WHEN doc_id % 3 = 0 THEN a || e ELSE c || b END AS r FROM p) SELECT doc_id, {_some(_splits('l'), 'i', _some(_splits('r'), 'j', _UNLIKE))} AS conflict, len(list_intersect({_leads('l')}, {_leads('r')})) > 0 AS leading FROM w")
def compound_identity(spark, sf_dir):
    w = pairs(spark, sf_dir).selectExpr("doc_id", "concat(a, b) AS l", "CASE WHEN doc_id % 3 = 0 THEN concat(a, e) ELSE concat(c, b) END AS r")
    return w.select("doc_id", text.specifier_conflict(F.col("l"), F.col("r")).alias("conflict"), text.shares_leading(F.col("l"), F.col("r")).alias("leading"))


_PREFIX = "substr(w, 1, length(w) - length(h))"
_GLUED = "list_filter([" + words([g for g in text.LINKS if g]) + "], lambda g: ends_with(x, g) AND length(x) - length(g) >= 3)[1]"


@query(f"""WITH {_DOCS}, w AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN b || a WHEN 1 THEN b || 's' || a WHEN 2 THEN 'glutenfrei' || a ELSE 'fresh' || a || 'n' END AS w, a AS k FROM p),
f AS (SELECT *, list_filter(list_concat([k, {stem('k')}], CASE WHEN length(k) >= 5 THEN [{', '.join(f"k || '{e}'" for e in text.PLURALS)}] ELSE [] END), lambda h: length(h) >= 3 AND ends_with(w, h) AND length(w) > length(h))[1] AS h FROM w),
x AS (SELECT *, {_PREFIX} AS x FROM f), y AS (SELECT *, substr(x, 1, length(x) - length({_GLUED})) AS y FROM x)
SELECT doc_id, CASE WHEN h IS NOT NULL AND NOT {_same('w', 'k')} AND length(x) >= 3 AND x NOT IN ({words(text.DESCRIPTORS)}) AND coalesce(y NOT IN ({words(text.DESCRIPTORS)}), true) AND {_absent('x')} IS NULL AND (y IS NULL OR {_absent('y')} IS NULL) THEN x END AS specifier FROM y""")
def specifier_of(spark, sf_dir):
    w = pairs(spark, sf_dir).selectExpr("doc_id", "CASE doc_id % 4 WHEN 0 THEN concat(b, a) WHEN 1 THEN concat(b, 's', a) WHEN 2 THEN concat('glutenfrei', a) ELSE concat('fresh', a, 'n') END AS w", "a AS k")
    return w.select("doc_id", text.compound_specifier(F.col("w"), F.col("k")).alias("specifier"))


@query(f"WITH {_DOCS}, w AS (SELECT doc_id, a || CASE doc_id % 6 WHEN 0 THEN 'frei' WHEN 1 THEN '-free' WHEN 2 THEN 'freie' ELSE '' END AS w FROM p UNION ALL SELECT doc_id, ['zuckerfrei', 'afrei', 'eifrei', 'frei'][1 + doc_id % 4] FROM p) SELECT doc_id, w, {_absent('w')} AS absent FROM w")
def absences(spark, sf_dir):
    p = pairs(spark, sf_dir)
    w = p.selectExpr("doc_id", "concat(a, CASE doc_id % 6 WHEN 0 THEN 'frei' WHEN 1 THEN '-free' WHEN 2 THEN 'freie' ELSE '' END) AS w")
    fixed = p.selectExpr("doc_id", "array('zuckerfrei', 'afrei', 'eifrei', 'frei')[doc_id % 4] AS w")
    return w.unionAll(fixed).select("doc_id", "w", text.absence_stem(F.col("w")).alias("absent"))


_NAME = "CASE doc_id % 5 WHEN 0 THEN a || '/' || b || ' (' || c || ')' WHEN 1 THEN a || ' ' || b || ' (mit ' || c || ')' WHEN 2 THEN a || ' (' || c || ') ' || b || ' ' || e WHEN 3 THEN a || ' / ' || b || '/' ELSE a || ' (S X) (' || c || ' ' || e || ')' END"
_PARTS = r"list_filter(list_transform(string_split(regexp_replace(name, '\([^)]*\)', ' ', 'g'), '/'), lambda x: trim(x)), lambda x: x <> '')"
_FIRST = r"regexp_replace(replace(replace(replace(replace(lower(string_split_regex(x, '\s+')[1]), 'ß', 'ss'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), '[^\p{L}]', '', 'g')"


@query(rf"""WITH {_DOCS}, m AS (SELECT doc_id, {_NAME} AS name FROM p),
o AS (SELECT doc_id, name, regexp_extract_all(name, '\(([^)]+)\)', 1) AS inside, CASE WHEN len({_PARTS}) > 1 THEN {_PARTS} ELSE [regexp_replace(name, '\([^)]*\)', ' ', 'g')] END AS base FROM m),
s AS (SELECT doc_id, name, list_transform(list_concat(base, inside, flatten(list_transform(inside, lambda v: list_transform(base, lambda y: CASE WHEN regexp_matches(y, '\S') THEN v || regexp_replace(y, '^\s*\S+', '') ELSE y END)))), lambda x: trim(x)) AS every FROM o),
u AS (SELECT doc_id, name, unnest(every) AS x, unnest(range(len(every))) AS k FROM s),
f AS (SELECT doc_id, x, min(k) AS k FROM u WHERE x <> '' AND len(string_split_regex(x, '\s+')) <= 2 AND regexp_matches(x, '\p{{L}}{{3,}}') AND {_FIRST} NOT IN ({words(text.FUNCTION_WORDS)}) GROUP BY doc_id, x)
SELECT m.doc_id, coalesce(string_agg(x, '|' ORDER BY k), '') AS spellings FROM m LEFT JOIN f ON f.doc_id = m.doc_id GROUP BY m.doc_id""")
def spellings(spark, sf_dir):
    name = "CASE doc_id % 5 WHEN 0 THEN concat(a, '/', b, ' (', c, ')') WHEN 1 THEN concat(a, ' ', b, ' (mit ', c, ')') WHEN 2 THEN concat(a, ' (', c, ') ', b, ' ', e) WHEN 3 THEN concat(a, ' / ', b, '/') ELSE concat(a, ' (S X) (', c, ' ', e, ')') END AS name"
    return pairs(spark, sf_dir).selectExpr("doc_id", name).select("doc_id", F.array_join(text.name_alternates(F.col("name")), "|").alias("spellings"))


_WORDS = "string_split(x, ' ')"
_COLOURS = words([q + e for q in text.QUALIFIERS for e in ("", *text.ADJECTIVE)])
_BASE = "regexp_replace(a, '[^\\p{L}\\p{N}]', '', 'g')"
_FORMS = f"list_filter(list_concat([{', '.join(f"CASE WHEN ends_with(k, '{e}') THEN substr(k, 1, length(k) - {len(e)}) END" for e in text.PLURALS)}], [{', '.join(f"k || '{e}'" for e in text.PLURALS)}]), lambda f: f IS NOT NULL)"


@query(f"""WITH {_DOCS}, w AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'rote ' || a || ' ' || b WHEN 1 THEN 'gelb' ELSE a || ' ' || c END AS x, {_BASE} AS k FROM p),
n AS (SELECT doc_id, k, unnest({_FORMS}) AS f, unnest(range(len({_FORMS}))) AS o FROM w),
g AS (SELECT doc_id, f, min(o) AS o FROM n WHERE f <> k AND length(f) >= 5 AND length(k) >= 4 AND {_same('f', 'k')} GROUP BY doc_id, f),
a AS (SELECT doc_id, string_agg(f, ',' ORDER BY o) AS fs FROM g GROUP BY doc_id)
SELECT w.doc_id, CASE WHEN len(list_filter({_WORDS}, lambda y: y NOT IN ({_COLOURS}))) BETWEEN 1 AND len({_WORDS}) - 1 THEN array_to_string(list_filter({_WORDS}, lambda y: y NOT IN ({_COLOURS})), ' ') END AS base,
CASE WHEN length(k) < 4 THEN '' ELSE concat_ws(',', k, fs) END AS needles FROM w LEFT JOIN a ON a.doc_id = w.doc_id""")
def base_and_needles(spark, sf_dir):
    w = pairs(spark, sf_dir).selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN concat('rote ', a, ' ', b) WHEN 1 THEN 'gelb' ELSE concat(a, ' ', c) END AS x", "a")
    return w.select("doc_id", text.base_identity(F.col("x")).alias("base"), F.array_join(text.recall_needles(F.col("a")), ",").alias("needles"))


_ASCII = "trim(regexp_replace(translate(lower(x), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'))"
_OWN = f"list_filter(string_split({_ASCII}, ' '), lambda t: length(t) >= 4 AND t NOT IN ({words(text.LABEL_WORDS)}))"


@query(f"""WITH {_DOCS}, w AS (SELECT doc_id, a || b || ' ' || c || ' sauce ' || e AS x FROM p), o AS (SELECT doc_id, {_OWN} AS own FROM w),
s AS (SELECT doc_id, list_distinct(list_filter(list_concat(own, flatten(list_transform(own, lambda y: flatten(list_transform({_splits('y', 5)}, lambda i: [substr(y, 1, i), substr(y, i + 1)]))))), lambda t: t NOT IN ({words(text.LABEL_WORDS)}))) AS every FROM o)
SELECT doc_id, array_to_string(list_sort(list_filter(every, lambda t: length(t) >= list_max(list_transform(every, lambda z: length(z))) - 2)), ',') AS distinctive FROM s""")
def distinctive(spark, sf_dir):
    w = pairs(spark, sf_dir).selectExpr("doc_id", "concat(a, b, ' ', c, ' sauce ', e) AS x")
    return w.select("doc_id", F.array_join(F.array_sort(text.distinctive_tokens(F.col("x"))), ",").alias("distinctive"))


_SAID = "['', 'ganz', 'gemahlene', 'getrocknet', 'tiefgekuehlt', 'frischer', 'mandelflocken'][1 + CAST({} AS BIGINT) % 7]"
_HELD = "CASE WHEN doc_id % 10 = 0 THEN 'Spices, ' ELSE '' END || a || ' ' || " + _SAID.format("doc_id // 3") + " || ' ' || b || ' ' || " + _SAID.format("doc_id // 21")


def _at(markers) -> str:
    forms = words([m + e for m in markers for e in ("", *text.ADJECTIVE)])
    long = words([m for m in markers if len(m) >= 4])
    return f"list_min(list_filter(list_transform(range(1, len(t) + 1), lambda k: CASE WHEN t[k] IN ({forms}) OR {_some(f'[{long}]', 'm', 'ends_with(t[k], m)')} THEN k END), lambda k: k IS NOT NULL))"


def _earliest(table) -> str:
    places = ", ".join(f"{{'k': {_at(ws)}, 'o': {i}, 'v': '{v}'}}" for i, (v, ws) in enumerate(table))
    return f"coalesce(list_sort(list_filter([{places}], lambda s: s.k IS NOT NULL))[1].v, 'unknown')"


def _against(asked: str, offered: str, table) -> str:
    return f"concat_ws('/', least({asked}, {offered}), greatest({asked}, {offered})) IN ({words(['/'.join(sorted(p)) for p in table])})"


_PRESERVED = f"CASE WHEN {_earliest(text.PRESERVATIONS)} <> 'unknown' THEN {_earliest(text.PRESERVATIONS)} WHEN starts_with(lower(name), 'spices,') THEN 'dried' WHEN list_has_any(t, [{words(text.FALSE_FRIENDS)}]) THEN 'fresh' ELSE 'unknown' END"


@query(f"""WITH {_DOCS}, m AS (SELECT doc_id, {_HELD} AS name FROM p), k AS (SELECT doc_id, name, {tk('name')} AS t FROM m),
f AS (SELECT doc_id, {_earliest(text.FORMS)} AS form, {_PRESERVED} AS preservation, ['whole', 'ground', 'unknown'][1 + doc_id % 3] AS qf, ['fresh', 'dried', 'canned', 'unknown'][1 + doc_id % 4] AS qp FROM k)
SELECT doc_id, form, preservation, {_against('qf', 'form', rules.FORM_PAIRS)} AS form_conflict, {_against('qp', 'preservation', rules.PRESERVATION_PAIRS)} AS preservation_conflict, qp = 'fresh' AND form IN ('ground', 'powder', 'flakes') AS processed_conflict FROM f""")
def stated_attributes(spark, sf_dir):
    said = lambda n: f"array('', 'ganz', 'gemahlene', 'getrocknet', 'tiefgekuehlt', 'frischer', 'mandelflocken')[CAST(doc_id div {n} AS INT) % 7]"
    m = pairs(spark, sf_dir).selectExpr("doc_id", f"concat(CASE WHEN doc_id % 10 = 0 THEN 'Spices, ' ELSE '' END, a, ' ', {said(3)}, ' ', b, ' ', {said(21)}) AS name")
    rows = m.withColumn("t", text.tokens(F.col("name")))
    rows = rows.select("doc_id", text.earliest_marker(F.col("t"), text.FORMS).alias("form"), text.preservation_of(F.col("name"), F.col("t")).alias("preservation"), F.expr("array('whole', 'ground', 'unknown')[doc_id % 3]").alias("qf"), F.expr("array('fresh', 'dried', 'canned', 'unknown')[doc_id % 4]").alias("qp"))
    conflicts = [rules.stated_conflict(F.col("qf"), F.col("form"), rules.FORM_PAIRS).alias("form_conflict"), rules.stated_conflict(F.col("qp"), F.col("preservation"), rules.PRESERVATION_PAIRS).alias("preservation_conflict"), rules.processed_conflict(F.col("qp"), F.col("form")).alias("processed_conflict")]
    return rows.select("doc_id", "form", "preservation", *conflicts)


_CHEESE = "a || ' ' || CAST(10 + doc_id % 50 AS VARCHAR) || ['% Fett i. Tr.', ' % Fett', ',5 % fat in dry matter', '% F.i.T. 12 % Fett'][1 + doc_id % 4]"
_DRY = "TRY_CAST(replace(regexp_extract(lower(name), '" + text.DRY_MATTER + "', 1), ',', '.') AS DOUBLE)"
_APART = r"list_transform(regexp_extract_all(regexp_replace(lower(name), '" + text.DRY_MATTER + r"', '', 'g'), '([0-9]+(?:[.,][0-9]+)?)\s*%', 1), lambda y: TRY_CAST(replace(y, ',', '.') AS DOUBLE))"


@query(f"WITH {_DOCS}, m AS (SELECT doc_id, {_CHEESE} AS name, CASE WHEN doc_id % 2 = 0 THEN 12.0 ELSE 10 + doc_id % 50 END AS claimed FROM p), n AS (SELECT *, {_DRY} AS dry FROM m) SELECT doc_id, dry, CAST(CASE WHEN dry IS NULL OR list_contains({_APART}, CAST(claimed AS DOUBLE)) THEN claimed END AS DOUBLE) AS fat, coalesce(dry <> 45, false) AS refused FROM n")
def dry_matter(spark, sf_dir):
    m = pairs(spark, sf_dir).selectExpr("doc_id", "concat(a, ' ', CAST(10 + doc_id % 50 AS STRING), array('% Fett i. Tr.', ' % Fett', ',5 % fat in dry matter', '% F.i.T. 12 % Fett')[doc_id % 4]) AS name", "CAST(CASE WHEN doc_id % 2 = 0 THEN 12.0 ELSE 10 + doc_id % 50 END AS DOUBLE) AS claimed")
    return m.select("doc_id", text.dry_matter_fat(F.col("name")).alias("dry"), text.reconcile_fat(F.col("name"), F.col("claimed")).alias("fat"), rules.dry_matter_conflict(F.lit("Käse 45 % Fett i. Tr."), F.col("name")).alias("refused"))


_ASKED = "asked AS (SELECT fid AS qid, CASE fid % 4 WHEN 0 THEN toks WHEN 1 THEN [toks[1]] WHEN 2 THEN [toks[1] || toks[len(toks)]] ELSE [toks[len(toks)] || 'n'] END AS q FROM names)"
_HELD_NAMES = "held AS (SELECT fid, CASE fid % 3 WHEN 0 THEN toks WHEN 1 THEN [toks[len(toks)] || toks[1], 'extra', 'word'] ELSE [toks[1] || 'en', toks[len(toks)]] END AS n FROM names)"


@query(f"""WITH {FOODS_SQL}, {NAMES}, {_ASKED}, {_HELD_NAMES}, k AS (SELECT qid, fid, q, n, {_identity('q')} AS qi, {_identity('n')} AS ci FROM asked, held),
x AS (SELECT *, {_explains('qi', 'ci')} AS explains FROM k), y AS (SELECT qid, fid, {_name_score('q', 'n', 'qi', 'ci', 'explains')} AS score FROM x) SELECT qid, fid, round(score, 6) AS score FROM y WHERE score > 0""")
def fuzzy_scores(spark, sf_dir):
    """Every record that a query's name score doesn't rule out; the SQL compares all with all."""
    n = names(spark, sf_dir).withColumns({"a": F.get("toks", F.lit(0)), "z": F.get("toks", F.size("toks") - 1)})
    asked = n.selectExpr("fid AS qid", "CASE fid % 4 WHEN 0 THEN toks WHEN 1 THEN array(a) WHEN 2 THEN array(concat(a, z)) ELSE array(concat(z, 'n')) END AS toks")
    held = n.selectExpr("fid", "CASE fid % 3 WHEN 0 THEN toks WHEN 1 THEN array(concat(z, a), 'extra', 'word') ELSE array(concat(a, 'en'), z) END AS toks")
    return linkage.fuzzy(asked, held, scoring.german_name_score).select("qid", "fid", F.round("score", 6).alias("score"))


_PLURAL = "({0} = {1} OR {0} = {1} || 's' OR {0} = {1} || 'es' OR {1} = {0} || 's' OR {1} = {0} || 'es')"
_CORE = "list_slice(q, len(q), len(q))"


def _classes(toks: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN list_has_any({toks}, [{words(ws)}]) THEN '{name}' END" for name, ws in text.DERIVED) + "], lambda x: x IS NOT NULL)"


_SOURCE = f"list_filter(q, lambda x: x NOT IN ({words([w for _, ws in text.DERIVED for w in ws])}))"
_GATED = f"""(len(list_filter({_CORE}, lambda c: length(c) >= 3)) > 0 AND len(list_filter({_CORE}, lambda c: length(c) >= 3 AND {_some('n', 't', _PLURAL.format('c', 't'))})) = 0
OR len({_classes('q')}) > 0 AND len(list_intersect({_classes('q')}, {_classes('n')})) = 0 OR len({_classes('q')}) > 0 AND len({_SOURCE}) > 0 AND len(list_filter({_SOURCE}, lambda s: {_some('n', 't', _PLURAL.format('s', 't'))})) = 0)"""
_MODIFIERS = f"list_distinct(list_filter(q, lambda m: NOT list_contains({_CORE}, m)))"
_ADJUSTED = f"""8 * least(len(list_filter({_MODIFIERS}, lambda m: {_some('n', 't', _same('m', 't'))})), len({_MODIFIERS}))
- 35 * len(list_filter(n, lambda t: NOT ({_some('q', 'x', _same('x', 't'))}) AND NOT regexp_matches(t, '^[0-9]') AND t NOT IN ({words(text.DESCRIPTORS)}) AND {_absent('t')} IS NULL))"""


@query(f"""WITH {FOODS_SQL}, {NAMES}, {_BLOCK}, k AS (SELECT qid, blocked.fid, a.toks AS q, b.toks AS n, {_identity('a.toks')} AS qi, {_identity('b.toks')} AS ci FROM blocked JOIN names a ON a.fid = qid JOIN names b ON b.fid = blocked.fid),
x AS (SELECT *, {_explains('qi', 'ci')} AS explains FROM k), y AS (SELECT *, {_name_score('q', 'n', 'qi', 'ci', 'explains')} AS s, {_ADJUSTED} AS adj, {_GATED} AS gated FROM x)
SELECT qid, fid, round(s, 6) AS name_score, CAST(adj AS INTEGER) AS adjustment, round(70 * s + adj + CASE WHEN kcal IS NOT NULL THEN 15 ELSE -50 END - CASE WHEN gated THEN 1000 ELSE 0 END, 4) AS score FROM y JOIN foods ON food_id = fid""")
def morph_score(spark, sf_dir):
    rows = blocked_pairs(spark, sf_dir).join(foods(spark, sf_dir).select(F.col("food_id").alias("fid"), "kcal"), "fid")
    core, q, t = F.slice("qtoks", -1, 1), F.col("qtoks"), F.col("toks")
    gated = scoring.core_conflict(core, t) | scoring.derived_conflict(q, t) | scoring.carrier_conflict(q, t)
    score = scoring.morph_score(scoring.german_name_score(q, t), scoring.core_adjustment(core, q, t), F.col("kcal"), gated)
    return rows.select("qid", "fid", F.round(scoring.german_name_score(q, t), 6).alias("name_score"), scoring.core_adjustment(core, q, t).cast("int").alias("adjustment"), F.round(score, 4).alias("score"))


@query(f"""WITH {_DOCS}, m AS (SELECT doc_id, q, [[b, c], [a || 'n', b], n][1 + doc_id % 3] AS n1, [[a], [c, e], [b, a]][1 + doc_id // 3 % 3] AS n2, CASE WHEN doc_id % 2 = 0 THEN [a, b, 'extra'] ELSE [c] END AS en FROM p),
u AS (SELECT doc_id, q, en, unnest([n1, n2]) AS n, unnest([0, 1]) AS o FROM m), s AS (SELECT *, {_identity('q')} AS qi, {_identity('n')} AS ci, {_identity('en')} AS ei FROM u),
x AS (SELECT *, {_explains('qi', 'ci')} AS explains FROM s), y AS (SELECT doc_id, n, o, len(ci) AS w, {_name_score('q', 'n', 'qi', 'ci', 'explains')} AS s, 0.7 * len(list_intersect(qi, ei)) / len(list_distinct(list_concat(qi, ei))) AS es FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, w, o) AS k FROM y) SELECT doc_id, round(greatest(s, es), 6) AS score, CASE WHEN es > s THEN 'english' ELSE array_to_string(n, ' ') END AS name, es > s AS english FROM z WHERE k = 1""")
def best_spelling(spark, sf_dir):
    """The spelling of a record that its score comes from."""
    m = pairs(spark, sf_dir).selectExpr("doc_id", "q", "array(array(b, c), array(concat(a, 'n'), b), n)[doc_id % 3] AS n1", "array(array(a), array(c, e), array(b, a))[CAST(doc_id div 3 AS INT) % 3] AS n2", "CASE WHEN doc_id % 2 = 0 THEN array(a, b, 'extra') ELSE array(c) END AS en")
    spelt = F.transform(F.array("n1", "n2"), lambda n: F.struct(F.array_join(n, " ").alias("name"), n.alias("toks")))
    best = scoring.best_name(F.col("q"), spelt, F.struct(F.lit("english").alias("name"), F.col("en").alias("toks")))
    return m.select("doc_id", best.alias("x")).select("doc_id", F.round("x.score", 6).alias("score"), "x.name", "x.english")
