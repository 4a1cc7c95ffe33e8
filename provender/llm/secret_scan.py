"""Secret scans: patterns propose candidates, a random forest drops the false ones; DataFrame operations only.

Candidates are strings of known shapes, assigned values and long strings, each whole. Their features are SQL
expressions: length, class shares, transitions between character classes, variety, coverage by dictionary
words, whether it looks like or stands in a path, and what the words around it say. The forest is trained on
the driver from LABELLED findings (a bounded list that this module makes from rules) and is then itself a SQL
expression, so a scan is one projection of whole texts, without exchange.

Every match is judged at its own place, by the words around it there: up to AROUND characters on each side,
reaching over one other match of its shape at most. Redaction replaces a value that is a secret at one place of a
text wherever it stands in that text, as any copy would give it away.

Values and texts of any length are taken whole. The work grows with a text's length and, for values and places,
with their number and its logarithm; what is left in plain products are moves of pointers, and a search of the
redacted rest for each secret. A null text has no findings and stays null. Repeated rows are each scanned. Extra
columns are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import random
import re
import string
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provender.llm.license_scan import templates

#: The shapes looked for. Group 1 is the candidate.
SHAPES = (
    r"\b(AKIA[0-9A-Z]{16})\b",
    r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b",
    r"\b(xox[abpr]-[A-Za-z0-9-]{10,})\b",
    r"\b(sk[-_][A-Za-z0-9_-]{16,})\b",
    # To the END line; where there is none, with the body as far as it is one.
    r"(-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|(?:\s++[A-Za-z0-9+/=]{32,}+)++(?:[ \t]*+\r?\n[A-Za-z0-9+/=]++(?=[ \t]*+(?:[\r\n]|$)))?)?)",
    r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,}+)",
    # What stands behind a name and "=" is taken without them.
    r"((?<![A-Za-z0-9+/_=-])(?![A-Za-z+/_-]*+=)[A-Za-z0-9+/_=-]{24,}+|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}+)",
)
#: Words that speak for an invented or harmless value, and words beside secrets and beside digests.
HINTS = ("password", "example", "changeme", "placeholder", "sample", "dummy", "secret", "token", "your", "here", "test", "fake", "none", "null", "true", "false", "demo", "value", "string", "user", "name", "admin", "default", "insert", "todo", "xxxx", "file", "path", "data", "image", "version", "release", "index")
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential", "login", "bearer")
HARMLESS = ("example", "sample", "dummy", "placeholder", "sha1", "sha256", "md5", "checksum", "digest", "commit", "hash", "revision", "uuid", "guid", "integrity", "etag", "fixture")
MASK = "[SECRET]"
AROUND = 40
#: Characters of a block by which places in a text are found.
BLOCK = 2048


def learned(words: int = 300, common: int = 60, fair: int = 140) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """From the license texts, which are prose: its commonest words of four letters or more, and pairs of letters, common and less so."""
    prose = re.findall("[a-z]+", " ".join(templates().values()).lower())
    ranked = lambda items: [x for x, _ in sorted(Counter(items).items(), key=lambda c: (-c[1], c[0]))]
    pairs = ranked(w[i : i + 2] for w in prose for i in range(len(w) - 1))
    return tuple(ranked(w for w in prose if len(w) > 3)[:words]), tuple(sorted(pairs[:common])), tuple(sorted(pairs[common : common + fair]))


_WORDS, _COMMON, _FAIR = learned()
DICTIONARY = (*HINTS, *sorted(set(_WORDS) - set(HINTS), key=lambda w: (-len(w), w)))

FEATURES = {
    "size": "double(length({v}))",
    "digits": "regexp_count({v}, '[0-9]') / length({v})",
    "upper": "regexp_count({v}, '[A-Z]') / length({v})",
    "lower": "regexp_count({v}, '[a-z]') / length({v})",
    "moves": "regexp_count({v}, '[a-z][^a-z]|[A-Z][^A-Z]|[0-9][^0-9]|[^a-zA-Z0-9][a-zA-Z0-9]') / length({v})",
    "common_pairs": "regexp_count(lower({v}), '(?=" + "|".join(_COMMON) + ")') / greatest(length({v}) - 1, 1)",
    "fair_pairs": "regexp_count(lower({v}), '(?=" + "|".join(_FAIR) + ")') / greatest(length({v}) - 1, 1)",
    "letters_met": "regexp_count({v}, '(?=[A-Za-z]{{2}})') / greatest(length({v}) - 1, 1)",
    "variety": "size(array_distinct(split({v}, ''))) / least(length({v}), 40)",
    "covered": "1 - length(regexp_replace(lower({v}), '" + "|".join(DICTIONARY) + "', '')) / length({v})",
    "hex": "double(rlike({v}, '^[0-9a-fA-F-]+$'))",
    "path": "double(rlike({v}, '(?:/[^/]+){{2}}|[.][a-z]{{1,4}}$') OR rlike({b}, '[/\\\\\\\\]$|://[^ ]*$') OR rlike({a}, '^(?:/|[.][a-z]{{2,4}}([^a-z]|$))'))",
    "keyword": "double(rlike(lower({b}), '(" + "|".join(KEYWORDS) + ")[^ ]{{0,12}} {{0,2}}[:=]? ?.?$'))",
    "harmless": "double(rlike(lower(concat({b}, ' ', {a})), '" + "|".join(HARMLESS) + "'))",
    "vendor": "double(rlike({v}, '^(AKIA[0-9A-Z]{{16}}$|gh[pousr]_|xox[abpr]-|sk[-_]|-----BEGIN)'))",
    "wordlike": "double(rlike({v}, '^[A-Z]?[a-z]+(?:[-_/+][A-Za-z]?[a-z]+)*+[-_]?[0-9]{{0,4}}$'))",
    "digit": "double(rlike({v}, '[0-9]'))",
    "classes": "double(rlike({v}, '[0-9]')) + double(rlike({v}, '[a-z]')) + double(rlike({v}, '[A-Z]'))",
    "embedded": "double(rlike({b}, ';base64,$') OR rlike({v}, '^data:'))",
    "template": "double(rlike({v}, '^[<$%{{\\\\[(*]|[)>}}\\\\]*]$'))",
}


def labelled(n: int = 2400, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """Findings with labels: (value, text before, text after, 1 for a true secret), made from rules."""
    rng = random.Random(seed)
    words = ["the", "and", "report", "une", "der", "para", "value", "with", "set", "erona", "thnt", "in", "of"]
    text = lambda: " ".join(rng.choice(words) for _ in range(5))
    take = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    every = string.ascii_letters + string.digits
    out = []
    for _ in range(n):
        kind = rng.randrange(24)
        name = rng.choice(["password=", "token = \"", "secret: ", "api_key=", "API_KEY = '", "access_key=\"", "pwd=", "auth: "])
        lead, tail = text() + " ", " " + text()
        harmless = rng.choice(["example ", "sha256 ", "md5: ", "commit ", "checksum ", "dummy ", "uuid ", "integrity "])
        row = {
            0: lambda: ("AKIA" + take(string.ascii_uppercase + string.digits, 16), lead, tail, 1),
            1: lambda: (rng.choice(["ghp_", "gho_", "ghs_"]) + take(every, 36), lead, tail, 1),
            2: lambda: (take("0123456789abcdef", rng.choice([16, 18, 20, 32, 40, 64])), lead + name, tail, 1),
            3: lambda: (take(every + "!#%_-", rng.randint(10, 40)), lead + name, tail, 1),
            4: lambda: (take(every + "+/", rng.randint(32, 64)), lead, tail, 1),
            5: lambda: (rng.choice(["sk-", "xoxb-"]) + take(every, rng.randint(20, 40)), lead, tail, 1),
            6: lambda: (rng.choice(HINTS) + rng.choice(["", "123", "_here", "-value"]) + rng.choice(HINTS), lead + name, tail, 0),
            7: lambda: ("<" + rng.choice(HINTS) + "-" + rng.choice(HINTS) + ">", lead + name, tail, 0),
            8: lambda: (take("0123456789abcdef", rng.choice([32, 40, 64])), lead + harmless, tail, 0),
            9: lambda: ("/".join(rng.choice(["usr", "lib", "data", "img", "v2", "assets", "2021"]) for _ in range(6)) + ".png", lead + rng.choice(["/", "http://x.org/", ""]), tail, 0),
            10: lambda: ("-".join(rng.choice(["release", "candidate", "build", "final", "draft", "section"]) for _ in range(4)) + str(rng.randint(1, 99)), lead, tail, 0),
            11: lambda: (rng.choice(["xxxx", "****", "1234"]) * rng.randint(2, 8), lead + name, tail, 0),
            12: lambda: (take("0123456789", rng.randint(24, 40)), lead, tail, 0),
            13: lambda: ("".join(rng.choice(["tion", "er", "th", "and", "ing", "ou", "es"]) for _ in range(8)) + rng.choice(["2", "19", "-1"]), lead + rng.choice(["", name]), tail, 0),
            14: lambda: (take(rng.choice([every, every + "_-", every + "+/", "0123456789abcdef" * 4 + every]), rng.randint(65, 1500)), lead + rng.choice(["", name]), tail, 1),
            15: lambda: (".".join(["eyJ" + take(every, 33), "eyJ" + take(every + "_-", rng.randint(60, 900)), take(every + "_-", rng.choice([43, 86, 342]))]), lead + name, tail, 1),
            16: lambda: (take(string.ascii_letters, rng.randint(26, 300)), lead, tail, 1),
            17: lambda: (rng.choice(["-", "=", "_", "+", "/", "-=", "=+"]) * rng.randint(24, 200), lead, tail, 0),
            18: lambda: ("".join(rng.choice(["tion", "er", "th", "and", "ing", "ou", "es"]) for _ in range(rng.randint(10, 40))).capitalize(), lead, tail, 0),
            19: lambda: (rng.choice(["-", "_", "/", "+", ""]).join(rng.choice(words + list(HINTS) + list(_WORDS)).capitalize() for _ in range(rng.randint(8, 60))), lead, tail, 0),
            20: lambda: (take(every + "+/", rng.randint(30, 1500)), (lead + "data:image/png;base64,"), tail, 0),
            21: lambda: (take(rng.choice(["0123456789", "ACGT", "acgt", "01", "ab"]), rng.randint(41, 900)), lead, tail, 0),
            22: lambda: (rng.choice(["ab", "Xy1", "abcdefgh", "0123456789", "deadbeef"]) * rng.randint(12, 90), lead, tail, 0),
            23: lambda: ("-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(take(every + "+/", 64) for _ in range(rng.randint(1, 24))) + "\n-----END RSA PRIVATE KEY-----", lead, tail, 1),
        }[kind]()
        out.append((row[0], row[1][-AROUND:], row[2][:AROUND], row[3]))
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A tree by Gini impurity: (feature, threshold, left, right), or the share of true ones at a leaf."""
    share = round(float(y.mean()), 4)
    if depth == 0 or len(y) < 8 or share in (0.0, 1.0):
        return share
    best = None
    for f in rng.choice(x.shape[1], min(8, x.shape[1]), replace=False).tolist():
        values = np.unique(x[:, f])
        for t in np.unique(np.quantile(values, np.linspace(0.05, 0.95, 15))).tolist() if len(values) > 1 else []:
            right = x[:, f] > t
            n = int(right.sum())
            if 3 <= n <= len(y) - 3:
                p, q = y[right].mean(), y[~right].mean()
                impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, round(t, 6), right)
    if best is None:
        return share
    _, f, t, right = best
    right = x[:, f] > t
    if right.all() or not right.any():
        return share
    return f, t, grow(x[~right], y[~right], rng, depth - 1), grow(x[right], y[right], rng, depth - 1)


def train(x: np.ndarray, y: np.ndarray, trees: int = 21, depth: int = 7, seed: int = 5) -> list:
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        forest.append(grow(x[rows], y[rows], rng, depth))
    return forest


def as_sql(tree, row: str) -> str:
    if isinstance(tree, float):
        return f"{tree}D"
    f, t, left, right = tree
    return f"CASE WHEN {row}.{list(FEATURES)[f]} > {t}D THEN {as_sql(right, row)} ELSE {as_sql(left, row)} END"


def features_sql(v: str, b: str, a: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', double({e.format(v=v, b=b, a=a)})" for n, e in FEATURES.items()) + ")"


_FORESTS: dict[tuple, str] = {}


def forest_sql(spark: SparkSession, findings: list[tuple[str, str, str, int]] | None = None) -> str:
    """The forest's vote for a struct `f` of features, as SQL; trained once for the same findings."""
    findings = tuple(findings if findings is not None else labelled())
    if findings not in _FORESTS:
        text = json.dumps([dict(zip("vbay", r, strict=True)) for r in findings])
        rows = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<v:string,b:string,a:string,y:int>>")).alias("r"))
        found = rows.select("r.y", F.expr(features_sql("r.v", "r.b", "r.a")).alias("f")).collect()
        x, y = np.array([list(r.f) for r in found]), np.array([float(r.y) for r in found])
        forest = train(x, y)
        _FORESTS[findings] = "(" + " + ".join(as_sql(t, "f") for t in forest) + f") / {len(forest)}D"
    return _FORESTS[findings]


def redact(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows with secrets replaced in their texts."""
    return _scanned(df, text, least, None).select(*[F.col("redacted").alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns])


def scan(df: DataFrame, text: str = "text", least: float = 0.5, findings: list | None = None) -> DataFrame:
    """The rows with a column `secrets`: array<struct<start, value, score, is_secret, starts>>, an element for each value and verdict with all its places (start and score are the first one's), in order, and `redacted`."""
    rows = _scanned(df, text, least, findings)
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns], F.col("secrets"), F.col("redacted"))


def places_sql(shape: str) -> str:
    """array<struct<p, v, n, b, a>> of a shape's matches in `t`, as SQL: where a value begins, from 1, the value, and what stands before and after it (n: less, the more that is)."""
    r = "'" + shape.replace("\\", "\\\\").replace("'", "\\'") + "'"
    part = lambda x, side: f"{side}(coalesce({x}, ''), {AROUND})"
    # A value ends where its match does. s: what stands between matches.
    before = f"right(concat({part('get(z.s, k - 1)', 'right')}, {part('get(z.m, k - 1)', 'right')}, {part('get(z.s, k)', 'right')}, {part('left(z.m[k], length(z.m[k]) - length(v))', 'right')}), {AROUND})"
    after = f"left(concat({part('get(z.s, k + 1)', 'left')}, {part('get(z.m, k + 1)', 'left')}, {part('get(z.s, k + 2)', 'left')}), {AROUND})"
    found = f"transform(z.v, (v, k) -> named_struct('v', v, 'b', {before}, 'a', {after}, 'step', length(z.s[k]) + length(z.m[k])))"
    none = "CAST(array() AS array<int>)"
    ends = f"aggregate(f, named_struct('at', 1, 'out', {none}), (acc, x) -> named_struct('at', acc.at + x.step, 'out', concat(acc.out, array(acc.at + x.step))), acc -> acc.out)"
    placed = f"transform(array({found}), f -> transform(array({ends}), e -> transform(f, (x, k) -> named_struct('p', e[k] - length(x.v), 'v', x.v, 'n', - length(x.b) - length(x.a), 'b', x.b, 'a', x.a)))[0])[0]"
    held = f"transform(array(named_struct('v', vs, 'm', regexp_extract_all(t, {r}, 0), 's', split(t, {r}, -1))), z -> {placed})[0]"
    return f"transform(array(regexp_extract_all(t, {r}, 1)), vs -> CASE WHEN size(vs) > 0 THEN {held} END)[0]"


def _firsts(array: str, differs: str) -> str:
    """The places in a sorted array, as SQL, at which an element (x) differs from the one before it (y)."""
    return f"filter(CASE WHEN size({array}) > 0 THEN sequence(0, size({array}) - 1) ELSE CAST(array() AS array<int>) END, i -> i = 0 OR {differs.replace('x.', f'{array}[i].').replace('y.', f'{array}[i - 1].')})"


def _scanned(df: DataFrame, text: str, least: float, findings: list | None) -> DataFrame:
    """row (all columns), secrets, redacted."""
    rows = df.select(F.struct("*").alias("row"), F.col(text).alias("t"))
    none = "CAST(array() AS array<struct<p:int,v:string,n:int,b:string,a:string>>)"
    every = ", ".join(f"coalesce({places_sql(p)}, {none})" for p in SHAPES)
    rows = rows.withColumn("c", F.expr(f"array_sort(filter(concat({every}), x -> length(x.v) > 5))"))
    rows = rows.withColumn("c", F.expr(f"transform({_firsts('c', 'x.p <> y.p OR x.v <> y.v')}, i -> c[i])"))
    rows = rows.withColumn("x", F.expr(f"transform(c, s -> named_struct('v', s.v, 'p', s.p, 'f', {features_sql('s.v', 's.b', 's.a')}))"))
    vote = forest_sql(df.sparkSession, findings).replace("f.", "s.f.")
    rows = rows.withColumn("x", F.expr(f"transform(x, s -> named_struct('value', s.v, 'start', s.p - 1, 'score', {vote}))"))
    # By value and verdict; the last of a value's says whether it is a secret anywhere.
    rows = rows.withColumn("g", F.expr(f"array_sort(transform(x, s -> named_struct('value', s.value, 'is_secret', s.score >= {least}D, 'start', s.start, 'score', s.score)))"))
    group = lambda firsts, body: f"transform(array({firsts}), w -> transform(w, (i, k) -> transform(array(slice(g, i + 1, coalesce(get(w, k + 1), size(g)) - i)), q -> {body})[0]))[0]"
    entry = "named_struct('start', q[0].start, 'value', q[0].value, 'score', q[0].score, 'is_secret', q[0].is_secret, 'starts', transform(q, s -> s.start))"
    rows = rows.withColumn("secrets", F.expr(f"array_sort({group(_firsts('g', 'x.value <> y.value OR x.is_secret <> y.is_secret'), entry)})"))
    place = "CASE WHEN q[size(q) - 1].is_secret THEN transform(q, s -> named_struct('a', s.start, 'b', s.start + length(s.value))) ELSE CAST(array() AS array<struct<a:int,b:int>>) END"
    rows = rows.withColumn("spans", F.expr(f"array_sort(flatten({group(_firsts('g', 'x.value <> y.value'), place)}))"))
    # Overlapping matches go as one; between them, copies that no shape matches, longer ones first, as one may hold another.
    last = "get(m, size(m) - 1)"
    union = f"aggregate(spans, CAST(array() AS array<struct<a:int,b:int>>), (m, s) -> CASE WHEN s.a < {last}.b THEN concat(slice(m, 1, size(m) - 1), array(named_struct('a', {last}.a, 'b', greatest({last}.b, s.b)))) ELSE concat(m, array(s)) END)"
    start = "coalesce(get(u, i - 1).b, 0)"
    blocks = f"transform(sequence(0, length(t) div {BLOCK}), o -> substring(t, o * {BLOCK} + 1, {BLOCK}))"
    piece = f"substring(array_join(slice(o, {start} div {BLOCK} + 1, s.a div {BLOCK} - {start} div {BLOCK} + 1), ''), {start} % {BLOCK} + 1, s.a - {start})"
    pieces = f"transform(array({blocks}), o -> transform(concat(u, array(named_struct('a', length(t), 'b', length(t)))), (s, i) -> {piece}))[0]"
    known = "array_sort(filter(transform(filter(secrets, s -> s.is_secret), s -> s.value), v -> contains(rest, v)), (l, r) -> CASE WHEN length(l) > length(r) THEN -1 WHEN length(l) < length(r) THEN 1 ELSE 0 END)"
    masked = f"array_join(transform(array(array_join(e, '\n')), rest -> transform(array({known}), h -> transform(e, y -> aggregate(h, y, (m, v) -> replace(m, v, '{MASK}'))))[0])[0], '{MASK}')"
    redacted = F.expr(f"CASE WHEN size(spans) > 0 THEN transform(array({union}), u -> transform(array({pieces}), e -> {masked})[0])[0] ELSE t END")
    return rows.select("row", "secrets", redacted.alias("redacted"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of places of candidates and of secrets, the latter's places, and digests of the redacted text."""
    out = scan(docs.select("doc_id", "text"))
    every = F.expr("array_distinct(flatten(transform(secrets, s -> s.starts)))")
    places = F.expr("array_sort(array_distinct(flatten(transform(filter(secrets, s -> s.is_secret), s -> s.starts))))")
    return out.select("doc_id", F.size(every).alias("n_candidates"), F.size(places).alias("n_secrets"), places.alias("starts"), F.length("redacted").alias("n_chars_redacted"), F.md5("redacted").alias("redacted_md5"))
