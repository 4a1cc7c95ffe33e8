"""Grading, tagging, units and plausibility, as SQL expressions that Spark and other engines read alike."""

from __future__ import annotations

#: Grams of a unit, and the densities of spoon and cup measures that apply without a category.
MASS = {"g": 1, "kg": 1000, "mg": 0.001, "oz": 28.35, "lb": 453.592, "dash": 0.3}
SPOONS = {"tbsp": 12, "tsp": 4, "cup": 150, "pinch": 0.4}
VOLUME_ML = {"ml": 1, "l": 1000}
ML_PER_TABLESPOON = 15
#: Categories of our own: (word in the name, grams of a tablespoon), and piece weights.
DENSITIES = (("copper", 14), ("steel", 8), ("brass", 21))
PIECES = (("tin", 60.0), ("nickel", 120.0))


def half_up(x: str, digits: int = 0) -> str:
    """Halves go up, also below zero."""
    scale = 10**digits
    return f"(floor(({x}) * {scale} + 0.5) / {scale})" if digits else f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def sql_round(x: str, digits: int) -> str:
    """round() of the other engines, which scale a double and round the product."""
    return f"round({x}, {digits})"


def spark_round(x: str, digits: int) -> str:
    """The same in Spark, whose round() takes the shortest decimal that reads as the double; they part near halves."""
    return f"(round(({x}) * 1e{digits}) / 1e{digits})"


def spoon_density(name: str) -> str:
    return "CASE " + " ".join(f"WHEN {name} LIKE '%{w}%' THEN {g}.0" for w, g in DENSITIES) + " END"


def grams(quantity: str, unit: str, name: str) -> str:
    """Mass, then spoons by density (a default where no category fits), volume (null without one), pieces, else null."""
    mass = " ".join(f"WHEN {unit} = '{u}' THEN {quantity} * {g}" for u, g in MASS.items())
    scale = {u: g / SPOONS["tbsp"] for u, g in SPOONS.items()}
    spoons = " ".join(f"WHEN {unit} = '{u}' THEN {quantity} * coalesce(({spoon_density(name)}) * {scale[u]!r}, {SPOONS[u]})" for u in SPOONS)
    volume = " ".join(f"WHEN {unit} = '{u}' THEN {quantity} * {ml} * ({spoon_density(name)}) / {ML_PER_TABLESPOON}.0" for u, ml in VOLUME_ML.items())
    pieces = f"WHEN {unit} = 'piece' THEN {quantity} * CASE " + " ".join(f"WHEN {name} LIKE '%{w}%' THEN {g}" for w, g in PIECES) + " END"
    return f"CASE {mass} {spoons} {volume} {pieces} END"


def calorie_tag(kcal: str) -> str:
    return f"CASE WHEN {kcal} IS NULL THEN NULL WHEN {kcal} < 350 THEN 'Calories:Light' WHEN {kcal} <= 600 THEN 'Calories:Moderate' WHEN {kcal} <= 850 THEN 'Calories:Hearty' ELSE 'Calories:Heavy' END"


def digest_tag(kcal: str, fat: str) -> str:
    """By the share of calories from fat; without calories, any fat is slow and none moderate."""
    share = f"({fat} * 900.0 / {kcal})"
    return f"CASE WHEN {kcal} IS NULL OR {fat} IS NULL THEN 'Digest:Unknown' WHEN {kcal} = 0 THEN CASE WHEN {fat} > 0 THEN 'Digest:Slow' ELSE 'Digest:Moderate' END WHEN {share} < 30 AND {kcal} <= 600 THEN 'Digest:Easy' WHEN {share} >= 40 THEN 'Digest:Slow' ELSE 'Digest:Moderate' END"


def completeness(unmatched: str, matched: str, resolved: str, known: str) -> str:
    missing = f"CASE WHEN coalesce({known}, 0) > 0 THEN ({known} - coalesce({resolved}, 0)) / {known} ELSE 1 END"
    return f"CASE WHEN {unmatched} = 0 THEN 'complete' WHEN {matched} = 0 THEN 'withheld' WHEN {missing} > 0.3 THEN 'withheld' ELSE 'partial' END"


def evidence(matched: str, estimated: str, total: str) -> str:
    return f"CASE WHEN {matched} = 0 THEN NULL WHEN coalesce({estimated}, 0) = 0 THEN 'database' WHEN coalesce({total}, 0) <= 0 THEN 'estimated' WHEN {estimated} / {total} > 0.25 THEN 'estimated' ELSE 'mixed' END"


def completeness_reason(unmatched: str, matched: str, resolved: str, known: str, rounded=sql_round) -> str:
    """Why a result is withheld or partial; null for a complete one."""
    missing = f"CASE WHEN coalesce({known}, 0) > 0 THEN ({known} - coalesce({resolved}, 0)) / {known} ELSE 1 END"
    share = f"CAST(CAST(floor({rounded(f'CAST({missing} AS DOUBLE) * 100', 6)} + 0.5) AS BIGINT) AS {{text}})"
    return f"CASE WHEN {unmatched} = 0 THEN NULL WHEN {matched} = 0 THEN 'nothing resolved' WHEN {missing} > 0.3 THEN concat({share}, '% of the weight unresolved') ELSE concat(CAST({unmatched} AS {{text}}), ' unresolved, a minor weight') END"


#: Energy of sugar alcohols in kcal per gram, least and most of the public labelling rules; 2.4 for one that isn't named.
POLYOLS = ((r"\berythrit(ol)?\b", 0.0, 0.0), (r"\bmannit(ol)?\b", 1.6, 2.4), (r"\bisomalt\b", 2.0, 2.4), (r"\blactit(ol)?\b", 2.0, 2.4), (r"\bmaltit(ol)?\b", 2.1, 2.4), (r"\bxylit(ol)?\b|\bbirkenzucker\b", 2.4, 2.4), (r"\bsorbit(ol)?\b", 2.4, 2.6))
POLYOL = 2.4
#: Our own: names of drinks whose energy is no macronutrient's, and of salts. They meet lower-case names.
ALCOHOL = r"\b(wine|beer|rum|gin|whisky|whiskey|vodka|wodka|brandy|cognac|sherry|sekt|schnaps|liqueur|likoer|likör)\b|wein\b|bier\b"
SALT = r"\b(salt|salz|meersalz|kochsalz)\b"


def facts_of_name(name: str, matches) -> dict[str, str]:
    """Columns that implausible() reads, from a name; matches(text, pattern) is an engine's test of a pattern."""
    low = f"lower({name})"
    case = lambda i, other: ", ".join(f"CASE WHEN {matches(low, p[0])} THEN {p[i]}e0 ELSE {other} END" for p in POLYOLS)
    return {"polyol_least": f"least({case(1, '99e0')})", "polyol_most": f"greatest({case(2, '-1e0')})", "alcoholic": matches(low, ALCOHOL), "salty": matches(low, SALT)}


def implausible(n: tuple[str, ...] = ("kcal", "protein", "carbs", "fat", "saturated", "sugar", "sodium"), others: tuple[str, ...] = ("trans", "unsaturated", "fiber", "cholesterol"), polyols: str = "polyols") -> str:
    """The first rule that a record breaks; null if it is plausible. It reads facts_of_name(), too.

    Energy is held against 4, 4 and 9 kcal a gram, with a band for sugar alcohols, which are part of the carbohydrates:
    the grams stated, or all of them where the name is one.
    """
    kcal, protein, carbs, fat, saturated, sugar, sodium = n
    named = "polyol_most >= 0"
    grams = f"(CASE WHEN coalesce({polyols}, 0) > 0 THEN least({polyols}, greatest({carbs}, 0)) WHEN {named} THEN {carbs} ELSE 0 END)"
    base = f"({protein} * 4 + greatest({carbs} - {grams}, 0) * 4 + {fat} * 9)"
    lowest = f"({base} + {grams} * CASE WHEN {named} THEN polyol_least ELSE {POLYOL}e0 END)"
    highest = f"({base} + {grams} * CASE WHEN {named} THEN polyol_most ELSE {POLYOL}e0 END)"
    off = f"({kcal} < {lowest} - greatest(60, {highest} * 0.35) OR {kcal} > {highest} + greatest(60, {highest} * 0.35))"
    negative = " OR ".join(f"{x} < 0" for x in (*n, *others, polyols))
    return (
        f"CASE WHEN {negative} THEN 'negative' WHEN {kcal} > 920 THEN 'kcal' WHEN NOT alcoholic AND {off} THEN 'macros' "
        f"WHEN salty AND {kcal} > 20 THEN 'salt-kcal' WHEN salty AND {sodium} < 20 THEN 'salt-sodium' "
        f"WHEN {saturated} > {fat} + 0.5 THEN 'saturated' WHEN {sugar} > {carbs} + 0.5 THEN 'sugar' END"
    )


def spark_matches(text: str, pattern: str) -> str:
    """The test of a pattern in Spark's SQL."""
    return f"rlike({text}, '" + pattern.replace("\\", "\\\\") + "')"
