"""Gates by rule tables: ordered mismatches, categories, plant parts of a set, brands. The tables are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provender.functions import nutrition, text

#: Our own defaults: (query pattern, pattern that a candidate must not have, reason), in order.
MISMATCHES = (
    (r"\b(ginger|ingwer)\b", r"\b(ale|soda)\b", "drink"),
    (r"\b(apple|apfel)\b", r"\b(juice|saft|cider)\b", "juice"),
    (r"\bbolt\b", r"\b(hot|old)\b", "worn"),
)
#: Our own defaults: categories that admit no composite, and markers of composites with the category that they imply.
STRICT = ("fruit", "vegetable", "spice", "small", "medium")
MARKERS = ((r"(soup|suppe)", "dish"), (r"(salad|salat)", "dish"), (r"\bgizmo\b", "device"))
#: Our own default, a parameter: words for a kind of food without a kind of it, and words that say no more.
BARE_OIL = (("oil", "oel"), ("neutral", "frying", "vegetable", "bratoel", "speiseoel", "pflanzenoel"))


def unspecific_conflict(query: Column, toks: Column, words=BARE_OIL) -> Column:
    """A query that names a food and no kind of it refuses a candidate that does name a kind. Both are token arrays."""
    names, silent = words
    says_more = lambda ts: F.exists(ts, lambda t: ~t.isin(*names, *silent, *text.DESCRIPTORS))
    holds = lambda ts: F.exists(ts, lambda t: t.isin(*names))
    return holds(query) & holds(toks) & ~says_more(query) & says_more(toks)


def dry_matter_conflict(query: Column, name: Column) -> Column:
    """Both names state fat in dry matter, and not the same."""
    return F.coalesce(text.dry_matter_fat(query) != text.dry_matter_fat(name), F.lit(False))


#: Our own defaults: pairs that contradict each other, whichever side states which.
FORM_PAIRS = (("whole", "ground"), ("whole", "flakes"), ("ground", "flakes"))
PRESERVATION_PAIRS = (("fresh", "dried"), ("fresh", "canned"), ("canned", "dried"), ("frozen", "dried"))


def stated_conflict(asked: Column, offered: Column, pairs) -> Column:
    """Both state something, and the two contradict each other."""
    return F.concat_ws("/", F.least(asked, offered), F.greatest(asked, offered)).isin(*["/".join(sorted(p)) for p in pairs])


def processed_conflict(preservation: Column, form: Column, processed=("ground", "powder", "flakes")) -> Column:
    """A query for something fresh refuses what is ground, powder or flakes."""
    return F.coalesce((preservation == "fresh") & form.isin(*processed), F.lit(False))


def with_sanity(records: DataFrame, name: str = "name") -> DataFrame:
    """Adds insane: why a record's nutrients are implausible; null if they aren't."""
    facts = nutrition.facts_of_name(name, nutrition.spark_matches)
    return records.withColumns({c: F.expr(e) for c, e in facts.items()}).withColumn("insane", F.expr(nutrition.implausible())).drop(*facts)


def no_evidence(similarity: Column, core: Column) -> Column:
    """Nothing of the name is shared, and there is no core that a gate could have checked."""
    return F.coalesce((similarity == 0) & (F.coalesce(F.size(core), F.lit(0)) <= 0), F.lit(False))


def mismatch(query: Column, name: Column, rules=MISMATCHES) -> Column:
    """The reason of the first rule that the pair breaks (null: none): fat in dry matter, a kind that wasn't asked for,
    then the table. A rule is skipped where the query itself names what it forbids. The patterns meet lower-case texts."""
    q, n = F.lower(query), F.lower(name)
    found = F.when(dry_matter_conflict(query, name), "dry-matter").when(unspecific_conflict(text.tokens(query), text.tokens(name)), "unspecific")
    for asked, forbidden, reason in rules:
        found = found.when(q.rlike(asked) & n.rlike(forbidden) & ~q.rlike(forbidden), reason)
    return found


def category_conflict(category: Column, query: Column, name: Column, strict=STRICT, markers=MARKERS) -> Column:
    """A query of a strict category refuses a name with the marker of another one, unless the query has it, too."""
    broken = F.lit(False)
    for pattern, implied in markers:
        broken = broken | (F.lower(name).rlike(pattern) & ~F.lower(query).rlike(pattern) & (F.lower(category) != implied))
    return F.coalesce(F.lower(category).isin(*strict) & broken, F.lit(False))


def part_conflict(candidates: DataFrame, group: str, query: Column, toks: Column) -> DataFrame:
    """part_conflict: the query names no part, and the group's candidates that name all of the query offer several."""
    part = text.first_part(toks)
    full = F.size(F.array_except(query, toks)) == 0
    offered = F.size(F.collect_set(F.when(full, part)).over(Window.partitionBy(group)))
    return candidates.withColumn("part_conflict", part.isNotNull() & (offered > 1) & text.first_part(query).isNull())


def brand_conflict(branded_route: Column, asked: Column, brand: Column, source: Column) -> Column:
    """On the generic route a branded candidate is refused, unless the query's brand stands in its source."""
    evident = F.coalesce((asked != "") & F.contains(F.lower(source), F.lower(asked)), F.lit(False))
    return ~branded_route & ~evident & F.coalesce(brand != "", F.lit(False))


def exact_branded_name(branded_route: Column, query: Column, name: Column, brand: Column) -> Column:
    """On the branded route: the same normalised name, with the brand among its words."""
    same = text.normalize_identity(query) == text.normalize_identity(name)
    padded = F.concat(F.lit(" "), text.normalize_identity(name), F.lit(" "))
    return F.coalesce(branded_route & same & (F.trim(brand) != "") & F.contains(padded, F.concat(F.lit(" "), text.normalize_identity(brand), F.lit(" "))), F.lit(False))
