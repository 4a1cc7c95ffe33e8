"""Keys of cached answers, and the provenance kept with them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provender.functions import text

#: What an answer's provenance may hold; an optional field that isn't there isn't written.
PROVENANCE = "struct<reranked:boolean,reason:string,unmet:array<string>>"


def _or_blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def query_key(food: Column, brand: Column) -> Column:
    """The same food with another brand, or without one, is another question."""
    return F.concat_ws("|", _or_blank(text.normalize_identity(food)), _or_blank(text.normalize_identity(brand)))


def attributes_key(form: Column, preservation: Column, fat: Column) -> Column:
    return F.concat_ws("/", F.coalesce(form, F.lit("unknown")), F.coalesce(preservation, F.lit("unknown")), _or_blank(fat.cast("string")))


def german_key(version: str, variants: Column, state: Column, attributes: Column) -> Column:
    return F.concat(F.lit(f"{version}:"), F.array_join(F.transform(variants, lambda v: text.normalize_identity(v)), ","), F.lit("|"), state, F.lit("|"), attributes)


def english_key(version: str, data_version: str, variants: Column, state: Column, attributes: Column, route: Column, core: Column) -> Column:
    return F.concat_ws("|", german_key(f"{version}:{data_version}", variants, state, attributes), route, _or_blank(core))


def miss_context(category: Column, food_type: Column, core: Column, evidence: Column) -> Column:
    """What a miss is valid for: with another category, type, core or evidence the question is asked again."""
    return F.concat_ws("|", *[_or_blank(c) for c in (category, food_type, core, evidence)])


def is_miss(status: Column) -> Column:
    """Only a confirmed absence is a miss; a failure that may pass, or a provider that wasn't asked, is none."""
    return status == "absent"


def grams_key(unit: Column, food: Column) -> Column:
    """Volumes share one key, as their answers are densities."""
    return F.concat(F.lit("v2:"), F.when(unit.isin("ml", "l"), "density").otherwise(unit), F.lit("|"), text.normalize_identity(food))


def nutrients_key(food: Column) -> Column:
    return F.concat(F.lit("v2:"), text.normalize_identity(food))


def rerank_key(provider: Column, identity: Column, state: Column, attributes: Column, ids: Column) -> Column:
    return F.concat(F.lit("v1:"), F.concat_ws("|", provider, F.concat_ws(":", identity), state, attributes, F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")))


def judge_key(prompt: str, model: str, key: Column, fingerprint: Column) -> Column:
    """Another prompt, model, question or pool of candidates is another judgement."""
    return F.concat_ws("|", F.lit(f"j2|{prompt}|{model}"), key, fingerprint)


def provenance(reranked: Column, reason: Column, unmet: Column) -> Column:
    """JSON of the fields that are there; null if none is."""
    held = F.struct(F.when(reranked, F.lit(True)).alias("reranked"), F.nullif(reason, F.lit("")).alias("reason"), F.when(F.size(unmet) > 0, unmet).alias("unmet"))
    return F.nullif(F.to_json(held), F.lit("{}"))


def provenance_read(raw: Column) -> Column:
    """The fields of such JSON; what can't be read is no provenance."""
    return F.from_json(raw, PROVENANCE)
