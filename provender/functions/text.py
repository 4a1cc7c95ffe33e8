"""Text normalisation, tokens, German morphology and marker inference, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lexicons are data: small defaults of our own, replaceable by the callers' tables.
DESCRIPTORS = ("fresh", "small", "large", "whole", "red", "green", "dark", "light", "der", "die", "das", "und", "mit", "von")
STATES = (("dried", ("dried", "dry", "getrocknet")), ("cooked", ("cooked", "boiled", "steel", "gekocht")), ("raw", ("raw", "fresh", "roh")))
FORMS = (("ground", ("ground", "powder", "gemahlen")), ("whole", ("whole", "ganz")), ("flakes", ("flakes", "flocken")))
FAMILIES = (("lean", ("lean", "light", "mager")), ("smoked", ("smoked", "dark")), ("sweet", ("sweet", "red")))
PARTS = ("seed", "leaf", "root")
PRESERVATIONS = (("dried", ("dried", "getrocknet")), ("canned", ("canned", "dose", "konserve")), ("frozen", ("frozen", "tiefgekuehlt", "gefroren")), ("fresh", ("fresh", "frisch", "raw", "roh")))
FALSE_FRIENDS = ("paprikaschote", "peppers")
QUALIFIERS = ("rot", "gelb", "gruen", "blau", "braun", "schwarz", "weiss", "kraus", "glatt")
FUNCTION_WORDS = ("mit", "ohne", "in", "im", "an", "am", "auf", "aus", "bei", "nach", "von", "vom", "zu", "zum", "zur", "und", "oder", "als", "fuer")
LABEL_WORDS = ("sauce", "pulver", "powder", "mix", "paste", "bio", "original", "extra")
ENERGY = ("zucker", "fett", "alkohol", "kohlenhydrate", "sugar", "fat", "alcohol", "carbs")
#: Endings of German plurals and adjectives, and the letters that glue compounds.
PLURALS = ("n", "en", "e", "s")
ADJECTIVE = ("e", "er", "en", "es", "em")
LINKS = ("", "e", "en", "er", "es", "n", "s")
DERIVED = (("oil", ("oil", "copper")), ("flour", ("flour", "steel")), ("juice", ("juice", "brass")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where body uses it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def normalize_german(text: Column) -> Column:
    """Lower case with umlauts and sharp s spelt out; accents stay."""
    pairs = (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, F.lower(text))


def normalize_identity(text: Column) -> Column:
    """normalize_german, everything but letters and digits to single spaces, trimmed: also the form of cache keys."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_german(text), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def normalize_ascii(text: Column) -> Column:
    """Accents dropped (ö to o), then ASCII letters and digits only."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(normalize_german(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda x: x != "")


def tokens_with_hyphens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(normalize_german(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s-]", " "), r"\s+"), lambda x: x != "")


def identity_tokens(toks: Column, descriptors=DESCRIPTORS) -> Column:
    """Without short ones, numbers and descriptors; all of them if nothing is left."""
    def kept(all_: Column) -> Column:
        return let(F.filter(all_, lambda x: (F.length(x) >= 3) & ~x.rlike("^[0-9]") & ~x.isin(*descriptors)), lambda k: F.when(F.size(k) > 0, k).otherwise(all_))

    return let(toks, kept)


def identity_key(toks: Column) -> Column:
    return F.array_join(F.array_sort(toks), " ")


def german_stem(token: Column) -> Column:
    n = F.length(token)
    cut = F.when(token.endswith("en") & (n >= 6), 2).when(token.endswith("n") | token.endswith("e"), 1).otherwise(0)
    return F.when(n <= 5, token).otherwise(F.substring(token, F.lit(1), n - cut))


def german_match(a: Column, b: Column) -> Column:
    """Equal, equal stems, or the shorter one (5 letters at least) with a plural ending."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    plural = (F.length(short) >= 5) & reduce(lambda x, y: x | y, [long == F.concat(short, F.lit(e)) for e in PLURALS])
    return (a == b) | (german_stem(a) == german_stem(b)) | plural


def english_spellings(token: Column) -> Column:
    trimmed = F.array(token, F.concat(token, F.lit("s")), F.concat(token, F.lit("es")), F.regexp_replace(token, "s$", ""), F.regexp_replace(token, "es$", ""))
    return F.array_sort(F.array_distinct(trimmed))


def compound_segments(token: Column, least: int = 4) -> Column:
    """All splits with both parts of `least` letters; none for short tokens (a sequence must not count down)."""
    splits = F.transform(F.sequence(F.lit(least), F.length(token) - least), lambda i: F.struct(F.substring(token, F.lit(1), i).alias("head"), F.substring(token, i + 1, F.length(token)).alias("tail")))
    return F.when(F.length(token) >= 2 * least, splits).otherwise(F.array().cast("array<struct<head:string,tail:string>>"))


def half_matches(half: Column, toks: Column) -> Column:
    return (F.length(half) >= 3) & F.exists(toks, lambda t: (F.length(t) >= 3) & ((t == half) | t.startswith(half) | half.startswith(t) | german_match(t, half)))


def _linked(word: Column, body) -> Column:
    """Whether body holds for the word, or for it without one of the letters that glue a compound in front of it."""
    return F.exists(F.array(*map(F.lit, LINKS)), lambda g: word.startswith(g) & body(F.substring(word, F.length(g) + 1, F.length(word))))


def compound_matches(token: Column, toks: Column) -> Column:
    """Some split whose halves are both evidenced by the tokens, the tail also without linking letters."""
    return F.exists(compound_segments(token), lambda s: half_matches(s["head"], toks) & _linked(s["tail"], lambda t: half_matches(t, toks)))


def absence_stem(token: Column, energy=ENERGY) -> Column:
    """What a word for an absence says is absent (two letters at least, no hyphen behind); null for what carries energy."""
    stem = F.regexp_replace(F.regexp_extract(token, "^(..+)(frei|free)$", 1), r"[-\s]+$", "")
    return F.when((F.length(stem) >= 2) & ~stem.isin(*energy), stem)


def compound_specifier(token: Column, core: Column, descriptors=DESCRIPTORS) -> Column:
    """What stands before the core, its stem or a plural of it, in a compound that ends with that; else null.

    A descriptor, with or without linking letters, or a word for an absence specifies nothing.
    """
    plurals = F.when(F.length(core) >= 5, F.transform(F.array(*map(F.lit, PLURALS)), lambda e: F.concat(core, e))).otherwise(F.array().cast("array<string>"))
    heads = F.filter(F.concat(F.array(core, german_stem(core)), plurals), lambda h: (F.length(h) >= 3) & token.endswith(h) & (F.length(token) > F.length(h)))
    head = F.get(heads, F.lit(0))
    prefix = F.substring(token, F.lit(1), F.length(token) - F.length(head))
    glued = F.get(F.filter(F.array(*[F.lit(g) for g in LINKS if g]), lambda g: prefix.endswith(g) & (F.length(prefix) - F.length(g) >= 3)), F.lit(0))
    bare = F.substring(prefix, F.lit(1), F.length(prefix) - F.length(glued))
    plain = prefix.isin(*descriptors) | F.coalesce(bare.isin(*descriptors), F.lit(False)) | absence_stem(prefix).isNotNull() | F.coalesce(absence_stem(bare).isNotNull(), F.lit(False))
    return F.when(head.isNotNull() & ~german_match(token, core) & (F.length(prefix) >= 3) & ~plain, prefix)


def specifier_conflict(a: Column, b: Column) -> Column:
    """Two compounds name the same head, and disagree about what kind of it."""
    def unlike(x: Column, y: Column) -> Column:
        return (german_stem(x["tail"]) == german_stem(y["tail"])) & ~german_match(x["head"], y["head"]) & ~x["head"].startswith(y["head"]) & ~y["head"].startswith(x["head"])

    return F.exists(compound_segments(a), lambda x: F.exists(compound_segments(b), lambda y: unlike(x, y)))


def shares_leading(a: Column, b: Column, least: int = 5) -> Column:
    """Some leading part of five letters at least is common: the word, its stem, or the head of a split."""
    def leads(t: Column) -> Column:
        heads = F.transform(compound_segments(t, least), lambda s: s["head"])
        return F.filter(F.concat(F.array(t, german_stem(t)), heads), lambda x: F.length(x) >= least)

    return F.arrays_overlap(leads(a), leads(b))


def is_qualifier(word: Column, qualifiers=QUALIFIERS) -> Column:
    """A colour or shape, in any ending of an adjective; word is normalised."""
    forms = [q + e for q in qualifiers for e in ("", *ADJECTIVE)]
    return word.isin(*forms)


def base_identity(text: Column, qualifiers=QUALIFIERS) -> Column:
    """The text without such words; null if nothing, or everything, is left."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~is_qualifier(F.regexp_replace(normalize_german(w), r"[^\p{L}\p{N}]", ""), qualifiers))
    return F.when((F.size(kept) > 0) & (F.size(kept) < F.size(words)), F.array_join(kept, " "))


def lemma(text: Column, lemmas: dict[str, str]) -> Column:
    """The lemma of a text whose letters and digits are a key of the table; null for others."""
    table = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair]) if lemmas else F.lit(None).cast("map<string,string>")
    return F.element_at(table, F.regexp_replace(normalize_german(text), r"[^\p{L}\p{N}]", ""))


def name_alternates(name: Column, openers=FUNCTION_WORDS) -> Column:
    """The spellings that a record's name holds: parts between slashes, names in parentheses, and those in place of the first word.

    A spelling has two words at most, a run of three letters, and begins with no function word.
    """
    inside = F.regexp_extract_all(name, F.lit(r"\(([^)]+)\)"), F.lit(1))
    bare = F.regexp_replace(name, r"\([^)]*\)", " ")
    parts = F.filter(F.transform(F.split(bare, "/"), lambda x: F.trim(x)), lambda x: x != "")
    base = F.when(F.size(parts) > 1, parts).otherwise(F.array(bare))
    swapped = F.flatten(F.transform(inside, lambda alt: F.transform(base, lambda b: F.when(b.rlike(r"\S"), F.concat(alt, F.regexp_replace(b, r"^\s*\S+", ""))).otherwise(b))))

    def is_name(x: Column) -> Column:
        words = F.split(x, r"\s+")
        first = F.regexp_replace(normalize_german(F.get(words, F.lit(0))), r"[^\p{L}]", "")
        return (x != "") & (F.size(words) <= 2) & x.rlike(r"\p{L}{3,}") & ~first.isin(*openers)

    return F.array_distinct(F.filter(F.transform(F.concat(base, inside, swapped), lambda x: F.trim(x)), is_name))


def recall_needles(core: Column) -> Column:
    """The core as letters and digits (four at least), then its inflections of five at least that are the same word."""
    base = F.regexp_replace(normalize_german(F.coalesce(core, F.lit(""))), r"[^\p{L}\p{N}]", "")
    shorter = F.transform(F.array(*map(F.lit, PLURALS)), lambda e: F.when(base.endswith(e), F.substring(base, F.lit(1), F.length(base) - F.length(e))))
    forms = F.concat(shorter, F.transform(F.array(*map(F.lit, PLURALS)), lambda e: F.concat(base, e)))
    derived = F.filter(F.array_distinct(F.array_compact(forms)), lambda f: (f != base) & (F.length(f) >= 5) & german_match(f, base))
    return F.when(F.length(base) >= 4, F.concat(F.array(base), derived)).otherwise(F.array().cast("array<string>"))


def ascii_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_ascii(F.coalesce(text, F.lit(""))), " "), lambda x: x != "")


def distinctive_tokens(text: Column, labels=LABEL_WORDS) -> Column:
    """Words of four letters and parts of compounds of five, no label words, that are at most two letters shorter than the longest."""
    own = F.filter(ascii_tokens(text), lambda t: (F.length(t) >= 4) & ~t.isin(*labels))
    parts = F.flatten(F.transform(own, lambda w: F.flatten(F.transform(compound_segments(w, 5), lambda s: F.array(s["head"], s["tail"])))))
    every = F.filter(F.array_distinct(F.concat(own, parts)), lambda t: ~t.isin(*labels))
    return F.filter(every, lambda t: F.length(t) >= F.array_max(F.transform(every, lambda x: F.length(x))) - 2)


def marker_at(toks: Column, markers: tuple[str, ...]) -> Column:
    """Where, from 0, the first token stands that is a marker, with an adjective's ending or not, or ends with one; null if none does."""
    hit = lambda t: t.isin(*[m + e for m in markers for e in ("", *ADJECTIVE)]) | F.exists(F.array(*map(F.lit, markers)), lambda m: (F.length(m) >= 4) & t.endswith(m))
    return F.array_min(F.filter(F.transform(toks, lambda t, i: F.when(hit(t), i)), lambda i: i.isNotNull()))


def earliest_marker(toks: Column, table) -> Column:
    """The value whose marker comes first, ties by the order of the table; unknown without one."""
    found = F.array_sort(F.filter(F.array(*[F.struct(marker_at(toks, words).alias("at"), F.lit(i).alias("ord"), F.lit(value).alias("value")) for i, (value, words) in enumerate(table)]), lambda s: s["at"].isNotNull()))
    return F.coalesce(F.get(found, F.lit(0))["value"], F.lit("unknown"))


def preservation_of(name: Column, toks: Column, false_friends=FALSE_FRIENDS) -> Column:
    """A marker's; dried for the category of spices; fresh for vegetables that are named like a spice; else unknown."""
    stated = earliest_marker(toks, PRESERVATIONS)
    fresh = F.arrays_overlap(toks, F.array(*map(F.lit, false_friends)))
    return F.when(stated != "unknown", stated).when(F.lower(name).startswith("spices,"), F.lit("dried")).when(fresh, F.lit("fresh")).otherwise(F.lit("unknown"))


def earliest(toks: Column, table) -> Column:
    """The value whose marker comes first among the tokens; ties by the order of the table."""
    places = [F.struct(F.array_min(F.filter(F.transform(F.array(*map(F.lit, words)), lambda w: F.array_position(toks, w)), lambda p: p > 0)).alias("place"), F.lit(i).alias("ord"), F.lit(value).alias("value")) for i, (value, words) in enumerate(table)]
    found = F.array_sort(F.filter(F.array(*places), lambda s: s["place"].isNotNull()))
    return F.coalesce(F.get(found, F.lit(0))["value"], F.lit("unknown"))


def state_of(toks: Column) -> Column:
    """Dried before cooked before raw, else unknown."""
    out = F.lit("unknown")
    for value, words in reversed(STATES):
        out = F.when(F.arrays_overlap(toks, F.array(*map(F.lit, words))), F.lit(value)).otherwise(out)
    return out


def reconcile_state(claimed: Column, toks: Column) -> Column:
    """What the text states wins; a transformed state that it doesn't support becomes unknown."""
    stated = state_of(toks)
    return F.when(stated != "unknown", stated).when(claimed.isin("cooked", "dried"), F.lit("unknown")).otherwise(claimed)


def classes_named(toks: Column, table) -> Column:
    """The sorted names of the table's rows with a word among the tokens."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.arrays_overlap(toks, F.array(*map(F.lit, words))), F.lit(name)) for name, words in table])))


def first_part(toks: Column) -> Column:
    return F.coalesce(*[F.when(F.array_contains(toks, p), F.lit(p)) for p in PARTS])


def percentages(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.,][0-9]+)?)\s*%"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))


DRY_MATTER = r"([0-9]+(?:[.,][0-9]+)?)\s*%\s*(?:fett\s*(?:i\s*[.]?\s*tr\s*[.]?|in\s+(?:der\s+)?trockenmasse)|fat\s+in\s+dry\s+matter|f\s*[.]?\s*i\s*[.]?\s*t\s*[.]?)"


def dry_matter_fat(name: Column) -> Column:
    """The percentage of fat in dry matter that a name states, which is no fat content; null if it states none."""
    return F.replace(F.regexp_extract(F.lower(name), DRY_MATTER, 1), F.lit(","), F.lit(".")).try_cast("double")


def reconcile_fat(name: Column, claimed: Column) -> Column:
    """The claimed fat content, unless the name gives a grade in dry matter and doesn't state the same percentage apart from it."""
    apart = percentages(F.regexp_replace(F.lower(name), DRY_MATTER, ""))
    return F.when(dry_matter_fat(name).isNull() | F.array_contains(apart, claimed), claimed)


def parse_bool(text: Column) -> Column:
    return F.coalesce(text.isin("true", "1"), F.lit(False))


def number_or_null(text: Column) -> Column:
    """The number that a text is; null for none and for what isn't finite."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def two_places(value: Column) -> Column:
    return F.floor(value * 100 + 0.5) / 100


def brand_of(brands: Column) -> Column:
    """Brands joined, blank ones left out; null if none is left."""
    return F.nullif(F.array_join(F.filter(brands, lambda b: F.trim(b) != ""), ", "), F.lit(""))


def parse_yield(text: Column) -> Column:
    """A range gives its rounded mean, else the first number (with a decimal comma), else null."""
    low, high = (F.regexp_extract(text, r"([0-9]+)\s*[-–]\s*([0-9]+)", i).try_cast("double") for i in (1, 2))
    one = F.replace(F.regexp_extract(text, r"([0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(low.isNotNull() & high.isNotNull(), F.floor((low + high) / 2 + 0.5).cast("double")).otherwise(one)


def canonical_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by |, a null part as - (so that it can't vanish)."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256)
