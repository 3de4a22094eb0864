"""Text normalisers, similarity, classifiers and evidence mining as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRANCE = r"^(north|south|east|west|main)\s+(entrance|gate)\s+(of|to)\s+"
LEGAL_FORMS = r"\b(inc|incorporated|llc|ltd|limited|corp|corporation|co|company|gmbh)\b"
#: Street words and their short forms.
STREET_WORDS = {"street": "st", "avenue": "ave", "road": "rd", "drive": "dr", "boulevard": "blvd", "lane": "ln", "north": "n", "south": "s", "east": "e", "west": "w"}
#: Words that mark an organisation.
ORGANISATION_WORDS = (
    "llc", "pllc", "lp", "llp", "inc", "incorporated", "corp", "corporation", "company", "co", "holdings", "properties",
    "property", "realty", "real estate", "partners", "partnership", "group", "services", "service", "construction",
    "contracting", "contractors", "engineering", "electric", "electrical", "mechanical", "heating", "cooling", "hvac", "solar",
    "energy", "power", "coop", "cooperative", "builders", "building", "roofing", "plumbing", "bank", "trust", "churc", "church",
    "ministry", "temple", "association", "foundation", "authority", "district", "school", "university", "college", "city",
    "county", "government", "commonwealth", "municipal", "apartments", "league",
)
ORGANISATION = "(^|[^a-z])(" + "|".join(ORGANISATION_WORDS) + ")([^a-z]|$)"


def collapse(text: Column) -> Column:
    """Lower case with every run of other than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def identity_text(name: Column) -> Column:
    """Lower case, ``&`` as "and", without an entrance phrase in front, punctuation collapsed; empty becomes null."""
    plain = F.regexp_replace(F.lower(F.trim(name)), "&", " and ")
    return F.nullif(collapse(F.regexp_replace(plain, ENTRANCE, "")), F.lit(""))


def name_variant(name: Column) -> Column:
    """Without a bracketed ending and quotes."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""), "[\"']", ""))


def business_name(name: Column) -> Column:
    """``identity_text`` without legal forms."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(identity_text(name), LEGAL_FORMS, " "), r"\s+", " ")), F.lit(""))


def address_key(address: Column) -> Column:
    """Collapsed address with street words shortened."""
    key = collapse(address)
    for long, short in STREET_WORDS.items():
        key = F.regexp_replace(key, rf"\b{long}\b", short)
    return key


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of each word, two spaces in front and one behind."""
    words = F.filter(F.split(collapse(text), " "), lambda w: w != "")
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda k: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), k, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 where neither has one."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def party_kind(name: Column) -> Column:
    """``organization`` by its words, ``unknown`` for null or blank, else ``person_or_household``."""
    blank = name.isNull() | (F.trim(name) == "")
    return F.when(blank, "unknown").when(F.lower(name).rlike(ORGANISATION), "organization").otherwise("person_or_household")


def identity_confidence(text: Column, phrase: Column, core: Column) -> Column:
    """0.995 where the phrase occurs, 0.96 where all its core words do, else 0.55."""
    haystack = F.concat(F.lit(" "), collapse(text), F.lit(" "))
    every = (F.size(core) > 0) & F.forall(core, lambda w: F.contains(haystack, F.concat(F.lit(" "), w, F.lit(" "))))
    exact = F.contains(haystack, F.concat(F.lit(" "), collapse(phrase), F.lit(" ")))
    return F.when(exact, 0.995).when(every, 0.96).otherwise(0.55)


def signals(df: DataFrame, keys: Sequence[str], text: str, families: dict[str, str], context: int = 20) -> DataFrame:
    """One row for each match of each family's pattern: its number, the match and the text around its own place.

    A text is cut once into what lies between the matches, and a match is shown between the ends of what lies beside it; so
    the work is that of the text and of its matches, and no match carries the text. Patterns match no empty text.
    """
    of = lambda f, p: F.struct(F.lit(f).alias("family"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("found"), F.split(F.col(text), p, -1).alias("between"))
    listed = df.select(*keys, F.inline(F.array(*[of(f, p) for f, p in families.items()]))).where(F.size("found") > 0)
    # Pieces and matches take turns, and no match is empty, so so many of them are enough for a context.
    n, back, ahead = F.size("found"), 2 * context + 1, 4 * context + 1
    pieces = F.concat(F.flatten(F.zip_with(F.slice("between", F.lit(1), n), F.col("found"), lambda b, f: F.array(b, f))), F.slice("between", n + 1, F.lit(1)))
    laid = listed.select(*keys, "family", "found", F.inline(F.array(F.struct(F.transform(pieces, lambda p: F.right(p, F.lit(context))).alias("tails"), F.transform(pieces, lambda p: F.left(p, F.lit(2 * context))).alias("heads")))))

    def shown(match: Column, k: Column) -> Column:
        first = F.greatest(F.lit(0), 2 * k + 1 - back)
        before = F.right(F.array_join(F.slice("tails", first + 1, 2 * k + 1 - first), ""), F.lit(context))
        return F.struct(match.alias("match"), before.alias("before"), F.array_join(F.slice("heads", 2 * k + 3, F.lit(ahead)), "").alias("after"))

    each = laid.select(*keys, "family", F.posexplode(F.transform("found", shown)).alias("place", "m"))
    around = F.concat("m.before", "m.match", F.left("m.after", F.lit(2 * context) - F.length("m.before")))
    return each.select(*keys, "family", (F.col("place") + 1).alias("place"), F.col("m.match").alias("match"), around.alias("context"))


def page_codes(df: DataFrame, keys: Sequence[str], text: str, rules: dict[str, str]) -> DataFrame:
    """Codes of the rules whose pattern matches, and where the first of each begins."""
    codes = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(c)) for c, p in rules.items()]))
    return df.select(*keys, codes.alias("codes"), *[F.nullif(F.regexp_instr(F.col(text), F.lit(p)), F.lit(0)).alias(f"at_{c}") for c, p in rules.items()])


def conflicts(findings: DataFrame, keys: Sequence[str], family: str, value: str) -> DataFrame:
    """Families with their values; several values are a conflict and nothing is applied."""
    per = findings.groupBy(*keys, family).agg(F.array_sort(F.collect_set(value)).alias("values"))
    conflict = F.size("values") > 1
    return per.select(*keys, family, F.array_join("values", ",").alias("values"), conflict.alias("conflict"), F.when(~conflict, F.element_at("values", 1)).alias("applied"))


def pages_of(text: Column) -> Column:
    """Pages of a document, split at form feeds."""
    return F.split(text, "\f")
