"""Whether two venue names mean the same venue, once words that many venues share are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# Words of venues, of operators and of identities that tell nothing, identifiers that name a product, and operators.
VENUE_WORDS = (
    "ielts", "test", "testing", "centre", "center", "central", "computer", "cbd", "official", "online", "station", "venue", "location",
    "international", "education", "academy", "institute", "school", "college", "university", "services", "solutions", "lab", "laboratory",
)
OPERATOR_WORDS = ("british", "council", "idp", "education", "limited", "ltd")
SHARED_WORDS = ("global", "english", "language")
PRODUCT_IDENTIFIERS = ("cbd", "gt", "ielts", "selt", "ukvi")
OPERATORS = ("british council", "idp", "wall street english", "aeo", "mts")
INSTITUTION = r"(?i)\b(?:campus|college|school|university|universitario|universite|universidad)\b"
#: The number of a room, floor or building.
SUBPREMISE_NUMBER = r"(?i)\b(?:bldg|building|floor|fl|level|room|suite|unit)\.?\s*[-#:]?\s*(\d+[a-z]?)"
#: What local place names are compared without.
LOCAL_MARKS = r"[\s·•・()（）\[\]【】\-—_,，.。&＆/／]"


def words(*parts: Column) -> Column:
    """The normalised words of all parts; null parts have none."""
    return F.flatten(F.array(*[text.tokens(text.normalised(F.coalesce(p, F.lit("")))) for p in parts]))


def without(names: Column, ignored: Column) -> Column:
    """The words of an array that are not ignored, in order, repeats kept."""
    return F.filter(names, lambda w: ~F.array_contains(ignored, w))


def without_location(value: Column, city: Column, region: Column, postcode: Column, country_name: Column) -> Column:
    """The normalised text without the words of its own location."""
    return F.array_join(without(words(value), words(city, region, postcode, country_name)), " ")


def shared_identity(ours: Column, theirs: Column, name: Column, candidate: Column) -> Column:
    """The share of distinct words in common, if two or more; of a single one, 1 if the name prints it as an identifier.

    ours and theirs are arrays of distinctive words of name and candidate. An identifier is in capitals, as of an operator.
    """
    x, y = F.array_distinct(ours), F.array_distinct(theirs)
    common = F.array_intersect(x, y)
    printed = F.transform(F.regexp_extract_all(name, F.lit(r"\b([A-Z][A-Z0-9]{2,11})\b"), 1), F.lower)
    known = F.array_intersect(F.array_intersect(common, printed), words(candidate))
    named = F.exists(known, lambda w: ~w.isin(*PRODUCT_IDENTIFIERS))
    return F.when(F.size(common) >= 2, F.size(common) / F.least(F.size(x), F.size(y))).when(named, F.lit(1.0)).otherwise(F.lit(0.0))


def venue_similarity(name: Column, candidate: Column, address: Column, city: Column, region: Column, country_name: Column) -> Column:
    """0 to 1: the best of word Dice, bigram Dice and shared identity of what is left of both names.

    Left out are words of the venue's own place, words of its address of three characters or more, and what many venues or
    operators share. 0 if nothing is left of either.
    """
    street = F.filter(words(address), lambda w: F.length(w) >= 3)
    common = F.array(*map(F.lit, dict.fromkeys(VENUE_WORDS + SHARED_WORDS + OPERATOR_WORDS)))
    ignored = F.concat(words(city, region, country_name), street, common)
    ours, theirs = without(words(name), ignored), without(words(candidate), ignored)
    a, b = F.array_join(ours, " "), F.array_join(theirs, " ")
    best = F.greatest(text.token_dice(a, b), text.bigram_dice(F.array_join(ours, ""), F.array_join(theirs, "")), shared_identity(ours, theirs, name, candidate))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(best)


def is_institution(name: Column) -> Column:
    return F.coalesce(name.rlike(INSTITUTION), F.lit(False))


def subpremises_conflict(a: Column, b: Column) -> Column:
    """Whether both addresses number a room, floor or building and have no such number in common."""
    return text.numbers_conflict(F.lower(a), F.lower(b), SUBPREMISE_NUMBER)


def same_operator(name: Column, others: Column) -> Column:
    """Whether a name and an array of names mention the same operator."""
    x, y = text.normalised(name), text.normalised(F.array_join(others, " "))
    mentioned = [x.contains(o) & y.contains(o) for o in OPERATORS]
    return F.coalesce(F.array_contains(F.array(*mentioned), True), F.lit(False))


def same_local_place(a: Column, b: Column) -> Column:
    """Whether one local name, of four characters at least without marks, is or contains the other."""
    x, y = (F.regexp_replace(F.lower(v), LOCAL_MARKS, "") for v in (a, b))
    return F.coalesce((F.length(x) >= 4) & (F.length(y) >= 4) & (x.contains(y) | y.contains(x)), F.lit(False))
