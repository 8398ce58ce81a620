"""Text normalisation, identity keys and similarity measures, as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import bound

# Words that do not tell one venue name from another.
NAME_STOPWORDS = (
    "ielts", "test", "tests", "testing", "centre", "center", "centres", "centers", "the", "of", "and", "ltd", "limited",
    "inc", "llc", "campus", "location", "british", "council", "idp", "education",
)

NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


# -- compatibility decomposition ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fold:
    """What each character of other than Hangul decomposes to, without combining accents: one character, none, or several."""

    single: dict[str, str]
    several: dict[str, str]


@cache
def fold_table() -> Fold:
    """From the character database of this Python: NFKD without U+0300 to U+036F."""
    single, several = {}, {}
    for code in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        c = chr(code)
        if "\u0300" <= c <= "\u036f":
            single[c] = ""
            continue
        d = unicodedata.normalize("NFKD", c)
        if d != c:
            d = "".join(x for x in d if not "\u0300" <= x <= "\u036f")
            (single if len(d) < 2 else several)[c] = d
    return Fold(single, several)


def _translated(text: Column, table: dict[str, str]) -> Column:
    """Characters of the table replaced by one character, or left out for none."""
    kept = {c: d for c, d in table.items() if d}
    return F.translate(text, "".join([*kept, *[c for c in table if c not in kept]]), "".join(kept.values()))


def character(code: Column) -> Column:
    """The character of a code point, through its four bytes; nothing for those that no text can hold (surrogates, beyond Unicode)."""
    possible = (code >= 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(possible, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")


def _syllable(c: Column) -> Column:
    """A Hangul syllable as its two or three letters, by arithmetic on its code point."""
    s = F.ascii(c) - 0xAC00
    last = s % 28
    return F.concat(character(0x1100 + F.floor(s / 588)), character(0x1161 + F.floor(s % 588 / 28)), F.when(last > 0, character(0x11A7 + last)).otherwise(""))


def folded(text: Column, places: int = 4) -> Column:
    """Compatibility decomposition of any script without combining accents, as an expression.

    Most characters become one or none, by translation of the whole text. Only a text that holds others is taken apart; the first
    `places` characters of what such a one becomes are translations of it, too, and the few longer ones are looked up.
    """
    table = fold_table()
    many, hangul = table.several, "[\uac00-\ud7a3]"
    short = {c: d for c, d in many.items() if len(d) <= places}
    long = {c: d for c, d in many.items() if len(d) > places}
    nth = [{c: d[i : i + 1] for c, d in short.items()} for i in range(places)]
    rare = F.create_map(*[F.lit(x) for pair in long.items() for x in pair])
    without = lambda c: F.translate(c, "".join(many), "")  # noqa: E731  a hash lookup a character, where a pattern would try each in turn

    def piece(c: Column) -> Column:
        several = F.coalesce(F.try_element_at(rare, c), F.concat(*[_translated(c, t) for t in nth]))
        return F.when(c < "\x80", c).when(c.between("\uac00", "\ud7a3"), _syllable(c)).when(without(c) == "", several).otherwise(c)

    apart = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), piece), "")
    whole = F.when(text.rlike(hangul) | (without(text) != text), apart).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), _translated(whole, table.single)).otherwise(text)


def normalised(text: Column) -> Column:
    """Lower case without accents, in any script; every run of other than letters, marks and numbers is one space. Null stays null."""
    return F.trim(F.regexp_replace(folded(F.lower(text)), NOT_WORD, " "))


def unmarked(text: Column) -> Column:
    """As normalised(), without marks of any script: what texts of other sources are compared by."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(F.lower(text)), r"\p{M}", ""), NOT_WORD, " "))


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def name_key(name: Column) -> Column:
    """The normalised name without its stopwords, in order."""
    return F.array_join(F.filter(tokens(normalised(name)), lambda t: ~t.isin(*NAME_STOPWORDS)), " ")


def slug_base(slug: Column) -> Column:
    return F.regexp_replace(slug, r"-\d+$", "")


def postcode_key(postcode: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(postcode, F.lit(""))), "[^a-z0-9]", "")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def token_similarity(a: Column, b: Column) -> Column:
    """Shared distinct tokens by the larger set; 0 if either has none."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.when((F.size(x) > 0) & (F.size(y) > 0), F.greatest(F.size(x), F.size(y)))), F.lit(0.0))


def name_similarity(a: Column, b: Column) -> Column:
    return F.greatest(edit_similarity(a, b), token_similarity(a, b))


def _shared(a: Column, b: Column) -> tuple[Column, Column, Column]:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.size(F.array_intersect(x, y)), F.size(x), F.size(y)


def token_containment(a: Column, b: Column) -> Column:
    shared, x, y = _shared(a, b)
    return F.coalesce(F.try_divide(shared, F.least(x, y)), F.lit(0.0))


def token_dice(a: Column, b: Column) -> Column:
    shared, x, y = _shared(a, b)
    return F.coalesce(F.try_divide(2 * shared, x + y), F.lit(0.0))


def _numbered_bigrams(text: Column) -> Column:
    """Bigrams with the number of their occurrence, so that a set intersection counts repeats."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    number = lambda grams, g, i: F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda h: h == g)).cast("string")
    return bound(pairs, lambda grams: F.transform(grams, lambda g, i: F.concat(g, F.lit("#"), number(grams, g, i))))


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice of the bigram multisets of two compact texts: 1 if equal, 0 if either is shorter than two characters."""
    x, y = _numbered_bigrams(a), _numbered_bigrams(b)
    dice = 2 * F.size(F.array_intersect(x, y)) / (F.length(a) + F.length(b) - 2)
    return F.when(a == b, F.lit(1.0)).when((F.length(a) < 2) | (F.length(b) < 2), F.lit(0.0)).otherwise(dice)


def compact(text: Column) -> Column:
    return F.replace(unmarked(text), F.lit(" "), F.lit(""))


def text_similarity(a: Column, b: Column) -> Column:
    return F.greatest(token_dice(unmarked(a), unmarked(b)), bigram_dice(compact(a), compact(b)))


def phone_identity(phone: Column) -> Column:
    digits = F.regexp_replace(phone, r"\D", "")
    return F.when(digits.startswith("00"), F.substring(digits, 3, 1 << 30)).otherwise(digits)


def website_identity(url: Column) -> Column:
    """Lower-cased host, no fragment, no slash at the end of the path; what is no url is lower-cased as it is."""
    parts = r"(?i)^([a-z][a-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?"
    path = F.regexp_replace(F.regexp_extract(url, parts, 3), "/+$", "")
    query = F.regexp_extract(url, parts, 4)
    known = F.concat(F.lower(F.regexp_extract(url, parts, 1)), F.lit("://"), F.lower(F.regexp_extract(url, parts, 2)), path, F.when((path == "") & (query != ""), F.concat(F.lit("/"), query)).otherwise(query))
    return F.when(url.rlike(parts), known).otherwise(F.regexp_replace(F.lower(url), "/+$", ""))


def unique_by(values: Column, identity: Callable[[Column], Column]) -> Column:
    """The first value of each identity, in order; empty identities are left out."""
    first = lambda keys, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1)
    return bound(F.transform(values, identity), lambda keys: F.filter(values, lambda v, i: first(keys, i)))


def phone_overlap(ours: Column, theirs: Column) -> Column:
    """Whether the last eight digits of a phone of ours (of seven digits at least) end one of theirs."""
    last = lambda p: F.substring(phone_identity(p), -8, 8)
    left = F.filter(F.transform(ours, last), lambda d: F.length(d) >= 7)
    return F.coalesce(F.arrays_overlap(left, F.transform(theirs, last)), F.lit(False))


# Hosts that many venues share.
GENERIC_HOSTS = ("britishcouncil.org", "ielts.org", "ielts.idp.com")


def website_host(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")
    return F.when((host != "") & ~host.isin(*GENERIC_HOSTS), host)


def website_overlap(ours: Column, theirs: Column) -> Column:
    hosts = lambda urls: F.filter(F.transform(urls, website_host), lambda h: h.isNotNull())
    return F.coalesce(F.arrays_overlap(hosts(ours), hosts(theirs)), F.lit(False))


def distinctive_tokens(text: Column, ignored: Iterable[str] = NAME_STOPWORDS, most: int = 5, numbers: bool = True) -> Column:
    """The first distinct tokens of at least three characters that are not ignored."""
    kept = F.filter(tokens(unmarked(text)), lambda t: (F.length(t) >= 3) & ~t.isin(*ignored) & (F.lit(numbers) | ~t.rlike(r"^\p{N}+$")))
    return F.slice(F.array_distinct(kept), 1, most)


def contains_either(a: Column, b: Column) -> Column:
    """Whether one compact text, not empty, is part of the other."""
    x, y = compact(F.coalesce(a, F.lit(""))), compact(F.coalesce(b, F.lit("")))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def numbers_conflict(a: Column, b: Column, pattern: str = r"(\d+)") -> Column:
    """Whether both texts have numbers and share none."""
    x, y = F.regexp_extract_all(a, F.lit(pattern), 1), F.regexp_extract_all(b, F.lit(pattern), 1)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


# Words that name a part of a building.
SUBPREMISE = r"(?i)\b(?:bldg|building|floor|fl|level|room|suite|unit)\b"


def has_subpremise(address: Column) -> Column:
    return F.coalesce(address.rlike(SUBPREMISE), F.lit(False))


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


# -- display -------------------------------------------------------------------------------------------------------------


def distance_label(km: Column) -> Column:
    """Metres below one kilometre, one decimal below ten, whole kilometres above."""
    metres = F.concat(F.floor(km * 1000 + 0.5).cast("string"), F.lit(" m"))
    tenths = F.concat((F.floor(km * 10 + 0.5) / 10).cast("decimal(10,1)").cast("string"), F.lit(" km"))
    return F.when(km < 1, metres).when(km < 10, tenths).otherwise(F.concat(F.floor(km + 0.5).cast("string"), F.lit(" km")))


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "high").when(confidence >= 0.5, "medium").otherwise("low")


def signed(n: Column) -> Column:
    """+n, -n, or 0 without a sign."""
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))
