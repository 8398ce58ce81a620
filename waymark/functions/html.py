"""Targeted extraction from server-rendered HTML, as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import character

# The named entities that are decoded; others stay as they are.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "hellip": "…",
    "mdash": "—", "ndash": "–", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”",
}

# Patterns of e-mail addresses, labels of phones, static maps, open location codes and format icons.
EMAIL = r"(?i)([A-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Z0-9.-]+\.[A-Z]{2,})"
PHONE_LABEL = r"(?i)^(?:phone(?:\s+number)?|tel(?:ephone)?\.?)\s*[:.]?\s*"
STATIC_MAP = r"(?i)staticmap\?[^\"']*?center=(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)"
PLUS_CODE = r"(?i)\b([23456789CFGHJMPQRVWX]{4,8}\+[23456789CFGHJMPQRVWX]{2,3})\b"
ON_PAPER, ON_COMPUTER = '(?i)aria-label="Test on paper"', '(?i)aria-label="Test on computer"'


def decoded_names(text: Column) -> Column:
    """Named entities only; & comes last so that nothing is decoded twice."""
    for name in [n for n in ENTITIES if n != "amp"] + ["amp"]:
        text = F.regexp_replace(text, f"(?i)&{name};", ENTITIES[name])
    return text


def _numbers_decoded(text: Column, entity: str, base: int, digits: int) -> Column:
    """The entities of one notation decoded; a number of more digits than the largest code point has means no character."""
    tokens = F.regexp_extract_all(text, F.lit(f"{entity}|[^&]+|&"), 0)
    number = lambda t: F.regexp_extract(t, f"^{entity}$", 1)
    bare = lambda t: F.regexp_replace(number(t), "^0+(?=.)", "")
    code = lambda t: F.conv(F.when(F.length(bare(t)) <= digits, bare(t)).otherwise("-1"), base, -10).cast("long")
    return F.array_join(F.transform(tokens, lambda t: F.when(number(t) != "", character(code(t))).otherwise(t)), "")


def decoded(text: Column) -> Column:
    """Hexadecimal, then decimal, then named entities, each in one pass; unknown names stay, impossible code points are dropped.

    A text without a numeric entity is not cut into tokens at all.
    """
    numeric = lambda t: _numbers_decoded(_numbers_decoded(t, "&#[xX]([0-9a-fA-F]+);", 16, 6), "&#([0-9]+);", 10, 7)
    return decoded_names(F.when(text.contains("&#"), numeric(text)).otherwise(text))


def stripped(html: Column, decode=decoded) -> Column:
    """Text without tags, entities decoded, white space collapsed."""
    return F.trim(F.regexp_replace(decode(F.regexp_replace(html, "<[^>]*>", " ")), r"\s+", " "))


def paragraphs(html: Column) -> Column:
    inner = F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1)
    return F.filter(F.transform(inner, lambda h: stripped(h)), lambda t: t != "")


def hrefs(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]*)"'), 1)
    return F.filter(F.transform(found, lambda h: F.trim(decoded(h))), lambda h: h != "")


def heading(html: Column, css_class: str | None = None) -> Column:
    """The text of the first h1, of the given class if one has it; null if there is none or it is blank."""
    text = lambda pattern: F.nullif(stripped(F.regexp_extract(html, pattern, 1)), F.lit(""))
    first = text(r"(?is)<h1\b[^>]*>(.*?)</h1>")
    return F.coalesce(text(rf'(?is)<h1\b[^>]*class="[^"]*{css_class}[^"]*"[^>]*>(.*?)</h1>'), first) if css_class else first


def complete(html: Column, suffix: str = "</html>") -> Column:
    """Whether a fetched body ends as it should, white space aside."""
    return F.coalesce(F.regexp_replace(html, r"\s+$", "").endswith(suffix), F.lit(False))


def section(html: Column, title: str, tag: str = "h5", most: int = 4000) -> Column:
    """What follows the heading with this title, up to the next closing div, of at most `most` characters."""
    after = F.regexp_extract(html, rf"(?is)<{tag}[^>]*>\s*{title}\s*</{tag}>(.{{0,{most}}})", 1)
    return F.regexp_replace(after, r"(?is)</div>.*$", "")


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), 1)


def phones(text: Column) -> Column:
    """Numbers after an optional label; several if each piece between , ; or / has six digits, else the whole."""
    value = F.regexp_replace(F.trim(text), PHONE_LABEL, "")
    digits = lambda s: F.length(F.regexp_replace(s, r"\D", ""))
    pieces = F.split(value, r"\s*[,;/]\s*")
    chosen = F.when(F.forall(pieces, lambda p: digits(p) >= 6), pieces).otherwise(F.array(value))
    return F.filter(chosen, lambda p: digits(p) >= 6)


def map_centre(html: Column) -> Column:
    """struct(lat, lng) of an embedded static map; null near 0, 0 (a placeholder) or out of range."""
    lat, lng = (F.regexp_extract(decoded(html), STATIC_MAP, i).try_cast("double") for i in (1, 2))
    placeholder = (F.abs(lat) < 1) & (F.abs(lng) < 1)
    return F.when(~placeholder & (F.abs(lat) <= 90) & (F.abs(lng) <= 180), F.struct(lat.alias("lat"), lng.alias("lng")))


def select_options(html: Column) -> Column:
    """The three-letter values of the first select element that has more than twenty of them."""
    selects = F.regexp_extract_all(html, F.lit(r"(?is)<select\b[^>]*>(.*?)</select>"), 1)
    codes = F.transform(selects, lambda s: F.regexp_extract_all(s, F.lit(r'<option[^>]*value="([A-Za-z]{3})"'), 1))
    return F.get(F.filter(codes, lambda c: F.size(c) > 20), F.lit(0))


def slugs_under(html: Column, path: str) -> Column:
    found = F.transform(F.filter(hrefs(html), lambda h: h.contains(path)), lambda h: F.regexp_extract(h, rf"{re.escape(path)}([^/?#]+)", 1))
    return F.array_distinct(F.filter(F.transform(found, F.url_decode), lambda s: s != ""))


def plus_code(text: Column) -> Column:
    """The first open location code in a text, upper-cased."""
    return F.nullif(F.upper(F.regexp_extract(text, PLUS_CODE, 1)), F.lit(""))


def balanced(html: str | None, start: int, tag: str) -> str | None:
    """From the opening tag at `start` to its closing tag; to the end if it is never closed."""
    if html is None:
        return None
    depth = 0
    for m in re.compile(rf"<{re.escape(tag)}\b|(</{re.escape(tag)}\s*>)", re.I).finditer(html, start):
        depth += -1 if m[1] else 1
        if depth == 0:
            return html[start : m.end()]
    return html[start:]


def balanced_elements(tag: str, marker: str):
    """An Arrow function: the elements `tag` whose opening tag matches `marker`, whole, nested ones inside."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(html: pd.Series) -> pd.Series:
        opening = re.compile(rf"<{re.escape(tag)}\b[^>]*{marker}[^>]*>", re.I)
        return html.map(lambda s: [] if s is None else [balanced(s, m.start(), tag) for m in opening.finditer(s)])

    return run


def cards(html: Column, css_class: str = "test-centre-card", badge: str = "test-centre-card__osr(?:-box)?", box: str = "test-centre-card__formats-box", path: str = "/test-centres/") -> Column:
    """array of struct(slug, only) of the linked cards that wear a badge; only: without a box of ordinary formats.

    The slug is in the card's own link, not in what it holds.
    """
    whole = F.filter(balanced_elements("a", rf'class="[^"]*\b{css_class}\b[^"]*"')(html), lambda c: c.rlike(rf"(?i)\b{badge}\b"))
    own = lambda c: F.get(slugs_under(F.regexp_extract(c, r"^(<a\b[^>]*>)", 1), path), F.lit(0))
    found = F.transform(whole, lambda c: F.struct(own(c).alias("slug"), (~c.rlike(rf"(?i)\b{box}\b")).alias("only")))
    return F.array_distinct(F.filter(found, lambda s: s["slug"].isNotNull()))


def offers(html: Column, css_class: str = "ielts-tests-available__test-row") -> Column:
    """array of struct(label, kind, format, price, links) of the rows of a price table.

    Rows without a title, or titled Fee, are headings. The price is the first that is not blank.
    """
    rows = balanced_elements("div", rf'class="[^"]*{css_class}[^"]*"')(html)
    title = lambda r: stripped(F.regexp_extract(r, rf"(?is)<h6[^>]*{css_class}-title[^>]*>(.*?)</h6>", 1))
    prices = lambda r: F.transform(F.regexp_extract_all(r, F.lit(rf"(?is)<p[^>]*{css_class}-price[^>]*>(.*?)</p>"), 1), lambda p: stripped(p))
    price = lambda r: F.get(F.filter(prices(r), lambda p: p != ""), F.lit(0))
    listed = F.transform(rows, lambda r: F.struct(title(r).alias("label"), product_kind(title(r)).alias("kind"), product_format(title(r), r).alias("format"), price(r).alias("price"), hrefs(r).alias("links")))
    return F.filter(listed, lambda o: (o["label"] != "") & (F.lower(o["label"]) != "fee"))


def booking_url(links: Column) -> Column:
    """The first link to a host that takes bookings."""
    return F.get(F.filter(links, lambda u: operator_of(u).isNotNull()), F.lit(0))


# Keywords that name the kind of a published product, first match wins.
KINDS = (("one skill retake", "osr"), ("osr", "osr"), ("life skills", "life_skills"), ("ukvi", "ukvi"), ("general training", "general_training"), ("academic", "academic"))


def product_kind(label: Column) -> Column:
    out = F.when(F.lit(False), "")
    for word, kind in KINDS:
        out = out.when(F.lower(label).contains(word), kind)
    return out.otherwise("other")


def product_format(label: Column, row: Column | None = None) -> Column:
    """On paper or by computer: the accessible label decides, then the title; computer if neither says."""
    label, row = F.lower(label), F.coalesce(row, F.lit("")) if row is not None else F.lit("")
    paper = row.rlike(ON_PAPER)
    computer = row.rlike(ON_COMPUTER)
    return F.when(paper | (~computer & (label.contains("on paper") | label.contains("paper-based"))), "paper_based").otherwise("computer_delivered")


# Hosts that tell who takes bookings.
BOOKING_HOSTS = (
    ("bxsearch.ielts.idp.com", "IDP"), ("idpielts.cn", "IDP"), ("ielts.idp.com", "IDP"), ("ieltsidpindia.com", "IDP"),
    ("ieltsregistration.britishcouncil.org", "British Council"), ("ielts.neea.cn", "British Council"), ("ieltsusa.org", "IELTS USA"), ("registration-ieltsusa.org", "IELTS USA"),
)


def operator_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    out = F.when(F.lit(False), "")
    for known, operator in BOOKING_HOSTS:
        out = out.when((host == known) | host.endswith(f".{known}"), operator)
    return out


def detected_operator(booking_url: Column, slug: Column, name: Column) -> Column:
    """struct(operator, source): by booking host, else slug prefix, else name."""
    by_url = operator_of(booking_url)
    s, n = F.lower(slug), F.lower(name)
    by_slug = F.when(s.startswith("british-council-"), "British Council").when(s.startswith("idp-"), "IDP")
    by_name = F.when(n.contains("british council"), "British Council").when(n.rlike(r"\bidp\b"), "IDP")
    source = F.when(by_url.isNotNull(), "booking_domain").when(by_slug.isNotNull(), "slug").when(by_name.isNotNull(), "name").otherwise("unknown")
    return F.struct(F.coalesce(by_url, by_slug, by_name, F.lit("unknown")).alias("operator"), source.alias("source"))


def external_id(booking_url: Column) -> Column:
    """The number in location= of one operator's booking links."""
    found = F.try_parse_url(booking_url, F.lit("QUERY"), F.lit("location"))
    return F.when((operator_of(booking_url) == "British Council") & found.rlike(r"^\d+$"), found)
