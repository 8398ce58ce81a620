"""Labels, titles and links that a directory shows for a place, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ways of testing and caveats of locations are called, and how operators are marked on a map.
FORMATS = {"computer_delivered": "Computer-delivered", "writing_on_paper": "Writing on paper"}
VERIFICATION_CAVEATS = {
    "conflicted": "Approximate — independent location evidence conflicts.",
    "unverified": "Unverified — this point has not yet been corroborated by a second evidence path.",
    "approximate": "Approximate — evidence did not agree closely enough for a precise pin.",
}
PRECISION_CAVEATS = {
    "postcode": "Approximate — located to the postal code, not the building.",
    "city": "Approximate — located to the city only.",
    "country": "Very approximate — no street-level match found.",
    "approximate": "Approximate — sources disagreed on this location.",
}
NO_LOCATION = "No map location — use the address below."
SHAPES = {"British Council": "circle", "IDP": "diamond", "IELTS USA": "square"}
COLOURS = {"British Council": "#5F259F", "IDP": "#D9480F", "IELTS USA": "#1D4ED8"}
# Where results are looked up, by operator and, where it matters, country.
PORTALS = {
    ("IELTS USA", None): "https://ieltsregistration.registration-ieltsusa.org/ttp",
    ("British Council", "CN"): "https://ielts.neea.cn/login",
    ("British Council", None): "https://ieltsregistration.britishcouncil.org/ttp",
    ("IDP", "CN"): "https://sign.idpielts.cn/personal-test",
    ("IDP", "IN"): "https://www.ieltsidpindia.com/access/candidatelogin",
    ("IDP", None): "https://ielts.idp.com/results/check-your-result",
}


def named(value: Column, names: dict[str, str], otherwise: str | None = None) -> Column:
    """The name of a value; of any other, and of null, `otherwise`."""
    return F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in names.items()], F.lit(otherwise).cast("string"))


def price_label(price_text: Column) -> Column:
    """The published text as it is."""
    return F.coalesce(price_text, F.lit("Price not published"))


def format_label(fmt: Column) -> Column:
    """Of a format or a way of delivery."""
    return named(fmt, FORMATS, "Paper-based")


def location_caveat(has_geo: Column, verification: Column, precision: Column) -> Column:
    """What to say about a pin; null if it can be trusted."""
    caveat = F.coalesce(named(verification, VERIFICATION_CAVEATS), named(precision, PRECISION_CAVEATS))
    return F.when(~F.coalesce(has_geo, F.lit(False)), NO_LOCATION).otherwise(caveat)


def operator_shape(operator: Column) -> Column:
    return named(operator, SHAPES, "circle")


def operator_colour(operator: Column) -> Column:
    return named(operator, COLOURS, "#64748B")


def in_city(city: Column) -> Column:
    return F.when(F.coalesce(city, F.lit("")) != "", F.concat(F.lit(" in "), city)).otherwise("")


def page_title(name: Column, city: Column, what: str = "IELTS test centre") -> Column:
    return F.concat(name, F.lit(f" — {what}"), in_city(city))


def page_description(name: Column, city: Column, operator: Column) -> Column:
    return F.concat(name, in_city(city), F.lit(": address, test formats, published fees and how to book. Operated by "), operator, F.lit("."))


def result_portal(operator: Column, country: Column) -> Column:
    """Where a candidate finds results; null for unknown operators."""
    fits = lambda who, where: (operator == who) & (F.lit(True) if where is None else F.upper(country) == where)
    return F.coalesce(*[F.when(fits(*key), F.lit(url)) for key, url in PORTALS.items()])


def component(value: Column) -> Column:
    """A text percent-encoded as a part of a url; spaces are %20, and ! ' ( ) * ~ stay as they are."""
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for code, kept in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(kept))
    return out


def report_url(form: str, title: Column, body: Column) -> Column:
    """A link to a form with title and body filled in; spaces are + as in a query."""
    return F.concat(F.lit(f"{form}?title="), F.url_encode(title), F.lit("&body="), F.url_encode(body))


def mail_url(to: str, subject: Column, body: Column) -> Column:
    return F.concat(F.lit(f"mailto:{to}?subject="), component(subject), F.lit("&body="), component(body))
