"""Faceted, nested, text and geographic search over places with nested offers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.numbers import cheapest_of_one_currency

MODES = ("computer", "paper", "paper_writing")


@dataclass(frozen=True)
class Search:
    """What a search asks for. None does not filter; an empty list of an offer field matches nothing, of others everything."""

    include_hidden: bool = False
    country: str | None = None
    city: str | None = None
    operators: Sequence[str] = ()
    formats: Sequence[str] = ()
    retake: bool | None = None
    kinds: Sequence[str] | None = None
    modules: Sequence[str] | None = None
    categories: Sequence[str] | None = None
    modes: Sequence[str] | None = None
    max_price: float | None = None
    words: str | None = None
    near: tuple[float, float] | None = None
    within_km: float | None = None


def module_of(module: Column, label: Column, kind: Column) -> Column:
    derived = (
        F.when(label.rlike(r"(?i)life\s*skills") | (kind == "life_skills"), "life_skills")
        .when(label.rlike(r"(?i)general\s+training|\bgt\b") | (kind == "general_training"), "general_training")
        .when(label.rlike(r"(?i)academic|\bac\b") | (kind == "academic"), "academic")
        .otherwise("other")
    )
    return F.coalesce(module, derived)


def category_of(category: Column, label: Column, kind: Column) -> Column:
    secure = label.rlike(r"(?i)life\s*skills|\bukvi\b|\bselt\b") | kind.isin("ukvi", "life_skills")
    return F.coalesce(category, F.when(secure, "ukvi_selt").otherwise("standard"))


def mode_of(module: Column, label: Column, fmt: Column) -> Column:
    """How a test is taken; life skills are spoken and have none."""
    mode = F.when(F.lower(label).contains("writing on paper"), "paper_writing").when(fmt == "paper_based", "paper").otherwise("computer")
    return F.when(module != "life_skills", mode)


def visible(publishable: Column, future: Column, offers: Column) -> Column:
    """Publishable with a priced offer, or announced for the future."""
    priced = F.exists(offers, lambda o: F.coalesce(F.trim(o["text"]), F.lit("")) != "")
    return F.coalesce((publishable & priced) | future, F.lit(False))


def _offer_test(ask: Search) -> object | None:
    """The test that one and the same offer has to pass in all its parts; None if nothing is asked of offers."""
    wanted = {"kind": ask.kinds, "module": ask.modules, "category": ask.categories, "mode": ask.modes}
    wanted = {k: list(v) for k, v in wanted.items() if v is not None}
    if not wanted:
        return None

    def test(offer: Column) -> Column:
        out = F.lit(True)
        for field, values in wanted.items():
            known = offer[field].isin(*values) if values else F.lit(False)
            out = out & (F.coalesce(known, F.lit(set(values) >= set(MODES))) if field == "mode" else F.coalesce(known, F.lit(False)))
        return out

    return test


def search(places: DataFrame, ask: Search) -> DataFrame:
    """The places that match, with only the offers that match, and price, currency and distance_km worked out anew.

    places has id, name, city, country, operator, formats, retake, retake_only, visible, haystack, lat, lng, pinnable and offers, an
    array of structs (kind, module, category, mode, format, text, currency, price, status). Retake-only places pass offer
    and price filters when a search asks for the retake. Distances are for pinnable places; a radius leaves out the others.
    """
    found = places if ask.include_hidden else places.where("visible")
    if ask.country:
        found = found.where(F.lower("country") == ask.country.lower())
    if ask.operators:
        found = found.where(F.col("operator").isin(*ask.operators))
    if ask.formats:
        found = found.where(F.arrays_overlap("formats", F.array(*map(F.lit, ask.formats))))
    if ask.retake is not None:
        found = found.where(F.coalesce("retake", F.lit(False)) == ask.retake)
    if ask.city:
        found = found.where(text.normalised(F.col("city")) == text.normalised(F.lit(ask.city)))
    exempt = F.coalesce(F.col("retake_only"), F.lit(False)) if ask.retake else F.lit(False)
    test = _offer_test(ask)
    if test is not None:
        found = found.withColumn("offers", F.when(exempt, F.col("offers")).otherwise(F.filter("offers", test))).where(exempt | (F.size("offers") > 0))
    found = found.withColumn("_best", cheapest_of_one_currency(F.col("offers"))).withColumns({"price_text": F.col("_best.text"), "currency": F.col("_best.currency"), "price": F.col("_best.price")}).drop("_best")
    if ask.max_price is not None:
        found = found.where(exempt | F.coalesce(F.col("price") <= ask.max_price, F.lit(False)))
    if ask.words:
        found = found.where(F.col("haystack").contains(text.normalised(F.lit(ask.words))))
    distance = F.when(F.col("pinnable"), geo.haversine_km(F.lit(ask.near[0]), F.lit(ask.near[1]), F.col("lat"), F.col("lng"))) if ask.near else F.lit(None).cast("double")
    found = found.withColumn("distance_km", distance)
    return found.where(F.coalesce(F.col("distance_km") <= ask.within_km, F.lit(False))) if ask.near and ask.within_km is not None else found


def haystack(*parts: Column) -> Column:
    return text.normalised(F.concat_ws(" ", *parts))


def ordered(found: DataFrame, by: str) -> DataFrame:
    """By name, price, distance or city; unknown prices and distances last, ties by name, then id."""
    keys = {"price": [F.asc_nulls_last("price")], "distance": [F.asc_nulls_last("distance_km")], "city": [F.asc_nulls_first("city")], "name": []}[by]
    return found.orderBy(*keys, "name", "id")


def facet(found: DataFrame, column: str) -> DataFrame:
    """(value, n): places per value, nulls left out."""
    return found.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def neutral_facet(places: DataFrame, ask: Search, column: str = "operator", field: str = "operators") -> DataFrame:
    """(value, n, universe) of every visible value, counted under all filters but the facet's own; none is left out at zero."""
    universe = facet(places.where("visible"), column).withColumnRenamed("n", "universe")
    counted = facet(search(places, replace(ask, **{field: ()})), column)
    return universe.join(counted, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"), "universe")


def offer_facet(found: DataFrame, field: str) -> DataFrame:
    """(value, n): places that have an offer with each value, each counted once."""
    values = found.select("id", F.explode(F.array_distinct(F.transform("offers", lambda o: o[field]))).alias("value"))
    return values.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))


def price_ceiling(found: DataFrame) -> DataFrame:
    """One row: currencies, and the highest price rounded up if there is exactly one currency."""
    many = F.sort_array(F.collect_set("currency"))
    return found.agg(many.alias("currencies"), F.when(F.size(many) == 1, F.ceil(F.max("price"))).alias("ceiling"))


def administered(places: DataFrame, words: str = "", queue_only: bool = False, most: int = 200) -> DataFrame:
    """Places whose id, name, address, city or country has these words, by id; `most` of them, or the whole review queue.

    places has those columns and needs_review. The limit is the page that an editor sees.
    """
    found = places.where("needs_review") if queue_only else places
    if words.strip():
        found = found.where(F.lower(F.concat_ws(" ", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("id", "name", "address", "city", "country")])).contains(words.strip().lower()))
    return found if queue_only else found.orderBy("id").limit(most)


# Parameters of a search's address, and the values that each accepts.
PARAMETERS = {
    "modules": ("module", ("academic", "general_training", "life_skills", "other")),
    "categories": ("category", ("standard", "ukvi_selt")),
    "modes": ("delivery", MODES),
    "kinds": ("test", ("academic", "general_training", "ukvi", "life_skills", "osr", "other")),
}


def from_query(query: str) -> Search:
    """The offer filters of a url's query. Unknown values are dropped; an older parameter counts only without newer ones."""
    given = parse_qs(query.lstrip("?"), keep_blank_values=True)
    asked = {field: tuple(v for v in given[name] if v in known) for field, (name, known) in PARAMETERS.items() if name in given}
    if "modules" in asked or "categories" in asked:
        asked.pop("kinds", None)
    return Search(**asked)


def to_query(ask: Search) -> str:
    pairs = [(name, v) for field, (name, _) in PARAMETERS.items() if field != "kinds" for v in getattr(ask, field) or ()]
    return f"?{urlencode(pairs)}" if pairs else ""


def in_view(found: DataFrame, view: dict[str, float] | None, words: str = "") -> DataFrame:
    """What a list shows beside a map: places in view, those without coordinates left out; a text search lists every match wherever it lies.

    view has north, south, east, west; None shows nothing, as long as nothing is searched for.
    """
    if words.strip():
        return found
    if view is None:
        return found.where(F.lit(False))
    return found.where(F.coalesce(geo.within_bounds(F.col("lat"), F.col("lng"), **view), F.lit(False)))
