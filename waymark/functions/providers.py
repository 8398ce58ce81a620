"""What geocoding providers' answers mean: precisions, review of locations, local addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo

# Result types and levels of the providers, by the precision that they stand for.
ADDRESS_TYPES = ("street_address", "premise", "subpremise")
STREET_TYPES = ("route", "intersection")
CITY_TYPES = ("locality", "sublocality", "neighborhood", "postal_town")
AREA_TYPES = ("administrative_area_level_1", "administrative_area_level_2", "locality", "postal_town")
LOCATION_TYPES = {"ROOFTOP": "rooftop", "RANGE_INTERPOLATED": "street", "GEOMETRIC_CENTER": "street"}
RANKS = ((30, "rooftop"), (26, "street"), (21, "postcode"), (13, "city"))
CHINESE_LEVELS = (("门牌|兴趣点|楼|建筑", "rooftop"), ("道路|交叉口", "street"), ("省|国家", "country"))
INDIAN_LEVELS = {"housenumber": "rooftop", "housename": "rooftop", "poi": "rooftop", "street": "street", "pincode": "postcode", "postcode": "postcode", "state": "country", "country": "country"}
STREET_LINE = r"(?i)(?:\b(?:road|rd|street|st|avenue|ave|boulevard|lane|highway|expressway|route)\b|(?:lu|jie|dadao)\b)"


def _any(types: Column, wanted: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, wanted))), F.lit(False))


def _postal(types: Column) -> Column:
    return F.coalesce(F.exists(types, lambda t: t.startswith("postal_code")), F.lit(False))


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    out = F.when(F.lit(False), "")
    for name, value in table.items():
        out = out.when(key == name, value)
    return out


def precision_by_rank(rank: Column, kind: Column, city: Column) -> Column:
    """By the rank of an open search; a hit that names a city is at least as precise as one."""
    out = F.when(kind == "postcode", "postcode")
    for least, value in RANKS:
        reached = F.coalesce(rank, F.lit(0)) >= least
        out = out.when(reached | (F.coalesce(city, F.lit("")) != "") if value == "city" else reached, value)
    return out.otherwise("country")


def precision_of_address(types: Column, location: Column) -> Column:
    """By what a geocoder resolved; where its types say nothing, by how it placed the point."""
    exact = F.when(location == "ROOFTOP", "rooftop").otherwise("street")
    return (
        F.when(_any(types, ADDRESS_TYPES), exact).when(_any(types, STREET_TYPES), "street").when(_postal(types), "postcode").when(_any(types, CITY_TYPES), "city").when(_any(types, ("country",)), "country")
        .otherwise(F.coalesce(_looked_up(location, LOCATION_TYPES), F.lit("city")))
    )


def precision_of_place(types: Column) -> Column:
    """An establishment is exact, unless its types are those of an area, a postcode or a street."""
    return F.when(_any(types, ("country",)), "country").when(_any(types, AREA_TYPES), "city").when(_postal(types), "postcode").when(_any(types, STREET_TYPES), "street").otherwise("rooftop")


def precision_of_chinese_level(level: Column) -> Column:
    out = F.when(F.coalesce(level, F.lit("")) == "", "city")
    for pattern, value in CHINESE_LEVELS:
        out = out.when(level.rlike(pattern), value)
    return out.otherwise("city")


def precision_of_indian_level(level: Column) -> Column:
    key = F.regexp_replace(F.lower(F.coalesce(level, F.lit(""))), "[^a-z]", "")
    return F.coalesce(_looked_up(key, INDIAN_LEVELS), F.lit("city"))


def joined_once(parts: Column) -> Column:
    """Parts of an address without spaces between them; one that the text already holds is left out."""
    step = lambda text, part: F.when(F.coalesce(part, F.lit("")) == "", text).when(text.contains(part), text).otherwise(F.concat(text, part))
    return F.aggregate(parts, F.lit(""), step)


def street_numbers(text: Column) -> Column:
    """Numbers of up to five digits, other than zeros."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d{1,5})"), 1), lambda n: ~n.rlike("^0+$"))


def street_numbers_of_lines(lines: Column) -> Column:
    return street_numbers(F.array_join(F.filter(lines, lambda s: s.rlike(STREET_LINE)), " "))


def review_issues(verification: Column, precision: Column, confidence: Column) -> Column:
    """Why a location is no confident point; none if it is pinnable or missing."""
    reasons = F.array(F.when(verification != "verified", "verification"), F.when(geo.tier(precision) < 3, "precision"), F.when(confidence < 0.5, "confidence"))
    open_case = verification.isNotNull() & ~geo.pinnable(verification, precision, confidence)
    return F.filter(F.when(open_case, reasons).otherwise(F.array().cast("array<string>")), lambda r: r.isNotNull())


def confirmation_token(lat: Column, lng: Column) -> Column:
    """The identity of a point that was looked at; null without one."""
    known = lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng)
    return F.when(known, F.to_json(F.array(lat, lng)))


def approved(paths: Column, confidence: Column, precision: Column | str) -> Column:
    """struct(precision, verification, paths, confidence) of a location that an administrator has approved."""
    new = F.lit(precision) if isinstance(precision, str) else precision
    return F.struct(new.alias("precision"), F.lit("verified").alias("verification"), F.array_union(paths, F.array(F.lit("admin"))).alias("paths"), F.greatest(confidence, F.lit(0.9)).alias("confidence"))
