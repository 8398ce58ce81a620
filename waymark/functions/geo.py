"""Distances, precision, plausibility and policy of coordinates, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# Precision tiers; agreement and divergence distances in kilometres.
TIERS = {"rooftop": 4, "street": 3, "postcode": 2, "city": 1}
AGREE_KM, AGREE_SAME_POSTCODE_KM, DIVERGE_KM = 0.25, 0.75, 2.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """The distance of two points on a sphere; null if a coordinate is missing."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def _grid(km: float) -> tuple[float, int]:
    """Degrees of a cell about as large as a radius, and cells around the globe."""
    around = max(1, int(360 / max(km * 360 / (12742 * 3.141592653589793), 0.01)))
    return 360 / around, around


def cell(lat: Column, lng: Column, km: float, coarse: float = 1) -> Column:
    """The grid cell of a point, for joins of points within `km`; null without coordinates. Cells are `coarse` times as wide as the radius."""
    size, around = _grid(km * coarse)
    return F.when(lat.isNotNull() & lng.isNotNull(), F.floor(lat / size) * around + F.pmod(F.floor(lng / size), F.lit(around)))


def cells_around(lat: Column, lng: Column, km: float, coarse: float = 1) -> Column:
    """The distinct cells that hold every point within `km` of a point, each once: a point there has one of them as its cell.

    They are some nine where cells are as wide as the radius, and some two where they are four times as wide.
    """
    size, around = _grid(km * coarse)
    angle = km / 6371 * (1 + 1e-9)
    reach = F.degrees(F.lit(angle))
    rows = F.sequence(F.floor((lat - reach) / size), F.floor((lat + reach) / size))
    half = F.when(F.abs(lat) + reach >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(angle)) / F.cos(F.radians(lat))))) + 1e-9)
    near = F.transform(F.sequence(F.floor((lng - half) / size), F.floor((lng + half) / size)), lambda i: F.pmod(i, F.lit(around)))
    columns = F.when(half * 2 + size >= 360, F.sequence(F.lit(0).cast("long"), F.lit(around - 1).cast("long"))).otherwise(F.array_distinct(near))
    return F.when(lat.isNotNull() & lng.isNotNull(), F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: r * around + c))))


def tier(precision: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, value in TIERS.items():
        out = out.when(precision == name, value)
    return out.otherwise(0)


def pinnable(verification: Column, precision: Column, confidence: Column) -> Column:
    return F.coalesce((verification == "verified") & (tier(precision) >= 3) & (confidence >= 0.5), F.lit(False))


def folded(c: Column) -> Column:
    """What a postcode, city or country is compared by."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def candidate_score(precision: Column, postcode: Column, city: Column, country: Column, want_postcode: Column, want_city: Column, want_country: Column) -> Column:
    """The tier, one more for an equal postcode and for an equal city; null rejects.

    A candidate of another country is rejected, as is one whose postcode starts otherwise (three characters), unless the cities agree.
    """
    return folded_score(tier(precision), *map(folded, (postcode, city, country, want_postcode, want_city, want_country)))


def folded_score(tier_: Column, postcode: Column, city: Column, country: Column, want_postcode: Column, want_city: Column, want_country: Column) -> Column:
    """candidate_score() of values that are folded already."""
    differ = lambda a, b: (a != "") & (b != "") & (a != b)
    same = lambda a, b: (a != "") & (a == b)
    cities = same(city, want_city)
    region = lambda c: F.substring(c, 1, 3)
    rejected = differ(country, want_country) | (differ(region(postcode), region(want_postcode)) & ~cities)
    return F.when(~rejected, tier_ + same(postcode, want_postcode).cast("int") + cities.cast("int"))


def agreement_limit(tier_a: Column, tier_b: Column, postcode_a: Column, postcode_b: Column, wanted: Column) -> Column:
    """How far apart two candidates may be: more if both are at street level and echo the wanted postcode."""
    same = (F.coalesce(postcode_a, F.lit("")) != "") & (postcode_a == postcode_b) & ((F.coalesce(wanted, F.lit("")) == "") | (postcode_a == wanted))
    return F.when(F.coalesce(same, F.lit(False)) & (tier_a >= 3) & (tier_b >= 3), AGREE_SAME_POSTCODE_KM).otherwise(AGREE_KM)


def wrapped_longitude(lng: Column) -> Column:
    return F.pmod(lng + 180, F.lit(360.0)) - 180


def within_bounds(lat: Column, lng: Column, north: float, south: float, east: float, west: float) -> Column:
    """Inside a box that may cross the antimeridian; one of 360 degrees or more holds every longitude."""
    rows = lat.between(south, north)
    if east - west >= 360:
        return rows
    wrap = lambda x: (x + 180) % 360 - 180
    e, w, x = wrap(east), wrap(west), wrapped_longitude(lng)
    return rows & (x.between(w, e) if w <= e else (x >= w) | (x <= e))


def plausible(places: DataFrame, bounds: DataFrame, country: str = "country", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """places with a column `plausible`: inside the country's box, or of a country without one.

    bounds has country, south, north, west and east, one row for each country, so that it is broadcast and places stay where they are.
    """
    box = F.broadcast(bounds.select(F.col("country").alias("_c"), "south", "north", "west", "east"))
    inside = F.col(lat).between(F.col("south"), F.col("north")) & F.col(lng).between(F.col("west"), F.col("east"))
    joined = places.join(box, F.col(country) == F.col("_c"), "left").withColumn("plausible", F.coalesce(inside, F.lit(True)))
    return joined.drop("_c", "south", "north", "west", "east")


def same_point(a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column, within: float = 1e-6) -> Column:
    """Whether both points are missing, or differ by less than `within` degrees either way."""
    neither = a_lat.isNull() & b_lat.isNull()
    return neither | F.coalesce((F.abs(a_lat - b_lat) < within) & (F.abs(a_lng - b_lng) < within), F.lit(False))


def same_location(a: Column, b: Column) -> Column:
    """Whether two structs (lat, lng, precision, verification, confidence, paths, agreement_km) say the same; paths in any order."""
    fields = [a[f].eqNullSafe(b[f]) for f in ("precision", "verification", "confidence", "agreement_km")]
    close = same_point(a["lat"], a["lng"], b["lat"], b["lng"], 1e-7) & F.sort_array(a["paths"]).eqNullSafe(F.sort_array(b["paths"]))
    for f in fields:
        close = close & f
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)


# Zoom levels of a map that opens at a point of each precision, and of boxes by their span in degrees.
ZOOMS = {"rooftop": 16, "street": 15, "postcode": 13, "city": 11, "country": 6, "approximate": 8}
SPAN_ZOOMS = ((80, 3), (35, 4), (15, 5))


def picker_starts(places: DataFrame, bounds: DataFrame) -> DataFrame:
    """(id, lat, lng, zoom): where a map opens to place each of `places` (id, country, city, precision, lat, lng).

    At its own point, else the mean of its city's, else the middle of its country's box, else the mean of its country's, else a view
    of the world. Means are aggregated before they are joined. bounds has country, south, north, west, east.
    """
    city = F.nullif(F.lower(F.trim("city")), F.lit(""))
    located = places.where("lat IS NOT NULL AND lng IS NOT NULL").select("country", city.alias("_city"), "lat", "lng")
    mean = lambda tag: (F.avg("lat").alias(f"{tag}_lat"), F.avg("lng").alias(f"{tag}_lng"))
    cities = located.where("_city IS NOT NULL").groupBy(F.col("country").alias("_c1"), F.col("_city").alias("_t1")).agg(*mean("city"))
    countries = located.groupBy(F.col("country").alias("_c2")).agg(*mean("country"))
    span = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    wide = F.coalesce(*[F.when(span > least, F.lit(zoom)) for least, zoom in SPAN_ZOOMS], F.lit(6))
    boxes = bounds.select(F.col("country").alias("_c3"), ((F.col("south") + F.col("north")) / 2).alias("box_lat"), ((F.col("west") + F.col("east")) / 2).alias("box_lng"), wide.alias("box_zoom"))
    joined = places.join(cities, F.col("country").eqNullSafe(F.col("_c1")) & (city == F.col("_t1")), "left")
    joined = joined.join(countries, F.col("country").eqNullSafe(F.col("_c2")), "left").join(boxes, F.col("country") == F.col("_c3"), "left")
    own = F.coalesce(*[F.when(F.col("precision") == p, F.lit(z)) for p, z in ZOOMS.items()])
    at = lambda c: F.coalesce(F.col(c), f"city_{c}", f"box_{c}", f"country_{c}", F.lit({"lat": 18.0, "lng": 5.0}[c]))
    zoom = F.when(F.col("lat").isNotNull(), own).when(F.col("city_lat").isNotNull(), 11).when(F.col("box_lat").isNotNull(), F.col("box_zoom")).when(F.col("country_lat").isNotNull(), 5).otherwise(2)
    return joined.select("id", at("lat").alias("lat"), at("lng").alias("lng"), zoom.alias("zoom"))


def refinement_radius_km(precision: Column) -> Column:
    return F.when(precision == "rooftop", 25.0).when(precision == "street", 5.0).otherwise(100.0)


def policy(rights: Column, target: Column | str, has_geo: Column) -> Column:
    """displayable, suppressed or missing: unknown rights are suppressed."""
    allowed = F.coalesce(F.array_contains(rights, target), F.lit(False))
    return F.when(~has_geo, "missing").when(allowed, "displayable").otherwise("suppressed")


# -- the shifted datum of mainland China ------------------------------------------------------------------------------------

# The published ellipsoid, box and series of the datum.
_AXIS, _ECCENTRICITY = 6378245.0, 0.00669342162296594323


def shifted_outside(lat: Column, lng: Column) -> Column:
    return (lng < 72.004) | (lng > 137.8347) | (lat < 0.8293) | (lat > 55.8271)


def _offsets(x, y, sin, cos, sqrt, absolute):
    """The published polynomial and sine series of the shift, for x = lng - 105 and y = lat - 35, in metres-like units."""
    pi = math.pi
    base = (20 * sin(6 * x * pi) + 20 * sin(2 * x * pi)) * 2 / 3
    lat = -100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * sqrt(absolute(x)) + base
    lat = lat + (20 * sin(y * pi) + 40 * sin(y / 3 * pi)) * 2 / 3 + (160 * sin(y / 12 * pi) + 320 * sin(y * pi / 30)) * 2 / 3
    lng = 300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * sqrt(absolute(x)) + base
    lng = lng + (20 * sin(x * pi) + 40 * sin(x / 3 * pi)) * 2 / 3 + (150 * sin(x / 12 * pi) + 300 * sin(x / 30 * pi)) * 2 / 3
    return lat, lng


def _shift(lat, lng, sin, cos, sqrt, absolute):
    a, b = _offsets(lng - 105, lat - 35, sin, cos, sqrt, absolute)
    rad = lat / 180 * math.pi
    magic = 1 - _ECCENTRICITY * sin(rad) * sin(rad)
    root = sqrt(magic)
    lat_step = a * 180 / ((_AXIS * (1 - _ECCENTRICITY)) / (magic * root) * math.pi)
    return lat + lat_step, lng + b * 180 / (_AXIS / root * cos(rad) * math.pi)


def to_shifted(lat: Column, lng: Column) -> Column:
    """struct(lat, lng) in the shifted datum; the identity outside its box."""
    y, x = _shift(lat, lng, F.sin, F.cos, F.sqrt, F.abs)
    out = shifted_outside(lat, lng)
    return F.struct(F.when(out, lat).otherwise(y).alias("lat"), F.when(out, lng).otherwise(x).alias("lng"))


def from_shifted(lat: Column, lng: Column, steps: int = 8) -> Column:
    """struct(lat, lng) of a point in the shifted datum, by fixed-point steps that a fold repeats; the identity outside its box."""
    start = F.struct(lat.cast("double").alias("lat"), lng.cast("double").alias("lng"))

    def closer(p: Column, _: Column) -> Column:
        y, x = _shift(p["lat"], p["lng"], F.sin, F.cos, F.sqrt, F.abs)
        return F.struct((p["lat"] - (y - lat)).alias("lat"), (p["lng"] - (x - lng)).alias("lng"))

    return F.when(shifted_outside(lat, lng), start).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, closer))


def search_region(south: Column, north: Column, west: Column, east: Column) -> Column:
    """struct(lat, lng, lat_span, lng_span): the region that a search in a country's box looks at; null without a box."""
    region = F.struct(((south + north) / 2).alias("lat"), ((west + east) / 2).alias("lng"), F.least(F.lit(180.0), north - south).alias("lat_span"), F.least(F.lit(360.0), east - west).alias("lng_span"))
    return F.when(south.isNotNull() & north.isNotNull() & west.isNotNull() & east.isNotNull(), region)
