"""Writing results: gated snapshots, feeds and GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..operators import snapshot


class UnsafePublication(Exception):
    """A gate does not let the new snapshot replace the one before."""


def publish(after: DataFrame, diff: DataFrame, path: str, allow: bool = False) -> Row:
    """Write a snapshot if the difference means something and passes the gates; its summary either way.

    Only the one-row summary comes to the driver.
    """
    summary = snapshot.summary(diff).first()
    if not allow and (summary.too_many_removed or summary.too_many_added):
        raise UnsafePublication(f"{summary.removed} removed and {summary.added} added of {summary.previous}")
    if summary.meaningful:
        after.write.mode("overwrite").parquet(path)
    return summary


def feed(places: DataFrame, *columns: str) -> DataFrame:
    """(id, json): each place as a JSON object of the given columns."""
    return places.select("id", F.to_json(F.struct(*columns)).alias("json"))


def for_map(places: DataFrame, status: str = "status", private: tuple[str, ...] = ("provider_id",)) -> DataFrame:
    """Places without provider ids, and without coordinates where the policy suppresses them."""
    shown = F.col(status) == "displayable"
    kept = places.drop(*private)
    return kept.withColumns({c: F.when(shown, F.col(c)) for c in ("lat", "lng") if c in kept.columns})


def map_summary(places: DataFrame, status: str = "status") -> DataFrame:
    return places.agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("displayable", "suppressed", "missing")])


def point(lng: Column, lat: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))
    own = F.struct(*[c.alias(n) for n, c in properties.items()])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), own.alias("properties")))


def collections(features: DataFrame, by: str, key: str) -> DataFrame:
    """(by, json): the features (by, key, feature as text) of each group as one GeoJSON collection, in the order of their keys.

    A collection is one text, so group by what a reader loads at once, such as a country or a tile.
    """
    together = features.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(key, "feature"))).alias("_f"))
    inner = F.array_join(F.transform("_f", lambda f: f["feature"]), ",")
    return together.select(by, F.concat(F.lit('{"type":"FeatureCollection","features":['), inner, F.lit("]}")).alias("json"))


def line(a_lng: Column, a_lat: Column, b_lng: Column, b_lat: Column) -> Column:
    geometry = F.struct(F.lit("LineString").alias("type"), F.array(F.array(a_lng, a_lat), F.array(b_lng, b_lat)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry")))


def bounding_box(places: DataFrame) -> DataFrame:
    return places.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"))


def grid_clusters(places: DataFrame, cells_per_degree: float) -> DataFrame:
    """Markers that stand for the places of a grid cell: how many, and where on average."""
    cell = lambda c: F.floor(F.col(c) * cells_per_degree).alias(f"{c}_cell")
    return places.groupBy(cell("lat"), cell("lng")).agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
