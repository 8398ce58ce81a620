"""Bounded repairs: which places to try first, which proposals to accept, and the evidence on possible duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numbers import severity_cost


def prioritised(places: DataFrame, most: int, country: str = "country", key: str = "id", candidate: str = "candidate") -> DataFrame:
    """The first `most` candidates: new ones, then by severity cost, then by how badly their country is hit, then by key.

    places has country, key, candidate, is_new and severities. The priority of a country is its rate of candidates times the square
    root of its size.
    """
    named = F.coalesce(F.col(country), F.lit("UNASSIGNED"))
    totals = places.groupBy(named.alias("_c")).agg(F.count("*").alias("_n"), F.count_if(candidate).alias("_hit"))
    joined = places.where(candidate).withColumn("_c", named).join(totals, "_c")
    priority = F.floor(F.col("_hit") / F.col("_n") * F.sqrt("_n") * 1e6 + 0.5) / 1e6
    ranked = joined.withColumns({"cost": severity_cost(F.col("severities")), "priority": priority})
    return ranked.orderBy(F.desc("is_new"), F.desc("cost"), F.desc("priority"), key).limit(most).drop("_c", "_n", "_hit")


def outcome(admin: Column, pinnable_before: Column, pinnable_after: Column, jump_km: Column, old_precision: Column, city_before: Column, city_after: Column, changed: Column, new_serious: Column, cost_before: Column, cost_after: Column) -> Column:
    """skipped_admin, unchanged, rejected or accepted for a proposal.

    A new location has to be pinnable and near the old one for its precision. A proposal that brings any new issue but
    information is rejected; one is accepted if a location or city became usable and the total severity fell.
    """
    far = pinnable_after & (jump_km > geo.refinement_radius_km(old_precision))
    better = (pinnable_after & ~pinnable_before) | (city_after & ~city_before)
    accepted = better & (cost_after < cost_before)
    return F.when(admin, "skipped_admin").when(~changed, "unchanged").when(F.coalesce(far, F.lit(False)) | new_serious, "rejected").when(accepted, "accepted").otherwise("rejected")


def both_ways(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, others): the neighbours of each node of an undirected graph."""
    every = links.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("other")))
    return every.where("node <> other").groupBy("node").agg(F.sort_array(F.collect_set("other")).alias("others"))


def duplicate_evidence(links: DataFrame, places: DataFrame, key: str = "id") -> DataFrame:
    """For each link (a, b) what its places share: phones, websites, and the distance in kilometres."""
    side = lambda tag: places.select(F.col(key).alias(f"{tag}_id"), F.col("phones").alias(f"{tag}_phones"), F.col("websites").alias(f"{tag}_sites"), F.col("lat").alias(f"{tag}_lat"), F.col("lng").alias(f"{tag}_lng"))
    joined = links.join(side("x"), F.col("a") == F.col("x_id")).join(side("y"), F.col("b") == F.col("y_id")).where("x_id <> y_id")
    shared = lambda c: F.sort_array(F.filter(F.array_intersect(f"x_{c}", f"y_{c}"), lambda v: v != ""))
    km = geo.haversine_km(F.col("x_lat"), F.col("x_lng"), F.col("y_lat"), F.col("y_lng"))
    return joined.select("a", "b", shared("phones").alias("phones"), shared("sites").alias("websites"), km.alias("km"))


def localised(places: DataFrame, evidence: DataFrame, key: str = "id", force: bool = False) -> DataFrame:
    """Places with an accepted local address: (key, locale, address), from evidence (key, locale, address, score_ok, km, order).

    Only pinnable places count, those that have a local address already only if forced. The first acceptable evidence by order
    within five kilometres is taken.
    """
    wanted = places.where("pinnable").where(F.lit(force) | ~F.coalesce("has_local", F.lit(False))).select(key)
    first = Window.partitionBy(key).orderBy("order", "address")
    good = evidence.where(F.coalesce("score_ok", F.lit(False)) & (F.col("km") <= 5)).withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
    return wanted.join(good, key).select(key, "locale", "address")


def without_sources(entries: Column, sources: tuple[str, ...]) -> Column:
    """Localised entries (locale, name, address, name_source, address_source) without what comes from these sources; empty ones go."""
    stale = lambda e, f: F.coalesce(e[f"{f}_source"].isin(*sources), F.lit(False))
    kept = lambda e, f, c: F.when(~stale(e, f), e[c])
    fields = (("name", "name"), ("address", "address"), ("name", "name_source"), ("address", "address_source"))
    fresh = F.transform(entries, lambda e: F.struct(e["locale"].alias("locale"), *[kept(e, f, c).alias(c) for f, c in fields]))
    return F.filter(fresh, lambda e: (F.coalesce(e["name"], F.lit("")) != "") | (F.coalesce(e["address"], F.lit("")) != ""))


def with_locale(entries: Column, locale: Column, entry: Column) -> Column:
    """An array of structs with the one of this locale replaced, in order."""
    return F.array_sort(F.concat(F.filter(entries, lambda e: e["locale"] != locale), F.array(entry)))
