"""Repairs judged by what they would do: a proposal is applied to its record, and both versions go through all rules.

Both analyses are expressions on one row, so that a run costs the join of proposals with records and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numbers import severity_cost
from .quality import Rule, analysed

# The issues that a new location and a new city can mend.
LOCATION_ISSUES = ("missing_location", "location_not_verified", "location_too_coarse", "location_not_independently_corroborated", "location_outside_country")
CITY_ISSUES = ("missing_city", "legacy_city")

#: What a record's location says to the rules.
FACTS = ("has_geo", "outside", "verified", "admin", "n_paths", "agreement_km", "tier", "pinnable")


def observed(places: DataFrame, box: tuple[str, str, str, str] = ("south", "north", "west", "east")) -> DataFrame:
    """places with the facts of `geo`, a struct (lat, lng, precision, source, verification, confidence, paths, agreement_km) or null.

    The box of the record's country stands in four columns, null for a country without one.
    """
    south, north, west, east = map(F.col, box)
    g = F.col("geo")
    inside = g["lat"].between(south, north) & g["lng"].between(west, east)
    facts = {
        "has_geo": g.isNotNull(), "outside": ~F.coalesce(inside, F.lit(True)), "verified": F.coalesce(g["verification"] == "verified", F.lit(False)), "admin": _by_admin(g), "n_paths": F.coalesce(F.size(g["paths"]), F.lit(0)),
        "agreement_km": g["agreement_km"], "tier": geo.tier(g["precision"]), "pinnable": geo.pinnable(g["verification"], g["precision"], g["confidence"]),
    }
    return places.withColumns(facts)


def _by_admin(g: Column) -> Column:
    return F.coalesce((g["source"] == "admin") | F.array_contains(g["paths"], "admin"), F.lit(False))


def attempted(places: DataFrame, proposals: DataFrame, bounds: DataFrame, checks: list[Rule] | None = None, key: str = "id") -> DataFrame:
    """(key, outcome, reason, targeted, before_issues, after_issues, changed, proposed): what becomes of each proposal.

    places has what the rules ask for but the facts of the location, and geo, place_id, confidence, city, city_source, region, postcode. proposals has
    the same seven and at most one row of a key; those without a record are left out. bounds has country, south, north, west, east.

    Reviewed records are skipped. A location counts only if it may be shown and mends an issue, and is a mismatch if it is further away than its old
    precision allows; a city only if it mends an issue and is not an old one. A repair must bring no new issue but information, mend
    what it was for, and lower the total severity. `proposed` holds the fields of the repaired record.
    """
    new = proposals.select(F.col(key).alias("_key"), F.struct("geo", "place_id", "confidence", "city", "city_source", "region", "postcode").alias("_new"))
    box = bounds.select(F.col("country").alias("_country"), "south", "north", "west", "east")
    joined = places.join(new, F.col(key) == F.col("_key")).join(box, F.col("country") == F.col("_country"), "left")
    fields = ("geo", "place_id", "confidence", "city", "city_source", "region", "postcode")
    before = analysed(observed(joined), checks)
    before = before.withColumns({"_old": F.struct(*fields), "_issues": F.col("issues"), "_pinned": F.col("pinnable")})

    codes = lambda issues: F.sort_array(F.transform(issues, lambda i: i["code"]))
    of = lambda names: F.exists("_issues", lambda i: i["code"].isin(*names))
    old, g, n = F.col("_old"), F.col("geo"), F.col("_new.geo")
    shown = F.coalesce(geo.pinnable(n["verification"], n["precision"], n["confidence"]), F.lit(False))
    moves = of(LOCATION_ISSUES) & shown
    far = moves & F.coalesce(geo.haversine_km(g["lat"], g["lng"], n["lat"], n["lng"]) > geo.refinement_radius_km(g["precision"]), F.lit(False))
    names = of(CITY_ISSUES) & (F.coalesce(F.col("_new.city"), F.lit("")) != "") & ~F.coalesce(F.col("_new.city_source") == "legacy", F.lit(False))
    marked = before.withColumns({"_admin": _by_admin(g) | F.coalesce(F.col("city_source") == "admin", F.lit(False)), "_moves": moves, "_far": far, "_names": names})
    use = lambda flag, c: F.when(F.col(flag), F.col(f"_new.{c}")).otherwise(F.col(c))
    fill = lambda c: F.when(F.col("_names"), F.coalesce(F.col(c), F.col(f"_new.{c}"))).otherwise(F.col(c))
    repaired = marked.withColumns({**{c: use("_moves", c) for c in ("geo", "place_id", "confidence")}, **{c: use("_names", c) for c in ("city", "city_source")}, "region": fill("region"), "postcode": fill("postcode")})
    after = analysed(observed(repaired), checks)

    kept = geo.same_location(old["geo"], F.col("geo"))
    same = lambda c: old[c].eqNullSafe(F.col(c))
    changed = F.array_compact(F.array(F.when(~(same("city") & same("city_source")), "city"), F.when(~kept, "location"), F.when(~same("place_id"), "place_id")))
    had = F.transform("_issues", lambda i: F.struct(i["code"], i["severity"]))
    worse = F.exists("issues", lambda i: (i["severity"] != "info") & ~F.array_contains(had, F.struct(i["code"], i["severity"])))
    cost = lambda issues: severity_cost(F.transform(issues, lambda i: i["severity"]))
    located = of(LOCATION_ISSUES) & ~F.col("_pinned") & F.col("pinnable")
    renamed = of(CITY_ISSUES) & (F.coalesce(F.col("city"), F.lit("")) != "") & ~F.coalesce(F.col("city_source") == "legacy", F.lit(False))
    judged = after.withColumns({"_changed": changed, "_worse": worse, "_located": located, "_renamed": renamed, "_cheaper": cost(F.col("issues")) < cost(F.col("_issues"))})
    c = F.col
    rules = [
        (c("_admin"), "skipped_admin", F.lit("reviewed_evidence")),
        (c("_far"), "rejected", F.lit("too_far")),
        (F.size("_changed") == 0, "unchanged", F.lit("same_result")),
        (c("_worse"), "rejected", F.lit("new_issues")),
        (~((c("_located") | c("_renamed")) & c("_cheaper")), "rejected", F.lit("no_net_gain")),
        (F.lit(True), "accepted", F.concat_ws("+", F.when(c("_located"), "location"), F.when(c("_renamed"), "city"))),
    ]
    first = lambda i: F.coalesce(*[F.when(r[0], r[i] if i == 2 else F.lit(r[i])) for r in rules])
    untouched = c("_admin") | c("_far")
    targeted = F.sort_array(F.filter(codes(c("_issues")), lambda x: x.isin(*LOCATION_ISSUES, *CITY_ISSUES)))
    return judged.select(
        key, first(1).alias("outcome"), first(2).alias("reason"), targeted.alias("targeted"), codes(c("_issues")).alias("before_issues"),
        F.when(untouched, codes(c("_issues"))).otherwise(codes(c("issues"))).alias("after_issues"), F.when(untouched, F.array().cast("array<string>")).otherwise(c("_changed")).alias("changed"), F.struct(*fields).alias("proposed"),
    )


def repaired(places: DataFrame, attempts: DataFrame, key: str = "id") -> DataFrame:
    """places with the accepted proposals of attempted() in place; all others stay as they are."""
    good = attempts.where("outcome = 'accepted'").select(F.col(key).alias("_key"), "proposed")
    joined = places.join(good, F.col(key) == F.col("_key"), "left")
    fields = [f.name for f in attempts.schema["proposed"].dataType.fields]
    return joined.withColumns({c: F.when(F.col("_key").isNotNull(), F.col(f"proposed.{c}")).otherwise(F.col(c)) for c in fields}).select(*places.columns)
