"""Reviewed overrides and other overlays by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked(patches: DataFrame, key: str = "id") -> DataFrame:
    """patches, or an error if an id has more than one; the count is one small aggregate."""
    twice = patches.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"more than one override for {[r[key] for r in twice]}")
    return patches


def applied(places: DataFrame, patches: DataFrame, fields: dict[str, str], key: str = "id", patch: str = "patch") -> DataFrame:
    """places with the fields whose key is present in the patch (a map of texts) replaced, by null too.

    fields maps column names to types.
    """
    own = patches.select(F.col(key).alias("_id"), F.col(patch).alias("_patch"))
    joined = places.join(own, F.col(key) == F.col("_id"), "left")
    present = lambda name: F.coalesce(F.map_contains_key("_patch", name), F.lit(False))
    new = {name: F.when(present(name), F.try_element_at("_patch", F.lit(name)).try_cast(kind)).otherwise(F.col(name)) for name, kind in fields.items()}
    return joined.withColumns(new).drop("_id", "_patch")


def unmatched(places: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Patches whose id no place has."""
    return patches.join(places.select(key), key, "left_anti")


def patch_of(before: Column, after: Column, fields: list[str]) -> Column:
    """A map of the fields whose values differ, null-safe, with the new values as texts."""
    entries = [F.when(~before[f].eqNullSafe(after[f]), F.struct(F.lit(f).alias("k"), after[f].cast("string").alias("v"))) for f in fields]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules that do not hold; a rule that is null does not hold."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda n: n.isNotNull())


def answered(edits: DataFrame, places: DataFrame, fields: dict[str, str], rules: dict[str, Column], key: str = "id") -> DataFrame:
    """edits with `status` and `problems`: what an administrator's PUT or DELETE of an override comes to.

    edits has id, seq (unique), method and patch (a map of texts, for PUT). A DELETE is always done (204), a PUT (200) only if the place
    exists (404), the patch is there and names known fields only, and the place under the patch alone breaks no rule (400). Rules are
    expressions over the fields; each edit is judged by the published place, whatever other edits there are.
    """
    base = places.select(F.col(key).alias("_key"), F.lit(True).alias("_there"), *fields)
    joined = edits.join(base, F.col("id") == F.col("_key"), "left")
    given = F.coalesce("patch", F.create_map().cast("map<string,string>"))
    unknown = F.transform(F.sort_array(F.array_except(F.map_keys(given), F.array(*map(F.lit, fields)))), lambda name: F.concat(F.lit("unknown:"), name))
    new = {f: F.when(F.map_contains_key(given, F.lit(f)), F.try_element_at(given, F.lit(f)).try_cast(kind)).otherwise(F.col(f)) for f, kind in fields.items()}
    judged = joined.withColumn("_unknown", unknown).withColumns(new).withColumn("_broken", violations(rules))
    problems = F.when(F.col("patch").isNull(), F.array(F.lit("no patch"))).when(F.size("_unknown") > 0, F.col("_unknown")).otherwise(F.col("_broken"))
    put, there = F.col("method") == "PUT", F.col("_there").isNotNull()
    status = F.when(F.col("method") == "DELETE", 204).when(~put, 405).when(~there, 404).when(F.size(problems) > 0, 400).otherwise(200)
    return judged.select(*edits.columns, status.alias("status"), F.when(put & there, problems).otherwise(F.array().cast("array<string>")).alias("problems"))


def stored_after(stored: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """(id, patch): the overrides after the edits of answered(); of an id's edits that were accepted the last one counts, and replaces the whole patch."""
    done = answers.where(F.col("status").isin(200, 204)).groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct("method", "patch"), "seq").alias("_last"))
    joined = stored.select(F.col(key).alias("_key"), F.col("patch").alias("_patch")).join(done, F.col("_key") == F.col("_id"), "full")
    kept = joined.where(F.col("_last").isNull() | (F.col("_last.method") == "PUT"))
    return kept.select(F.coalesce("_id", "_key").alias(key), F.when(F.col("_last").isNull(), F.col("_patch")).otherwise(F.col("_last.patch")).alias("patch"))


def merged_feed(places: DataFrame, patches: DataFrame, fields: dict[str, str], key: str = "id", publishable: str = "publishable", future: str = "future_opening") -> DataFrame:
    """places under their patches, less those that are then unpublishable and not announced for the future; ids never change."""
    merged = applied(places, patches, {f: kind for f, kind in fields.items() if f != key}, key)
    return merged.where(F.coalesce(publishable, F.lit(True)) | (F.coalesce(F.col(future), F.lit("")) != ""))


def future_openings(places: DataFrame, openings: DataFrame, key: str = "id") -> DataFrame:
    """places with the label of their announced opening, null without one."""
    own = openings.select(F.col(key).alias("_id"), F.col("label").alias("future_opening"))
    return places.join(own, F.col(key) == F.col("_id"), "left").drop("_id")
