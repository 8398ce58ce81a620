"""Differences between two snapshots, and the gates that stop an unsafe publication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How many rows may go or come at once: at least so many, or this share of the previous snapshot.
REMOVED, ADDED = (25, 0.05), (100, 0.10)


def canonical(c: Column | str, kind: str = "text") -> Column:
    """A field as text that compares equal exactly when the field is: sets in order, coordinates to 1e-5 degrees."""
    c = F.col(c) if isinstance(c, str) else c
    if kind == "set":
        return F.array_join(F.sort_array(c), "|")
    if kind == "degrees":
        return F.floor(c * 100000 + 0.5).cast("string")
    return c.cast("string")


def place_fields() -> dict[str, Column]:
    """The nineteen fields of a whole record (assembly.assembled) whose change means something, each as text that compares equal exactly when it does.

    Times of a crawl are none of them; coordinates count to about a metre; lists of formats, offers and sources count in any order.
    """
    c, json = F.col, lambda value: F.to_json(F.struct(value.alias("v")))
    offer = lambda o: F.concat(F.concat_ws("|", o["label"], o["format"], F.coalesce(o["text"], F.lit(""))), F.lit("|"), F.coalesce(o["currency"], F.lit("")), F.coalesce(o["price"].cast("string"), F.lit("")), F.lit("|"), F.coalesce(o["status"], F.lit("")))
    place = F.concat_ws("|", F.concat_ws(",", canonical(c("geo.lat"), "degrees"), canonical(c("geo.lng"), "degrees")), c("geo.precision"))
    flag = lambda name: canonical(F.coalesce(c(name), F.lit(False)))
    return {
        "name": c("name"), "operator": c("operator"), "address": c("address.raw"), "localizations": canonical("localizations"), "city": c("address.city"), "postcode": c("address.postcode"), "contact": json(c("contact")), "price_text": c("price_text"),
        "price": canonical("price"), "currency": c("currency"), "formats": canonical("formats", "set"), "offers": canonical(F.transform("offers", offer), "set"), "booking_url": c("booking_url"), "retake": flag("retake"), "retake_only": flag("retake_only"),
        "location": F.when(c("geo").isNotNull(), place), "place_id": c("place_id"), "publishable": canonical("publishable"), "sources": canonical(F.transform("sources", lambda s: s["slug"]), "set"),
    }


def difference(before: DataFrame, after: DataFrame, key: str, fields: dict[str, Column] | Sequence[str]) -> DataFrame:
    """(key, change, fields): added, removed, changed or unchanged, and the names of the fields that differ.

    fields are column names, or names with canonical expressions; whatever else the snapshots hold, such as the time of a
    crawl, makes no difference.
    """
    exprs = fields if isinstance(fields, dict) else {f: canonical(f) for f in fields}
    side = lambda df, tag: df.select(F.col(key).alias(f"_{tag}"), F.struct(*[e.alias(n) for n, e in exprs.items()]).alias(tag))
    joined = side(before, "old").join(side(after, "new"), F.col("_old") == F.col("_new"), "full_outer")
    differing = F.filter(F.array(*[F.when(~F.col(f"old.{n}").eqNullSafe(F.col(f"new.{n}")), F.lit(n)) for n in exprs]), lambda n: n.isNotNull())
    added, removed = F.col("_old").isNull(), F.col("_new").isNull()
    found = joined.select(F.coalesce("_new", "_old").alias(key), added.alias("added"), removed.alias("removed"), F.when(added | removed, F.array().cast("array<string>")).otherwise(differing).alias("fields"))
    change = F.when(F.col("added"), "added").when(F.col("removed"), "removed").when(F.size("fields") > 0, "changed").otherwise("unchanged")
    return found.select(key, change.alias("change"), "fields")


def limit(size: Column, rule: tuple[int, float]) -> Column:
    return F.greatest(F.lit(rule[0]), F.ceil(size * rule[1]))


def summary(diff: DataFrame) -> DataFrame:
    """One row: counts of each change, the size of the previous snapshot, whether anything changed, and each gate."""
    count = lambda c: F.count_if(F.col("change") == c).alias(c)
    counted = diff.agg(*[count(c) for c in ("added", "removed", "changed", "unchanged")], F.count_if(F.col("change") != "added").alias("previous"))
    some = F.col("previous") > 0
    return counted.select(
        "*", (F.col("added") + F.col("removed") + F.col("changed") > 0).alias("meaningful"),
        (some & (F.col("removed") > limit(F.col("previous"), REMOVED))).alias("too_many_removed"), (some & (F.col("added") > limit(F.col("previous"), ADDED))).alias("too_many_added"),
    )


def carried_first_seen(after: DataFrame, before: DataFrame, key: str, seen: str) -> DataFrame:
    old = before.select(F.col(key).alias("_k"), F.col(seen).alias("_s"))
    return after.join(old, F.col(key) == F.col("_k"), "left").withColumn(seen, F.coalesce("_s", seen)).drop("_k", "_s")


def rendered(diff: DataFrame, key: str, most: int = 50) -> str:
    """Markdown with the first keys of each change, for a reviewer."""
    out = []
    for change in ("added", "removed", "changed"):
        rows = diff.where(F.col("change") == change).orderBy(key).limit(most).collect()
        out += [f"## {change}", *[f"- {r[key]}" + (f": {', '.join(r['fields'])}" if r["fields"] else "") for r in rows]]
    return "\n".join(out)
