"""The whole record of a place: what its pages say together, where it lies, and what an earlier run knew of it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.numbers import cheapest_of_one_currency
from . import entities
from .records import merged_formats

#: What tells one published product from another; of equal ones, those with the same price are one.
OFFER_IDENTITY = ["label", "kind", "module", "category", "format"]
#: A kind of offer that is no full test.
SHORT_KIND = "life_skills"
#: Pages that a task handles, about: tasks grow in number with the pages, not in size.
PER_TASK = 10_000


def assembled(pages: DataFrame, clusters: DataFrame, located: DataFrame, previous: DataFrame, seen_at: str) -> DataFrame:
    """One record per cluster, with everything that is published of it.

    pages: slug (unique), url, fetched_at, name, operator, operator_source, external_id, booking_url, completeness, address (struct raw, lines, city, city_source,
    region, postcode, country), phones, emails, websites (arrays), offers (array of struct label, kind, module, category, format, text, currency, price, status),
    retake, retake_only (null where no listing said so). clusters: slug, cluster. located: cascade.located() with clusters as entities. previous: id,
    raw, lat, lng, retake, retake_only, first_seen, localizations.

    The most complete page names the place and comes first wherever several have something to say, the others follow by slug. Its address is
    filled up from a verified location. A record may be published if it has a price, or if it offers retakes alone: some page says so, none
    that offers retakes has full tests, and no full test is on offer. Local names stay as long as address and coordinates do. A cluster's lists are of its own
    few pages. Pages without a cluster are left out, clusters without a location have none. Pages are dealt by cluster over tasks of about PER_TASK of them, and what
    is worked out of them stays there.
    """
    tasks = min(4096, max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(clusters.count() / PER_TASK)))
    best = Window.partitionBy("cluster").orderBy(F.desc("completeness"), F.length("slug"), "slug")
    placed = pages.join(clusters.select("slug", "cluster"), "slug")
    rows = placed.repartition(tasks, "cluster").withColumn("_other", (F.row_number().over(best) > 1).cast("int"))
    dealt = lambda df: df.repartition(tasks, "cluster")
    order = ["_other", "slug"]

    each = rows.select("cluster", *order, F.posexplode("offers").alias("_i", "_o")).select("cluster", *order, "_i", "_o.*").withColumn("_at", F.struct(*order, "_i"))
    offers = entities.merged_offers(each, "cluster", OFFER_IDENTITY, "text", "_at")
    names = [*OFFER_IDENTITY, "text", "currency", "price", "status"]
    listed = offers.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("_at", *names))).alias("_l"))
    listed = listed.select("cluster", F.transform("_l", lambda o: F.struct(*[o[n].alias(n) for n in names])).alias("offers"))

    def contacts(column: str, identity) -> DataFrame:
        every = rows.select("cluster", *order, F.posexplode(column).alias("_i", "_v"))
        return entities.merged_values(every, "cluster", "_v", [*order, "_i"], identity).select("cluster", F.col("values").alias(column))

    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(*order)))
    source = F.struct("slug", "url", F.col("fetched_at").alias("seen_at"))
    together = rows.groupBy("cluster").agg(
        F.sort_array(F.collect_list(source)).alias("sources"), F.count("*").alias("n_pages"), first("external_id").alias("external_id"), first("booking_url").alias("booking_url"),
        F.max(F.col("retake").isNotNull()).alias("_known"), F.coalesce(F.max(F.col("retake")), F.lit(False)).alias("_offers"), F.coalesce(F.max("retake_only"), F.lit(False)).alias("_only"),
        F.coalesce(F.max(F.col("retake") & ~F.col("retake_only")), F.lit(False)).alias("_full_card"),
    )
    canonical = rows.where("_other = 0").select("cluster", F.col("slug").alias("canonical"), "name", "operator", "operator_source", "address", entities.place_id(F.when(F.col("operator") == "British Council", F.col("external_id")), F.col("slug")).alias("id"))
    made = canonical.join(together, "cluster").join(listed, "cluster", "left")
    for column, identity in (("phones", text.phone_identity), ("emails", F.lower), ("websites", text.website_identity)):
        made = made.join(contacts(column, identity), "cluster", "left")
    place = located.select(
        F.col("entity").alias("cluster"), F.when(F.col("lat").isNotNull(), F.struct("lat", "lng", "precision", "source", "verification", "confidence", "paths", "agreement_km")).alias("geo"), "place_id",
        F.struct("city", "city_source", "region", "postcode").alias("_found"),
    )
    old = previous.select(F.col("id").alias("_id"), F.struct("raw", "lat", "lng", "retake", "retake_only", "first_seen", "localizations").alias("_old"))
    known = dealt(canonical.select("cluster", "id").join(old, F.col("id") == F.col("_id")).select("cluster", "_id", "_old"))
    made = made.join(dealt(place), "cluster", "left").join(known, "cluster", "left")

    c, found, before = F.col, F.col("_found"), F.col("_old")
    sure = F.coalesce(c("geo.verification") == "verified", F.lit(False))
    own = c("address")
    city = F.coalesce(own["city"], found["city"])
    city_source = F.when(own["city"].isNotNull(), F.coalesce(own["city_source"], F.lit("address_rule"))).otherwise(found["city_source"])
    fill = lambda n: F.coalesce(own[n], F.when(sure, found[n]))
    empty = lambda name: F.coalesce(name, F.array().cast("array<string>"))
    kind = offers.select(F.array(F.struct(*names))).schema.fields[0].dataType.simpleString()
    every = F.coalesce("offers", F.array().cast(kind))
    full_test = F.exists(every, lambda o: F.coalesce(o["kind"] != SHORT_KIND, F.lit(True)))
    only = F.when(c("_known"), c("_offers") & c("_only") & ~c("_full_card") & ~full_test).otherwise(F.coalesce(before["retake_only"], F.lit(False)))
    priced = F.exists(every, lambda o: F.coalesce(o["text"], F.lit("")) != "")
    signs = entities.confidence(c("operator_source") == "booking_domain", c("operator") != "unknown", c("booking_url").isNotNull(), own["postcode"].isNotNull(), F.size(every), sure, F.coalesce(geo.tier(c("geo.precision")), F.lit(0)), c("n_pages"))
    kept = before["raw"].eqNullSafe(own["raw"]) & geo.same_point(before["lat"], before["lng"], c("geo.lat"), c("geo.lng"))
    cheapest = cheapest_of_one_currency(every)
    return made.select(
        "id", "name", "operator", "operator_source", "external_id", c("canonical").alias("slug"), F.array_remove(F.transform("sources", lambda s: s["slug"]), c("canonical")).alias("merged_slugs"),
        own.withField("city", city).withField("city_source", city_source).withField("region", fill("region")).withField("postcode", fill("postcode")).alias("address"),
        F.struct(empty(c("phones")).alias("phones"), empty(c("emails")).alias("emails"), empty(c("websites")).alias("websites")).alias("contact"), F.get("phones", F.lit(0)).alias("phone"), "geo", "place_id",
        merged_formats(F.transform(every, lambda o: o["format"])).alias("formats"), every.alias("offers"), cheapest["text"].alias("price_text"), cheapest["currency"].alias("currency"), cheapest["price"].alias("price"), "booking_url",
        F.when(c("_known"), c("_offers")).otherwise(F.coalesce(before["retake"], F.lit(False))).alias("retake"), only.alias("retake_only"), (priced | only).alias("publishable"), signs.alias("confidence"), "sources",
        F.coalesce(before["first_seen"], F.lit(seen_at)).alias("first_seen"), F.lit(seen_at).alias("last_seen"), F.when(c("_id").isNotNull() & kept, before["localizations"]).alias("localizations"),
    )
