"""Entity resolution: which published pages are one place, and what the merged record says.

Decisions do not depend on the order of rows: each pair is judged once, with flags for the blocks that it shares, the star
of a slug base has its smallest slug as centre, and ties go to the smaller slug.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..sources.storage import materialise
from . import pairing
from .components import components

# Similarity and distance limits, and the sizes of blocks within which pairs are compared.
SAME_ADDRESS, SAME_POSTCODE, NEAR_NAME, NEAR_KM = 0.6, 0.8, 0.75, 0.15
BLOCK = (2, 400)


def indexed(pages: DataFrame) -> DataFrame:
    """Pages with their matching keys; pages have slug, name, external_id, operator, operator_source, address, city, postcode, lat, lng."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return pages.select(
        "slug", "external_id", "operator", "operator_source", "lat", "lng", text.name_key(F.col("name")).alias("key"), text.slug_base(F.col("slug")).alias("base"),
        text.postcode_key(F.col("postcode")).alias("postcode"), text.name_key(empty("city")).alias("city"), text.name_key(empty("address")).alias("address"),
    )


def mergeable(a: str = "a", b: str = "b") -> Column:
    """Two different external ids, or two different operators that were both read from a booking link, are two places."""
    x, y = lambda c: F.col(f"{a}.{c}"), lambda c: F.col(f"{b}.{c}")
    other_id = F.coalesce(x("external_id") != y("external_id"), F.lit(False))
    other_operator = (x("operator_source") == "booking_domain") & (y("operator_source") == "booking_domain") & (x("operator") != y("operator"))
    return ~other_id & ~F.coalesce(other_operator, F.lit(False))


def _link(reason: str, strength: Column | float = 1.0) -> list[Column]:
    return [F.col("a.slug").alias("a"), F.col("b.slug").alias("b"), F.lit(reason).alias("reason"), (F.lit(strength) if isinstance(strength, float) else strength).alias("strength")]


def _stars(rows: DataFrame, key: str) -> DataFrame:
    """Each row b of a block with the block's first row a; one aggregate instead of all pairs."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), "slug").alias("a"))
    return rows.select(F.struct(*rows.columns).alias("b"), F.col(key).alias("_key")).join(first.withColumnRenamed(key, "_key"), "_key").where("a.slug < b.slug")


def links(rows: DataFrame, every: bool = True) -> DataFrame:
    """(a, b, reason, strength) of indexed pages that are one place: external id, slug base, or address and operator and name.

    Pages of one address, operator, name and external id are copies of each other. With `every` all pairs of copies are given; without, they
    are linked to the first of them, which alone is compared with other names: fewer rows that connect the same pages.
    """
    by_id = _stars(rows.where("external_id <> ''"), "external_id").select(*_link("external_id"))
    by_slug = _stars(rows, "base").where(mergeable()).select(*_link("slug_base"))
    addressed = rows.where((F.length("address") >= 10) & F.col("operator").isNotNull() & F.col("key").isNotNull())
    found = by_id.unionByName(by_slug)
    if not every:
        copies = addressed.withColumn("copy", F.struct("address", "operator", "key", F.col("external_id").isNull(), F.coalesce("external_id", F.lit(""))))
        found = found.unionByName(_stars(copies, "copy").select(*_link("operator_address")))
        addressed = addressed.groupBy("address", "operator", "key", "external_id").agg(F.min("slug").alias("slug"), F.min("operator_source").alias("operator_source"))
    similarity = text.name_similarity(F.col("a.key"), F.col("b.key"))
    pairs = addressed.alias("a").join(addressed.alias("b"), (F.col("a.address") == F.col("b.address")) & (F.col("a.operator") == F.col("b.operator")) & (F.col("a.slug") < F.col("b.slug")))
    return found.unionByName(pairs.where(mergeable() & (similarity >= SAME_ADDRESS)).select(*_link("operator_address", similarity)))


def clusters(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(slug, cluster): the smallest slug that links reach from each page."""
    named = components(found.select("a", "b"))
    return rows.select("slug").join(named, F.col("slug") == F.col("node"), "left").select("slug", F.coalesce("root", "slug").alias("cluster"))


def _blocked(rows: DataFrame, cluster_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages of each block of equal postcode or city, and the blocks' sizes."""
    keyed = rows.join(cluster_of, "slug").select("*", F.explode(F.array(F.concat(F.lit("pc:"), "postcode"), F.concat(F.lit("city:"), "city"))).alias("block"))
    return keyed, keyed.groupBy("block").agg(F.count("*").alias("n"))


def left_out(rows: DataFrame, cluster_of: DataFrame, block: tuple[int, int | None] = BLOCK) -> DataFrame:
    """(block, n): the blocks that pending() does not compare as they are too large, so that a reviewer knows of them."""
    _, sizes = _blocked(rows, cluster_of)
    return sizes.where(F.col("n") > block[1]) if block[1] is not None else sizes.where(F.lit(False))


def pending(rows: DataFrame, cluster_of: DataFrame, block: tuple[int, int | None] = BLOCK) -> DataFrame:
    """(a, b, reason, strength) of pairs for a reviewer: alike in name, and in postcode or within NEAR_KM. They are never merged.

    Pairs come from blocks of equal postcode or city with a size within `block`, which is what the review is for; without an upper size
    every block is compared. left_out() has the blocks above it.
    """
    keyed, sizes = _blocked(rows, cluster_of)
    fits = (F.col("n") >= block[0]) & (F.col("n") <= block[1] if block[1] is not None else F.lit(True))
    blocks = sizes.where(fits).select("block")
    # what a page has to say to a pair is worked out once for each page; a pair that shares both blocks is judged in that of its postcode
    reviewed = blocks.select(F.col("block").alias("_block"), F.lit(True).alias("_by_code"))
    own = keyed.join(blocks, "block").join(reviewed, F.concat(F.lit("pc:"), "postcode") == F.col("_block"), "left").select(
        "block", "slug", "cluster", "key", "postcode", "external_id", "operator", "operator_source", "lat", "lng", F.length("key").alias("size"), F.array_distinct(text.tokens(F.col("key"))).alias("words"),
        (F.coalesce("_by_code", F.lit(False)) & F.col("block").startswith("city:")).alias("elsewhere"),
    )
    own = materialise(own.distinct(), "blocked")
    pairs = pairing.once(own, ["block"], "slug")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    pairs = pairs.where((x("cluster") != y("cluster")) & ~(x("elsewhere") & F.coalesce(x("postcode") == y("postcode"), F.lit(False))) & mergeable())
    code = F.coalesce((x("postcode") != "") & (x("postcode") == y("postcode")), F.lit(False))
    near = F.coalesce(geo.haversine_km(x("lat"), x("lng"), y("lat"), y("lng")) <= NEAR_KM, F.lit(False))
    longest, shared = F.greatest(x("size"), y("size")), F.size(F.array_intersect(x("words"), y("words")))
    by_words = F.when((F.size(x("words")) > 0) & (F.size(y("words")) > 0), shared / F.greatest(F.size(x("words")), F.size(y("words")))).otherwise(0.0)
    strength = F.greatest(F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x("key"), y("key")) / longest), by_words)
    # names are compared last, and once for all pairs but those that are kept
    alike = pairs.where(code | near).where(strength >= F.when(near, NEAR_NAME).otherwise(SAME_POSTCODE))
    reason = F.when(code & (strength >= SAME_POSTCODE), "name_postcode").otherwise("name_proximity")
    return alike.select(F.least(x("slug"), y("slug")).alias("a"), F.greatest(x("slug"), y("slug")).alias("b"), reason.alias("reason"), strength.alias("strength"))


def completeness(embedded: Column, postcode: Column, lines: Column, contacts: Column, booking: Column, by_domain: Column, offers: Column) -> Column:
    points = lambda when, n: F.when(F.coalesce(when, F.lit(False)), n).otherwise(0)
    return points(embedded, 4) + points(postcode, 2) + points(lines > 1, 1) + points(contacts > 0, 1) + points(booking, 1) + points(by_domain, 2) + F.least(offers, F.lit(6))


def canonical(rows: DataFrame, cluster: str = "cluster", score: str = "completeness", slug: str = "slug") -> DataFrame:
    """The most complete row of each cluster; the shorter, then the smaller slug wins ties."""
    best = Window.partitionBy(cluster).orderBy(F.desc(score), F.length(slug), slug)
    return rows.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def merged_offers(offers: DataFrame, cluster: str, identity: list[str], price: str, order: str) -> DataFrame:
    """Offers of a cluster: equal identity and price once, and none without a price where the identity has a priced one."""
    first = Window.partitionBy(cluster, *identity, price).orderBy(order)
    once = offers.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    priced = F.max(F.col(price).isNotNull()).over(Window.partitionBy(cluster, *identity))
    return once.withColumn("_priced", priced).where(F.col(price).isNotNull() | ~F.col("_priced")).drop("_priced")


def merged_values(rows: DataFrame, cluster: str, value: str, order: list[str], identity) -> DataFrame:
    """(cluster, values): the first of each identity in order, as an array; blank ones are left out."""
    keyed = rows.withColumn("_key", identity(F.col(value))).where("_key <> ''")
    first = keyed.groupBy(cluster, "_key").agg(F.min(F.struct(*order, value)).alias("_first"))
    return first.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list("_first")), lambda f: f[value]).alias("values"))


def place_id(external_id: Column, slug: Column) -> Column:
    return F.when(F.coalesce(external_id, F.lit("")) != "", F.concat(F.lit("bc-"), external_id)).otherwise(text.slug_base(slug))


def retake_status(offered: Column, known: Column, previous: Column) -> Column:
    """Of a group: true if any page offers it, what was known before where nothing is known now."""
    return F.when(F.bool_or(known), F.coalesce(F.bool_or(offered), F.lit(False))).otherwise(F.bool_or(previous))


def confidence(by_domain: Column, operator_known: Column, booking: Column, postcode: Column, offers: Column, verified: Column, tier: Column, pages: Column) -> Column:
    """Between 0.2 and 1, to two decimals, from independent signs that a record is right."""
    add = lambda when, n: F.when(F.coalesce(when, F.lit(False)), n).otherwise(0.0)
    operator = F.when(F.coalesce(by_domain, F.lit(False)), 0.3).otherwise(add(operator_known, 0.1))
    place = F.when(verified & (tier >= 3), 0.2).otherwise(add(verified | (tier == 2), 0.1))
    total = 0.2 + operator + add(booking, 0.1) + add(postcode, 0.1) + add(offers > 0, 0.1) + place + add(pages > 1, 0.05)
    return F.floor(F.least(total, F.lit(1.0)) * 100 + 0.5) / 100
