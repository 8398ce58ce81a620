"""From fetched pages to records, and from clusters of records to places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import address, html, maps, providers, text
from . import entities

# Labels of phones inside a line, and links that are written out.
LABELLED = r"(?i)\b(?:phone(?:\s+number)?|tel(?:ephone)?\.?)\s*[:.]?\s*(.+?)(?=\s+(?:e-?mail)\b|$)"
LINK = r"(?i)(https?://[^\s<>\"']+|www\.[^\s<>\"']+)"
CONTACT_CLASS = "test-center-header__content-column-contact"


def contact_blocks(page: Column, css_class: str = CONTACT_CLASS) -> Column:
    """The contact blocks of a page, whole; an Arrow function, so a column of its own."""
    return html.balanced_elements("div", rf"class=[\"'][^\"']*{css_class}(?:\s|--)[^\"']*[\"']")(page)


def contacts(blocks: Column, lines: Column) -> Column:
    """struct(phones, emails, websites) of a page's contact blocks and its address lines, each value once, in order.

    In a block, mailto: and tel: links and links to other sites count by their scheme, its text for e-mail addresses, and its paragraphs for
    phones if the block is one of phones.
    """
    links = lambda b, scheme: F.filter(html.hrefs(b), lambda h: h.rlike(f"(?i)^{scheme}"))
    target = lambda h: F.regexp_replace(h, r"(?i)^(?:mailto|tel):|\?.*$", "")
    each = lambda values, of: F.flatten(F.transform(values, of))
    by_phone = lambda b: F.regexp_extract(b, "(?is)^<div[^>]*>", 0).rlike("(?i)contact--phone")
    none = F.array().cast("array<string>")
    phones = each(blocks, lambda b: F.concat(each(links(b, "tel:"), lambda h: html.phones(target(h))), F.when(by_phone(b), each(html.paragraphs(b), html.phones)).otherwise(none)))
    emails = each(blocks, lambda b: F.concat(each(links(b, "mailto:"), lambda h: html.emails(target(h))), html.emails(html.stripped(b))))
    sites = each(blocks, lambda b: links(b, "https?://"))
    written = lambda line: F.transform(F.regexp_extract_all(line, F.lit(LINK), 1), lambda u: F.when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u)))
    labelled = lambda line: html.phones(F.regexp_extract(line, LABELLED, 1))
    return F.struct(
        text.unique_by(F.concat(phones, each(lines, labelled)), text.phone_identity).alias("phones"),
        text.unique_by(F.concat(emails, each(lines, html.emails)), F.lower).alias("emails"),
        text.unique_by(F.concat(sites, each(lines, written)), text.website_identity).alias("websites"),
    )


def page_records(pages: DataFrame, codes: DataFrame, heading: str = "Address") -> DataFrame:
    """pages (slug, html, fetched_at) as records; `failed` marks those without a title, whose other columns are not to be used.

    codes has (code, country) of dialling prefixes, see address.country_of_phone. The country is the address's, else the booking link's, else the
    first phone's.
    """
    page = F.col("html")
    rows = pages.select("slug", "html", "fetched_at", html.heading(page).alias("name"), html.paragraphs(html.section(page, heading)).alias("lines"))
    rows = rows.withColumn("blocks", contact_blocks(page))
    rows = rows.withColumns({"contact": contacts(F.col("blocks"), F.col("lines")), "geo": html.map_centre(page), "offers": html.offers(page), "address": address.parsed(F.col("lines"), F.lit(None).cast("string"))})
    booking = F.coalesce(html.booking_url(F.flatten(F.col("offers.links"))), html.booking_url(html.hrefs(page)))
    rows = rows.withColumn("booking_url", booking).withColumn("phone", F.get("contact.phones", F.lit(0)))
    rows = address.country_of_phone(rows, codes).withColumn("detected", html.detected_operator(F.col("booking_url"), F.col("slug"), F.col("name")))
    country = address.resolved_country(F.col("address.country"), address.country_of_booking(F.col("booking_url")), F.col("phone_country"))
    return rows.select(
        "slug", "name", F.col("name").isNull().alias("failed"), F.col("detected.operator").alias("operator"), F.col("detected.source").alias("operator_source"), html.external_id(F.col("booking_url")).alias("external_id"),
        F.col("address").withField("country", country).alias("address"), "contact", "phone", "geo", "offers", "booking_url", "fetched_at",
    )


def with_index(records: DataFrame, listed: DataFrame, retakes: DataFrame, retakes_only: DataFrame) -> DataFrame:
    """records with the country of the listing where it has one, their lines parsed anew with it, and two flags; null where it has none.

    listed has (slug, country); retakes and retakes_only have slugs. Each has a slug once.
    """
    tag = lambda rows, name: rows.select(F.col("slug").alias(f"_{name}")).distinct()
    joined = records.join(listed.select(F.col("slug").alias("_slug"), F.col("country").alias("_country")), F.col("slug") == F.col("_slug"), "left")
    joined = joined.join(tag(retakes, "offers"), F.col("slug") == F.col("_offers"), "left").join(tag(retakes_only, "only"), F.col("slug") == F.col("_only"), "left")
    known = F.col("_country").isNotNull()
    again = F.when(known, address.parsed(F.col("address.lines"), F.col("_country"))).otherwise(F.col("address"))
    flags = {"retake": F.when(known, F.col("_offers").isNotNull()), "retake_only": F.when(known, F.col("_only").isNotNull())}
    return joined.withColumns({"address": again, **flags}).drop("_slug", "_country", "_offers", "_only")


def merged_formats(formats: Column) -> Column:
    """Formats of a place's offers, each once, in order."""
    return F.array_distinct(F.filter(formats, lambda f: f.isNotNull()))


def resolved_places(records: DataFrame, clusters: DataFrame, score: str = "completeness") -> DataFrame:
    """One place per cluster, from records (slug, name, operator, external_id, booking_url, phones, formats, has_price, retake_only, score) and
    clusters (slug, cluster).

    The most complete record names the place; the first by slug that has an external id or booking link gives it; the slugs of the others
    are kept, phones come from the canonical record first. A place is publishable if it has a price or offers retakes alone. What a cluster
    collects is a few values of each of its pages.
    """
    rows = records.join(clusters, "slug")
    best = entities.canonical(rows, "cluster", score, "slug").select("cluster", F.col("slug").alias("canonical"), "name", "operator", F.col("phones").alias("_own"), entities.place_id(F.col("external_id"), F.col("slug")).alias("id"))
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("slug")))
    together = rows.groupBy("cluster").agg(
        F.sort_array(F.collect_list("slug")).alias("slugs"), first("external_id").alias("external_id"), first("booking_url").alias("booking_url"), F.count("*").alias("n_pages"),
        F.array_sort(F.collect_list(F.struct("slug", "phones", "formats"))).alias("_each"), F.bool_or("has_price").alias("has_price"), F.bool_and("retake_only").alias("retake_only"),
    )
    joined = best.join(together, "cluster")
    phones = text.unique_by(F.concat("_own", F.flatten(F.col("_each.phones"))), text.phone_identity)
    return joined.select(
        "id", "cluster", "canonical", "name", "operator", "external_id", "booking_url", F.array_remove("slugs", F.col("canonical")).alias("merged_slugs"), phones.alias("phones"),
        merged_formats(F.flatten(F.col("_each.formats"))).alias("formats"), (F.coalesce("has_price", F.lit(False)) | F.coalesce("retake_only", F.lit(False))).alias("publishable"), "n_pages",
    )


def members(clusters: DataFrame, places: DataFrame, place_of: Column) -> DataFrame:
    """clusters joined to places (id, ...) by the id that place_of computes for them; those that no place has are left out."""
    return clusters.withColumn("id", place_of).join(places, "id")


def by_slug(places: DataFrame, slug: str) -> DataFrame:
    """The places that have a slug as their own or as one that was merged into them."""
    return places.where((F.col("canonical") == slug) | F.array_contains("merged_slugs", slug))


def in_country(records: DataFrame, country: str = "ALL", column: str = "country") -> DataFrame:
    """records of a country, or all; an error if there are none, so that no empty dataset is written by mistake."""
    found = records if country == "ALL" else records.where(F.col(column) == country)
    if found.isEmpty():
        raise ValueError(f"no record is in {country}")
    return found


def pilot_queries(name: Column, raw: Column, entries: Column) -> Column:
    """array of struct(kind, text): name and address, the address alone, and the first local entry that has both."""
    one = lambda kind, value: F.struct(kind.alias("kind"), value.alias("text"))
    local = F.get(F.filter(entries, lambda e: (F.coalesce(e["name"], F.lit("")) != "") & (F.coalesce(e["address"], F.lit("")) != "")), F.lit(0))
    always = F.array(one(F.lit("canonical_name_address"), F.concat_ws(", ", name, raw)), one(F.lit("canonical_address"), raw))
    extra = F.when(local.isNotNull(), F.array(one(F.concat(F.lit("localized_"), local["locale"]), F.concat_ws(", ", local["name"], local["address"]))))
    return F.concat(always, F.coalesce(extra, F.filter(always, lambda _: F.lit(False))))


def local_postal(evidence: DataFrame, places: DataFrame) -> DataFrame:
    """(id, address) of the first answer (id, order, address, postcode) of each place (id, postcode) if it may be shown: written in Devanagari,
    and with the place's postcode if it has one. A refused first answer is not replaced by a later one."""
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    first = evidence.groupBy("id").agg(F.min_by(F.struct("address", "postcode"), "order").alias("a"))
    joined = first.join(places.select("id", F.col("postcode").alias("_own")), "id")
    fits = (digits(F.col("_own")) == "") | (digits(F.col("_own")) == digits(F.col("a.postcode")))
    return joined.where(fits & F.col("a.address").rlike(r"[\x{0900}-\x{097F}]")).select("id", F.col("a.address").alias("address"))


# Names that are looked up, kinds and names of places that count.
LOOKED_UP, SCHOOL, VENUE = r"(?i)\b(?:university|college|school|institute|academy|IELTS)\b", "科教文化服务;学校", r"(?i)(?:雅思|IELTS).*(?:考点|考试|机考|中心)"
HAN = r"\p{IsHan}"


def local_place(hits: DataFrame, places: DataFrame, within_m: float = 5000) -> DataFrame:
    """(id, name, address) of the first hit (id, order, name, type, distance, province, city, district, address) that may name each place (id, name, lines).

    Only schools and test venues are looked up. A hit counts if it is near, written in Chinese, a school or a test venue by its name, and has
    one of the house numbers of the place's street lines, if those have any.
    """
    wanted = places.where(F.col("name").rlike(LOOKED_UP)).select("id", providers.street_numbers_of_lines(F.col("lines")).alias("_numbers"))
    found = hits.withColumns({"name": F.trim("name"), "_address": providers.joined_once(F.array(*[F.trim(c) for c in ("province", "city", "district", "address")]))}).join(wanted, "id")
    numbered = (F.size("_numbers") == 0) | F.exists("_numbers", lambda n: F.contains(F.col("_address"), F.concat(n, F.lit("号"))))
    kind = F.coalesce(F.col("type").contains(SCHOOL), F.lit(False)) | F.col("name").rlike(VENUE)
    good = found.where(F.col("name").rlike(HAN) & F.coalesce(F.col("distance") <= within_m, F.lit(False)) & kind & F.col("_address").rlike(HAN) & numbered)
    return good.groupBy("id").agg(F.min_by(F.struct("name", "_address"), "order").alias("_h")).select("id", F.col("_h.name").alias("name"), F.col("_h._address").alias("address"))


# -- counters ------------------------------------------------------------------------------------------------------------------


def best_tier(candidates: DataFrame, entity: str = "entity") -> DataFrame:
    """(entity, best): the highest tier among its candidates that were not rejected, -1 if all were."""
    return candidates.groupBy(entity).agg(F.coalesce(F.max(F.when(F.col("score").isNotNull(), F.col("tier"))), F.lit(-1)).alias("best"))


def tagged(candidates: DataFrame, source: str, path: str) -> DataFrame:
    """candidates with the provider and the path of evidence that they came by."""
    return candidates.withColumns({"source": F.lit(source), "evidence_path": F.lit(path)})


def remediation_counts(attempts: DataFrame, candidates: int, limit: int, enabled: bool = True) -> DataFrame:
    """One row over attempts (outcome): how many, of each outcome, and how many candidates were beyond the limit."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return attempts.agg(F.count("*").alias("attempted"), *map(n, ("accepted", "unchanged", "rejected", "skipped_admin"))).withColumns(
        {"candidates": F.lit(candidates).cast("long"), "skipped_over_limit": F.lit(max(0, candidates - limit) if enabled else 0).cast("long")}
    )


def call_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(provider, before, after, delta) of calls counted in two tables (provider, calls), 0 where one lacks a provider."""
    joined = before.withColumnRenamed("calls", "before").join(after.withColumnRenamed("calls", "after"), "provider", "full").fillna(0, ["before", "after"])
    return joined.withColumn("delta", F.col("after") - F.col("before"))


def call_changes(before: Column, after: Column) -> Column:
    """The calls of a run by provider, from maps of all calls counted before and after it; a provider without any stays, with 0."""
    return maps.combined(after, before, lambda x, y: x - y)


def link_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("reason").agg(F.count("*").alias("n"))


def decision_summary(judged: DataFrame, samples: DataFrame, sample: str = "id") -> DataFrame:
    """One row over samples (id, country) and judged candidates (id, rank, decision): the best candidates by decision, samples without one, and
    rejected candidates of any rank. A rejected best candidate is none of accept or review."""
    best = judged.where("rank = 1").groupBy(sample).agg(F.min("decision").alias("_best"))
    joined = samples.join(best, sample, "left")
    one = joined.agg(F.count("*").alias("sample_size"), F.countDistinct("country").alias("countries"), F.count_if(F.col("_best") == "accept").alias("accepted"), F.count_if(F.col("_best") == "review").alias("review"), F.count_if(F.col("_best").isNull()).alias("none"))
    return one.join(judged.agg(F.count_if(F.col("decision") == "reject").alias("rejected")))  # one row each


def precision_breakdown(places: DataFrame) -> DataFrame:
    """(precision, n), most frequent first."""
    return places.where("precision IS NOT NULL").groupBy("precision").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "precision")


def comparison(records: DataFrame, status: str | None = None, country: str | None = None) -> DataFrame:
    """Records (name, country, status, distance_km) of a status and country: those with a match by falling distance, then the others by name."""
    found = records if status is None else records.where(F.col("status") == status)
    found = found if country is None else found.where(F.col("country") == country)
    return found.orderBy(F.desc_nulls_last("distance_km"), "name")
