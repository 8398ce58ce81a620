"""Queries over page records, resolved places, counters and small lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address, geo, html, text
from ..operators import entities, overlay, quality, records, repair, search
from ..sources import pages as page_sources
from .places import _CLUSTERS, _LINKS, _SQL_PAGES, _pages
from .registry import Tables, joined, query

_H1 = r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)"


def _published(t: Tables) -> DataFrame:
    """Raw pages with an address and contact blocks at their end."""
    n = F.col("page_id").cast("string")
    block = lambda kind, inner: F.concat(F.lit(f'<div class="x {records.CONTACT_CLASS}--{kind}">'), *inner, F.lit("</div>"))
    lines = F.concat(F.lit("<h5>Address</h5><p>"), n, F.lit(" Main Street</p><p>"), F.when(F.col("page_id") % 2 == 0, "Halifax, Nova Scotia</p><p>B3H 4R2").otherwise("Tel: +91 22 555 0100"), F.lit("</p></div>"))
    phone = block("phone", [F.lit("<p>Phone: +44 20 555 01"), F.lpad((F.col("page_id") % 100).cast("string"), 2, "0"), F.lit('</p><a href="tel:+44 20 555 0199">call</a>')])
    mail = block("email", [F.lit('<a href="mailto:a'), n, F.lit('@x.org?subject=1">m</a> A'), n, F.lit('@X.org b@y.org <a href="https://www.ieltsusa.org/book">book</a>')])
    page = F.concat(F.when(F.col("page_id") % 10 == 0, F.regexp_replace("html", "(?is)<h1.*?</h1>", "")).otherwise(F.col("html")), phone, mail, lines)
    return t.pages.select(F.col("page_id").alias("slug"), page.alias("html"), F.lit("2026-01-01").alias("fetched_at"))


@query(
    """WITH p AS (SELECT page_id AS slug, page_id % 10 = 0 OR NOT regexp_matches(html, '(?is)<h1\\b[^>]*>.*?[^<> ].*?</h1>') AS failed, page_id % 2 = 0 AS ca FROM pages)
    SELECT slug, failed, CASE WHEN ca THEN 'Halifax' END AS city, CASE WHEN ca THEN 'NS' END AS region, CASE WHEN ca THEN 'B3H 4R2' END AS postcode, CASE WHEN ca THEN 'CA' ELSE 'GB' END AS country,
        '+44 20 555 0199' || CASE WHEN slug % 100 = 99 THEN '' ELSE '|+44 20 555 01' || lpad((slug % 100)::VARCHAR, 2, '0') END || CASE WHEN ca THEN '' ELSE '|+91 22 555 0100' END AS phones, 'a' || slug || '@x.org|b@y.org' AS emails, 'https://www.ieltsusa.org/book' AS websites, 'IELTS USA' AS operator FROM p"""
)
def page_records(t: Tables) -> DataFrame:
    """Raw pages as records: title, address, contacts, country and operator."""
    codes = t.spark.createDataFrame([("44", "GB"), ("91", "IN")], "code string, country string")
    found = records.page_records(_published(t), codes)
    return found.select("slug", "failed", *[F.col(f"address.{c}").alias(c) for c in ("city", "region", "postcode", "country")], *[joined(F.col(f"contact.{c}")).alias(c) for c in ("phones", "emails", "websites")], "operator")


@query(
    f"""WITH RECURSIVE {_SQL_PAGES}, {_LINKS}, {_CLUSTERS}, q AS (SELECT p.*, cluster, k % 9 AS score FROM p JOIN c USING (slug)),
    b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, length(slug), slug) = 1),
    g AS (SELECT cluster, arg_min(ext, slug) FILTER (WHERE ext IS NOT NULL) AS ext, count(*) AS n_pages, bool_or(k % 4 = 0) OR bool_and(k % 6 = 1) AS publishable, list(slug ORDER BY slug) AS slugs, bool_or(k % 2 = 0) AS paper, bool_or(k % 2 = 1) AS computer, arg_min(k % 2, slug) AS lead FROM q GROUP BY cluster)
    SELECT CASE WHEN b.ext IS NOT NULL THEN 'bc-' || b.ext ELSE b.base END AS id, b.slug AS canonical, b.op AS operator, g.ext AS external_id, n_pages, publishable, array_to_string(list_filter(slugs, lambda s: s <> b.slug), '|') AS merged_slugs,
        CASE WHEN paper AND computer THEN CASE WHEN lead = 0 THEN 'paper|computer' ELSE 'computer|paper' END WHEN paper THEN 'paper' ELSE 'computer' END AS formats FROM b JOIN g USING (cluster)"""
)
def resolved_places(t: Tables) -> DataFrame:
    """One place for each cluster of published pages."""
    found = _pages(t)
    rows = entities.indexed(found)
    clusters = entities.clusters(rows, entities.links(rows, every=False))
    key = F.regexp_extract("slug", "x-([0-9]+)$", 1).cast("long")
    given = found.withColumns({"completeness": key % 9, "booking_url": F.lit(None).cast("string"), "phones": F.array(F.concat(F.lit("+1 555 "), key.cast("string"))), "formats": F.array(F.when(key % 2 == 0, "paper").otherwise("computer")), "has_price": key % 4 == 0, "retake_only": key % 6 == 1})
    made = records.resolved_places(given, clusters)
    return made.select("id", "canonical", "operator", "external_id", "n_pages", "publishable", joined(F.col("merged_slugs")).alias("merged_slugs"), joined(F.col("formats")).alias("formats"))


@query(
    """SELECT c_custkey AS slug, CASE c_custkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'US' ELSE NULL END AS country, CASE WHEN c_custkey % 3 < 2 THEN 'Springfield' END AS city,
        CASE WHEN c_custkey % 3 < 2 THEN c_custkey % 4 = 0 END AS retake, CASE WHEN c_custkey % 3 < 2 THEN c_custkey % 8 = 0 END AS retake_only FROM customer"""
)
def country_authority(t: Tables) -> DataFrame:
    """Addresses parsed anew with the country that a listing gives."""
    k = F.col("c_custkey")
    lines = F.array(F.concat(k.cast("string"), F.lit(" Elm Street")), F.lit("Springfield"))
    rows = t.customer.select(k.alias("slug"), address.parsed(lines, F.lit(None).cast("string")).alias("address"))
    listed = t.customer.where("c_custkey % 3 < 2").select(k.alias("slug"), F.when(k % 3 == 0, "CA").otherwise("US").alias("country"))
    slugs = lambda n: t.customer.where(k % n == 0).select(k.alias("slug"))
    return records.with_index(rows, listed, slugs(4), slugs(8)).select("slug", "address.country", "address.city", "retake", "retake_only")


@query(
    """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'GB' END AS country, CASE n_nationkey % 3 WHEN 0 THEN 'Canada' WHEN 1 THEN 'GB' END AS country_name, CASE WHEN n_nationkey % 2 = 0 THEN 'IN' WHEN n_nationkey % 3 < 2 THEN CASE n_nationkey % 3 WHEN 0 THEN 'CA' ELSE 'GB' END ELSE 'US' END AS resolved FROM nation"""
)
def country_lookups(t: Tables) -> DataFrame:
    """Two-letter codes of three-letter ones, names of countries, and the order of sources of a country."""
    k = F.col("n_nationkey")
    rows = t.nation.select("n_nationkey", F.when(k % 3 == 0, "can").when(k % 3 == 1, "GBR").otherwise("XXX").alias("alpha3"))
    codes = t.spark.createDataFrame([("CAN", "CA"), ("GBR", "GB")], "alpha3 string, alpha2 string")
    named = address.country_names(address.two_letters(rows, codes), t.spark.createDataFrame([("CA", "Canada")], "alpha2 string, name string"))
    return named.select("n_nationkey", "country", "country_name", address.resolved_country(F.when(k % 2 == 0, "IN"), F.col("country"), F.lit("US")).alias("resolved"))


#: Lines of an address ({n} is a number) and the street line in them.
_STREETS = [
    (["31 Pippy Place, Unit {n}", "3rd Floor"], "31 Pippy Place"), (["{n} W 1st St, Unit 106", "North Vancouver"], "{n} W 1st St"), (["{n} Skinner St #101", "Nanaimo"], "{n} Skinner St"), (["{n} Bannister Rd SE #101"], "{n} Bannister Rd SE"),
    (["{n} 91 St W, Unit 104", "Edmonton"], "{n} 91 St W"), (["Unit 210, Bentinck St Level", "{n} George St", "Sydney"], "{n} George St"), (["Unit 208 - {n} Kingsway", "Burnaby"], "{n} Kingsway"), (["Bld. 5, 110 - {n} Commerce Parkway"], "{n} Commerce Parkway"),
    (["Bldg 4, {n} Main Street"], "{n} Main Street"), (["Apt 5 - {n} Elm Road"], "{n} Elm Road"), (["Level 3, {n} King Street West"], "{n} King Street West"), (["Ste 200, {n} Kingsway"], "{n} Kingsway"), (["KFUPM square", "Alkhobar/Dammam"], None),
    (["Annex B", "Office 12, {n}a High Lane T2X 1Z2"], "{n}a High Lane"), (["The Hall (OG Level)", "476, {n} Kingsway Ave in Metrotown"], "{n} Kingsway Ave"), (["Room 5"], None), (["{n} Rue Ordinaire", "{n} Queen Blvd. North, Blk 7"], "{n} Queen Blvd. North"),
    (["{n} Somewhere else ,  rear"], "{n} Somewhere else, rear"), (["Campus {n}", "9 X"], None), (["#{n}", "{n}–44 Terrace Hill"], "44 Terrace"),
]
_STREET_SQL = ", ".join("NULL" if want is None else f"'{want}'" for _, want in _STREETS)


@query(
    f"""SELECT s_suppkey, replace([{_STREET_SQL}][(s_suppkey % {len(_STREETS)} + 1)::INT], '{{n}}', (s_suppkey + 10)::VARCHAR) AS street, 'canonical_name_address:Hall, raw|canonical_address:raw' || CASE WHEN s_suppkey % 2 = 0 THEN '|localized_zh:N, A' ELSE '' END AS queries FROM supplier"""
)
def street_lines(t: Tables) -> DataFrame:
    """The street lines of twenty shapes of address, and the queries that look a place up."""
    k = F.col("s_suppkey")
    shapes = F.array(*[F.array(*map(F.lit, lines)) for lines, _ in _STREETS])
    number = (k + 10).cast("string")
    lines = F.transform(F.get(shapes, (k % len(_STREETS)).cast("int")), lambda s: F.replace(s, F.lit("{n}"), number))
    entry = F.struct(F.lit("zh").alias("locale"), F.when(k % 2 == 0, "N").alias("name"), F.lit("A").alias("address"))
    asked = F.transform(records.pilot_queries(F.lit("Hall"), F.lit("raw"), F.array(entry)), lambda q: F.concat_ws(":", q["kind"], q["text"]))
    return t.supplier.select("s_suppkey", address.street_line(lines).alias("street"), joined(asked).alias("queries"))


@query(
    """SELECT page_id, 2::BIGINT AS n_lines, page_id || ' Main Street' AS first_line, CASE WHEN page_id % 3 <> 0 THEN 24::BIGINT END AS n_codes, CASE page_id % 3 WHEN 0 THEN '87G8P27Q+VW' WHEN 1 THEN '9C3XGV4C+XV' END AS plus_code FROM pages"""
)
def page_sections(t: Tables) -> DataFrame:
    """A section below a heading, the codes of a long select element, and an open location code, all in raw pages."""
    k = F.col("page_id")
    shown = F.concat(F.lit("<h5 class='a'> Address </h5><p>"), k.cast("string"), F.lit(" Main Street</p><p>City</p></div><p>other</p>"), "html")
    options = lambda n: "<select>" + "".join(f'<option value="A{chr(65 + i)}B">x</option>' for i in range(n)) + "</select>"
    page = F.concat(F.lit(options(5)), F.when(k % 3 != 0, options(24)).otherwise(""))
    lines = html.paragraphs(html.section(shown, "Address"))
    spot = F.concat(F.lit("at "), F.when(k % 3 == 0, "87g8p27q+vw").when(k % 3 == 1, "9C3XGV4C+XV 2").otherwise("nowhere +2"))
    return t.pages.select("page_id", F.size(lines).cast("long").alias("n_lines"), F.get(lines, F.lit(0)).alias("first_line"), F.size(html.select_options(page)).cast("long").alias("n_codes"), html.plus_code(spot).alias("plus_code"))


@query(
    """SELECT s_suppkey, s_suppkey % 3 = 0 AS is_http, CASE s_suppkey % 3 WHEN 0 THEN 'IN' END AS booked_country, CASE s_suppkey % 5 WHEN 0 THEN 'Halifax' END AS city, CASE WHEN s_suppkey % 2 = 0 THEN 'bc-' || s_suppkey ELSE 'venue' || s_suppkey END AS place_id,
        CASE s_suppkey % 3 WHEN 0 THEN 25::DOUBLE WHEN 1 THEN 5::DOUBLE ELSE 100::DOUBLE END AS radius_km, 'missing_name:' || CASE WHEN s_suppkey % 2 = 0 THEN 'error' ELSE 'info' END AS token, s_suppkey % 7 = 0 AS same_phone, s_suppkey % 4 = 0 AS same_site, s_suppkey % 2 = 0 AS alike FROM supplier"""
)
def record_checks(t: Tables) -> DataFrame:
    """Small checks of a record: links, cities, ids, radii, tokens and what two records share."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    url = F.when(k % 3 == 0, "HTTPS://x.org/b?country=in").when(k % 3 == 1, "ftp://x.org/?a=1").otherwise("https:///b")
    city = F.element_at(F.array(*map(F.lit, ("Halifax", "n/a", "Box 12", "www.x.org", " "))), (k % 5 + 1).cast("int"))
    precision = F.when(k % 3 == 0, "rooftop").when(k % 3 == 1, "street").otherwise("city")
    one = lambda v: F.array(v)
    theirs = F.when(k % 7 == 0, F.concat(F.lit("0044 5550"), F.lpad(n, 6, "0"))).otherwise("+1 222 333 4444")
    return t.supplier.select(
        "s_suppkey", text.is_http_url(url).alias("is_http"), address.country_of_booking(url).alias("booked_country"), address.usable_city(city).alias("city"), entities.place_id(F.when(k % 2 == 0, n), F.concat(F.lit("venue"), n)).alias("place_id"),
        geo.refinement_radius_km(precision).alias("radius_km"), quality.issue_token(F.lit("missing_name"), F.when(k % 2 == 0, "error").otherwise("info")).alias("token"),
        text.phone_overlap(one(F.concat(F.lit("+44 5550"), F.lpad(n, 6, "0"))), one(theirs)).alias("same_phone"), text.website_overlap(one(F.lit("https://www.a.org/x")), one(F.when(k % 4 == 0, "http://A.org").otherwise("http://b.org"))).alias("same_site"),
        (text.text_similarity(F.lit("North Hall College"), F.when(k % 2 == 0, "Hall College, North").otherwise("Other")) >= 0.99).alias("alike"),
    )


@query(
    """WITH c AS (SELECT c_nationkey, bool_or(c_custkey % 3 <> 0) AS known, bool_or(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 50 = 1 END) AS offered, bool_or(c_nationkey % 2 = 0) AS before FROM customer GROUP BY c_nationkey)
    SELECT c_nationkey, CASE WHEN known THEN coalesce(offered, FALSE) ELSE before END AS retake FROM c"""
)
def retake_by_nation(t: Tables) -> DataFrame:
    """Whether any page of a group offers retakes, or was known to."""
    k = F.col("c_custkey")
    rows = t.customer.select("c_nationkey", (k % 3 != 0).alias("known"), F.when(k % 3 != 0, k % 50 == 1).alias("offered"), (F.col("c_nationkey") % 2 == 0).alias("before"))
    return rows.groupBy("c_nationkey").agg(entities.retake_status(F.col("offered"), F.col("known"), F.col("before")).alias("retake"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'general_training' WHEN 1 THEN 'life_skills' WHEN 2 THEN 'academic' ELSE 'other' END AS module, CASE l_linenumber % 4 WHEN 1 THEN 'ukvi_selt' WHEN 3 THEN 'ukvi_selt' ELSE 'standard' END AS category,
        CASE WHEN l_linenumber % 4 = 1 THEN NULL WHEN l_linenumber % 4 = 2 THEN 'paper_writing' WHEN l_returnflag = 'R' THEN 'paper' ELSE 'computer' END AS mode, (l_returnflag = 'A' AND l_linestatus = 'F') OR l_linenumber = 7 AS visible FROM lineitem"""
)
def offer_modules(t: Tables) -> DataFrame:
    """Module, category and mode from an offer's label, and whether its place is shown."""
    n = F.col("l_linenumber")
    label = F.element_at(F.array(*map(F.lit, ("IELTS GT", "Life  Skills A1", "Academic, writing on paper", "IELTS for UKVI"))), (n % 4 + 1).cast("int"))
    module = search.module_of(F.lit(None).cast("string"), label, F.lit("x"))
    offers = F.array(F.struct(F.when(F.col("l_linestatus") == "F", "10 USD").otherwise(" ").alias("text")))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", module.alias("module"), search.category_of(F.lit(None).cast("string"), label, F.lit("x")).alias("category"), search.mode_of(module, label, F.when(F.col("l_returnflag") == "R", "paper_based")).alias("mode"),
        search.visible(F.col("l_returnflag") == "A", n == 7, offers).alias("visible"),
    )


@query(
    """WITH b AS (SELECT c_nationkey::VARCHAR AS country, count(*) AS centres, count(*) FILTER (WHERE c_acctbal < 0) AS errors FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1), a AS (SELECT c_nationkey::VARCHAR AS country, count(*) AS centres, count(*) FILTER (WHERE c_acctbal < 100) AS errors FROM customer GROUP BY 1)
    SELECT country, a.centres - b.centres AS centres, a.errors - b.errors AS errors FROM a JOIN b USING (country) WHERE a.centres <> b.centres OR a.errors <> b.errors"""
)
def country_deltas(t: Tables) -> DataFrame:
    """How the counters of each country changed between two runs."""
    count = lambda rows, least: rows.groupBy(F.col("c_nationkey").cast("string").alias("country")).agg(F.count("*").alias("centres"), F.count_if(F.col("c_acctbal") < least).alias("errors"))
    return quality.country_deltas(count(t.customer.where("c_custkey % 3 <> 0"), 0), count(t.customer, 100), ["centres", "errors"])


@query(
    """WITH e AS (SELECT c_custkey AS id, o_orderkey % 1000 AS n, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AND o_orderstatus = 'F' AND o_orderkey % 9 <= 5)
    SELECT id, 'zh' AS locale, 'addr ' || o_orderkey AS address FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY n, 'addr ' || o_orderkey) = 1"""
)
def localised_addresses(t: Tables) -> DataFrame:
    """The first acceptable local address of each place that may show one."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    places = t.customer.select(k.alias("id"), (k % 2 == 0).alias("pinnable"), (k % 5 == 0).alias("has_local"))
    evidence = t.orders.select(F.col("o_custkey").alias("id"), F.lit("zh").alias("locale"), F.concat(F.lit("addr "), o.cast("string")).alias("address"), (F.col("o_orderstatus") == "F").alias("score_ok"), (o % 9).cast("double").alias("km"), (o % 1000).alias("order"))
    return repair.localised(places, evidence)


@query(
    """WITH f AS (SELECT o_custkey AS id, arg_min(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS o FROM orders GROUP BY 1)
    SELECT id, 'पता ' || o AS address FROM f WHERE o % 3 <> 0 AND (id % 4 = 0 OR id % 10 = o % 10)"""
)
def localised_postal(t: Tables) -> DataFrame:
    """First answers in Devanagari that have the place's postcode."""
    o = F.col("o_orderkey")
    order = F.struct("o_orderdate", "o_orderkey")
    evidence = t.orders.select(F.col("o_custkey").alias("id"), order.alias("order"), F.concat(F.when(o % 3 != 0, "पता ").otherwise("addr "), o.cast("string")).alias("address"), F.concat(F.lit("11 00"), (o % 10).cast("string")).alias("postcode"))
    places = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("1100"), (F.col("c_custkey") % 10).cast("string"))).alias("postcode"))
    return records.local_postal(evidence, places)


@query(
    """SELECT c_custkey, 'hi:' || c_custkey || '|zh:new' AS entries, CASE WHEN c_custkey % 3 = 0 THEN 'name=New' WHEN c_custkey % 3 = 1 THEN 'city=null' ELSE '' END AS patch FROM customer"""
)
def entries_and_patches(t: Tables) -> DataFrame:
    """A local entry replaced by its locale, and the patch that leads from one record to another."""
    k = F.col("c_custkey")
    entry = lambda locale, name: F.struct(F.lit(locale).alias("locale"), name.alias("name"))
    merged = repair.with_locale(F.array(entry("zh", F.lit("old")), entry("hi", k.cast("string"))), F.lit("zh"), entry("zh", F.lit("new")))
    record = lambda name, city: F.struct(name.alias("name"), city.alias("city"))
    before, after = record(F.lit("Old"), F.lit("C")), record(F.when(k % 3 == 0, "New").otherwise("Old"), F.when(k % 3 != 1, "C"))
    patch = F.transform(F.map_entries(overlay.patch_of(before, after, ["name", "city"])), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return t.customer.select("c_custkey", joined(F.transform(merged, lambda e: F.concat_ws(":", e["locale"], e["name"]))).alias("entries"), joined(patch).alias("patch"))


@query("""SELECT split_part(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-', 1) AS prefix, count(*) AS n FROM part GROUP BY 1""")
def slug_prefixes(t: Tables) -> DataFrame:
    """First words of slugs."""
    return page_sources.prefixes(t.part.select(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-").alias("slug")))


@query(
    """SELECT o_orderstatus AS provider, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS before, count(*) AS after, count(*) FILTER (WHERE o_orderkey % 2 <> 0) AS delta FROM orders GROUP BY 1"""
)
def provider_call_deltas(t: Tables) -> DataFrame:
    """Calls to each provider before and after a run."""
    count = lambda rows: rows.groupBy(F.col("o_orderstatus").alias("provider")).agg(F.count("*").alias("calls"))
    return records.call_deltas(count(t.orders.where("o_orderkey % 2 = 0")), count(t.orders)).select("provider", "before", "after", "delta")


@query(
    """SELECT count(*) AS attempted, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS accepted, count(*) FILTER (WHERE o_orderkey % 4 = 1) AS unchanged, count(*) FILTER (WHERE o_orderkey % 4 = 2) AS rejected, count(*) FILTER (WHERE o_orderkey % 4 = 3) AS skipped_admin, 900::BIGINT AS candidates, 400::BIGINT AS skipped_over_limit FROM orders"""
)
def remediation_counts(t: Tables) -> DataFrame:
    """Attempts by outcome and candidates beyond the limit."""
    outcome = F.element_at(F.array(*map(F.lit, ("accepted", "unchanged", "rejected", "skipped_admin"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return records.remediation_counts(t.orders.select(outcome.alias("outcome")), 900, 500)


@query(
    """WITH j AS (SELECT l_suppkey AS id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS k, CASE l_partkey % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'review' ELSE 'reject' END AS d FROM lineitem WHERE l_suppkey % 4 <> 0), b AS (SELECT id, arg_min(d, k) AS d FROM j GROUP BY id)
    SELECT count(*) AS sample_size, count(DISTINCT s_nationkey) AS countries, count(*) FILTER (WHERE d = 'accept') AS accepted, count(*) FILTER (WHERE d = 'review') AS review, count(*) FILTER (WHERE d IS NULL) AS none, (SELECT count(*) FROM j WHERE d = 'reject') AS rejected FROM supplier LEFT JOIN b ON id = s_suppkey"""
)
def decision_summary(t: Tables) -> DataFrame:
    """Best candidates of samples by decision, samples without one, and all rejected candidates."""
    k = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
    decision = F.when(F.col("l_partkey") % 3 == 0, "accept").when(F.col("l_partkey") % 3 == 1, "review").otherwise("reject")
    rows = t.lineitem.where("l_suppkey % 4 <> 0").select(F.col("l_suppkey").alias("id"), k.alias("k"), decision.alias("decision"))
    first = rows.groupBy("id").agg(F.min("k").alias("first"))
    judged = rows.join(first, "id").select("id", "decision", F.when(F.col("k") == F.col("first"), 1).otherwise(2).alias("rank"))
    return records.decision_summary(judged, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("country")))


@query(f"WITH {_SQL_PAGES}, {_LINKS} SELECT reason, count(*) AS n FROM l GROUP BY reason")
def link_reasons(t: Tables) -> DataFrame:
    """Links between pages by reason."""
    return records.link_counts(entities.links(entities.indexed(_pages(t))))


@query("""SELECT l_partkey AS entity, coalesce(max(CASE WHEN l_suppkey % 11 <> 0 THEN l_linenumber % 5 END), -1) AS best FROM lineitem GROUP BY 1""")
def best_tiers(t: Tables) -> DataFrame:
    """The best tier of each part's candidates that were not rejected."""
    rows = t.lineitem.select(F.col("l_partkey").alias("entity"), (F.col("l_linenumber") % 5).alias("tier"), F.when(F.col("l_suppkey") % 11 != 0, 1).alias("score"))
    return records.best_tier(records.tagged(rows, "lines", "embed"))


@query("""SELECT o_orderstatus AS precision, count(*) AS n FROM orders GROUP BY 1""")
def precision_breakdown(t: Tables) -> DataFrame:
    """Places by precision."""
    return records.precision_breakdown(t.orders.select(F.col("o_orderstatus").alias("precision")))


@query("""SELECT c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS distance_km FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3""")
def comparison_list(t: Tables) -> DataFrame:
    """Compared records of one country and status, the furthest first."""
    rows = t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("country"), F.col("c_mktsegment").alias("status"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("distance_km"))
    return records.comparison(rows, "BUILDING", "3").select("name", "distance_km")
