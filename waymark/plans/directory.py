"""Queries over what a directory shows and what its editors see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display, geo, html, names, numbers
from ..operators import matching, overlay, pairing, quality, repair, search
from .registry import Tables, joined, query, sql_places

# Quarters of a degree are exact, and so are their sums.
_QUARTERS = "CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey * 7919 % 720 AS DOUBLE) / 4 - 90 END AS lat, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey * 104729 % 1440 AS DOUBLE) / 4 - 180 END AS lng"


def _located(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    known = lambda c: F.when(k % 3 != 0, c)
    city = F.when(k % 5 != 0, F.initcap("c_mktsegment"))
    precision = F.when(k % 2 == 0, "street").otherwise("city")
    point = [known((k * m % n).cast("double") / 4 - half).alias(c) for c, m, n, half in (("lat", 7919, 720, 90), ("lng", 104729, 1440, 180))]
    return t.customer.select(k.alias("id"), F.when(k % 7 != 0, F.col("c_nationkey")).alias("country"), city.alias("city"), known(precision).alias("precision"), *point)


@query(
    f"""WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS country, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS city, c_custkey % 2 = 0 AS street, {_QUARTERS} FROM customer),
    t AS (SELECT country, city, avg(lat) AS lat, avg(lng) AS lng FROM p WHERE lat IS NOT NULL AND city IS NOT NULL GROUP BY ALL), c AS (SELECT country, avg(lat) AS lat, avg(lng) AS lng FROM p WHERE lat IS NOT NULL GROUP BY ALL),
    b AS (SELECT n_nationkey AS country, n_nationkey * 1.0::DOUBLE AS mid_lat, n_nationkey * 2.0::DOUBLE AS mid_lng, CASE WHEN 4 * n_nationkey > 80 THEN 3 WHEN 4 * n_nationkey > 35 THEN 4 WHEN 4 * n_nationkey > 15 THEN 5 ELSE 6 END AS zoom FROM nation WHERE n_nationkey % 2 = 0)
    SELECT p.id, coalesce(p.lat, t.lat, b.mid_lat, c.lat, 18) AS lat, coalesce(p.lng, t.lng, b.mid_lng, c.lng, 5) AS lng,
        CASE WHEN p.lat IS NOT NULL THEN CASE WHEN street THEN 15 ELSE 11 END WHEN t.lat IS NOT NULL THEN 11 WHEN b.country IS NOT NULL THEN b.zoom WHEN c.lat IS NOT NULL THEN 5 ELSE 2 END AS zoom
    FROM p LEFT JOIN t ON p.country IS NOT DISTINCT FROM t.country AND p.city = t.city LEFT JOIN c ON p.country IS NOT DISTINCT FROM c.country LEFT JOIN b ON p.country = b.country"""
)
def location_picker_starts(t: Tables) -> DataFrame:
    """Where a map opens to place each customer."""
    k = F.col("n_nationkey").cast("double")
    bounds = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("country"), F.lit(0.0).alias("south"), (2 * k).alias("north"), F.lit(0.0).alias("west"), (4 * k).alias("east"))
    return geo.picker_starts(_located(t), bounds)


@query(
    f"""WITH p AS (SELECT c_custkey AS id, {_QUARTERS} FROM customer), b AS (SELECT id, lat + CASE id % 4 WHEN 0 THEN 0.0000004::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0 END AS lat, CASE WHEN id % 11 <> 0 THEN lng END AS lng FROM p)
    SELECT id, lat IS NULL OR (lng IS NOT NULL AND id % 4 <> 1) AS same_point FROM b"""
)
def same_points(t: Tables) -> DataFrame:
    """Whether points moved by nothing, a hair or half a degree are the same; missing ones are."""
    k = F.col("id")
    moved = F.col("lat") + F.when(k % 4 == 0, 0.0000004).when(k % 4 == 1, 0.5).otherwise(0.0)
    return _located(t).select("id", geo.same_point(F.col("lat"), F.col("lng"), moved, F.when(k % 11 != 0, F.col("lng"))).alias("same_point"))


@query(
    """SELECT page_id, i.n AS n, CASE i.n WHEN 1 THEN 'IELTS Academic ' || page_id WHEN 2 THEN 'IELTS for UKVI & more' ELSE 'Life Skills A1' END AS label, CASE i.n WHEN 1 THEN 'academic' WHEN 2 THEN 'ukvi' ELSE 'life_skills' END AS kind,
        CASE WHEN i.n = 1 AND page_id % 2 = 0 THEN 'paper_based' ELSE 'computer_delivered' END AS format, CASE i.n WHEN 1 THEN 'CAD ' || (300 + page_id % 50) WHEN 2 THEN NULL ELSE 'GBP 150' END AS price, i.n = 2 AS bookable
    FROM pages, (SELECT unnest([1, 2, 3]) AS n) i"""
)
def price_table_offers(t: Tables) -> DataFrame:
    """The rows of a price table, nested elements and headings inside."""
    key, row = F.col("page_id"), "ielts-tests-available__test-row"
    cell = lambda title, price, more="": f'<div class="{row} x"><h6 class="{row}-title">{title}</h6><div><p class="{row}-price">{price}</p></div>{more}</div>'
    first = F.format_string(cell("IELTS <b>Academic</b> %d", "CAD %d", "%s"), key, 300 + key % 50, F.when(key % 2 == 0, '<i aria-label="Test on paper"></i>').otherwise(""))
    rest = cell("IELTS for UKVI &amp; more", " ", '<a href="https://ielts.idp.com/book/UKVI">Book</a>') + cell("Fee", "USD 1") + cell("Life Skills A1", "</p><p>", f'<p class="{row}-price">GBP 150</p>')
    found = t.pages.select("page_id", F.posexplode(html.offers(F.concat(F.lit("<body><div>"), first, F.lit(rest + "</div></body>")))).alias("i", "o"))
    return found.select("page_id", (F.col("i") + 1).alias("n"), "o.label", "o.kind", "o.format", "o.price", html.booking_url(F.col("o.links")).isNotNull().alias("bookable"))


@query("""SELECT page_id, 'venue ' || page_id || CASE WHEN page_id % 3 = 0 THEN '|only-' || page_id || '!' ELSE '' END AS cards FROM pages""")
def retake_cards(t: Tables) -> DataFrame:
    """Cards with a badge; those without a box of formats are marked."""
    key = F.col("page_id")
    card = lambda slug, inner: f'<a class="test-centre-card" href="/test-centres/{slug}?x=1"><span>{inner}</span></a>'
    badge, box = '<i class="test-centre-card__osr"></i>', '<i class="test-centre-card__formats-box"></i>'
    third = F.when(key % 3 == 0, F.format_string(card("only-%d", badge), key)).otherwise(F.lit(card("plain", box)))
    page = F.concat(F.format_string(card("venue%%20%d", badge + box), key), F.lit(f"<p>{badge}</p>" + card("none", box)), third)
    marked = F.transform(html.cards(page), lambda c: F.concat(c["slug"], F.when(c["only"], "!").otherwise("")))
    return t.pages.select("page_id", joined(marked).alias("cards"))


_RATES = "SELECT count(*) AS n, count(DISTINCT c_nationkey) AS countries, count(*) FILTER (c_custkey % 5 < 2) AS exact, count(*) FILTER (c_custkey % 5 = 2) AS campus, count(*) FILTER (c_custkey % 5 = 4) AS no_result FROM customer"


@query(
    f"""WITH s AS ({_RATES}), w AS (SELECT *, CAST(exact AS DOUBLE) / n AS p, 1.96::DOUBLE * 1.96::DOUBLE AS zz FROM s)
    SELECT n AS sample_size, countries, 'measured' AS status, {sql_places("CAST(n - no_result AS DOUBLE) / n", 4)} AS selection_coverage, {sql_places("CAST(exact AS DOUBLE) / n", 4)} AS exact_coverage,
        {sql_places("CAST(exact + campus AS DOUBLE) / (n - no_result)", 4)} AS usable_agreement, {sql_places("((p + zz / (2 * n)) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)", 4)} AS exact_low FROM w"""
)
def search_agreement_summary(t: Tables) -> DataFrame:
    """Counts, rates and intervals over assessed searches."""
    k = F.col("c_custkey")
    agreement = F.when(k % 5 < 2, "exact").when(k % 5 == 2, "campus").when(k % 5 == 3, "disagrees").otherwise("no_result")
    records = t.customer.select(F.col("c_nationkey").alias("country"), agreement.alias("agreement"), F.lit(2).alias("queries"), F.when(k % 10 == 0, 1).otherwise(0).alias("errors"), F.lit(3).alias("candidates"), F.lit(0).alias("outside"))
    found = matching.search_summary(records)
    return found.select("sample_size", "countries", "status", "selection_coverage", "exact_coverage", "usable_agreement", F.col("exact_coverage_interval.low").alias("exact_low"))


@query(
    """WITH p AS (SELECT c_custkey AS id, c_custkey % 6 <> 0 AS geo, c_custkey % 2 = 0 AS ok, c_custkey % 9 = 0 AS legacy FROM customer)
    SELECT 'no_location' AS kind, id, NULL AS detail FROM p WHERE NOT geo UNION ALL SELECT 'unverified_location', id, 'unverified' FROM p WHERE geo AND NOT ok UNION ALL SELECT 'legacy_city', id, 'City ' || id FROM p WHERE legacy
    UNION ALL SELECT 'unparsed_price', o_custkey, o_orderpriority || ': about ' || o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT id FROM p)"""
)
def audit_extracts(t: Tables) -> DataFrame:
    """What people should look at."""
    k = F.col("c_custkey")
    offer = F.struct(F.col("o_orderpriority").alias("label"), F.concat(F.lit("about "), F.col("o_orderkey").cast("string")).alias("text"), F.when(F.col("o_orderstatus") == "P", "unparsed").otherwise("verified").alias("status"))
    listed = t.orders.groupBy("o_custkey").agg(F.collect_list(offer).alias("offers"))
    places = t.customer.join(listed, k == F.col("o_custkey"), "left").select(
        k.alias("id"), (k % 6 != 0).alias("has_geo"), F.when(k % 2 == 0, "verified").otherwise("unverified").alias("verification"), F.concat(F.lit("City "), k.cast("string")).alias("city"),
        F.when(k % 9 == 0, "legacy").otherwise("rule").alias("city_source"), "offers",
    )
    return quality.audit(places)


@query(
    """WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 1 THEN 'Renamed' WHEN c_custkey % 4 = 3 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 2 THEN FALSE ELSE c_custkey % 3 <> 0 END AS publishable, c_custkey % 6 = 0 AS future FROM customer)
    SELECT id, name, publishable FROM p WHERE publishable OR future"""
)
def merged_override_feed(t: Tables) -> DataFrame:
    """Customers under their patches, without those that may not be shown; a patched id has no effect."""
    k = F.col("c_custkey")
    places = t.customer.select(k.alias("id"), F.col("c_name").alias("name"), (k % 3 != 0).alias("publishable"), F.when(k % 6 == 0, "2026").alias("future_opening"))
    entry = F.when(k % 4 == 1, F.create_map(F.lit("name"), F.lit("Renamed"), F.lit("id"), F.lit("0"))).when(k % 4 == 2, F.create_map(F.lit("publishable"), F.lit("false"))).otherwise(F.create_map(F.lit("name"), F.lit(None).cast("string")))
    patches = t.customer.where(k % 4 != 0).select(k.alias("id"), entry.alias("patch"))
    return overlay.merged_feed(places, patches, {"id": "bigint", "name": "string", "publishable": "boolean"}).select("id", "name", "publishable")


@query(
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'zh:-:' || s_name || ':manual' WHEN 1 THEN 'zh:Local:-:-' WHEN 2 THEN '' ELSE 'zh:Local:' || s_name || ':manual' END AS entries FROM supplier"""
)
def localisation_refresh(t: Tables) -> DataFrame:
    """Localised entries without one provider's fields; an entry that had nothing else is gone."""
    k, text = F.col("s_suppkey"), F.lit
    stale = lambda yes: F.when(yes, "amap").otherwise("manual")
    entry = F.struct(text("zh").alias("locale"), text("Local").alias("name"), F.col("s_name").alias("address"), stale(k % 4 % 2 == 0).alias("name_source"), stale((k % 4).isin(1, 2)).alias("address_source"))
    shown = lambda e: F.concat_ws(":", e["locale"], *[F.coalesce(e[f], F.lit("-")) for f in ("name", "address", "address_source")])
    return t.supplier.select("s_suppkey", joined(F.transform(repair.without_sources(F.array(entry), ("amap",)), shown)).alias("entries"))


@query(
    """WITH c AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS city, CASE c_custkey % 4 WHEN 0 THEN 'British Council' WHEN 1 THEN 'IDP' WHEN 2 THEN 'IELTS USA' ELSE 'unknown' END AS op,
        CASE c_custkey % 5 WHEN 0 THEN 'cn' WHEN 1 THEN 'IN' WHEN 2 THEN 'FR' END AS country FROM customer)
    SELECT k, name || ' — IELTS test centre' || coalesce(' in ' || city, '') AS title, name || coalesce(' in ' || city, '') || ': address, test formats, published fees and how to book. Operated by ' || op || '.' AS description,
        CASE WHEN op = 'IELTS USA' THEN 'https://ieltsregistration.registration-ieltsusa.org/ttp' WHEN op = 'British Council' THEN CASE WHEN country = 'cn' THEN 'https://ielts.neea.cn/login' ELSE 'https://ieltsregistration.britishcouncil.org/ttp' END
             WHEN op = 'IDP' THEN CASE country WHEN 'cn' THEN 'https://sign.idpielts.cn/personal-test' WHEN 'IN' THEN 'https://www.ieltsidpindia.com/access/candidatelogin' ELSE 'https://ielts.idp.com/results/check-your-result' END END AS portal,
        CASE k % 4 WHEN 1 THEN 'diamond' WHEN 2 THEN 'square' ELSE 'circle' END AS shape, CASE k % 3 WHEN 0 THEN 'Paper-based' WHEN 1 THEN 'Computer-delivered' ELSE 'Writing on paper' END AS format,
        CASE WHEN k % 7 = 0 THEN 'No map location — use the address below.' WHEN k % 2 = 0 THEN 'Approximate — independent location evidence conflicts.' WHEN k % 3 = 0 THEN 'Approximate — located to the city only.' END AS caveat FROM c"""
)
def place_pages(t: Tables) -> DataFrame:
    """Titles, descriptions, portals and labels of places."""
    k, name = F.col("c_custkey"), F.col("c_name")
    city = F.when(k % 3 != 0, F.col("c_mktsegment"))
    operator = F.when(k % 4 == 0, "British Council").when(k % 4 == 1, "IDP").when(k % 4 == 2, "IELTS USA").otherwise("unknown")
    country = F.when(k % 5 == 0, "cn").when(k % 5 == 1, "IN").when(k % 5 == 2, "FR")
    fmt = F.when(k % 3 == 0, "paper_based").when(k % 3 == 1, "computer_delivered").otherwise("writing_on_paper")
    caveat = display.location_caveat(k % 7 != 0, F.when(k % 2 == 0, "conflicted").otherwise("verified"), F.when(k % 3 == 0, "city").otherwise("street"))
    return t.customer.select(
        k.alias("k"), display.page_title(name, city).alias("title"), display.page_description(name, city, operator).alias("description"), display.result_portal(operator, country).alias("portal"),
        display.operator_shape(operator).alias("shape"), display.format_label(fmt).alias("format"), caveat.alias("caveat"),
    )


@query(
    """SELECT c_custkey, 'https://forms.example.org/new?title=' || replace(url_encode('About ' || c_name), '%20', '+') || '&body=' || replace(url_encode(c_mktsegment || ': é & ü'), '%20', '+') AS report,
        'mailto:desk@example.org?subject=' || url_encode('About ' || c_name) || '&body=' || replace(replace(url_encode('Hello (' || c_mktsegment || ')'), '%28', '('), '%29', ')') AS mail FROM customer"""
)
def report_links(t: Tables) -> DataFrame:
    """Links to a form and to a mail, filled in."""
    about = F.concat(F.lit("About "), F.col("c_name"))
    report = display.report_url("https://forms.example.org/new", about, F.concat(F.col("c_mktsegment"), F.lit(": é & ü")))
    return t.customer.select("c_custkey", report.alias("report"), display.mail_url("desk@example.org", about, F.concat(F.lit("Hello ("), F.col("c_mktsegment"), F.lit(")"))).alias("mail"))


@query(
    """WITH b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND event_id % 2 = 0), a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND event_id % 2 = 1),
    n AS (SELECT count(*) FILTER (b.user_id IS NULL) AS came, count(*) FILTER (a.user_id IS NULL) AS went FROM a FULL JOIN b ON a.user_id = b.user_id) SELECT came, went, came + went > 0 AS changed FROM n"""
)
def discovery_state_change(t: Tables) -> DataFrame:
    """How the pages to remember differ between two runs."""
    crawl = lambda half: t.events.where(F.col("event_id") % 2 == half).select("user_id", F.when(F.col("event_type") == "error", "unresolved_new").otherwise("known").alias("outcome"))
    return quality.state_changed(quality.next_state(crawl(0), "user_id"), quality.next_state(crawl(1), "user_id"), "user_id")


@query(
    """SELECT l_linenumber, l_returnflag, count(*) AS n, count(*) FILTER (CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag <> 'A' AND l_discount > 0 ELSE l_returnflag = 'N' END) AS consistent FROM lineitem GROUP BY ALL"""
)
def price_consistency(t: Tables) -> DataFrame:
    """How many derived prices agree with their status."""
    verified = F.col("l_linenumber") % 2 == 1
    currency = F.when(verified, F.when(F.col("l_returnflag") != "A", "CAD")).when(F.col("l_returnflag") != "N", "CAD")
    price = F.when(verified, F.col("l_discount"))
    fine = numbers.derived_price_consistent(F.lit("CAD 1"), currency, price, F.when(verified, "verified").otherwise("unparsed"))
    return t.lineitem.groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("n"), F.count_if(fine).alias("consistent"))


@query("""SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 200""")
def editor_search(t: Tables) -> DataFrame:
    """The page that an editor sees of the places with a word."""
    places = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("address"), F.col("c_mktsegment").alias("city"), F.col("c_nationkey").alias("country"), F.lit(False).alias("needs_review"))
    return search.administered(places, "  building ").select("id", "name")


_REST = "list_filter(string_split(lower({c}), ' '), lambda w: w <> '' AND w NOT IN (split_part(lower(a.p_name), ' ', 1)))"


@query(
    f"""WITH p AS (SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, list_distinct({_REST.format(c="a.p_name")}) AS x, list_distinct({_REST.format(c="b.p_name")}) AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)
    SELECT a_key, b_key, len(x) = 0 OR len(y) = 0 AS nothing_left, {sql_places("CASE WHEN len(list_intersect(x, y)) >= 2 THEN len(list_intersect(x, y))::DOUBLE / least(len(x), len(y)) ELSE 0.0::DOUBLE END", 6)} AS identity FROM p"""
)
def venue_identity_parts(t: Tables) -> DataFrame:
    """Shared words of the names of parts, without the first word of one, which stands for a city."""
    prepared = {"name": F.col("p_name"), "words": names.words(F.col("p_name")), "city": names.words(F.get(F.split("p_name", " "), F.lit(0)))}

    def score(a, b):
        x, y = names.without(a("words"), a("city")), names.without(b("words"), a("city"))
        return {"nothing_left": (F.size(x) == 0) | (F.size(y) == 0), "identity": numbers.places(names.shared_identity(x, y, a("name"), b("name")), 6)}

    return pairing.within(t.part, ["p_brand", "p_size"], "p_partkey", "p_name", prepared, score, symmetric=False)
