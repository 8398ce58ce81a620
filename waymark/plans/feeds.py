"""Queries of sources and sinks: sitemaps, listings, envelopes, map feeds, features, flags of names and addresses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, html, names, providers
from ..operators import search
from ..sources import pages, sinks
from ..sources.storage import materialise, shared_dir
from ..streaming import memory
from . import places as place_plans
from .registry import Tables, lat_of, lng_of, query, sql_lat, sql_lng


def _text(key: str) -> F.Column:
    return F.col(key).cast("string")


@query("""WITH l AS (SELECT p_partkey // 100 AS page, CASE WHEN p_partkey % 10 < 7 THEN 's-' || (p_partkey % 150) END AS slug FROM part) SELECT slug, min(page) AS page FROM l WHERE slug IS NOT NULL GROUP BY slug""")
def sitemap_pages(t: Tables) -> DataFrame:
    """Slugs of sitemaps of a hundred addresses each, with the first page that lists them."""
    k = F.col("p_partkey")
    where = F.when(k % 10 < 7, F.concat(F.lit("/test-centres/s-"), (k % 150).cast("string"), F.lit("/?x=1"))).otherwise(F.concat(F.lit("/news/"), _text("p_partkey")))
    loc = F.concat(F.lit("<url><loc> https://example.org"), where, F.lit("</loc></url>"))
    sitemaps = t.part.groupBy(F.floor(k / 100).alias("page")).agg(F.array_join(F.sort_array(F.collect_list(loc)), "\n").alias("xml"))
    return pages.all_listed(pages.sitemap_slugs(sitemaps, "/test-centres")).select("slug", "page")


@query("""WITH l AS (SELECT c_nationkey AS n, c_custkey % 40 AS s FROM customer) SELECT 'v ' || s AS slug, 'N' || min(n) AS country FROM l GROUP BY s""")
def listing_countries(t: Tables) -> DataFrame:
    """The first country whose listing links to each place."""
    link = F.concat(F.lit('<a class="x" href="/test-centres/v%20'), (F.col("c_custkey") % 40).cast("string"), F.lit('?tab=1">more</a>'))
    listings = t.customer.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list(link)), "").alias("html")).select(F.concat(F.lit("N"), _text("c_nationkey")).alias("country"), F.col("c_nationkey").alias("ordinal"), "html")
    return pages.listed_countries(listings, "/test-centres/")


@query("""WITH c AS (SELECT DISTINCT p_size AS n FROM part) SELECT chr((97 + n // 26)::INT) || chr((97 + n % 26)::INT) || 'x' AS code FROM c""")
def listing_codes(t: Tables) -> DataFrame:
    """The countries that a listing page offers; it must name at least twenty here."""
    n = F.col("p_size")
    letter = lambda c: F.char(97 + c)
    option = F.concat(F.lit('<option value="'), F.upper(F.concat(letter(F.floor(n / 26)), letter(n % 26), F.lit("x"))), F.lit('">x</option>'))
    page = t.part.select(option.alias("o")).distinct().agg(F.array_join(F.sort_array(F.collect_list("o")), "").alias("o"))
    return pages.known_countries(page.select(F.concat(F.lit("<select><option value='City'>x</option></select><select id=country>"), "o", F.lit("</select>")).alias("html")), least=20)


@query("""SELECT c_custkey AS id, c_name AS name FROM customer""")
def versioned_envelope(t: Tables) -> DataFrame:
    """What a JSON envelope of the right version holds; one of another version is as good as none."""
    path = f"{shared_dir(t.spark)}/envelope-{uuid.uuid4().hex}"
    each = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    lines = t.customer.groupBy(F.floor(F.col("c_custkey") / 50).alias("b")).agg(F.array_join(F.collect_list(each), ",\n").alias("items"))
    lines.select(F.concat(F.lit('{"version": 3,\n "items": ['), "items", F.lit("]}")).alias("value")).repartition("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    schema = "version int, items array<struct<id:long,name:string>>"
    if pages.versioned(t.spark, path, schema, 4) is not None:
        raise ValueError("an envelope of another version was read")
    return pages.versioned(t.spark, path, schema, 3, strict=True).select(F.inline("items"))


@query("""SELECT c_custkey AS id, '{"id":' || c_custkey || ',"name":"' || c_name || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"segment":"' || c_mktsegment || '"' ELSE '' END || '}' AS json FROM customer""")
def place_feed(t: Tables) -> DataFrame:
    """Each place as a JSON object; what is unknown is left out."""
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    return sinks.feed(rows, "id", "name", "segment")


_STATUS = "['displayable', 'suppressed', 'missing'][(s_suppkey % 3 + 1)::INT]"


def _shown(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    status = F.element_at(F.array(*map(F.lit, ("displayable", "suppressed", "missing"))), (k % 3 + 1).cast("int"))
    return t.supplier.select(k.alias("id"), F.concat(F.lit("p"), _text("s_suppkey")).alias("provider_id"), status.alias("status"), F.when(status != "missing", lat_of("s_suppkey")).alias("lat"), F.when(status != "missing", lng_of("s_suppkey")).alias("lng"))


@query(f"""SELECT s_suppkey AS id, {_STATUS} AS status, CASE WHEN s_suppkey % 3 = 0 THEN {sql_lat("s_suppkey")} END AS lat, CASE WHEN s_suppkey % 3 = 0 THEN {sql_lng("s_suppkey")} END AS lng FROM supplier""")
def map_feed(t: Tables) -> DataFrame:
    """Places as a map may show them: no provider's ids, coordinates only where the policy allows."""
    return sinks.for_map(_shown(t))


@query("""SELECT count(*) FILTER (s_suppkey % 3 = 0) AS displayable, count(*) FILTER (s_suppkey % 3 = 1) AS suppressed, count(*) FILTER (s_suppkey % 3 = 2) AS missing FROM supplier""")
def map_totals(t: Tables) -> DataFrame:
    """How many places a map shows, keeps back, or lacks coordinates for."""
    return sinks.map_summary(_shown(t))


@query(f"""SELECT min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east FROM (SELECT {sql_lat("o_orderkey")} AS lat, {sql_lng("o_custkey")} AS lng FROM orders)""")
def map_box(t: Tables) -> DataFrame:
    """The box of all points."""
    return sinks.bounding_box(t.orders.select(lat_of("o_orderkey").alias("lat"), lng_of("o_custkey").alias("lng")))


_FEATURE = """'{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (c_custkey % 180) || '.5,' || (c_custkey % 90) || '.0]},"properties":{"id":' || c_custkey || ',"name":"' || c_name || '"}}'"""


def _features(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    feature = sinks.point((k % 180).cast("double") + 0.5, (k % 90).cast("double"), id=k, name=F.col("c_name"))
    return t.customer.select(k.alias("id"), F.col("c_nationkey").alias("country"), feature.alias("feature"))


@query(f"SELECT c_custkey AS id, {_FEATURE} AS feature FROM customer")
def map_features(t: Tables) -> DataFrame:
    """Each place as a GeoJSON feature."""
    return _features(t).select("id", "feature")


@query(f"""SELECT c_nationkey AS country, '{{"type":"FeatureCollection","features":[' || string_agg({_FEATURE}, ',' ORDER BY c_custkey) || ']}}' AS json FROM customer GROUP BY 1""")
def map_collections(t: Tables) -> DataFrame:
    """The features of each country as one collection."""
    return sinks.collections(_features(t), "country", "id")


@query(
    """WITH k AS (SELECT page_id AS k FROM pages) SELECT k AS page_id, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 0 - (k % 80)::DOUBLE - 2.25::DOUBLE ELSE (k % 80)::DOUBLE + 2.25::DOUBLE END AS lat, CASE WHEN k % 5 = 0 THEN NULL ELSE (k % 170)::DOUBLE END AS lng FROM k"""
)
def static_map_points(t: Tables) -> DataFrame:
    """The points of static maps in pages; placeholders and impossible ones are none."""
    k = F.col("page_id")
    whole = lambda n: (k % n).cast("string")
    lat = F.when(k % 5 == 0, "91.5").when(k % 5 == 1, F.concat(F.lit("-"), (k % 80 + 2).cast("string"), F.lit(".25"))).otherwise(F.concat((k % 80 + 2).cast("string"), F.lit(".25")))
    page = F.concat("html", F.lit('<img src="https://maps/staticmap?zoom=3&amp;center='), lat, F.lit(","), whole(170), F.lit('&amp;x">'))
    return t.pages.select("page_id", html.map_centre(page).alias("p")).select("page_id", "p.lat", "p.lng")


@query(
    """SELECT c_custkey AS id, 'hall ' || c_custkey AS bare, c_custkey % 4 = 0 AND c_custkey <> 0 AS rooms_conflict, c_custkey % 3 = 1 AS same_place, '北京市海淀区' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_custkey || '号' END AS address, c_custkey % 5 = 0 AS pinnable FROM customer"""
)
def venue_flags(t: Tables) -> DataFrame:
    """Names without their place, rooms that contradict each other, equal local places, joined addresses and places that may be pinned."""
    k, key = F.col("c_custkey"), _text("c_custkey")
    none = F.lit(None).cast("string")
    bare = names.without_location(F.concat(F.lit("Hall "), key, F.lit(", Oslo NORWAY 0150")), F.lit("Oslo"), none, F.lit("0150"), F.lit("Norway"))
    rooms = names.subpremises_conflict(F.concat(F.lit("Suite "), key), F.when(k % 4 == 0, "unit #0").when(k % 4 == 1, F.concat(F.lit("Room "), key)).otherwise(F.lit("12 King Street")))
    local = names.same_local_place(F.lit("北京·教育考试院"), F.when(k % 3 == 0, "北京").when(k % 3 == 1, "教育考试院").otherwise(none))
    address = providers.joined_once(F.array(F.lit("北京市"), F.lit("北京"), none, F.lit("海淀区"), F.when(k % 2 == 1, F.concat(key, F.lit("号"))).otherwise("")))
    pin = geo.pinnable(F.when(k % 5 < 3, "verified").otherwise("approximate"), F.when(k % 5 == 1, "city").otherwise("street"), F.when(k % 5 == 2, 0.4).otherwise(0.5))
    return t.customer.select(k.alias("id"), bare.alias("bare"), rooms.alias("rooms_conflict"), local.alias("same_place"), address.alias("address"), pin.alias("pinnable"))


@query(f"""SELECT o_orderkey AS id, count(*) AS n_offers {place_plans._BASE} AND l_linenumber % 3 = 1 AND l_returnflag IS NOT NULL AND CASE l_returnflag WHEN 'A' THEN 'academic' WHEN 'N' THEN 'general_training' ELSE 'ukvi' END = 'ukvi' GROUP BY o_orderkey""")
def search_of_a_url(t: Tables) -> DataFrame:
    """Places and offers that the query of an old link asks for; what it does not know is passed over."""
    ask = search.from_query("?test=ukvi&test=nonsense&delivery=computer&delivery=carrier-pigeon")
    found = search.search(place_plans.places(t), ask)
    return found.select("id", F.size("offers").cast("long").alias("n_offers"))


@query("""SELECT DISTINCT user_id FROM events""")
def first_sightings(t: Tables) -> DataFrame:
    """Users as a stream first sees them, each once."""
    files = materialise(t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).repartition(3, "user_id"), "events")
    source = t.spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(files._written_to)
    path = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    return memory.drain(t.spark, memory.first_seen(source, "user_id", "ts", "4000 days"), f"{path}/out", f"{path}/state").select("user_id")
