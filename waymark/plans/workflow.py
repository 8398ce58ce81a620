"""Queries of what a run of the directory does around its data: guards, lookups, reports, local names, memory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import overlay, quality, records, reports, search, snapshot
from ..sources import pages
from ..sources.storage import shared_dir
from ..streaming import memory
from . import publication
from .registry import Tables, joined, lat_of, lng_of, query, sql_lat, sql_lng


def _named(t: Tables) -> DataFrame:
    """Suppliers as places with the slugs that were merged into them."""
    k = F.col("s_suppkey")
    slug = lambda n: F.concat(F.lit("s-"), n.cast("string"))
    return t.supplier.select(k.alias("id"), F.col("s_name").alias("name"), slug(k * 2).alias("canonical"), F.when(k % 3 == 0, F.array(slug(k * 2 + 1))).otherwise(F.array().cast("array<string>")).alias("merged_slugs"), (k % 4).cast("string").alias("country"))


@query("""SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey * 2 IN (6, 13, 19, 40) OR (s_suppkey % 3 = 0 AND s_suppkey * 2 + 1 IN (6, 13, 19, 40))""")
def places_by_slug(t: Tables) -> DataFrame:
    """Places looked up by a slug of their own or one that was merged into them."""
    rows = _named(t)
    found = [records.by_slug(rows, f"s-{n}").select("id", "name") for n in (6, 13, 19, 40)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("""SELECT c_custkey AS cluster, s_suppkey AS id, s_name AS name FROM customer JOIN supplier ON s_suppkey = c_custkey // 2 WHERE c_custkey % 2 = 0""")
def cluster_members(t: Tables) -> DataFrame:
    """Clusters and the places that their computed ids name; the others are passed over."""
    k = F.col("cluster")
    clusters = t.customer.select(F.col("c_custkey").alias("cluster"))
    return records.members(clusters, _named(t).select("id", "name"), F.when(k % 2 == 0, F.floor(k / 2))).select("cluster", "id", "name")


@query("""SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 4 = 2""")
def places_in_country(t: Tables) -> DataFrame:
    """The records of one country."""
    return records.in_country(_named(t), "2").select("id")


@query("""SELECT DISTINCT replace(p_name, ' ', '-') AS slug FROM part WHERE p_name <> ''""")
def slug_snapshots(t: Tables) -> DataFrame:
    """Slugs out of a text file that has each of them twice, once with a stray quote."""
    slug = F.replace("p_name", F.lit(" "), F.lit("-"))
    path = f"{shared_dir(t.spark)}/slugs-{uuid.uuid4().hex}"
    t.part.select(F.explode(F.array(slug, F.concat(slug, F.lit('"')))).alias("value")).write.text(path)
    return pages.slug_snapshot(t.spark, path)


@query("""SELECT e.event_id, e.user_id, c_name AS answer FROM events e LEFT JOIN customer ON c_custkey = e.user_id AND c_custkey % 2 = 0""")
def stream_memo_join(t: Tables) -> DataFrame:
    """Streamed requests with the answers that a table already has."""
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    memo = t.customer.select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("user_id"), F.col("c_name").alias("answer"))
    path = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    return memory.drain(t.spark, memory.with_memo(source.select("event_id", "user_id"), memo, ["user_id"]), f"{path}/out", f"{path}/state").select("event_id", "user_id", "answer")


@query(
    """WITH s AS (SELECT c_custkey AS k, 's-' || c_custkey AS slug, c_custkey // 2 AS id, c_name AS name FROM customer), b AS (SELECT k, slug, id FROM s WHERE k % 5 <> 0)
    SELECT slug, id, name FROM s WHERE slug NOT IN (SELECT slug FROM b) AND id IN (SELECT id FROM b)"""
)
def merged_into_existing(t: Tables) -> DataFrame:
    """New pages of places that were known before; two pages make a place, every fifth page is new."""
    k = F.col("c_custkey")
    rows = t.customer.select(F.concat(F.lit("s-"), k.cast("string")).alias("slug"), F.floor(k / 2).alias("id"), F.col("c_name").alias("name"))
    old = k % 5 != 0
    before = t.customer.select(F.when(old, F.concat(F.lit("s-"), k.cast("string"))).alias("slug"), F.when(old, F.floor(k / 2)).alias("id"))
    return quality.merged_into_existing(rows, before)


@query(
    f"""WITH {publication._DELTA}, g AS (SELECT a.country, count(*) FILTER (pin_change = 'lost') - count(*) FILTER (pin_change = 'restored') AS net_pins,
        count(*) FILTER (decision_change = 'regression' AND after = 'quarantined') - count(*) FILTER (decision_change = 'improvement' AND bd.decision = 'quarantined') AS net_quarantines FROM d JOIN ad a USING (id) JOIN bd USING (id) WHERE NOT is_new AND a.country IS NOT NULL GROUP BY a.country),
    n AS (SELECT country, count(*) AS centres FROM bd WHERE id % 17 <> 0 AND country IS NOT NULL GROUP BY country HAVING count(*) >= 10)
    SELECT *, net_pins > greatest(5, ceil(centres * 0.10)) AS too_many_pins, net_quarantines > greatest(3, ceil(centres * 0.05)) AS too_many_quarantines FROM g JOIN n USING (country) WHERE too_many_pins OR too_many_quarantines"""
)
def country_gate(t: Tables) -> DataFrame:
    """Countries in which too many places lost their pin or were quarantined."""
    after, before = publication._baseline_rows(t, 1000, 23), publication._baseline_rows(t, 0, 19).where("id % 17 <> 0")
    deltas = quality.delta(before, after, "id").join(after.select("id", "country"), "id").join(before.select("id", F.col("decision").alias("was")), "id", "left")
    sizes = before.groupBy("country").agg(F.count("*").alias("centres"))
    return quality.country_gate(deltas, sizes).select("country", "net_pins", "net_quarantines", "centres", "too_many_pins", "too_many_quarantines")


@query(
    f"""WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN {sql_lat("o_orderkey")} END AS lat, {sql_lng("o_custkey")} AS lng FROM orders)
    SELECT 'view' AS list, id FROM p WHERE lat BETWEEN -10 AND 40 AND (lng >= 150 OR lng <= -150) UNION ALL SELECT 'search', id FROM p"""
)
def map_lists(t: Tables) -> DataFrame:
    """What the list beside a map shows: what is in view, or whatever a search finds."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 != 0, lat_of("o_orderkey")).alias("lat"), lng_of("o_custkey").alias("lng"))
    view = {"north": 40.0, "south": -10.0, "east": -150.0, "west": 150.0}
    return search.in_view(rows, view).select(F.lit("view").alias("list"), "id").unionByName(search.in_view(rows, view, "hall").select(F.lit("search").alias("list"), "id"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN (n_nationkey * 2 - 20)::DOUBLE END AS lat, CASE WHEN n_nationkey % 4 <> 0 THEN (n_nationkey * 5)::DOUBLE END AS lng, CASE WHEN n_nationkey % 4 <> 0 THEN least(180, n_nationkey * 20)::DOUBLE END AS lat_span, CASE WHEN n_nationkey % 4 <> 0 THEN least(360, n_nationkey * 30)::DOUBLE END AS lng_span FROM nation""")
def search_regions(t: Tables) -> DataFrame:
    """The region in which the places of each country are searched for."""
    k = F.col("n_nationkey").cast("double")
    box = lambda c: F.when(F.col("n_nationkey") % 4 != 0, c)
    region = geo.search_region(box(k * 2 - 20 - k * 10), box(k * 2 - 20 + k * 10), box(k * 5 - k * 15), box(k * 5 + k * 15))
    return t.nation.select("n_nationkey", region.alias("r")).select("n_nationkey", "r.lat", "r.lng", "r.lat_span", "r.lng_span")


@query(
    """WITH h AS (SELECT o_custkey AS id, o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '市雅思考点' WHEN 1 THEN '第一大学' WHEN 2 THEN 'Hall' WHEN 3 THEN '咖啡馆' ELSE '北京IELTS机考中心' END AS name, CASE WHEN o_orderkey % 5 = 1 THEN '科教文化服务;学校;高等院校' ELSE '餐饮' END AS type, (o_orderkey % 7) * 1000 AS dist, (o_orderkey % 3 + 10) || '号' AS no FROM orders),
    g AS (SELECT *, '北京市海淀区' || CASE WHEN k % 4 = 0 THEN '' ELSE '学院路' || no END AS address FROM h WHERE id % 3 <> 2 AND k % 5 IN (0, 1, 4) AND dist <= 5000 AND (id % 2 = 0 OR k % 4 <> 0 AND k % 3 + 10 = id % 4 + 9))
    SELECT id, arg_min(name, k) AS name, arg_min(address, k) AS address FROM g GROUP BY id"""
)
def local_places(t: Tables) -> DataFrame:
    """The Chinese name and address of places, from the first search result that can be the place."""
    o, k = F.col("o_orderkey"), F.col("c_custkey")
    pick = lambda key, *values: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    hits = t.orders.select(
        F.col("o_custkey").alias("id"), o.alias("order"), pick(o, "市雅思考点", "第一大学", " Hall", "咖啡馆", "北京IELTS机考中心").alias("name"), F.when(o % 5 == 1, "科教文化服务;学校;高等院校").otherwise("餐饮").alias("type"), (o % 7 * 1000).alias("distance"),
        F.lit("北京市").alias("province"), F.lit("北京市").alias("city"), F.lit(" 海淀区 ").alias("district"), F.when(o % 4 != 0, F.concat(F.lit("学院路"), (o % 3 + 10).cast("string"), F.lit("号"))).alias("address"),
    )
    places = t.customer.select(k.alias("id"), pick(k, "Beijing University", "IELTS Hall", "Cafe").alias("name"), F.array(F.lit("Building 77"), F.when(k % 2 == 1, F.concat((k % 4 + 9).cast("string"), F.lit(" Xueyuan Lu"))).otherwise("Haidian")).alias("lines"))
    return records.local_place(hits, places)


# -- reports ---------------------------------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'removed' WHEN s_suppkey % 5 = 1 THEN 'changed' WHEN s_suppkey % 5 = 2 THEN 'added' END AS change FROM supplier),
    l AS (SELECT change, id, '- ' || id || CASE WHEN change = 'changed' THEN ': v' ELSE '' END AS text FROM c WHERE change IS NOT NULL QUALIFY row_number() OVER (PARTITION BY change ORDER BY id) <= 50),
    h AS (SELECT change, -1::BIGINT AS id, '## ' || change AS text FROM (SELECT unnest(['added', 'removed', 'changed']) AS change) UNION ALL SELECT * FROM l)
    SELECT row_number() OVER (ORDER BY list_position(['added', 'removed', 'changed'], change), id)::INT AS line, text FROM h"""
)
def difference_report(t: Tables) -> DataFrame:
    """The first keys of each change between two snapshots, as lines for a reviewer."""
    k = F.col("s_suppkey")
    before = t.supplier.select(F.when(k % 5 != 2, k).alias("id"), F.lit(1).alias("v")).where("id IS NOT NULL")
    after = t.supplier.select(F.when(k % 5 != 0, k).alias("id"), F.when(k % 5 == 1, 2).otherwise(1).alias("v")).where("id IS NOT NULL")
    return reports.as_rows(t.spark, snapshot.rendered(snapshot.difference(before, after, "id", ["v"]), "id").split("\n"))


@query(
    """WITH r AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'unchanged' END AS outcome, CASE WHEN c_custkey % 2 = 0 THEN 'a|b' ELSE 'c' END AS reason, c_custkey AS id FROM customer),
    c AS (SELECT outcome, reason, count(*) AS n FROM r GROUP BY ALL), a AS (SELECT id FROM r WHERE outcome = 'accepted' ORDER BY id LIMIT 50),
    l AS (SELECT 1 AS part, 0 AS n, '## Repairs' AS text UNION ALL SELECT 2, 0, '' UNION ALL SELECT 3, 0, '| Outcome | Reason | Number |' UNION ALL SELECT 4, 0, '|---|---|---|'
        UNION ALL SELECT 5, row_number() OVER (ORDER BY outcome, reason), '| ' || outcome || ' | ' || replace(reason, '|', '\\|') || ' | ' || n || ' |' FROM c UNION ALL SELECT 6, 0, '' UNION ALL SELECT 7, 0, '| Place | Changed | Mended |' UNION ALL SELECT 8, 0, '|---|---|---|'
        UNION ALL SELECT 9, id, '| ' || id || ' | city, location | missing_city |' FROM a UNION ALL SELECT 10, 0, '| …and ' || (count(*) - 50) || ' more | | |' FROM r WHERE outcome = 'accepted' HAVING count(*) > 50)
    SELECT row_number() OVER (ORDER BY part, n)::INT AS line, text FROM l"""
)
def repairs_report(t: Tables) -> DataFrame:
    """Repairs by outcome and reason and the first accepted ones, as lines for a reviewer."""
    k = F.col("c_custkey")
    outcome = F.when(k % 3 == 0, "accepted").when(k % 3 == 1, "rejected").otherwise("unchanged")
    names = lambda *values: F.array(*map(F.lit, values))
    attempts = t.customer.select(k.alias("id"), outcome.alias("outcome"), F.when(k % 2 == 0, "a|b").otherwise("c").alias("reason"), names("city", "location").alias("changed"), names("missing_city", "legacy_city").alias("before_issues"), names("legacy_city").alias("after_issues"))
    return reports.as_rows(t.spark, reports.remediation_report(attempts))


# -- overrides and whole differences -----------------------------------------------------------------------------------------------

_EDITS = """e AS (SELECT o_custkey * CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE 1 END AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'DELETE' ELSE 'PUT' END AS method, o_orderkey % 7 AS kind FROM orders),
    j AS (SELECT id, seq, method, kind, c_custkey IS NOT NULL AS there, CASE WHEN method = 'DELETE' OR kind = 0 THEN NULL WHEN kind = 1 THEN 'colour' WHEN kind = 2 THEN 'balance=-5' WHEN kind = 3 THEN 'name=' ELSE 'name=N' || seq END AS p, c_acctbal FROM e LEFT JOIN customer ON c_custkey = id),
    q AS (SELECT *, CASE WHEN method = 'PUT' AND there THEN CASE WHEN kind = 0 THEN 'no patch' WHEN kind = 1 THEN 'unknown:colour' ELSE concat_ws('|', CASE WHEN CASE WHEN kind = 2 THEN -5 ELSE c_acctbal END < 0 THEN 'balance' END, CASE WHEN kind = 3 THEN 'name' END) END ELSE '' END AS problems FROM j),
    a AS (SELECT *, CASE WHEN method = 'DELETE' THEN 204 WHEN NOT there THEN 404 WHEN problems <> '' THEN 400 ELSE 200 END AS status FROM q)"""


def _edited(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    kind = o % 7
    entry = lambda k, v: F.create_map(F.lit(k), v)
    patch = F.when(kind == 1, entry("colour", F.lit("red"))).when(kind == 2, entry("balance", F.lit("-5"))).when(kind == 3, entry("name", F.lit(""))).when(kind > 3, entry("name", F.concat(F.lit("N"), o.cast("string"))))
    edits = t.orders.select((F.col("o_custkey") * F.when(o % 13 == 0, -1).otherwise(1)).alias("id"), o.alias("seq"), F.when(o % 5 == 0, "DELETE").otherwise("PUT").alias("method"), F.when(o % 5 != 0, patch).alias("patch"))
    places = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return overlay.answered(edits, places, {"name": "string", "balance": "double"}, {"balance": F.col("balance") >= 0, "name": F.col("name") != ""})


@query(f"WITH {_EDITS} SELECT id, seq, status, problems FROM a")
def override_edits(t: Tables) -> DataFrame:
    """What each edit of an override comes to."""
    return _edited(t).select("id", "seq", "status", joined(F.col("problems")).alias("problems"))


@query(
    f"""WITH {_EDITS}, l AS (SELECT id, arg_max(method, seq) AS method, arg_max(p, seq) AS p FROM a WHERE status IN (200, 204) GROUP BY id), s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'name=Stored' END AS p FROM customer)
    SELECT coalesce(l.id, s.id) AS id, CASE WHEN l.id IS NULL THEN s.p ELSE l.p END AS patch FROM l FULL JOIN (SELECT * FROM s WHERE p IS NOT NULL) s ON l.id = s.id WHERE l.id IS NULL OR l.method = 'PUT'"""
)
def override_store(t: Tables) -> DataFrame:
    """The stored overrides after all edits."""
    k = F.col("c_custkey")
    stored = t.customer.select(k.alias("id"), F.when(k % 2 == 0, F.create_map(F.lit("name"), F.lit("Stored"))).alias("patch")).where("patch IS NOT NULL")
    after = overlay.stored_after(stored, _edited(t))
    return after.select("id", F.array_join(F.transform(F.map_entries("patch"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("patch"))


_CHANGES = ["name", "operator", "address", "localizations", "city", "postcode", "contact", "price_text", "price", "currency", "formats", "offers", "booking_url", "retake", "retake_only", "location", "place_id", "publishable", "sources"]


@query(
    f"""SELECT c_custkey AS id, CASE c_custkey % 25 WHEN 23 THEN 'added' WHEN 24 THEN 'removed' ELSE CASE WHEN c_custkey % 25 < 19 THEN 'changed' ELSE 'unchanged' END END AS change, CASE WHEN c_custkey % 25 < 19 THEN {_CHANGES}[(c_custkey % 25 + 1)::INT] ELSE '' END AS fields FROM customer"""
)
def place_differences(t: Tables) -> DataFrame:
    """Differences of whole records in one field each, in the order of a list, in digits of no weight, or in none."""
    k = F.col("c_custkey")
    case = k % 25

    def record(new: bool) -> DataFrame:
        turn = lambda i, old, other: F.when((case == i) & F.lit(new), other).otherwise(old)
        text = lambda i, name: turn(i, F.lit(name), F.lit("x")).alias(name)
        listed = lambda i, *values: turn(i, F.array(*map(F.lit, values[::-1] if new else values)), F.array(F.lit("x")))
        offer = lambda price: F.struct(F.lit("l").alias("label"), F.lit("f").alias("format"), F.lit("t").alias("text"), F.lit("CAD").alias("currency"), price.alias("price"), F.lit("verified").alias("status"))
        point = F.struct((F.lit(1.0) + F.when((case == 20) & F.lit(new), 1e-7).otherwise(0.0)).alias("lat"), turn(15, F.lit(2.0), F.lit(2.1)).alias("lng"), F.lit("street").alias("precision"))
        return t.customer.select(
            F.when(case != (24 if new else 23), k).alias("id"), text(0, "name"), text(1, "operator"), F.struct(text(2, "raw"), text(4, "city"), text(5, "postcode")).alias("address"), text(3, "localizations"), F.struct(F.array(text(6, "phone")).alias("phones")).alias("contact"),
            text(7, "price_text"), turn(8, F.lit(1.5), F.lit(2.5)).alias("price"), text(9, "currency"), listed(10, "a", "b").alias("formats"), F.array(offer(turn(11, F.lit(1.0), F.lit(2.0)))).alias("offers"), text(12, "booking_url"), turn(13, F.lit(None).cast("boolean"), F.lit(True)).alias("retake"),
            turn(14, F.lit(False), F.lit(True)).alias("retake_only"), point.alias("geo"), text(16, "place_id"), turn(17, F.lit(True), F.lit(False)).alias("publishable"), F.transform(listed(18, "s", "t"), lambda s: F.struct(s.alias("slug"), F.lit(str(new)).alias("seen_at"))).alias("sources"), F.lit(str(new)).alias("last_seen"),
        ).where("id IS NOT NULL")

    return snapshot.difference(record(False), record(True), "id", snapshot.place_fields()).select("id", "change", joined(F.col("fields")).alias("fields"))
