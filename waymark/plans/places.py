"""Queries over places: resolution of entities and coordinates, search and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, numbers, text
from ..operators import candidates, entities, search
from ..operators.components import components
from .registry import Tables, joined, lat_of, lng_of, query, sql_km, sql_lat, sql_lng, sql_places

# -- entities ------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS component, count(*) OVER (PARTITION BY text) > 1 AS copied FROM documents""")
def dedup_exact_components(t: Tables) -> DataFrame:
    """Documents with equal texts as components of a graph of links to the first copy."""
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))
    links = docs.join(first, "digest").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    named = components(links)
    return docs.join(named, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("component"), F.col("root").isNotNull().alias("copied"))


@query(
    """WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS a, -1 - l_partkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    c(node, root) USING KEY (node) AS (
      SELECT a, min(least(a, b)) FROM e GROUP BY a
      UNION
      SELECT x.node, min(y.root) FROM c y JOIN e ON e.a = y.node JOIN recurring.c x ON x.node = e.b WHERE y.root < x.root GROUP BY x.node)
    SELECT node, root FROM c"""
)
def graph_components(t: Tables) -> DataFrame:
    """Components of a graph of customers and the parts in all of their orders. Parts count from -1 down, as keys can be 0."""
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return components(lines.select(F.col("o_custkey").alias("a"), (-1 - F.col("l_partkey")).alias("b")))


def _pages(t: Tables) -> DataFrame:
    """Suppliers as published pages: several share a slug base, an address or an external id."""
    key = F.col("s_suppkey")
    n = key.cast("string")
    group = F.floor(key / 3).cast("string")
    return t.supplier.select(
        F.concat(F.lit("venue-"), group, F.lit("x-"), n).alias("slug"), F.concat(F.lit("Test Hall "), group, F.when(key % 2 == 0, " East").otherwise(" West")).alias("name"),
        F.when(key % 5 == 0, F.floor(key / 10).cast("string")).alias("external_id"), F.when(key % 7 == 0, "IDP").otherwise("British Council").alias("operator"),
        F.when(key % 7 < 3, "booking_domain").otherwise("slug").alias("operator_source"), F.concat(F.lit("Station Road "), F.floor(key / 6).cast("string")).alias("address"),
        F.concat(F.lit("City "), (F.col("s_nationkey")).cast("string")).alias("city"), F.concat(F.lit("P"), F.floor(key / 6).cast("string")).alias("postcode"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"),
    )


_SQL_PAGES = """p AS (SELECT s_suppkey AS k, 'venue-' || (s_suppkey // 3) || 'x-' || s_suppkey AS slug, 'venue-' || (s_suppkey // 3) || 'x' AS base,
        'hall ' || (s_suppkey // 3) || CASE WHEN s_suppkey % 2 = 0 THEN ' east' ELSE ' west' END AS key, CASE WHEN s_suppkey % 5 = 0 THEN (s_suppkey // 10)::VARCHAR END AS ext, CASE WHEN s_suppkey % 7 = 0 THEN 'IDP' ELSE 'British Council' END AS op,
        s_suppkey % 7 < 3 AS dom, 'station road ' || (s_suppkey // 6) AS addr, 'p' || (s_suppkey // 6) AS pc, 'city ' || s_nationkey AS city FROM supplier)"""
_OK = "NOT coalesce(a.ext <> b.ext, FALSE) AND NOT (a.dom AND b.dom AND a.op <> b.op)"
_NAME = """greatest(1 - levenshtein(a.key, b.key)::DOUBLE / greatest(length(a.key), length(b.key)), len(list_intersect(string_split(a.key, ' '), string_split(b.key, ' ')))::DOUBLE / greatest(len(string_split(a.key, ' ')), len(string_split(b.key, ' '))))"""
_LINKS = f"""l AS (SELECT a.slug AS a, b.slug AS b, 'external_id' AS reason FROM p a JOIN p b ON a.ext = b.ext AND a.slug < b.slug WHERE a.slug = (SELECT min(slug) FROM p c WHERE c.ext = a.ext)
        UNION ALL SELECT a.slug, b.slug, 'slug_base' FROM p a JOIN p b ON a.base = b.base AND a.slug < b.slug WHERE a.slug = (SELECT min(slug) FROM p c WHERE c.base = a.base) AND {_OK}
        UNION ALL SELECT a.slug, b.slug, 'operator_address' FROM p a JOIN p b ON a.addr = b.addr AND a.op = b.op AND a.slug < b.slug WHERE {_OK} AND {_NAME} >= 0.6)"""
_CLUSTERS = """s AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l), r AS (SELECT slug AS x, slug AS y FROM p UNION SELECT r.x, s.y FROM r JOIN s ON r.y = s.x), c AS (SELECT x AS slug, min(y) AS cluster FROM r GROUP BY x)"""


@query(f"WITH {_SQL_PAGES}, {_LINKS} SELECT a, b, reason FROM l")
def entity_links(t: Tables) -> DataFrame:
    """Links between pages by external id, slug base, and operator and address."""
    return entities.links(entities.indexed(_pages(t))).select("a", "b", "reason")


@query(f"WITH RECURSIVE {_SQL_PAGES}, {_LINKS}, {_CLUSTERS} SELECT slug, cluster FROM c")
def entity_clusters(t: Tables) -> DataFrame:
    """The cluster of every page."""
    rows = entities.indexed(_pages(t))
    return entities.clusters(rows, entities.links(rows, every=False))


@query(
    f"""WITH RECURSIVE {_SQL_PAGES}, {_LINKS}, {_CLUSTERS}, q AS (SELECT p.*, cluster FROM p JOIN c USING (slug)), b AS (SELECT *, 'pc:' || pc AS block FROM q UNION ALL SELECT *, 'city:' || city FROM q),
    z AS (SELECT block FROM b GROUP BY block HAVING count(*) BETWEEN 2 AND 400)
    SELECT DISTINCT a.slug AS a, b.slug AS b FROM b a JOIN b b ON a.block = b.block AND a.slug < b.slug AND a.cluster <> b.cluster WHERE a.block IN (FROM z) AND a.pc = b.pc AND {_OK} AND {_NAME} >= 0.8"""
)
def dedup_pending_links(t: Tables) -> DataFrame:
    """Pairs of pages for a reviewer."""
    rows = entities.indexed(_pages(t))
    return entities.pending(rows, entities.clusters(rows, entities.links(rows, every=False))).select("a", "b")


_AT = ("((a.k % 7)::DOUBLE / 10000)", "((b.k % 7)::DOUBLE / 10000)")


@query(
    f"""WITH RECURSIVE {_SQL_PAGES}, {_LINKS}, {_CLUSTERS}, q AS (SELECT p.*, cluster FROM p JOIN c USING (slug)), b AS (SELECT *, 'pc:' || pc AS block FROM q UNION ALL SELECT *, 'city:' || city FROM q),
    z AS (SELECT block FROM b GROUP BY block HAVING count(*) >= 2),
    j AS (SELECT a.slug AS a, b.slug AS b, a.pc = b.pc AND {_NAME} >= 0.8 AS pm, a.k % 4 <> 3 AND b.k % 4 <> 3 AND {sql_km("59::DOUBLE + " + _AT[0], "10::DOUBLE", "59::DOUBLE + " + _AT[1], "10::DOUBLE")} <= 0.15 AND {_NAME} >= 0.75 AS nm
        FROM b a JOIN b b ON a.block = b.block AND a.slug < b.slug AND a.cluster <> b.cluster WHERE a.block IN (FROM z) AND {_OK})
    SELECT DISTINCT a, b, CASE WHEN pm THEN 'name_postcode' ELSE 'name_proximity' END AS reason FROM j WHERE pm OR nm"""
)
def dedup_near_links(t: Tables) -> DataFrame:
    """Pairs of pages for a reviewer, by postcode or by where they lie, from blocks of any size; every fourth page has no coordinates."""
    k = F.regexp_extract("slug", "x-([0-9]+)$", 1).cast("long")
    rows = entities.indexed(_pages(t)).withColumns({"lat": F.when(k % 4 != 3, F.lit(59.0) + (k % 7).cast("double") / 10000), "lng": F.when(k % 4 != 3, F.lit(10.0))})
    return entities.pending(rows, entities.clusters(rows, entities.links(rows, every=False)), (2, None)).select("a", "b", "reason")


@query(
    f"""WITH RECURSIVE {_SQL_PAGES}, b AS (SELECT slug, 'pc:' || pc AS block FROM p UNION ALL SELECT slug, 'city:' || city FROM p) SELECT block, count(*) AS n FROM b GROUP BY block HAVING count(*) > 4"""
)
def dedup_left_out(t: Tables) -> DataFrame:
    """Blocks of more than four pages, which a review with that limit does not compare."""
    rows = entities.indexed(_pages(t))
    return entities.left_out(rows, rows.select("slug", F.col("slug").alias("cluster")), (2, 4))


@query(
    """WITH c AS (SELECT o_custkey, o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 0 END) + (CASE WHEN o_totalprice > 100000 THEN 2 ELSE 0 END) + (CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 0 END) AS score FROM orders)
    SELECT o_custkey, o_orderkey, score FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, length(o_orderkey::VARCHAR), o_orderkey::VARCHAR) = 1"""
)
def pick_canonical(t: Tables) -> DataFrame:
    """The most complete order of each customer, the shorter key first."""
    no = F.lit(False)
    score = entities.completeness(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000, F.lit(0), F.lit(0), no, F.col("o_orderpriority").startswith("1"), F.lit(0))
    rows = t.orders.select("o_custkey", F.col("o_orderkey").cast("string").alias("slug"), "o_orderkey", score.alias("score"))
    return entities.canonical(rows, "o_custkey", "score", "slug").select("o_custkey", "o_orderkey", "score")


@query(
    """WITH o AS (SELECT l_suppkey, l_returnflag, l_linestatus, l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_quantity > 10 THEN l_quantity END AS price FROM lineitem),
    f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus, price ORDER BY k) = 1)
    SELECT l_suppkey, l_returnflag, l_linestatus, price, k FROM f QUALIFY price IS NOT NULL OR NOT bool_or(price IS NOT NULL) OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus)"""
)
def merge_offerings(t: Tables) -> DataFrame:
    """Offers per supplier: equal ones once, unpriced ones only where none is priced."""
    rows = t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("price"))
    return entities.merged_offers(rows, "l_suppkey", ["l_returnflag", "l_linestatus"], "price", "k")


@query(
    """WITH c AS (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '00' ELSE '+' END || '1 555 ' || (c_custkey % 7) AS phone FROM customer),
    k AS (SELECT *, '1555' || (c_custkey % 7) AS id FROM c), f AS (SELECT c_nationkey, id, arg_min(phone, c_custkey) AS phone, min(c_custkey) AS first FROM k GROUP BY c_nationkey, id)
    SELECT c_nationkey, string_agg(phone, '|' ORDER BY first) AS phones FROM f GROUP BY c_nationkey"""
)
def merge_contacts(t: Tables) -> DataFrame:
    """Phones of a nation's customers, each once however it is written, in order."""
    key = F.col("c_custkey")
    rows = t.customer.select("c_nationkey", "c_custkey", F.concat(F.when(key % 2 == 0, "00").otherwise("+"), F.lit("1 555 "), (key % 7).cast("string")).alias("phone"))
    found = entities.merged_values(rows, "c_nationkey", "phone", ["c_custkey"], text.phone_identity)
    return found.select("c_nationkey", joined(F.col("values")).alias("phones"))


@query(
    """SELECT c_custkey, floor(least(CAST(0.2 AS DOUBLE) + CASE WHEN c_custkey % 2 = 0 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN c_acctbal > 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END + 0.1::DOUBLE + 0::DOUBLE + CASE WHEN c_custkey % 3 = 0 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN c_custkey % 5 = 0 THEN 0.05::DOUBLE ELSE 0::DOUBLE END, 1::DOUBLE) * 100 + 0.5::DOUBLE) / 100::DOUBLE AS confidence FROM customer"""
)
def record_confidence(t: Tables) -> DataFrame:
    """Additive confidence of records."""
    key, yes = F.col("c_custkey"), F.lit(True)
    found = entities.confidence(key % 2 == 0, yes, F.col("c_acctbal") > 0, yes, F.lit(0), yes, F.when(key % 3 == 0, 4).otherwise(2), F.when(key % 5 == 0, 2).otherwise(1))
    return t.customer.select("c_custkey", found.alias("confidence"))


# -- coordinates ------------------------------------------------------------------------------------------------------------

_CAND = """c AS (SELECT l_partkey AS entity, l_orderkey * 10 + l_linenumber AS seq, ['embed', 'osm', 'poi', 'admin'][(CASE WHEN l_linenumber = 7 THEN 4 ELSE l_suppkey % 3 + 1 END)::INT] AS path,
        CAST(l_partkey % 50 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 1000 AS lat, CAST(l_partkey % 90 AS DOUBLE) + CAST(l_suppkey % 4 AS DOUBLE) / 100 AS lng, (l_linenumber % 5)::INT AS tier, (l_suppkey % 2)::VARCHAR AS pc,
        CASE WHEN l_suppkey % 11 <> 0 THEN (l_linenumber % 5 + CASE WHEN l_suppkey % 2 = 1 THEN 1 ELSE 0 END)::INT END AS score FROM lineitem)"""


@query(
    f"""WITH {_CAND}, v AS (SELECT * FROM c WHERE score IS NOT NULL), t AS (SELECT entity, seq AS bseq, path AS bpath, score AS bscore FROM v QUALIFY row_number() OVER (PARTITION BY entity ORDER BY score DESC, seq) = 1),
    p AS (SELECT x.entity, x.seq, y.seq AS other, x.path, x.score, least(x.path, y.path) || '|' || greatest(x.path, y.path) AS paths, x.score + y.score AS total, {sql_km("x.lat", "x.lng", "y.lat", "y.lng")} AS gap,
        CASE WHEN x.pc = y.pc AND x.pc = '1' AND x.tier >= 3 AND y.tier >= 3 THEN 0.75 ELSE 0.25 END AS lim FROM v x JOIN v y ON x.entity = y.entity AND x.path <> y.path AND (x.score > y.score OR (x.score = y.score AND x.seq < y.seq))),
    a AS (SELECT * FROM p WHERE gap <= lim QUALIFY row_number() OVER (PARTITION BY entity ORDER BY total DESC, gap, seq, other) = 1), n AS (SELECT p.entity, min(gap) AS nearest FROM p JOIN t USING (entity) WHERE p.seq = bseq OR other = bseq GROUP BY p.entity)
    SELECT t.entity, coalesce(a.seq, bseq) AS seq, coalesce(a.path, bpath) AS path, CASE WHEN coalesce(a.path, bpath) = 'admin' OR a.seq IS NOT NULL THEN 'verified' WHEN nearest > 2 THEN 'conflicted' WHEN nearest IS NOT NULL THEN 'approximate' ELSE 'unverified' END AS verification,
        CASE WHEN coalesce(a.path, bpath) = 'admin' THEN 0.98::DOUBLE WHEN a.seq IS NOT NULL THEN {sql_places("least(1::DOUBLE, 0.55::DOUBLE + 0.08::DOUBLE * a.score)", 2)} WHEN nearest > 2 THEN 0.2::DOUBLE WHEN nearest IS NOT NULL THEN 0.35::DOUBLE ELSE {sql_places("least(0.45::DOUBLE, 0.2::DOUBLE + 0.05::DOUBLE * bscore)", 2)} END AS confidence,
        CASE WHEN coalesce(a.path, bpath) = 'admin' THEN 'admin' WHEN a.seq IS NOT NULL THEN a.paths ELSE bpath END AS paths
    FROM t LEFT JOIN a USING (entity) LEFT JOIN n USING (entity)"""
)
def resolve_geo_candidates(t: Tables) -> DataFrame:
    """Verification of parts' coordinates from the candidates that their order lines propose."""
    n, s, p = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    path = F.when(n == 7, "admin").otherwise(F.element_at(F.array(*map(F.lit, ("embed", "osm", "poi"))), (s % 3 + 1).cast("int")))
    rows = t.lineitem.select(
        p.alias("entity"), (F.col("l_orderkey") * 10 + n).alias("seq"), path.alias("path"), ((p % 50).cast("double") + n.cast("double") / 1000).alias("lat"), ((p % 90).cast("double") + (s % 4).cast("double") / 100).alias("lng"),
        (n % 5).cast("int").alias("tier"), (s % 2).cast("string").alias("postcode"), F.lit("1").alias("want_postcode"), F.when(s % 11 != 0, n % 5 + F.when(s % 2 == 1, 1).otherwise(0)).alias("score"),
    )
    return candidates.resolve(rows).select("entity", "seq", "path", "verification", "confidence", joined(F.col("paths")).alias("paths"))


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN NULL ELSE [4, 3, 2, 0][(s_suppkey % 4 + 1)::INT] + CASE WHEN s_suppkey % 3 = 1 THEN 1 ELSE 0 END + s_suppkey % 2 END AS score FROM supplier"""
)
def candidate_scores(t: Tables) -> DataFrame:
    """Scores of candidates whose postcode, city or country agree or not; null rejects."""
    k = F.col("s_suppkey")
    precision = F.element_at(F.array(*map(F.lit, ("rooftop", "street", "postcode", "country"))), (k % 4 + 1).cast("int"))
    postcode = F.when(k % 3 == 0, "K1A 0B1").when(k % 3 == 1, "M5V 2T6")
    score = geo.candidate_score(precision, postcode, F.when(k % 2 == 1, "TORONTO").otherwise("Oakville"), F.when(k % 7 == 0, "US").otherwise("ca"), F.lit("M5V2T6"), F.lit("Toronto"), F.lit("CA"))
    return t.supplier.select("s_suppkey", score.cast("long").alias("score"))


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT DISTINCT user_id, event_type FROM c WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.user_id AND e.event_type = c.event_type AND e.event_id % 2 = 0)"""
)
def lookup_memo_misses(t: Tables) -> DataFrame:
    """Requests that a table of earlier answers does not hold."""
    requests = t.events.where("event_type <> 'error'").select("user_id", "event_type")
    return candidates.missing_lookups(requests, t.events.where("event_id % 2 = 0").select("user_id", "event_type"), ["user_id", "event_type"])


@query("""SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= CASE event_type WHEN 'click' THEN 100 WHEN 'view' THEN 50 ELSE 0 END AS allowed FROM events""")
def provider_budgets(t: Tables) -> DataFrame:
    """Which requests keep within their provider's budget."""
    budgets = t.spark.createDataFrame([("click", 100), ("view", 50)], "provider string, n int")
    return candidates.rationed(t.events, "event_type", ["ts", "event_id"], budgets).select("event_id", "event_type", "allowed")


@query(
    """WITH b AS (SELECT event_id, event_type, event_id % 4 AS n, coalesce(sum(event_id % 4) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, CASE event_type WHEN 'click' THEN 1000 WHEN 'view' THEN 2500 ELSE 0 END AS budget FROM events)
    SELECT event_id, event_type, before, greatest(0, least(budget - before, n))::BIGINT AS paid FROM b"""
)
def attempt_budgets(t: Tables) -> DataFrame:
    """How many of each request's attempts its provider's budget covers."""
    budgets = t.spark.createDataFrame([("click", 1000), ("view", 2500)], "provider string, n int")
    rows = t.events.select("event_id", "event_type", "ts", (F.col("event_id") % 4).alias("n"))
    return candidates.charged(rows, "event_type", "n", ["ts", "event_id"], budgets).select("event_id", "event_type", "before", "paid")


# -- search --------------------------------------------------------------------------------------------------------------------


def places(t: Tables) -> DataFrame:
    """Orders as places, their lines as nested offers."""
    offer = F.struct(
        F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "A", "academic").when(F.col("l_returnflag") == "N", "general_training").otherwise("ukvi").alias("kind"), F.col("l_returnflag").alias("module"), F.col("l_linestatus").alias("category"),
        F.when(F.col("l_linenumber") % 3 == 0, "paper").when(F.col("l_linenumber") % 3 == 1, "computer").alias("mode"), F.lit("computer_delivered").alias("format"), F.lit("priced").alias("text"), F.lit("USD").alias("currency"), F.col("l_extendedprice").alias("price"), F.lit("verified").alias("status"),
    )
    offers = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(offer)).alias("offers"))
    people = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "c_mktsegment")
    rows = t.orders.join(offers, F.col("o_orderkey") == F.col("l_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    return rows.select(
        key.alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("country"), F.concat(F.lit("City "), (F.col("o_custkey") % 40).cast("string")).alias("city"), F.col("c_mktsegment").alias("operator"), F.array(F.lit("computer_delivered")).alias("formats"),
        (F.col("o_orderpriority") == "1-URGENT").alias("retake"), F.lit(False).alias("retake_only"), (F.col("o_orderstatus") != "P").alias("visible"), search.haystack(F.col("c_name"), F.col("n_name"), F.col("c_mktsegment")).alias("haystack"),
        lat_of("o_custkey").alias("lat"), lng_of("o_custkey").alias("lng"), (key % 2 == 0).alias("pinnable"), "offers",
    )


_BASE = "FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P'"


@query(f"""SELECT o_orderkey AS id, count(*) AS n_offers, min(l_extendedprice) AS price {_BASE} AND l_returnflag IN ('A', 'R') AND l_linestatus = 'F' AND l_linenumber % 3 = 0 GROUP BY o_orderkey HAVING min(l_extendedprice) <= 20000""")
def filter_nested_and(t: Tables) -> DataFrame:
    """Places with one offer that meets all conditions at once, and what such offers cost at least."""
    ask = search.Search(modules=("A", "R"), categories=("F",), modes=("paper",), max_price=20000)
    return search.search(places(t), ask).select("id", F.size("offers").cast("long").alias("n_offers"), "price")


@query("SELECT 0 AS n, 15 AS operators WHERE FALSE UNION ALL SELECT 0, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))")
def filter_empty_list(t: Tables) -> DataFrame:
    """An empty list of offer kinds matches nothing, an empty list of operators everything."""
    base = places(t)
    nothing, everything = search.search(base, search.Search(kinds=())), search.search(base, search.Search(operators=()))
    both = nothing.select(F.lit(True).alias("none")).unionByName(everything.select(F.lit(False).alias("none")))
    return both.agg(F.count_if("none").cast("int").alias("n"), F.count_if(~F.col("none")).alias("operators"))


@query(f"""SELECT DISTINCT o_orderkey AS id {_BASE} AND regexp_replace(lower(c_name || ' ' || n_name || ' ' || c_mktsegment), '[^a-z0-9]+', ' ', 'g') LIKE '%nation 3 build%'""")
def filter_text(t: Tables) -> DataFrame:
    """Places whose normalised text has the words in order."""
    return search.search(places(t), search.Search(words="Nation_3  Build")).select("id")


@query(f"""SELECT DISTINCT o_orderkey AS id, {sql_places(sql_km("CAST(10 AS DOUBLE)", "CAST(20 AS DOUBLE)", sql_lat("o_custkey"), sql_lng("o_custkey")), 6)} AS km {_BASE} AND o_orderkey % 2 = 0 AND {sql_km("CAST(10 AS DOUBLE)", "CAST(20 AS DOUBLE)", sql_lat("o_custkey"), sql_lng("o_custkey"))} <= 1500""")
def filter_radius(t: Tables) -> DataFrame:
    """Pinnable places within 1,500 km."""
    found = search.search(places(t), search.Search(near=(10.0, 20.0), within_km=1500))
    return found.select("id", numbers.places(F.col("distance_km"), 6).alias("km"))


@query(f"""SELECT 'City ' || (o_custkey % 40) AS value, count(DISTINCT o_orderkey) AS n {_BASE} GROUP BY 1""")
def facets_city(t: Tables) -> DataFrame:
    """Visible places per city."""
    return search.facet(search.search(places(t), search.Search()), "city")


@query(
    f"""WITH u AS (SELECT c_mktsegment AS value, count(DISTINCT o_orderkey) AS universe {_BASE} GROUP BY 1), f AS (SELECT c_mktsegment AS value, count(DISTINCT o_orderkey) AS n {_BASE} AND n_name = 'NATION_3' AND l_returnflag = 'R' GROUP BY 1)
    SELECT value, coalesce(n, 0) AS n, universe FROM u LEFT JOIN f USING (value)"""
)
def facets_operator_neutral(t: Tables) -> DataFrame:
    """Operators counted under all filters but their own."""
    return search.neutral_facet(places(t), search.Search(country="nation_3", modules=("R",), operators=("BUILDING",)))


@query(f"""SELECT l_returnflag AS value, count(DISTINCT o_orderkey) AS n {_BASE} GROUP BY 1""")
def facets_distinct_entity(t: Tables) -> DataFrame:
    """Places with an offer of each module, each counted once."""
    return search.offer_facet(search.search(places(t), search.Search()), "module")


@query("""SELECT l_suppkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), '|') AS currencies, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN ceil(max(l_extendedprice))::BIGINT END AS ceiling FROM lineitem GROUP BY l_suppkey""")
def currency_set_guard(t: Tables) -> DataFrame:
    """Currencies per supplier, and the price ceiling where there is one currency."""
    many = F.sort_array(F.collect_set("l_returnflag"))
    found = t.lineitem.groupBy("l_suppkey").agg(many.alias("c"), F.max("l_extendedprice").alias("top"))
    return found.select("l_suppkey", joined(F.col("c")).alias("currencies"), F.when(F.size("c") == 1, F.ceil("top")).alias("ceiling"))


@query("""SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS price FROM customer ORDER BY price ASC NULLS LAST, name, id LIMIT 40""")
def sort_nulls_last_topk(t: Tables) -> DataFrame:
    """The forty cheapest, unknown prices last."""
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("price"))
    return search.ordered(rows, "price").limit(40)


@query("""SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5""")
def topk_per_group(t: Tables) -> DataFrame:
    """The five longest documents of each language."""
    order: Column = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return t.documents.select("lang", "doc_id", "n_chars", order.cast("long").alias("rank")).where("rank <= 5")
