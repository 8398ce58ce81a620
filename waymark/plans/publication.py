"""Queries over snapshots, quality, repair, matching and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maps, text
from ..functions.numbers import places as rounded
from ..operators import matching, overlay, pairing, quality, repair, snapshot
from .registry import Tables, joined, lat_of, lng_of, query, sql_km, sql_lat, sql_lng, sql_places

# -- snapshots -------------------------------------------------------------------------------------------------------------


def _before(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey % 10 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _after(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    rows = t.orders.where("o_orderkey % 100 <> 7")
    return rows.select("o_orderkey", F.when(key % 5 == 1, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_totalprice") + F.when(key % 7 == 2, 1.0).otherwise(0.0)).alias("o_totalprice"), F.when(key % 11 != 3, F.col("o_orderpriority")).alias("o_orderpriority"))


_DIFF = """b AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 0), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 7 = 2 THEN 1 ELSE 0 END AS o_totalprice, CASE WHEN o_orderkey % 11 <> 3 THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 100 <> 7),
    j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, b.o_orderkey IS NULL AS added, a.o_orderkey IS NULL AS removed, concat_ws('|', CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'status' END, CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'price' END, CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'priority' END) AS f FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey),
    d AS (SELECT o_orderkey, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN f <> '' THEN 'changed' ELSE 'unchanged' END AS change, CASE WHEN added OR removed THEN '' ELSE f END AS fields FROM j)"""


def _difference(t: Tables) -> DataFrame:
    fields = {"status": F.col("o_orderstatus"), "price": F.col("o_totalprice"), "priority": F.col("o_orderpriority")}
    return snapshot.difference(_before(t), _after(t), "o_orderkey", fields)


@query(f"WITH {_DIFF} SELECT o_orderkey, change, fields FROM d")
def snapshot_diff_fields(t: Tables) -> DataFrame:
    """What became of each order, and which of its fields differ."""
    return _difference(t).select("o_orderkey", "change", joined(F.col("fields")).alias("fields"))


@query(
    f"""WITH {_DIFF}, c AS (SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change <> 'added') AS previous FROM d)
    SELECT *, added + removed + changed > 0 AS meaningful, previous > 0 AND removed > greatest(25, ceil(previous * 0.05)) AS too_many_removed, previous > 0 AND added > greatest(100, ceil(previous * 0.1)) AS too_many_added FROM c"""
)
def diff_safety_gate(t: Tables) -> DataFrame:
    """Counts of the difference, and whether it is safe to publish."""
    return snapshot.summary(_difference(t))


@query("""SELECT a.o_orderkey, coalesce(b.o_orderdate, a.o_orderdate) AS seen FROM orders a LEFT JOIN (SELECT o_orderkey, o_orderdate - INTERVAL 30 DAY AS o_orderdate FROM orders WHERE o_orderkey % 3 = 0) b USING (o_orderkey)""")
def first_seen_carried(t: Tables) -> DataFrame:
    """First sightings carried on from the snapshot before."""
    now = t.orders.select("o_orderkey", F.col("o_orderdate").alias("seen"))
    before = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("seen"))
    return snapshot.carried_first_seen(now, before, "o_orderkey", "seen")


@query(
    """SELECT 'status' AS dimension, string_agg(o_orderstatus || '=' || n, '|' ORDER BY o_orderstatus) AS counts, sum(n)::BIGINT AS total FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
    UNION ALL SELECT 'priority', string_agg(p || '=' || n, '|' ORDER BY p), sum(n)::BIGINT FROM (SELECT coalesce(o_orderpriority, 'none') AS p, count(*) AS n FROM orders GROUP BY 1)"""
)
def dataset_stats_maps(t: Tables) -> DataFrame:
    """Totals of a data set as maps, in text form."""
    return maps.tallies(t.orders, {"status": "o_orderstatus", "priority": "o_orderpriority"}).withColumn("counts", maps.as_text(F.col("counts")))


# -- quality ---------------------------------------------------------------------------------------------------------------


def _places(t: Tables, cut: float) -> DataFrame:
    """Customers as places whose facts follow from their keys; `cut` is the balance below which there are no offers."""
    k, yes, no = F.col("c_custkey"), F.lit(True), F.lit(False)
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("id"), F.when(k % 97 != 0, F.col("c_name")).otherwise(" ").alias("name"), F.lit("1 Main Street").alias("address"), F.when(k % 89 == 0, 0).otherwise(2).alias("address_lines"), F.when(k % 83 != 0, F.col("n_name")).alias("country"),
        F.when(k % 4 != 0, "City").alias("city"), F.when(k % 10 == 1, "legacy").otherwise("rule").alias("city_source"), F.lit(1).alias("n_sources"), F.when(k % 5 == 0, "unknown").otherwise("IDP").alias("operator"), F.when(k % 3 == 0, "slug").otherwise("booking_domain").alias("operator_source"),
        F.when(k % 6 != 0, "u").alias("booking_url"), (k % 31 == 0).alias("retake_only"), F.when(F.col("c_acctbal") < cut, 0).otherwise(3).alias("n_offers"), F.lit(1).alias("n_priced"), F.when(k % 12 == 0, 1).otherwise(0).alias("n_unparsed"),
        F.lit(1).alias("n_currencies"), F.lit(0).alias("n_unclassified"), no.alias("bad_price"), (k % 41 == 0).alias("pending"), F.when(k % 9 == 0, 0).otherwise(1).alias("n_contacts"), (k % 8 != 0).alias("has_geo"), (k % 50 == 3).alias("outside"),
        (k % 7 != 0).alias("verified"), (k % 13 == 0).alias("admin"), F.when(k % 11 == 0, 1).otherwise(2).alias("n_paths"), F.lit(0.1).alias("agreement_km"), F.when(k % 14 == 1, 2).otherwise(4).alias("tier"), yes.alias("publishable"),
    )


_GEO = "k % 8 <> 0"
_ISSUES = [
    ("missing_name", "error", "quarantine_centre", "k % 97 = 0"), ("missing_address", "error", "quarantine_centre", "k % 89 = 0"), ("missing_country", "error", "quarantine_centre", "k % 83 = 0"), ("unknown_operator", "warning", "review", "k % 5 = 0"),
    ("operator_not_domain_verified", "warning", "review", "k % 5 <> 0 AND k % 3 = 0"), ("missing_booking_url", "warning", "review", "k % 6 = 0 AND k % 31 <> 0"), ("missing_city", "warning", "review", "k % 4 = 0"), ("legacy_city", "warning", "review", "k % 4 <> 0 AND k % 10 = 1"),
    ("osr_only_centre", "info", "none", "k % 31 = 0"), ("no_offerings", "error", "quarantine_centre", "bal < {cut} AND k % 31 <> 0"), ("unparsed_price", "warning", "review", "k % 12 = 0"), ("missing_contact_information", "info", "none", "k % 9 = 0"),
    ("pending_duplicate_candidate", "warning", "review", "k % 41 = 0"), ("missing_location", "warning", "suppress_location", "k % 8 = 0"), ("location_outside_country", "error", "suppress_location", f"{_GEO} AND k % 50 = 3"),
    ("location_not_independently_corroborated", "error", "suppress_location", f"{_GEO} AND k % 7 <> 0 AND k % 13 <> 0 AND k % 11 = 0"), ("location_not_verified", "warning", "suppress_location", f"{_GEO} AND k % 7 = 0"), ("location_too_coarse", "warning", "suppress_location", f"{_GEO} AND k % 7 <> 0 AND k % 14 = 1"),
]


def _sql_issues(name: str, cut: str) -> str:
    rules = " UNION ALL ".join(f"SELECT id, country, '{c}' AS code, '{s}' AS severity, '{a}' AS action FROM {name}c WHERE {w.format(cut=cut)}" for c, s, a, w in _ISSUES)
    return f"""{name}c AS (SELECT c_custkey AS id, c_custkey AS k, c_acctbal AS bal, CASE WHEN c_custkey % 83 <> 0 THEN n_name END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey), {name}i AS ({rules}),
    {name}d AS (SELECT c.id, any_value(c.k) AS k, any_value(c.country) AS country, CASE WHEN bool_or(coalesce(action = 'quarantine_centre', FALSE)) THEN 'quarantined' WHEN bool_or(coalesce(severity <> 'info', FALSE)) THEN 'needs_review' ELSE 'ready' END AS decision,
        coalesce(list_sort(list(code || ':' || severity) FILTER (code IS NOT NULL)), []) AS tokens FROM {name}c c LEFT JOIN {name}i i ON c.id = i.id GROUP BY c.id)"""


@query(f"WITH {_sql_issues('a', '0')} SELECT id, code, severity, action FROM ai")
def quality_issues(t: Tables) -> DataFrame:
    """The issues of every place."""
    return quality.exploded(quality.analysed(_places(t, 0)), "id")


@query(
    f"""WITH {_sql_issues("a", "0")}, n AS (SELECT coalesce(country, 'UNASSIGNED') AS country, code, count(*) AS n FROM ai GROUP BY ALL), m AS (SELECT country, string_agg(code || '=' || n, '|' ORDER BY code) AS codes FROM n GROUP BY country),
    v AS (SELECT coalesce(country, 'UNASSIGNED') AS country, 'error=' || count(*) FILTER (severity = 'error') || '|info=' || count(*) FILTER (severity = 'info') || '|warning=' || count(*) FILTER (severity = 'warning') AS severities FROM ai GROUP BY 1),
    g AS (SELECT coalesce(country, 'UNASSIGNED') AS country, count(*) AS centres, count(*) FILTER (decision = 'ready') AS ready, count(*) FILTER (decision = 'needs_review') AS needs_review, count(*) FILTER (decision = 'quarantined') AS quarantined, count(*) FILTER (k % 8 <> 0 AND k % 7 <> 0) AS pinnable FROM ad GROUP BY 1)
    SELECT g.*, codes, severities FROM g LEFT JOIN m USING (country) LEFT JOIN v USING (country)"""
)
def quality_decision_by_nation(t: Tables) -> DataFrame:
    """The baseline of each country: decisions, pins, and issues by code and severity."""
    return _baselines(t, 0).withColumns({c: maps.as_text(F.col(c)) for c in ("codes", "severities")})


def _baselines(t: Tables, cut: float) -> DataFrame:
    return quality.baseline(quality.analysed(_places(t, cut)).withColumn("pinnable", F.col("has_geo") & F.col("verified")))


@query(
    f"""WITH {_sql_issues("b", "0")}, {_sql_issues("a", "1000")}, n AS (SELECT coalesce(country, 'UNASSIGNED') AS country, code, severity, 1 AS d FROM ai UNION ALL SELECT coalesce(country, 'UNASSIGNED'), code, severity, -1 FROM bi),
    c AS (SELECT country, string_agg(code || '=' || d, '|' ORDER BY code) AS codes FROM (SELECT country, code, sum(d) AS d FROM n GROUP BY ALL HAVING sum(d) <> 0) GROUP BY country),
    s AS (SELECT country, string_agg(severity || '=' || d, '|' ORDER BY severity) AS severities FROM (SELECT country, severity, sum(d) AS d FROM n GROUP BY ALL HAVING sum(d) <> 0) GROUP BY country),
    g AS (SELECT country, sum(d * (decision = 'ready')::INT) AS ready, sum(d * (decision = 'quarantined')::INT) AS quarantined FROM (SELECT coalesce(country, 'UNASSIGNED') AS country, decision, 1 AS d FROM ad UNION ALL SELECT coalesce(country, 'UNASSIGNED'), decision, -1 FROM bd) GROUP BY country)
    SELECT country, ready::BIGINT AS ready, quarantined::BIGINT AS quarantined, coalesce(codes, '') AS codes, coalesce(severities, '') AS severities FROM g LEFT JOIN c USING (country) LEFT JOIN s USING (country) WHERE ready <> 0 OR quarantined <> 0 OR codes IS NOT NULL OR severities IS NOT NULL"""
)
def country_issue_deltas(t: Tables) -> DataFrame:
    """How decisions and the maps of issues of each country changed between two baselines."""
    found = quality.country_deltas(_baselines(t, 0), _baselines(t, 1000), ["ready", "quarantined"], ("codes", "severities"))
    return found.withColumns({c: maps.as_text(F.col(c)) for c in ("codes", "severities")})


@query(
    f"""WITH {_sql_issues("a", "0")}, c AS (SELECT string_agg(code || '=' || n, '|' ORDER BY code) AS codes FROM (SELECT code, count(*) AS n FROM ai GROUP BY code))
    SELECT count(*) AS centres, count(*) FILTER (decision = 'ready') AS ready, count(*) FILTER (decision = 'needs_review') AS needs_review, count(*) FILTER (decision = 'quarantined') AS quarantined, count(*) FILTER (k % 8 <> 0 AND k % 7 <> 0) AS pinnable, any_value(c.codes) AS codes,
        (SELECT 'error=' || count(*) FILTER (severity = 'error') || '|info=' || count(*) FILTER (severity = 'info') || '|warning=' || count(*) FILTER (severity = 'warning') FROM ai) AS severities FROM ad, c"""
)
def quality_totals(t: Tables) -> DataFrame:
    """The summary of a run: all countries' counters and maps added up."""
    return quality.totals(_baselines(t, 0)).withColumns({c: maps.as_text(F.col(c)) for c in ("codes", "severities")})


def _baseline_rows(t: Tables, cut: float, pin: int) -> DataFrame:
    found = quality.analysed(_places(t, cut))
    tokens = F.sort_array(F.transform("issues", lambda i: F.concat(i["code"], F.lit(":"), i["severity"])))
    return found.select("id", "country", "decision", (F.col("id") % pin != 0).alias("pinnable"), tokens.alias("tokens"))


def _deltas(t: Tables) -> DataFrame:
    return quality.delta(_baseline_rows(t, 0, 19).where("id % 17 <> 0"), _baseline_rows(t, 1000, 23), "id")


_DEG = "CASE {d} WHEN 'quarantined' THEN 2 WHEN 'needs_review' THEN 1 ELSE 0 END"
_DELTA = f"""{_sql_issues("b", "0")}, {_sql_issues("a", "1000")}, x AS (SELECT a.id, b.id IS NULL AS is_new, array_to_string(list_sort(list_filter(a.tokens, lambda t: NOT list_contains(coalesce(b.tokens, []), t))), '|') AS new_tokens, array_to_string(list_sort(list_filter(coalesce(b.tokens, []), lambda t: NOT list_contains(a.tokens, t))), '|') AS resolved_tokens,
    {_DEG.format(d="a.decision")} - {_DEG.format(d="coalesce(b.decision, 'ready')")} AS m, a.id % 23 <> 0 AS pin, a.id % 19 <> 0 AS was, a.decision AS after FROM ad a LEFT JOIN (SELECT * FROM bd WHERE id % 17 <> 0) b ON a.id = b.id),
    d AS (SELECT id, is_new, new_tokens, resolved_tokens, CASE WHEN is_new OR m = 0 THEN 'same' WHEN m > 0 THEN 'regression' ELSE 'improvement' END AS decision_change, CASE WHEN is_new OR pin = was THEN 'same' WHEN was THEN 'lost' ELSE 'restored' END AS pin_change, after FROM x)"""


@query(f"WITH {_DELTA} SELECT * FROM d")
def baseline_delta(t: Tables) -> DataFrame:
    """What changed between two baselines, place by place."""
    return _deltas(t).withColumns({"new_tokens": joined(F.col("new_tokens")), "resolved_tokens": joined(F.col("resolved_tokens"))})


@query(
    f"""WITH {_DELTA}, c AS (SELECT coalesce(sum(len(list_filter(string_split(new_tokens, '|'), lambda t: t <> '' AND NOT suffix(t, ':info')))), 0)::BIGINT AS issues, count(*) FILTER (pin_change = 'lost') AS pins, count(*) FILTER (decision_change = 'regression' AND after = 'quarantined') AS quarantines FROM d WHERE NOT is_new),
    s AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 17 <> 0)
    SELECT issues, pins, quarantines, issues > greatest(25, ceil(n * 0.03)) AS too_many_issues, pins > greatest(20, ceil(n * 0.02)) AS too_many_pins, quarantines > greatest(5, ceil(n * 0.005)) AS too_many_quarantines FROM c, s"""
)
def regression_gate(t: Tables) -> DataFrame:
    """Whether the new baseline may be published."""
    size = t.customer.where("c_custkey % 17 <> 0").count()
    return quality.regression_gate(_deltas(t), size)


@query(
    """WITH e AS (SELECT user_id, min(ts) AS first, bool_or(event_type = 'error') AS failed FROM events GROUP BY user_id), k AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), f AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')
    SELECT user_id, CASE WHEN failed THEN CASE WHEN user_id IN (FROM k) THEN 'known_failed' WHEN user_id IN (FROM f) THEN 'unresolved_ongoing' ELSE 'unresolved_new' END WHEN user_id IN (FROM k) THEN 'known' ELSE 'new' END AS outcome FROM e"""
)
def discovery_new_ongoing(t: Tables) -> DataFrame:
    """Pages that are new, known or failed, now and before; users stand for pages."""
    crawled = t.events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("failed"))
    return quality.discovery(crawled, t.events.where("event_type = 'purchase'"), t.events.where("event_type = 'signup'"), "user_id")


# -- repair ------------------------------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT c_custkey AS id, n_name AS country, c_acctbal < 2000 AS candidate, c_custkey % 20 = 0 AS is_new, CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 10 ELSE 0 END + 1 AS cost FROM customer JOIN nation ON c_nationkey = n_nationkey),
    g AS (SELECT country, count(*) AS n, count(*) FILTER (candidate) AS hit FROM p GROUP BY country)
    SELECT id, is_new, cost, floor(hit::DOUBLE / n * sqrt(n::DOUBLE) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS priority FROM p JOIN g USING (country) WHERE candidate ORDER BY is_new DESC, cost DESC, priority DESC, id LIMIT 30"""
)
def remediation_priority(t: Tables) -> DataFrame:
    """The thirty places to repair first."""
    k = F.col("c_custkey")
    severities = F.filter(F.array(F.when(k % 2 == 0, "error"), F.when(k % 3 == 0, "warning"), F.lit("info")), lambda s: s.isNotNull())
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("id"), F.col("n_name").alias("country"), (F.col("c_acctbal") < 2000).alias("candidate"), (k % 20 == 0).alias("is_new"), severities.alias("severities"))
    return repair.prioritised(rows, 30).select("id", "is_new", "cost", "priority")


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'skipped_admin' WHEN c_custkey % 7 = 0 THEN 'unchanged' WHEN (c_custkey % 3 = 0 AND c_custkey % 40 > 5) OR c_custkey % 11 = 0 THEN 'rejected' WHEN (c_custkey % 3 = 0 OR c_custkey % 2 = 0) AND c_custkey % 5 > 0 THEN 'accepted' ELSE 'rejected' END AS outcome FROM customer"""
)
def remediation_outcome(t: Tables) -> DataFrame:
    """What becomes of proposed repairs."""
    k, no = F.col("c_custkey"), F.lit(False)
    found = repair.outcome(k % 10 == 0, no, k % 3 == 0, (k % 40).cast("double"), F.lit("street"), no, k % 2 == 0, k % 7 != 0, k % 11 == 0, F.lit(10), F.lit(10) - k % 5)
    return t.customer.select(k.alias("id"), found.alias("outcome"))


@query("""WITH l AS (SELECT DISTINCT l_partkey AS a, -1 - l_suppkey AS b FROM lineitem), s AS (SELECT a AS node, b AS o FROM l UNION SELECT b, a FROM l) SELECT node, count(*) AS n, string_agg(o::VARCHAR, '|' ORDER BY o) AS others FROM s GROUP BY node""")
def duplicate_adjacency(t: Tables) -> DataFrame:
    """Neighbours in an undirected graph of all parts and suppliers; each link once. Suppliers count from -1 down, as keys can be 0."""
    links = t.lineitem.select(F.col("l_partkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b")).distinct()
    return repair.both_ways(links).select("node", F.size("others").cast("long").alias("n"), joined(F.transform("others", lambda o: o.cast("string"))).alias("others"))


@query(
    f"""WITH p AS (SELECT c_custkey AS id, c_custkey // 4 AS phone, c_mktsegment AS seg, {sql_lat("c_custkey")} AS lat, {sql_lng("c_custkey")} AS lng FROM customer), l AS (SELECT a.id AS a, b.id AS b, a.phone AS phone, a.lat AS la, a.lng AS ga, b.lat AS lb, b.lng AS gb FROM p a JOIN p b ON a.phone = b.phone AND a.id < b.id)
    SELECT a, b, 'p' || phone AS phones, CASE WHEN a % 2 = b % 2 THEN 'site' || (a % 2) ELSE '' END AS websites, {sql_places(sql_km("la", "ga", "lb", "gb"), 6)} AS km FROM l"""
)
def pending_duplicate_evidence(t: Tables) -> DataFrame:
    """What two places share that have a phone in common; every such pair."""
    k = F.col("c_custkey")
    phone = F.concat(F.lit("p"), F.floor(k / 4).cast("string"))
    rows = t.customer.select(k.alias("id"), F.array(phone, F.lit("")).alias("phones"), F.array(F.concat(F.lit("site"), (k % 2).cast("string"))).alias("websites"), lat_of("c_custkey").alias("lat"), lng_of("c_custkey").alias("lng"))
    phones = rows.select("id", F.explode("phones").alias("phone")).where("phone <> ''")
    links = phones.withColumnRenamed("id", "a").join(phones.withColumnRenamed("id", "b"), "phone").where("a < b").select("a", "b").distinct()
    return repair.duplicate_evidence(links, rows).select("a", "b", joined(F.col("phones")).alias("phones"), joined(F.col("websites")).alias("websites"), rounded(F.col("km"), 6).alias("km"))


# -- overlays ------------------------------------------------------------------------------------------------------------------


@query(
    """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Renamed ' || c_custkey WHEN 1 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN 1.5::DOUBLE ELSE c_acctbal END AS balance, c_mktsegment AS segment FROM customer"""
)
def override_present_keys(t: Tables) -> DataFrame:
    """Reviewed patches: a key that is present replaces, by null too; one that is absent does not."""
    k = F.col("c_custkey")
    rows = t.customer.select(k.alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    patch = F.when(k % 4 == 0, F.create_map(F.lit("name"), F.concat(F.lit("Renamed "), k.cast("string")), F.lit("balance"), F.lit("1.5"))).otherwise(F.create_map(F.lit("name"), F.lit(None).cast("string")))
    patches = t.customer.where("c_custkey % 4 < 2").select(k.alias("id"), patch.alias("patch"))
    return overlay.applied(rows, overlay.checked(patches), {"name": "string", "balance": "double"})


@query("""SELECT c_custkey AS id, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN length(c_name) > 17 THEN 'name' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment' END], lambda v: v IS NOT NULL), '|') AS violations FROM customer""")
def override_violations(t: Tables) -> DataFrame:
    """Rules that records break."""
    rules: dict[str, Column] = {"balance": F.col("c_acctbal") >= 0, "name": F.length("c_name") <= 17, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")}
    return t.customer.select(F.col("c_custkey").alias("id"), joined(overlay.violations(rules)).alias("violations"))


@query("""SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 9 = 0 THEN 'opens ' || c_custkey END AS future_opening FROM customer""")
def future_openings_overlay(t: Tables) -> DataFrame:
    """Announced openings by id."""
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    openings = t.customer.where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("opens "), F.col("c_custkey").cast("string")).alias("label"))
    return overlay.future_openings(rows, openings)


# -- matching ----------------------------------------------------------------------------------------------------------------------

_M = "s_suppkey * 13 + p_partkey"
_MATCH = f"""m AS (SELECT s_suppkey, p_partkey, CAST(({_M}) % 11 AS DOUBLE) / 10 AS ns, CAST(({_M}) % 7 AS DOUBLE) / 10 AS ads, ({_M}) % 3 = 0 AS city, ({_M}) % 5 = 0 AS pc, ({_M}) % 4 = 1 AS pcx, ({_M}) % 6 = 1 AS cityx, ({_M}) % 17 = 0 AS contact, ({_M}) % 19 = 0 AS country, ({_M}) % 8 = 3 AS num, ({_M}) % 2 = 0 AS inst, ({_M}) % 9 = 0 AS subl, ({_M}) % 10 = 7 AS op, ({_M}) % 12 = 5 AS isaddr FROM supplier JOIN part ON p_size = s_suppkey % 50),
    x AS (SELECT *, (pcx OR cityx) AND ads < 0.35 AS st FROM m), y AS (SELECT *, num OR st AS conf, ns >= 0.5 AS nm FROM x), z AS (SELECT *, NOT conf AND (ads >= 0.35 OR (pc AND ads >= 0.22)) AS ad FROM y), w AS (SELECT *, nm::INT + ad::INT + contact::INT AS n_paths, city OR pc AS near FROM z)"""


@query(
    f"""WITH {_MATCH} SELECT s_suppkey, p_partkey, {sql_places("least(ns * 0.58::DOUBLE + ads * 0.27::DOUBLE + CASE WHEN pc THEN 0.04::DOUBLE ELSE 0::DOUBLE END + CASE WHEN city THEN 0.02::DOUBLE ELSE 0::DOUBLE END + CASE WHEN contact THEN 0.15::DOUBLE ELSE 0::DOUBLE END, 1::DOUBLE)", 3)} AS score, n_paths,
        CASE WHEN country THEN 'reject:country_conflict' WHEN st AND (nm OR contact OR op) THEN 'reject:same_operator_different_address' WHEN nm AND inst AND near AND (conf OR NOT ad OR subl) THEN 'review:campus_level_candidate' WHEN subl AND n_paths >= 2 THEN 'review:subpremise_not_confirmed'
            WHEN conf AND (ns >= 0.4 OR op) THEN 'reject:same_operator_different_address' WHEN n_paths >= 2 THEN 'accept:two_independent_evidence_paths' WHEN nm AND (near OR ads >= 0.2) THEN 'review:insufficient_independent_evidence' WHEN isaddr AND ad AND near THEN 'review:insufficient_identity_evidence'
            WHEN nm OR ad THEN 'reject:insufficient_independent_evidence' ELSE 'reject:insufficient_identity_evidence' END AS decision FROM w"""
)
def candidate_match_decision(t: Tables) -> DataFrame:
    """Scores and decisions of candidate pairs."""
    return matching.judged(_match_pairs(t)).select("s_suppkey", "p_partkey", "score", "n_paths", F.concat_ws(":", "decision", "reason").alias("decision"))


def _match_sides(t: Tables) -> tuple[DataFrame, DataFrame, dict[str, Column]]:
    """Parts, suppliers and what is known of a pair of them."""
    key, no = F.col("s_suppkey") * 13 + F.col("p_partkey"), F.lit(False)
    flags = {"city_matches": key % 3 == 0, "postcode_matches": key % 5 == 0, "postcode_conflicts": key % 4 == 1, "city_conflicts": key % 6 == 1, "contact_matches": key % 17 == 0, "country_conflict": key % 19 == 0, "number_conflict": key % 8 == 3,
             "has_address": F.lit(True), "institution": key % 2 == 0, "subpremise_lost": key % 9 == 0, "subpremise_conflict": no, "same_operator": key % 10 == 7, "is_address": key % 12 == 5}
    scores = {"name_score": (key % 11).cast("double") / 10, "address_score": (key % 7).cast("double") / 10}
    return t.part.select("p_partkey", F.col("p_size").cast("long").alias("size")), t.supplier.select("s_suppkey", (F.col("s_suppkey") % 50).alias("size")), scores | flags


def _match_pairs(t: Tables) -> DataFrame:
    parts, suppliers, facts = _match_sides(t)
    return pairing.crossed(parts, suppliers, ["size"], "p_partkey").select("s_suppkey", "p_partkey", *[v.alias(k) for k, v in facts.items()])


@query(
    f"""WITH {_MATCH}, d AS (SELECT s_suppkey, p_partkey, {sql_places("least(ns * 0.58::DOUBLE + ads * 0.27::DOUBLE + CASE WHEN pc THEN 0.04::DOUBLE ELSE 0::DOUBLE END + CASE WHEN city THEN 0.02::DOUBLE ELSE 0::DOUBLE END + CASE WHEN contact THEN 0.15::DOUBLE ELSE 0::DOUBLE END, 1::DOUBLE)", 3)} AS score,
        CASE WHEN country OR (st AND (nm OR contact OR op)) THEN 2 WHEN nm AND inst AND near AND (conf OR NOT ad OR subl) THEN 1 WHEN subl AND n_paths >= 2 THEN 1 WHEN conf AND (ns >= 0.4 OR op) THEN 2 WHEN n_paths >= 2 THEN 0 WHEN nm AND (near OR ads >= 0.2) THEN 1 WHEN isaddr AND ad AND near THEN 1 ELSE 2 END AS g FROM w)
    SELECT s_suppkey, p_partkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY g, score DESC, p_partkey) AS rank FROM d QUALIFY rank <= 5"""
)
def candidate_ranking(t: Tables) -> DataFrame:
    """The five best candidates of each supplier."""
    parts, suppliers, facts = _match_sides(t)
    found = matching.ranked_of(suppliers, parts, ["size"], facts, "s_suppkey", "p_partkey")
    return found.select("s_suppkey", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH s AS (SELECT s_suppkey AS id, s_suppkey % 5 AS country, string_split(lower(p_name), ' ') AS tokens, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'P' || (s_suppkey % 97) END AS pc, 'c' || (s_suppkey % 83) AS contact FROM supplier JOIN part ON p_partkey = s_suppkey),
    c AS (SELECT p_partkey AS cid, p_size % 5 AS country, lower(p_name) AS txt, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'P' || (p_partkey % 97) END AS pc, 'c' || (p_partkey % 101) AS contact FROM part),
    j AS (SELECT id, cid, len(list_filter(tokens, lambda k: contains(txt, k))) AS hits, s.pc <> '' AND s.pc = c.pc AS pm, s.contact = c.contact AS cm FROM s JOIN c USING (country))
    SELECT id, cid, hits::BIGINT AS hits, pm AS postcode, cm AS contact FROM j WHERE hits > 0 OR pm OR cm QUALIFY row_number() OVER (PARTITION BY id ORDER BY pm DESC, hits DESC, cid) <= 20"""
)
def candidate_discovery(t: Tables) -> DataFrame:
    """Candidates of the same country that share a name token, a postcode or a contact, the best twenty of each sample."""
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    of = lambda key, n, tag: F.concat(F.lit(tag), (key % n).cast("string"))
    samples = t.supplier.hint("merge").join(t.part, p == s).select(
        s.alias("id"), (s % 5).cast("int").alias("country"), text.tokens(text.normalised(F.col("p_name"))).alias("tokens"), F.when(s % 3 == 0, "").otherwise(of(s, 97, "P")).alias("postcode"), F.array(of(s, 83, "c")).alias("contacts")
    )
    found = t.part.select(
        p.alias("cid"), (F.col("p_size") % 5).cast("int").alias("country"), F.lower("p_name").alias("text"), F.when(p % 4 == 0, "").otherwise(of(p, 97, "P")).alias("postcode"), F.array(of(p, 101, "c")).alias("contacts")
    )
    rows = matching.discovered(samples, found, most=20, counted=False)
    return rows.select("id", "cid", F.col("hits").cast("long").alias("hits"), F.col("postcode_matches").alias("postcode"), F.col("contact_matches").alias("contact"))


@query(
    f"""WITH r AS (SELECT l_orderkey AS control, l_linenumber AS rank, CAST(l_partkey % 10 AS DOUBLE) / 10 AS ns, CAST(l_suppkey % 10 AS DOUBLE) / 10 AS ads, l_partkey % 4 = 0 AS ph, l_partkey % 5 = 0 AS si, l_partkey % 3 = 0 AS ci, CAST(l_suppkey % 3 AS DOUBLE) / 200 AS lat FROM lineitem WHERE l_partkey % 6 <> 0),
    every AS (SELECT DISTINCT l_orderkey AS control FROM lineitem), s AS (SELECT *, {sql_places("0.35::DOUBLE * ns + 0.35::DOUBLE * ads + (0::DOUBLE + CASE WHEN ph THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN si THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN ci THEN 0.1::DOUBLE ELSE 0::DOUBLE END)", 4)} AS score, {sql_places(sql_km("lat", "CAST(0 AS DOUBLE)", "CAST(0 AS DOUBLE)", "CAST(0 AS DOUBLE)"), 6)} AS km FROM r)
    SELECT control, rank, score, km, CASE WHEN km <= 0.25 THEN 'exact' WHEN km <= 0.75 THEN 'campus' ELSE 'disagrees' END AS agreement FROM s QUALIFY row_number() OVER (PARTITION BY control ORDER BY score DESC, rank, km) = 1
    UNION ALL SELECT control, NULL, NULL, NULL, 'no_result' FROM every WHERE control NOT IN (SELECT control FROM r)"""
)
def map_search_assessment(t: Tables) -> DataFrame:
    """The best search result of each control, and how far it is from it."""
    p, s, zero = F.col("l_partkey"), F.col("l_suppkey"), F.lit(0.0)
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("control"), F.col("l_linenumber").alias("rank"), (p % 6 != 0).alias("in_country"), ((p % 10).cast("double") / 10).alias("name_score"), ((s % 10).cast("double") / 10).alias("address_score"),
        (p % 4 == 0).alias("phone"), (p % 5 == 0).alias("site"), (p % 3 == 0).alias("city"), ((s % 3).cast("double") / 200).alias("lat"), zero.alias("lng"), zero.alias("control_lat"), zero.alias("control_lng"),
    )
    return matching.search_assessment(rows)


@query("""SELECT p_partkey AS key, p_name AS name, 'part' AS kind FROM part UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier""")
def union_except_columns(t: Tables) -> DataFrame:
    """Two candidate relations as one, without the columns that only helped to find them."""
    parts = t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.lit("part").alias("kind"), F.col("p_size").alias("hits"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.lit(0).alias("hits"))
    return parts.unionByName(suppliers).drop("hits")
