"""Queries over the scalar functions: text, numbers and coordinates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import address, geo, numbers, providers, text
from ..operators import pairing, sampling
from .registry import Tables, joined, lat_of, lng_of, query, sql_km, sql_lat, sql_lng, sql_places

_FOLD = "trim(regexp_replace(translate(lower({t}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in text.NAME_STOPWORDS)


@query(
    f"""WITH n AS (SELECT doc_id, {_FOLD.format(t="text")} AS normal FROM documents)
    SELECT doc_id, md5(normal) AS normal_md5, md5(array_to_string(list_filter(string_split(normal, ' '), lambda t: t <> '' AND t NOT IN ({_STOP})), ' ')) AS key_md5 FROM n"""
)
def text_normalise_documents(t: Tables) -> DataFrame:
    """Normalised text and name key of every document."""
    c = F.col("text")
    return t.documents.select("doc_id", F.md5(text.normalised(c).cast("binary")).alias("normal_md5"), F.md5(text.name_key(c).cast("binary")).alias("key_md5"))


_PARTS = "(?i)^([a-z][a-z0-9+.-]*)://([^/?#]+)([^?#]*)(\\?[^#]*)?"


@query(
    f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '{_PARTS}', 1) AS s, regexp_extract(url, '{_PARTS}', 2) AS h,
        regexp_replace(regexp_extract(url, '{_PARTS}', 3), '/+$', '') AS path, regexp_extract(url, '{_PARTS}', 4) AS q FROM pages)
    SELECT page_id, lower(s) || '://' || lower(h) || path || CASE WHEN path = '' AND q <> '' THEN '/' || q ELSE q END AS identity,
        regexp_replace(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS host,
        regexp_replace(regexp_replace(regexp_replace(path, '\\.html$', ''), '^.*/', ''), '\\d$', '') AS stem FROM p"""
)
def slug_base_pages(t: Tables) -> DataFrame:
    """Identity, host and last path segment of every page's url."""
    url = F.col("url")
    path = F.regexp_replace(F.regexp_extract(url, _PARTS, 3), "/+$", "")
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), "^.*/", ""), r"\d$", "")
    return t.pages.select("page_id", text.website_identity(url).alias("identity"), text.website_host(url).alias("host"), stem.alias("stem"))


_TOKENS = "list_distinct(string_split({c}, ' '))"
_SIM = "CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"
_TOKEN_SIM = f"len(list_intersect({_TOKENS.format(c='{a}')}, {_TOKENS.format(c='{b}')}))::DOUBLE / greatest(len({_TOKENS.format(c='{a}')}), len({_TOKENS.format(c='{b}')}))"
_PAIRS = "FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey"


def _part_pairs(t: Tables, prepared: dict[str, Column], score: Callable[[Callable, Callable], dict[str, Column]]) -> DataFrame:
    return pairing.within(t.part, ["p_brand", "p_size"], "p_partkey", "p_name", prepared, score)


@query(
    f"""SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, {sql_places(_SIM.format(a="lower(a.p_name)", b="lower(b.p_name)"), 6)} AS edit,
        {sql_places(_TOKEN_SIM.format(a="lower(a.p_name)", b="lower(b.p_name)"), 6)} AS token,
        greatest({sql_places(_SIM.format(a="lower(a.p_name)", b="lower(b.p_name)"), 6)}, {sql_places(_TOKEN_SIM.format(a="lower(a.p_name)", b="lower(b.p_name)"), 6)}) AS best {_PAIRS}"""
)
def name_similarity_parts(t: Tables) -> DataFrame:
    """Edit and token similarity of the names of parts of one brand and size."""
    edit = lambda a, b: numbers.places(text.edit_similarity(a("name"), b("name")), 6)
    token = lambda a, b: numbers.places(text.token_similarity(a("name"), b("name")), 6)
    return _part_pairs(t, {"name": text.normalised(F.col("p_name"))}, lambda a, b: {"edit": edit(a, b), "token": token(a, b), "best": F.greatest(edit(a, b), token(a, b))})


@query(
    f"""WITH p AS (SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, replace(lower(a.p_name), ' ', '') AS x, replace(lower(b.p_name), ' ', '') AS y, {_TOKENS.format(c="lower(a.p_name)")} AS u, {_TOKENS.format(c="lower(b.p_name)")} AS v {_PAIRS}),
    g AS (SELECT a_key, b_key, substr(x, i, 2) AS g, 1 AS side FROM p, unnest(generate_series(1, length(x) - 1)) AS s(i) UNION ALL SELECT a_key, b_key, substr(y, i, 2), 2 FROM p, unnest(generate_series(1, length(y) - 1)) AS s(i)),
    c AS (SELECT a_key, b_key, g, count(*) FILTER (side = 1) AS n, count(*) FILTER (side = 2) AS m FROM g GROUP BY ALL),
    o AS (SELECT a_key, b_key, sum(least(n, m))::BIGINT AS shared FROM c GROUP BY ALL)
    SELECT a_key, b_key, {sql_places("2 * len(list_intersect(u, v))::DOUBLE / (len(u) + len(v))", 6)} AS tokens, {sql_places("CASE WHEN x = y THEN 1.0::DOUBLE ELSE 2 * shared::DOUBLE / (length(x) + length(y) - 2) END", 6)} AS bigrams
    FROM p JOIN o USING (a_key, b_key)"""
)
def token_and_bigram_dice_parts(t: Tables) -> DataFrame:
    """Dice of words and of character pairs, counting repeats."""
    prepared = {"name": text.normalised(F.col("p_name")), "compact": text.compact(F.col("p_name"))}
    dice = lambda a, b: {"tokens": text.token_dice(a("name"), b("name")), "bigrams": text.bigram_dice(a("compact"), b("compact"))}
    return _part_pairs(t, prepared, lambda a, b: {n: numbers.places(c, 6) for n, c in dice(a, b).items()})


_WORDS = "list_distinct(list_filter(string_split({c}, ' '), lambda w: length(w) >= 5))"


@query(
    f"""WITH d AS (SELECT doc_id, unnest({_WORDS.format(c=_FOLD.format(t="text"))}) AS w FROM documents), b AS (SELECT item_id, {_WORDS.format(c=_FOLD.format(t="text"))} AS ws FROM benchmark),
    e AS (SELECT item_id, unnest(ws) AS w, len(ws) AS n FROM b)
    SELECT doc_id, item_id, count(*) AS shared, any_value(n)::BIGINT AS n_words FROM d JOIN e USING (w) GROUP BY doc_id, item_id HAVING count(*) * 2 >= any_value(n)"""
)
def shared_words_documents_benchmark(t: Tables) -> DataFrame:
    """Documents that hold half of the longer words of a benchmark item: a join on words, then counts."""
    words = lambda c: F.array_distinct(F.filter(text.tokens(text.normalised(F.col(c))), lambda w: F.length(w) >= 5))
    items = t.benchmark.select("item_id", words("text").alias("ws")).select("item_id", F.explode("ws").alias("w"), F.size("ws").cast("long").alias("n_words"))
    docs = t.documents.select("doc_id", F.explode(words("text")).alias("w"))
    found = docs.join(items, "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.first("n_words").alias("n_words"))
    return found.where(F.col("shared") * 2 >= F.col("n_words"))


_CENTS = "CAST(floor(l_extendedprice * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT)"


@query(
    f"""WITH l AS (SELECT l_orderkey, l_linenumber, {_CENTS} AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 IN (0, 1, 2, 3) THEN 'CAD' END AS currency,
        CASE l_linenumber % 5 WHEN 0 THEN c::DOUBLE / 100 WHEN 1 THEN c::DOUBLE / 100 WHEN 2 THEN (c // 100)::DOUBLE WHEN 3 THEN (c // 100)::DOUBLE END AS price,
        CASE WHEN l_linenumber % 5 = 4 THEN 'unparsed' ELSE 'verified' END AS status FROM l"""
)
def price_parse_formats(t: Tables) -> DataFrame:
    """Prices printed in five styles and read again: 1,234.56, 1.234,56, Arabic digits, grouped thousands, and without a currency."""
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    whole, fraction = F.floor(cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = F.format_number(whole, 0)
    arabic = F.translate(whole.cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    style = F.col("l_linenumber") % 5
    printed = (
        F.when(style == 0, F.concat(F.lit("CAD "), grouped, F.lit("."), fraction)).when(style == 1, F.concat(F.lit("from CAD "), F.replace(grouped, F.lit(","), F.lit(".")), F.lit(","), fraction))
        .when(style == 2, F.concat(F.lit("CAD "), arabic)).when(style == 3, F.concat(F.lit("CAD "), grouped)).otherwise(F.concat(grouped, F.lit("."), fraction))
    )
    found = t.lineitem.select("l_orderkey", "l_linenumber", numbers.published_price(printed).alias("p"))
    return found.select("l_orderkey", "l_linenumber", F.col("p.currency").alias("currency"), F.col("p.price").alias("price"), F.col("p.status").alias("status"))


@query(
    """WITH g AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n, min(l_extendedprice) AS low, arg_min(l_returnflag, l_linenumber) AS first_flag, arg_min(l_linenumber, l_linenumber) AS first_line FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN n = 1 THEN first_flag END AS currency, CASE WHEN n = 1 THEN low END AS price FROM g"""
)
def price_summary_by_order(t: Tables) -> DataFrame:
    """The cheapest line of orders with one currency, here the return flag."""
    offer = F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("text"), F.col("l_returnflag").alias("currency"), F.col("l_extendedprice").alias("price"), F.lit("verified").alias("status"))
    grouped = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(offer)).alias("offers"))
    best = grouped.select("l_orderkey", numbers.cheapest_of_one_currency(F.col("offers")).alias("b"))
    return best.select("l_orderkey", F.col("b.currency").alias("currency"), F.col("b.price").alias("price"))


_P, _N = "(k::DOUBLE / n)", "n::DOUBLE"
_CENTRE, _SPREAD = f"({_P} + CAST(3.8416 AS DOUBLE) / (2 * n))", f"(CAST(1.96 AS DOUBLE) * sqrt({_P} * (1 - {_P}) / n + CAST(3.8416 AS DOUBLE) / (4 * {_N} * n)))"
_BOUND = "least(greatest(({x}) / (1 + CAST(3.8416 AS DOUBLE) / n), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))"


@query(
    f"""WITH g AS (SELECT quality, count(*) FILTER (toxic = 1) AS k, count(*) AS n FROM labels GROUP BY quality)
    SELECT quality, k, n, {sql_places(_BOUND.format(x=f"{_CENTRE} - {_SPREAD}"), 4)} AS low, {sql_places(_BOUND.format(x=f"{_CENTRE} + {_SPREAD}"), 4)} AS high FROM g"""
)
def wilson_by_label(t: Tables) -> DataFrame:
    """The share of toxic documents per quality, with its interval."""
    found = t.labels.groupBy("quality").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("*").alias("n"))
    return found.select("quality", "k", "n", numbers.wilson(F.col("k"), F.col("n")).alias("w")).select("quality", "k", "n", F.col("w.low").alias("low"), F.col("w.high").alias("high"))


@query(
    """WITH h AS (SELECT c_custkey, c_nationkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('bc-' || c_custkey, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS hash FROM customer),
    s AS (SELECT c_nationkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS place FROM customer GROUP BY c_nationkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY hash, 'bc-' || c_custkey) AS round FROM h JOIN s USING (c_nationkey) WHERE place <= 25)
    SELECT 'bc-' || c_custkey AS id, c_nationkey AS nation, hash, round FROM r ORDER BY round, place LIMIT 50"""
)
def fnv_stratified_sample(t: Tables) -> DataFrame:
    """Fifty customers, one of each nation in turn, in the order of a hash of their ids."""
    rows = t.customer.select(F.concat(F.lit("bc-"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").alias("nation"))
    return sampling.round_robin(rows, "nation", "id", 50).select("id", "nation", "hash", F.col("round").cast("long").alias("round"))


# -- coordinates -------------------------------------------------------------------------------------------------------


@query(
    f"""SELECT c_custkey, s_suppkey, {sql_places(sql_km(sql_lat("c_custkey"), sql_lng("c_custkey"), sql_lat("s_suppkey"), sql_lng("s_suppkey")), 6)} AS km
    FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE {sql_places(sql_km(sql_lat("c_custkey"), sql_lng("c_custkey"), sql_lat("s_suppkey"), sql_lng("s_suppkey")), 6)} <= 2500"""
)
def haversine_radius(t: Tables) -> DataFrame:
    """Suppliers within 2,500 km of customers of their nation."""
    people = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), geo.cell(lat_of("c_custkey"), lng_of("c_custkey"), 2500).alias("cell"))
    sellers = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.explode(geo.cells_around(lat_of("s_suppkey"), lng_of("s_suppkey"), 2500)).alias("cell"))
    pairs = pairing.crossed(people, sellers, ["nation", "cell"], "c_custkey")
    km = numbers.places(geo.haversine_km(lat_of("c_custkey"), lng_of("c_custkey"), lat_of("s_suppkey"), lng_of("s_suppkey")), 6)
    return pairs.select("c_custkey", "s_suppkey", km.alias("km")).where("km <= 2500")


@query(f"""SELECT c_custkey, {sql_lat("c_custkey")} AS lat, {sql_lng("c_custkey")} AS lng FROM customer WHERE {sql_lat("c_custkey")} BETWEEN -40 AND 40 AND ({sql_lng("c_custkey")} >= 150 OR {sql_lng("c_custkey")} <= -160)""")
def viewport_antimeridian(t: Tables) -> DataFrame:
    """Customers in a view that crosses the antimeridian."""
    rows = t.customer.select("c_custkey", lat_of("c_custkey").alias("lat"), lng_of("c_custkey").alias("lng"))
    return rows.where(geo.within_bounds(F.col("lat"), F.col("lng"), north=40, south=-40, east=200, west=150))


_BOUNDS = [("NATION_1", 41.0, 84.0, -142.0, -52.0), ("NATION_2", 41.0, 52.0, -6.0, 10.0), ("NATION_3", 17.0, 54.0, 73.0, 136.0), ("NATION_4", -34.0, 6.0, -74.0, -34.0), ("NATION_5", -5.0, 6.0, 33.0, 42.0)]
_BOX = ", ".join(str(b) for b in _BOUNDS)


@query(
    f"""SELECT c_custkey, n_name AS country, coalesce({sql_lat("c_custkey")} BETWEEN south AND north AND {sql_lng("c_custkey")} BETWEEN west AND east, TRUE) AS plausible
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (VALUES {_BOX}) b(name, south, north, west, east) ON name = n_name"""
)
def country_plausibility(t: Tables) -> DataFrame:
    """Whether customers lie in their country's box; a country without a box accepts every point."""
    bounds = t.spark.createDataFrame(_BOUNDS, "country string, south double, north double, west double, east double")
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("country"), lat_of("c_custkey").alias("lat"), lng_of("c_custkey").alias("lng"))
    return geo.plausible(rows, bounds).select("c_custkey", "country", "plausible")


@query(
    """WITH c AS (SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN ['any'] WHEN 'MACHINERY' THEN ['own_map'] WHEN 'AUTOMOBILE' THEN [] END AS rights, c_acctbal >= 0 AS has_geo FROM customer)
    SELECT c_mktsegment AS source, CASE WHEN NOT has_geo THEN 'missing' WHEN coalesce(list_contains(rights, 'any'), FALSE) THEN 'displayable' ELSE 'suppressed' END AS status, count(*) AS n FROM c GROUP BY ALL"""
)
def geo_policy_export(t: Tables) -> DataFrame:
    """Places by source that may be shown on any map, are suppressed, or have no coordinate."""
    source = F.col("c_mktsegment")
    rights = F.when(source == "BUILDING", F.array(F.lit("any"))).when(source == "MACHINERY", F.array(F.lit("own_map"))).when(source == "AUTOMOBILE", F.array().cast("array<string>"))
    rows = t.customer.select(source.alias("source"), geo.policy(rights, "any", F.col("c_acctbal") >= 0).alias("status"))
    return rows.groupBy("source", "status").agg(F.count("*").alias("n"))


_CODES = [("33", "FR"), ("44", "GB"), ("49", "DE"), ("61", "AU"), ("86", "CN"), ("91", "IN"), ("254", "KE"), ("351", "PT"), ("966", "SA"), ("972", "IL")]
_CODE_ROWS = ", ".join(str(c) for c in _CODES)


@query(
    f"""WITH p AS (SELECT c_custkey, '+' || (c_custkey * 7919 % 900 + 100) || '-' || (c_custkey * 31 % 1000000) AS phone FROM customer), d AS (SELECT c_custkey, substr(regexp_replace(phone, '[^0-9]', '', 'g'), 1, 3) AS d FROM p), c AS (SELECT * FROM (VALUES {_CODE_ROWS}) t(code, country))
    SELECT c_custkey, CASE WHEN d[1] NOT IN ('1', '7') THEN coalesce(c3.country, c2.country) END AS country FROM d LEFT JOIN c c3 ON c3.code = d LEFT JOIN c c2 ON c2.code = d[1:2]"""
)
def phone_country_prefix(t: Tables) -> DataFrame:
    """The country of a phone by its dialling code; codes 1 and 7 are shared."""
    key = F.col("c_custkey")
    rows = t.customer.select("c_custkey", F.concat(F.lit("+"), (key * 7919 % 900 + 100).cast("string"), F.lit("-"), (key * 31 % 1000000).cast("string")).alias("phone"))
    return address.country_of_phone(rows, t.spark.createDataFrame(_CODES, "code string, country string"), out="country").select("c_custkey", "country")


@query(
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Halifax' WHEN 1 THEN 'Denver' END AS city, CASE c_custkey % 3 WHEN 0 THEN 'NS' WHEN 1 THEN 'CO' END AS region,
        CASE c_custkey % 3 WHEN 0 THEN 'B3H 4R2' WHEN 1 THEN '80202' ELSE '4000' END AS postcode, CASE c_custkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'US' ELSE 'AU' END AS country FROM customer"""
)
def address_fold(t: Tables) -> DataFrame:
    """Address lines of three shapes, folded into their parts."""
    street = F.concat(F.col("c_custkey").cast("string"), F.lit(" Main Street"))
    line = lambda *s: F.array(street, *map(F.lit, s))
    kind = F.col("c_custkey") % 3
    lines = F.when(kind == 0, line("Halifax", "Nova Scotia", "b3h4r2")).when(kind == 1, line("Denver, CO", "80202")).otherwise(line("Brisbane", "4000", "Australia"))
    found = t.customer.select("c_custkey", address.parsed(lines, F.lit(None).cast("string")).alias("a"))
    return found.select("c_custkey", *[F.col(f"a.{c}").alias(c) for c in ("city", "region", "postcode", "country")])


_SHIFT = f"""WITH p AS (SELECT c_custkey, {sql_lat("c_custkey")} AS lat, {sql_lng("c_custkey")} AS lng FROM customer), q AS (SELECT *, lng - 105 AS x, lat - 35 AS y, radians(lat) AS r FROM p),
    b AS (SELECT *, (20 * sin(6 * pi() * x) + 20 * sin(2 * pi() * x)) * 2 / 3 AS base, 1::DOUBLE - 0.00669342162296594323::DOUBLE * sin(r) * sin(r) AS m FROM q),
    o AS (SELECT *, -100 + 2 * x + 3 * y + y * y / 5 + x * y / 10 + sqrt(abs(x)) / 5 + base + (20 * sin(pi() * y) + 40 * sin(pi() * y / 3)) * 2 / 3 + (160 * sin(pi() * y / 12) + 320 * sin(pi() * y / 30)) * 2 / 3 AS dy,
        300 + x + 2 * y + x * x / 10 + x * y / 10 + sqrt(abs(x)) / 10 + base + (20 * sin(pi() * x) + 40 * sin(pi() * x / 3)) * 2 / 3 + (150 * sin(pi() * x / 12) + 300 * sin(pi() * x / 30)) * 2 / 3 AS dx FROM b),
    s AS (SELECT *, lng < 72.004 OR lng > 137.8347 OR lat < 0.8293 OR lat > 55.8271 AS out FROM o)"""


@query(
    f"""{_SHIFT} SELECT c_custkey, {sql_places("CASE WHEN out THEN lat ELSE lat + dy * 180 / (6378245::DOUBLE * (1 - 0.00669342162296594323::DOUBLE) / (m * sqrt(m)) * pi()) END", 6)} AS lat,
        {sql_places("CASE WHEN out THEN lng ELSE lng + dx * 180 / (6378245::DOUBLE / sqrt(m) * cos(r) * pi()) END", 6)} AS lng, 0::BIGINT AS error FROM s"""
)
def shifted_datum_round_trip(t: Tables) -> DataFrame:
    """Customers' points in the shifted datum and back; the error in millionths of a degree."""
    rows = t.customer.select("c_custkey", lat_of("c_custkey").alias("lat"), lng_of("c_custkey").alias("lng"))
    there = rows.withColumn("s", geo.to_shifted(F.col("lat"), F.col("lng")))
    back = there.withColumn("b", geo.from_shifted(F.col("s.lat"), F.col("s.lng")))
    error = F.greatest(F.abs(F.col("b.lat") - F.col("lat")), F.abs(F.col("b.lng") - F.col("lng")))
    return back.select("c_custkey", numbers.places(F.col("s.lat"), 6).alias("lat"), numbers.places(F.col("s.lng"), 6).alias("lng"), F.floor(error * 1e6 + 0.5).alias("error"))


@query(
    """WITH t AS (SELECT c_custkey, lower(c_name) AS n FROM customer) SELECT c_custkey, regexp_replace(n, '#\\d+$', '') AS stem, CASE WHEN c_custkey % 4 = 0 THEN '750 m' WHEN c_custkey % 4 = 1 THEN '1.5 km' WHEN c_custkey % 4 = 2 THEN '12 km' ELSE '0 m' END AS label,
        CASE WHEN c_custkey % 3 = 0 THEN 'high' WHEN c_custkey % 3 = 1 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN c_custkey % 3 = 1 THEN '+1' WHEN c_custkey % 3 = 2 THEN '-2' ELSE '0' END AS signed FROM t"""
)
def display_labels(t: Tables) -> DataFrame:
    """Distances, confidences and changes as they are shown."""
    key = F.col("c_custkey")
    km = F.when(key % 4 == 0, 0.75).when(key % 4 == 1, 1.5).when(key % 4 == 2, 12.25).otherwise(0.0)
    sure = F.when(key % 3 == 0, 0.8).when(key % 3 == 1, 0.5).otherwise(0.3)
    change = F.when(key % 3 == 1, 1).when(key % 3 == 2, -2).otherwise(0)
    return t.customer.select("c_custkey", F.regexp_replace(F.lower("c_name"), r"#\d+$", "").alias("stem"), text.distance_label(km).alias("label"), text.confidence_label(sure).alias("confidence"), text.signed(change).alias("signed"))


@query(
    """WITH c AS (SELECT c_custkey, ['+1 416 555 ' || lpad((c_custkey % 50)::VARCHAR, 4, '0'), '001-416-555-' || lpad((c_custkey % 50)::VARCHAR, 4, '0'), 'x'] AS ps FROM customer)
    SELECT c_custkey, ps[1] AS phones, regexp_replace(ps[1], '\\D', '', 'g') AS identity FROM c"""
)
def contact_identity(t: Tables) -> DataFrame:
    """Phones that are written in two ways are one; those without digits are none."""
    last = F.lpad((F.col("c_custkey") % 50).cast("string"), 4, "0")
    phones = F.array(F.concat(F.lit("+1 416 555 "), last), F.concat(F.lit("001-416-555-"), last), F.lit("x"))
    own = t.customer.select("c_custkey", phones.alias("ps"))
    return own.select("c_custkey", joined(text.unique_by(F.col("ps"), text.phone_identity)).alias("phones"), text.phone_identity(F.get("ps", F.lit(0))).alias("identity"))


@query(
    """WITH k AS (SELECT s_suppkey, s_suppkey % 35 AS r FROM supplier)
    SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'postcode' WHEN r >= 30 THEN 'rooftop' WHEN r >= 26 THEN 'street' WHEN r >= 21 THEN 'postcode' WHEN r >= 13 OR s_suppkey % 4 = 0 THEN 'city' ELSE 'country' END AS by_rank,
        CASE s_suppkey % 5 WHEN 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'rooftop' ELSE 'street' END WHEN 1 THEN 'street' WHEN 2 THEN 'postcode' WHEN 3 THEN 'city' ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'rooftop' ELSE 'city' END END AS by_address,
        CASE s_suppkey % 5 WHEN 1 THEN 'street' WHEN 2 THEN 'postcode' WHEN 3 THEN 'city' ELSE 'rooftop' END AS by_place FROM k"""
)
def provider_precisions(t: Tables) -> DataFrame:
    """Precisions by rank, by address types and by place types."""
    k = F.col("s_suppkey")
    kinds = F.array(F.element_at(F.array(*map(F.lit, ("premise", "route", "postal_code", "locality", "point_of_interest"))), (k % 5 + 1).cast("int")))
    location = F.when(k % 2 == 0, "ROOFTOP")
    rank = providers.precision_by_rank((k % 35).cast("int"), F.when(k % 9 == 0, "postcode").otherwise("x"), F.when(k % 4 == 0, "City"))
    return t.supplier.select("s_suppkey", rank.alias("by_rank"), providers.precision_of_address(kinds, location).alias("by_address"), providers.precision_of_place(kinds).alias("by_place"))


@query(
    """WITH g AS (SELECT c_custkey, c_custkey % 3 = 0 AS v, c_custkey % 4 > 1 AS p, CAST(c_custkey % 10 AS DOUBLE) / 10 AS c, c_custkey % 11 = 0 AS none FROM customer)
    SELECT c_custkey, CASE WHEN none OR (v AND p AND c >= 0.5) THEN '' ELSE concat_ws('|', CASE WHEN NOT v THEN 'verification' END, CASE WHEN NOT p THEN 'precision' END, CASE WHEN c < 0.5 THEN 'confidence' END) END AS issues, greatest(c, 0.9::DOUBLE) AS approved FROM g"""
)
def location_review(t: Tables) -> DataFrame:
    """Why locations need a review, and their confidence once approved."""
    k = F.col("c_custkey")
    verification, precision, sure = F.when(k % 11 != 0, F.when(k % 3 == 0, "verified").otherwise("unverified")), F.when(k % 4 > 1, "street").otherwise("city"), (k % 10).cast("double") / 10
    approved = providers.approved(F.array(F.lit("osm")), sure, "street")
    return t.customer.select("c_custkey", joined(providers.review_issues(verification, precision, sure)).alias("issues"), approved["confidence"].alias("approved"))


@query(
    """WITH w AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 3) AS ws FROM part), d AS (SELECT p_partkey, i, ws[i] AS x FROM w, unnest(generate_series(1, len(ws))) s(i)),
    f AS (SELECT p_partkey, x, min(i) AS i FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS n FROM f)
    SELECT p_partkey, string_agg(x, '|' ORDER BY i) AS tokens FROM r WHERE n <= 5 GROUP BY p_partkey"""
)
def distinctive_tokens_parts(t: Tables) -> DataFrame:
    """The tokens that tell parts apart."""
    return t.part.select("p_partkey", joined(text.distinctive_tokens(F.col("p_name"))).alias("tokens")).where("tokens <> ''")
