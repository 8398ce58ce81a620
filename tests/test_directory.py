import pytest
from pyspark.sql import functions as F

from waymark.functions import display, geo, html, names, numbers, text
from waymark.operators import matching, quality, search


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def lits(*values):
    return F.array(*map(F.lit, values)).cast("array<string>")


def none(kind="string"):
    return F.lit(None).cast(kind)


@pytest.mark.parametrize(
    "name, candidate, want",
    [
        ("IELTS Test Centre Toronto", "Toronto Test Venue", 0.0),  # nothing is left
        ("AEO Toronto", "AEO Language Centre", 1.0),
        ("Siam Learning", "Siam Mall", None),
        ("Northern Star Learning", "Northern Star Learning Hub", 1.0),
        ("", "x", 0.0),
    ],
)
def test_venue_similarity(spark, name, candidate, want):
    got = value(spark, names.venue_similarity(F.lit(name), F.lit(candidate), F.lit("12 King Street"), F.lit("Toronto"), none(), F.lit("Canada")))
    assert got == want if want is not None else 0 < got < 1


def test_identifiers_of_products_are_none(spark):
    same = lambda n, c: value(spark, names.shared_identity(names.words(F.lit(n)), names.words(F.lit(c)), F.lit(n), F.lit(c)))
    assert same("CBD one", "cbd two") == 0 and same("EIKEN one", "Eiken two") == 1 and same("Eiken one", "EIKEN two") == 0


def test_flags_of_names(spark):
    assert value(spark, names.is_institution(F.lit("York University"))) and not value(spark, names.is_institution(none()))
    conflict = lambda a, b: value(spark, names.subpremises_conflict(F.lit(a), F.lit(b)))
    assert conflict("Suite 12A", "unit #9") and not conflict("Suite 12A", "Room 12a") and not conflict("12 King", "Unit 3")
    assert value(spark, names.same_operator(F.lit("IDP Lagos"), lits("x", "The idp office"))) and not value(spark, names.same_operator(F.lit("IDP"), lits()))
    assert value(spark, names.same_local_place(F.lit("北京·教育考试院"), F.lit("教育考试院"))) and not value(spark, names.same_local_place(F.lit("北京"), F.lit("北京")))
    assert value(spark, names.without_location(F.lit("Lab, Oslo 0150"), F.lit("Oslo"), none(), F.lit("0150"), F.lit("Norway"))) == "lab"
    assert value(spark, text.has_subpremise(F.lit("Bldg 4"))) and not value(spark, text.has_subpremise(F.lit("Flat 4")))


def test_labels(spark):
    assert value(spark, display.price_label(none())) == "Price not published"
    assert value(spark, display.operator_colour(F.lit("?"))) == "#64748B" and value(spark, display.operator_shape(none())) == "circle"
    assert value(spark, display.result_portal(F.lit("unknown"), F.lit("CN"))) is None
    assert value(spark, display.component(F.lit("a b&(c)~!*'é"))) == "a%20b%26(c)~!*'%C3%A9"
    assert value(spark, display.location_caveat(F.lit(True), F.lit("verified"), F.lit("rooftop"))) is None


def test_listing_without_rows(spark):
    assert value(spark, html.offers(F.lit("<p>no table</p>"))) == [] and value(spark, html.offers(none())) == []
    assert value(spark, html.cards(F.lit(""))) == []
    assert value(spark, html.booking_url(lits("https://example.com", "https://www.ieltsusa.org/x"))) == "https://www.ieltsusa.org/x"


def test_derived_prices(spark):
    ok = lambda *a: value(spark, numbers.derived_price_consistent(*a))
    assert ok(F.lit("CAD 3"), F.lit("CAD"), F.lit(3.0), F.lit("verified")) and not ok(F.lit(" "), F.lit("CAD"), F.lit(3.0), F.lit("verified"))
    assert not ok(F.lit("x"), F.lit("CAD"), F.lit(float("inf")), F.lit("verified")) and ok(F.lit("x"), none(), none("double"), F.lit("unparsed"))


def test_same_location(spark):
    point = "struct<lat:double,lng:double,precision:string,verification:string,confidence:double,paths:array<string>,agreement_km:double>"
    one = lambda *paths: F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"), F.lit("city").alias("precision"), F.lit("v").alias("verification"), F.lit(0.5).alias("confidence"), lits(*paths).alias("paths"), none("double").alias("agreement_km")).cast(point)
    assert value(spark, geo.same_location(one("a", "b"), one("b", "a"))) and not value(spark, geo.same_location(one("a"), one("b")))
    assert value(spark, geo.same_location(none(point), none(point))) and not value(spark, geo.same_location(one(), none(point)))


def test_unfit_environment(spark):
    rows = [("CA", "exact", 2, 2, 3, 0), ("US", "no_result", 2, 0, 0, 0)]
    got = matching.search_summary(spark.createDataFrame(rows, "country string, agreement string, queries int, errors int, candidates int, outside int")).first()
    assert got.status == "invalid_environment" and got.exact_agreement is None and got.exact_coverage == 0.5
    empty = matching.search_summary(spark.createDataFrame([], "country string, agreement string, queries int, errors int, candidates int, outside int")).first()
    assert empty.sample_size == 0 and empty.exact_coverage is None and empty.status == "measured"


def test_review_queue_is_whole(spark):
    places = spark.createDataFrame([(i, f"n{i}", None, "c", "CA", i % 2 == 0) for i in range(300)], "id int, name string, address string, city string, country string, needs_review boolean")
    assert search.administered(places).count() == 200 and search.administered(places, queue_only=True).count() == 150
    assert [r.id for r in search.administered(places, "N299").collect()] == [299]


def test_audit_of_nothing(spark):
    schema = "id int, has_geo boolean, verification string, city string, city_source string, offers array<struct<label:string,text:string,status:string>>"
    rows = [(1, True, "verified", "x", "rule", None), (2, False, None, None, None, [("a", None, "unparsed")])]
    got = {(r.kind, r.id, r.detail) for r in quality.audit(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("no_location", 2, None), ("unparsed_price", 2, "a: ")}


def test_whole_graph_components_against_union_find(spark, tmp_path):
    from waymark import plans

    # chains and a hot part over orders of which no key is a multiple of 40
    lines = [(o, o * 7 % 60, o) for o in range(1, 39)] + [(o, 500, o) for o in range(41, 60)] + [(80, 900, 1), (80, 0, 2)]
    spark.createDataFrame([(o, o // 2) for o in {x[0] for x in lines}], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber long").write.parquet(f"{tmp_path}/lineitem.parquet")
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for o, part, _ in lines:
        a, b = find(o // 2), find(-1 - part)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in plans.QUERIES["graph_components"](spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in list(root)} and len(set(got.values())) > 1


def test_whole_adjacency_and_evidence(spark):
    from waymark import plans

    sf = "/root/testdata/sf0.001"
    links = {(r.l_partkey, r.l_suppkey) for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    assert sum(r.n for r in plans.QUERIES["duplicate_adjacency"](spark, sf).collect()) == 2 * len(links)
    ids = [r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()]
    got = {(r.a, r.b) for r in plans.QUERIES["pending_duplicate_evidence"](spark, sf).collect()}
    assert got == {(a, b) for a in ids for b in ids if a < b and a // 4 == b // 4}


def test_whole_resolution_and_currencies(spark):
    from waymark import plans

    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    resolved = {r.entity for r in plans.QUERIES["resolve_geo_candidates"](spark, sf).collect()}
    assert resolved == {r.l_partkey for r in lines if r.l_suppkey % 11}
    assert {r.l_suppkey for r in plans.QUERIES["currency_set_guard"](spark, sf).collect()} == {r.l_suppkey for r in lines}
    assert "l_partkey % 5 = 0" not in plans.ORACLE_SQL["resolve_geo_candidates"] and "WHERE" not in plans.ORACLE_SQL["currency_set_guard"]
