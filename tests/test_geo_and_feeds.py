import json

from pyspark.sql import functions as F

from waymark.operators import candidates, repair, sampling, search
from waymark.sources import pages, sinks
from waymark.streaming import memory


def test_feeds(spark):
    rows = spark.createDataFrame([(1, "p1", "displayable", 1.0, 2.0), (2, "p2", "suppressed", 3.0, 4.0), (3, "p3", "missing", None, None)], "id long, provider_id string, status string, lat double, lng double")
    shown = {r.id: (r.lat, r.lng) for r in sinks.for_map(rows).collect()}
    assert shown == {1: (1.0, 2.0), 2: (None, None), 3: (None, None)} and "provider_id" not in sinks.for_map(rows).columns
    assert tuple(sinks.map_summary(rows).first()) == (1, 1, 1)
    feature = json.loads(rows.select(sinks.point(F.col("lng"), F.col("lat"), id=F.col("id")).alias("f")).first().f)
    assert feature["geometry"]["coordinates"] == [2.0, 1.0] and feature["properties"] == {"id": 1}
    assert tuple(sinks.bounding_box(rows).first()) == (1.0, 3.0, 2.0, 4.0)
    assert sinks.grid_clusters(rows.where("lat IS NOT NULL"), 0.1).first().n == 2
    assert json.loads(sinks.feed(rows, "id", "status").first().json)["status"] == "displayable"


def test_stages_stop_once_verified(spark):
    rows = [(1, 1, "a", 0.0, 0.0, 4, "x", "x", 5, 1), (1, 2, "b", 0.0, 0.001, 4, "x", "x", 4, 2), (1, 3, "admin", 9.0, 9.0, 0, None, "x", 9, 3), (2, 1, "a", 0.0, 0.0, 4, None, None, 4, 1)]
    df = spark.createDataFrame(rows, "entity long, seq long, path string, lat double, lng double, tier int, postcode string, want_postcode string, score int, stage int")
    got = {r.entity: (r.stage, r.verification, r.path) for r in candidates.staged(df, stages=3).collect()}
    assert got == {1: (2, "verified", "a"), 2: (3, "unverified", "a")}


def test_round_robin_over_strata(spark):
    rows = spark.createDataFrame([(f"k{i}", "big" if i < 30 else "small" if i < 33 else "tiny") for i in range(34)], "id string, s string")
    got = [r.s for r in sampling.round_robin(rows, "s", "id", 8).collect()]
    assert got == ["big", "small", "tiny", "big", "small", "big", "small", "big"]


def test_listing(spark):
    html = "".join(f'<a href="/centre/{s}?x=1">x</a>' for s in ("a", "b%20c", "a"))
    rows = spark.createDataFrame([("FR", 2, html), ("DE", 1, '<a href="/centre/a">x</a>')], "country string, ordinal int, html string")
    assert {r.slug: r.country for r in pages.listed_countries(rows, "/centre/").collect()} == {"a": "DE", "b c": "FR"}


def test_neighbours(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 4)], "a long, b long")
    assert {r.node: r.others for r in repair.both_ways(links).collect()} == {1: [2], 2: [1, 3], 3: [2]}


def test_price_ceiling(spark):
    one = spark.createDataFrame([("USD", 10.2), (None, None)], "currency string, price double")
    two = one.unionByName(spark.createDataFrame([("EUR", 5.0)], "currency string, price double"))
    assert search.price_ceiling(one).first().ceiling == 11 and search.price_ceiling(two).first().ceiling is None


def test_streamed_first_sightings(spark, tmp_path):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("a", day), ("a", day + dt.timedelta(hours=1)), ("b", day)], "slug string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("slug string, ts timestamp").parquet(str(tmp_path / "in"))
    run = lambda: memory.drain(spark, memory.first_seen(stream, "slug", "ts"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.slug for r in run().collect()) == ["a", "b"]
    spark.createDataFrame([("a", day + dt.timedelta(hours=2)), ("c", day)], "slug string, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r.slug for r in run().collect()) == ["a", "b", "c"]  # what was seen before the restart is remembered


def test_cascade(spark):
    """A ladder over hand-made answers: each entity is settled at its own rung."""
    from waymark.operators import cascade

    ladder = [cascade.Rung("embed"), cascade.Rung("address", unless_verified=True), cascade.Rung("text", unless_verified=True, unless_answered="address"), cascade.Rung("postcode", while_coarse=True), cascade.Rung("city", if_empty=True), cascade.Rung("local", unless_verified=True)]
    answer = lambda e, rung, seq, path, lat, precision, country="US": (e, rung, seq, "s", path, lat, 5.0, precision, None, f"city {rung}", "r", country, "p")
    rows = [
        answer(1, "embed", 1, "page_embed", 10.0, "street"), answer(1, "address", 2, "address", 10.001, "rooftop"), answer(1, "local", 3, "venue_name", 10.0, "rooftop"),  # agree at the second rung
        answer(2, "address", 1, "address", 20.0, "country"), answer(2, "text", 2, "text", 20.0, "rooftop"), answer(2, "postcode", 3, "address", 20.5, "postcode"), answer(2, "city", 4, "address", 20.6, "city"), answer(2, "local", 5, "venue_name", 20.5, "street"),  # the text is not asked; postcode and local agree
        answer(3, "city", 1, "address", 30.0, "city"), answer(3, "text", 2, "address", 31.0, "street", "MX"),  # another country's answer counts as one, but is rejected
        answer(4, "city", 1, "address", 40.0, "city"),
        answer(6, "embed", 1, "page_embed", 10.0, "street"),
    ]
    answers = spark.createDataFrame(rows, "entity long, rung string, seq long, source string, path string, lat double, lng double, precision string, postcode string, city string, region string, country string, place_id string")
    entities = spark.createDataFrame([(i, f"a{i}", "US", None, None) for i in range(1, 8)], "entity long, raw string, country string, want_postcode string, want_city string")
    kept = lambda e, raw, **more: {"entity": e, "raw": raw, "lat": 1.0, "lng": 1.0, "precision": "rooftop", "source": "google", "system": "WGS84", "verification": "verified", "confidence": 0.9, "paths": ["a", "b"], "agreement_km": 0.1, "place_id": "x", "city": "Town", "city_source": None, "region": "R", "postcode": "P"} | more
    prior = [kept(3, "a3", verification="unverified"), kept(4, "moved"), kept(5, "a5", lat=None, city="12 St"), kept(6, "a6"), kept(7, "a7", lat=80.0, city="Far")]
    schema = "entity long, raw string, lat double, lng double, precision string, source string, system string, verification string, confidence double, paths array<string>, agreement_km double, place_id string, city string, city_source string, region string, postcode string"
    before = spark.createDataFrame([tuple(p.values()) for p in prior], schema)
    bounds = spark.createDataFrame([("US", 0.0, 50.0, 0.0, 50.0)], "country string, south double, north double, west double, east double")
    got = {r.entity: (r.settled, r.verification, r.lat, r.city, r.city_source) for r in cascade.located(entities, before, answers, bounds, ladder).collect()}
    assert got == {
        1: ("address", "verified", 10.001, "city address", "geocoder"), 2: ("local", "verified", 20.5, "city local", "geocoder"), 3: (None, None, None, "Town", "legacy"), 4: (None, "unverified", 40.0, "Town", "legacy"),
        5: (None, None, None, None, None), 6: ("prior", "verified", 1.0, "Town", "legacy"), 7: (None, None, None, "Far", "legacy"),
    }
    again = {r.entity: r.settled for r in cascade.located(entities, before, answers, bounds, ladder, again=True).collect()}
    assert again[6] is None
    legacy = {r.entity: (r.settled, r.precision, r.confidence, r.paths, r.region) for r in cascade.located(entities, before, answers, bounds, ladder, keep_legacy=True).collect()}
    assert legacy[6] == ("legacy", "street", 0.4, ["address"], None) and legacy[3][0] == "legacy" and legacy[7][0] is None
    use = {r.rung: (r.asked, r.settled) for r in cascade.ladder_use(entities, before, answers, bounds, ladder).collect()}
    assert use["address"] == (4, 1) and use["text"] == (2, 0) and use["local"] == (3, 1) and use["city"] == (1, 0)


def test_many_answers_of_one_entity_meet_in_cells(spark):
    from waymark.operators import cascade

    rows = spark.range(40_000).selectExpr("1L AS entity", "if(id % 2 = 0, 'a', 'b') AS rung", "if(id % 2 = 0, 'p', 'q') AS path", "cast(id % 200 as double) / 10 AS lat", "if(id % 2 = 0, 0.0D, 1.0D) AS lng", "3 AS tier", "CAST(NULL AS STRING) AS postcode", "CAST(NULL AS STRING) AS want_postcode", "3 AS score")
    got = cascade.climbed(rows, [cascade.Rung("a"), cascade.Rung("b", unless_verified=True)]).collect()
    assert [(r.asked, r.settled) for r in got] == [(3, None)]


def test_embedded_points_in_both_datums(spark):
    from waymark.functions import geo
    from waymark.operators import cascade

    rows = spark.createDataFrame([(1, "CN", 39.9, 116.4), (2, "FR", 48.8, 2.3), (3, "CN", 60.0, 116.4), (4, "CN", None, None)], "entity int, country string, lat double, lng double")
    bounds = spark.createDataFrame([("CN", 18.0, 54.0, 73.0, 135.0)], "country string, south double, north double, west double, east double")
    got = cascade.interpretations(rows, bounds)
    points = sorted((r.entity, round(r.lat, 4), round(r.lng, 4)) for r in got.where("lat IS NOT NULL").collect())
    assert points == [(1, 39.8986, 116.3938), (1, 39.9, 116.4), (2, 48.8, 2.3)]
    back = got.where("entity = 1").select(geo.to_shifted(F.col("lat"), F.col("lng")).alias("s")).select("s.*").collect()
    assert any(abs(r.lat - 39.9) < 1e-9 and abs(r.lng - 116.4) < 1e-9 for r in back)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
