import random

from pyspark.sql import functions as F

from waymark.operators import candidates, entities, matching, overlay, quality, search, snapshot
from waymark.operators.components import components
from waymark.sources import pages, sinks


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(links).collect()}
    assert {roots[i] for i in range(n)} == {0} and roots[1001] == 1000


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sparse_links_connect_the_same_pages(spark):
    cols = "slug string, name string, external_id string, operator string, operator_source string, address string, city string, postcode string, lat double, lng double"
    rng = random.Random(3)
    pick = lambda *of: rng.choice(of)
    rows = [(f"page{i:03d}", pick("Town Hall", "Town Hall East", "Old Mill Campus", "", None), pick(None, None, "", "7", "8"), pick("X", "Y", None), pick("booking_domain", "slug", None), pick("1 Long Road Town", "2 Long Road Town", "short", None), "T", "P", None, None) for i in range(90)]
    found = entities.indexed(spark.createDataFrame([*rows, rows[0], rows[7]], cols)).cache()
    every, sparse = entities.links(found), entities.links(found, every=False)
    clusters = lambda links: sorted((r.slug, r.cluster) for r in entities.clusters(found, links).collect())
    assert clusters(sparse) == clusters(every)
    assert len({c for _, c in clusters(every)}) > 10
    count = lambda links: links.where("reason = 'operator_address'").distinct().count()
    assert count(sparse) < count(every), (count(sparse), count(every))


def test_clusters_do_not_depend_on_order(spark):
    cols = "slug string, name string, external_id string, operator string, operator_source string, address string, city string, postcode string, lat double, lng double"
    rows = [("a-1", "Hall", "7", "X", "booking_domain", "1 Long Road Town", "T", "P", None, None), ("a-2", "Hall", None, "X", "slug", "2 Long Road Town", "T", "P", None, None), ("b", "Hall", "7", "X", "slug", None, None, None, None, None), ("c", "Hall", "8", "Y", "booking_domain", "1 Long Road Town", "T", "P", None, None)]
    want = None
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        found = entities.indexed(spark.createDataFrame(rows, cols))
        got = {r.slug: r.cluster for r in entities.clusters(found, entities.links(found)).collect()}
        assert want is None or got == want
        want = got
    assert want == {"a-1": "a-1", "a-2": "a-1", "b": "a-1", "c": "c"}


def test_same_snapshot_has_no_difference(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, None, 2.0)], "id long, a string, b double")
    diff = snapshot.difference(rows, rows, "id", ["a", "b"])
    assert {r.change for r in diff.collect()} == {"unchanged"}
    assert snapshot.summary(diff).first().meaningful is False


def test_publication_gate(spark, tmp_path):
    before, after = spark.range(100).withColumn("a", F.lit(1)), spark.range(60).withColumn("a", F.lit(1))
    diff = snapshot.difference(before, after, "id", ["a"])
    try:
        sinks.publish(after, diff, str(tmp_path / "out"))
        raise AssertionError("published")
    except sinks.UnsafePublication:
        pass
    assert sinks.publish(after, diff, str(tmp_path / "out"), allow=True).removed == 40


def test_verified_implies_two_paths_or_admin(spark):
    rows = [(1, 1, "osm", 10.0, 10.0, 4, "a", "a", 5), (1, 2, "poi", 10.0, 10.001, 4, "a", "a", 4), (2, 1, "osm", 0.0, 0.0, 4, None, None, 4), (2, 2, "poi", 5.0, 0.0, 4, None, None, 4), (3, 1, "admin", 0.0, 0.0, 0, None, None, 0), (4, 1, "osm", 0.0, 0.0, 1, None, None, None)]
    df = spark.createDataFrame(rows, "entity long, seq long, path string, lat double, lng double, tier int, postcode string, want_postcode string, score int")
    got = {r.entity: (r.verification, r.confidence) for r in candidates.resolve(df).collect()}
    assert got == {1: ("verified", 0.95), 2: ("conflicted", 0.2), 3: ("verified", 0.98)}


def test_explicit_null_overwrites(spark):
    rows = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "id long, name string, price double")
    patches = spark.createDataFrame([(1, {"name": None, "price": "3.5"})], "id long, patch map<string,string>")
    got = {r.id: (r.name, r.price) for r in overlay.applied(rows, patches, {"name": "string", "price": "double"}).collect()}
    assert got == {1: (None, 3.5), 2: ("y", 2.0)}


def test_two_overrides_of_one_id(spark):
    patches = spark.createDataFrame([(1, {"a": "b"}), (1, {"a": "c"})], "id long, patch map<string,string>")
    try:
        overlay.checked(patches)
        raise AssertionError("not noticed")
    except ValueError:
        pass


def test_modes(spark):
    rows = spark.createDataFrame([("life_skills", "Life Skills", "x"), ("academic", "Academic, writing on paper", "computer_delivered"), ("academic", "Academic", "paper_based")], "m string, l string, f string")
    got = [r[0] for r in rows.select(search.mode_of(F.col("m"), F.col("l"), F.col("f"))).collect()]
    assert got == [None, "paper_writing", "paper"]


def test_lineage(spark):
    got = spark.range(1).select(matching.lineage(F.lit('[{"element":{"license":"B"}},{"license":"A"},{"license":"B"}]')).alias("v")).first().v
    assert got == ["A", "B"]


def test_decision_without_issues_is_ready(spark):
    assert quality.analysed(spark.range(1).withColumn("publishable", F.lit(True)), []).first().decision == "ready"


def test_sitemap(spark):
    maps = spark.createDataFrame([(2, "<loc>https://x/testcentres/b</loc>"), (1, "<loc>https://x/testcentres/a/</loc><loc>https://x/other</loc><loc>https://x/testcentres/b</loc>")], "page int, xml string")
    got = {(r.slug, r.page) for r in pages.sitemap_slugs(maps, "/testcentres").collect()}
    assert got == {("a", 1), ("b", 1)}


def test_missing_json_is_none(spark, tmp_path):
    assert pages.versioned(spark, str(tmp_path / "none.json"), "version int", 1) is None


def test_large_blocks_are_named_or_compared(spark):
    rows = entities.indexed(spark.createDataFrame([(f"s{i}", f"Hall {i}", None, "IDP", "slug", "", "Oslo", "0150", 1.0, 1.0) for i in range(12)], "slug string, name string, external_id string, operator string, operator_source string, address string, city string, postcode string, lat double, lng double"))
    alone = rows.select("slug", F.col("slug").alias("cluster"))
    assert {tuple(r) for r in entities.left_out(rows, alone, (2, 10)).collect()} == {("pc:0150", 12), ("city:oslo", 12)} and entities.left_out(rows, alone, (2, None)).count() == 0
    assert entities.pending(rows, alone, (2, 10)).count() == 0 and entities.pending(rows, alone, (2, None)).count() > 0
