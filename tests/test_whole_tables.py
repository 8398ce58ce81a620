"""Rows that only larger tables have, and tables made of many copies, compared with SQL or with plain versions."""

import time

import pytest
from pyspark.sql import functions as F

from tests.oracle import same_rows
from waymark import plans
from waymark.functions import geo
from waymark.operators import elements, pairing

BIG = "/root/testdata/sf0.1"


def _copy(spark, to, rows):
    """A directory with the given tables, each as one file."""
    for name, df in rows.items():
        df.coalesce(1).write.parquet(f"{to}/{name}.parquet")
    return str(to)


@pytest.mark.parametrize("name", ["remediation_attempts", "remediated_records"])
def test_proposals_beyond_the_pole(spark, tmp_path, name):
    customers = spark.read.parquet(f"{BIG}/customer.parquet").where("c_custkey IN (12247, 12963) OR c_custkey < 50")
    sf = _copy(spark, tmp_path, {"customer": customers, "nation": spark.read.parquet(f"{BIG}/nation.parquet")})
    same_rows(plans.QUERIES[name](spark, sf), sf, plans.ORACLE_SQL[name])


def test_long_text_behind_the_last_tag(spark):
    rows = [(1, "<li>a" + "x" * 400_000), (2, "<li>b</li>" + "y" * 400_000), (3, "z" * 400_000), (4, None)]
    began = time.time()
    found = elements.balanced(spark.createDataFrame(rows, "id long, html string"), "li").select("id", "n", "start", F.length("element").alias("size")).collect()
    assert sorted(map(tuple, found)) == [(1, 1, 0, 400_005), (2, 1, 0, 10)]
    assert time.time() - began < 60  # the square of a text's length took minutes


PAIRED = ["name_similarity_parts", "token_and_bigram_dice_parts", "venue_identity_parts"]


@pytest.mark.parametrize("name", [*PAIRED, "candidate_match_decision"])
def test_pairs_of_one_small_file_are_spread(spark, name):
    """A table of one file is small when read, but not its pairs: they were all made in one task."""
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


@pytest.mark.parametrize("name", PAIRED)
def test_pairs_of_copies(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(pairing, "PER_ROW", 3)
    monkeypatch.setattr(pairing, "PER_TASK", 5)
    few = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_partkey < 4").withColumns({"p_brand": F.lit("B"), "p_size": F.lit(1)})
    copies = few.crossJoin(spark.range(5).toDF("i")).withColumn("p_partkey", F.col("p_partkey") + 7 * F.col("i")).drop("i")
    sf = _copy(spark, tmp_path, {"part": copies})
    same_rows(plans.QUERIES[name](spark, sf), sf, plans.ORACLE_SQL[name])


def test_pairs_keep_missing_values(spark):
    rows = spark.createDataFrame([(1, 3, None), (1, 1, "a"), (1, 2, None), (1, None, "a"), (None, 5, "a"), (None, 6, "a")], "g int, k int, v string")
    found = pairing.within(rows, ["g"], "k", "v", {"v": F.col("v")}, lambda a, b: {"s": F.concat(a("v"), b("v"))})
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == ["(1, 2, None)", "(1, 3, None)", "(2, 3, None)"]


@pytest.mark.parametrize("name", ["discovery_paths", "candidate_discovery"])
def test_candidates_without_broadcasts(spark, name):
    """A broadcast of texts or indexes lies whole in the driver."""
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_radius_is_spread(spark):
    assert plans.QUERIES["haversine_radius"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_legacy_places_need_no_answers(spark, tmp_path):
    sf = _copy(spark, tmp_path, {"orders": spark.read.parquet("/root/testdata/sf0.001/orders.parquet")})
    same_rows(plans.QUERIES["location_legacy"](spark, sf), sf, plans.ORACLE_SQL["location_legacy"])


def test_coarse_cells_hold_what_is_near(spark):
    rows = spark.range(2000).select((F.rand(1) * 180 - 90).alias("lat"), (F.rand(2) * 360 - 180).alias("lng"), ((F.rand(3) - 0.5) / 60).alias("dx"), ((F.rand(4) - 0.5) / 60).alias("dy"))
    near = rows.where(geo.haversine_km(F.col("lat"), F.col("lng"), F.col("lat") + F.col("dy"), F.col("lng") + F.col("dx")) <= 0.75)
    around = geo.cells_around(F.col("lat"), F.col("lng"), 0.75, 4)
    found = near.select(F.size(around).alias("n"), F.array_contains(around, geo.cell(F.col("lat") + F.col("dy"), F.col("lng") + F.col("dx"), 0.75, 4)).alias("met"))
    n, met, cells = found.agg(F.count("*"), F.count_if("met"), F.percentile("n", 0.5)).first()
    assert n > 100 and met == n and cells <= 4


def test_address_points_are_counted_not_paired(spark):
    """A hundred million pairs of 2,000 samples and 50,000 points that are all alike took minutes; the first ones and their number do not."""
    from waymark.operators import matching

    samples = spark.range(2000).select("id", F.lit("A").alias("country"), F.when(F.col("id") > 0, "K1").alias("postcode"), F.array(F.lit("main"), F.lit("road")).alias("tokens"), F.array(F.lit("1"), F.lit("2")).alias("numbers"))
    points = spark.range(50_000).select(F.col("id").alias("aid"), F.lit("A").alias("country"), F.when(F.col("id") % 5 > 0, "k 1").alias("postcode"), F.when(F.col("id") % 3 > 0, "1").alias("number"), F.when(F.col("id") % 2 > 0, "Main Road").alias("street"))
    began = time.time()
    rows = matching.addressed(samples, points, most=4).orderBy("id", "aid").collect()
    assert time.time() - began < 60
    coded, number, street = ({i for i in range(50_000) if f(i)} for f in (lambda i: i % 5 > 0, lambda i: i % 3 > 0, lambda i: i % 2 > 0))
    every = coded & (number | street) | number & street
    assert len(rows) == 8000 and {r.n_found for r in rows if r.id} == {len(every)} and {r.n_found for r in rows if not r.id} == {len(number & street)}
    assert [(r.aid, r.evidence) for r in rows[4:8]] == [(1, ["postcode", "number", "street"]), (2, ["postcode", "number"]), (3, ["postcode", "street"]), (4, ["postcode", "number"])]
    assert [(r.aid, r.evidence) for r in rows[:4]] == [(i, ["number", "street"]) for i in (1, 5, 7, 11)]


@pytest.mark.parametrize("most", [1, 3, 20])
def test_first_address_points_are_those_of_all_pairs(spark, most):
    import random

    from waymark.operators import matching

    rng = random.Random(most)
    streets = ["Main Street", "main road north", "Grand Ave", "", None, "Grandmain Sq"]
    samples = [(i, rng.choice("AB"), rng.choice(["K1A", "k1 b", "", None]), rng.choice([None, ["main", "street"], ["grand", "ave", "av"], []]), rng.choice([None, [], ["1", "2", "1"], ["3"]])) for i in range(80)]
    points = [(i, rng.choice("AB"), rng.choice(["K1A", "K1B", "", None]), rng.choice(["1", "2b", "3", "", None]), rng.choice(streets)) for i in range(150)]
    left = spark.createDataFrame(samples, "id long, country string, postcode string, tokens array<string>, numbers array<string>")
    right = spark.createDataFrame(points, "aid long, country string, postcode string, number string, street string")
    every = {}
    for r in matching.addressed(left, right, most=None).collect():
        every.setdefault(r.id, []).append((not r.postcode_matches, r.aid, tuple(r.evidence)))
    want = {(i, aid, e, not p, len(v)) for i, v in every.items() for p, aid, e in sorted(v)[:most]}
    got = [(r.id, r.aid, tuple(r.evidence), r.postcode_matches, r.n_found) for r in matching.addressed(left, right, most=most).collect()]
    assert set(got) == want and len(got) == len(want) and any(len(v) > most for v in every.values())


@pytest.mark.parametrize("name", ["dedup_near_links", "dedup_pending_links"])
def test_pairs_for_a_reviewer_are_spread(spark, monkeypatch, name):
    """The pairs of all cities were made in one task, as the pages are few when read."""
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
    monkeypatch.setattr(pairing, "PER_TASK", 30)  # blocks of several parts
    same_rows(plans.QUERIES[name](spark, "/root/testdata/sf0.01"), "/root/testdata/sf0.01", plans.ORACLE_SQL[name])


def test_a_pair_of_two_blocks_is_told_once(spark):
    from waymark.operators import entities

    pages = [(f"s{i}", f"Hall {i % 3}", None, "IDP", "slug", "", "Town" if i % 4 else None, ["k1 a", "K1A", "", None][i // 3 % 4], 59.0 if i % 5 else None, 10.0) for i in range(40)]
    rows = entities.indexed(spark.createDataFrame(pages, "slug string, name string, external_id string, operator string, operator_source string, address string, city string, postcode string, lat double, lng double"))
    cluster_of = rows.select("slug", "slug")
    cluster_of = cluster_of.toDF("slug", "cluster")
    for block in ((2, None), (2, 15), (16, None)):
        want, own = set(), rows.collect()
        size = lambda kind, v: sum(getattr(r, kind) == v for r in own)
        fits = lambda n: block[0] <= n <= (block[1] or n)
        for x in own:
            for y in own:
                both = [k for k in ("postcode", "city") if getattr(x, k) is not None and getattr(x, k) == getattr(y, k) and fits(size(k, getattr(x, k)))]
                if x.slug < y.slug and both and x.key == y.key:
                    code, near = bool(x.postcode) and x.postcode == y.postcode, x.lat is not None and y.lat is not None
                    if code or near:
                        want.add((x.slug, y.slug, "name_postcode" if code else "name_proximity"))
        got = [(r.a, r.b, r.reason) for r in entities.pending(rows, cluster_of, block).where("strength = 1").collect()]
        assert len(got) == len(set(got)) and set(got) == want and want, block


def test_tasks_of_whole_places_grow_with_the_pages(spark, monkeypatch):
    """The pages of all clusters went to as many tasks as a session has partitions, however many they were."""
    from waymark.operators import assembly

    monkeypatch.setattr(assembly, "PER_TASK", 200)
    found = plans.QUERIES["whole_places"](spark, "/root/testdata/sf0.01")
    assert found.rdd.getNumPartitions() == 8  # 1,500 pages
    same_rows(found, "/root/testdata/sf0.01", plans.ORACLE_SQL["whole_places"])


def test_pairs_of_discovery_are_made_where_they_stay(spark):
    """Pairs were shuffled to be made distinct and twice more for their texts, though they are far more than the rows."""
    plan = plans.QUERIES["discovery_paths"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Aggregate" not in plan


def _some_candidates(spark, seed):
    """Samples and candidates with copies, missing values and several contacts, and all their pairs: hits, postcode, contact, two address tokens."""
    import random

    rng = random.Random(seed)
    words = ["hall", "hal", "town", "north", "st", "grand"]
    some = lambda of, n: [rng.choice(of) for _ in range(rng.randrange(n))] if rng.random() < 0.9 else None
    samples = [(i, rng.choice(["A", "B", None]), some(words, 4), rng.choice(["P", "Q", "", None]), some(["x", "y", "z", None], 3), some(["road", "west", ""], 4)) for i in range(60)]
    found = [(i, rng.choice(["A", "B", None]), rng.choice(["hall north", "grand hall", "st town", "", None]), rng.choice(["P", "Q", "", None]), some(["x", "y", "w", None], 3), rng.choice(["West Road", "road", "", None])) for i in range(100)]
    left = spark.createDataFrame(samples, "id long, country string, tokens array<string>, postcode string, contacts array<string>, address_tokens array<string>")
    right = spark.createDataFrame(found, "cid long, country string, text string, postcode string, contacts array<string>, address string")
    pairs = {}
    for i, c, tokens, code, contacts, street in samples:
        for cid, d, text, other, theirs, address in found:
            hits = sum(len(x) >= 3 and x in (text or "") for x in set(tokens or []))
            same, shared = bool(code) and code == other, bool((set(contacts or []) & set(theirs or [])) - {None})
            if c and c == d and (hits or same or shared):
                pairs[i, cid] = hits, same, shared, sum(x != "" and x in (address or "").lower() for x in set(street or [])) >= 2
    return left, right, pairs


@pytest.mark.parametrize("most", [2, 9])
def test_best_candidates_are_those_of_all_pairs(spark, monkeypatch, most):
    from waymark.operators import matching

    monkeypatch.setattr(pairing, "PER_ROW", 3)
    monkeypatch.setattr(pairing, "PER_TASK", 40)  # keys of several shares
    left, right, pairs = _some_candidates(spark, most)
    own = {}
    for (i, cid), (hits, same, shared, _) in pairs.items():
        own.setdefault(i, []).append((not same, -hits, cid, shared))
    want = sorted((i, cid, -hits, not other, shared, len(rows)) for i, rows in own.items() for other, hits, cid, shared in sorted(rows)[:most])
    got = matching.discovered(left, right, most=most).select("id", "cid", "hits", "postcode_matches", "contact_matches", "n_found")
    assert sorted(map(tuple, got.collect())) == want and any(len(rows) > most for rows in own.values())


def test_each_pair_has_all_its_evidence_once(spark, monkeypatch):
    from waymark.operators import matching

    monkeypatch.setattr(pairing, "PER_ROW", 3)
    monkeypatch.setattr(pairing, "PER_TASK", 40)
    left, right, pairs = _some_candidates(spark, 7)
    want = sorted((*k, [n for n, found in (("venue_name", hits > 0), ("address", same or inside), ("contact", shared)) if found]) for k, (hits, same, shared, inside) in pairs.items())
    assert sorted(tuple(r) for r in matching.evidenced(left, right).select("id", "cid", "paths").collect()) == want
    assert matching.discovered(left, right, most=None).count() == len(want)


def test_best_candidates_without_all_pairs(spark):
    """A hundred million pairs of 2,000 samples and 50,000 candidates that are all alike took minutes; the first ones and their number do not."""
    from waymark.operators import matching

    rows = lambda n, key: spark.range(n).select(F.col("id").alias(key), F.lit("A").alias("country"), F.when(F.col("id") % 4 == 1, "K").alias("postcode"), F.array().cast("array<string>").alias("contacts"))
    began = time.time()
    found = matching.discovered(rows(2000, "id").withColumn("tokens", F.array(F.lit("main"))), rows(50_000, "cid").withColumn("text", F.lit("main road")), most=2).collect()
    assert time.time() - began < 60
    assert sorted((r.id, r.cid, r.n_found) for r in found) == [(i, c, 50_000) for i in range(2000) for c in ((1, 5) if i % 4 == 1 else (0, 1))]


def test_the_cascade_shuffles_each_table_once(spark):
    """Answers were shuffled some eight times and written twice."""
    plan = plans.QUERIES["location_cascade"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3


@pytest.mark.parametrize("few", [0, 3])
def test_many_answers_of_an_entity_are_judged_as_few_are(spark, monkeypatch, few):
    from waymark.operators import cascade

    monkeypatch.setattr(cascade, "FEW", few)
    for name in ("location_cascade", "cascade_rungs"):
        same_rows(plans.QUERIES[name](spark, "/root/testdata/sf0.001"), "/root/testdata/sf0.001", plans.ORACLE_SQL[name])


def test_best_candidates_come_from_few_pairs(spark, monkeypatch):
    """All pairs of a key were sorted, to keep five of each sample."""
    monkeypatch.setattr(pairing, "PER_TASK", 1000)
    left, right = (spark.range(600).select(F.col("id").alias(c), F.lit(1).alias("g")) for c in ("p", "s"))
    valued = lambda pairs: pairs.withColumn("_v", (F.col("p") * 7 + F.col("s") * 13) % 101)
    got = [(r.s, r.p) for r in pairing.least(left, right, ["g"], "p", "s", valued, 3).select("s", "p").collect()]
    assert len(got) == len(set(got)) < 600 * 600 / 20
    for s in range(600):
        value = {p: (p * 7 + s * 13) % 101 for p in range(600)}
        bound = sorted(value.values())[2]
        assert {p for p in value if value[p] <= bound} <= {p for x, p in got if x == s} if s % 50 == 0 else True


@pytest.mark.parametrize("shares", [2, 40])
def test_ranks_by_shares_are_those_of_all_pairs(spark, monkeypatch, shares):
    """With two shares a sample has fewer than it wants candidates, and needs all of both."""
    monkeypatch.setattr(pairing, "PER_TASK", 3)
    monkeypatch.setattr(pairing, "SHARES", shares)
    same_rows(plans.QUERIES["candidate_ranking"](spark, "/root/testdata/sf0.01"), "/root/testdata/sf0.01", plans.ORACLE_SQL["candidate_ranking"])
