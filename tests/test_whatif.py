"""Proposals that are judged by analysing the record they would make."""

import pytest

from waymark.operators import quality, whatif

PLACE = dict(
    id="a", name="Centre", address="1 Main Street, Toronto", address_lines=2, country="CA", n_sources=1, operator="IDP", operator_source="booking_domain", booking_url="u", retake_only=False, n_offers=1, n_priced=1, n_unparsed=0, n_currencies=1,
    n_unclassified=0, bad_price=False, pending=False, n_contacts=1, publishable=True, place_id="p", confidence=0.9, city="Old Toronto", city_source="legacy", region="ON", postcode="M5V 1A1",
)
GEO = dict(lat=43.65, lng=-79.38, precision="street", source="google", verification="verified", confidence=0.8, paths=["address", "venue_name"], agreement_km=0.05)
WEAK = GEO | dict(verification="unverified", paths=["address"], agreement_km=None, confidence=0.4)
POINT = "struct<lat:double,lng:double,precision:string,source:string,verification:string,confidence:double,paths:array<string>,agreement_km:double>"
MORE = f"geo {POINT}, place_id string, confidence double, city string, city_source string, region string, postcode string"
SCHEMA = (
    "id string, name string, address string, address_lines int, country string, n_sources int, operator string, operator_source string, booking_url string, retake_only boolean, n_offers int, n_priced int, n_unparsed int, n_currencies int, "
    f"n_unclassified int, bad_price boolean, pending boolean, n_contacts int, publishable boolean, {MORE}"
)


@pytest.fixture(scope="module")
def tried(spark):
    names = [f.strip().split()[0] for f in MORE.replace(POINT, "x").split(",")]
    cases = {
        # (geo, changes of the place), (geo, changes of the proposal)
        "city": ((GEO, {}), (GEO, dict(city="Toronto", city_source="geocoder"))),
        "legacy_again": ((GEO, {}), (GEO, dict(city="Toronto", city_source="legacy"))),
        "still_weak": ((WEAK, dict(city_source="rule")), (WEAK | dict(lat=43.7), {})),
        "verified_now": ((WEAK, dict(city_source="rule")), (GEO | dict(lat=43.66), dict(place_id="q"))),
        "too_far": ((WEAK, dict(city_source="rule")), (GEO | dict(lat=44.65), {})),
        "abroad": ((None, dict(city_source="rule", country="XX")), (GEO, {})),
        "found": ((None, dict(city=None)), (GEO, dict(city="Toronto", city_source="geocoder"))),
        "admin": ((WEAK | dict(source="admin"), {}), (GEO, {})),
        "admin_city": ((WEAK, dict(city_source="admin")), (GEO, {})),
        "one_path": ((WEAK, dict(city_source="rule")), (GEO | dict(paths=["address"]), {})),
        "nothing_wrong": ((GEO, dict(city_source="rule")), (GEO | dict(lat=43.66), dict(city="Other", city_source="geocoder"))),
        "nothing_new": ((GEO, {}), (GEO, dict(city=None))),
        "unproposed": ((GEO, {}), None),
    }
    places, proposals = [], []
    for key, ((g, change), new) in cases.items():
        places.append({**PLACE, **change, "id": key, "geo": g})
        if new:
            proposals.append({"id": key, **{n: (PLACE | {"city_source": "rule", "geo": new[0]} | new[1])[n] for n in names}})
    bounds = spark.createDataFrame([("CA", 41.0, 84.0, -142.0, -52.0), ("XX", 0.0, 10.0, 0.0, 10.0)], "country string, south double, north double, west double, east double")
    rows = spark.createDataFrame(places, SCHEMA)
    attempts = whatif.attempted(rows, spark.createDataFrame([*proposals, {**proposals[0], "id": "unknown"}], f"id string, {MORE}"), bounds)
    return rows, attempts, {r.id: r for r in attempts.collect()}


def test_outcomes(tried):
    assert {k: (r.outcome, r.reason, r.changed) for k, r in tried[2].items()} == {
        "city": ("accepted", "city", ["city"]), "legacy_again": ("unchanged", "same_result", []), "still_weak": ("unchanged", "same_result", []), "verified_now": ("accepted", "location", ["location", "place_id"]), "too_far": ("rejected", "too_far", []),
        "abroad": ("rejected", "new_issues", ["location"]), "found": ("accepted", "location+city", ["city", "location"]), "admin": ("skipped_admin", "reviewed_evidence", []), "admin_city": ("skipped_admin", "reviewed_evidence", []),
        "one_path": ("rejected", "new_issues", ["location"]), "nothing_wrong": ("unchanged", "same_result", []), "nothing_new": ("unchanged", "same_result", []),
    }


def test_issues_of_both_versions(tried):
    found = tried[2]
    assert (found["found"].targeted, found["found"].before_issues, found["found"].after_issues) == (["missing_city", "missing_location"], ["missing_city", "missing_location"], [])
    assert found["abroad"].after_issues == ["location_outside_country"] and found["too_far"].after_issues == found["too_far"].before_issues == ["location_not_verified"]


def test_only_accepted_repairs_are_applied(tried):
    rows, attempts, _ = tried
    got = {r.id: r for r in whatif.repaired(rows, attempts).collect()}
    assert whatif.repaired(rows, attempts).columns == rows.columns and len(got) == 13
    assert got["city"].city == "Toronto" and got["city"].geo.lat == 43.65 and got["verified_now"].geo.lat == 43.66 and got["verified_now"].place_id == "q" and got["too_far"].geo.lat == 43.65 and got["unproposed"].city == "Old Toronto" and got["abroad"].geo is None


def test_the_rules_can_be_others(spark, tried):
    rule = quality.Rule("legacy_city", "info", "none", lambda: rules_city())
    from pyspark.sql import functions as F

    def rules_city():
        return F.col("city_source") == "legacy"

    rows, bounds = tried[0], spark.createDataFrame([], "country string, south double, north double, west double, east double")
    proposals = rows.where("id = 'city'").select("id", "geo", "place_id", "confidence", F.lit("T").alias("city"), F.lit("rule").alias("city_source"), "region", "postcode")
    assert whatif.attempted(rows, proposals, bounds, [rule]).first().outcome == "accepted"


def test_address_points_against_the_plain_disjunction(spark):
    import random

    from waymark.operators import matching

    rng = random.Random(3)
    streets = ["Main Street", "main road north", "Grand Ave", "Av", "", None, "Kingsway", "Grandmain Sq"]
    samples = [(i, rng.choice("AB"), rng.choice(["K1A 0B1", "k1a0b2", "", None]), rng.sample(["main", "street", "grand", "king", "av", "north"], rng.randint(0, 4)), [str(rng.randint(1, 4)) for _ in range(rng.randint(0, 3))]) for i in range(60)]
    points = [(i, rng.choice("AB"), rng.choice(["K1A0B1", "K1A 0B2", "", None]), rng.choice(["1", "2b", "No. 3", "", None, "14"]), rng.choice(streets)) for i in range(200)]
    want = set()
    for i, c, code, tokens, numbers in samples:
        for a, c2, code2, number, street in points:
            key = lambda x: (x or "").lower().replace(" ", "")
            p = key(code) != "" and key(code) == key(code2)
            n = "".join(x for x in number or "" if x.isdigit()) in set(numbers) - {""}
            s = any(len(x) >= 3 and x in (street or "").lower() for x in tokens)
            if c == c2 and (p and (s or n) or n and s):
                want.add((i, a, tuple(e for e, has in (("postcode", p), ("number", n), ("street", s)) if has)))
    left = spark.createDataFrame(samples, "id long, country string, postcode string, tokens array<string>, numbers array<string>")
    right = spark.createDataFrame(points, "aid long, country string, postcode string, number string, street string")
    got = [(r.id, r.aid, tuple(r.evidence)) for r in matching.addressed(left, right, most=None).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({e for *_, e in want}) == 4
    best = matching.addressed(left, right, most=3).collect()
    assert {r.id: r.n_found for r in best} == {i: sum(x == i for x, *_ in want) for i, *_ in want} and all(sum(r.id == i for r in best) == min(3, sum(x == i for x, *_ in want)) for i in {x for x, *_ in want})


def test_tokens_in_texts(spark):
    from waymark.operators import matching

    texts = spark.createDataFrame([(1, "x", "the kings cross"), (2, "x", "cross the king"), (3, "y", "kings"), (4, "x", ""), (5, "x", None), (6, "x", "ki")], "cid long, c string, text string")
    tokens = spark.createDataFrame([(1, "x", "kings"), (1, "x", "cross"), (2, "y", "kings"), (3, "x", "queen"), (4, "x", "ki"), (5, "x", None), (6, "x", "s c"), (1, "x", "kings")], "id long, c string, token string")
    assert sorted(tuple(r) for r in matching.containing(tokens, texts).collect()) == [(1, "cross", 1), (1, "cross", 2), (1, "kings", 1), (2, "kings", 3), (6, "s c", 1)]
