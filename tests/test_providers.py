import pytest
from pyspark.sql import functions as F

from waymark.functions import providers
from waymark.operators.search import Search, from_query, to_query


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def types(*names):
    return F.array(*map(F.lit, names)).cast("array<string>")


@pytest.mark.parametrize("rank, kind, city, want", [(30, "x", None, "rooftop"), (27, "x", None, "street"), (22, "x", None, "postcode"), (4, "x", "Town", "city"), (4, "x", None, "country"), (30, "postcode", None, "postcode"), (None, None, None, "country")])
def test_rank(spark, rank, kind, city, want):
    assert value(spark, providers.precision_by_rank(F.lit(rank).cast("int"), F.lit(kind).cast("string"), F.lit(city).cast("string"))) == want


@pytest.mark.parametrize("names, location, want", [(["premise"], "ROOFTOP", "rooftop"), (["premise"], None, "street"), (["route"], "ROOFTOP", "street"), (["postal_code_prefix"], None, "postcode"), (["locality", "country"], None, "city"), ([], "GEOMETRIC_CENTER", "street"), ([], None, "city")])
def test_address_types(spark, names, location, want):
    assert value(spark, providers.precision_of_address(types(*names), F.lit(location).cast("string"))) == want


def test_places_and_levels(spark):
    assert value(spark, providers.precision_of_place(types("school"))) == "rooftop"
    assert value(spark, providers.precision_of_place(types("locality"))) == "city"
    assert value(spark, providers.precision_of_chinese_level(F.lit("兴趣点"))) == "rooftop"
    assert value(spark, providers.precision_of_chinese_level(F.lit(None).cast("string"))) == "city"
    assert value(spark, providers.precision_of_indian_level(F.lit("House Number"))) == "rooftop"


def test_local_addresses(spark):
    assert value(spark, providers.joined_once(types("北京市", "海淀区", None, "北京", "1号"))) == "北京市海淀区1号"
    assert value(spark, providers.street_numbers(F.lit("12 Road 000 5"))) == ["12", "5"]
    assert value(spark, providers.street_numbers_of_lines(types("Room 9", "88 Nanjing Lu"))) == ["88"]


def test_review(spark):
    s = lambda v: F.lit(v).cast("string")
    assert value(spark, providers.review_issues(s("conflicted"), s("city"), F.lit(0.2))) == ["verification", "precision", "confidence"]
    assert value(spark, providers.review_issues(s("verified"), s("street"), F.lit(0.6))) == []
    assert value(spark, providers.review_issues(s(None), s(None), F.lit(None).cast("double"))) == []
    got = value(spark, providers.approved(types("osm"), F.lit(0.3), "street"))
    assert (got.precision, got.verification, got.paths, got.confidence) == ("street", "verified", ["osm", "admin"], 0.9)
    assert value(spark, providers.confirmation_token(F.lit(1.5), F.lit(None).cast("double"))) is None


def test_search_parameters():
    ask = from_query("?module=academic&module=nonsense&delivery=paper&test=ukvi")
    assert ask == Search(modules=("academic",), modes=("paper",))
    assert from_query("test=ukvi") == Search(kinds=("ukvi",)) and from_query("module=") == Search(modules=())
    assert from_query(to_query(ask)) == ask and to_query(Search()) == ""
