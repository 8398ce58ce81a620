import pytest
from pyspark.sql import functions as F

from waymark.functions import address, geo, html, numbers, text


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, want",
    [("Québec  City!", "quebec city"), ("", ""), ("北京 Test", "北京 test"), ("Ünï-códe", "uni code")],
)
def test_normalised(spark, raw, want):
    assert value(spark, text.normalised(F.lit(raw))) == want
    assert value(spark, text.normalised(F.lit(raw))) == want


def test_normalised_null(spark):
    assert value(spark, text.normalised(F.lit(None).cast("string"))) is None
    assert value(spark, text.normalised(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("a, b, want", [("", "", 1.0), ("abc", "abc", 1.0), ("abc", "abd", 1 - 1 / 3), ("abc", "", 0.0)])
def test_edit_similarity(spark, a, b, want):
    assert value(spark, text.edit_similarity(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_token_similarity_of_nothing(spark):
    assert value(spark, text.token_similarity(F.lit(""), F.lit(""))) == 0.0


@pytest.mark.parametrize("a, b, want", [("aaa", "aa", 2 / 3), ("night", "nacht", 0.25), ("a", "b", 0.0), ("a", "a", 1.0)])
def test_bigram_dice(spark, a, b, want):
    assert value(spark, text.bigram_dice(F.lit(a), F.lit(b))) == pytest.approx(want)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("CAD 1,234.56", ("CAD", 1234.56, "verified")), ("EUR 1.234,5", ("EUR", 1234.5, "verified")), ("USD 1,234", ("USD", 1234.0, "verified")), ("USD 12,34", ("USD", 12.34, "verified")),
        ("USD 1,234.567", (None, None, "unparsed")), ("12.50", (None, None, "unparsed")), ("  ", (None, None, "missing")), ("AED ١٢٣٤", ("AED", 1234.0, "verified")), ("INR १,२३४", ("INR", 1234.0, "verified")), ("CHF 1'200", ("CHF", 1200.0, "verified")),
        ("USD 500.", ("USD", 500.0, "verified")), ("USD free", (None, None, "unparsed")),
    ],
)
def test_published_price(spark, raw, want):
    got = value(spark, numbers.published_price(F.lit(raw)))
    assert (got.currency, got.price, got.status) == want


def test_fnv(spark):
    assert value(spark, numbers.fnv1a(F.lit("bc-1268"))) == 1170076


def test_wilson_of_nothing(spark):
    assert value(spark, numbers.wilson(F.lit(0), F.lit(0))).low is None


@pytest.mark.parametrize("box, inside", [(dict(north=10, south=-10, east=-170, west=170), True), (dict(north=10, south=-10, east=170, west=-170), False), (dict(north=10, south=-10, east=400, west=0), True), (dict(north=-1, south=-10, east=-170, west=170), False)])
def test_bounds_across_the_antimeridian(spark, box, inside):
    assert value(spark, geo.within_bounds(F.lit(0.0), F.lit(179.0), **box)) is inside


def test_pinnable_of_nothing(spark):
    nothing = F.lit(None).cast("string")
    assert value(spark, geo.pinnable(nothing, nothing, F.lit(None).cast("double"))) is False


@pytest.mark.parametrize("raw, want", [("&amp;lt;", "&lt;"), ("&#65;&#x42;&middot;", "AB&middot;"), ("&#xD800;x", "x"), (None, None)])
def test_entities(spark, raw, want):
    assert value(spark, html.decoded(F.lit(raw).cast("string"))) == want


def test_balanced():
    page = "a<div>x<div>y</div>z</div>b"
    assert html.balanced(page, 1, "div") == "<div>x<div>y</div>z</div>"
    assert html.balanced("<div>open", 0, "div") == "<div>open"


def test_map_centre(spark):
    link = lambda c: F.lit(f'<img src="https://m/staticmap?x=1&amp;center={c}&z=2">')
    assert tuple(value(spark, html.map_centre(link("45.5,-73.6")))) == (45.5, -73.6)
    assert value(spark, html.map_centre(link("0.5,0.5"))) is None
    assert value(spark, html.map_centre(link("95,10"))) is None


@pytest.mark.parametrize(
    "lines, want",
    [
        (["Suite 5", "100 King St", "Calgary", "Alberta", "t2p0t8"], ("Calgary", "AB", "T2P 0T8", "CA")), (["1 Main St", "St Johns (NL)", "A1B 3X2"], ("St Johns", "NL", "A1B 3X2", "CA")), (["5 Smith St", "Darwin, NT", "0800"], (None, "NT", "0800", None)),
        (["10 Elm Street", "Austin, TX 78701"], ("Austin", "TX", "78701", "US")), (["10 Elm Street", "Austin, TX", "78701"], ("Austin", "TX", "78701", "US")), ([], (None, None, None, None)), (None, (None, None, None, None)),
    ],
)
def test_address(spark, lines, want):
    given = F.lit(None).cast("array<string>") if lines is None else F.array(*map(F.lit, lines)).cast("array<string>")
    got = value(spark, address.parsed(given, F.lit(None).cast("string")))
    assert (got["city"], got["region"], got["postcode"], got["country"]) == want


def test_unique_by(spark):
    phones = F.array(*map(F.lit, ("+1 2", "0012", "x", "+3")))
    assert value(spark, text.unique_by(phones, text.phone_identity)) == ["+1 2", "+3"]


def test_numeric_entities_in_texts(spark):
    assert value(spark, html.stripped(F.lit("<p>Tom&#39;s &amp; Ann&#x2019;s</p>\n caf&#233; &bogus;"), html.decoded)) == "Tom's & Ann\u2019s caf\u00e9 &bogus;"


def test_cells_hold_every_point_within_a_radius(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180), rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(3000)]
    rows += [(89.5, 10.0, 89.0, -170.0), (0.0, 179.9, 0.0, -179.9), (-89.9, 0.0, -88.0, 120.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for km in (100, 800, 2500, 9000, 21000):
        near = df.where(geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")) <= km)
        around = geo.cells_around(F.col("c"), F.col("d"), km)
        assert near.where(~F.array_contains(around, geo.cell(F.col("a"), F.col("b"), km))).count() == 0
        assert df.where(F.size(around) != F.size(F.array_distinct(around))).count() == 0


def test_every_character_folds_as_its_decomposition(spark):
    import unicodedata

    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF and unicodedata.category(chr(i)) != "Cn"]
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not "\u0300" <= c <= "\u036f")
    texts = [*every, *["x".join(every[i : i + 40]) for i in range(0, len(every), 997)], "", "Ő Čs ﬁ Ａ ½ 한국어 ㍿"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", text.folded(F.col("t")).alias("v")).collect()
    assert len(got) > 280_000 and [r.t for r in got if r.v != plain(r.t)] == []


def test_marks_of_other_scripts(spark):
    assert value(spark, text.normalised(F.lit("ไทย की ガ"))) == "ไทย की カ\u3099" and value(spark, text.unmarked(F.lit("की ガ Őﬁ"))) == "क カ ofi"
    assert value(spark, text.compact(F.lit("São Ｐaulo ①"))) == "saopaulo1"
