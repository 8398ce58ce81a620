"""Guards of sources, reports for reviewers, lists beside a map."""

import json

import pytest
from pyspark.sql import functions as F

from waymark.functions import maps
from waymark.operators import quality, records, reports, search
from waymark.sources import pages


def test_sources_that_give_too_little(spark):
    sitemap = spark.createDataFrame([(1, "<urlset><loc>https://x/news/a</loc></urlset>")], "page int, xml string")
    slugs = pages.sitemap_slugs(sitemap, "/test-centres")
    assert slugs.count() == 0
    with pytest.raises(pages.Incomplete):
        pages.all_listed(slugs)
    code = lambda i: f"{chr(97 + i // 26)}{chr(97 + i % 26)}z"
    page = lambda n: spark.createDataFrame([("<select>" + "".join(f'<option value="{code(i)}">x</option>' for i in range(n)) + "</select>",)], "html string")
    assert pages.known_countries(page(50)).count() == 50
    for n in (49, 5, 0):
        with pytest.raises(pages.Incomplete):
            pages.known_countries(page(n))
    with pytest.raises(ValueError):
        records.in_country(spark.createDataFrame([("CA",)], "country string"), "FR")


def test_lists_beside_a_map(spark):
    rows = spark.createDataFrame([(1, 10.0, 179.0), (2, 10.0, 0.0), (3, None, None)], "id int, lat double, lng double")
    view = dict(north=20, south=0, east=-170, west=170)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(search.in_view(rows, view)) == [1] and ids(search.in_view(rows, None)) == [] and ids(search.in_view(rows, view, " hall ")) == [1, 2, 3] and ids(search.in_view(rows, view, "  ")) == [1]


def test_maps_of_counters(spark):
    text = lambda c: spark.range(1).select(maps.as_text(c).alias("v")).first().v
    m = lambda **kw: F.create_map(*[F.lit(x) for pair in kw.items() for x in pair]) if kw else F.lit(None).cast(maps.NUMBERS)
    assert text(maps.difference(m(a=3, b=1, c=2), m(b=1, c=5, d=4))) == "a=3|c=-3|d=-4" and text(maps.difference(m(), m())) == ""
    assert text(maps.added(m(a=1), m(a=2, b=3))) == "a=3|b=3" and text(records.call_changes(m(google=1), m(google=1, osm=2))) == "google=0|osm=2"
    assert text(maps.counted(F.array(F.lit("x"), F.lit("y"), F.lit("x")))) == "x=2|y=1" and text(maps.counted(F.array(F.lit("x")), ("y", "x"))) == "x=1|y=0"


def test_quality_report(spark):
    issue = "array<struct<code:string,severity:string,action:string>>"
    rows = [("A|B  x", "needs_review", True, True, "verified", "street", True, [("missing_city", "warning", "review"), ("note", "info", "none")]), ("C", "quarantined", False, True, None, None, False, []), ("Old", "ready", True, False, "verified", "street", True, [])]
    analyses = spark.createDataFrame(rows, f"name string, decision string, publishable boolean, is_new boolean, verification string, precision string, pinnable boolean, issues {issue}")
    discovered = spark.createDataFrame([("s1", "new", None), ("s2", "unresolved_new", "timeout"), ("s3", "known_failed", "404"), ("s4", "unresolved_ongoing", "x"), ("s5", "known", None)], "slug string, outcome string, error string")
    merged = quality.merged_into_existing(spark.createDataFrame([("n", "a", "A"), ("o", "a", "A"), ("p", "b", "B")], "slug string, id string, name string"), spark.createDataFrame([("a", "o"), (None, None)], "id string, slug string"))
    assert [tuple(r) for r in merged.collect()] == [("n", "a", "A")]
    lines = reports.quality_report(analyses, discovered, merged)
    assert "3 places were analysed. 2 pages are new, which make 2 new places." in lines and "- `s2` — timeout" in lines and "- `s3` — 404" in lines
    assert "| A\\|B x | needs_review | yes | verified/street | yes | `missing_city` |" in lines and "| C | quarantined | no | missing | no | none |" in lines
    assert "1 new pages belong to places that were known before." in lines and lines[-1] == "Outcome: 0 ready, 1 to be reviewed, 2 quarantined or unresolved."
    nothing = reports.quality_report(analyses.limit(0), discovered.limit(0), merged.limit(0))
    assert nothing[-1] == "Outcome: 0 ready, 0 to be reviewed, 0 quarantined or unresolved." and not any(x.startswith("|") for x in nothing)


def test_delta_report_and_long_tables(spark):
    deltas = spark.createDataFrame([(True, ["a"], [], "same", "same"), (False, [], ["b", "c"], "regression", "lost"), (False, [], [], "improvement", "restored")], "is_new boolean, new_tokens array<string>, resolved_tokens array<string>, decision_change string, pin_change string")
    countries = spark.range(60).select(F.format_string("C%02d", "id").alias("country"), F.col("id").alias("ready"))
    lines = reports.delta_report(deltas, countries)
    assert "| Resolved issues | 2 |" in lines and "| Pins lost | 1 |" in lines and lines[-1] == "| …and 10 more | |" and "| C00 | 0 |" in lines and "| C50 | 50 |" not in lines


GOOD = {"id": "a", "reviewedAt": "2026-01-01", "reason": "moved", "evidence": ["x", "y"], "patch": {"name": "New", "city": None, "address": {"raw": "1 St"}, "publishable": False}}


def test_files_of_overrides(spark, tmp_path):
    path = tmp_path / "overrides.json"
    path.write_text(json.dumps({"version": 1, "overrides": [GOOD, GOOD | {"id": "b", "evidence": [], "patch": {}}]}, indent=2))
    rows = {r.id: r for r in pages.override_file(spark, str(path)).collect()}
    assert rows["a"].patch == {"name": "New", "city": None, "address": '{"raw":"1 St"}', "publishable": "false"} and rows["a"].evidence == ["x", "y"] and rows["b"].patch == {} and rows["b"].evidence == []
    path.write_text(json.dumps({"version": 1, "overrides": []}))
    assert pages.override_file(spark, str(path)).count() == 0


@pytest.mark.parametrize(
    "content",
    [
        "", "[]", "{", "null", {"version": 2, "overrides": []}, {"version": "1", "overrides": []}, {"overrides": []}, {"version": 1}, {"version": 1, "overrides": {}}, {"version": 1, "overrides": ["x"]}, {"version": 1, "overrides": [None]}, {"version": 1, "overrides": [GOOD | {"id": 5}]},
        {"version": 1, "overrides": [GOOD, GOOD | {"reason": None}]}, {"version": 1, "overrides": [GOOD | {"evidence": ["x", 1]}]}, {"version": 1, "overrides": [GOOD | {"evidence": "x"}]}, {"version": 1, "overrides": [GOOD | {"patch": []}]}, {"version": 1, "overrides": [{k: v for k, v in GOOD.items() if k != "reviewedAt"}]},
    ],
)
def test_broken_files_of_overrides(spark, tmp_path, content):
    path = tmp_path / "overrides.json"
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    with pytest.raises(ValueError):
        pages.override_file(spark, str(path))


def test_edits_of_overrides(spark):
    from waymark.operators import overlay

    places = spark.createDataFrame([("a", "A", 1), ("b", "", 2)], "id string, name string, n int")
    edits = [("a", 1, "PUT", {"name": "X"}), ("a", 2, "PUT", {"name": ""}), ("b", 3, "PUT", {"n": "5"}), ("b", 4, "PUT", {"name": "B", "n": None}), ("z", 5, "PUT", {"name": "Z"}), ("c", 6, "DELETE", None), ("a", 7, "PATCH", {}), ("b", 8, "PUT", {"m": "1", "k": "2"}), ("a", 9, "PUT", None)]
    df = spark.createDataFrame(edits, "id string, seq int, method string, patch map<string,string>")
    got = overlay.answered(df, places, {"name": "string", "n": "int"}, {"name": F.col("name") != "", "n": F.coalesce(F.col("n") > 0, F.lit(True))})
    assert {r.seq: (r.status, r.problems) for r in got.collect()} == {1: (200, []), 2: (400, ["name"]), 3: (400, ["name"]), 4: (200, []), 5: (404, []), 6: (204, []), 7: (405, []), 8: (400, ["unknown:k", "unknown:m"]), 9: (400, ["no patch"])}
    stored = spark.createDataFrame([("c", {"name": "old"}), ("d", {"name": "kept"}), ("a", {"n": "9"})], "id string, patch map<string,string>")
    assert {r.id: r.patch for r in overlay.stored_after(stored, got).collect()} == {"a": {"name": "X"}, "b": {"name": "B", "n": None}, "d": {"name": "kept"}}
