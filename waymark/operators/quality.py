"""Data-quality rules over places, baselines of their outcome, and gates on regressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maps

UNASSIGNED = "UNASSIGNED"
SEVERITIES = ("error", "warning", "info")


@dataclass(frozen=True)
class Rule:
    """An issue that a record has where `when` holds."""

    code: str
    severity: str  # error, warning or info
    action: str  # quarantine_centre, suppress_location, review or none
    when: Callable[[], Column]


def rules() -> list[Rule]:
    """The rules of the directory. Places have name, address, address_lines, country, city, city_source, n_sources, operator,
    operator_source, booking_url, retake_only, n_offers, n_priced, n_unparsed, n_currencies, n_unclassified, bad_price, pending,
    n_contacts and location: has_geo, outside, verified, admin, n_paths, agreement_km, tier."""
    c = F.col
    full = lambda: ~F.coalesce(c("retake_only"), F.lit(False))
    blank = lambda name: F.coalesce(F.trim(name), F.lit("")) == ""
    lone = lambda: c("verified") & ~c("admin") & ((c("n_paths") < 2) | c("agreement_km").isNull())
    error, warning = "error", "warning"
    stop, hide, review = "quarantine_centre", "suppress_location", "review"
    return [
        Rule("missing_name", error, stop, lambda: blank("name")),
        Rule("missing_address", error, stop, lambda: (F.length(F.trim(F.coalesce("address", F.lit("")))) < 5) | (c("address_lines") == 0)),
        Rule("missing_country", error, stop, lambda: blank("country")),
        Rule("missing_source", error, stop, lambda: c("n_sources") == 0),
        Rule("unknown_operator", warning, review, lambda: c("operator") == "unknown"),
        Rule("operator_not_domain_verified", warning, review, lambda: (c("operator") != "unknown") & (c("operator_source") != "booking_domain")),
        Rule("missing_booking_url", warning, review, lambda: full() & blank("booking_url")),
        Rule("missing_city", warning, review, lambda: blank("city")),
        Rule("legacy_city", warning, review, lambda: ~blank("city") & (c("city_source") == "legacy")),
        Rule("osr_only_centre", "info", "none", lambda: ~full()),
        Rule("no_offerings", error, stop, lambda: full() & (c("n_offers") == 0)),
        Rule("no_published_price", error, stop, lambda: full() & (c("n_priced") == 0)),
        Rule("unparsed_price", warning, review, lambda: c("n_unparsed") > 0),
        Rule("invalid_derived_price", error, review, lambda: c("bad_price")),
        Rule("multiple_currencies", warning, review, lambda: c("n_currencies") > 1),
        Rule("unclassified_offering", warning, review, lambda: c("n_unclassified") > 0),
        Rule("missing_contact_information", "info", "none", lambda: c("n_contacts") == 0),
        Rule("pending_duplicate_candidate", warning, review, lambda: c("pending")),
        Rule("missing_location", warning, hide, lambda: ~c("has_geo")),
        Rule("location_outside_country", error, hide, lambda: c("has_geo") & c("outside")),
        Rule("location_not_independently_corroborated", error, hide, lambda: c("has_geo") & lone()),
        Rule("location_not_verified", warning, hide, lambda: c("has_geo") & ~c("verified")),
        Rule("location_too_coarse", warning, hide, lambda: c("has_geo") & c("verified") & (c("tier") < 3)),
    ]


def analysed(places: DataFrame, checks: list[Rule] | None = None, publishable: str = "publishable") -> DataFrame:
    """places with issues (array of code, severity, action), decision and publishable after quarantine."""
    entry = lambda r: F.when(F.coalesce(r.when(), F.lit(False)), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.lit(r.action).alias("action")))
    issues = F.filter(F.array(*[entry(r) for r in (rules() if checks is None else checks)]), lambda i: i.isNotNull())
    found = places.withColumn("issues", issues.cast("array<struct<code:string,severity:string,action:string>>"))
    stopped = F.exists("issues", lambda i: i["action"] == "quarantine_centre")
    found = found.withColumn(publishable, F.col(publishable) & ~stopped)
    serious = F.exists("issues", lambda i: i["severity"] != "info")
    return found.withColumn("decision", F.when(~F.col(publishable), "quarantined").when(serious, "needs_review").otherwise("ready"))


def exploded(analyses: DataFrame, key: str, *kept: str) -> DataFrame:
    return analyses.select(key, *kept, F.explode("issues").alias("_i")).select(key, *kept, "_i.code", "_i.severity", "_i.action")


def baseline(analyses: DataFrame, country: str = "country") -> DataFrame:
    """Per country: places, each decision, pins, and maps of issue codes and of severities to counts."""
    named = analyses.withColumn("_c", F.coalesce(F.col(country), F.lit(UNASSIGNED)))
    decided = lambda d: F.count_if(F.col("decision") == d).alias(d)
    totals = named.groupBy("_c").agg(F.count("*").alias("centres"), *[decided(d) for d in ("ready", "needs_review", "quarantined")], F.count_if("pinnable").alias("pinnable"))
    each = exploded(named, "_c").groupBy("_c", "code", "severity").agg(F.count("*").alias("n"))
    sum_of = lambda name: F.aggregate(F.filter(F.collect_list(F.struct("severity", "n")), lambda e: e["severity"] == name), F.lit(0).cast("long"), lambda total, e: total + e["n"])
    severities = F.map_from_arrays(F.array(*map(F.lit, SEVERITIES)), F.array(*map(sum_of, SEVERITIES))).alias("severities")
    by_code = F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "n")))).alias("codes")  # a code has one severity
    return totals.join(each.groupBy("_c").agg(by_code, severities), "_c", "left").withColumnRenamed("_c", "country")


def totals(baselines: DataFrame) -> DataFrame:
    """One row: the counters of all countries added up, and their maps by name."""
    counters = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("centres", "ready", "needs_review", "quarantined", "pinnable")]
    one = baselines.agg(*counters)
    for name in ("codes", "severities"):
        one = one.join(maps.summed(baselines, name), how="left")  # one row each
    return one


_DEGREE = "CASE {d} WHEN 'quarantined' THEN 2 WHEN 'needs_review' THEN 1 ELSE 0 END"


def delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per place of `after`: is_new, the issues that are new or resolved, and how decision and pin moved.

    Both have key, decision, pinnable and tokens (an array of issue tokens). A place without an entry before counts as ready, with
    a pin and without issues; decisions and pins are compared for old places only.
    """
    old = before.select(F.col(key).alias("_k"), F.lit(True).alias("_known"), F.col("decision").alias("_decision"), F.col("pinnable").alias("_pin"), F.col("tokens").alias("_tokens"))
    joined = after.join(old, F.col(key) == F.col("_k"), "left")
    known, none = F.coalesce("_known", F.lit(False)), F.array().cast("array<string>")
    was = F.coalesce("_tokens", none)
    degree = lambda d: F.expr(_DEGREE.format(d=d))
    moved = degree("decision") - degree("coalesce(_decision, 'ready')")
    pin = F.coalesce("_pin", F.lit(True))
    return joined.select(
        key, (~known).alias("is_new"), F.sort_array(F.array_except("tokens", was)).alias("new_tokens"), F.sort_array(F.array_except(was, F.col("tokens"))).alias("resolved_tokens"),
        F.when(known & (moved > 0), "regression").when(known & (moved < 0), "improvement").otherwise("same").alias("decision_change"),
        F.when(known & pin & ~F.col("pinnable"), "lost").when(known & ~pin & F.col("pinnable"), "restored").otherwise("same").alias("pin_change"), F.col("decision").alias("after"),
    )


def country_deltas(before: DataFrame, after: DataFrame, counters: list[str], of: tuple[str, ...] = ()) -> DataFrame:
    """after - before of each counter, and of each map in `of` by name, for countries in both, where anything changed."""
    old = before.select(F.col("country").alias("_c"), *[F.col(c).alias(f"_{c}") for c in (*counters, *of)])
    numbers = [(F.col(c) - F.col(f"_{c}")).alias(c) for c in counters]
    found = after.join(old, F.col("country") == F.col("_c")).select("country", *numbers, *[maps.difference(F.col(c), F.col(f"_{c}")).alias(c) for c in of])
    changed = [F.col(c) != 0 for c in counters] + [F.size(c) > 0 for c in of]
    return found.where(reduce(Column.__or__, changed))


# Regressions that stop a publication: more than so many, or than this share of the places before.
ISSUES, PINS, QUARANTINES = (25, 0.03), (20, 0.02), (5, 0.005)
COUNTRY_PINS, COUNTRY_QUARANTINES, COUNTRY_LEAST = (5, 0.10), (3, 0.05), 10


def _over(n: Column, size: Column, rule: tuple[int, float]) -> Column:
    return n > F.greatest(F.lit(rule[0]), F.ceil(size * rule[1]))


def regression_gate(deltas: DataFrame, before_size: int) -> DataFrame:
    """One row: new serious issues, lost pins and new quarantines of old places, and whether each is beyond its limit."""
    old = deltas.where("NOT is_new")
    serious = F.size(F.filter("new_tokens", lambda t: ~t.endswith(":info")))
    counted = old.agg(
        F.coalesce(F.sum(serious), F.lit(0)).alias("issues"), F.count_if(F.col("pin_change") == "lost").alias("pins"),
        F.count_if((F.col("decision_change") == "regression") & (F.col("after") == "quarantined")).alias("quarantines"),
    )
    size = F.lit(before_size)
    return counted.select("*", _over(F.col("issues"), size, ISSUES).alias("too_many_issues"), _over(F.col("pins"), size, PINS).alias("too_many_pins"), _over(F.col("quarantines"), size, QUARANTINES).alias("too_many_quarantines"))


def country_gate(deltas: DataFrame, before: DataFrame) -> DataFrame:
    """Countries of at least COUNTRY_LEAST places before whose net lost pins or net quarantines are beyond their limit.

    deltas also has country and `was`, the decision before; before has country and centres.
    """
    old = deltas.where("NOT is_new").groupBy("country").agg(
        (F.count_if(F.col("pin_change") == "lost") - F.count_if(F.col("pin_change") == "restored")).alias("net_pins"),
        (F.count_if((F.col("decision_change") == "regression") & (F.col("after") == "quarantined")) - F.count_if((F.col("decision_change") == "improvement") & (F.col("was") == "quarantined"))).alias("net_quarantines"),
    )
    joined = old.join(before.where(F.col("centres") >= COUNTRY_LEAST).select("country", "centres"), "country")
    pins, stops = _over(F.col("net_pins"), F.col("centres"), COUNTRY_PINS), _over(F.col("net_quarantines"), F.col("centres"), COUNTRY_QUARANTINES)
    return joined.select("*", pins.alias("too_many_pins"), stops.alias("too_many_quarantines")).where("too_many_pins OR too_many_quarantines")


def discovery(crawled: DataFrame, known: DataFrame, failed_before: DataFrame, key: str) -> DataFrame:
    """(key, outcome) of crawled pages (key, failed): new, known, unresolved_new, unresolved_ongoing or known_failed."""
    known_keys = known.select(F.col(key).alias("_known")).distinct()
    old = failed_before.select(F.col(key).alias("_before")).distinct()
    joined = crawled.join(known_keys, F.col(key) == F.col("_known"), "left").join(old, F.col(key) == F.col("_before"), "left")
    is_known = F.col("_known").isNotNull()
    failed = F.when(is_known, "known_failed").when(F.col("_before").isNotNull(), "unresolved_ongoing").otherwise("unresolved_new")
    return joined.select(key, F.when(F.col("failed"), failed).when(is_known, "known").otherwise("new").alias("outcome"))


def merged_into_existing(sources: DataFrame, before: DataFrame) -> DataFrame:
    """(slug, id, name): pages that were not known before, of places that were; both have id and slug, one row for each page of a place."""
    known = before.select(F.col("id").alias("_id")).where("_id IS NOT NULL").distinct()
    listed = before.select(F.col("slug").alias("_slug")).distinct()
    return sources.join(listed, F.col("slug") == F.col("_slug"), "left_anti").join(known, F.col("id") == F.col("_id"), "left_semi").select("slug", "id", "name")


def issue_token(severity: Column, code: Column) -> Column:
    return F.concat(severity, F.lit(":"), code)


def next_state(discovered: DataFrame, key: str) -> DataFrame:
    """The keys to remember until the next run: pages without an answer, new or from before, each once."""
    return discovered.where(F.col("outcome").isin("unresolved_new", "unresolved_ongoing")).select(key).distinct()


def state_changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: whether the remembered keys of two runs differ, how many came and how many went."""
    joined = before.select(F.col(key).alias("b")).distinct().join(after.select(F.col(key).alias("a")).distinct(), F.col("a") == F.col("b"), "full")
    came, went = F.count_if(F.col("b").isNull()), F.count_if(F.col("a").isNull())
    return joined.agg(came.alias("came"), went.alias("went"), (came + went > 0).alias("changed"))


def audit(places: DataFrame) -> DataFrame:
    """(kind, id, detail) of what people should look at: no location, unverified ones, prices not understood, old cities.

    places has id, has_geo, verification, city, city_source and offers (label, text, status).
    """
    flat = F.array(
        F.when(~F.col("has_geo"), F.struct(F.lit("no_location").alias("kind"), F.lit(None).cast("string").alias("detail"))),
        F.when(F.col("has_geo") & (F.coalesce("verification", F.lit("")) != "verified"), F.struct(F.lit("unverified_location").alias("kind"), F.col("verification").alias("detail"))),
        F.when(F.col("city_source") == "legacy", F.struct(F.lit("legacy_city").alias("kind"), F.col("city").alias("detail"))),
    )
    unread = F.transform(F.filter("offers", lambda o: o["status"] == "unparsed"), lambda o: F.struct(F.lit("unparsed_price").alias("kind"), F.concat(o["label"], F.lit(": "), F.coalesce(o["text"], F.lit(""))).alias("detail")))
    every = F.concat(F.filter(flat, lambda e: e.isNotNull()), F.coalesce(unread, F.array().cast("array<struct<kind:string,detail:string>>")))
    return places.select("id", F.explode(every).alias("_e")).select("_e.kind", "id", "_e.detail")
