"""Reports for a reviewer: Markdown lines from what a run found. Tables come sorted and cut on Spark; only the lines go to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 50


def cell(value: Column) -> Column:
    """A value as it may stand in a table: bars escaped, white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " "))


def table(rows: DataFrame, columns: dict[str, Column], order: list[Column], most: int = MOST) -> list[str]:
    """A Markdown table of the first rows, and a last line that says how many more there are; no line for no row."""
    shown = rows.select(*[cell(c).alias(f"c{i}") for i, c in enumerate(columns.values())], *[o.alias(f"o{i}") for i, o in enumerate(order)])
    first = shown.orderBy(*[f"o{i}" for i in range(len(order))]).limit(most).collect()
    if not first:
        return []
    lines = [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}", *[f"| {' | '.join(r[: len(columns)])} |" for r in first]]
    more = rows.count() - len(first) if len(first) == most else 0
    return lines + [f"| …and {more} more |{' |' * (len(columns) - 1)}"] * (more > 0)


def listed(rows: DataFrame, key: str, detail: str, title: str, most: int = MOST) -> list[str]:
    """A heading with the number of rows and a line for each of the first ones; nothing for no row."""
    n = rows.count()
    first = rows.orderBy(key).limit(most).collect()
    return [f"### {title} ({n})", "", *[f"- `{r[key]}` — {r[detail]}" for r in first], ""] if n else []


def quality_report(analyses: DataFrame, discovered: DataFrame, merged: DataFrame) -> list[str]:
    """Lines about new places and pages.

    analyses: name, decision, publishable, is_new, verification, precision (null: no location), pinnable, issues. discovered: slug, outcome
    (quality.discovery), error. merged: quality.merged_into_existing().
    """
    new = analyses.where("is_new")
    counts = analyses.agg(F.count("*").alias("n"), F.count_if("is_new").alias("new"), *[F.count_if(F.col("is_new") & (F.col("decision") == d)).alias(d) for d in ("ready", "needs_review", "quarantined")]).first()
    kinds = {r.outcome: r["count"] for r in discovered.groupBy("outcome").count().collect()}
    fresh = kinds.get("new", 0) + kinds.get("unresolved_new", 0)
    lines = ["## New places", "", f"{counts.n} places were analysed. {fresh} pages are new, which make {counts.new} new places.", ""]
    lines += listed(discovered.where("outcome = 'unresolved_new'"), "slug", "error", "Unresolved pages")
    lines += listed(discovered.where("outcome = 'known_failed'"), "slug", "error", "Known pages that failed")
    if kinds.get("known_failed"):
        lines += ["Nothing is written, as a page that fails once must not remove its place.", ""]
    if kinds.get("unresolved_ongoing"):
        lines += [f"{kinds['unresolved_ongoing']} pages are unresolved since an earlier run.", ""]
    serious = F.transform(F.filter("issues", lambda i: i["severity"] != "info"), lambda i: F.concat(F.lit("`"), i["code"], F.lit("`")))
    issues = F.when(F.size(serious) > 0, F.array_join(serious, ", ")).otherwise("none")
    location = F.coalesce(F.concat_ws("/", F.col("verification"), F.when(F.col("verification").isNotNull(), F.col("precision"))), F.lit(""))
    yes = lambda c: F.when(c, "yes").otherwise("no")
    rows = table(new, {"Place": F.col("name"), "Decision": F.col("decision"), "Published": yes(F.col("publishable")), "Location": F.when(location == "", "missing").otherwise(location), "Pin": yes(F.col("pinnable")), "Issues": issues}, [F.col("name")])
    lines += [*rows, ""] if rows else []
    if n := merged.count():
        lines += [f"{n} new pages belong to places that were known before.", ""]
    stopped = counts.quarantined + kinds.get("unresolved_new", 0)
    return [*lines, f"Outcome: {counts.ready} ready, {counts.needs_review} to be reviewed, {stopped} quarantined or unresolved."]


def delta_report(deltas: DataFrame, countries: DataFrame) -> list[str]:
    """Lines about what changed: counters of quality.delta() rows, and a table of quality.country_deltas() rows with maps as text."""
    n = lambda when, name: F.count_if(when).alias(name)
    c = deltas.agg(
        n(F.col("is_new"), "new"), F.coalesce(F.sum(F.size("new_tokens")), F.lit(0)).alias("came"), F.coalesce(F.sum(F.size("resolved_tokens")), F.lit(0)).alias("went"), n(F.col("decision_change") == "regression", "worse"),
        n(F.col("decision_change") == "improvement", "better"), n(F.col("pin_change") == "lost", "lost"), n(F.col("pin_change") == "restored", "restored"),
    ).first()
    lines = ["## Changes", "", "| Counter | Number |", "|---|---|", *[f"| {k} | {v} |" for k, v in (("New places", c.new), ("New issues", c.came), ("Resolved issues", c.went), ("Worse decisions", c.worse), ("Better decisions", c.better), ("Pins lost", c.lost), ("Pins restored", c.restored))], ""]
    columns = {f.name.replace("_", " ").capitalize(): F.col(f.name) for f in countries.schema.fields}
    return lines + table(countries, columns, [F.col("country")])


def remediation_report(attempts: DataFrame) -> list[str]:
    """Lines about repairs: how many of each outcome and reason, and those that were accepted."""
    counts = attempts.groupBy("outcome", "reason").count()
    lines = ["## Repairs", "", *table(counts, {"Outcome": F.col("outcome"), "Reason": F.col("reason"), "Number": F.col("count")}, [F.col("outcome"), F.col("reason")]), ""]
    accepted = attempts.where("outcome = 'accepted'")
    return lines + table(accepted, {"Place": F.col("id"), "Changed": F.array_join("changed", ", "), "Mended": F.array_join(F.array_except("before_issues", "after_issues"), ", ")}, [F.col("id")])


def as_rows(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(line, text) of a report."""
    return spark.createDataFrame(list(enumerate(lines, 1)), "line int, text string")
