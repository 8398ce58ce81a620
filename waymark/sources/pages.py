"""Reading what was fetched: page bodies, sitemaps, listings, slug snapshots and versioned JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import html


def cache_name(url) -> F.Column:
    """The content address of a url, sixteen hexadecimal digits."""
    return F.substring(F.sha1(url.cast("binary")), 1, 16)


def bodies(spark: SparkSession, path: str, suffix: str = "</html>") -> DataFrame:
    """(path, body, complete) of a folder of fetched files; incomplete ones have to be fetched again."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    return rows.withColumn("complete", html.complete(F.col("body"), suffix))


class Incomplete(ValueError):
    """A source gave less than it must have; going on would empty the directory."""


def sitemap_slugs(sitemaps: DataFrame, under: str, page: str = "page", xml: str = "xml") -> DataFrame:
    """(slug, page, pos): each slug of sitemaps (page, xml) whose address goes through `under`, with the first page that lists it.

    A sitemap without any address of it is left as it is; see all_listed().
    """
    places = F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*([^<\s]+)\s*</loc>"), 1))
    found = sitemaps.select(F.col(page).alias("page"), places.alias("pos", "loc")).where(F.col("loc").contains(under))
    slug = F.regexp_replace(F.regexp_extract("loc", f"{under}/?([^?#]+)", 1), "/+$", "")
    first = found.select(slug.alias("slug"), "page", "pos").where("slug <> ''").groupBy("slug").agg(F.min(F.struct("page", "pos")).alias("f"))
    return first.select("slug", F.col("f.page").alias("page"), F.col("f.pos").alias("pos"))


def all_listed(slugs: DataFrame) -> DataFrame:
    """The slugs of a sitemap; Incomplete if there is none."""
    if slugs.isEmpty():
        raise Incomplete("the sitemap lists no page")
    return slugs


def known_countries(page: DataFrame, least: int = 50, html_col: str = "html") -> DataFrame:
    """(code): the three-letter codes that a listing page names; Incomplete if there are fewer than `least`, as its layout must have changed."""
    codes = page.select(F.explode(F.coalesce(html.select_options(F.col(html_col)), F.array().cast("array<string>"))).alias("code")).select(F.lower("code").alias("code")).distinct()
    found = codes.limit(least).count()
    if found < least:
        raise Incomplete(f"the listing names {found} countries, at least {least} are expected")
    return codes


def listed_countries(listings: DataFrame, path: str) -> DataFrame:
    """(slug, country) from listing pages (country, ordinal, html); the first country that lists a slug has it."""
    slugs = listings.select("country", "ordinal", F.explode(html.slugs_under(F.col("html"), path)).alias("slug"))
    return slugs.groupBy("slug").agg(F.min_by("country", F.struct("ordinal", "country")).alias("country"))


def slug_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The distinct slugs of a text file, of which some lines end in a stray quote."""
    return spark.read.text(path).select(F.rtrim(F.trim("value"), F.lit('"')).alias("slug")).where("slug <> ''").distinct()


def versioned(spark: SparkSession, path: str, schema: str, version: int, strict: bool = False) -> DataFrame | None:
    """A JSON envelope of the given version; None if it is missing or of another version, unless strict, which raises."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    try:
        found = spark.read.schema(schema).json(path, multiLine=True, mode=mode)
        if found.where(F.col("version") == version).limit(1).count():
            return found
    except AnalysisException:
        if strict:
            raise
        return None
    if strict:
        raise ValueError(f"{path} is not of version {version}")
    return None


def override_file(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """(id, reviewed_at, reason, evidence, patch) of a file of reviewed overrides; patch is a map of texts, null where the file says null.

    Any departure from the format raises, as a correction that is lost without notice brings a known error back: another version, entries
    that are no objects, texts that are missing or of another type, evidence that is no list of texts, a patch that is no object.
    """
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    part = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    kind = lambda v, name: F.coalesce(F.schema_of_variant(part(v, name)), F.lit(""))
    v = F.col("v")
    sound = F.coalesce(F.try_variant_get(v, "$.version", "int") == version, F.lit(False)) & (kind(v, "version") == "BIGINT") & kind(v, "overrides").startswith("ARRAY<")
    if whole.where(~sound).limit(1).count() or whole.isEmpty():
        raise ValueError(f"{path} is no file of overrides of version {version}")
    entries = whole.select(F.explode(F.variant_get("v", "$.overrides", "array<variant>")).alias("e"))
    e = F.col("e")
    text = [kind(e, name) == "STRING" for name in ("id", "reviewedAt", "reason")]
    good = text[0] & text[1] & text[2] & kind(e, "evidence").isin("ARRAY<STRING>", "ARRAY<VOID>") & kind(e, "patch").startswith("OBJECT<")
    if entries.where(~F.coalesce(good, F.lit(False))).limit(1).count():
        raise ValueError(f"{path} has an override that is not as it should be")
    get = lambda name, kind: F.variant_get(e, f"$.{name}", kind)
    return entries.select(get("id", "string").alias("id"), get("reviewedAt", "string").alias("reviewed_at"), get("reason", "string").alias("reason"), get("evidence", "array<string>").alias("evidence"), get("patch", "map<string,string>").alias("patch"))


def prefixes(slugs: DataFrame) -> DataFrame:
    """How many slugs start with each word."""
    return slugs.groupBy(F.substring_index("slug", "-", 1).alias("prefix")).agg(F.count("*").alias("n"))
