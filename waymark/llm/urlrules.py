"""URL filters by a sort-merge range join, in DataFrame operations only.

The canonical key of a (host, path) is the host's labels in reverse, then the path: example.com with /en/ is
com.example//en/: the host ends in a slash of its own, so that com does not lead to community. All keys that start with a rule's key are one interval of the sorted order, and the intervals of two
rules are nested or disjoint. A url has one key for each suffix of its host. The sweep goes through rules and keys in
sorted order, within ranges of keys of about equal size. At each key the last rule seen carries its stack: itself and
the rules that enclose it. Those of the stack that the key still starts with are active; the longest is the match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): each rule with the rules that enclose it, itself included, as structs that order by length.

    Of rules with equal host and path the blocking one counts. Rules with a null part are dropped; hosts are lower-cased.
    """
    host = F.translate("host", UPPER, LOWER)
    own = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.concat(_reversed(F.split(host, r"\.")), F.lit("/"), "path").alias("key"), F.concat(host, "path").alias("rule"), "verdict"
    )
    own = own.groupBy("key", "rule").agg(F.max("verdict").alias("verdict"))
    named = own.select("key", F.struct(F.length("key").alias("n"), "key", "rule", "verdict").alias("entry"))
    starts = F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n)))
    prefixes = own.where("key <> ''").select("key", starts.alias("prefix"))
    enclosing = prefixes.join(named.withColumnRenamed("key", "prefix"), "prefix")
    return enclosing.groupBy("key").agg(F.array_sort(F.collect_list("entry")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) per row of pages, by the longest rule whose host and path fit.

    rules has host, path (a prefix) and verdict. A rule fits its host and every subdomain. Null and relative urls have
    an empty host and path, and no rule; they and all others without a rule get `default`. Rows with equal ids or urls
    are judged one by one, so a url that many rows share is spread over ranges like any others. Empty tables are fine.
    """
    spark = pages.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stacks = materialise(rule_stacks(rules), "rules")
    kind = stacks.schema["stack"].dataType
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = materialise(urls, "urls")  # row numbers must not change
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: _reversed(F.slice(labels, -i, i)))
    keys = urls.where("host <> ''").select("row", F.explode(F.transform(suffixes, lambda s: F.concat(s, F.lit("/"), "path"))).alias("key"))
    # rules sort before keys that are equal to them; rows dealt by range keep the ranges even when keys repeat
    events = keys.select("key", "row", F.lit(1).alias("turn"), F.lit(None).cast(kind).alias("stack")).unionByName(
        stacks.select("key", F.lit(None).cast("long").alias("row"), F.lit(0).alias("turn"), "stack")
    )
    dealt = materialise(events.repartitionByRange(n, "key", "turn", "row").withColumn("range", F.spark_partition_id()), "ranges")
    # rules that opened before a range starts and still cover its first key
    first = dealt.groupBy("range").agg(F.min("key").alias("first"))
    starts = F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda i: F.substring(F.col("first"), F.lit(1), i)))
    opened = first.select("range", "first", starts.alias("prefix")).join(stacks.withColumnRenamed("key", "prefix"), "prefix")
    opened = opened.groupBy("range", "first").agg(F.max_by("stack", F.length("prefix")).alias("stack"))
    carried = opened.select(F.col("first").alias("key"), F.lit(None).cast("long").alias("row"), F.lit(-1).alias("turn"), "stack", "range")

    sweep = Window.partitionBy("range").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.unionByName(carried).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("row IS NOT NULL")
    # all keys of a url end in its path, so that the longest key is the longest rule
    active = F.filter("open", lambda e: F.col("key").startswith(e["key"]))
    matched = swept.select("row", F.try_element_at(active, F.lit(-1)).alias("entry")).where("entry IS NOT NULL")
    best = matched.groupBy("row").agg(F.max("entry").alias("entry"))
    return urls.join(best, "row", "left").select("id", "host", "path", F.col("entry.rule").alias("rule"), F.coalesce("entry.verdict", F.lit(default)).alias("verdict"))
