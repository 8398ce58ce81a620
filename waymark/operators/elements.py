"""Nested elements of pages by prefix sums: a tag token is one row, its depth a running sum, its partner the next token of its depth."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def balanced(pages: DataFrame, tag: str, marker: str = "", key: str = "id", html: str = "html") -> DataFrame:
    """(key, n, start, element): every element `tag` of each page whose opening tag matches `marker`, whole, with what is nested in it.

    n counts them from 1 by page. An element that is never closed goes on to the page's end; closing tags without an element are passed over.
    Rows of one page meet in one task, as numbers without the text; keys are unique; a null page has no element.
    """
    name = re.escape(tag)
    # each piece runs from the end of the one before (\G) to the end of a tag token, so that lengths alone give its place; without \G the text
    # behind the last token would be searched again from each of its characters
    pieces = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)\G.*?(?:<{name}\b|</{name}\s*>)"), 0)
    sizes = F.transform(pieces, lambda p: F.struct(F.length(p).alias("size"), F.when(p.rlike(rf"(?is)</{name}\s*>\z"), -1).otherwise(1).alias("turn"), (F.length(p) - F.length(F.regexp_replace(p, rf"(?is)(?:<{name}|</{name}\s*>)\z", ""))).alias("own")))
    tokens = pages.select(F.col(key).alias("_key"), F.posexplode(sizes).alias("pos", "t")).select("_key", "pos", "t.size", "t.turn", "t.own")
    before = Window.partitionBy("_key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = tokens.withColumns({"end": F.sum("size").over(before), "depth": F.sum("turn").over(before)})
    # an opening token at depth d and the closing one that comes back to d - 1 are neighbours on level d
    level = placed.withColumn("level", F.when(F.col("turn") > 0, F.col("depth")).otherwise(F.col("depth") + 1))
    along = Window.partitionBy("_key", "level").orderBy("pos")
    paired = level.withColumns({"next_turn": F.lead("turn").over(along), "next_end": F.lead("end").over(along)}).where("turn > 0")
    spans = paired.select("_key", (F.col("end") - F.col("own")).alias("start"), F.when(F.col("next_turn") < 0, F.col("next_end")).alias("stop"))
    # a page meets its spans as one array of numbers, so that the elements' texts are cut row by row and never sorted
    listed = spans.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_spans"))
    joined = pages.select(F.col(key).alias(key), F.col(html).alias("_html")).join(listed, F.col(key) == F.col("_key"))
    text = lambda s: F.substring(F.col("_html"), s["start"] + 1, F.coalesce(s["stop"], F.length("_html")) - s["start"])
    opening = rf"(?i)^<{name}\b[^>]*{marker}[^>]*>" if marker else rf"(?i)^<{name}\b[^>]*>"
    fits = F.filter("_spans", lambda s: text(s).contains(">") & text(s).rlike(opening))
    found = joined.select(key, "_html", F.posexplode(fits).alias("_i", "_s"))
    return found.select(key, (F.col("_i") + 1).alias("n"), F.col("_s.start").alias("start"), text(F.col("_s")).alias("element"))
