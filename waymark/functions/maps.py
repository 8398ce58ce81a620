"""Counters kept as maps from a name to a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = "map<string,bigint>"


def known(m: Column) -> Column:
    """The map, or an empty one for null."""
    return F.coalesce(m.cast(NUMBERS), F.create_map().cast(NUMBERS))


def combined(a: Column, b: Column, how) -> Column:
    """how(x, y) for every name of either map, with 0 where one lacks it."""
    return F.map_zip_with(known(a), known(b), lambda _, x, y: how(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def difference(after: Column, before: Column) -> Column:
    """after - before by name; names whose number did not change are left out."""
    return F.map_filter(combined(after, before, lambda x, y: x - y), lambda _, v: v != 0)


def added(a: Column, b: Column) -> Column:
    return combined(a, b, lambda x, y: x + y)


def counted(values: Column, names: tuple[str, ...] | None = None) -> Column:
    """How often each of an array's values occurs; of `names`, if given, also those that do not."""
    every = F.array(*map(F.lit, names)) if names else F.array_sort(F.array_distinct(values))
    return F.map_from_arrays(every, F.transform(every, lambda n: F.size(F.filter(values, lambda v: v == n)).cast("long")))


def summed(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, column): the maps of each group added up by name, in the order of names; groups without any entry are left out."""
    each = rows.select(*keys, F.explode(column).alias("_name", "_n")).groupBy(*keys, "_name").agg(F.sum("_n").alias("_n"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_name", "_n")))).alias(column))


def tallies(rows: DataFrame, columns: dict[str, Column | str], missing: str = "none") -> DataFrame:
    """(dimension, counts, total): for each named column how many rows have each of its values, nulls as `missing`; one pass over the rows."""
    each = F.array(*[F.struct(F.lit(name).alias("dimension"), F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(missing)).alias("value")) for name, c in columns.items()])
    n = rows.select(F.inline(each)).groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return n.groupBy("dimension").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias("counts"), F.sum("n").alias("total"))


def as_text(m: Column) -> Column:
    """`name=number` by name, joined by |."""
    entries = F.array_sort(F.map_entries(known(m)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
