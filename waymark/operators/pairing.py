"""All pairs of rows that share a key, as many tasks of like size: what is costly is worked out once for each two values."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialise

#: Pairs that a task makes, and copies of a value that lie in one row.
PER_TASK, PER_ROW = 1_000_000, 1024
#: Shares that least() cuts a key's rows into.
SHARES = 256


def _shares(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[int, int]:
    """How many shares each key is cut into and how many tasks there are, from the counted rows of both sides."""
    n = left.groupBy(*on).agg(F.sum("_n").alias("_l")).join(right.groupBy(*on).agg(F.sum("_n").alias("_r")), on)
    every, most = n.agg(F.sum(F.col("_l").cast("double") * F.col("_r")), F.max(F.col("_l").cast("double") * F.col("_r"))).first()
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((every or 0) / PER_TASK))
    return min(256, math.ceil((most or 1) / PER_TASK)), min(4096, tasks)


def _dealt(left: DataFrame, right: DataFrame, on: list[str], by: Column, shares: int, tasks: int, condition: Column | None = None) -> DataFrame:
    """left joined with right on keys; left is dealt in shares by a hash of `by`, right goes to every share."""
    x = left.withColumn("_share", F.pmod(F.xxhash64(by), F.lit(shares)).cast("int")).repartition(tasks, *on, "_share")
    y = right.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(tasks, *on, "_share")
    found = x.join(y.hint("merge"), [*on, "_share"])
    return (found if condition is None else found.where(condition)).drop("_share")


def crossed(left: DataFrame, right: DataFrame, on: list[str], by: str, condition: Column | None = None, size: str | None = None) -> DataFrame:
    """left joined with right on equal keys, where few keys have many rows of both; `by` is a column of left that tells its rows apart.

    `size` is a column of both that says for how many rows each stands, and goes along as _size1 and _size2.
    """
    n = (F.lit(1) if size is None else F.col(size)).alias("_n")
    counts = _shares(left.select(*on, n), right.select(*on, n), on)
    if size is not None:
        left, right = left.withColumnRenamed(size, "_size1"), right.withColumnRenamed(size, "_size2")
    return _dealt(left, right, on, F.col(by), *counts, condition)


def least(left: DataFrame, right: DataFrame, on: list[str], by: str, sample: str, valued: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """Those pairs of crossed() that can be among the `most` with the least value of a sample: the others have a greater one than that many.

    valued(pairs) gives them with a column _v, a number that is never null; `by` tells rows of left apart, `sample` those of right. All pairs are valued, none is
    sorted or shuffled: a key's rows of left lie in SHARES, and of each share and sample the least value is kept. The `most`th least of these bounds
    what a sample needs, and only the shares that reach it are gone through again. A key with few pairs is one share, as is left then.
    """
    one = F.lit(1).alias("_n")
    shares, tasks = _shares(left.select(*on, one), right.select(*on, one), on)
    if shares == 1:
        return valued(_dealt(left, right, on, F.col(by), shares, tasks)).drop("_v")
    to_cells = lambda rows: rows.repartition(tasks, *on, "_share")
    x = to_cells(left.withColumn("_share", F.pmod(F.xxhash64(by), F.lit(SHARES)).cast("int")))
    copied = right.repartition(min(tasks, 32), sample)  # few files, but many copies of their rows
    every = to_cells(copied.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))))
    first = valued(x.join(every.hint("merge"), [*on, "_share"])).groupBy(*on, "_share", sample).agg(F.min("_v").alias("_least"))
    of = Window.partitionBy(sample)
    reached = first.withColumn("_rank", F.rank().over(of.orderBy("_least"))).where(F.col("_rank") <= most)
    reached = reached.withColumn("_most", F.when(F.count("*").over(of) >= most, F.max("_least").over(of)))  # with fewer shares a sample needs all
    again = right.join(materialise(reached.select(*on, "_share", sample, "_most"), "shares").hint("merge"), [*on, sample])
    found = valued(x.join(to_cells(again).hint("merge"), [*on, "_share"]))
    # as a generated column, as a plan that moves the filter to the pairs writes out all steps of their value for each use
    found = found.withColumn("_w", F.explode(F.array("_v"))).where(F.col("_most").isNull() | (F.col("_w") <= F.col("_most")))
    return found.drop("_v", "_w", "_most", "_share")


def packed(rows: DataFrame, on: list[str], by: str, into: str) -> DataFrame:
    """rows with equal values of `on`, nulls among them, in arrays `into` of about PER_ROW of the other columns, and their number `size`; `by` tells rows apart."""
    counted = rows.groupBy(F.struct(*on).alias("_g")).agg(F.count("*").alias("_n"))
    cuts = counted.select("_g", F.ceil(F.col("_n") / F.lit(PER_ROW)).cast("int").alias("_cuts"))
    other = F.struct(*[c for c in rows.columns if c not in on])
    dealt = rows.select(F.struct(*on).alias("_g"), F.col(by).alias("_by"), other.alias("_row")).join(cuts.hint("merge"), "_g")
    chunks = dealt.groupBy("_g", F.pmod(F.xxhash64("_by"), F.col("_cuts")).alias("_chunk")).agg(F.collect_list("_row").alias(into), F.count("*").alias("size"))
    return chunks.select("_g.*", into, "size", F.monotonically_increasing_id().alias("_at"))


def once(rows: DataFrame, on: list[str], by: str) -> DataFrame:
    """(on, a, b): all pairs of rows that share a key and differ in `by`, as structs, each pair once with either row as a.

    A key's rows are cut by a hash of `by` into parts; each two parts are a cell of about PER_TASK pairs at most, which is a join key of its own. A row goes to as
    many cells as its key has parts, the root of what its pairs would fill.
    """
    counted = rows.groupBy(*on).agg(F.count("*").alias("_n")).where("_n > 1")
    every = counted.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2)).first()[0]
    tasks = min(4096, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((every or 0) / PER_TASK)))
    cuts = counted.select(*on, F.ceil(F.col("_n") / F.lit(math.sqrt(PER_TASK))).cast("int").alias("_cuts"))
    dealt = rows.join(cuts.hint("merge"), on).withColumn("_own", F.pmod(F.xxhash64(by), F.col("_cuts")).cast("int"))
    row = F.struct(*[c for c in rows.columns if c not in on])
    left = dealt.select(*on, row.alias("a"), F.col("_own").alias("_low"), F.explode(F.sequence("_own", F.col("_cuts") - 1)).alias("_high"))
    right = dealt.select(*on, row.alias("b"), F.explode(F.sequence(F.lit(0), "_own")).alias("_low"), F.col("_own").alias("_high"))
    cell = [*on, "_low", "_high"]
    found = left.repartition(tasks, *cell).join(right.repartition(tasks, *cell).hint("merge"), cell)
    return found.where(F.when(F.col("_low") == F.col("_high"), F.col(f"a.{by}") < F.col(f"b.{by}")).otherwise(F.col(f"a.{by}") != F.col(f"b.{by}"))).select(*on, "a", "b")


def within(rows: DataFrame, group: list[str], key: str, value: str, prepared: dict[str, Column], score: Callable[[Callable, Callable], dict[str, Column]], symmetric: bool = True) -> DataFrame:
    """(a_key, b_key and the scores): all pairs of keys of a group, a_key < b_key.

    prepared are columns of `value`, worked out once for each value of a group; score(a, b) gives columns, a and b the prepared ones of either row by name.
    Keys with one value lie in arrays of at most PER_ROW, so that two values are scored once for all keys that have them.
    """
    rows = rows.select(*group, F.col(key).alias("_key"), F.col(value).alias(value)).where(F.col("_key").isNotNull())
    place = F.row_number().over(Window.partitionBy(*group, value).orderBy("_key"))
    packed = rows.withColumn("_chunk", F.floor((place - 1) / PER_ROW)).groupBy(*group, value, "_chunk").agg(F.array_sort(F.collect_list("_key")).alias("_keys"))
    packed = packed.select(*group, "_keys", F.struct(F.get("_keys", F.lit(0)), value, "_chunk").alias("_at"), F.struct(*[c.alias(n) for n, c in prepared.items()]).alias("_v"))
    counted = rows.select(*group, F.lit(1).alias("_n"))
    sides = [packed.select(*group, *[F.col(c).alias(f"{c}{i}") for c in ("_keys", "_at", "_v")]) for i in (1, 2)]
    pairs = _dealt(*sides, group, F.col("_at1"), *_shares(counted, counted, group), F.col("_at1") <= F.col("_at2"))
    one, two = (lambda i: lambda n: F.col(f"_v{i}.{n}"))(1), (lambda i: lambda n: F.col(f"_v{i}.{n}"))(2)
    scores = {"_ab": score(one, two)} | ({} if symmetric else {"_ba": score(two, one)})
    scored = pairs.select("_keys1", "_keys2", (F.col("_at1") == F.col("_at2")).alias("_same"), *[F.struct(*[c.alias(n) for n, c in s.items()]).alias(k) for k, s in scores.items()])
    every = scored.withColumn("_p", F.explode("_keys1")).withColumn("_q", F.explode("_keys2"))
    every = every.where((F.col("_p") < F.col("_q")) | (~F.col("_same") & (F.col("_p") > F.col("_q"))))
    out = (lambda n: F.col(f"_ab.{n}")) if symmetric else (lambda n: F.when(F.col("_p") < F.col("_q"), F.col(f"_ab.{n}")).otherwise(F.col(f"_ba.{n}")))
    return every.select(F.least("_p", "_q").alias("a_key"), F.greatest("_p", "_q").alias("b_key"), *[out(n).alias(n) for n in scores["_ab"]])
