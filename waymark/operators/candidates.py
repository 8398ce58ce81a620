"""Coordinates from independent candidates: scores, agreement and the stage at which a place is settled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numbers import places
from ..sources.storage import materialise


def resolve(candidates: DataFrame, entity: str = "entity") -> DataFrame:
    """One row per entity: seq and source path of the chosen candidate, verification, confidence, agreement and paths.

    candidates has entity, seq (unique within it), path, lat, lng, tier, postcode, want_postcode and score (null: rejected). Two
    candidates of different paths that lie within their agreement limit verify each other; the pair with the highest
    scores, then the least gap, then the least seq counts. An entity has a handful of candidates.
    """
    live = candidates.where("score IS NOT NULL")
    best = Window.partitionBy(entity).orderBy(F.desc("score"), "seq")
    top = live.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select(entity, *[F.col(c).alias(f"best_{c}") for c in ("seq", "path", "score")])
    x, y = live.alias("x"), live.alias("y")
    gap = geo.haversine_km(F.col("x.lat"), F.col("x.lng"), F.col("y.lat"), F.col("y.lng"))
    limit = geo.agreement_limit(F.col("x.tier"), F.col("y.tier"), F.col("x.postcode"), F.col("y.postcode"), F.col("x.want_postcode"))
    first = (F.col("x.score") > F.col("y.score")) | ((F.col("x.score") == F.col("y.score")) & (F.col("x.seq") < F.col("y.seq")))
    pairs = x.join(y, (F.col(f"x.{entity}") == F.col(f"y.{entity}")) & (F.col("x.path") != F.col("y.path")) & first)
    pairs = pairs.select(
        F.col(f"x.{entity}").alias(entity), F.col("x.seq").alias("seq"), F.col("y.seq").alias("other"), F.col("x.path").alias("path"), F.col("x.score").alias("score"),
        F.array_sort(F.array("x.path", "y.path")).alias("paths"), (F.col("x.score") + F.col("y.score")).alias("total"), gap.alias("gap"), (gap <= limit).alias("agree"),
    )
    order = F.struct((-F.col("total")).alias("t"), "gap", "seq", "other")
    agreeing = pairs.where("agree").groupBy(entity).agg(F.min_by(F.struct("seq", "path", "score", "paths", "gap"), order).alias("pair"))
    nearest = pairs.join(top, entity).where("seq = best_seq OR other = best_seq").groupBy(entity).agg(F.min("gap").alias("nearest"))
    joined = top.join(agreeing, entity, "left").join(nearest, entity, "left")
    pair = F.col("pair")
    return joined.select(entity, F.coalesce(pair["seq"], "best_seq").alias("seq"), F.coalesce(pair["path"], "best_path").alias("path"), *verdict(pair, F.struct(F.col("best_path").alias("path"), F.col("best_score").alias("score")), F.col("nearest")))


def verdict(pair: Column, best: Column, nearest: Column) -> list[Column]:
    """verification, confidence, paths and agreement_km, by the pair that agrees (path, score, paths, gap) or null, the best candidate (path, score), and how near the nearest of another path is to it."""
    agreed, path, score = pair.isNotNull(), F.coalesce(pair["path"], best["path"]), F.coalesce(pair["score"], best["score"])
    admin = path == "admin"
    two = lambda c: places(c, 2)
    return [
        F.when(admin | agreed, "verified").when(nearest > geo.DIVERGE_KM, "conflicted").when(nearest.isNotNull(), "approximate").otherwise("unverified").alias("verification"),
        F.when(admin, F.lit(0.98)).when(agreed, two(F.least(F.lit(1.0), 0.55 + 0.08 * score))).when(nearest > geo.DIVERGE_KM, F.lit(0.2)).when(nearest.isNotNull(), F.lit(0.35))
        .otherwise(two(F.least(F.lit(0.45), 0.2 + 0.05 * score))).alias("confidence"),
        F.when(admin, F.array(F.lit("admin"))).when(agreed, pair["paths"]).otherwise(F.array(best["path"])).alias("paths"),
        F.when(~admin & agreed, places(pair["gap"], 3)).alias("agreement_km"),
    ]


def staged(candidates: DataFrame, entity: str = "entity", stage: str = "stage", stages: int = 4) -> DataFrame:
    """The result of the first stage at which an entity is verified, from all candidates up to it; else of all stages.

    Each stage is resolved for the entities that are still open, so that work shrinks as entities are settled.
    """
    done, open_rows = None, candidates
    for last in range(1, stages + 1):
        found = resolve(open_rows.where(F.col(stage) <= last), entity).withColumn(stage, F.lit(last))
        settled = found if last == stages else found.where("verification = 'verified'")
        done = settled if done is None else done.unionByName(settled)
        open_rows = open_rows.join(settled.select(entity), entity, "left_anti")
    return done


def missing_lookups(requests: DataFrame, memo: DataFrame, key: list[str]) -> DataFrame:
    """The distinct requests that the memo table of past answers does not hold; empty answers are held, failures are not."""
    return requests.join(memo.select(*key), key, "left_anti").dropDuplicates(key)


def rationed(requests: DataFrame, provider: str, order: list[str], budgets: DataFrame) -> DataFrame:
    """requests with `allowed`: whether it is among its provider's first n, of budgets (provider, n); `order` is unique within a provider.

    Only ranks up to the largest budget are computed, which Spark cuts before it shuffles; each provider's last allowed request is then
    compared with all of its requests, so that no provider is sorted whole.
    """
    limits = budgets.groupBy(F.col("provider").alias("_p")).agg(F.max("n").alias("_n")).where("_n > 0")
    most = limits.agg(F.max("_n")).first()[0] or 0
    rank = F.row_number().over(Window.partitionBy(provider).orderBy(*order))
    first = requests.select(provider, *order).withColumn("_rank", rank).where(F.col("_rank") <= most)
    last = first.join(limits, F.col(provider) == F.col("_p")).where("_rank <= _n").groupBy("_p").agg(F.max(F.struct(*order)).alias("_last"))
    joined = requests.join(last, F.col(provider) == F.col("_p"), "left")
    return joined.withColumn("allowed", F.coalesce(F.struct(*order) <= F.col("_last"), F.lit(False))).drop("_p", "_last")


def charged(requests: DataFrame, provider: str, attempts: str, order: list[str], budgets: DataFrame) -> DataFrame:
    """requests with `before`, the attempts of its provider's earlier requests, and `paid`, how many of its own the provider's budget still covers.

    Each attempt counts, a retry as much as a first one: a request may begin while something is left, and stops when nothing is. `order` is unique
    within a provider; a provider that budgets (provider, n) does not name pays for none. Requests are dealt by ranges of provider and order. A running
    sum within each part and the sums of the parts before it give the place of each, so that no provider is sorted in one task.
    """
    dealt = requests.repartitionByRange(provider, *order).withColumn("_part", F.spark_partition_id())
    parts = materialise(dealt, "requests")
    each = F.coalesce(F.col(attempts), F.lit(0)).cast("long")
    sums = parts.groupBy(provider, "_part").agg(F.sum(each).alias("_sum"))
    earlier = Window.partitionBy(provider).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = sums.select(F.col(provider).alias("_p"), F.col("_part").alias("_q"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(provider, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_inside", F.coalesce(F.sum(each).over(inside), F.lit(0)))
    limits = budgets.groupBy(F.col("provider").alias("_b")).agg(F.max("n").cast("long").alias("_n"))
    joined = placed.join(offsets, F.col(provider).eqNullSafe(F.col("_p")) & (F.col("_part") == F.col("_q"))).join(limits, F.col(provider) == F.col("_b"), "left")
    left = F.coalesce("_n", F.lit(0)) - F.col("before")
    return joined.withColumn("before", F.col("_inside") + F.col("_offset")).withColumn("paid", F.greatest(F.lit(0), F.least(left, each))).drop("_part", "_p", "_q", "_b", "_n", "_inside", "_offset")
