"""Deterministic stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import fnv1a


def round_robin(rows: DataFrame, stratum: str, key: str, most: int, strata: int = 25) -> DataFrame:
    """`most` rows, one of each stratum in turn: the `strata` largest, in order of size then name; inside by hash then key.

    The ranks inside a stratum are cut at `most` as they are made, so a large stratum is not sorted whole.
    """
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), stratum).limit(min(most, strata))
    placed = sizes.withColumn("_place", F.row_number().over(Window.orderBy(F.desc("_n"), stratum))).drop("_n")  # at most `strata` rows
    inside = Window.partitionBy(stratum).orderBy("hash", key)
    ranked = rows.join(F.broadcast(placed), stratum).withColumn("hash", fnv1a(F.col(key))).withColumn("round", F.row_number().over(inside)).where(F.col("round") <= most)
    return ranked.orderBy("round", "_place").limit(most).drop("_place")
