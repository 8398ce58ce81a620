"""What a directory remembers between runs, kept up by Structured Streaming: first sightings and unresolved pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions


def first_seen(stream: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """One row per key, at its first sighting; state older than the watermark is dropped, so memory is bounded by `delay`."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def failures_by_window(stream: DataFrame, ts: str, kind: str, delay: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Failed and all attempts per window; late rows within the watermark still count."""
    window = F.window(ts, length)
    counted = stream.withWatermark(ts, delay).groupBy(window).agg(F.count_if(F.col(kind) == "error").alias("failed"), F.count("*").alias("attempts"))
    return counted.select(F.col("window.start").alias("day"), "failed", "attempts")


def drain(spark: SparkSession, result: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream until its input is used up, into Parquet files at `path`; started again, it goes on from its checkpoint."""
    query = result.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(path)


def with_memo(stream: DataFrame, memo: DataFrame, key: list[str]) -> DataFrame:
    """A stream of requests with the answers that a table already has; those without one go to the provider."""
    return stream.join(memo, key, "left")


# -- a table of all keys ever seen ----------------------------------------------------------------------------------------------
# Each batch leaves one small table under its own number, so that a batch that is delivered again only replaces itself. Now and then the
# tables so far are merged into one, and a manifest says up to which batch it goes.


def _merged(rows: DataFrame) -> DataFrame:
    """One row per key; every column can be merged again."""
    last = F.max(F.struct("last_seen", "failed")).alias("_last")
    found = rows.groupBy("k").agg(F.min("first_seen").alias("first_seen"), last, F.sum("seen").alias("seen"))
    return found.select("k", "first_seen", F.col("_last.last_seen").alias("last_seen"), "seen", F.col("_last.failed").alias("failed"))


def _batches(spark: SparkSession, root: str, after: int) -> list[int]:
    at, files = versions._path(spark, f"{root}/batches")
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit() and int(n) > after)


def remember_batch(batch: DataFrame, number: int, root: str, key: str, ts: str, failed: str, merge_every: int = 20) -> None:
    """Add a batch (key, ts, failed) to the memory at `root`; the same number again changes nothing.

    Of equal times of a key, a failure counts as the later. Null keys are left out.
    """
    spark = batch.sparkSession
    version = versions.current(spark, root)
    if version and number <= version.notes["batch"]:
        return
    rows = batch.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(ts).alias("first_seen"), F.col(ts).alias("last_seen"), F.lit(1).cast("long").alias("seen"), F.col(failed).alias("failed"))
    _merged(rows).write.mode("overwrite").parquet(f"{root}/batches/{number}")
    if len(_batches(spark, root, version.notes["batch"] if version else -1)) >= merge_every:
        merge(spark, root)


def remembered(spark: SparkSession, root: str) -> DataFrame:
    """(k, first_seen, last_seen, seen, failed): every key, when it was first and last seen, how often, and whether it failed last."""
    version = versions.current(spark, root)
    parts = [spark.read.parquet(f"{root}/batches/{n}") for n in _batches(spark, root, version.notes["batch"] if version else -1)]
    if version:
        parts.append(versions.read(spark, root, "memory"))
    if not parts:
        raise ValueError(f"nothing is remembered at {root}")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return _merged(rows)


def merge(spark: SparkSession, root: str) -> None:
    """Make one table of the memory so far; batches up to it are not read any more."""
    version = versions.current(spark, root)
    found = _batches(spark, root, version.notes["batch"] if version else -1)
    if found:
        versions.commit(spark, root, [("memory", remembered(spark, root))], {"batch": found[-1]})


def unresolved(spark: SparkSession, root: str) -> DataFrame:
    """The keys that failed when they were last seen: what a later run has to report as ongoing."""
    return remembered(spark, root).where("failed").select("k", "first_seen", "last_seen")


def remember(stream: DataFrame, root: str, key: str, ts: str, failed: str, checkpoint: str, merge_every: int = 20) -> None:
    """Run a stream until its input is used up and add it to the memory at `root`; started again, it goes on from its checkpoint."""
    add = lambda batch, number: remember_batch(batch, number, root, key, ts, failed, merge_every)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
