"""Streaming queries, run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialise, shared_dir
from ..streaming import memory
from .registry import Tables, query


@query("""SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS failed, count(*) AS attempts FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1""")
def stream_failures_by_day(t: Tables) -> DataFrame:
    """Failed and all events per day; days that the watermark has not passed are still open and not shown."""
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    result = memory.failures_by_window(source.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    path = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    return memory.drain(t.spark, result, f"{path}/out", f"{path}/state").select(F.col("day").cast("date").alias("day"), "failed", "attempts")


@query(
    """SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen, arg_max(event_type = 'error', (ts, event_type = 'error')) AS failed FROM events GROUP BY user_id"""
)
def discovery_memory(t: Tables) -> DataFrame:
    """Every user's first and last sighting, from a stream of several batches of which the last is delivered twice."""
    files = materialise(t.events.select("user_id", "ts", "event_type").repartition(6, "ts"), "events")
    rows = t.spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 2).parquet(files._written_to).withColumn("failed", F.col("event_type") == "error")
    root = f"{shared_dir(t.spark)}/memory-{uuid.uuid4().hex}"
    memory.remember(rows, root, "user_id", "ts", "failed", f"{root}-state", merge_every=2)
    last = files.withColumn("failed", F.col("event_type") == "error")
    memory.remember_batch(last, 0, root, "user_id", "ts", "failed")  # a number that is part of the memory already
    return memory.remembered(t.spark, root).withColumnRenamed("k", "user_id")
