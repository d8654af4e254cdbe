"""Weekly shares as a stream: counts by week and group that arriving files change, without a look at what came before.

A sample counts once, by the row that arrives first, whatever comes again within `delay` of its day; counts of a week stay in the stream's state
until the watermark, the latest day seen less `delay`, has passed the week. Rows that come later than that are dropped; `too_late` counts
them. So state is bounded by the samples of a delay and not by the table. Each batch gives the counts that it changed, whole, as upserts by week and group; counts only grow, so a replayed
batch changes nothing. For much state set spark.sql.streaming.stateStore.providerClass to Spark's RocksDB provider, which keeps it off the heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.scalars import week_label
from .ingest import snapshot, upserts

COUNTS, KEYS = "monday date, `group` string, samples long", ["monday", "group"]


def weekly_counts(rows: DataFrame, group: str, delay: str, entity: str = "sample", day: str = "day") -> DataFrame:
    """monday, group and samples of streamed rows, by state with a watermark. Rows without a day are left out; weeks begin on Mondays of the session's time zone, which should be UTC."""
    timed = rows.where(F.col(day).isNotNull()).select(F.col(entity).alias("_entity"), F.col(group).cast("string").alias("group"), F.col(day).cast("timestamp").alias("_at"))
    once = timed.withWatermark("_at", delay).dropDuplicatesWithinWatermark(["_entity"])
    # The epoch is a Thursday: weeks begin four days behind it.
    week = F.window("_at", "7 days", startTime="4 days")
    return once.groupBy(week.alias("_week"), "group").agg(F.count("*").alias("samples")).select(F.col("_week.start").cast("date").alias("monday"), "group", "samples")


def stream_weekly(spark: SparkSession, source: str, target: str, schema: str, group: str, checkpoint: str, delay: str, files_per_batch: int = 100, entity: str = "sample", day: str = "day") -> StreamingQuery:
    """Starts a stream over the Parquet files that arrive in source, which ends when all that are there are counted; started again, it goes on from there."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    counts = weekly_counts(rows, group, delay, entity, day)
    return counts.writeStream.outputMode("update").foreachBatch(upserts(target, COUNTS, KEYS, "samples")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_shares(spark: SparkSession, target: str) -> DataFrame:
    """monday, week, group, samples and percent of the week, as stats.group_shares() has them, from what streams have counted so far."""
    counts = snapshot(spark, f"{target}/data", COUNTS, KEYS, "samples")
    whole = F.sum("samples").over(Window.partitionBy("monday"))
    return counts.select("monday", week_label("monday").alias("week"), "group", "samples", F.round(100.0 * F.col("samples") / whole, 2).alias("percent"))


def too_late(stream: StreamingQuery) -> int:
    """Rows of the stream's kept progress that came behind the watermark."""
    return sum(o["numRowsDroppedByWatermark"] for p in stream.recentProgress for o in p["stateOperators"])
