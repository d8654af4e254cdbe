"""Ingest as a stream: files that arrive are applied as batches of upserts, and each batch is logged once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.maintain import last_wins


#: Batches whose changes are kept beside the last whole table; then they are made one.
COMPACT = 20


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables below a path that are whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))) if fs.exists(root) else []


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def snapshot(spark: SparkSession, path: str, schema: str, keys: list[str], order: str, before: int | None = None) -> DataFrame:
    """The table below a path, of the batches before a number if given: the last whole table and the changes since; empty where there is none."""
    names = [n for n in _listed(spark, path) if before is None or n.split("-")[1] < f"{before:012d}"]
    whole = [n for n in names if n.startswith("whole")][-1:]
    since = [n for n in names if n.startswith("change") and (not whole or n.split("-")[1] > whole[0].split("-")[1])]
    if not whole + since:
        return spark.createDataFrame([], schema)
    return last_wins(spark.read.schema(schema).parquet(*(f"{path}/{n}" for n in whole + since)), keys, order)


def upserts(target: str, schema: str, keys: list[str], order: str, compact: int = COMPACT) -> Callable[[DataFrame, int], None]:
    """What a stream does with each batch: writes its changes (the row of a key with the highest order) to target's data and a row to its log.

    Each `compact` batches the changes and the table before them become one table, and what that replaces is deleted one such turn later. A batch
    that is replayed writes its changes and log row again, under the same names, so it counts once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        session, data = batch.sparkSession, f"{target}/data"
        last_wins(batch, keys, order).write.mode("overwrite").parquet(f"{data}/change-{number:012d}")
        if number % compact == compact - 1:
            # Read from what was there before this batch, and from its changes: a replay reads the same.
            snapshot(session, data, schema, keys, order, number).unionByName(session.read.schema(schema).parquet(f"{data}/change-{number:012d}")).transform(lambda t: last_wins(t, keys, order)).write.mode("overwrite").parquet(f"{data}/whole-{number:012d}")
            for name in _listed(session, data):
                if int(name.split("-")[1]) <= number - compact and name != f"whole-{number - compact:012d}":
                    _deleted(session, f"{data}/{name}")
        batch.agg(F.lit(number).alias("batch"), F.count("*").alias("rows"), F.lit(True).alias("success")).write.mode("overwrite").parquet(f"{target}/log/batch={number}")

    return apply


def ingest(spark: SparkSession, source: str, target: str, schema: str, keys: list[str], order: str, checkpoint: str, files_per_batch: int = 100, compact: int = COMPACT) -> StreamingQuery:
    """Starts a stream over the Parquet files that arrive in source, which ends when all that are there are applied as upserts()."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(upserts(target, schema, keys, order, compact)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
