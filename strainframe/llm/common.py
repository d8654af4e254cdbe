"""What the operators of this subpackage share: reading tables, cutting lineage, joins that split hot keys."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables with more rows are not broadcast; parts that a key is dealt to in a join with such a table.
BROADCAST_ROWS, SALTS = 200_000, 16
#: Tables written within the innermost block of cleared(), of this thread alone.
_written: ContextVar[list[str] | None] = ContextVar("_written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strainframe-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives the loss of executors. cleared() deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (tables := _written.get()) is not None:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def cleared(spark: SparkSession):
    """Deletes at its end the tables that operators wrote within it, in the same thread: for callers that have stored their results by then."""
    token = _written.set([])
    try:
        yield
    finally:
        for path in _written.get() or []:
            deleted(spark, path)
        _written.reset(token)


def dealt(rows: DataFrame, few: DataFrame, spread: Column, hot: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """rows with a _salt by the hash of spread, and few once for each of SALTS; where hot, a condition on the key, is not met: with one salt, and once."""
    every, own = F.sequence(F.lit(0), F.lit(SALTS - 1)), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    if hot is not None:
        every, own = F.when(hot, every).otherwise(F.array(F.lit(0))), F.when(hot, own).otherwise(0)
    return rows.withColumn("_salt", own), few.withColumn("_salt", F.explode(every))


def met(rows: DataFrame, few: DataFrame, on: list[str], how: str, spread: Column, hot: Column | None = None) -> DataFrame:
    """rows joined with few, which has one row a key: by broadcast up to BROADCAST_ROWS; beyond that a key's rows are
    dealt to SALTS tasks by the hash of spread, so that no task meets all rows of a hot key. hot: which keys may be that, all if not given.
    Such a join is sorted and merged: left to itself Spark broadcasts what takes under 10 MB on disk, whatever its rows, and here SALTS times."""
    if small_enough(few, BROADCAST_ROWS):
        return rows.join(F.broadcast(few), on, how)
    rows, few = dealt(rows, few, spread, hot)
    return rows.join(few.hint("merge"), [*on, "_salt"], how).drop("_salt")


def text_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null becomes empty) and the columns in more; whatever else the table has is left out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows
