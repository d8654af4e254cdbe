"""What holds at any size: broadcasts behind a count of rows and bytes, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Rows and bytes up to which a dimension is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 256 << 20
#: Rows of a task where partitions are dealt by rows.
TASK_ROWS = 1_000_000


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row has: texts and binaries by their length, nested values by their text."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + 8
    return size


def few(df: DataFrame, rows: int = BROADCAST_ROWS, size: int | None = None) -> bool:
    """Whether df has at most so many rows and so many bytes (BROADCAST_BYTES if not given); looks at no more rows than that."""
    n, found = df.limit(rows + 1).select(_bytes(df).alias("_bytes")).agg(F.count("*"), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    return n <= rows and found <= (BROADCAST_BYTES if size is None else size)


def side(df: DataFrame, small: bool) -> DataFrame:
    """df for a side of a join: broadcast if it is small, else sorted and merged. Left to itself Spark broadcasts what takes under 10 MB on disk, which can be
    a million rows, and in rounds of joins each of these goes through the driver."""
    return F.broadcast(df) if small else df.hint("merge")


def dimension(df: DataFrame) -> DataFrame:
    """df for the small side of a join: broadcast where it is small, else for a shuffle join, whose hot keys Spark splits."""
    return side(df, few(df))


def tasks(*tables: DataFrame) -> int:
    """How many tasks the rows of these tables need, TASK_ROWS each."""
    return sum(t.count() for t in tables) // TASK_ROWS + 1


def existing(df: DataFrame, others: DataFrame, keys: list[str], how: str, n: int | None = None) -> DataFrame:
    """A semi or anti join whose tasks have about TASK_ROWS rows: others is broadcast where it is small, else both sides are dealt to n tasks. Left to itself
    Spark broadcasts or merges partitions by bytes as they are compressed, of which a row of a dense key has one or two, and a task sorts what is in them."""
    others = others.select(*keys)
    if few(others):
        return df.join(F.broadcast(others), keys, how)
    n = n or tasks(df, others)
    return df.repartition(n, *keys).join(others.repartition(n, *keys).hint("merge"), keys, how)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Only a local session may do without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strainframe-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so lineage stays short."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the folder of a table that cut() wrote: for callers that have stored what they made of it."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/cut-" in f}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
