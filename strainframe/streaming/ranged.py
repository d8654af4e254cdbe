"""Tables that batches change range by range: what a batch doesn't touch is neither read nor written.

Keys lie in ranges of fixed width, which never move: `key div width` for whole numbers, and one of width groups by hash otherwise. A batch reads the
present rows of the ranges it touches, merges them with its own and writes these ranges once more as `data/batch=n/range=r`; its log,
written last, names them. The table is, for each range, what the last logged batch with this range wrote. A batch that ends early has no log and
counts for nothing; a batch that is replayed reads what was there before it and writes the same again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegralType, StructType

from ..operators.maintain import last_wins
from ..operators.scale import dimension
from .ingest import _deleted, _listed


class RangedTable:
    """A table of rows by key at a path. order: the column by which the last row of a key wins."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: str, width: int = 100_000) -> None:
        self.spark, self.path, self.schema, self.keys, self.order, self.width = spark, path, StructType.fromDDL(schema), keys, order, width

    def range_of(self) -> Column:
        """The range of a row, by its first key."""
        if isinstance(self.schema[self.keys[0]].dataType, IntegralType):
            return F.coalesce(F.floor(F.col(self.keys[0]) / self.width), F.lit(-1)).cast("long")
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.width))

    def batches(self, before: int | None = None) -> list[int]:
        """Numbers of the batches that are whole."""
        numbers = sorted(int(n.split("=")[1]) for n in _listed(self.spark, f"{self.path}/log") if n.startswith("batch="))
        return [n for n in numbers if before is None or n < before]

    def versions(self, before: int | None = None) -> DataFrame:
        """range and the batch that wrote it last."""
        numbers = self.batches(before)
        if not numbers:
            return self.spark.createDataFrame([], "range long, batch long")
        logs = self.spark.read.schema("range long, rows long, batch long").option("basePath", f"{self.path}/log").parquet(*(f"{self.path}/log/batch={n}" for n in numbers))
        return logs.groupBy("range").agg(F.max("batch").alias("batch"))

    def read(self, before: int | None = None, ranges: DataFrame | None = None) -> DataFrame:
        """The table's rows with range and batch, of the batches before a number and of some ranges if given. Versions prune the folders that are read."""
        current = self.versions(before)
        if ranges is not None:
            current = current.join(dimension(ranges), "range", "left_semi")
        used = sorted(r.batch for r in current.select("batch").distinct().collect())
        schema = StructType.fromDDL(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in self.schema)}, batch long, range long")
        if not used:
            return self.spark.createDataFrame([], schema)
        data = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/batch={n}" for n in used))
        return data.join(dimension(current), ["batch", "range"], "left_semi").select(*schema.fieldNames())

    def snapshot(self) -> DataFrame:
        return self.read().select(*self.schema.fieldNames())

    def apply(self, batch: DataFrame, number: int) -> None:
        """Merges a batch of rows into the ranges that it touches."""
        own = batch.select(*self.schema.fieldNames()).withColumn("range", self.range_of())
        touched = own.groupBy("range").agg(F.count("*").alias("rows"))
        stored = self.read(number, touched.select("range")).drop("batch")
        merged = last_wins(stored.select(*own.columns).unionByName(own), ["range", *self.keys], self.order)
        # A range has at most width keys, so one task may write it.
        merged.repartition("range").write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/data/batch={number}")
        touched.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/batch={number}")

    def ingest(self, source: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
        """Starts a stream over the Parquet files that arrive in source, which ends when all that are there are applied."""
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        return rows.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes the folders of ranges that were replaced before the last keep batches, and returns them. Readers of older versions must be done."""
        numbers = self.batches()
        if len(numbers) <= keep:
            return []
        current, old = self.versions(numbers[-keep] if keep else None), self.spark.read.schema("range long, rows long, batch long").option("basePath", f"{self.path}/log").parquet(*(f"{self.path}/log/batch={n}" for n in numbers))
        held = current.unionByName(old.where(F.col("batch") >= numbers[-keep]).select("range", "batch")) if keep else current
        gone = [f"{self.path}/data/batch={r.batch}/range={r.range}" for r in old.select("range", "batch").join(held, ["range", "batch"], "left_anti").collect()]
        for path in gone:
            _deleted(self.spark, path)
        return gone
