"""Pages of an ordered table by an index of its ranges: a page opens the ranges it lies in, whatever its offset.

The table is stored in ranges of the order, each with its number of rows and its last key in a manifest. Offsets go by running sums of the
numbers, seeks by the last keys. Order is by one column, `-` before its name for descending (nulls first then, else last), and by a key that
breaks ties and has no nulls, so a value that most rows have is split too. Rows of one value and key stand in any order.
The manifest has a row for each range, which the reader takes as a list.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scale import cut, dropped

ROWS_A_RANGE = 100_000
RANGES_A_GROUP = 1 << 32
MANIFEST, ABOUT, RANGE, GROUP = "_manifest", "_about", "range_number", "range_group"


def _order(by: str, tie: str) -> list[Column]:
    column = F.col(by.lstrip("-"))
    return [column.desc_nulls_first() if by.startswith("-") else column.asc_nulls_last(), F.col(tie).asc()]


def _later(by: str, value: Column, key: Column, than: Column, than_key: Column) -> Column:
    """Whether (value, key) stands behind (than, than_key)."""
    if by.startswith("-"):
        behind = (value < than) | (value.isNotNull() & than.isNull())
    else:
        behind = (value > than) | (value.isNull() & than.isNotNull())
    return F.coalesce(behind, F.lit(False)) | (value.eqNullSafe(than) & (key > than_key))


def write_pages(df: DataFrame, path: str, by: str, tie: str, rows_a_range: int = ROWS_A_RANGE) -> None:
    """Stores df at a new path, in ranges. What the table is comes last, and without it a store can't be opened, so a write that ended early shows nothing."""
    column, rows = by.lstrip("-"), df.count()
    # A task and its folder hold many small ranges: with one for each, tasks and folders would grow with the rows, and what the driver gets of them.
    number = max(1, -(-rows // max(rows_a_range, ROWS_A_RANGE)))
    # The number of a range is made of its task's and of its rows' places there, and a task that runs again has the same ones.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = df.repartitionByRange(number, *_order(by, tie)).sortWithinPartitions(*_order(by, tie))
    dealt = sorted_.withColumn(RANGE, F.spark_partition_id().cast("long") * RANGES_A_GROUP + F.floor(place / rows_a_range)).withColumn(GROUP, F.floor(F.col(RANGE) / RANGES_A_GROUP))
    dealt.write.partitionBy(GROUP).parquet(path)
    stored = df.sparkSession.read.schema(dealt.schema).parquet(path)
    last = F.min(column) if by.startswith("-") else F.when(F.count(column) == F.count("*"), F.max(column))
    ends = cut(stored.groupBy(RANGE).agg(F.count("*").alias("rows"), last.alias("last_value")))
    keys = stored.alias("s").join(F.broadcast(ends.alias("e")), RANGE).where(F.col(f"s.{column}").eqNullSafe(F.col("e.last_value"))).groupBy(RANGE).agg(F.max(f"s.{tie}").alias("last_key"))
    ends.join(keys, RANGE).coalesce(1).write.parquet(f"{path}/{MANIFEST}")
    dropped(ends)
    df.sparkSession.range(1).select(F.lit(by).alias("by"), F.lit(tie).alias("tie"), F.lit(dealt.schema.json()).alias("schema")).write.parquet(f"{path}/{ABOUT}")


@dataclass
class Pages:
    """A stored order, opened."""

    whole: DataFrame
    manifest: DataFrame
    ranges: list[int]
    sums: list[int]  # rows up to and with each range
    by: str
    tie: str

    @property
    def total(self) -> int:
        return self.sums[-1] if self.sums else 0

    def _rows(self, first: int, last: int) -> DataFrame:
        """The rows of the ranges at places first to last: a condition on their folders, which alone are opened, and on the ranges in them."""
        if first > last or first >= len(self.ranges):
            return self.whole.drop(RANGE, GROUP).limit(0)
        a, b = self.ranges[first], self.ranges[last]
        return self.whole.where(F.col(GROUP).between(a // RANGES_A_GROUP, b // RANGES_A_GROUP) & F.col(RANGE).between(a, b)).drop(RANGE, GROUP)

    def page(self, limit: int = 100, offset: int = 0, with_total: bool = False) -> DataFrame:
        """Rows offset to offset + limit, in order; with_total: and total, the number of all rows."""
        first = bisect_right(self.sums, offset)
        if first == len(self.sums):
            out = self.whole.drop(RANGE, GROUP).limit(0)
        else:
            last = min(bisect_right(self.sums, offset + limit - 1), len(self.sums) - 1)
            out = self._rows(first, max(first, last)).orderBy(*_order(self.by, self.tie)).offset(offset - (self.sums[first - 1] if first else 0)).limit(limit)
        return out.withColumn("total", F.lit(self.total).cast("long")) if with_total else out

    def after(self, value: object, key: object, limit: int = 100) -> DataFrame:
        """The rows that follow (value, key), which need not be in the table: the next page of one that ended there, though rows came in before it."""
        type_of = {f.name: f.dataType for f in self.whole.schema.fields}
        column = self.by.lstrip("-")
        than, than_key = F.lit(value).cast(type_of[column]), F.lit(key).cast(type_of[self.tie])
        start = self.manifest.where(_later(self.by, F.col("last_value"), F.col("last_key"), than, than_key)).agg(F.min(RANGE)).first()[0]
        if start is None:
            return self.whole.drop(RANGE, GROUP).limit(0)
        first = self.ranges.index(start)
        # The first range may have one such row only, so the page ends within `limit` rows behind it.
        last = min(bisect_right(self.sums, self.sums[first] + limit - 1), len(self.sums) - 1)
        return self._rows(first, last).where(_later(self.by, F.col(column), F.col(self.tie), than, than_key)).orderBy(*_order(self.by, self.tie)).limit(limit)


def open_pages(spark: SparkSession, path: str) -> Pages:
    by, tie, schema = spark.read.parquet(f"{path}/{ABOUT}").select("by", "tie", "schema").first()
    manifest = spark.read.parquet(f"{path}/{MANIFEST}")
    rows = manifest.select(RANGE, "rows").orderBy(RANGE).collect()
    return Pages(spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(path), manifest, [r[RANGE] for r in rows], list(accumulate(r["rows"] for r in rows)), by, tie)
