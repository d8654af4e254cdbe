"""Distinct counts from one cube of bitmaps: totals, series, distributions, cross tables and coverage of samples, exact and mergeable.

Samples have dense ordinals. One aggregation by GROUPING SETS makes a cell for each set of columns, combination of values and bucket of 32,768
ordinals: a bitmap of its samples, and their first and last day. Buckets share no sample, so a count is the sum of bits of a cell's buckets.
Sets that aren't there are rolled up by OR from one that has more columns, as are labels that put values together (weeks to months).
Batches go in by OR, so a sample that comes again counts once.

Columns should have few values: a cell is 4 KB a bucket, however few its samples. Values are texts; a null is a value of its own. Rows of
samples without an ordinal (not among the samples, or without a key) are left out. A sample whose value changes has both until the cube is built anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent_text, week_label
from .bitmap_index import numbered
from .scale import cut

#: A table with the sample's key, and the sets of its columns to count by.
Fact = tuple[DataFrame, Sequence[tuple[str, ...]]]
MERGED = (("bits", "bitmap_or_agg"), ("first_day", "min"), ("last_day", "max"))


@dataclass
class Cube:
    """ordinals: entity, ordinal. cells: name of the set, key (its values in order), bucket, bits, first_day, last_day."""

    ordinals: DataFrame
    cells: DataFrame
    sets: tuple[tuple[str, ...], ...]
    entity: str = "sample"


def _merged() -> list[Column]:
    return [F.call_function(f, F.col(c)).alias(c) for c, f in MERGED]


def _cells(fact: Fact, ordinals: DataFrame, entity: str, day: str) -> DataFrame:
    rows, sets = fact
    names = list(dict.fromkeys(n for s in sets for n in s))
    at = F.col(day).cast("date") if day in rows.columns else F.lit(None).cast("date")
    own = rows.select(entity, at.alias("_day"), *(F.col(n).cast("string").alias(f"_{i}") for i, n in enumerate(names))).join(ordinals, entity)
    own = own.withColumn("bucket", F.bitmap_bucket_number("ordinal"))
    column = {n: f"_{i}" for i, n in enumerate(names)}
    grouped = own.groupingSets([["bucket", *(column[n] for n in s)] for s in sets], "bucket", *column.values()).agg(
        F.grouping_id().alias("_id"), F.bitmap_construct_agg(F.bitmap_bit_position("ordinal")).alias("bits"), F.min("_day").alias("first_day"), F.max("_day").alias("last_day"))
    # Bits of a grouping's number say which columns it leaves out.
    number = {s: sum(1 << (len(names) - 1 - i) for i, n in enumerate(names) if n not in s) for s in sets}
    name, key = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for s, i in number.items():
        name = F.when(F.col("_id") == i, ",".join(s)).otherwise(name)
        key = F.when(F.col("_id") == i, F.array(*(F.col(column[n]) for n in s)).cast("array<string>")).otherwise(key)
    return grouped.select(name.alias("name"), key.alias("key"), "bucket", "bits", "first_day", "last_day")


def _of(facts: Sequence[Fact], ordinals: DataFrame, entity: str, day: str) -> DataFrame:
    out = None
    for fact in facts:
        own = _cells(fact, ordinals, entity, day)
        out = own if out is None else out.unionByName(own)
    return out


def _sets(facts: Sequence[Fact]) -> tuple[tuple[str, ...], ...]:
    sets = tuple(s for _, own in facts for s in own)
    if len({frozenset(s) for s in sets}) < len(sets):
        raise ValueError("each set of columns may be counted once, from one table")
    return sets


def build(samples: DataFrame, facts: Sequence[Fact], entity: str = "sample", day: str = "day") -> Cube:
    """The cube of all samples. Each fact is read and grouped once, whatever the number of its sets."""
    sets, ordinals = _sets(facts), numbered(samples, entity)
    return Cube(ordinals, cut(_of(facts, ordinals, entity, day)), sets, entity)


def added(cube: Cube, samples: DataFrame, facts: Sequence[Fact], day: str = "day") -> Cube:
    """The cube with a batch of samples and rows, of the same sets. Only the batch's facts are read; what came before may come again."""
    if {frozenset(s) for s in _sets(facts)} - {frozenset(s) for s in cube.sets}:
        raise ValueError("a batch can't bring sets that the cube doesn't have")
    last = cube.ordinals.agg(F.coalesce(F.max("ordinal"), F.lit(0))).first()[0]
    new = numbered(samples.join(cube.ordinals, cube.entity, "left_anti"), cube.entity, last)
    ordinals = cut(cube.ordinals.unionByName(new))
    every = cube.cells.unionByName(_of(facts, ordinals, cube.entity, day))
    return Cube(ordinals, cut(every.groupBy("name", "key", "bucket").agg(*_merged())), cube.sets, cube.entity)


def counts(cube: Cube, *names: str, labels: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The names' values, samples, first_day and last_day; values that `labels` make equal are one. By the smallest set that has all names."""
    have = [s for s in cube.sets if set(names) <= set(s)]
    if not have:
        raise ValueError(f"no set of the cube has {names}")
    least, labels = min(have, key=len), labels or {}
    value = lambda n: labels.get(n, lambda c: c)(F.get("key", F.lit(least.index(n))))
    own_names = [f"_{i}" for i in range(len(names))]
    own = cube.cells.where(F.col("name") == ",".join(least)).select(*(value(n).alias(c) for n, c in zip(names, own_names, strict=True)), "bucket", *(c for c, _ in MERGED))
    if labels or len(least) > len(names):
        own = own.groupBy(*own_names, "bucket").agg(*_merged())
    found = own.groupBy(*own_names).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("samples"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    return found.toDF(*names, "samples", "first_day", "last_day")


def totals(cube: Cube) -> DataFrame:
    """As stats.totals: one row, also of no samples."""
    return counts(cube)


def per_week(cube: Cube, monday: str = "monday") -> DataFrame:
    """As stats.per_week."""
    return counts(cube, monday).where(F.col(monday).isNotNull()).select(F.col(monday).cast("date").alias("monday"), week_label(F.col(monday).cast("date")).alias("week"), "samples")


def distribution(cube: Cube, name: str, missing: str | None = None) -> DataFrame:
    """As stats.distribution: value and samples; with `missing`, samples without a value count under that name."""
    if missing is not None:
        return counts(cube, name, labels={name: lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(missing))}).select(F.col(name).alias("value"), "samples")
    return counts(cube, name).where(F.col(name).isNotNull()).select(F.col(name).alias("value"), "samples")


def cross_table(cube: Cube, x: str, y: str) -> DataFrame:
    """As stats.cross_table: x, y and samples where both are there."""
    return counts(cube, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"), "samples")


def _single(cube: Cube, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The names as rows, and the cells of their own sets that hold data."""
    lacking = [n for n in names if (n,) not in cube.sets]
    if lacking:
        raise ValueError(f"the cube has no sets of {lacking} alone")
    value = F.get("key", F.lit(0))
    return cube.cells.sparkSession.createDataFrame([(n,) for n in names], "property string"), cube.cells.where(F.col("name").isin(*names) & value.isNotNull() & (F.trim(value) != "")).withColumn("value", value)


def coverage(cube: Cube, names: Sequence[str]) -> DataFrame:
    """As stats.coverage of fields: property and n, the samples that hold data, all names in one pass over their cells."""
    rows, own = _single(cube, names)
    held = own.groupBy("name", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).groupBy(F.col("name").alias("property")).agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return rows.join(held, "property", "left").select("property", F.coalesce("n", F.lit(0)).alias("n"))


def catalogue(cube: Cube, names: Sequence[str]) -> DataFrame:
    """As stats.catalogue of fields: property and distinct, how many values that are not empty."""
    rows, own = _single(cube, names)
    held = own.groupBy(F.col("name").alias("property")).agg(F.count_distinct("value").alias("distinct"))
    return rows.join(held, "property", "left").select("property", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def report(cube: Cube, organism: str = "reference", accession: str = "replicon") -> DataFrame:
    """organism, samples, first_day, last_day, its accessions in order (a text), and its share of all samples."""
    both = counts(cube, organism, accession).where(F.col(organism).isNotNull()).groupBy(organism).agg(F.array_join(F.array_sort(F.collect_set(accession)), ",").alias("replicons"))
    own = counts(cube, organism).join(both, organism)
    total = totals(cube).select(F.col("samples").alias("total"))
    return own.crossJoin(F.broadcast(total)).select(F.col(organism).alias("organism"), "samples", "first_day", "last_day", "replicons", percent_text("samples", "total").alias("share"))
