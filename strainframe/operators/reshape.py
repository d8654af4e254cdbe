"""Reshaping: typed key/value properties and wide tables, profiles per sample, nested reference trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_value
from .scale import TASK_ROWS, tasks

VALUE_COLUMNS = ("value_integer", "value_float", "value_text", "value_varchar", "value_date", "value_zip")


def eav_value(columns: tuple[str, ...] = VALUE_COLUMNS) -> Column:
    """The value of a row: its first typed column that is not null."""
    return first_value(*columns)


def to_wide(eav: DataFrame, names: list[str], entity: str = "sample") -> DataFrame:
    """One row for each entity, a column for each of the names (the registry's)."""
    return eav.groupBy(entity).pivot("name", names).agg(F.first("value"))


def to_long(wide: DataFrame, types: dict[str, str], entity: str = "sample") -> DataFrame:
    """entity, name and typed value columns; missing values make no row. types: property to value column."""
    long = wide.select(entity, *(F.col(n).cast("string").alias(n) for n in types)).unpivot(entity, list(types), "name", "raw").where("raw IS NOT NULL")
    of = lambda column: F.col("name").isin(*[n for n, c in types.items() if c == column])
    casts = {"value_integer": "bigint", "value_float": "double", "value_date": "date"}
    return long.select(entity, "name", *(F.when(of(c), F.col("raw").try_cast(casts.get(c, "string"))).alias(c) for c in VALUE_COLUMNS))


def split_columns(columns: list[str], fixed: list[str], key: str) -> tuple[list[str], list[str]]:
    """The sample fields and the custom properties among input columns, the key apart."""
    return [c for c in columns if c in fixed and c != key], [c for c in columns if c not in fixed and c != key]


def profiles(calls: DataFrame, entity: str = "sample", name: str = "replicon", annotation: str | None = "annotation") -> DataFrame:
    """entity and profile: array of (name, items of (label, annotations)), sorted by name and label; annotations distinct and sorted."""
    notes = F.array_sort(F.collect_set(F.nullif(F.col(annotation), F.lit("")))) if annotation else F.array().cast("array<string>")
    items = calls.groupBy(entity, F.col(name).alias("name"), "label").agg(notes.alias("annotations"))
    named = items.groupBy(entity, "name").agg(F.array_sort(F.collect_list(F.struct("label", "annotations"))).alias("items"))
    return named.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("name", "items"))).alias("profile"))


def profile_map(profile: Column) -> Column:
    """A profile as map of name to map of label to annotations (maps keep no order)."""
    return F.map_from_entries(F.transform(profile, lambda p: F.struct(p["name"], F.map_from_entries(F.transform(p["items"], lambda i: F.struct(i["label"], i["annotations"]))))))


def property_list(samples: DataFrame, fields: list[str], eav: DataFrame | None = None, lengths: DataFrame | None = None, entity: str = "sample") -> DataFrame:
    """entity and properties: (name, value) of its fields with data, its custom values and its sequences' lengths, sorted by name."""
    kinds = dict(samples.dtypes)
    rows = samples.select(entity, F.explode(F.array(*(F.struct(F.lit(f).alias("name"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select(entity, "x.*").where("value IS NOT NULL AND value <> ''")
    if eav is not None:
        rows = rows.unionByName(eav.select(entity, "name", F.col("value").cast("string").alias("value")).where("value IS NOT NULL"))
    if lengths is not None:
        lengths = lengths.withColumn(entity, F.col(entity).cast(kinds[entity]))
        rows = rows.unionByName(lengths.repartition(tasks(lengths), entity).groupBy(entity).agg(F.array_join(F.transform(F.array_sort(F.collect_set("length")), lambda x: x.cast("string")), ",").alias("value")).select(entity, F.lit("lengths").alias("name"), "value"))
    # A sample has few rows, and lists are no smaller than these: dealt by rows, a task's memory does not grow with the table.
    n = len(fields) * samples.count() // TASK_ROWS + (0 if eav is None else tasks(eav)) + 1
    return rows.repartition(n, entity).groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("properties"))


def wide_profiles(calls: DataFrame, names: list[str], entity: str = "sample", name: str = "replicon") -> DataFrame:
    """One column for each known name with its labels joined by ', '."""
    return calls.groupBy(entity).pivot(name, names).agg(F.array_join(F.array_sort(F.collect_set("label")), ", "))


def reference_tree(genes: DataFrame, cds: DataFrame, segments: DataFrame, peptides: DataFrame | None = None, peptide_segments: DataFrame | None = None) -> DataFrame:
    """gene with cds, their segments (by order), peptides and their segments. Built bottom up, children of one parent are few."""
    parts = segments.groupBy("cds").agg(F.array_sort(F.collect_list(F.struct("order", "start", "end", "strand"))).alias("segments"))
    own = cds.join(parts, "cds", "left")
    inner = ["cds", "segments"]
    if peptides is not None:
        p = peptides
        fields = ["peptide"]
        if peptide_segments is not None:
            p = p.join(peptide_segments.groupBy("peptide").agg(F.array_sort(F.collect_list(F.struct("order", "start", "end"))).alias("peptide_parts")), "peptide", "left")
            fields.append("peptide_parts")
        own = own.join(p.groupBy("cds").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("peptides")), "cds", "left")
        inner.append("peptides")
    return genes.join(own.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct(*inner))).alias("cds")), "gene", "left")
