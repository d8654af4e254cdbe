"""Putting samples, calls and annotations together, ordering and paging results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import dimension


def star(samples: DataFrame, links: DataFrame, sequences: DataFrame, alignments: DataFrame, replicons: DataFrame) -> DataFrame:
    """One row for each sample, sequence and alignment. replicons is a dimension."""
    return samples.join(links, "sample").join(sequences, "sequence").join(alignments, "sequence").join(dimension(replicons), "replicon")


def assembled(samples: DataFrame, calls: DataFrame, annotations: DataFrame | None = None, entity: str = "sample") -> DataFrame:
    """samples with their calls and the calls' annotations; samples without calls and calls without annotations stay."""
    own = calls if annotations is None else calls.join(annotations, "mutation", "left")
    return samples.join(own, entity, "left")


def call_lists(samples: DataFrame, calls: DataFrame, entity: str = "sample", with_n: bool = False) -> DataFrame:
    """entity, replicon and its calls (start, end, ref, alt) by start."""
    own = calls if with_n else calls.where(~F.contains("alt", F.lit("N")))
    return samples.select(entity).join(own, entity).groupBy(entity, "replicon").agg(F.array_sort(F.collect_list(F.struct("start", "end", "ref", "alt"))).alias("calls"))


def pairs_found(wanted: DataFrame, alignments: DataFrame, keys: list[str]) -> DataFrame:
    return alignments.join(wanted.select(*keys).distinct(), keys, "left_semi")


def looked_up(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """wanted with what is stored under its key; nulls where nothing is."""
    return wanted.join(stored, key, "left")


def missing(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(stored.select(key), key, "left_anti")


def ordered(df: DataFrame, by: str = "-day", tie: str = "sample") -> DataFrame:
    """df by a column, `-` before its name for descending; nulls are first when descending, last when ascending."""
    column = F.col(by.lstrip("-"))
    return df.orderBy(column.desc_nulls_first() if by.startswith("-") else column.asc_nulls_last(), tie)


def ordered_by_property(samples: DataFrame, eav: DataFrame, name: str, descending: bool = False, entity: str = "sample") -> DataFrame:
    value = eav.where(F.col("name") == name).select(entity, F.col("value").alias("order_value"))
    return ordered(samples.join(value, entity, "left"), f"{'-' if descending else ''}order_value", entity)


def page(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of an ordered table."""
    return df.offset(offset).limit(limit)


def subset(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows by a hash of their key: the same rows whatever the partitions; all where there are no more."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def output_columns(columns: list[str], known: list[str]) -> list[str]:
    """name first, profiles and upload dates last, unknown names refused."""
    unknown = [c for c in columns if c not in known]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    last = [c for c in ("genomic_profiles", "proteomic_profiles", "init_upload_date", "last_update_date") if c in columns]
    first = [c for c in ("name",) if c in columns]
    return [*first, *(c for c in columns if c not in first and c not in last), *last]


def auto_linked(columns: list[str], properties: list[str], links: dict[str, str] | None = None, key: str = "name") -> tuple[dict[str, str], list[str]]:
    """property to input column: given links first, then columns that have a property's name in any case; and properties not found. The key must be found."""
    by_lower = {c.lower(): c for c in columns}
    out = {p: c for p, c in (links or {}).items() if c in columns}
    for p in properties:
        if p not in out and p.lower() in by_lower:
            out[p] = by_lower[p.lower()]
    if key not in out:
        raise ValueError(f"no column for {key!r}")
    return out, [p for p in properties if p not in out]
