"""Keeping tables: incremental selection, upserts as snapshots, cascading deletes, quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import typed
from .reshape import split_columns, to_long
from .scale import existing, tasks


def to_process(incoming: DataFrame, stored: DataFrame, key: str = "name", hash_column: str = "seqhash", force: bool = False) -> DataFrame:
    """Rows that are new, or whose hash changed, or all of them; with reason."""
    old = stored.select(key, F.col(hash_column).alias("_old"))
    joined = incoming.join(old, key, "left")
    reason = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col(hash_column), "changed").when(F.lit(force), "forced")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").drop("_old")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the highest ingest order; of equals the one whose other values have the highest hash."""
    others = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(F.col(order), F.xxhash64(*others))).alias("_row")
    return rows.groupBy(*keys).agg(last).select(*(c if c in keys else F.col("_row").getField(c).alias(c) for c in rows.columns))


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A new snapshot: incoming rows replace stored ones of their key; of several the last wins. Stored rows keep their place where order is lower."""
    return last_wins(stored.unionByName(incoming, allowMissingColumns=True), keys, order)


def inserted(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """stored and the incoming rows of new keys, one of each."""
    return stored.unionByName(incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def metadata_upserted(samples: DataFrame, eav: DataFrame, incoming: DataFrame, fixed: list[str], types: dict[str, str], key: str = "sample", order: str = "ingest_seq", links: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """New snapshots of samples and of typed properties from wide rows of text; and of sample-sequence links where given.

    A row's `sequences` (a list in one text) replaces the sample's links.
    """
    fields, custom = split_columns([c for c in incoming.columns if c not in (order, "sequences")], fixed, key)
    last = last_wins(incoming, [key], order)
    new = upserted(samples, last.select(key, *fields, order), [key], order)
    values = to_long(last.select(key, *(typed(c, types[c]).alias(c) for c in custom if c in types)), {c: types[c] for c in custom if c in types}, key)
    kept = eav.join(values.select(key, "name"), [key, "name"], "left_anti")
    out = (new, kept.unionByName(values, allowMissingColumns=True))
    if links is not None:
        own = last.where("sequences IS NOT NULL").select(key, F.explode(F.split(F.trim("sequences"), r"\s+")).alias("sequence")).distinct()
        out = (*out, links.join(own.select(key), key, "left_anti").unionByName(own))
    return out


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys), keys, "left_anti")


def delete_samples(gone: DataFrame, samples: DataFrame, links: DataFrame, eav: DataFrame, sequences: DataFrame, alignments: DataFrame) -> dict[str, DataFrame]:
    """Snapshots after samples (sample) are deleted: their links and properties, and sequences that no sample holds any more, with alignments."""
    n = tasks(links, sequences, alignments)
    left = existing(links, gone, ["sample"], "left_anti")
    kept = existing(sequences, left, ["sequence"], "left_semi", n).unionByName(existing(sequences, links, ["sequence"], "left_anti", n))
    rest = {name: existing(df, gone, ["sample"], "left_anti") for name, df in (("samples", samples), ("eav", eav))}
    return {"samples": rest["samples"], "links": left, "eav": rest["eav"], "sequences": kept, "alignments": existing(alignments, kept, ["sequence"], "left_semi", n)}


def delete_sequences(gone: DataFrame, sequences: DataFrame, links: DataFrame, alignments: DataFrame) -> dict[str, DataFrame]:
    return {"sequences": without(sequences, gone, ["sequence"]), "links": without(links, gone, ["sequence"]), "alignments": without(alignments, gone, ["sequence"])}


def delete_reference(reference: str, references: DataFrame, replicons: DataFrame, **dependents: DataFrame) -> dict[str, DataFrame]:
    """Snapshots without a reference, its replicons and the rows of dependents on these replicons. Samples stay."""
    gone = replicons.where(F.col("reference") == reference).select("replicon")
    return {"references": references.where(F.col("reference") != reference), "replicons": replicons.where(F.col("reference") != reference), **{n: without(d, gone, ["replicon"]) for n, d in dependents.items()}}


def registered(registry: DataFrame, name: str, datatype: str, querytype: str, default: str | None = None) -> DataFrame:
    """The registry with a property, which is added where no property has its name."""
    row = registry.sparkSession.createDataFrame([(name, datatype, querytype, default)], "name string, datatype string, querytype string, default string")
    return registry.unionByName(row.join(registry.select("name"), "name", "left_anti"))


def unregistered(registry: DataFrame, eav: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    return registry.where(F.col("name") != name), eav.where(F.col("name") != name)


def violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique_names(sequences: DataFrame, names: DataFrame) -> DataFrame:
    """sequence and a unique name: the first of its samples' names, or its hash; clashes get a number behind."""
    first = names.groupBy("sequence").agg(F.min("name").alias("name"))
    wish = sequences.select("sequence", "seqhash").join(first, "sequence", "left").select("sequence", F.coalesce("name", "seqhash").alias("wish"))
    n = F.row_number().over(Window.partitionBy("wish").orderBy("sequence"))
    return wish.select("sequence", F.when(n == 1, F.col("wish")).otherwise(F.concat("wish", F.lit("_"), n.cast("string"))).alias("name"))
