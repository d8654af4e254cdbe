"""Filter trees by a bitmap index: a tree is AND, OR and NOT of bitmaps, whatever the number of its leaves.

Samples have dense ordinals. The index has, for each mutation and bucket of 32,768 ordinals, a bitmap of the samples that carry it, as those of its
512 words of 64 bits that are not 0: a mutation of all samples is one row of 512 words a bucket, one of a single sample a row of one word. A leaf on
mutations is the OR of the rows that it selects, a leaf on anything else a bitmap made from the samples that meet it; the tree is worked out
bucket by bucket. What is new goes in by OR. A sample that changes gets a new ordinal, and its old one is nobody's, so its old bits count for nothing.

Results are those of filters.matching. Samples without a key are in no index and no result; repeated facts count once; rows of
one key are one sample, which has a property where any of them has it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import filters
from .filters import Tables
from .scale import cut, dimension, tasks

#: What tells mutations apart, of those columns that a fact has; ordinals of a bucket. The latter is Spark's.
KEYS = {"nt": ("replicon", "start", "end", "ref", "alt"), "aa": ("replicon", "gene", "start", "end", "ref", "alt")}
BUCKET = 32_768
#: Bits of a word of a bitmap.
WORD = 64


@dataclass
class BitmapIndex:
    """ordinals: entity, ordinal. facts: by name the rows of mutation, bucket and words (word, bits), those of the bitmap that are not 0."""

    ordinals: DataFrame
    facts: dict[str, DataFrame]
    entity: str = "sample"


def numbered(entities: DataFrame, entity: str, after: int = 0) -> DataFrame:
    """Each entity once with an ordinal behind `after`: the rows of each task follow those of the task before."""
    own = entities.select(entity).where(F.col(entity).isNotNull()).distinct()
    own = cut(own.select(entity, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    # One row a task.
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return cut(own.join(F.broadcast(before), "_part").select(entity, (F.col("_before") + F.col("_at") + after + 1).alias("ordinal")))


def _bits(position: Column) -> Column:
    return F.bitmap_construct_agg(F.bitmap_bit_position(position))


def _gathered(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, bucket and words from rows of keys, bucket, word and bits, by OR, in n tasks. A group has the rows of one mutation and bucket at most."""
    words = rows.repartition(n, *keys, "bucket").groupBy(*keys, "bucket", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy(*keys, "bucket").agg(F.collect_list(F.struct("word", "bits")).alias("words"))


def constructed(fact: DataFrame, ordinals: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """The keys, bucket and words of a fact's rows; rows of entities without an ordinal are left out."""
    at = F.bitmap_bit_position("ordinal")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % WORD).cast("int"))
    rows = fact.select(entity, *keys).join(dimension(ordinals), entity)
    return _gathered(rows.select(*keys, F.bitmap_bucket_number("ordinal").alias("bucket"), F.floor(at / WORD).cast("short").alias("word"), bit.alias("bits")), keys, tasks(fact))


def _keys(fact: DataFrame, name: str) -> list[str]:
    return [c for c in KEYS[name] if c in fact.columns]


def build(t: Tables) -> BitmapIndex:
    """The index of a star of tables, as tables in the shared folder."""
    ordinals = numbered(t.samples, t.entity)
    facts = {n: cut(constructed(f, ordinals, _keys(f, n), t.entity)) for n in KEYS if (f := getattr(t, n)) is not None}
    return BitmapIndex(ordinals, facts, t.entity)


def updated(index: BitmapIndex, t: Tables) -> BitmapIndex:
    """The index with the samples of t, which are new or replace those of their key, and their facts. Only t's facts are read."""
    last = index.ordinals.agg(F.coalesce(F.max("ordinal"), F.lit(0))).first()[0]
    new = numbered(t.samples, index.entity, last)
    ordinals = cut(index.ordinals.join(new.select(index.entity), index.entity, "left_anti").unionByName(new))
    facts = dict(index.facts)
    for n in KEYS:
        if (fact := getattr(t, n)) is not None:
            keys = _keys(fact, n)
            more = cut(constructed(fact, new, keys, index.entity))
            if n in facts:
                rows = facts[n].unionByName(more).select(*keys, "bucket", F.inline("words"))
                more = cut(_gathered(rows, keys, tasks(rows)))
            facts[n] = more
    return BitmapIndex(ordinals, facts, index.entity)


def _evaluated(tree: dict, leaves: list[dict], excluded: list[bool]) -> Callable:
    """A function of the leaves' bitmaps, by the rules of trees: a node's own leaf and its andFilter together, or any of its orFilter."""
    number = {id(f): i for i, f in enumerate(leaves)}

    def program(node: dict):
        i = number.get(id(node))
        every = ([("leaf", i, excluded[i])] if i is not None else []) + [p for sub in node.get("andFilter") or [] if (p := program(sub))]
        some = [p for sub in node.get("orFilter") or [] if (p := program(sub))]
        return ("tree", every, some) if every or some else None

    steps = program(tree)

    def run(bits: list[np.ndarray], step=steps) -> np.ndarray | None:
        if step is None:
            return None
        if step[0] == "leaf":
            return ~bits[step[1]] if step[2] else bits[step[1]]
        out = None
        for s in step[1]:
            out = run(bits, s) if out is None else out & run(bits, s)
        for s in step[2]:
            out = run(bits, s) if out is None else out | run(bits, s)
        return out

    return run


def _bytes(bits: bytes | list[dict] | None) -> np.ndarray:
    """A bitmap's bytes, from these or from its words that are not 0."""
    if isinstance(bits, bytes):
        return np.frombuffer(bits, np.uint8)
    out = np.zeros(BUCKET // WORD, "<i8")
    for w in bits or []:
        out[w["word"]] = w["bits"]
    return out.view(np.uint8)


def matching(t: Tables, index: BitmapIndex, tree: dict, reference: str | None = None) -> DataFrame:
    """The samples that a tree keeps, as filters.matching. Facts that the index has are not read."""
    samples = t.samples
    if reference is not None and t.placed is not None:
        samples = samples.join(t.placed.where(F.col("reference") == reference).select(t.entity), t.entity, "left_semi")
    scoped = Tables(**{**t.__dict__, "samples": samples})
    tree = filters.expanded(scoped, tree)
    leaves = filters._leaves(tree)
    made = [filters.leaf(scoped, f, reference) for f in leaves]
    bucket = F.bitmap_bucket_number("ordinal").alias("bucket")
    own = [_bits(F.when(x.column, F.col("ordinal"))).alias(f"_leaf{i}") for i, x in enumerate(made) if x.column is not None]
    out = samples.join(index.ordinals, t.entity).groupBy(bucket).agg(_bits(F.col("ordinal")).alias("_all"), *own)
    for name in {x.fact for x in made if x.fact in index.facts}:
        hits = {i: F.coalesce(x.rows, F.lit(False)) for i, x in enumerate(made) if x.fact == name}
        some = F.lit(False)
        for h in hits.values():
            some = some | h
        rows = index.facts[name].where(some).select("bucket", *(h.alias(f"_leaf{i}") for i, h in hits.items()), F.inline("words"))
        words = rows.groupBy("bucket", "word").agg(*(F.coalesce(F.bit_or(F.when(F.col(f"_leaf{i}"), F.col("bits"))), F.lit(0)).alias(f"_leaf{i}") for i in hits))
        out = out.join(words.groupBy("bucket").agg(*(F.collect_list(F.struct("word", F.col(f"_leaf{i}").alias("bits"))).alias(f"_leaf{i}") for i in hits)), "bucket", "left")
    for i, x in enumerate(made):
        if x.column is None and x.fact not in index.facts:
            met = x.members if x.fact is None else getattr(t, x.fact).where(x.rows)
            out = out.join(met.select(t.entity).distinct().join(index.ordinals, t.entity).groupBy(bucket).agg(_bits(F.col("ordinal")).alias(f"_leaf{i}")), "bucket", "left")
    run, names = _evaluated(tree, leaves, [x.exclude for x in made]), [f"_leaf{i}" for i in range(len(made))]

    def found(batches):
        for batch in batches:
            for number, every, *leaf_bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                every = np.frombuffer(every, np.uint8)
                kept = run([_bytes(b) for b in leaf_bits])
                kept = every if kept is None else kept & every
                ordinals = np.flatnonzero(np.unpackbits(kept, bitorder="little")) + (number - 1) * BUCKET + 1
                yield pa.RecordBatch.from_arrays([pa.array(ordinals, pa.int64())], names=["ordinal"])

    ordinals = out.select("bucket", "_all", *names).mapInArrow(found, "ordinal long")
    return t.samples.join(index.ordinals.join(ordinals, "ordinal", "left_semi").select(t.entity), t.entity, "left_semi")
