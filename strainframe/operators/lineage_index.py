"""Interval labels of lineages: each lineage has a number, `first`, and all below it have the numbers up to `last`.

"Descendant of" is then a range of numbers, which a scan of samples that carry their lineage's number takes as a pushed filter. Labels are
those of a depth-first walk, but nobody walks: sizes of subtrees and then sums of offsets along the way to the root are found by pointer
jumping, in rounds that double the distance, so a chain of 10,000 lineages takes 14 of them. A round is one table of a row for each lineage.

Lineages on a cycle or below one have no labels (null); `lineage.descendants` serves them. A lineage of several parents is an error.
Parents that are no lineage themselves count as none. A null reference counts as ''.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scale import BROADCAST_ROWS, cut, dimension, dropped, side

KEY = ["reference", "lineage"]
#: Siblings that one window orders, numbers of a block that one row expands to, rows of a file of samples.
SIBLINGS, BLOCK, ROWS_A_FILE = 100_000, 4096, 4_000_000


def _jumped(state: DataFrame, column: str, rows: int, upwards: bool) -> DataFrame:
    """state (reference, lineage, ptr, column and others) with ptr null, or on a cycle for ever: pointers double their reach each round.

    upwards: column adds up along the way to the root; else over all lineages below.
    """
    for _ in range(rows.bit_length() + 1):
        going = state.where("ptr IS NOT NULL")
        if going.isEmpty():
            break
        up = state.select("reference", F.col("lineage").alias("ptr"), F.col("ptr").alias("_next"), F.col(column).alias("_above"))
        # Lineages that are done have no key and take no part, so nulls are no hot key; nor is a root of many children: it is one row of `up`.
        moved = going.join(side(up, rows <= BROADCAST_ROWS), ["reference", "ptr"])
        moved = moved.unionByName(state.where("ptr IS NULL").withColumns({"_next": F.lit(None).cast("string"), "_above": F.lit(0).cast("long")}))
        others = [F.col(c) for c in state.columns if c not in ("ptr", column)]
        if upwards:
            new = moved.select(*others, F.col("_next").alias("ptr"), (F.col(column) + F.col("_above")).alias(column))
        else:
            below = going.groupBy("reference", F.col("ptr").alias("lineage")).agg(F.sum(column).alias("_below"))
            new = moved.join(below, KEY, "left").select(*others, F.col("_next").alias("ptr"), (F.col(column) + F.coalesce("_below", F.lit(0))).alias(column))
        before, state = state, cut(new)
        dropped(before)
    return state


def _offsets(tree: DataFrame, rows: int) -> DataFrame:
    """tree with `first`: how many numbers lie between a lineage's parent and itself. Siblings go by hashed bins and then by name, so no window takes all of a large family."""
    family = ["reference", "parent"]
    bins = F.pmod(F.xxhash64("lineage"), F.lit(rows // SIBLINGS + 1)).alias("_bin")
    own = tree.select("*", bins)
    earlier = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = own.groupBy(*family, "_bin").agg(F.sum("size").alias("size")).withColumn("_before", earlier(Window.partitionBy(*family).orderBy("_bin"))).drop("size")
    within = own.withColumn("_within", earlier(Window.partitionBy(*family, "_bin").orderBy("lineage"))).alias("w")
    sums = sums.alias("s")
    on = (F.col("w.reference") == F.col("s.reference")) & F.col("w.parent").eqNullSafe(F.col("s.parent")) & (F.col("w._bin") == F.col("s._bin"))
    return within.join(sums, on).select("w.reference", "w.lineage", "w.parent", "w.size", (F.col("_before") + F.col("_within") + F.when(F.col("w.parent").isNull(), 0).otherwise(1)).alias("first"))


def labelled(edges: DataFrame) -> DataFrame:
    """reference, lineage, parent, first and last of each lineage of edges (lineage, parent and, where there are several, reference)."""
    reference = F.coalesce("reference", F.lit("")) if "reference" in edges.columns else F.lit("")
    own = edges.where("lineage IS NOT NULL").select(reference.alias("reference"), "lineage", "parent")
    one = cut(own.groupBy(*KEY).agg(F.max("parent").alias("parent"), (F.max("parent") != F.min("parent")).alias("_several")))
    rows, several = one.agg(F.count("*"), F.count(F.when(F.col("_several"), 1))).first()
    if several:
        dropped(one)
        raise ValueError(f"{several} lineages have several parents")
    known = one.select("reference", F.col("lineage").alias("parent"), F.lit(True).alias("_known"))
    state = cut(one.join(side(known, rows <= BROADCAST_ROWS), ["reference", "parent"], "left").withColumn("parent", F.when(F.col("_known"), F.col("parent"))).select(*KEY, "parent", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("size")))
    dropped(one)
    sized = _jumped(state, "size", rows, upwards=False)
    offset = cut(_offsets(sized.where("ptr IS NULL"), rows).withColumn("ptr", F.col("parent")))
    numbered = _jumped(offset, "first", rows, upwards=True)
    none = F.lit(None).cast("long")
    out = numbered.select(*KEY, "parent", "first", (F.col("first") + F.col("size") - 1).alias("last"))
    out = cut(out.unionByName(sized.where("ptr IS NOT NULL").select(*KEY, "parent", none.alias("first"), none.alias("last"))))
    dropped(sized)
    dropped(numbered)
    return out


def write_labels(edges: DataFrame, path: str) -> None:
    """Replaces the labels of the references in edges, no others; they are made anew as a whole, as a lineage that comes in moves the numbers behind it."""
    made = labelled(edges)
    made.repartitionByRange("reference", "first").sortWithinPartitions("first").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("reference").parquet(path)
    dropped(made)


def located(samples: DataFrame, labels: DataFrame, reference: str) -> DataFrame:
    """samples (with lineage) and lineage_at, their lineage's number in a reference; null for lineages without one."""
    own = labels.where(F.col("reference") == reference).select("lineage", F.col("first").alias("lineage_at"))
    return samples.join(dimension(own), "lineage", "left")


def write_located(samples: DataFrame, path: str, entity: str = "sample", rows_a_file: int = ROWS_A_FILE) -> None:
    """located() samples as a table along lineage_at, so that a range of numbers lies in few files. A lineage of many samples is split by entity."""
    files = max(1, -(-samples.count() // rows_a_file))
    samples.repartitionByRange(files, "lineage_at", entity).sortWithinPartitions("lineage_at", entity).write.mode("overwrite").parquet(path)


def ranges(labels: DataFrame, names: list[str], reference: str) -> list[tuple[int, int]] | None:
    """The numbers of the named lineages and all below them, in any case of letters, as disjoint ranges in order. None where a name has no label; empty where none is known."""
    rows = labels.where((F.col("reference") == reference) & F.lower("lineage").isin(*(n.lower() for n in names))).select("first", "last").collect()
    if any(r["first"] is None for r in rows):
        return None
    out: list[tuple[int, int]] = []
    for first, last in sorted((r["first"], -r["last"]) for r in rows):
        # Ranges lie within one another or apart.
        if not out or first > out[-1][1]:
            out.append((first, -last))
    return out


def descendants_by_labels(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """reference, root and lineage: all that lie below each root (lineage), itself included, by one join on their numbers. Rows are as many as the result's. Roots without labels give none."""
    own = labels.join(roots.select("lineage").distinct(), "lineage", "left_semi").where("first IS NOT NULL").select("reference", F.col("lineage").alias("root"), "first", "last")
    blocks = own.withColumn("_block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK))))
    at = F.sequence(F.greatest("first", F.col("_block") * BLOCK), F.least("last", F.col("_block") * BLOCK + (BLOCK - 1)))
    numbers = blocks.select("reference", "root", F.explode(at).alias("_at"))
    named = labels.where("first IS NOT NULL").select("reference", "lineage", F.col("first").alias("_at"))
    return numbers.join(dimension(named), ["reference", "_at"]).select("reference", "root", "lineage")


def rolled_up(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """reference, lineage, own and whole: what counts (reference, lineage, n) has for a lineage, and for it and all below, as a difference of running sums.

    No pair of a lineage and one below is made. Repeated rows of counts add up; lineages without labels are left out.
    """
    n = counts.groupBy(*KEY).agg(F.sum("n").alias("own"))
    own = labels.where("first IS NOT NULL").join(n, KEY, "left").select(*KEY, "first", "last", F.coalesce("own", F.lit(0)).alias("own"), F.floor(F.col("first") / BLOCK).alias("_block"))
    running = lambda w, end: F.coalesce(F.sum("own").over(w.rowsBetween(Window.unboundedPreceding, end)), F.lit(0))
    before = own.groupBy("reference", "_block").agg(F.sum("own").alias("own")).withColumn("_before", running(Window.partitionBy("reference").orderBy("_block"), -1)).drop("own")
    within = own.withColumn("_within", running(Window.partitionBy("reference", "_block").orderBy("first"), 0))
    sums = within.join(before, ["reference", "_block"]).select(*KEY, "first", "last", "own", (F.col("_before") + F.col("_within")).alias("_sum"))
    to = sums.select("reference", F.col("first").alias("last"), F.col("_sum").alias("_to"))
    return sums.join(to, ["reference", "last"]).select(*KEY, "own", (F.col("_to") - F.col("_sum") + F.col("own")).alias("whole"))
