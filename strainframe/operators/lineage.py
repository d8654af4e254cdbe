"""Lineage tables: edges (lineage, parent, reference) from several shapes, and walks over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scale import cut, dimension

LONGEST_NAME = 50
ROOT_WORDS = ("", "none", "null", "na")


def edges_from_children(rows: DataFrame, order: str = "seq") -> DataFrame:
    """lineage and parent from (lineage, comma list of children or `none`): every name is a node, the first parent wins, too long names go."""
    child = F.explode(F.split("children", r"\s*,\s*"))
    pairs = rows.select("lineage", order, child.alias("child")).where(~F.lower("child").isin(*ROOT_WORDS))
    first = pairs.groupBy(F.col("child").alias("lineage")).agg(F.min_by("lineage", order).alias("parent"))
    names = rows.select("lineage").union(pairs.select("child")).distinct().where(F.length("lineage") <= LONGEST_NAME)
    return names.join(first, "lineage", "left").withColumn("parent", F.when(F.length("parent") <= LONGEST_NAME, F.col("parent")))


def edges_from_pairs(pairs: DataFrame, order: str = "seq") -> DataFrame:
    """lineage and parent from (lineage, parent) rows: null words are roots, parents that are only referred to become roots."""
    own = pairs.select(F.trim("lineage").alias("lineage"), F.when(~F.lower(F.trim(F.coalesce("parent", F.lit("")))).isin(*ROOT_WORDS), F.trim("parent")).alias("parent"), order)
    first = own.where("parent IS NOT NULL").groupBy("lineage").agg(F.min_by("parent", order).alias("parent"))
    names = own.select("lineage").union(own.select("parent").where("parent IS NOT NULL")).distinct()
    return names.join(first, "lineage", "left")


def pairs_from_clades(rows: DataFrame, order: str = "seq") -> DataFrame:
    """(lineage, parent) from clade designations (clade, gene, site, alt): rows of gene `clade` name the parent in site."""
    parents = rows.where("gene = 'clade'").groupBy("clade").agg(F.min_by("site", order).alias("parent"))
    return rows.groupBy("clade").agg(F.min(order).alias(order)).join(parents, "clade", "left").select(F.col("clade").alias("lineage"), "parent", order)


def descendants(edges: DataFrame, roots: DataFrame, steps: int = 4) -> DataFrame:
    """root and lineage: all descendants of each root, itself included. Rounds of `steps` joins, each round one table; a lineage counts once for a root, so cycles end."""
    children = edges.where("parent IS NOT NULL").select(F.col("parent").alias("at"), F.col("lineage").alias("child")).distinct()
    children = dimension(cut(children))
    new = cut(roots.select(F.col("lineage").alias("root"), "lineage").distinct())
    seen = new
    while not new.isEmpty():
        reach, every = new, None
        for _ in range(steps):
            reach = reach.join(children, F.col("lineage") == F.col("at")).select("root", F.col("child").alias("lineage"))
            every = reach if every is None else every.unionByName(reach)
        new = cut(every.distinct().join(seen, ["root", "lineage"], "left_anti"))
        seen = seen.unionByName(new)
    return seen


def child_table(edges: DataFrame) -> DataFrame:
    """lineage and sublineage: a row for each direct child, and `none` for roots without children."""
    pairs = edges.where("parent IS NOT NULL").select(F.col("parent").alias("lineage"), F.col("lineage").alias("sublineage"))
    alone = edges.where("parent IS NULL").select("lineage").join(pairs.select("lineage").distinct(), "lineage", "left_anti")
    return pairs.unionByName(alone.select("lineage", F.lit("none").alias("sublineage")))


def alias_parents(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """lineage and parent: the alias is expanded, the last segment dropped, and the longest prefix that has an alias compressed again.

    aliases: alias, prefix. Compression goes by the prefixes of whole dot segments.
    """
    aliases = dimension(aliases)
    head = F.substring_index("lineage", ".", 1)
    tail = F.when(F.contains(F.col("lineage"), F.lit(".")), F.expr("substring(lineage, length(substring_index(lineage, '.', 1)) + 1)")).otherwise("")
    full = names.select("lineage", head.alias("alias"), tail.alias("tail")).join(aliases, "alias", "left").select("lineage", F.concat(F.coalesce(F.nullif("prefix", F.lit("")), "alias"), "tail").alias("full"))
    up = full.withColumn("up", F.when(F.contains("full", F.lit(".")), F.expr("regexp_replace(full, '[.][^.]*$', '')")))
    cuts = up.withColumn("cuts", F.expr("transform(sequence(1, size(split(up, '[.]'))), i -> substring_index(up, '.', i))")).select("lineage", "up", F.explode_outer("cuts").alias("prefix"))
    best = cuts.join(dimension(aliases.where("prefix <> ''")), "prefix", "left").groupBy("lineage", "up").agg(F.max(F.when(F.col("alias").isNotNull(), F.struct(F.length("prefix").alias("n"), "alias"))).alias("best"))
    return best.select("lineage", F.when(F.col("best").isNull(), F.col("up")).otherwise(F.concat("best.alias", F.expr("substring(up, best.n + 1)"))).alias("parent"))


def replaced(edges: DataFrame, new: DataFrame, reference: str) -> DataFrame:
    """edges with those of one reference replaced; others stay."""
    return edges.where(F.col("reference") != reference).unionByName(new.withColumn("reference", F.lit(reference)).select(*edges.columns))


def write_edges(edges: DataFrame, path: str) -> None:
    """Overwrites the partitions of the references in edges, no others."""
    edges.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("reference").parquet(path)


def grouped(names: DataFrame, known: DataFrame, column: str = "lineage") -> DataFrame:
    """names with lineage_group: the first two segments where they are a known lineage, else Unknown."""
    label = F.substring_index(F.col(column), ".", 2)
    return names.withColumn("_group", label).join(known.select(F.col("lineage").alias("_known")).distinct(), F.col("_group") == F.col("_known"), "left").withColumn("lineage_group", F.coalesce("_known", F.lit("Unknown"))).drop("_group", "_known")


def orphans(edges: DataFrame) -> DataFrame:
    """Parents that are no lineage themselves."""
    return edges.where("parent IS NOT NULL").select(F.col("parent").alias("lineage")).distinct().join(edges.select("lineage"), "lineage", "left_anti")


def first_parent(pairs: DataFrame, order: str = "seq") -> DataFrame:
    """The first row of each lineage."""
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy("lineage").orderBy(order, "parent"))).where("_r = 1").drop("_r")
