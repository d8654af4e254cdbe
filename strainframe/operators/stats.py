"""Surveillance statistics: totals, coverage, weekly series, shares, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import natural_key, week_label, week_start
from .scale import cut, few


def present(column: str, kind: str) -> Column:
    """Whether a field holds data: not null, and not empty where it is a text."""
    c = F.col(column)
    return c.isNotNull() & (F.trim(c) != "") if kind == "string" else c.isNotNull()


def totals(samples: DataFrame, entity: str = "sample", day: str = "day") -> DataFrame:
    return samples.agg(F.count_distinct(entity).alias("samples"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def _long(one: DataFrame, name: str, value: str) -> DataFrame:
    """The columns of a table of one row as rows of name and value."""
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in one.columns))).alias("x")).select("x.*")


def coverage(samples: DataFrame, fields: list[str], eav: DataFrame | None = None, facts: dict[str, DataFrame] | None = None, entity: str = "sample") -> DataFrame:
    """property and n: samples that hold data for each field, each property of eav (entity, name, value), and each fact."""
    kinds = dict(samples.dtypes)
    out = [_long(samples.agg(*(F.count_if(present(f, kinds[f])).alias(f) for f in fields)), "property", "n")]
    if eav is not None:
        out.append(eav.join(samples.select(entity), entity, "left_semi").where(F.col("value").isNotNull() & (F.col("value").cast("string") != "")).groupBy(F.col("name").alias("property")).agg(F.count_distinct(entity).alias("n")))
    for name, fact in (facts or {}).items():
        out.append(samples.join(fact.select(entity), entity, "left_semi").agg(F.lit(name).alias("property"), F.count_distinct(entity).alias("n")).select("property", "n"))
    return reduce(DataFrame.unionByName, out)


def populated(covered: DataFrame) -> DataFrame:
    return covered.where("n > 0").select("property")


def shares(covered: DataFrame, total: DataFrame) -> DataFrame:
    """property, n and percent of a total (a table of one row and column)."""
    return covered.crossJoin(F.broadcast(total.toDF("_total"))).select("property", "n", F.when(F.col("_total") == 0, 0.0).otherwise(F.round(100.0 * F.col("n") / F.col("_total"), 2)).alias("percent"))


def per_week(samples: DataFrame, entity: str = "sample", day: str = "day") -> DataFrame:
    """monday, week (YYYY-Www) and samples; samples without a date are left out."""
    return samples.where(F.col(day).isNotNull()).groupBy(week_start(day).alias("monday")).agg(F.count_distinct(entity).alias("samples")).select("monday", week_label("monday").alias("week"), "samples")


def week_axis(weeks: DataFrame) -> DataFrame:
    """All Mondays from the first to the last."""
    return weeks.agg(F.min("monday").alias("a"), F.max("monday").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("monday"))


def filled_weeks(weeks: DataFrame) -> DataFrame:
    """per_week() with zeros between the first and the last week."""
    return week_axis(weeks).join(weeks.select("monday", "samples"), "monday", "left").select("monday", week_label("monday").alias("week"), F.coalesce("samples", F.lit(0)).alias("samples"))


def group_shares(samples: DataFrame, group: str, entity: str = "sample", day: str = "day") -> DataFrame:
    """monday, week, group, samples and percent of the week."""
    counts = samples.where(F.col(day).isNotNull()).groupBy(week_start(day).alias("monday"), F.col(group).alias("group")).agg(F.count_distinct(entity).alias("samples"))
    return counts.select("monday", week_label("monday").alias("week"), "group", "samples", F.round(100.0 * F.col("samples") / F.sum("samples").over(Window.partitionBy("monday")), 2).alias("percent"))


def filled_groups(shared: DataFrame) -> DataFrame:
    """group_shares() with zeros for every week and group: each group gets the weeks from the first to the last, so rows are those of the result, and no group meets another. A null group is one too."""
    bounds = shared.agg(F.min("monday").alias("a"), F.max("monday").alias("b")).where("a IS NOT NULL")
    every = shared.select("group").distinct().crossJoin(F.broadcast(bounds)).select("group", F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("monday")).alias("e")
    own = shared.select("monday", "group", "samples", "percent").alias("s")
    joined = every.join(own, (F.col("e.monday") == F.col("s.monday")) & F.col("e.group").eqNullSafe(F.col("s.group")), "left")
    return joined.select("e.monday", week_label(F.col("e.monday")).alias("week"), "e.group", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("percent", F.lit(0.0)).alias("percent"))


def normalised(shared: DataFrame, value: str = "percent") -> DataFrame:
    """Values of each week as shares that sum to 100."""
    total = F.sum(value).over(Window.partitionBy("monday"))
    return shared.withColumn("normalised", F.when(total == 0, 0.0).otherwise(F.round(100.0 * F.col(value) / total, 4)))


def last_weeks(weeks: DataFrame, n: int = 26) -> DataFrame:
    """Rows of the last n weeks that occur. Weeks are few: the distinct ones are ranked, not the rows."""
    ranked = weeks.select("monday").distinct().orderBy(F.desc("monday")).limit(n)
    return weeks.join(F.broadcast(ranked), "monday", "left_semi")


def distribution(samples: DataFrame, column: str, entity: str = "sample", missing: str | None = None) -> DataFrame:
    """value and samples; with `missing`, samples without a value count under that name."""
    value = F.col(column).cast("string")
    own = samples.withColumn("value", F.coalesce(F.nullif(value, F.lit("")), F.lit(missing)) if missing else value)
    return (own if missing else own.where("value IS NOT NULL")).groupBy("value").agg(F.count_distinct(entity).alias("samples"))


def property_view(samples: DataFrame, eav: DataFrame | None, name: str, entity: str = "sample") -> DataFrame:
    """entity and value of a fixed or a custom property."""
    if name in samples.columns:
        return samples.select(entity, F.col(name).cast("string").alias("value")).where("value IS NOT NULL")
    return eav.where(F.col("name") == name).join(samples.select(entity), entity, "left_semi").select(entity, F.col("value").cast("string").alias("value")).where("value IS NOT NULL")


def cross_table(x: DataFrame, y: DataFrame, entity: str = "sample") -> DataFrame:
    """x, y and samples of two property views."""
    both = x.withColumnRenamed("value", "x").join(y.withColumnRenamed("value", "y"), entity)
    return both.groupBy("x", "y").agg(F.count_distinct(entity).alias("samples"))


def nested(crossed: DataFrame) -> DataFrame:
    """x and its counts by y, sorted by y."""
    return crossed.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("y", "samples"))).alias("counts"))


def catalogue(samples: DataFrame, fields: list[str], eav: DataFrame | None = None, entity: str = "sample") -> DataFrame:
    """property and distinct: how many values that are not empty."""
    fixed = _long(samples.agg(*(F.count_distinct(F.nullif(F.col(f).cast("string"), F.lit(""))).alias(f) for f in fields)), "property", "distinct")
    if eav is None:
        return fixed
    own = eav.join(samples.select(entity), entity, "left_semi").groupBy(F.col("name").alias("property")).agg(F.count_distinct(F.nullif(F.col("value").cast("string"), F.lit(""))).alias("distinct"))
    return fixed.unionByName(own)


def usable(listed: DataFrame, most: int = 10) -> DataFrame:
    """Properties with values; whether a drop-down can hold them."""
    return listed.where("distinct > 0").withColumn("dropdown", F.col("distinct") <= most)


def histogram(samples: DataFrame, column: str, width: float, empty: bool = True) -> DataFrame:
    """bin, label lo-hi and n, from the minimum in steps of width; the maximum is in the last bin."""
    own = samples.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    least = own.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    counts = own.crossJoin(F.broadcast(least)).groupBy(F.floor((F.col("v") - F.col("lo")) / F.lit(float(width))).alias("bin")).agg(F.count("*").alias("n"))
    bins = least.where("lo IS NOT NULL").select("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / F.lit(float(width))))).alias("bin"))
    lo = F.col("lo") + F.col("bin") * F.lit(float(width))
    return bins.join(counts, "bin", "left" if empty else "inner").select("bin", F.format_string("%.2f-%.2f", lo, lo + F.lit(float(width))).alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def data_set_options(samples: DataFrame, organism: str = "organism", accession: str = "accession", data_set: str = "data_set") -> DataFrame:
    """organism with its sorted accessions and data sets; the empty one is -Empty-."""
    name = F.coalesce(F.nullif(F.col(data_set), F.lit("")), F.lit("-Empty-"))
    return samples.groupBy(F.col(organism).alias("organism")).agg(F.sort_array(F.collect_set(accession)).alias("accessions"), F.sort_array(F.collect_set(name)).alias("data_sets"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL AND value <> ''").distinct()


def naturally(df: DataFrame, column: str, first: str | None = "Unknown") -> DataFrame:
    """df with its rank in number-aware order by distinct value; `first` leads. Many values are ranked by ranges."""
    names = df.select(column).distinct().withColumn("_key", natural_key(column, first))
    if few(names):
        ranked = names.withColumn("natural_rank", F.dense_rank().over(Window.orderBy("_key", column)))
    else:
        dealt = cut(names.repartitionByRange("_key", column).withColumn("_part", F.spark_partition_id()))
        before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        ranked = dealt.join(F.broadcast(before), "_part").withColumn("natural_rank", (F.row_number().over(Window.partitionBy("_part").orderBy("_key", column)) + F.col("_before")).cast("int")).drop("_part", "_before")
    return df.join(ranked.drop("_key"), column)


def job_status(files: DataFrame, logs: DataFrame) -> DataFrame:
    """job and status: in progress while files have no log row, failed with any failure, else completed. files: job, file; logs: file, success."""
    per_file = logs.groupBy("file").agg(F.bool_and("success").alias("success"))
    joined = files.join(per_file, "file", "left").groupBy("job").agg(F.count("*").alias("files"), F.count_if(F.col("success").isNull()).alias("open"), F.count_if(~F.col("success")).alias("failed"))
    return joined.select("job", "files", F.when(F.col("open") > 0, "in progress").when(F.col("failed") > 0, "failed").otherwise("completed").alias("status"))
