import pytest
from pyspark.sql import functions as F

from strainframe.functions.scalars import week_start
from strainframe.operators import bitmap_cube as bc
from strainframe.operators import stats


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def samples(spark):
    """100,000 samples over four buckets, most of one lab, some of them twice, with nulls and empty texts."""
    s = spark.range(100_000).selectExpr("id AS sample", "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 50 = 1 THEN '' WHEN id % 3 > 0 THEN 'big' ELSE concat('lab', id % 5) END AS lab", "concat('h', id % 4) AS host", "IF(id % 40 = 3, NULL, date_add(DATE'2021-01-01', cast(id % 300 AS int))) AS day")
    return s.unionByName(s.where("sample % 10 = 0")).withColumn("monday", week_start("day")).cache()


SETS = [(), ("monday",), ("lab",), ("host",), ("lab", "host", "monday")]


def test_statistics_equal_those_of_the_rows(samples):
    c = bc.build(samples, [(samples, SETS)])
    assert rows(bc.totals(c)) == rows(stats.totals(samples))
    assert rows(bc.per_week(c)) == rows(stats.per_week(samples))
    for missing in (None, "Not Reported"):
        assert rows(bc.distribution(c, "lab", missing)) == rows(stats.distribution(samples, "lab", missing=missing))
    view = lambda n: stats.property_view(samples.distinct(), None, n)
    assert rows(bc.cross_table(c, "lab", "host")) == rows(stats.cross_table(view("lab"), view("host")))
    once = samples.distinct()
    assert rows(bc.coverage(c, ["lab", "host", "monday"])) == rows(stats.coverage(once, ["lab", "host", "monday"]))
    assert rows(bc.catalogue(c, ["lab", "host"])) == rows(stats.catalogue(samples, ["lab", "host"]))
    month = bc.counts(c, "host", "monday", labels={"monday": lambda m: F.substring(m, 1, 7)}).select("host", "monday", "samples")
    assert rows(month) == rows(samples.groupBy("host", F.substring(F.col("monday").cast("string"), 1, 7)).agg(F.count_distinct("sample")))


def test_the_report_counts_samples_of_two_places_once(spark):
    s = spark.sql("SELECT * FROM VALUES (1L, DATE'2021-01-01'), (2L, DATE'2021-02-01'), (3L, NULL), (4L, NULL) AS t(sample, day)")
    p = spark.sql("SELECT * FROM VALUES (1L, 'A', 'a2'), (1L, 'A', 'a1'), (2L, 'A', 'a1'), (2L, 'B', 'b1'), (3L, 'C', NULL), (9L, 'D', 'd1') AS t(sample, reference, replicon)")
    c = bc.build(s, [(s.join(p, "sample", "left"), [(), ("reference", "replicon")])])
    got = {r["organism"]: (r["samples"], str(r["first_day"]), str(r["last_day"]), r["replicons"], r["share"]) for r in bc.report(c).collect()}
    assert got == {"A": (2, "2021-01-01", "2021-02-01", "a1,a2", "2 (50.00%)"), "B": (1, "2021-02-01", "2021-02-01", "b1", "1 (25.00%)"), "C": (1, "None", "None", "", "1 (25.00%)")}


def test_batches_merge_and_repeated_samples_count_once(samples):
    sets = SETS[:3] + SETS[4:]
    part = lambda k: samples.where((F.col("sample") % 3 == k) | (F.col("sample") % 11 == 0))
    c = bc.build(part(0), [(part(0), sets)])
    for k in (1, 2, 2):
        c = bc.added(c, part(k), [(part(k), sets)])
    whole = bc.build(samples, [(samples, sets)])
    for names in sets:
        assert rows(bc.counts(c, *names)) == rows(bc.counts(whole, *names))
    # Cells are as many as without batches, and ordinals have no gaps.
    assert c.cells.groupBy("name", "key", "bucket").count().where("count > 1").isEmpty()
    assert c.ordinals.agg(F.max("ordinal"), F.count("*"), F.count_distinct("sample")).first() == (100_000,) * 3


def test_empty_tables_null_keys_and_unknown_names(spark, samples):
    none = samples.limit(0)
    c = bc.build(none, [(none, SETS)])
    assert rows(bc.totals(c)) == [(0, None, None)] and rows(bc.per_week(c)) == [] and rows(bc.coverage(c, ["lab"])) == [("lab", 0)]
    one = spark.sql("SELECT CAST(NULL AS LONG) AS sample, 'x' AS lab, 1 AS ordinal, 2 AS bucket UNION ALL SELECT 5L, 'x', 3, 4")
    d = bc.build(one, [(one, [("lab",), ("ordinal", "bucket")])])
    assert rows(bc.distribution(d, "lab")) == [("x", 1)] and rows(bc.cross_table(d, "ordinal", "bucket")) == [("3", "4", 1)]
    d = bc.added(d, none.select("sample", "lab"), [(none.select("sample", "lab"), [("lab",)])])
    assert rows(bc.distribution(d, "lab")) == [("x", 1)]
    for wrong in (lambda: bc.counts(d, "host"), lambda: bc.added(d, one, [(one, [("bucket",)])]), lambda: bc.build(one, [(one, [("lab",), ("lab",)])]), lambda: bc.coverage(d, ["bucket"])):
        with pytest.raises(ValueError):
            wrong()
