from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from strainframe.operators import stats
from strainframe.streaming import weekly

SCHEMA = "sample long, lab string, day date"
MONDAY = date(2021, 1, 4)


def shares(df):
    return {(r["monday"], r["week"], r["group"]): (r["samples"], r["percent"]) for r in df.collect()}


@pytest.fixture
def stream(spark, tmp_path):
    at = f"file://{tmp_path}"

    def drop(rows, delay="30 days"):
        df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, SCHEMA)
        df.repartition(2).write.mode("append").parquet(f"{at}/in")
        q = weekly.stream_weekly(spark, f"{at}/in", f"{at}/out", SCHEMA, "lab", f"{at}/state", delay, 1)
        q.awaitTermination()
        return q

    drop.at = f"{at}/out"
    return drop


def test_three_drops_with_late_rows_equal_the_batch(spark, stream):
    """Rows of earlier days and repeated rows come with later drops; days and labs may be null."""
    rows = spark.range(900).selectExpr("id AS sample", "IF(id % 11 = 0, NULL, concat('lab', id % 4)) AS lab", "IF(id % 50 = 7, NULL, date_add(DATE'2021-01-01', cast(id div 10 AS int))) AS day").withColumn("part", F.expr("sample div 300"))
    late, again = F.col("sample") % 9 == 0, F.col("sample") % 7 == 0
    for k in range(3):
        due = (F.col("part") == k) & (~late | (F.lit(k) == 2))
        before = (F.col("part") == k - 1) & (late | again)
        q = stream(rows.where(due | before).select("sample", "lab", "day"), delay="80 days")
        assert weekly.too_late(q) == 0
    assert shares(weekly.weekly_shares(spark, stream.at)) == shares(stats.group_shares(rows, "lab"))
    # Started again without new files it counts nothing twice.
    empty = stream(rows.limit(0).select("sample", "lab", "day"), delay="80 days")
    assert weekly.too_late(empty) == 0 and shares(weekly.weekly_shares(spark, stream.at)) == shares(stats.group_shares(rows, "lab"))


def test_the_watermark_bounds_state_and_drops_what_is_later(spark, stream):
    stream([(i, "x", MONDAY + timedelta(days=i % 7)) for i in range(100)])
    first = stream([(1000, "x", MONDAY + timedelta(days=90))])
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in first.recentProgress]
    assert held[-1] < 5
    last = stream([(2000, "x", MONDAY), (2001, "x", MONDAY + timedelta(days=70))])
    assert weekly.too_late(last) == 1
    got = {r["monday"]: r["samples"] for r in weekly.weekly_shares(spark, stream.at).collect()}
    assert got == {MONDAY: 100, MONDAY + timedelta(days=84): 1, MONDAY + timedelta(days=70): 1}


def test_nothing_streamed(spark, tmp_path):
    assert weekly.weekly_shares(spark, f"file://{tmp_path}/none").count() == 0
