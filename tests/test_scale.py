from datetime import date

from pyspark.sql import functions as F

from strainframe.operators import scale, stats


def test_a_dimension_is_small_by_rows_and_bytes(spark, monkeypatch):
    """Few rows of long sequences are no broadcast; texts, binaries and nested values count by what they hold, clashing and dotted names too."""
    df = spark.range(3).select("id", F.repeat(F.lit("A"), 30_000).alias("a.b"), F.array(F.lit("x")).alias("_bytes"), F.lit(None).cast("binary").alias("none"))
    assert scale.few(df) and scale.few(df, 3) and not scale.few(df, 2) and not scale.few(df, size=80_000) and scale.few(df, size=100_000)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 50_000)
    plan = lambda: spark.range(9).join(scale.dimension(df), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan()
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 200_000)
    assert "strategy=broadcast" in plan()
    assert scale.few(df.limit(0), 0)


def test_filled_groups_of_nulls_and_of_many(spark):
    """A null group has its own zeros and counts; hundreds of groups are one explode of the weeks each."""
    rows = [(i, f"g{i}" if i else None, date(2021, 1, 4 + 7 * (i % 3))) for i in range(400)]
    filled = stats.filled_groups(stats.group_shares(spark.createDataFrame(rows, "sample long, lab string, day date"), "lab"))
    got = {(r["monday"], r["group"]): r["samples"] for r in filled.collect()}
    assert len(got) == 1200 and {k: n for k, n in got.items() if n} == {(d, g): 1 for _, g, d in rows}
    assert "CartesianProduct" not in filled._jdf.queryExecution().executedPlan().toString()
