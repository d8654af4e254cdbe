from pyspark.sql import functions as F

from strainframe.operators import match, paging


def test_pages_by_offset_and_by_key(spark, tmp_path):
    """All orders, with nulls and a value that a third of all rows have: pages are those of the sorted table, in 17 ranges."""
    df = spark.range(1000).selectExpr("id AS sample", "CASE WHEN id % 3 = 0 THEN 500 WHEN id % 7 > 0 THEN id * 37 % 211 END AS price", "concat('t', id) AS note")
    for by in ("price", "-price"):
        at = str(tmp_path / by)
        paging.write_pages(df, at, by, "sample", rows_a_range=60)
        pages, rows = paging.open_pages(spark, at), [tuple(r) for r in match.ordered(df, by, "sample").collect()]
        assert pages.total == 1000 and len(pages.ranges) == 17
        for offset, limit in ((0, 10), (55, 10), (137, 200), (995, 20), (1000, 5), (5000, 1), (0, 1000), (300, 0)):
            got = [tuple(r) for r in pages.page(limit, offset, with_total=True).select("sample", "price", "note", "total").collect()]
            assert got == [(*r, 1000) for r in rows[offset : offset + limit]], (by, offset, limit)
        for k in (0, 59, 60, 400, 700, 998, 999):
            got = [tuple(r) for r in pages.after(rows[k][1], rows[k][0], 75).select("sample", "price", "note").collect()]
            assert got == rows[k + 1 : k + 76], (by, k)
        # A key that no row has: between two samples of one value.
        assert [r["sample"] for r in pages.after(500, -1, 3).collect()] == [r[0] for r in rows if r[1] == 500][:3]


def test_a_far_page_opens_the_ranges_it_lies_in(spark, tmp_path):
    """Of 50 ranges a page behind 9,990,000 rows of 10,000,000 opens one, or two where it lies across an end."""
    df = spark.range(10_000_000).selectExpr("id AS sample", "id div 10 AS price")
    paging.write_pages(df, str(tmp_path / "p"), "price", "sample", rows_a_range=200_000)
    pages = paging.open_pages(spark, str(tmp_path / "p"))
    far = pages.page(100, 9_990_000)
    assert [r["sample"] for r in far.collect()] == list(range(9_990_000, 9_990_100))
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert plan.count(paging.RANGE) and "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [(" in plan or "PartitionFilters: [" + paging.RANGE in plan
    first = next(i for i, s in enumerate(pages.sums) if s > 9_990_000)
    opened = pages._rows(first, first)
    assert opened.select(F.input_file_name()).distinct().count() == 1 and opened.count() < 500_000


def test_an_empty_table(spark, tmp_path):
    paging.write_pages(spark.createDataFrame([], "sample long, price long"), str(tmp_path / "e"), "price", "sample")
    pages = paging.open_pages(spark, str(tmp_path / "e"))
    assert pages.total == 0 and pages.page().count() == 0 and pages.page(with_total=True).columns == ["sample", "price", "total"]
