"""What held at the size of the test tables only."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strainframe.operators import variants as v
from strainframe.plans import variant_queries as q


def _lines(spark, at, rows):
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_returnflag string, l_linenumber int").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def test_aligner_calls_behind_ten_thousand_parts(spark, tmp_path):
    """the reference is as long as the parts are many."""
    at = _lines(spark, tmp_path, [(1, 9_998, "N", 1), (1, 25_000, "N", 2), (1, 30_000, "R", 3), (2, 40_000, "A", 1)])
    got = sorted((r["id"], r["start"], r["ref"], r["alt"]) for r in q.aligner_json_nt(spark, at).collect())
    assert got == [("1", 9_998, "AAA", ""), ("1", 25_000, "AAA", ""), ("1", 30_000, "A", "AGG"), ("2", 40_000, "C", "T")]


def test_bases_of_ranges_of_any_length(spark):
    """Across pieces, longer than pieces, behind the end, and of texts that are more than ASCII."""
    rng = random.Random(3)
    texts = {"a": "".join(rng.choice("ACGT") for _ in range(2_000)), "b": "ÄC" * 300, "c": ""}
    rows = [(r, rng.randrange(0, 2_100), rng.choice([0, 1, 3, 256, 257, 700])) for r in texts for _ in range(40)] + [("a", 10, None), ("z", 1, 3)]
    found = v._with_bases(spark.createDataFrame(rows, "replicon string, _first long, _n long"), spark.createDataFrame(list(texts.items()), "replicon string, sequence string"))
    got = sorted((r["replicon"], r["_first"], r["_n"] or 0, r["_bases"]) for r in found.collect())
    assert got == sorted((r, a, n or 0, texts.get(r, "")[a : a + (n or 0)]) for r, a, n in rows)


def test_vcf_rows_on_a_long_reference(spark):
    """60,000 deletions on a reference of 3,000,000 bases; each walked to its place."""
    calls = spark.range(60_000).select(F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("id"), F.lit("r").alias("replicon"), (F.col("id") * 49 + 1).alias("start"), F.lit("A").alias("ref"), F.lit("").alias("alt"))
    references = spark.range(1).select(F.lit("r").alias("replicon"), F.expr("repeat('CGT', 1000000)").alias("sequence"))
    begun = time.time()
    rows = v.vcf_rows(calls, references, ["s0", "s1"]).agg(F.count("*").alias("n"), F.count_if(F.col("alt") == F.expr("element_at(array('C', 'G', 'T'), cast((pos - 1) % 3 AS INT) + 1)")).alias("right"), F.count_if(F.col("s0") == "./.").alias("s0")).first()
    assert tuple(rows) == (60_000, 60_000, 30_000) and time.time() - begun < 20


def test_vcf_genotypes_by_alt(spark):
    """Alts are numbered in order, the least number as text counts, samples that are not asked for make rows."""
    rows = [("s0", "r", 4, "A", alt) for alt in "BCDEFGHIJKLM"[1:]] + [("s1", "r", 4, "A", "B"), ("s1", "r", 4, "A", "K"), ("x", "r", 9, "A", "T"), ("x", "r", 9, None, "T"), ("x", "gone", 9, "A", "")]
    out = v.vcf_rows(spark.createDataFrame(rows, "id string, replicon string, start int, ref string, alt string"), spark.createDataFrame([("r", "ACGT")], "replicon string, sequence string"), ["s0", "s1"])
    assert sorted(map(tuple, out.collect())) == [("r", 5, "A", "B,C,D,E,F,G,H,I,J,K,L,M", "10", "1"), ("r", 10, "A", "T", "0", "0")]


@pytest.mark.parametrize("rows", [0, 1])
def test_aligner_calls_of_a_text(spark, rows):
    """References as texts stay, and tables without records."""
    kinds = "seqId string, substitutions array<struct<pos: bigint, refNuc: string, qryNuc: string>>, deletions array<struct<range: struct<begin: bigint, end: bigint>>>, insertions array<struct<pos: bigint, ins: string>>"
    records = spark.createDataFrame([("x", [], [((1, 4),)], [(0, "TT")])][:rows], kinds)
    assert sorted((r["start"], r["ref"], r["alt"]) for r in v.aligner_nt(records, "r", "ACGTA").collect()) == [(0, "A", "ATT"), (1, "CGT", "")][: 2 * rows]


def _covered(calls, genes):
    """By trying every gene."""
    out = []
    for n, r, s, e in calls:
        fits = [(a, g) for g, gr, a, b in genes if gr == r and None not in (s, e) and s <= e and a <= b and a >= s and b <= e]
        if fits:
            out.append((n, min(fits)[1]))
    return sorted(out)


def test_covered_genes_of_all_lengths(spark):
    """Sparse, dense, nested and piled genes; negative places; calls of all lengths."""
    rng = random.Random(5)
    genes = [(f"g{i:03}", "r", a := rng.choice([rng.randrange(-300, 200), rng.randrange(0, 100_000)]), a + rng.choice([0, 1, 30, 500, 40_000])) for i in range(150)]
    genes += [(f"n{i:03}", "r", 3_000 + i, 9_000 - i) for i in range(200)] + [(f"p{i:03}", "r", 777, 777 + 97 * i % 101) for i in range(100)] + [("back", "r", 50, 40), ("other", "q", 1, 2)]
    calls = [(i, rng.choice("rrrrq"), a := rng.choice([rng.randrange(-400, 400), rng.randrange(700, 800), rng.randrange(2_900, 3_300), rng.randrange(0, 90_000)]), a + int(2 ** rng.uniform(0, 20)) - 1) for i in range(600)]
    calls += [(600, "r", 5, 1), (601, "r", None, 9)]
    found = v.covered_genes(spark.createDataFrame(calls, "n int, replicon string, start int, end int"), spark.createDataFrame(genes, "gene string, replicon string, start long, end long"))
    assert found.columns == ["n", "replicon", "start", "end", "gene"]
    assert sorted((r["n"], r["gene"]) for r in found.collect()) == _covered(calls, genes)
    short = [c for c in calls if c[2] is not None and c[3] - c[2] < 60]
    found = v.covered_genes(spark.createDataFrame(short, "n int, replicon string, start int, end int"), spark.createDataFrame(genes, "gene string, replicon string, start long, end long"))
    assert sorted((r["n"], r["gene"]) for r in found.collect()) == _covered(short, genes)


def test_long_calls_do_not_meet_all_genes(spark):
    """20,000 calls that cover 100,000 genes each and more."""
    calls = spark.range(20_000).select(F.col("id").alias("n"), F.lit("r").alias("replicon"), F.col("id").alias("start"), (F.col("id") + 900_000).alias("end"))
    genes = spark.range(200_000).select(F.col("id").alias("gene"), F.lit("r").alias("replicon"), F.col("id").alias("start"), (F.col("id") + 3).alias("end"))
    begun = time.time()
    assert v.covered_genes(calls, genes).agg(F.count_if(F.col("n") == F.col("gene"))).first()[0] == 20_000 and time.time() - begun < 60


def test_large_dimensions_do_not_go_through_the_driver(spark):
    """F13, F16 to F19: 300,000 rows take 2.4 MB, which Spark would broadcast by itself."""
    from strainframe.operators.scale import dimension

    plan = spark.range(10).join(dimension(spark.range(300_000)), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert "Broadcast" in spark.range(10).join(dimension(spark.range(3)), "id")._jdf.queryExecution().executedPlan().toString()


def test_small_ranges_share_tasks_and_folders(spark, tmp_path):
    """500 ranges of 40 rows were 500 tasks and folders."""
    from strainframe.operators import paging

    df = spark.range(20_000).selectExpr("id AS sample", "id * 7919 % 20000 AS price")
    paging.write_pages(df, str(tmp_path / "p"), "price", "sample", rows_a_range=40)
    pages = paging.open_pages(spark, str(tmp_path / "p"))
    assert len(pages.ranges) == 500 and len(list((tmp_path / "p").glob(f"{paging.GROUP}=*"))) == 1
    assert [r["price"] for r in pages.page(50, 10_030).collect()] == list(range(10_030, 10_080))
    assert [r["price"] for r in pages.after(12_345, 2**62, 90).collect()] == list(range(12_346, 12_436)) and pages._rows(3, 4).count() == 80


def test_deleting_many_samples_broadcasts_nothing(spark):
    """300,000 samples that go take 2.4 MB, which Spark broadcast by itself."""
    from strainframe.operators import maintain

    ids = spark.range(400_000).select(F.col("id").alias("sample"))
    links, parts = ids.withColumn("sequence", F.col("sample") % 250_000), spark.range(260_000).select(F.col("id").alias("sequence"))
    left = maintain.delete_samples(ids.where("sample < 300000"), ids, links, ids, parts, parts.where("sequence % 2 = 0"))
    plan = left["samples"]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # Sequences of 50,000 to 149,999 are those of samples that stay, 250,000 and on nobody's.
    assert {n: d.count() for n, d in left.items()} == {"samples": 100_000, "links": 100_000, "eav": 100_000, "sequences": 110_000, "alignments": 55_000}


def test_property_lists_are_dealt_by_rows(spark):
    """partitions merged by compressed bytes made a task's memory grow with the table."""
    from strainframe.operators import reshape

    own = spark.range(1_200_000).selectExpr("id AS sample", "'F' AS status", "id % 7 AS priority")
    lists = reshape.property_list(own, ["status", "priority"])
    assert "REPARTITION_BY_NUM" in lists._jdf.queryExecution().executedPlan().toString()
    assert lists.rdd.getNumPartitions() == 3 and lists.where("size(properties) = 2").count() == 1_200_000
