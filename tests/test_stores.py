"""Stores that are laid out so that a read or a batch meets only what it needs."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from strainframe.operators.scale import shared_dir
from strainframe.sources import variant_store as v
from strainframe.streaming.ranged import RangedTable


def folder(spark):
    return f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"


def interleaved(x, y):
    return sum(((x >> i & 1) << 2 * i + 1) | ((y >> i & 1) << 2 * i) for i in range(16))


def test_morton(spark):
    r = random.Random(5)
    pairs = [(r.randrange(1 << 16), r.randrange(1 << 16)) for _ in range(200)] + [(0, 0), (65535, 65535), (1, 0), (0, 1)]
    got = spark.createDataFrame(pairs, "x long, y long").select("x", "y", v.morton(F.col("x"), F.col("y")).alias("z")).collect()
    assert all(z == interleaved(x, y) for x, y, z in got)


@pytest.fixture(scope="module")
def store(spark):
    """60,000 variants of one reference, of which one allele is in a third of the rows, and a small reference; twice each."""
    r = random.Random(7)
    rows = [(i, 1000 if i % 3 == 0 else r.randrange(30000), "A", "T" if i % 3 == 0 else r.choice("CGT"), "big" if i % 20 else "small") for i in range(60000)]
    df = spark.createDataFrame(rows, "seqhash long, start int, ref string, alt string, reference_acc string").withColumns({"refhash": F.lit("r"), "end": F.col("start") + 1, "type": F.lit("nt")})
    path = folder(spark)
    v.write_variants(df.unionByName(df), path, 1000)
    return path, rows


def test_region_opens_few_files(spark, store):
    path, rows = store
    files = v.manifest(spark, path).count()
    assert files >= 55
    got = v.read_region(spark, path, "big", 12000, 12300)
    assert len(got.inputFiles()) <= files / 3
    assert sorted((r.seqhash, r.start) for r in got.collect()) == sorted((s, at) for s, at, _, _, ref in rows if ref == "big" and 12000 <= at <= 12300)
    one = v.read_allele(spark, path, "big", 12010, "A", "C")
    assert len(one.inputFiles()) <= 4
    assert {r.seqhash for r in one.collect()} == {s for s, at, _, alt, ref in rows if (ref, at, alt) == ("big", 12010, "C")}


def test_hot_allele_is_split(spark, store):
    path, rows = store
    assert v.manifest(spark, path).agg(F.max("rows")).first()[0] < 4000  # 19,000 rows have one allele
    assert v.read_allele(spark, path, "big", 1000, "A", "T").count() == sum(at == 1000 and alt == "T" and ref == "big" for _, at, _, alt, ref in rows)


def test_store_without_manifest_or_rows(spark, store):
    empty = folder(spark)
    v.write_variants(spark.createDataFrame([], "seqhash long, refhash string, start int, end int, ref string, alt string, type string, reference_acc string"), empty)
    assert v.manifest(spark, empty) is None
    path = folder(spark)
    df = spark.createDataFrame([(1, "r", 5, 6, "A", None, "nt", "x"), (1, "r", 5, 6, "A", None, "nt", "x"), (2, "r", None, None, "A", "C", "nt", "x")], "seqhash long, refhash string, start int, end int, ref string, alt string, type string, reference_acc string")
    v.write_variants(df, path)
    assert spark.read.parquet(path).count() == 2
    assert [r.seqhash for r in v.read_region(spark, path, "x", 0, 9).collect()] == [1]
    assert v.read_region(spark, path, "y", 0, 9).count() == 0


SCHEMA = "name long, status string, seq int"


def batch(spark, names, status, seq):
    return spark.createDataFrame([(n, status, seq) for n in names], SCHEMA)


def test_batches_write_only_their_ranges(spark):
    t = RangedTable(spark, folder(spark), SCHEMA, ["name"], "seq", 100)
    t.apply(batch(spark, range(10000), "a", 0), 0)
    t.apply(batch(spark, range(4950, 5050), "b", 1), 1)
    rows = {r.name: (r.status, r.batch) for r in t.read().collect()}
    assert len(rows) == 10000
    assert {n for n, (s, _) in rows.items() if s == "b"} == set(range(4950, 5050))
    assert {n for n, (_, b) in rows.items() if b == 1} == set(range(4900, 5100))
    assert sorted(r.range for r in t.versions().where("batch = 1").collect()) == [49, 50]


def test_replay_and_crash(spark):
    t = RangedTable(spark, folder(spark), SCHEMA, ["name"], "seq", 10)
    t.apply(batch(spark, range(50), "a", 0), 0)
    late = batch(spark, [3, 3, 77], "b", 1).unionByName(batch(spark, [4], "old", -1))
    t.apply(late, 1)
    want = sorted(map(tuple, t.snapshot().collect()))
    assert (3, "b", 1) in want and (77, "b", 1) in want and (4, "a", 0) in want and len(want) == 51
    t.apply(late, 1)
    assert sorted(map(tuple, t.snapshot().collect())) == want
    # A batch that ends before its log counts for nothing; its replay does.
    third = batch(spark, [5, 60], "c", 2)
    third.withColumn("range", t.range_of()).write.partitionBy("range").parquet(f"{t.path}/data/batch=2")
    assert sorted(map(tuple, t.snapshot().collect())) == want
    t.apply(third, 2)
    got = sorted(map(tuple, t.snapshot().collect()))
    assert len(got) == 52 and (5, "c", 2) in got and (6, "a", 0) in got
    gone = t.vacuum(1)
    assert any(x.endswith("batch=0/range=0") for x in gone)
    assert sorted(map(tuple, t.snapshot().collect())) == got


def test_text_keys_nulls_and_empty_batches(spark):
    t = RangedTable(spark, folder(spark), "name string, status string, seq int", ["name"], "seq", 8)
    assert t.snapshot().count() == 0
    t.apply(spark.createDataFrame([("x", "a", 0), (None, "n", 0), ("y", "a", 0)], "name string, status string, seq int"), 0)
    t.apply(spark.createDataFrame([], "name string, status string, seq int"), 1)
    t.apply(spark.createDataFrame([("x", "b", 1), (None, "m", 1)], "name string, status string, seq int"), 2)
    assert sorted((str(r.name), r.status) for r in t.snapshot().collect()) == [("None", "m"), ("x", "b"), ("y", "a")]
