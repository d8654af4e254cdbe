"""The bitmap index against the scan of filters.matching."""

import random

import pytest
from pyspark.sql import functions as F

from strainframe.operators import bitmap_index as b
from strainframe.operators import filters
from strainframe.operators.filters import Tables

CALL = "sample string, replicon string, gene string, start int, end int, ref string, alt string"


def snp(pos, alt, **more):
    return {"label": "SNP Nt", "ref_nuc": "A", "ref_pos": pos, "alt_nuc": alt, **more}


def aa(pos, alt, gene="g1", **more):
    return {"label": "SNP AA", "protein_symbol": gene, "ref_aa": "A", "ref_pos": pos, "alt_aa": alt, **more}


def prop(name, value, kind="exact", **more):
    return {"label": "Property", "property_name": name, "filter_type": kind, "value": value, **more}


def calls_of(rng, names):
    rows = [(n, f"rep{rng.randrange(2)}", f"g{rng.randrange(2)}", p, p + 1, "A", rng.choice("CGT")) for n in names for p in rng.sample(range(6), 3)]
    # One mutation is everybody's, some rows come twice, and one is of nobody.
    rows += [(n, "rep0", "g0", 50, 51, "A", "C") for n in names if n] + rows[:20] + [("stranger", "rep0", "g0", 1, 2, "A", "C")]
    return rows


@pytest.fixture(scope="module")
def star(spark):
    rng, names = random.Random(4), [f"s{i}" for i in range(400)]
    rows = [(n, rng.choice(["x", "y", None]), rng.randrange(10)) for n in names]
    samples = spark.createDataFrame(rows + rows[:1], "sample string, status string, age int")
    calls = spark.createDataFrame(calls_of(rng, names), CALL)
    eav = spark.createDataFrame([(n, "lab", rng.choice("pq")) for n in names[::3]], "sample string, name string, value_varchar string")
    placed = spark.createDataFrame([(n, "rep0", f"ref{i % 2}") for i, n in enumerate(names)], "sample string, replicon string, reference string")
    return Tables(samples=samples, nt=calls, aa=calls, eav=eav, placed=placed, eav_columns={"lab": "value_varchar"}, genes=frozenset({"g0", "g1"}), replicons=frozenset({"rep0", "rep1"}))


TREES = [
    snp(2, "C"),
    snp(2, "N", exclude=True),
    {},
    {"andFilter": [snp(1, "C"), snp(2, "n", exclude=True), prop("status", "x")]},
    {"orFilter": [{"andFilter": [snp(1, "C"), aa(3, "T")]}, {"andFilter": [prop("lab", "p"), snp(51, "C")]}, prop("status", None, exclude=True)]},
    {**prop("age", 4, "gte"), "andFilter": [{"orFilter": [snp(3, "G", replicon_accession="rep1"), aa(4, "C", "g0", exclude=True)]}], "orFilter": [snp(51, "C", exclude=True), snp(99, "C")]},
    {"label": "DNA/AA Profile", "value": "A2C, ^g1:A3T"},
    {"label": "Sample", "value": ["s1", "s2", "nobody"], "exclude": True},
]


@pytest.mark.parametrize("number", range(len(TREES)))
@pytest.mark.parametrize("reference", [None, "ref1"])
def test_index_equals_scan(star, index, number, reference):
    got = b.matching(star, index, TREES[number], reference)
    assert got.columns == star.samples.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, filters.matching(star, TREES[number], reference).collect()))


@pytest.fixture(scope="module")
def index(star):
    return b.build(star)


def test_ordinals_are_dense(star, index):
    numbers = sorted(r.ordinal for r in index.ordinals.collect())
    assert numbers == list(range(1, 401))
    # A mutation that all carry is one row a bucket.
    assert index.facts["nt"].where("start = 50").count() == 1


def test_ordinals_over_buckets(spark):
    many = spark.range(100_000).select(F.col("id").alias("sample")).repartition(7)
    calls = many.select("sample", F.lit("r").alias("replicon"), (F.col("sample") % 3).cast("int").alias("start"), (F.col("sample") % 3 + 1).cast("int").alias("end"), F.lit("A").alias("ref"), F.lit("C").alias("alt"))
    t = Tables(samples=many, nt=calls)
    index = b.build(t)
    assert index.facts["nt"].count() == 3 * 4
    out = b.matching(t, index, {"orFilter": [snp(1, "C"), snp(3, "C")]})
    assert out.count() == 66_667 and out.where("sample % 3 = 1").count() == 0


def test_rare_mutations_take_no_whole_bitmap(spark):
    many = spark.range(40_000).select(F.col("id").alias("sample"))
    call = lambda at: many.select("sample", F.lit("r").alias("replicon"), at.cast("int").alias("start"), (at + 1).cast("int").alias("end"), F.lit("A").alias("ref"), F.lit("C").alias("alt"))
    t = Tables(samples=many, nt=call(F.col("sample") + 1).unionByName(call(F.lit(0))))
    index = b.build(t)
    for _ in range(2):
        sizes = index.facts["nt"].groupBy(F.col("start") == 0).agg(F.count("*"), F.max(F.size("words")), F.sum(F.size("words"))).collect()
        # One word for a mutation of one sample, 512 and the rest of them for one of all.
        assert {tuple(r) for r in sizes} == {(False, 40_000, 1, 40_000), (True, 2, 512, 40_000 // 64)}
        # No sample is new: what is merged is the same.
        index = b.updated(index, Tables(samples=many.limit(0), nt=t.nt))
    assert [r.sample for r in b.matching(t, index, {"andFilter": [snp(1, "C"), snp(35_001, "C")]}).collect()] == [34_999]


def test_updates(spark, star, index):
    rng = random.Random(8)
    names = [f"s{i}" for i in range(0, 40)] + [f"new{i}" for i in range(30)]
    fresh = spark.createDataFrame([(n, "y", 1) for n in names], star.samples.schema)
    calls = spark.createDataFrame(calls_of(rng, names), CALL)
    after = b.updated(index, Tables(samples=fresh, nt=calls, aa=calls))
    known = star.samples.join(fresh.select("sample"), "sample", "left_anti").unionByName(fresh)
    facts = star.nt.join(fresh.select("sample"), "sample", "left_anti").unionByName(calls)
    whole = Tables(**{**star.__dict__, "samples": known, "nt": facts, "aa": facts})
    for tree in TREES[:7]:
        assert sorted(map(str, b.matching(whole, after, tree).collect())) == sorted(map(str, filters.matching(whole, tree).collect()))


def test_empty_tables_and_null_keys(spark, star):
    none = Tables(samples=star.samples.limit(0), nt=star.nt.limit(0))
    index = b.build(none)
    assert b.matching(none, index, snp(2, "C", exclude=True)).count() == 0
    some = Tables(samples=spark.createDataFrame([(None, "x", 1), ("a", "x", 1)], star.samples.schema), nt=spark.createDataFrame([(None, "rep0", "g0", 1, 2, "A", "C")], CALL))
    index = b.updated(index, some)
    assert [r.sample for r in b.matching(some, index, snp(2, "C", exclude=True)).collect()] == ["a"]
