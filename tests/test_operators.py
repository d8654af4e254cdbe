from datetime import date

import pytest
from pyspark.sql import functions as F

from strainframe.operators import filters, lineage, maintain, match, reshape, stats
from strainframe.sources import readers, writers
from strainframe.streaming import ingest


@pytest.fixture(scope="module")
def small(spark):
    samples = spark.createDataFrame([(1, "a", date(2021, 1, 4), "x"), (2, None, date(2021, 1, 20), None), (3, "b", None, "")], "sample long, host string, day date, lab string")
    nt = spark.createDataFrame([(1, "r", 9, 10, "A", "G"), (2, "r", 9, 10, "A", "N"), (2, "r", 4, 6, "AC", ""), (3, "q", 9, 10, "A", "G")], "sample long, replicon string, start int, end int, ref string, alt string")
    eav = spark.createDataFrame([(1, "age", 5), (2, "age", 0), (2, "dose", 5)], "sample long, name string, value_integer long")
    return filters.Tables(samples=samples, nt=nt, eav=eav, eav_columns={"age": "value_integer", "dose": "value_integer"})


def found(t, tree):
    return sorted(r["sample"] for r in filters.matching(t, tree).collect())


def test_filters(small):
    g = {"label": "SNP Nt", "ref_nuc": "A", "ref_pos": 10, "alt_nuc": "G"}
    assert found(small, g) == [1, 3]
    assert found(small, g | {"alt_nuc": "R"}) == [1, 3] and found(small, g | {"alt_nuc": "N"}) == [1, 2, 3] and found(small, g | {"alt_nuc": "n"}) == [2]
    assert found(small, g | {"replicon_accession": "q"}) == [3]
    assert found(small, {"label": "Del Nt", "first_deleted": "5", "last_deleted": "6"}) == [2]
    assert found(small, {}) == [1, 2, 3]


@pytest.mark.parametrize("leaf", [{"label": "SNP Nt", "ref_nuc": "A", "ref_pos": 10, "alt_nuc": "G"}, {"label": "Property", "property_name": "host", "filter_type": "exact", "value": "a"}, {"label": "Property", "property_name": "age", "filter_type": "gte", "value": 1}])
def test_exclude_is_the_complement(small, leaf):
    tree = {"andFilter": [leaf]}
    other = {"andFilter": [leaf | {"exclude": True}]}
    assert sorted(found(small, tree) + found(small, other)) == [1, 2, 3]
    assert found(small, leaf | {"exclude": True}) == found(small, other)


def test_tree_order(small):
    p = lambda n, v: {"label": "Property", "property_name": n, "filter_type": "exact", "value": v}
    assert found(small, {**p("host", "a"), "andFilter": [p("age", 7)], "orFilter": [p("host", "b")]}) == [3]
    assert found(small, {"andFilter": [p("age", 0), p("dose", 5)]}) == [2]


def test_languages():
    tree = filters.property_tree("age", ["^>=3", "0", "1:5"], "integer")["orFilter"]
    assert [(f["filter_type"], f["value"], f["exclude"]) for f in tree] == [("gte", 3, True), ("exact", 0, False), ("range", [1, 5], False)]
    assert [f["filter_type"] for f in filters.property_tree("n", ["%a", "a%", "%a%", "a"], "text")["orFilter"]] == ["endswith", "startswith", "contains", "exact"]
    with pytest.raises(ValueError):
        filters.property_tree("d", ["2021-02-01:2021-01-01"], "date")
    with pytest.raises(ValueError):
        filters.profile_filters(["x:A4G"], {"S"}, {"r"})
    made = filters.profile_filters(["^S:del:7-8", "r:A4GT"], {"S"}, {"r"})
    assert [(f["label"], f["exclude"]) for f in made] == [("Del AA", True), ("Ins Nt", False)]
    groups = [{"filters": [{"label": "Property", "property_name": "day", "value": [date(2021, 2, 1), date(2021, 1, 1)]}, {"label": "Sample", "value": []}]}]
    assert filters.group_tree(groups)["orFilter"][0]["andFilter"][0]["value"] == [date(2021, 1, 1), date(2021, 2, 1)]
    assert filters.coerced("a, b", "in") == ["a", "b"] and filters.coerced("%a%", "contains") == "a"


def test_unknown_names_are_errors(small):
    for bad in ({"label": "?"}, {"label": "Property", "property_name": "nope", "value": 1}, {"label": "SNP Nt", "ref_nuc": "A", "ref_pos": 1, "alt_nuc": "Q"}):
        with pytest.raises(ValueError):
            filters.matching(small, bad)


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "b")], "lineage string, parent string")
    rows = {(r["root"], r["lineage"]) for r in lineage.descendants(edges, edges.where("lineage IN ('a', 'd')").select("lineage")).collect()}
    assert rows == {("a", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("d", "d")}


def test_lineage_shapes(spark):
    clades = spark.createDataFrame([("A.1", "clade", "A", "", 1), ("A", "nuc", "1", "", 0), ("B.1", "clade", "B", "", 2), ("A.1", "nuc", "1", "", 3)], "clade string, gene string, site string, alt string, seq long")
    got = {r["lineage"]: r["parent"] for r in lineage.edges_from_pairs(lineage.pairs_from_clades(clades)).collect()}
    assert got == {"A": None, "A.1": "A", "B": None, "B.1": "B"}
    pairs = spark.createDataFrame([("X", "Y", 0), ("Z", "None", 1)], "lineage string, parent string, seq long")
    assert {r["lineage"]: r["parent"] for r in lineage.edges_from_pairs(pairs).collect()} == {"X": "Y", "Y": None, "Z": None}
    alone = spark.createDataFrame([("A", None)], "lineage string, parent string")
    assert [tuple(r) for r in lineage.child_table(alone).collect()] == [("A", "none")]
    aliases = spark.createDataFrame([("B", ""), ("AY", "B.1.617.2")], "alias string, prefix string")
    names = spark.createDataFrame([("AY.4.2",), ("AY.4",), ("B.1",), ("B",)], "lineage string")
    assert {r["lineage"]: r["parent"] for r in lineage.alias_parents(names, aliases).collect()} == {"AY.4.2": "AY.4", "AY.4": "AY", "B.1": "B", "B": None}


def test_shares_and_bins(spark, small):
    shared = stats.filled_groups(stats.group_shares(small.samples, "host"))
    assert {r["monday"]: r["s"] for r in stats.normalised(shared, "samples").groupBy("monday").agg(F.sum("normalised").alias("s")).collect()}[date(2021, 1, 4)] == 100
    rows = stats.histogram(spark.createDataFrame([(0.0,), (10.0,), (30.0,)], "v double"), "v", 10).orderBy("bin").collect()
    assert [(r["label"], r["n"]) for r in rows] == [("0.00-10.00", 1), ("10.00-20.00", 1), ("20.00-30.00", 0), ("30.00-40.00", 1)]


def test_columns():
    assert match.output_columns(["genomic_profiles", "x", "name"], ["name", "x", "genomic_profiles"]) == ["name", "x", "genomic_profiles"]
    with pytest.raises(ValueError):
        match.output_columns(["y"], ["x"])
    assert match.auto_linked(["ID", "Host"], ["name", "host", "lab"], {"name": "ID"}) == ({"name": "ID", "host": "Host"}, ["lab"])
    with pytest.raises(ValueError):
        match.auto_linked(["Host"], ["host"])
    assert reshape.split_columns(["name", "lab", "age"], ["name", "lab"], "name") == (["lab"], ["age"])


def test_metadata_upsert_links(spark):
    samples = spark.createDataFrame([("a", "old", 0)], "sample string, lab string, ingest_seq int")
    eav = spark.createDataFrame([("a", "age", 5)], "sample string, name string, value_integer long")
    links = spark.createDataFrame([("a", "s1"), ("b", "s2")], "sample string, sequence string")
    rows = spark.createDataFrame([("a", "x", "6", "s3 s4", 1), ("a", "new", "7", "s4", 2)], "sample string, lab string, age string, sequences string, ingest_seq int")
    s, e, n = maintain.metadata_upserted(samples, eav, rows, ["lab"], {"age": "value_integer"}, links=links)
    assert [(r["sample"], r["lab"]) for r in s.collect()] == [("a", "new")] and [r["value_integer"] for r in e.collect()] == [7]
    assert {tuple(r) for r in n.collect()} == {("a", "s4"), ("b", "s2")}


def test_files(spark, tmp_path):
    import gzip
    import lzma
    import zipfile

    text = ">a one\nAC\nGT\n>b|two\nTT\n"
    (tmp_path / "p.fasta").write_text(text)
    (tmp_path / "x.xz").write_bytes(lzma.compress(text.encode()))
    (tmp_path / "g.gz.bin").write_bytes(gzip.compress(text.encode()))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in.fasta", text)
    expected = {("a", "ACGT"), ("b", "TT")}
    assert {(r["id"], r["sequence"]) for r in readers.read_fasta(spark, str(tmp_path / "p.fasta")).collect()} == expected
    for name in ("x.xz", "g.gz.bin", "z.zip"):
        assert {(r["id"], r["sequence"]) for r in readers.read_packed_fasta(spark, str(tmp_path / name)).collect()} == expected
    (tmp_path / "l.json").write_text('{"seqId": "s", "substitutions": [{"pos": 1, "refNuc": "A", "qryNuc": "C"}]}\nnot json\n')
    assert readers.read_aligner_json(spark, str(tmp_path / "l.json")).count() == 1
    (tmp_path / "o.json").write_text('{"results": [{"seqId": "s", "insertions": [{"pos": 1, "ins": "A"}]}, {"seqId": "t"}]}')
    assert sorted(r["seqId"] for r in readers.read_aligner_json(spark, str(tmp_path / "o.json"), "object").collect()) == ["s", "t"]
    (tmp_path / "j.json").write_text('{"lineages": [{"name": "X", "parent": "None"}]}')
    assert [tuple(r)[:2] for r in readers.read_json_lineages(spark, str(tmp_path / "j.json")).collect()] == [("X", "None")]
    (tmp_path / "c.tsv").write_text("clade\tgene\tsite\talt\nA.1\tclade\tA\t\n")
    assert readers.read_clades(spark, [str(tmp_path / "c.tsv")] * 2).count() == 2
    (tmp_path / "t.tsv").write_text("lineage\tsublineage\nA\tA.1,A.2\nB\tnone\n")
    rows = lineage.edges_from_children(readers.read_lineages(spark, str(tmp_path / "t.tsv"))).collect()
    assert {(r["lineage"], r["parent"]) for r in rows} == {("A", None), ("A.1", "A"), ("A.2", "A"), ("B", None)}
    lines = writers.fasta_lines(spark.createDataFrame([("a", "A" * 160)], "id string, sequence string")).first()[0].split("\n")
    assert [len(x) for x in lines] == [2, 80, 80]
    lineage.write_edges(spark.createDataFrame([("a", "r1"), ("b", "r2")], "lineage string, reference string"), str(tmp_path / "e"))
    lineage.write_edges(spark.createDataFrame([("c", "r1")], "lineage string, reference string"), str(tmp_path / "e"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "e")).collect()} == {("c", "r1"), ("b", "r2")}


def test_profile_leaf(spark):
    """A profile as users type it needs all of its notations; exclude is its complement as a whole."""
    samples = spark.createDataFrame([(i,) for i in range(4)], "sample long")
    nt = spark.createDataFrame([(0, "r", 9, 10, "A", "G"), (0, "r", 3, 5, "AA", ""), (1, "r", 9, 10, "A", "G"), (2, "r", 3, 5, "AA", None)], "sample long, replicon string, start int, end int, ref string, alt string")
    t = filters.Tables(samples=samples, nt=nt, replicons=frozenset({"r"}))
    ids = lambda tree: sorted(r["sample"] for r in filters.matching(t, tree).collect())
    profile = {"label": "DNA/AA Profile", "value": "A10G,; r:del:4-5 "}
    assert ids(profile) == [0] and ids(profile | {"exclude": True}) == [1, 2, 3]
    assert ids({"label": "DNA/AA Profile", "value": "A10G ^del:=4-=5"}) == [1]
    assert ids(profile | {"orFilter": [{"label": "Sample", "value": [3]}]}) == [0, 3]
    for bad in ("", "what", "x:A10G"):
        with pytest.raises(ValueError):
            ids({"label": "DNA/AA Profile", "value": bad})


def test_last_wins_has_no_chance(spark):
    rows = [(1, v, 7) for v in "abcdef"] + [(2, "x", None), (2, "y", 1)]
    df = spark.createDataFrame(rows, "k long, v string, seq int")
    once = {tuple(r) for r in maintain.last_wins(df, ["k"], "seq").collect()}
    assert len(once) == 2 and (2, "y", 1) in once
    assert {tuple(r) for r in maintain.last_wins(df.repartition(5).orderBy(F.desc("v")), ["k"], "seq").collect()} == once


def test_natural_ranks_by_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(f"n{i * 37 % 101}",) for i in range(120)] + [("Unknown",)], "name string")
    ranks = lambda: {r["name"]: r["natural_rank"] for r in stats.naturally(df, "name").collect()}
    expected = ranks()
    monkeypatch.setattr(stats, "few", lambda names: False)
    assert ranks() == expected and expected["Unknown"] == 1 and expected["n9"] < expected["n10"]


def test_ingest_makes_changes_one_table(spark, tmp_path):
    """Six batches, each two of them made one; a replayed batch counts once; what was replaced goes."""
    schema, at = "name long, status string, seq int", f"file://{tmp_path}"
    for k in range(6):
        spark.createDataFrame([(0, f"s{k}", k), (k, "new", k)], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        ingest.ingest(spark, f"{at}/in", f"{at}/out", schema, ["name"], "seq", f"{at}/state", 1, 2).awaitTermination()
    got = {r["name"]: r["status"] for r in ingest.snapshot(spark, f"{at}/out/data", schema, ["name"], "seq").collect()}
    assert got == {0: "s5"} | {k: "new" for k in range(1, 6)} and spark.read.parquet(f"{at}/out/log").count() == 6
    names = ingest._listed(spark, f"{at}/out/data")
    assert "whole-000000000005" in names and not [n for n in names if n < "whole-000000000003" and n.startswith("whole")] and len(names) < 8
    assert ingest.snapshot(spark, f"{at}/none", schema, ["name"], "seq").count() == 0
