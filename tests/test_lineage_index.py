import random

import pytest

from strainframe.operators import filters, lineage, lineage_index


def below(edges):
    """Plain closure: {(root, lineage)}, for tables without cycles."""
    parents = dict(edges)
    out = set()
    for at in parents:
        up = at
        while up is not None and up in parents:
            out.add((up, at))
            up = parents[up]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "lineage string, parent string")


@pytest.mark.parametrize("siblings", [100_000, 7])
def test_labels_of_a_random_forest(spark, siblings, monkeypatch):
    """Intervals hold exactly what lies below; families of any size give the same, in bins as well."""
    monkeypatch.setattr(lineage_index, "SIBLINGS", siblings)
    monkeypatch.setattr(lineage_index, "BLOCK", 5)
    pick = random.Random(3)
    rows = [("n0", None), ("r", "unknown")] + [(f"n{i}", None if pick.random() < 0.03 else f"n{0 if pick.random() < 0.3 else pick.randrange(i)}") for i in range(1, 120)]
    labels = lineage_index.labelled(table(spark, rows))
    at = {r["lineage"]: (r["first"], r["last"]) for r in labels.collect()}
    assert sorted(a for a, _ in at.values()) == list(range(len(rows)))
    plain = below([(n, None if p == "unknown" else p) for n, p in rows])
    assert {(a, b) for a in at for b in at if at[a][0] <= at[b][0] <= at[a][1]} == plain
    every = lineage_index.descendants_by_labels(labels, labels.select("lineage"))
    assert {(r["root"], r["lineage"]) for r in every.collect()} == plain and every.count() == len(plain)
    counts = spark.createDataFrame([("", n, i) for i, (n, _) in enumerate(rows)] + [("", "n1", 1), ("", "nowhere", 9)], "reference string, lineage string, n long")
    n = {name: i + (name == "n1") for i, (name, _) in enumerate(rows)}
    got = {r["lineage"]: (r["own"], r["whole"]) for r in lineage_index.rolled_up(labels, counts).collect()}
    assert got == {a: (n[a], sum(n[b] for x, b in plain if x == a)) for a in n}


def test_a_long_chain(spark):
    """10,000 lineages in one line: rounds go by the log of its depth."""
    chain = spark.range(10_000).selectExpr("concat('c', id) AS lineage", "CASE WHEN id > 0 THEN concat('c', id - 1) END AS parent")
    labels = lineage_index.labelled(chain)
    assert labels.where("cast(substring(lineage, 2) AS long) = first AND last = 9999").count() == 10_000


def test_cycles_have_no_labels(spark):
    rows = [("a", "c"), ("b", "a"), ("c", "b"), ("d", "b"), ("s", "s"), ("x", None), ("y", "x")]
    labels = lineage_index.labelled(table(spark, rows))
    assert {r["lineage"]: (r["first"], r["last"]) for r in labels.collect()} == dict.fromkeys("abcds", (None, None)) | {"x": (0, 1), "y": (1, 1)}
    t = filters.Tables(samples=spark.createDataFrame([(1, "d"), (2, "y"), (3, None)], "sample long, lineage string"), lineages=table(spark, rows).selectExpr("*", "'' AS reference"), labels=labels)
    found = lambda *names: sorted(r["sample"] for r in filters.matching(t, {"label": "Lineages", "lineageList": list(names)}, "").collect())
    assert found("A") == [1] and found("x") == [2] and found("a", "y") == [1, 2]
    with pytest.raises(ValueError):
        found("nowhere")


def test_several_parents_and_empty_tables(spark):
    with pytest.raises(ValueError, match="several parents"):
        lineage_index.labelled(table(spark, [("a", None), ("b", None), ("c", "a"), ("c", "b")]))
    twice = lineage_index.labelled(table(spark, [("a", None), ("a", None), ("b", "a"), ("b", None), (None, "a")]))
    assert sorted(tuple(r)[1:] for r in twice.collect()) == [("a", None, 0, 1), ("b", "a", 1, 1)]
    assert lineage_index.labelled(table(spark, [])).count() == 0


def test_references_are_apart_and_written_apart(spark, tmp_path):
    schema, path = "reference string, lineage string, parent string", str(tmp_path / "labels")
    lineage_index.write_labels(spark.createDataFrame([("p", "a", None), ("p", "b", "a"), ("q", "b", None), ("q", "a", "b")], schema), path)
    lineage_index.write_labels(spark.createDataFrame([("q", "a", None), ("q", "b", None)], schema), path)
    assert {(r["reference"], r["lineage"], r["first"], r["last"]) for r in spark.read.parquet(path).collect()} == {("p", "a", 0, 1), ("p", "b", 1, 1), ("q", "a", 0, 0), ("q", "b", 1, 1)}


def test_a_filter_is_a_pushed_range_of_two_jobs(spark, tmp_path):
    """The range reaches the scan of the samples; names that lie below other names add nothing; both ways give the rows of the closure."""
    edges = spark.range(1, 400).selectExpr("'ref' AS reference", "concat('L', id) AS lineage", "CASE WHEN id > 1 THEN concat('L', id div 2) END AS parent")
    labels = lineage_index.labelled(edges)
    samples = spark.range(3000).selectExpr("id AS sample", "concat('L', id % 450) AS lineage")
    lineage_index.write_located(lineage_index.located(samples, labels, "ref"), str(tmp_path / "s"), rows_a_file=300)
    stored = spark.read.parquet(str(tmp_path / "s"))
    tree = {"label": "Sublineages", "lineageList": ["l5", "L10", "L21", "L40"]}
    plain = filters.matching(filters.Tables(samples=samples, lineages=edges), tree, "ref")
    assert lineage_index.ranges(labels, ["l5", "L10", "L21", "L40"], "ref") == lineage_index.ranges(labels, ["L5"], "ref")
    spark.sparkContext.setJobGroup("pushed", "")
    by_range = filters.matching(filters.Tables(samples=stored, lineages=edges, labels=labels), tree, "ref")
    rows = sorted(r["sample"] for r in by_range.collect())
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("pushed")) == 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "GreaterThanOrEqual(lineage_at" in by_range._jdf.queryExecution().toString()
    assert rows == sorted(r["sample"] for r in plain.collect()) and rows
    on_labels = filters.matching(filters.Tables(samples=samples, lineages=edges, labels=labels), tree, "ref")
    assert rows == sorted(r["sample"] for r in on_labels.collect())
    roots = edges.where("lineage IN ('L5', 'L10')")
    assert {tuple(r) for r in lineage.descendants(edges, roots).collect()} == {(r["root"], r["lineage"]) for r in lineage_index.descendants_by_labels(labels, roots).collect()}
