"""Queries of statistics, series, shares, distributions, lineages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import percent_text, week_start
from ..operators import bitmap_cube, lineage, lineage_index, reshape, stats
from .bindings import CALLS, EAV_TEXT, EDGES, ORACLE_SQL, PLACED, SAMPLES, calls, eav_text, edges, placed, query, samples, table

MONDAY = "date_trunc('week', day)::DATE"
WEEKS = f"(SELECT {MONDAY} AS monday, count(DISTINCT sample) AS samples FROM {SAMPLES} WHERE day IS NOT NULL GROUP BY 1)"
LABEL = "strftime(monday, '%G-W%V')"
AXIS = "(SELECT unnest(generate_series(min(monday), max(monday), INTERVAL 7 DAY))::DATE AS monday FROM {})"


def _text(df):
    return df.withColumn("monday", F.col("monday").cast("string"))


@query(f"SELECT count(DISTINCT sample) AS samples, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day FROM {SAMPLES}")
def statistics_totals(spark, sf):
    return stats.totals(samples(spark, sf)).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query(f"SELECT monday::VARCHAR AS monday, {LABEL} AS week, samples FROM {WEEKS}")
def samples_per_week(spark, sf):
    return _text(stats.per_week(samples(spark, sf)))


RARE = f"(SELECT {MONDAY} AS monday, count(DISTINCT sample) AS samples FROM {SAMPLES} WHERE status = 'P' AND priority = '1-URGENT' GROUP BY 1)"


@query(f"SELECT a.monday::VARCHAR AS monday, strftime(a.monday, '%G-W%V') AS week, coalesce(w.samples, 0) AS samples FROM {AXIS.format(RARE)} a LEFT JOIN {RARE} w USING (monday)")
def samples_per_week_filled(spark, sf):
    """Weeks of the urgent samples that are pending, of which some weeks have none."""
    return _text(stats.filled_weeks(stats.per_week(samples(spark, sf).where("status = 'P' AND priority = '1-URGENT'"))))


SHARES = f"(SELECT {MONDAY} AS monday, priority AS \"group\", count(DISTINCT sample) AS samples, round(100.0 * count(DISTINCT sample) / sum(count(DISTINCT sample)) OVER (PARTITION BY {MONDAY}), 2) AS percent FROM {SAMPLES} WHERE day IS NOT NULL GROUP BY 1, 2)"


@query(f"SELECT monday::VARCHAR AS monday, {LABEL} AS week, \"group\", samples, percent FROM {SHARES}")
def group_share_per_week(spark, sf):
    return _text(stats.group_shares(samples(spark, sf), "priority"))


@query(f"SELECT a.monday::VARCHAR AS monday, strftime(a.monday, '%G-W%V') AS week, g.\"group\", coalesce(samples, 0) AS samples, coalesce(percent, 0.0) AS percent FROM {AXIS.format(SHARES)} a CROSS JOIN (SELECT DISTINCT \"group\" FROM {SHARES}) g LEFT JOIN {SHARES} x ON x.monday = a.monday AND x.\"group\" = g.\"group\"")
def group_share_filled(spark, sf):
    return _text(stats.filled_groups(stats.group_shares(samples(spark, sf), "priority")))


@query(f"SELECT monday::VARCHAR AS monday, \"group\", round(100.0 * samples / sum(samples) OVER (PARTITION BY monday), 4) AS normalised FROM {SHARES} WHERE \"group\" <> '5-LOW'")
def share_normalised(spark, sf):
    """Shares among the groups that are shown."""
    shown = stats.group_shares(samples(spark, sf), "priority").where(F.col("group") != "5-LOW")
    return _text(stats.normalised(shown, "samples")).select("monday", "group", "normalised")


@query(f"SELECT monday::VARCHAR AS monday, {LABEL} AS week, samples FROM {WEEKS} WHERE monday IN (SELECT monday FROM {WEEKS} ORDER BY monday DESC LIMIT 26)")
def last_weeks(spark, sf):
    return _text(stats.last_weeks(stats.per_week(samples(spark, sf))))


COVERAGE = f"""(SELECT 'status' AS property, count(*) FILTER (trim(status) <> '') AS n FROM {SAMPLES} UNION ALL SELECT 'day', count(day) FROM {SAMPLES} UNION ALL SELECT 'price', count(price) FROM {SAMPLES}
    UNION ALL SELECT name, count(DISTINCT sample) FROM {EAV_TEXT} WHERE sample IN (SELECT sample FROM {SAMPLES}) AND value <> '' GROUP BY name
    UNION ALL SELECT 'nt', count(DISTINCT sample) FROM {CALLS} WHERE sample IN (SELECT sample FROM {SAMPLES}))"""


def _coverage(spark, sf):
    return stats.coverage(samples(spark, sf), ["status", "day", "price"], eav_text(spark, sf), {"nt": calls(spark, sf)})


@query(f"SELECT * FROM {COVERAGE}")
def metadata_coverage(spark, sf):
    return _coverage(spark, sf)


@query(f"SELECT property FROM {COVERAGE} WHERE n > 0")
def populated_fields(spark, sf):
    return stats.populated(_coverage(spark, sf))


@query(f"SELECT property, n, round(100.0 * n / (SELECT count(*) FROM {SAMPLES}), 2) AS percent FROM {COVERAGE}")
def coverage_percent(spark, sf):
    return stats.shares(_coverage(spark, sf), samples(spark, sf).agg(F.count("*")))


@query(f"SELECT priority AS value, count(DISTINCT sample) AS samples FROM {SAMPLES} GROUP BY 1")
def property_distribution(spark, sf):
    return stats.distribution(samples(spark, sf), "priority")


@query(f"SELECT value, count(DISTINCT sample) AS samples FROM {EAV_TEXT} WHERE name = 'k' GROUP BY 1")
def property_distribution_eav(spark, sf):
    return stats.distribution(eav_text(spark, sf).where("name = 'k'"), "value")


@query(f"SELECT coalesce(CASE WHEN status <> 'P' THEN status END, 'Not Reported') AS value, count(DISTINCT sample) AS samples FROM {SAMPLES} GROUP BY 1")
def not_reported(spark, sf):
    return stats.distribution(samples(spark, sf).withColumn("status", F.when(F.col("status") != "P", F.col("status"))), "status", missing="Not Reported")


CROSS = f"(SELECT status AS x, value AS y, count(DISTINCT sample) AS samples FROM {SAMPLES} JOIN {EAV_TEXT} USING (sample) WHERE name = 'kind' GROUP BY ALL)"


@query(f"SELECT * FROM {CROSS}")
def property_crosstab(spark, sf):
    s, e = samples(spark, sf), eav_text(spark, sf)
    return stats.cross_table(stats.property_view(s, e, "status"), stats.property_view(s, e, "kind"))


@query(f"SELECT a.value AS x, b.value AS y, count(DISTINCT sample) AS samples FROM (SELECT * FROM {EAV_TEXT} WHERE name = 'kind') a JOIN (SELECT * FROM {EAV_TEXT} WHERE name = 'k') b USING (sample) WHERE sample IN (SELECT sample FROM {SAMPLES}) GROUP BY ALL")
def property_crosstab_eav(spark, sf):
    s, e = samples(spark, sf), eav_text(spark, sf)
    return stats.cross_table(stats.property_view(s, e, "kind"), stats.property_view(s, e, "k"))


@query(f"SELECT x, string_agg(y || ':' || samples::VARCHAR, ',' ORDER BY y) AS counts FROM {CROSS} GROUP BY x")
def property_crosstab_nested(spark, sf):
    return stats.nested(property_crosstab(spark, sf)).select("x", F.array_join(F.transform("counts", lambda c: F.concat(c["y"], F.lit(":"), c["samples"].cast("string"))), ",").alias("counts"))


CATALOGUE = f"(SELECT 'status' AS property, count(DISTINCT status) AS \"distinct\" FROM {SAMPLES} UNION ALL SELECT 'priority', count(DISTINCT priority) FROM {SAMPLES} UNION ALL SELECT 'day', count(DISTINCT day) FROM {SAMPLES} UNION ALL SELECT name, count(DISTINCT value) FROM {EAV_TEXT} WHERE sample IN (SELECT sample FROM {SAMPLES}) GROUP BY name)"


@query(f"SELECT * FROM {CATALOGUE}")
def property_catalogue(spark, sf):
    return stats.catalogue(samples(spark, sf), ["status", "priority", "day"], eav_text(spark, sf))


@query(f"SELECT property, \"distinct\", \"distinct\" <= 10 AS dropdown FROM {CATALOGUE} WHERE \"distinct\" > 0")
def usable_properties(spark, sf):
    return stats.usable(property_catalogue(spark, sf))


@query(f"SELECT b.bin, printf('%.2f-%.2f', lo + b.bin * 25000.0, lo + b.bin * 25000.0 + 25000.0) AS label, coalesce(n, 0) AS n FROM (SELECT lo, unnest(range(0, floor((hi - lo) / 25000.0)::BIGINT + 1)) AS bin FROM (SELECT min(price) AS lo, max(price) AS hi FROM {SAMPLES})) b LEFT JOIN (SELECT floor((price - (SELECT min(price) FROM {SAMPLES})) / 25000.0)::BIGINT AS bin, count(*) AS n FROM {SAMPLES} GROUP BY 1) c USING (bin)")
def histogram(spark, sf):
    return stats.histogram(samples(spark, sf), "price", 25000)


@query(f"SELECT reference AS organism, array_to_string(list_sort(list(DISTINCT replicon)), ',') AS accessions, array_to_string(list_sort(list(DISTINCT CASE WHEN status = 'P' THEN '-Empty-' ELSE status END)), ',') AS data_sets FROM {SAMPLES} JOIN {PLACED} USING (sample) GROUP BY 1")
def dataset_options(spark, sf):
    s = samples(spark, sf).join(placed(spark, sf), "sample").withColumn("data_set", F.when(F.col("status") != "P", F.col("status")))
    return stats.data_set_options(s, "reference", "replicon").select("organism", F.array_join("accessions", ",").alias("accessions"), F.array_join("data_sets", ",").alias("data_sets"))


@query(f"SELECT reference AS organism, count(DISTINCT sample) AS samples, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, string_agg(DISTINCT replicon, ',' ORDER BY replicon) AS replicons, printf('%d (%.2f%%)', count(DISTINCT sample), round(100.0 * count(DISTINCT sample) / (SELECT count(*) FROM {SAMPLES}), 2)) AS share FROM {SAMPLES} JOIN {PLACED} USING (sample) GROUP BY 1")
def database_report(spark, sf):
    s = samples(spark, sf)
    total = F.broadcast(s.agg(F.count("*").alias("total")))
    own = s.join(placed(spark, sf), "sample").groupBy(F.col("reference").alias("organism")).agg(F.count_distinct("sample").alias("samples"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.array_join(F.array_sort(F.collect_set("replicon")), ",").alias("replicons"))
    return own.crossJoin(total).select("organism", "samples", "first_day", "last_day", "replicons", percent_text("samples", "total").alias("share"))


@query(f"SELECT DISTINCT replicon AS value FROM {PLACED} WHERE reference = 'EUROPE'")
def distinct_values(spark, sf):
    return stats.distinct_values(placed(spark, sf).where("reference = 'EUROPE'"), "replicon")


@query(f"SELECT status, arg_min(sample, (day, sample)) AS first_sample, arg_max(sample, (day, -sample)) AS last_sample FROM {SAMPLES} WHERE day IS NOT NULL GROUP BY status")
def first_last(spark, sf):
    return samples(spark, sf).where("day IS NOT NULL").groupBy("status").agg(F.min_by("sample", F.struct("day", "sample")).alias("first_sample"), F.max_by("sample", F.struct("day", -F.col("sample"))).alias("last_sample"))


@query(f"""WITH RECURSIVE d AS (SELECT lineage AS root, lineage FROM {EDGES} WHERE lineage IN ('L3', 'L5', 'L40') UNION SELECT d.root, e.lineage FROM {EDGES} e JOIN d ON e.parent = d.lineage) SELECT * FROM d""")
def lineage_closure(spark, sf):
    e = edges(spark, sf)
    return lineage.descendants(e, e.where(F.col("lineage").isin("L3", "L5", "L40")))


@query(f"WITH RECURSIVE d AS (SELECT lineage AS root, lineage FROM {EDGES} WHERE substring(lineage, 2)::INT % 3 = 0 UNION SELECT d.root, e.lineage FROM {EDGES} e JOIN d ON e.parent = d.lineage) SELECT root, lineage FROM d")
def lineage_closure_by_labels(spark, sf):
    """The closure of a third of all lineages, by one join on their numbers."""
    e = edges(spark, sf)
    return lineage_index.descendants_by_labels(lineage_index.labelled(e), e.where("cast(substring(lineage, 2) AS INT) % 3 = 0")).select("root", "lineage")


@query(f"""WITH RECURSIVE d AS (SELECT lineage AS root, lineage FROM {EDGES} UNION SELECT d.root, e.lineage FROM {EDGES} e JOIN d ON e.parent = d.lineage),
n AS (SELECT 'L' || cust::VARCHAR AS lineage, count(*) AS n FROM {SAMPLES} GROUP BY 1)
SELECT root AS lineage, coalesce(sum(CASE WHEN root = d.lineage THEN n END), 0)::BIGINT AS own, coalesce(sum(n), 0)::BIGINT AS whole FROM d LEFT JOIN n ON n.lineage = d.lineage GROUP BY root""")
def lineage_rollup(spark, sf):
    """Samples of each lineage, and of it with all below."""
    counts = samples(spark, sf).groupBy(F.lit("ref").alias("reference"), F.concat(F.lit("L"), F.col("cust").cast("string")).alias("lineage")).agg(F.count("*").alias("n"))
    return lineage_index.rolled_up(lineage_index.labelled(edges(spark, sf)), counts).select("lineage", "own", "whole")


CHILDREN = "(SELECT 'L' || (c_custkey // 3)::VARCHAR AS lineage, string_agg('L' || c_custkey::VARCHAR, ', ' ORDER BY c_custkey) AS children, min(c_custkey) AS seq FROM customer WHERE c_custkey > 2 GROUP BY 1)"


@query("SELECT 'L' || c_custkey::VARCHAR AS lineage, CASE WHEN c_custkey > 2 THEN 'L' || (c_custkey // 3)::VARCHAR END AS parent FROM customer WHERE c_custkey > 0")
def lineage_edges_first_parent(spark, sf):
    """A table of children, in which every child has a second, later parent."""
    c = table(spark, sf, "customer").where("c_custkey > 2").select("c_custkey", F.concat(F.lit("L"), F.col("c_custkey").cast("string")).alias("child"))
    rows = c.groupBy(F.concat(F.lit("L"), F.expr("c_custkey div 3").cast("string")).alias("lineage")).agg(F.array_join(F.array_sort(F.collect_list("child")), ", ").alias("children"), F.min("c_custkey").alias("seq"))
    again = c.select(F.lit("L1").alias("lineage"), F.col("child").alias("children"), (F.col("c_custkey") + 10**9).alias("seq"))
    return lineage.edges_from_children(rows.unionByName(again), "seq")


@query("SELECT DISTINCT 'L' || (c_custkey // 2)::VARCHAR AS lineage FROM customer WHERE c_custkey % 5 = 1 AND c_custkey > 1 AND NOT (c_custkey // 2) % 5 = 1")
def lineage_orphans(spark, sf):
    return lineage.orphans(edges(spark, sf).where("cast(substring(lineage, 2) AS INT) % 5 = 1"))


@query(f"SELECT parent AS lineage, lineage AS sublineage FROM {EDGES} WHERE parent IS NOT NULL UNION ALL SELECT lineage, 'none' FROM {EDGES} WHERE parent IS NULL AND lineage NOT IN (SELECT parent FROM {EDGES} WHERE parent IS NOT NULL)")
def lineage_child_table(spark, sf):
    return lineage.child_table(edges(spark, sf))


DOTTED = "(SELECT sample, chr(65 + (cust % 5)::INT) || '.' || (cust % 7)::VARCHAR || '.' || (cust % 3)::VARCHAR AS lineage FROM " + SAMPLES + ")"
KNOWN = "(SELECT DISTINCT chr(65 + (c_custkey % 5)::INT) || '.' || (c_custkey % 7)::VARCHAR AS lineage FROM customer WHERE c_custkey % 7 < 4)"


@query(f"SELECT coalesce(k.lineage, 'Unknown') AS lineage_group, count(*) AS samples FROM {DOTTED} d LEFT JOIN {KNOWN} k ON array_to_string(string_split(d.lineage, '.')[1:2], '.') = k.lineage GROUP BY 1")
def lineage_group(spark, sf):
    dotted = lambda c, *rest: F.concat(F.char(65 + F.col(c) % 5), F.lit("."), (F.col(c) % 7).cast("string"), *rest)
    own = samples(spark, sf).select("sample", dotted("cust", F.lit("."), (F.col("cust") % 3).cast("string")).alias("lineage"))
    known = table(spark, sf, "customer").where("c_custkey % 7 < 4").select(dotted("c_custkey").alias("lineage"))
    return lineage.grouped(own, known).groupBy("lineage_group").agg(F.count("*").alias("samples"))


@query("""SELECT alias || '.' || k::VARCHAR || '.1' AS lineage, alias || '.' || k::VARCHAR AS parent FROM (SELECT 'A' || (c_custkey % 10)::VARCHAR AS alias, c_custkey AS k FROM customer)""")
def alias_parent(spark, sf):
    """Names below ten aliases, whose parents are compressed again."""
    names = table(spark, sf, "customer").select(F.concat(F.lit("A"), (F.col("c_custkey") % 10).cast("string"), F.lit("."), F.col("c_custkey").cast("string"), F.lit(".1")).alias("lineage"))
    aliases = table(spark, sf, "nation").where("n_nationkey < 10").select(F.concat(F.lit("A"), F.col("n_nationkey").cast("string")).alias("alias"), F.concat(F.lit("B.1."), F.col("n_nationkey").cast("string")).alias("prefix"))
    return lineage.alias_parents(names, aliases)


@query("SELECT 'C' || c_custkey::VARCHAR AS lineage, CASE WHEN c_custkey % 4 > 0 THEN 'C' || (c_custkey - c_custkey % 4)::VARCHAR END AS parent FROM customer")
def lineage_from_clades(spark, sf):
    """Designations: a row of sites for each clade, and one of gene `clade` that names its parent."""
    c = table(spark, sf, "customer")
    name = lambda k: F.concat(F.lit("C"), k.cast("string"))
    sites = c.select(name(F.col("c_custkey")).alias("clade"), F.lit("nuc").alias("gene"), F.col("c_custkey").cast("string").alias("site"), F.col("c_custkey").alias("seq"))
    parents = c.where("c_custkey % 4 > 0").select(name(F.col("c_custkey")).alias("clade"), F.lit("clade").alias("gene"), name(F.col("c_custkey") - F.col("c_custkey") % 4).alias("site"), F.col("c_custkey").alias("seq"))
    return lineage.edges_from_pairs(lineage.pairs_from_clades(sites.unionByName(parents)))


@query("SELECT 'J' || c_custkey::VARCHAR AS lineage, CASE WHEN c_custkey % 3 > 0 THEN 'J' || (c_custkey // 3)::VARCHAR END AS parent FROM customer")
def lineage_from_json(spark, sf):
    """Pairs with words for no parent; JSON documents hold them."""
    c = table(spark, sf, "customer").select("c_custkey", F.to_json(F.struct(F.concat(F.lit("J"), F.col("c_custkey").cast("string")).alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("J"), F.expr("c_custkey div 3").cast("string"))).otherwise("None").alias("parent"))).alias("doc"))
    pairs = c.select(F.from_json("doc", "name string, parent string").alias("x"), F.col("c_custkey").alias("seq")).select(F.col("x.name").alias("lineage"), "x.parent", "seq")
    return lineage.edges_from_pairs(pairs)


@query("SELECT 'N' || c_custkey::VARCHAR AS lineage FROM customer WHERE c_custkey % 6 <> 0")
def lineage_from_notes(spark, sf):
    from ..sources.readers import lineage_notes

    star = F.when(F.col("c_custkey") % 6 == 0, "*").otherwise("")
    lines = table(spark, sf, "customer").select(F.concat(star, F.lit("N"), F.col("c_custkey").cast("string"), F.lit(" alias of x\tnote")).alias("value"))
    return lineage_notes(lines)


@query("SELECT 'L' || c_custkey::VARCHAR AS lineage, NULL::VARCHAR AS parent, 'ref' || (c_custkey % 3)::VARCHAR AS reference FROM customer WHERE c_custkey % 3 <> 1 UNION ALL SELECT 'X' || n_nationkey::VARCHAR, 'X0', 'ref1' FROM nation")
def lineage_replace_reference(spark, sf):
    own = edges(spark, sf).withColumns({"parent": F.lit(None).cast("string"), "reference": F.concat(F.lit("ref"), (F.expr("cast(substring(lineage, 2) AS INT)") % 3).cast("string"))})
    new = table(spark, sf, "nation").select(F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("lineage"), F.lit("X0").alias("parent"))
    return lineage.replaced(own, new, "ref1")


@query(f"SELECT sample, max(value) FILTER (name = 'k') AS k, max(value) FILTER (name = 'kind') AS kind, max(value) FILTER (name = 'score') AS score FROM {EAV_TEXT} GROUP BY sample")
def eav_to_wide(spark, sf):
    return reshape.to_wide(eav_text(spark, sf), ["k", "kind", "score"])


@query("SELECT o_orderkey AS sample, 'price' AS name, NULL::BIGINT AS value_integer, o_totalprice AS value_float, NULL::VARCHAR AS value_varchar, NULL::VARCHAR AS value_date FROM orders UNION ALL SELECT o_orderkey, 'cust', o_custkey, NULL, NULL, NULL FROM orders UNION ALL SELECT o_orderkey, 'status', NULL, NULL, o_orderstatus, NULL FROM orders UNION ALL SELECT o_orderkey, 'day', NULL, NULL, NULL, o_orderdate::DATE::VARCHAR FROM orders")
def wide_to_eav(spark, sf):
    out = reshape.to_long(samples(spark, sf), {"price": "value_float", "cust": "value_integer", "status": "value_varchar", "day": "value_date"})
    return out.select("sample", "name", "value_integer", "value_float", "value_varchar", F.col("value_date").cast("string").alias("value_date"))


@query("SELECT r_name AS gene, string_agg(n_name || '[' || parts || ']', ' ' ORDER BY n_name) AS cds FROM (SELECT n_regionkey, n_name, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS parts FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL) JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def reference_tree(spark, sf):
    """Regions as genes, nations as coding sequences, suppliers as their segments."""
    n, r, s = (table(spark, sf, t) for t in ("nation", "region", "supplier"))
    cds = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("gene"), F.col("n_name").alias("cds"))
    segments = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("cds"), F.col("s_suppkey").cast("int").alias("order"), F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit(1).alias("strand"))
    tree = reshape.reference_tree(r.select(F.col("r_name").alias("gene")), cds.join(segments.select("cds").distinct(), "cds", "left_semi"), segments)
    shown = F.transform("cds", lambda c: F.concat(c["cds"], F.lit("["), F.array_join(F.transform(c["segments"], lambda x: x["order"].cast("string")), ","), F.lit("]")))
    return tree.where("cds IS NOT NULL").select("gene", F.array_join(shown, " ").alias("cds"))


def _cube_facts(samples_, placed_, eav_):
    """What a cube counts: samples where they belong, and the kind of their events."""
    where = samples_.join(placed_, "sample", "left").withColumn("monday", week_start("day"))
    return [(where, [(), ("monday",), ("priority",), ("status",), ("status", "priority"), ("reference", "replicon")]), (eav_.where("name = 'kind'"), [("name", "value")])]


def _cube(spark, sf):
    s = samples(spark, sf)
    return bitmap_cube.build(s, _cube_facts(s, placed(spark, sf), eav_text(spark, sf)))


@query(f"""SELECT 'total' AS statistic, NULL AS x, NULL AS y, count(DISTINCT sample) AS samples FROM {SAMPLES}
    UNION ALL SELECT 'week', {LABEL}, NULL, samples FROM {WEEKS}
    UNION ALL SELECT 'month', strftime({MONDAY}, '%Y-%m') AS x, NULL, count(DISTINCT sample) FROM {SAMPLES} WHERE day IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'priority', priority, NULL, count(DISTINCT sample) FROM {SAMPLES} GROUP BY 2
    UNION ALL SELECT 'status and priority', status, priority, count(DISTINCT sample) FROM {SAMPLES} GROUP BY 2, 3
    UNION ALL SELECT 'region', reference, NULL, count(DISTINCT sample) FROM {PLACED} GROUP BY 2
    UNION ALL SELECT 'kind', value, NULL, count(DISTINCT sample) FROM {EAV_TEXT} WHERE name = 'kind' AND sample IN (SELECT sample FROM {SAMPLES}) GROUP BY 2
    UNION ALL SELECT 'coverage', 'status', NULL, count(*) FROM {SAMPLES} WHERE trim(status) <> ''
    UNION ALL SELECT 'values', 'status', NULL, count(DISTINCT status) FROM {SAMPLES}""")
def statistics_by_cube(spark, sf):
    """Statistics of several kinds from the cells of one cube; months and regions are rolled up."""
    c = _cube(spark, sf)
    row = lambda name, df, x, y=None: df.select(F.lit(name).alias("statistic"), x.alias("x"), (F.lit(None).cast("string") if y is None else y).alias("y"), F.col(df.columns[-1]).alias("samples"))
    months = bitmap_cube.counts(c, "monday", labels={"monday": lambda m: F.substring(m, 1, 7)}).where("monday IS NOT NULL").select("monday", "samples")
    crossed = bitmap_cube.cross_table(c, "status", "priority")
    parts = [row("week", bitmap_cube.per_week(c), F.col("week")), row("month", months, F.col("monday")), row("priority", bitmap_cube.distribution(c, "priority"), F.col("value")), row("status and priority", crossed, F.col("x"), F.col("y")),
             row("region", bitmap_cube.distribution(c, "reference"), F.col("value")), row("kind", bitmap_cube.distribution(c, "value"), F.col("value")), row("coverage", bitmap_cube.coverage(c, ["status"]), F.col("property")), row("values", bitmap_cube.catalogue(c, ["status"]), F.col("property"))]
    out = row("total", bitmap_cube.totals(c).select("samples"), F.lit(None).cast("string"))
    for p in parts:
        out = out.unionByName(p)
    return out


@query(ORACLE_SQL["database_report"])
def database_report_by_cube(spark, sf):
    return bitmap_cube.report(_cube(spark, sf)).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query(f"SELECT reference, status, count(DISTINCT sample) AS samples, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day FROM {SAMPLES} LEFT JOIN {PLACED} USING (sample) GROUP BY 1, 2")
def cube_in_batches(spark, sf):
    """A cube to which a third of the samples is added at a time, with a part of those that it has."""
    s, p, cube = samples(spark, sf), placed(spark, sf), None
    for part in range(3):
        own = s.where((F.col("sample") % 3 == part) | ((F.col("sample") % 3 < part) & (F.col("sample") % 7 == 0)))
        facts = [(own.join(p, "sample", "left"), [("reference", "status"), ("priority",)])]
        cube = bitmap_cube.build(own, facts) if cube is None else bitmap_cube.added(cube, own, facts)
    return bitmap_cube.counts(cube, "reference", "status").select("reference", "status", "samples", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"))
