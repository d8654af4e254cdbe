"""Queries of filter trees, properties, notation and matching."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.notation import matched, matched_by_rarest, resolved
from ..functions.scalars import aa_label, annotation_text, nt_label, rendered_profile
from ..operators import bitmap_index, lineage_index, match, paging, reshape, stats
from ..operators import filters as f
from ..operators.filters import Tables
from ..operators.scale import existing, shared_dir
from .bindings import CALLS, EAV, EAV_TEXT, EDGES, ORACLE_SQL, PLACED, SAMPLES, calls, eav, eav_text, edges, nt, query, samples, table, tables

HAS = f"s.sample IN (SELECT sample FROM {CALLS} WHERE {{}})"


def _has(where: str) -> str:
    return HAS.format(where)


A, R, N = (f'"end" {op} AND ref = \'F\' AND alt {alt}' for op, alt in (("= 100", "= 'A'"), ("= 200", "IN ('A', 'G', 'R')"), ("= 300", "= 'N'")))
KEYS = f"SELECT s.sample FROM {SAMPLES} s WHERE "


def _matching(spark, sf, tree, reference=None, **more):
    return f.matching(tables(spark, sf, **more), tree, reference).select("sample")


CLOSE = f"(SELECT sample, ref, alt, \"end\" % 20 + 1 AS \"end\" FROM {CALLS})"
AT = "s.sample IN (SELECT sample FROM " + CLOSE + " WHERE \"end\" = {} AND ref = '{}' AND alt IN ({}))"


@query(KEYS + AT.format(10, "F", "'A'") + " AND " + AT.format(11, "O", "'A', 'G', 'R'") + " OR " + AT.format(12, "F", "'N'") + " AND " + AT.format(13, "O", "'N'"))
def match_and(spark, sf):
    """Positions are taken within 20 here, so that samples carry two of them."""
    t = tables(spark, sf)
    t.nt = t.nt.withColumn("end", F.col("end") % 20 + 1).withColumn("start", F.col("end") - 1)
    return f.matching(t, {"orFilter": [{"andFilter": [nt(10, "A"), nt(11, "R", "O")]}, {"andFilter": [nt(12, "n"), nt(13, "n", "O")]}]}).select("sample")


@query(KEYS + " OR ".join(_has(x) for x in (A, R, N)))
def match_or(spark, sf):
    return _matching(spark, sf, {"orFilter": [nt(100, "A"), nt(200, "R"), nt(300, "n")]})


@query(KEYS + "NOT " + _has("\"end\" = 200 AND ref = 'F' AND alt IN ('A', 'C', 'G', 'T', 'R', 'Y', 'S', 'W', 'K', 'M', 'B', 'D', 'H', 'V', 'N')"))
def match_exclude(spark, sf):
    return _matching(spark, sf, nt(200, "N", exclude=True))


def _equals(name: str, value: str, **more) -> dict:
    return {"label": "Property", "property_name": name, "filter_type": "exact", "value": value, **more}


NESTED = {**_equals("status", "F"), "andFilter": [{"orFilter": [nt(100, "A"), nt(200, "R", exclude=True)]}], "orFilter": [{"andFilter": [nt(300, "n"), _equals("priority", "1-URGENT", exclude=True)]}]}


@query(KEYS + f"(s.status = 'F' AND ({_has(A)} OR NOT {_has(R)})) OR ({_has(N)} AND NOT s.priority = '1-URGENT')")
def match_nested_tree(spark, sf):
    return _matching(spark, sf, NESTED)


@query(ORACLE_SQL["match_nested_tree"])
def match_nested_tree_by_index(spark, sf):
    """The same tree by bitmaps."""
    t = tables(spark, sf)
    return bitmap_index.matching(t, bitmap_index.build(t), NESTED).select("sample")


@query(ORACLE_SQL["match_and"])
def match_and_by_updated_index(spark, sf):
    """An index of two thirds of the samples, to which the others come as a batch; one sample in five comes again with it, having had no calls before."""
    t = tables(spark, sf)
    t.nt = t.nt.withColumn("end", F.col("end") % 20 + 1).withColumn("start", F.col("end") - 1)
    part = lambda some, calls: Tables(samples=t.samples.where(some), nt=t.nt.where(calls))
    index = bitmap_index.build(part("sample % 3 < 2", "sample % 3 < 2 AND sample % 5 > 0"))
    late = "sample % 3 = 2 OR sample % 5 = 0"
    index = bitmap_index.updated(index, part(late, late))
    return bitmap_index.matching(t, index, {"orFilter": [{"andFilter": [nt(10, "A"), nt(11, "R", "O")]}, {"andFilter": [nt(12, "n"), nt(13, "n", "O")]}]}).select("sample")


@query(KEYS + f"({_has(A)} AND NOT {_has(R)}) OR ({_has(N)})")
def match_profile_sets(spark, sf):
    return _matching(spark, sf, f.profile_tree([["F100A", "^F200R"], ["F300n"]]))


@query(KEYS + f"NOT ({_has(A)} AND {_has(R)})")
def match_profile_exclude(spark, sf):
    return _matching(spark, sf, f.profile_tree([["F100A", "F200R"]], exclude=True))


@query(KEYS + _has("gene = 'g1' AND replicon = 'rep1' AND \"end\" BETWEEN 100 AND 100 AND ref = 'F' AND alt IN ('A')") + " OR " + _has("gene = 'g2' AND \"end\" = 150 AND ref = 'O' AND alt IN ('R')"))
def match_aa(spark, sf):
    return _matching(spark, sf, f.profile_tree([["rep1:g1:F100A"], ["g2:O150R"]], {"g0", "g1", "g2"}, {"rep0", "rep1"}))


# Deletions and insertions: calls of flag N stand for deletions, those of flag R get a longer alt.
SHAPED = f"(SELECT * REPLACE (CASE WHEN alt = 'N' THEN '' WHEN alt = 'R' THEN 'RA' ELSE alt END AS alt) FROM {CALLS})"


def _shaped(spark, sf):
    return calls(spark, sf).withColumn("alt", F.when(F.col("alt") == "N", "").when(F.col("alt") == "R", "RA").otherwise(F.col("alt")))


@query(f"SELECT s.sample FROM {SAMPLES} s WHERE s.sample IN (SELECT sample FROM {SHAPED} WHERE \"end\" = 50 AND start = 49 AND alt = '') OR s.sample IN (SELECT sample FROM {SHAPED} WHERE \"end\" = 60 AND ref = 'O' AND alt = 'RA') OR s.sample IN (SELECT sample FROM {SHAPED} WHERE gene = 'g1' AND \"end\" = 70 AND start = 69 AND alt = '') OR s.sample IN (SELECT sample FROM {SHAPED} WHERE gene = 'g0' AND \"end\" = 80 AND ref = 'F' AND alt = 'RA')")
def match_indels(spark, sf):
    shaped = _shaped(spark, sf)
    t = f.Tables(samples=samples(spark, sf), nt=shaped, aa=shaped)
    return f.matching(t, f.profile_tree([["del:50"], ["O60RA"], ["g1:del:70"], ["g0:F80RA"]], {"g0", "g1", "g2"})).select("sample")


WATCH_SQL = f"""WITH w AS (SELECT p_partkey AS profile, p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_partkey > 0)
SELECT DISTINCT 'P' || w.profile::VARCHAR AS profile, x.sample FROM w JOIN {CALLS} x ON x."end" = w.a AND x.ref = 'F' AND x.alt = 'A' JOIN {CALLS} y ON y.sample = x.sample AND y."end" = w.b AND y.ref = 'O' AND y.alt IN ('A', 'G', 'R')"""


@query(WATCH_SQL)
def watchlist_batch_match(spark, sf):
    """A watch-list of two mutations for each part, matched against all calls at once."""
    p = table(spark, sf, "part").where("p_partkey > 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("profile"), "p_partkey")
    notes = p.select("profile", F.explode(F.array(F.concat(F.lit("rep:F"), F.col("p_partkey").cast("string"), F.lit("A")), F.concat(F.lit("O"), (F.col("p_partkey") + 1).cast("string"), F.lit("R")))).alias("notation"))
    found = resolved(notes, spark.createDataFrame([], "gene string"), spark.createDataFrame([("rep", "ref")], "replicon string, reference string"))
    facts = calls(spark, sf).withColumns({"kind": F.lit("nt"), "replicon": F.lit("rep"), "gene": F.lit(None).cast("string")})
    return matched(found, facts)


@query(f"""WITH w AS (SELECT p_partkey AS profile, p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_partkey > 0)
SELECT DISTINCT 'P' || w.profile::VARCHAR AS profile, x.sample FROM w JOIN {CALLS} x ON x."end" = w.a AND x.ref = 'F' AND x.alt IN ('A', 'G', 'R')
WHERE x.sample IN (SELECT sample FROM {SAMPLES}) AND NOT EXISTS (SELECT 1 FROM {CALLS} y WHERE y.sample = x.sample AND y."end" = w.b AND y.ref = 'F' AND y.alt = 'N')""")
def watchlist_by_rarest(spark, sf):
    """A profile for each part: a mutation that all samples carry, a rare one of several alts, and one that must not be there."""
    number = lambda by: (F.col("p_partkey") + by).cast("string")
    p = table(spark, sf, "part").where("p_partkey > 0").select(F.concat(F.lit("P"), number(0)).alias("profile"), F.explode(F.array(F.lit("rep:C900000000T"), F.concat(F.lit("F"), number(0), F.lit("R")), F.concat(F.lit("^F"), number(1), F.lit("n")))).alias("notation"))
    found = resolved(p, spark.createDataFrame([], "gene string"), spark.createDataFrame([("rep", "ref")], "replicon string, reference string"))
    own = calls(spark, sf).select("sample", "start", "end", "ref", "alt")
    all_have = samples(spark, sf).select("sample", F.lit(899_999_999).alias("start"), F.lit(900_000_000).alias("end"), F.lit("C").alias("ref"), F.lit("T").alias("alt"))
    facts = own.unionByName(all_have).withColumns({"kind": F.lit("nt"), "replicon": F.lit("rep"), "gene": F.lit(None).cast("string")})
    return matched_by_rarest(found, facts)


def _paged(spark, sf, by):
    at = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    paging.write_pages(samples(spark, sf).select("sample", "price", "status"), at, by, "sample", rows_a_range=400)
    return paging.open_pages(spark, at)


@query(f"SELECT sample, price, status, (SELECT count(*) FROM {SAMPLES}) AS total FROM {SAMPLES} ORDER BY price DESC NULLS FIRST, sample LIMIT 250 OFFSET 900")
def page_with_total(spark, sf):
    """A page behind 900 rows and the number of all rows, from the ranges it lies in."""
    return _paged(spark, sf, "-price").page(250, 900, with_total=True)


@query(f"SELECT sample, price, status FROM {SAMPLES} WHERE price > 150000 OR price IS NULL ORDER BY price NULLS LAST, sample LIMIT 300")
def page_after_key(spark, sf):
    """The page that follows a price."""
    return _paged(spark, sf, "price").after(150000, 2**62, 300)


def _property(name, lookup, value, exclude=False):
    return lambda spark, sf: _matching(spark, sf, {"label": "Property", "property_name": name, "filter_type": lookup, "value": value, "exclude": exclude})


for _name, _args, _where in (
    ("exact", ("status", "exact", "P"), "status = 'P'"),
    ("iexact", ("priority", "iexact", "5-low"), "lower(priority) = '5-low'"),
    ("contains", ("priority", "contains", "%URG%"), "contains(priority, 'URG')"),
    ("icontains", ("priority", "icontains", "spec"), "contains(lower(priority), 'spec')"),
    ("range", ("price", "range", [1000.0, 50000.0]), "price BETWEEN 1000 AND 50000"),
    ("in", ("status", "in", "O, F"), "status IN ('O', 'F')"),
    ("compare", ("price", "gte", 400000.0), "price >= 400000"),
    ("startswith", ("priority", "startswith", "1-"), "priority LIKE '1-%'"),
    ("iendswith", ("priority", "iendswith", "gh"), "lower(priority) LIKE '%gh'"),
    ("regex", ("priority", "regex", "^[12]-"), "regexp_matches(priority, '^[12]-')"),
    ("iregex", ("priority", "iregex", "^4-not"), "regexp_matches(priority, '(?i)^4-not')"),
    ("isnull", ("day", "isnull", True), "day IS NULL"),
    ("datepart", ("day", "year__gte", 1998), "year(day) >= 1998"),
    ("month", ("day", "month", 3), "month(day) = 3"),
    ("exclude", ("status", "exact", "P", True), "NOT coalesce(status = 'P', false)"),
):
    _f = _property(*_args)
    _f.__name__ = f"property_lookup_{_name}"
    query(KEYS + _where)(_f)

EV = "(SELECT event_id AS sample, user_id FROM events)"


def _events(spark, sf):
    return f.Tables(samples=table(spark, sf, "events").select(F.col("event_id").alias("sample"), "user_id"), eav=eav(spark, sf), eav_columns={"k": "value_integer", "score": "value_float", "kind": "value_varchar"})


@query(f"SELECT sample FROM {EV} WHERE sample IN (SELECT sample FROM {EAV} WHERE name = 'k' AND value_integer BETWEEN 10 AND 20)")
def property_eav_filter(spark, sf):
    return f.matching(_events(spark, sf), f.property_tree("k", ["10:20"], "integer")).select("sample")


@query(f"SELECT sample FROM {EV} WHERE sample IN (SELECT sample FROM {EAV} WHERE name = 'k' AND value_integer > 50) AND sample IN (SELECT sample FROM {EAV} WHERE name = 'kind' AND value_varchar LIKE 'cl%')")
def property_eav_two_and(spark, sf):
    return f.matching(_events(spark, sf), {"andFilter": [f.property_tree("k", [">50"], "integer"), f.property_tree("kind", ["cl%"], "varchar")]}).select("sample")


@query(f"SELECT sample FROM {EV} WHERE sample IN (SELECT sample FROM {EAV} WHERE name = 'k' AND value_integer = 0) OR NOT sample IN (SELECT sample FROM {EAV} WHERE name = 'k' AND value_integer <> 7 AND value_integer <= 90)")
def property_mini_language(spark, sf):
    t = _events(spark, sf)
    return f.matching(t, {"orFilter": [f.property_tree("k", ["=0"], "integer"), {"andFilter": [f.property_tree("k", ["^<=90", "7"], "integer")]}]}).select("sample")


@query("SELECT doc_id AS sample FROM documents WHERE n_chars BETWEEN 1000 AND 2000")
def length_filter(spark, sf):
    d = table(spark, sf, "documents")
    t = f.Tables(samples=d.select(F.col("doc_id").alias("sample")), sequences=d.select(F.col("doc_id").alias("sample"), F.col("n_chars").alias("length")))
    return f.matching(t, {"label": "Property", "property_name": "length", "filter_type": "range", "value": "1000,2000".split(",")}).select("sample")


@query(f"SELECT s.sample FROM {SAMPLES} s WHERE s.sample IN (SELECT sample FROM {PLACED} WHERE reference = 'ASIA') AND s.status = 'F' AND NOT s.sample IN (SELECT sample FROM {PLACED} WHERE replicon = 'NATION_3')")
def reference_scope(spark, sf):
    return _matching(spark, sf, {"andFilter": [{"label": "Property", "property_name": "status", "filter_type": "exact", "value": "F"}, {"label": "Replicon", "accession": "NATION_3", "exclude": True}, {"label": "Reference", "accession": "ASIA"}]}, "ASIA")


NOTES = "(SELECT l_orderkey AS sample, l_partkey AS mutation, p_type AS ontology, p_brand AS impact FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _notes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("ontology"), F.col("p_brand").alias("impact"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_partkey").alias("mutation")).join(p, F.col("mutation") == F.col("p_partkey")).drop("p_partkey")


@query(f"{KEYS} s.sample IN (SELECT sample FROM {NOTES} WHERE ontology = 'ECONOMY') AND s.sample IN (SELECT sample FROM {NOTES} WHERE impact = 'Brand#2')")
def annotation_filter(spark, sf):
    return _matching(spark, sf, {"label": "Annotation", "ontology": "ECONOMY", "impact": "Brand#2"}, annotations=_notes(spark, sf))


@query(f"{KEYS} s.sample IN (SELECT sample FROM {NOTES} WHERE ontology = 'ECONOMY' AND impact = 'Brand#2')")
def annotation_same_mutation(spark, sf):
    return _matching(spark, sf, {"label": "Annotation", "ontology": "ECONOMY", "impact": "Brand#2", "same_mutation": True}, annotations=_notes(spark, sf))


@query(f"""WITH RECURSIVE d AS (SELECT lineage FROM {EDGES} WHERE lineage = 'L5' UNION SELECT e.lineage FROM {EDGES} e JOIN d ON e.parent = d.lineage)
SELECT sample FROM {SAMPLES} WHERE 'L' || cust::VARCHAR IN (SELECT lineage FROM d)""")
def lineage_filter(spark, sf):
    t = f.Tables(samples=samples(spark, sf).withColumn("lineage", F.concat(F.lit("L"), F.col("cust").cast("string"))), lineages=edges(spark, sf))
    return f.matching(t, {"label": "Sublineages", "lineageList": ["l5"], "includeSublineages": True}, "ref").select("sample")


@query(f"""WITH RECURSIVE d AS (SELECT lineage FROM {EDGES} WHERE lineage IN ('L5', 'L6', 'L11', 'L40') UNION SELECT e.lineage FROM {EDGES} e JOIN d ON e.parent = d.lineage)
SELECT sample FROM {SAMPLES} WHERE ('L' || cust::VARCHAR IN (SELECT lineage FROM d) AND status = 'F')""")
def lineage_filter_by_labels(spark, sf):
    """Lineages as ranges of numbers, on samples that are stored along them."""
    e, at = edges(spark, sf), f"{shared_dir(spark)}/located-{uuid.uuid4().hex}"
    lineage_index.write_labels(e, f"{at}/labels")
    labels = spark.read.parquet(f"{at}/labels")
    own = samples(spark, sf).withColumn("lineage", F.concat(F.lit("L"), F.col("cust").cast("string")))
    lineage_index.write_located(lineage_index.located(own, labels, "ref"), f"{at}/samples")
    t = f.Tables(samples=spark.read.parquet(f"{at}/samples"), lineages=e, labels=labels)
    return f.matching(t, {"label": "Sublineages", "lineageList": ["l5", "L6", "L11", "l40"], "andFilter": [{"label": "Property", "property_name": "status", "value": "F"}]}, "ref").select("sample")


@query(f"""WITH RECURSIVE d AS (SELECT lineage FROM {EDGES} WHERE lineage = 'L40' UNION SELECT e.lineage FROM {EDGES} e JOIN d ON e.parent = d.lineage)
SELECT s.sample FROM {SAMPLES} s WHERE ({_has(A)} AND NOT {_has("gene = 'g1' AND \"end\" = 200 AND ref = 'F' AND alt = 'R'")} AND status = 'F') OR ('L' || cust::VARCHAR IN (SELECT lineage FROM d) AND NOT ({_has(A)} AND {_has(R)}))""")
def match_reference_tree(spark, sf):
    """Profiles as users type them and lineages, in one tree."""
    t = tables(spark, sf, lineages=edges(spark, sf), genes=frozenset({"g0", "g1", "g2"}), replicons=frozenset({"rep0", "rep1"}))
    t.samples = t.samples.withColumn("lineage", F.concat(F.lit("L"), F.col("cust").cast("string")))
    profile = {"label": "DNA/AA Profile", "value": " F100A; ^g1:F200R,"}
    lineages = {"label": "Lineages", "lineageList": "l40", "andFilter": [{"label": "DNA/AA Profile", "value": "F100A F200R", "exclude": True}]}
    return f.matching(t, profile | {"andFilter": [{"label": "Property", "property_name": "status", "value": "F"}], "orFilter": [lineages]}, None).select("sample")


@query(f"SELECT count(*) AS samples FROM {SAMPLES} s WHERE {_has(A)} OR status = 'P'")
def filtered_count(spark, sf):
    return _matching(spark, sf, {"orFilter": [nt(100, "A"), {"label": "Property", "property_name": "status", "filter_type": "exact", "value": "P"}]}).agg(F.count("*").alias("samples"))


@query(f"SELECT sample, status FROM {SAMPLES} WHERE sample IN (SELECT event_id * 3 FROM events WHERE event_type = 'click')")
def sample_list(spark, sf):
    """A list of names that is itself a table."""
    ids = table(spark, sf, "events").where("event_type = 'click'").select((F.col("event_id") * 3).alias("sample"))
    return samples(spark, sf).join(ids, "sample", "left_semi").select("sample", "status")


@query(f"SELECT sample FROM {SAMPLES} WHERE CASE WHEN status = 'O' THEN '' ELSE status END IN ('', 'P')")
def data_set_selection(spark, sf):
    s = samples(spark, sf).withColumn("data_set", F.when(F.col("status") == "O", "").otherwise(F.col("status")))
    return s.where(f.in_data_sets(F.col("data_set"), ["-Empty-", "P"])).select("sample")


@query(f"SELECT sample, \"end\", alt FROM {CALLS} WHERE alt <> 'N'")
def nx_filter(spark, sf):
    return calls(spark, sf).where(f.informative(nt_alt=F.col("alt"))).select("sample", "end", "alt")


@query("SELECT o_orderkey, o_orderstatus FROM orders SEMI JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49) x ON o_orderkey = l_orderkey")
def id_set_filter(spark, sf):
    ids = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query(f"SELECT sample, count(*) AS calls FROM (SELECT *, max(quantity) OVER (PARTITION BY sample) AS longest FROM {CALLS}) WHERE longest <= 40 GROUP BY sample")
def quality_gate(spark, sf):
    """Samples without a call whose reference stretch is over the limit; stretches are as long as the quantity."""
    own = calls(spark, sf).withColumn("ref", F.repeat(F.lit("A"), F.col("quantity")))
    return f.quality_gate(own, longest=40).groupBy("sample").agg(F.count("*").alias("calls"))


@query(f"SELECT s.sample, x.replicon, count(x.line) AS calls, count(DISTINCT p.p_type) AS notes FROM {SAMPLES} s LEFT JOIN {CALLS} x USING (sample) LEFT JOIN part p ON x.\"end\" = p.p_partkey AND p.p_size < 20 WHERE s.status = 'P' GROUP BY ALL")
def profile_assembly(spark, sf):
    notes = table(spark, sf, "part").where("p_size < 20").select(F.col("p_partkey").cast("int").alias("mutation"), F.col("p_type").alias("note"))
    own = match.assembled(samples(spark, sf).where("status = 'P'"), calls(spark, sf).withColumn("mutation", F.col("end")), notes)
    return own.groupBy("sample", "replicon").agg(F.count("line").alias("calls"), F.count_distinct("note").alias("notes"))


LABELS = "CASE WHEN alt = '' THEN 'del:' || \"end\"::VARCHAR ELSE ref || \"end\"::VARCHAR || alt END"
PROFILE_ROWS = f"""(SELECT sample, replicon, label, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS notes FROM (SELECT x.sample, x.replicon, {LABELS} AS label, p.p_type FROM {SHAPED} x LEFT JOIN part p ON x."end" = p.p_partkey AND p.p_size < 20) GROUP BY ALL)"""


def _profiles(spark, sf):
    notes = table(spark, sf, "part").where("p_size < 20").select(F.col("p_partkey").cast("int").alias("end"), F.col("p_type").alias("annotation"))
    return reshape.profiles(_shaped(spark, sf).withColumn("label", nt_label()).join(notes, "end", "left"))


@query(f"SELECT sample, string_agg(part, ', ' ORDER BY replicon) AS profile FROM (SELECT sample, replicon, replicon || '(' || string_agg(label || coalesce('(' || notes || ')', ''), ', ' ORDER BY label) || ')' AS part FROM {PROFILE_ROWS} GROUP BY sample, replicon) GROUP BY sample")
def profile_render(spark, sf):
    return _profiles(spark, sf).select("sample", rendered_profile("profile").alias("profile"))


@query(f"SELECT sample, count(DISTINCT replicon) AS replicons, count(*) AS labels, max(CASE WHEN replicon = 'rep1' THEN 1 ELSE 0 END) = 1 AS has_rep1 FROM {PROFILE_ROWS} GROUP BY sample")
def profile_maps(spark, sf):
    own = _profiles(spark, sf).withColumn("map", reshape.profile_map(F.col("profile")))
    labels = F.aggregate(F.map_values("map"), F.lit(0), lambda a, m: a + F.size(m))
    return own.select("sample", F.size("map").alias("replicons"), labels.alias("labels"), F.map_contains_key("map", "rep1").alias("has_rep1"))


@query(f"SELECT sample, gene || ':' || {LABELS} AS label, trim(p_type || ' ' || p_brand) AS annotation FROM {SHAPED} JOIN part ON \"end\" = p_partkey")
def aa_labels(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("end"), "p_type", "p_brand")
    return _shaped(spark, sf).join(p, "end").select("sample", aa_label().alias("label"), annotation_text("p_type", "p_brand").alias("annotation"))


@query(f"SELECT sample, string_agg(name || '=' || value, ', ' ORDER BY name, value) AS properties FROM (SELECT o_orderkey AS sample, 'status' AS name, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders UNION ALL SELECT sample, name, value FROM {EAV_TEXT} WHERE sample IN (SELECT o_orderkey FROM orders) UNION ALL SELECT l_orderkey, 'lengths', string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1) GROUP BY sample")
def property_list(spark, sf):
    s = samples(spark, sf)
    lengths = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("length"))
    own = reshape.property_list(s, ["status", "priority"], existing(eav_text(spark, sf), s, ["sample"], "left_semi"), existing(lengths, s, ["sample"], "left_semi"))
    return own.select("sample", F.array_join(F.transform("properties", lambda p: F.concat(p["name"], F.lit("="), p["value"])), ", ").alias("properties"))


@query(f"SELECT sample, replicon, string_agg(\"end\"::VARCHAR || alt, ',' ORDER BY \"end\", ref, alt) AS calls FROM {CALLS} WHERE alt <> 'N' GROUP BY ALL")
def call_lists(spark, sf):
    own = match.call_lists(samples(spark, sf), calls(spark, sf))
    return own.select("sample", "replicon", F.array_join(F.transform("calls", lambda c: F.concat(c["end"].cast("string"), c["alt"])), ",").alias("calls"))


@query(f"SELECT sample, row_number() OVER (ORDER BY day DESC NULLS FIRST, sample) AS place FROM {SAMPLES} ORDER BY day DESC NULLS FIRST, sample LIMIT 50 OFFSET 100")
def page(spark, sf):
    """The third page of 50, newest first, with places counted on."""
    from pyspark.sql.window import Window

    rows = match.page(match.ordered(samples(spark, sf), "-day"), 50, 100)
    return rows.select("sample", (F.row_number().over(Window.orderBy(F.desc_nulls_first("day"), "sample")) + 100).alias("place"))


@query(f"SELECT s.sample FROM (SELECT event_id AS sample FROM events) s LEFT JOIN (SELECT sample, value_integer AS v FROM {EAV} WHERE name = 'k') e USING (sample) ORDER BY v DESC NULLS FIRST, s.sample LIMIT 40")
def order_by_property(spark, sf):
    values = eav(spark, sf).select("sample", "name", F.col("value_integer").alias("value"))
    return match.page(match.ordered_by_property(table(spark, sf, "events").select(F.col("event_id").alias("sample")), values, "k", True), 40).select("sample")


@query("SELECT o_orderkey AS sample FROM orders ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey LIMIT 100")
def sample_n(spark, sf):
    return match.subset(samples(spark, sf).select("sample"), 100, "sample")


@query("SELECT p_name, dense_rank() OVER (ORDER BY k, p_name) AS natural_rank FROM (SELECT DISTINCT p_name, regexp_extract(p_name, '[^0-9]*') || lpad(regexp_extract(p_name, '[0-9]+'), 12, '0') AS k FROM (SELECT 'item' || p_size::VARCHAR AS p_name FROM part))")
def natural_sort(spark, sf):
    return stats.naturally(table(spark, sf, "part").select(F.concat(F.lit("item"), F.col("p_size").cast("string")).alias("p_name")), "p_name").distinct()


@query("SELECT w.k, o.o_orderstatus FROM (SELECT event_id * 7 AS k FROM events) w LEFT JOIN orders o ON w.k = o.o_orderkey")
def lookup_with_missing(spark, sf):
    wanted = table(spark, sf, "events").select((F.col("event_id") * 7).alias("k"))
    return match.looked_up(wanted, table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus"), "k")


@query("SELECT DISTINCT event_id * 7 AS k FROM events WHERE event_id * 7 NOT IN (SELECT o_orderkey FROM orders)")
def missing_names(spark, sf):
    return match.missing(table(spark, sf, "events").select((F.col("event_id") * 7).alias("k")), table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), "k")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM events WHERE event_id = l_orderkey AND user_id % 7 + 1 = l_linenumber)")
def pair_lookup(spark, sf):
    wanted = table(spark, sf, "events").select(F.col("event_id").alias("l_orderkey"), (F.col("user_id") % 7 + 1).cast("int").alias("l_linenumber"))
    return match.pairs_found(wanted, table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query(f"SELECT s.sample, x.line AS alignment_id, x.replicon AS sequence_name FROM {SAMPLES} s JOIN {CALLS} x USING (sample) WHERE s.status = 'P'")
def select_rename(spark, sf):
    return samples(spark, sf).where("status = 'P'").join(calls(spark, sf), "sample").select("sample", F.col("line").alias("alignment_id"), F.col("replicon").alias("sequence_name"))


@query("SELECT n_nationkey AS id, n_name AS replicon, 1 AS translation_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def replicon_rows(spark, sf):
    r = table(spark, sf, "region").where("r_name = 'ASIA'")
    return table(spark, sf, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("replicon"), F.lit(1).alias("translation_id"))


@query("SELECT r_regionkey AS id, r_name AS accession FROM region")
def reference_listing(spark, sf):
    return table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("accession"))


@query("SELECT o_orderkey AS name, o_orderstatus AS status, o_orderdate::DATE::VARCHAR AS init_upload_date FROM orders")
def column_order(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").cast("string").alias("init_upload_date"), F.col("o_orderkey").alias("name"))
    return o.select(*match.output_columns(o.columns, o.columns))


@query("SELECT s.sample, x.replicon, n.reference FROM (SELECT o_orderkey AS sample FROM orders WHERE o_orderstatus = 'P') s JOIN " + CALLS + " x USING (sample) JOIN (SELECT 'rep' || (n_nationkey % 2)::VARCHAR AS replicon, min(n_name) AS reference FROM nation GROUP BY 1) n USING (replicon)")
def star_join(spark, sf):
    c = calls(spark, sf)
    links = c.select("sample", F.concat_ws("/", "sample", "line").alias("sequence")).distinct()
    alignments = c.select(F.concat_ws("/", "sample", "line").alias("sequence"), "replicon")
    n = table(spark, sf, "nation").groupBy(F.concat(F.lit("rep"), (F.col("n_nationkey") % 2).cast("string")).alias("replicon")).agg(F.min("n_name").alias("reference"))
    return match.star(samples(spark, sf).where("status = 'P'").select("sample"), links, links.select("sequence").distinct(), alignments, n).select("sample", "replicon", "reference")


