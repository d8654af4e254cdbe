"""Queries of table maintenance, metadata, files and the ingest stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import lineage, reshape, stats
from ..operators import maintain as m
from ..operators.match import auto_linked
from ..operators.scale import shared_dir
from ..sources import readers, variant_store, writers
from ..streaming.ingest import ingest, snapshot
from ..streaming.ranged import RangedTable
from ..streaming.weekly import stream_weekly, weekly_shares
from .bindings import EAV_TEXT, SAMPLES, SEQUENCES, calls, eav_text, query, samples, sequences, table
from .stats_queries import LABEL, SHARES

ORDERS = "(SELECT o_orderkey AS name, o_orderstatus AS status, o_orderpriority AS priority, o_custkey AS cust FROM orders)"


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("cust"))


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


@query(f"SELECT name, CASE WHEN name % 3 = 0 THEN 'new' ELSE 'changed' END AS reason FROM {ORDERS} WHERE name % 3 = 0 OR name % 5 = 0")
def incremental_select(spark, sf):
    """Orders that are not stored (one in three), or stored with another hash (one in five)."""
    incoming = _orders(spark, sf).select("name", x.sequence_hash(F.concat("status", "priority")).alias("seqhash"))
    stored = incoming.where("name % 3 <> 0").withColumn("seqhash", F.when(F.col("name") % 5 == 0, "old").otherwise(F.col("seqhash")))
    return m.to_process(incoming, stored).select("name", "reason")


@query(f"SELECT name, CASE WHEN name % 8 = 0 THEN 'Y' WHEN name % 4 = 0 THEN 'X' ELSE status END AS status FROM {ORDERS} UNION ALL SELECT -1 - n_nationkey, 'Z' FROM nation")
def upsert_latest(spark, sf):
    o = _orders(spark, sf).select("name", "status")
    stored = o.withColumn("seq", F.lit(0))
    incoming = o.where("name % 4 = 0").select("name", F.lit("X").alias("status"), F.lit(1).alias("seq")).unionByName(o.where("name % 8 = 0").select("name", F.lit("Y").alias("status"), F.lit(2).alias("seq")))
    new = table(spark, sf, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("name"), F.lit("Z").alias("status"), F.lit(1).alias("seq"))
    return m.upserted(stored, incoming.unionByName(new), ["name"], "seq").select("name", "status")


@query("SELECT l_partkey AS pos, l_returnflag AS alt, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem) GROUP BY ALL")
def insert_ignore(spark, sf):
    """Mutations of even lines are stored, those of odd lines come in: natural keys stay unique."""
    keys = ["pos", "alt", "ref"]
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("alt"), F.col("l_linestatus").alias("ref"), "l_linenumber")  # noqa: E741
    stored = l.where("l_linenumber % 2 = 0").select(*keys).distinct()
    return m.inserted(stored, l.where("l_linenumber % 2 = 1").select(*keys), keys).groupBy("pos", "alt").agg(F.count("*").alias("n"))


DELETED = "SELECT 'samples' AS t, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'links', count(*) FROM lineitem WHERE l_orderkey % 7 <> 0 UNION ALL SELECT 'eav', count(*) FROM events WHERE event_id % 7 <> 0 UNION ALL "
SEQS = "SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 7 <> 0"


@query(DELETED + f"SELECT 'sequences', count(*) FROM part WHERE p_partkey IN ({SEQS}) OR p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 'alignments', count(*) FROM part WHERE p_partkey % 2 = 0 AND (p_partkey IN ({SEQS}) OR p_partkey NOT IN (SELECT l_partkey FROM lineitem))")
def delete_cascade(spark, sf):
    """Rows that are left in each table after one sample in seven is deleted. Parts are the sequences."""
    s = samples(spark, sf)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("sequence"))
    links = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_partkey").alias("sequence"))
    gone = s.where("sample % 7 = 0").select("sample").unionByName(table(spark, sf, "events").where("event_id % 7 = 0").select(F.col("event_id").alias("sample"))).unionByName(links.where("sample % 7 = 0").select("sample"))
    left = m.delete_samples(gone, s, links, table(spark, sf, "events").select(F.col("event_id").alias("sample")), p, p.where("sequence % 2 = 0"))
    out = None
    for name, df in left.items():
        n = df.agg(F.lit(name).alias("t"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT (SELECT count(*) FROM part WHERE p_size <= 40) AS sequences, (SELECT count(*) FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 40)) AS links")
def delete_sequences(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("sequence"), "p_size")
    links = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("sequence"))
    left = m.delete_sequences(p.where("p_size > 40"), p, links, p)
    return left["sequences"].agg(F.count("*").alias("sequences")).crossJoin(left["links"].agg(F.count("*").alias("links")))


@query("SELECT (SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') AS replicons, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') AS alignments, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') AS affected")
def reference_delete(spark, sf):
    """What is left without a reference, and how many alignments that concerns."""
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("reference"))
    replicons = table(spark, sf, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("rk")).select(F.col("n_nationkey").alias("replicon"), "reference")
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("replicon"))
    left = m.delete_reference("ASIA", r, replicons, alignments=a)
    affected = a.join(replicons.where("reference = 'ASIA'"), "replicon", "left_semi").agg(F.count("*").alias("affected"))
    return left["replicons"].agg(F.count("*").alias("replicons")).crossJoin(left["alignments"].agg(F.count("*").alias("alignments"))).crossJoin(affected)


@query("SELECT name, datatype FROM (SELECT DISTINCT event_type AS name, 'value_varchar' AS datatype FROM events) WHERE name <> 'click' UNION ALL SELECT 'extra', 'value_float'")
def property_registry(spark, sf):
    """Event types as properties: one is added, one found, one deleted with its values."""
    e = table(spark, sf, "events")
    registry = e.select(F.col("event_type").alias("name"), F.lit("value_varchar").alias("datatype"), F.lit("text").alias("querytype"), F.lit(None).cast("string").alias("default")).distinct()
    registry = m.registered(m.registered(registry, "extra", "value_float", "float"), "error", "value_float", "float")
    registry, _ = m.unregistered(registry, e.select(F.col("event_type").alias("name")), "click")
    return registry.select("name", "datatype")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, sf):
    return m.violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_suppkey AS sequence, CASE WHEN n = 1 THEN wish ELSE wish || '_' || n::VARCHAR END AS name FROM (SELECT l_suppkey, wish, row_number() OVER (PARTITION BY wish ORDER BY l_suppkey) AS n FROM (SELECT l_suppkey, min('n' || (l_orderkey % 100)::VARCHAR) AS wish FROM lineitem GROUP BY 1))")
def unique_name_backfill(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    s = l.select(F.col("l_suppkey").alias("sequence")).distinct().withColumn("seqhash", F.lit("h"))
    return m.unique_names(s, l.select(F.col("l_suppkey").alias("sequence"), F.concat(F.lit("n"), (F.col("l_orderkey") % 100).cast("string")).alias("name")))


JOBS = "(SELECT user_id AS job, count(*) AS files, CASE WHEN bool_or(event_type = 'view') THEN 'in progress' WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY 1)"


def _jobs(spark, sf):
    e = table(spark, sf, "events")
    return stats.job_status(e.select(F.col("user_id").alias("job"), F.col("event_id").alias("file")), e.where("event_type != 'view'").select(F.col("event_id").alias("file"), (F.col("event_type") != "error").alias("success")))


@query(f"SELECT * FROM {JOBS}")
def job_status(spark, sf):
    """Users as jobs and their events as files; views are not logged yet, errors have failed."""
    return _jobs(spark, sf)


@query(f"SELECT job, upper(status[1:1]) || status[2:] AS status, strftime(t, '%Y-%m-%d %H:%M') AS started FROM {JOBS} JOIN (SELECT user_id AS job, min(ts) AS t FROM events GROUP BY 1) USING (job)")
def job_listing(spark, sf):
    start = table(spark, sf, "events").groupBy(F.col("user_id").alias("job")).agg(F.min("ts").alias("t"))
    name = x.lookup({"in progress": "In progress", "failed": "Failed", "completed": "Completed"}, F.col("status"))
    return _jobs(spark, sf).join(start, "job").select("job", name.alias("status"), F.date_format("t", "yyyy-MM-dd HH:mm").alias("started"))


@query(f"SELECT sample, count(*) AS \"values\", max(CASE WHEN name = 'score' THEN value END) AS score FROM (SELECT * FROM {EAV_TEXT} WHERE NOT (name = 'score' AND sample % 2 = 0) UNION ALL SELECT event_id, 'score', (user_id * 2)::VARCHAR FROM events WHERE event_id % 2 = 0) GROUP BY 1")
def metadata_upsert(spark, sf):
    """Metadata rows of every second event change its score; other properties stay."""
    e = table(spark, sf, "events")
    s = e.select(F.col("event_id").alias("sample"), F.lit("old").alias("lab"), F.lit(0).alias("ingest_seq"))
    old = eav_text(spark, sf).withColumnRenamed("value", "value_varchar")
    rows = e.where("event_id % 2 = 0").select(F.col("event_id").alias("sample"), F.lit("new").alias("lab"), (F.col("user_id") * 2).cast("string").alias("score"), F.lit(1).alias("ingest_seq"))
    _, values = m.metadata_upserted(s, old, rows, ["lab"], {"score": "value_integer"})
    value = F.coalesce("value_varchar", F.col("value_integer").cast("string"))
    return values.groupBy("sample").agg(F.count(value).alias("values"), F.max(F.when(F.col("name") == "score", value)).alias("score"))


@query("SELECT event_id AS name, event_type AS lab, CASE WHEN user_id % 10 < 8 THEN (DATE '2024-01-01' + (user_id % 10)::INT)::VARCHAR END AS day, CASE WHEN event_id % 3 = 0 THEN (props->>'$.k') END AS lineage, 'DE' AS country FROM events")
def harmonise_metadata_a(spark, sf):
    """The first filled of two columns, a constant, a date and a field of a JSON array."""
    return _harmonised(spark, sf)[0].withColumn("day", F.col("day").cast("string")).withColumn("name", F.col("name").cast("long"))


@query("SELECT event_id AS name, 'day' AS \"column\", '2024-99-01' AS value FROM events WHERE user_id % 10 >= 8")
def harmonise_errors(spark, sf):
    return _harmonised(spark, sf)[1].withColumn("name", F.col("name").cast("long"))


def _harmonised(spark, sf):
    e = table(spark, sf, "events")
    day = F.when(F.col("user_id") % 10 < 8, F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("user_id") % 10).cast("int")).cast("string")).otherwise("2024-99-01")
    cell = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('[{"genomic_typing_result": '), F.get_json_object("props", "$.k"), F.lit("}]"))).otherwise("[]")
    raw = e.select(F.col("event_id").cast("string").alias("IMS_ID"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(" ").alias("LAB"), F.col("event_type").alias("LAB_2"), day.alias("DATE_DRAW"), cell.alias("TYPING"))
    return readers.harmonised_a(raw, {"name": ["IMS_ID"], "lab": ["LAB", "LAB_2", "LAB_3"], "day": ["DATE_DRAW"]}, {"country": "DE"}, ["day"], ("lineage", "TYPING"))


@query("SELECT user_id AS accession, arg_min(event_type, event_id) AS host, CASE user_id % 3 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '2024-03-01' ELSE '' END AS day FROM events GROUP BY user_id")
def harmonise_metadata_b(spark, sf):
    """The first record of each accession; years and months as their first day."""
    day = F.when(F.col("user_id") % 3 == 0, "2024").when(F.col("user_id") % 3 == 1, "2024-03").otherwise("2024-13-77")
    records = table(spark, sf, "events").select(F.col("user_id").alias("acc"), F.col("event_type").alias("hostName"), day.alias("date"), F.col("event_id").alias("seq"))
    return readers.harmonised_b(records, {"acc": "accession", "hostName": "host", "date": "day"}, ["day"], "accession")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate::DATE::VARCHAR END AS day FROM orders")
def parse_dates(spark, sf):
    """The same dates in four formats, and texts that are no date."""
    d, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(d, "dd.MM.yyyy")).when(k % 5 == 2, F.date_format(d, "M/d/yyyy")).when(k % 5 == 3, F.date_format(d, "d MMM yyyy")).otherwise("soon")
    return table(spark, sf, "orders").select(k.alias("k"), x.parsed_date(text).cast("string").alias("day"))


@query("SELECT o_orderkey AS k, o_orderstatus || '|' || o_orderpriority[1:1] || '|' || o_custkey::VARCHAR AS items FROM orders")
def split_lists(spark, sf):
    text = F.concat(F.lit(" ;"), "o_orderstatus", F.lit(", ; "), F.substring("o_orderpriority", 1, 1), F.lit("\t"), F.col("o_custkey").cast("string"), F.lit(",,"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.array_join(x.split_list(text), "|").alias("items"))


@query("SELECT event_id AS k, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS yes FROM events")
def bool_text(spark, sf):
    k = F.col("event_id") % 4
    return table(spark, sf, "events").select(F.col("event_id").alias("k"), x.parsed_bool(F.when(k == 0, " Yes").when(k == 1, "OFF").when(k == 2, "1").otherwise("perhaps")).alias("yes"))


@query("SELECT event_id AS k, coalesce(CASE WHEN event_id % 2 = 0 THEN user_id END, 5) AS n, CASE WHEN event_id % 3 = 0 THEN value END AS f, CASE WHEN event_id % 3 <> 0 THEN NULL ELSE DATE '2024-01-02'::VARCHAR END AS d FROM events")
def typed_values(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select(k.alias("k"), x.typed(F.when(k % 2 == 0, F.col("user_id").cast("string")).otherwise(" "), "value_integer", "5").alias("n"), x.typed(F.when(k % 3 == 0, F.col("value").cast("string")).otherwise("n/a"), "value_float").alias("f"), x.typed(F.when(k % 3 == 0, "2024-01-02").otherwise("later"), "value_date").cast("string").alias("d"))


@query("SELECT doc_id AS id, text[1:90] AS translated FROM (SELECT doc_id, array_to_string(list_transform(range(0, 10), lambda k: substr('" + x.RESIDUES + f"', (16 * (strpos('{x.BASES}', s[3 * k + 1]) - 1) + 4 * (strpos('{x.BASES}', s[3 * k + 2]) - 1) + strpos('{x.BASES}', s[3 * k + 3]))::INT, 1)), '') AS text FROM (SELECT id AS doc_id, sequence AS s FROM {SEQUENCES}))")
def translate_codons(spark, sf):
    return sequences(spark, sf).select("id", x.translated("sequence").alias("translated"))


@query(f"SELECT id::VARCHAR AS id, repeat(sequence, 6) AS sequence FROM {SEQUENCES}")
def fasta_round_trip(spark, sf):
    """Sequences written with wrapped lines and read again."""
    path = _folder(spark)
    writers.write_fasta(sequences(spark, sf).select(F.concat(F.col("id").cast("string"), F.lit(" a note|x")).alias("header"), F.repeat("sequence", 6).alias("sequence")), path, header="header")
    return readers.read_fasta(spark, path).select("id", "sequence")


@query("SELECT o_orderkey::VARCHAR AS name, o_orderstatus AS status, CASE WHEN o_custkey % 2 = 0 THEN o_custkey::VARCHAR END AS cust FROM orders")
def metadata_round_trip(spark, sf):
    """Metadata as text with a column that is linked by its name in another case."""
    path = _folder(spark)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("Name"), F.col("o_orderstatus").alias("STATUS"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("customer"))
    writers.export(o, path, ["Name", "STATUS", "customer", "nothing"])
    links, _ = auto_linked(["Name", "STATUS", "customer", "nothing"], ["name", "status", "lab"], {"cust": "customer"})
    return readers.renamed(readers.read_metadata(spark, path, ["Name", "STATUS", "customer", "nothing"]), links).select("name", "status", "cust")


@query("SELECT l_orderkey AS seqhash, l_partkey AS start, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS alt, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag <> 'N') GROUP BY ALL")
def variant_store_round_trip(spark, sf):
    """Variants written once each, by reference, and read without the unclear ones."""
    path = _folder(spark)
    writers.write_variants(_variants(spark, sf), path)
    return readers.read_variants(spark, path).groupBy("seqhash", "start", "alt").agg(F.count("*").alias("n"))


def _variants(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("seqhash"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 1).alias("end"), F.lit("G").alias("ref"), F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_returnflag")).alias("alt"), F.lit("nt").alias("type"), F.col("l_linestatus").alias("refhash"), F.col("l_linestatus").alias("reference_acc"))


@query("SELECT DISTINCT l_orderkey AS seqhash, l_partkey AS start, CASE WHEN l_returnflag = 'R' THEN ' ' ELSE l_returnflag END AS alt FROM lineitem WHERE l_linestatus = 'F' AND l_partkey BETWEEN (SELECT max(l_partkey) // 4 FROM lineitem) AND (SELECT max(l_partkey) // 4 + max(l_partkey) // 50 FROM lineitem)")
def variant_region_scan(spark, sf):
    """A fiftieth of one reference from a store of many files: those that the manifest names are opened."""
    path, v = _folder(spark), _variants(spark, sf)
    last = v.agg(F.max("start")).first()[0]
    variant_store.write_variants(v, path, max(1000, last * 2))
    return variant_store.read_region(spark, path, "F", last // 4, last // 4 + last // 50).select("seqhash", "start", "alt")


@query("SELECT DISTINCT l_orderkey AS seqhash FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'A' AND l_partkey = (SELECT max(l_partkey) // 3 FROM lineitem)")
def variant_allele_scan(spark, sf):
    """The sequences that carry one variant."""
    path, v = _folder(spark), _variants(spark, sf)
    last = v.agg(F.max("start")).first()[0]
    variant_store.write_variants(v, path, max(1000, last * 2))
    return variant_store.read_allele(spark, path, "F", last // 3, "G", "A").select("seqhash")


@query("SELECT o_orderkey AS sample, coalesce(string_agg(DISTINCT l, ', ' ORDER BY l) FILTER (r = 'rep0'), '') AS rep0, coalesce(string_agg(DISTINCT l, ', ' ORDER BY l) FILTER (r = 'rep1'), '') AS rep1, coalesce(string_agg(DISTINCT l, ', ' ORDER BY l) FILTER (r = 'rep0' AND g = 'g1'), '') AS rep0_g1 FROM orders LEFT JOIN (SELECT l_orderkey, 'rep' || (l_linenumber % 2)::VARCHAR AS r, 'g' || (l_linenumber % 3)::VARCHAR AS g, l_linestatus || l_partkey::VARCHAR || l_returnflag AS l FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1")
def wide_export(spark, sf):
    """The wide table, exported and read again."""
    path = _folder(spark)
    c = calls(spark, sf).withColumn("label", x.nt_label())
    wide = writers.wide_table(samples(spark, sf).select("sample"), c, c.withColumn("cds", F.col("gene")), ["rep0", "rep1"], [("rep0", "g1")])
    wide.write.csv(path, sep=";", header=True)
    back = spark.read.csv(path, sep=";", header=True, schema="sample long, rep0 string, rep1 string, rep0_g1 string")
    return back.fillna("")


@query("SELECT count(*)::BIGINT AS lines, sum(CASE WHEN p > 0 THEN 1 ELSE 0 END)::BIGINT AS deletions FROM (SELECT l_partkey, l_linestatus, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS p FROM lineitem GROUP BY l_partkey, l_linestatus, l_returnflag = 'N')")
def vcf_write(spark, sf):
    """VCF text, written and read again."""
    from .variant_queries import vcf_rows

    path = _folder(spark)
    writers.write_vcf(vcf_rows(spark, sf), path, ["s0", "s1", "s2"])
    return readers.read_vcf(spark, path).agg(F.count("*").alias("lines"), F.count_if(F.length("ref") > F.length("alt")).alias("deletions"))


@query("SELECT (SELECT count(*) FROM events)::BIGINT AS ids, (SELECT count(*) FROM events WHERE user_id % 10 >= 8)::BIGINT AS errors")
def error_report(spark, sf):
    path = _folder(spark)
    good, bad = _harmonised(spark, sf)
    writers.write_reports(good, bad, path)
    errors = spark.read.csv(f"{path}/errors", header=True).agg(F.count("*").alias("errors"))
    return readers.id_list(spark, [], f"{path}/ids").agg(F.count("*").alias("ids")).crossJoin(errors)


@query("SELECT DISTINCT trim(event_type) AS id FROM events UNION SELECT 'extra'")
def id_list(spark, sf):
    path = _folder(spark)
    table(spark, sf, "events").select(F.concat(F.lit(" "), "event_type", F.lit(" "))).write.text(path)
    return readers.id_list(spark, ["extra", " click"], path)


@query(f"SELECT sample AS name, CASE WHEN sample % 5 = 0 THEN 'late' ELSE status END AS status FROM {SAMPLES}")
def stream_ingest_snapshot(spark, sf):
    """Orders arrive as files in two drops, the second with changed rows; the stream is run three times and the last finds nothing."""
    path = _folder(spark)
    o = samples(spark, sf).select(F.col("sample").alias("name"), "status")
    schema = "name long, status string, seq int"

    def drop(df):
        df.repartition(4).write.mode("append").parquet(f"{path}/in")
        ingest(spark, f"{path}/in", f"{path}/out", schema, ["name"], "seq", f"{path}/state", 3, 2).awaitTermination()

    drop(o.where("name % 2 = 0").withColumn("seq", F.lit(0)))
    drop(o.where("name % 2 = 1").withColumn("seq", F.lit(0)).unionByName(o.where("name % 5 = 0").withColumns({"status": F.lit("late"), "seq": F.lit(1)})))
    ingest(spark, f"{path}/in", f"{path}/out", schema, ["name"], "seq", f"{path}/state").awaitTermination()
    return snapshot(spark, f"{path}/out/data", schema, ["name"], "seq").select("name", "status")


@query(f"""WITH late AS (SELECT sample FROM {SAMPLES} WHERE sample BETWEEN (SELECT max(o_orderkey) // 3 FROM orders) AND (SELECT max(o_orderkey) // 3 + max(o_orderkey) // 100 FROM orders))
SELECT sample AS name, CASE WHEN sample IN (SELECT sample FROM late) THEN 'late' ELSE status END AS status, sample // (SELECT max(o_orderkey) // 200 + 1 FROM orders) IN (SELECT sample // (SELECT max(o_orderkey) // 200 + 1 FROM orders) FROM late) AS rewritten FROM {SAMPLES}""")
def stream_ingest_ranges(spark, sf):
    """Orders arrive, then changes to one in a hundred: only their ranges are written again."""
    path = _folder(spark)
    o = samples(spark, sf).select(F.col("sample").alias("name"), "status")
    last = o.agg(F.max("name")).first()[0]
    stored = RangedTable(spark, f"{path}/out", "name long, status string, seq int", ["name"], "seq", last // 200 + 1)

    def drop(df):
        df.repartition(2).write.mode("append").parquet(f"{path}/in")
        stored.ingest(f"{path}/in", f"{path}/state").awaitTermination()

    drop(o.withColumn("seq", F.lit(0)))
    drop(o.where(F.col("name").between(last // 3, last // 3 + last // 100)).withColumns({"status": F.lit("late"), "seq": F.lit(1)}))
    return stored.read().select("name", "status", (F.col("batch") > 0).alias("rewritten"))


@query(f"SELECT monday::VARCHAR AS monday, {LABEL} AS week, \"group\", samples, percent FROM {SHARES}")
def group_share_stream(spark, sf):
    """Weekly shares after three drops of orders by day; a tenth comes a drop late, a seventh comes twice. The watermark is two drops behind."""
    path = _folder(spark)
    o = samples(spark, sf).select("sample", "priority", "day").where("day IS NOT NULL")
    first, last = o.agg(F.min("day"), F.max("day")).first()
    third = (last - first).days // 3 + 1
    part, late, again = F.floor(F.datediff("day", F.lit(first)) / third), F.col("sample") % 10 == 3, F.col("sample") % 7 == 0
    for k in range(3):
        due, before = (part == k) & (~late | F.lit(k == 2)), (part == k - 1) & (late | again)
        o.where(due | before).repartition(2).write.mode("append").parquet(f"{path}/in")
        stream_weekly(spark, f"{path}/in", f"{path}/out", "sample long, priority string, day date", "priority", f"{path}/state", f"{2 * third + 7} days").awaitTermination()
    return weekly_shares(spark, f"{path}/out").withColumn("monday", F.col("monday").cast("string"))


@query(f"SELECT 'd' || id::VARCHAR AS id, sequence FROM {SEQUENCES}")
def packed_fasta_round_trip(spark, sf):
    """Sequences as xz, gz and zip files, one for each hundred documents, packed by the executors and read again by content."""
    path = _folder(spark)
    s = sequences(spark, sf).withColumn("value", F.concat(F.lit(">d"), F.col("id").cast("string"), F.lit(" x\n"), F.substring("sequence", 1, 20), F.lit("\n"), F.expr("substring(sequence, 21)"), F.lit("\n")))
    files = s.groupBy(F.expr("id div 100").alias("k")).agg(F.array_join(F.array_sort(F.collect_list("value")), "").alias("text"))

    def pack(batches):
        import gzip
        import io
        import lzma
        import zipfile

        for batch in batches:
            out = []
            for k, text in zip(batch["k"], batch["text"], strict=True):
                raw, whole = text.encode(), io.BytesIO()
                with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("s.fasta", raw)
                out.append([lzma.compress(raw), gzip.compress(raw), whole.getvalue()][k % 3])
            yield batch.assign(content=out)[["k", "content"]]

    # Binary files of the packed bytes, by way of one table.
    packed = files.mapInPandas(pack, "k long, content binary")
    packed.write.parquet(path)
    return readers.packed_fasta(spark.read.parquet(path).select("content")).select("id", "sequence")


ALIGNED = "(SELECT c_custkey::VARCHAR AS seqId, c_nationkey AS n FROM customer)"


def _aligned(spark, sf):
    c = table(spark, sf, "customer")
    subs = F.array(F.struct(F.col("c_nationkey").cast("bigint").alias("pos"), F.lit("A").alias("refNuc"), F.lit("T").alias("qryNuc")))
    return c.select(F.col("c_custkey").cast("string").alias("seqId"), subs.alias("substitutions"), F.col("c_nationkey").alias("n"))


@query(f"SELECT seqId, n::BIGINT AS pos, 'lines' AS form FROM {ALIGNED} UNION ALL SELECT seqId, n::BIGINT, 'list' FROM {ALIGNED} UNION ALL SELECT seqId, n::BIGINT, 'results' FROM {ALIGNED}")
def aligner_json_round_trip(spark, sf):
    """Aligner records as JSON lines (with lines that are no JSON), as a list and as an object of results, a file for each nation."""
    path, own = _folder(spark), _aligned(spark, sf)
    doc = F.to_json(F.struct("seqId", "substitutions"))
    own.select(doc.alias("value")).union(table(spark, sf, "nation").select(F.concat(F.lit("{broken "), "n_name"))).write.text(f"{path}/lines")
    lists = own.groupBy("n").agg(F.concat(F.lit("["), F.array_join(F.collect_list(doc), ","), F.lit("]")).alias("value")).repartition(8, "n")
    lists.select("value").where("n >= 0").write.option("maxRecordsPerFile", 1).text(f"{path}/list")
    lists.select(F.concat(F.lit('{"results": '), "value", F.lit("}")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/results")
    every = [readers.read_aligner_json(spark, f"{path}/{form}", form).select("seqId", F.col("substitutions")[0]["pos"].alias("pos"), F.lit(form).alias("form")) for form in ("lines", "list", "results")]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query("SELECT 'L' || c_custkey::VARCHAR AS lineage, CASE WHEN c_custkey > 1 THEN 'L' || (c_custkey // 2)::VARCHAR END AS parent FROM customer")
def lineage_table_round_trip(spark, sf):
    """A lineage table file: each customer with its children, or none."""
    path = _folder(spark)
    name = lambda k: F.concat(F.lit("L"), k.cast("string"))
    c = table(spark, sf, "customer")
    children = c.where("c_custkey > 1").groupBy(name(F.expr("c_custkey div 2")).alias("lineage")).agg(F.array_join(F.array_sort(F.collect_list(name(F.col("c_custkey")))), ",").alias("sublineage"))
    c.select(name(F.col("c_custkey")).alias("lineage")).join(children, "lineage", "left").fillna("none", ["sublineage"]).write.csv(path, sep="\t", header=True)
    return lineage.edges_from_children(readers.read_lineages(spark, path))


@query("SELECT 'C' || c_custkey::VARCHAR AS lineage, CASE WHEN c_custkey % 4 > 0 THEN 'C' || (c_custkey - c_custkey % 4)::VARCHAR END AS parent FROM customer")
def clade_files_round_trip(spark, sf):
    """Two designation files: the sites of clades, and rows of gene `clade` that name parents."""
    path = _folder(spark)
    c, name = table(spark, sf, "customer"), lambda k: F.concat(F.lit("C"), k.cast("string"))
    row = lambda df, gene, site: df.select(name(F.col("c_custkey")).alias("clade"), F.lit(gene).alias("gene"), site.alias("site"), F.lit("A").alias("alt"))
    row(c, "nuc", F.col("c_custkey").cast("string")).write.csv(f"{path}/sites", sep="\t", header=True)
    row(c.where("c_custkey % 4 > 0"), "clade", name(F.col("c_custkey") - F.col("c_custkey") % 4)).write.csv(f"{path}/parents", sep="\t", header=True)
    return lineage.edges_from_pairs(lineage.pairs_from_clades(readers.read_clades(spark, [f"{path}/sites", f"{path}/parents"])))


@query("SELECT 'J' || c_custkey::VARCHAR AS lineage, CASE WHEN c_custkey % 3 > 0 THEN 'J' || (c_custkey // 3)::VARCHAR END AS parent FROM customer UNION SELECT 'J0', NULL")
def lineage_json_round_trip(spark, sf):
    """Designation files, a list or an object of lineages for each nation; roots have words for no parent."""
    path, c = _folder(spark), table(spark, sf, "customer")
    item = F.struct(F.concat(F.lit("J"), F.col("c_custkey").cast("string")).alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("J"), F.expr("c_custkey div 3").cast("string"))).otherwise(F.when(F.col("c_custkey") % 2 == 0, "None")).alias("parent"))
    lists = c.groupBy("c_nationkey").agg(F.to_json(F.collect_list(item)).alias("list"))
    lists.select(F.when(F.col("c_nationkey") % 2 == 0, F.col("list")).otherwise(F.concat(F.lit('{"lineages": '), "list", F.lit("}"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return lineage.edges_from_pairs(readers.read_json_lineages(spark, path))


@query("SELECT event_id AS sample, 'kind' AS name, event_type AS value FROM events UNION ALL SELECT event_id, 'user', user_id::VARCHAR FROM events UNION ALL SELECT event_id, 'day', strftime(ts, '%Y-%m-%d') FROM events")
def eav_values(spark, sf):
    """Typed properties and their value as text: the first typed column that is not null."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("sample"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("user"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    long = reshape.to_long(e, {"kind": "value_varchar", "user": "value_integer", "day": "value_date"})
    return long.select("sample", "name", reshape.eav_value().alias("value"))


@query(f"SELECT id, sequence FROM {SEQUENCES}")
def reference_harmonise(spark, sf):
    """Reference sequences in lower case, as RNA, between blanks."""
    raw = sequences(spark, sf).withColumn("raw", F.concat(F.lit("\n "), F.lower(F.replace("sequence", F.lit("T"), F.lit("U"))), F.lit(" ")))
    return raw.select("id", x.reference_sequence(F.regexp_replace("raw", "\n", " ")).alias("sequence"))


@query(f"SELECT o_orderkey AS sample FROM orders WHERE (o_orderstatus = 'F' AND o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1995-06-30') OR o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus LIKE '%P%'")
def filter_groups(spark, sf):
    """Two groups of filters as forms give them: texts that are read as lists, dates or patterns, and unset ones."""
    from datetime import date

    from ..operators import filters as f

    leaf = lambda name, kind, value: {"label": "Property", "property_name": name, "filter_type": kind, "value": value}
    groups = [{"filters": [leaf("status", "exact", "F"), leaf("day", "exact", [date(1995, 6, 30), date(1995, 1, 1)]), leaf("priority", "exact", "")]},
        {"filters": [leaf("priority", "in", "1-URGENT,2-HIGH"), leaf("status", "contains", "%P%")]}, {"filters": [leaf("status", "exact", None)]}]
    return f.matching(f.Tables(samples=samples(spark, sf)), f.group_tree(groups)).select("sample")


@query("SELECT event_id AS sample, 'new' AS lab, event_type AS kind FROM events")
def split_input_columns(spark, sf):
    """Columns of an input table told apart: sample fields go to samples, custom ones to properties."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("sample"), F.lit("new").alias("lab"), F.col("event_type").alias("kind"))
    fields, custom = reshape.split_columns(e.columns, ["lab", "zip"], "sample")
    values = reshape.to_long(e.select("sample", *custom), dict.fromkeys(custom, "value_varchar"))
    return e.select("sample", *fields).join(values.select("sample", F.col("value_varchar").alias("kind")), "sample")
