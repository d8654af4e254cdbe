"""Queries of sequences, variants and VCF text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import sketches
from ..operators import variants as v
from ..operators.scale import cut, tasks
from ..sources.readers import vcf_from_lines
from .bindings import CALLS, SEQUENCES, calls, query, sequences, table


@query(f"SELECT id, sequence AS harmonised, sha256(sequence) AS seqhash FROM {SEQUENCES}")
def sequence_harmonise_hash(spark, sf):
    """Sequences in lower case, as RNA, with gaps and blanks about them."""
    raw = sequences(spark, sf).withColumn("raw", F.concat(F.lit(" "), F.lower(F.regexp_replace(F.replace("sequence", F.lit("T"), F.lit("U")), "^(.{5})", "$1--"))))
    return raw.select("id", x.harmonised("raw").alias("harmonised"), x.sequence_hash(x.harmonised("raw")).alias("seqhash"))


# Aligned pairs: a document's sequence against the next one's, with a deletion of 3 in every third and an insertion of 2 in every second.
PAIRS = f"""(SELECT a.id, CASE WHEN a.id % 3 = 0 THEN a.sequence[1:4] || '---' || a.sequence[8:] ELSE a.sequence END AS q,
    CASE WHEN a.id % 2 = 0 THEN b.sequence[1:20] || '--' || b.sequence[23:] ELSE b.sequence END AS r FROM {SEQUENCES} a JOIN {SEQUENCES} b ON b.id = a.id + 1)"""
CALLED = f"""(SELECT id, i - CASE WHEN id % 2 = 0 AND i > 21 THEN 2 ELSE 0 END AS start, i + 1 - CASE WHEN id % 2 = 0 AND i > 21 THEN 2 ELSE 0 END AS "end", r[i + 1] AS ref, q[i + 1] AS alt FROM {PAIRS}, range(32) t(i) WHERE q[i + 1] <> r[i + 1] AND q[i + 1] <> '-' AND r[i + 1] <> '-'
    UNION ALL SELECT id, 4, 7, r[5:7], '' FROM {PAIRS} WHERE id % 3 = 0 UNION ALL SELECT id, 19, 20, r[20], q[20:22] FROM {PAIRS} WHERE id % 2 = 0)"""


def _pairs(spark, sf):
    s = sequences(spark, sf)
    both = s.select("id", F.col("sequence").alias("q")).join(s.select((F.col("id") - 1).alias("id"), F.col("sequence").alias("r")), "id")
    gap = lambda c, a, n, b: F.concat(F.substring(c, 1, a), F.lit("-" * n), F.expr(f"substring({c}, {b})"))
    return both.select("id", F.concat(F.lit("r"), F.col("id").cast("string")).alias("replicon"), F.when(F.col("id") % 3 == 0, gap("q", 4, 3, 8)).otherwise(F.col("q")).alias("qry"), F.when(F.col("id") % 2 == 0, gap("r", 20, 2, 23)).otherwise(F.col("r")).alias("ref"))


@query(f"SELECT id, start, \"end\", ref, alt FROM {CALLED}")
def call_from_pairs(spark, sf):
    return v.calls_from_pairs(_pairs(spark, sf)).drop("replicon")


def _plain(c):
    return F.replace(c, F.lit("-"), F.lit(""))


@query(f"SELECT id, start, \"end\", ref, alt FROM {CALLED}")
def call_from_cigar(spark, sf):
    cigar = F.concat(F.lit("4M"), F.when(F.col("id") % 3 == 0, "3D").otherwise("3M"), F.lit("13M"), F.when(F.col("id") % 2 == 0, "2I").otherwise("2M"), F.lit("10M"))
    rows = _pairs(spark, sf).select("id", "replicon", _plain(F.col("qry")).alias("qry"), _plain(F.col("ref")).alias("ref"), cigar.alias("cigar"))
    return v.calls_from_cigar(rows).drop("replicon")


@query(f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY start, \"end\", ref, alt) AS number, CASE WHEN alt = '' THEN 'del:5-7' ELSE ref || \"end\"::VARCHAR || alt END AS label, (length(alt) - length(ref)) % 3 <> 0 AS frameshift FROM {CALLED}")
def frameshift(spark, sf):
    return v.labelled(v.numbered(call_from_pairs(spark, sf))).select("id", "number", "label", "frameshift")


@query(f"SELECT id, max(number) AS last FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY start) + 10 AS number FROM {CALLED}) GROUP BY id")
def variant_ids(spark, sf):
    """Numbers that go on after ten others."""
    return v.numbered(call_from_pairs(spark, sf).withColumn("before", F.lit(10)), "before").groupBy("id").agg(F.max("number").alias("last"))


@query(f"SELECT id, replace(q, '-', '') AS sequence FROM {PAIRS} WHERE id IN (SELECT id FROM {CALLED})")
def reconstruct_check(spark, sf):
    """What the calls make of the reference is the sequence that they came from."""
    pairs = _pairs(spark, sf)
    return v.reconstructed(pairs.select("replicon", _plain(F.col("ref")).alias("sequence")), v.calls_from_pairs(pairs)).select("id", "sequence")


@query(f"SELECT id FROM {PAIRS} WHERE id % 10 = 1")
def reconstruct_failures(spark, sf):
    """Originals of one remainder are changed behind the calls' back."""
    pairs = _pairs(spark, sf)
    bad = F.when(F.col("id") % 10 == 1, F.concat(_plain(F.col("qry")), F.lit("A"))).otherwise(_plain(F.col("qry")))
    return v.reconstruction_failures(pairs.select("replicon", _plain(F.col("ref")).alias("sequence")), v.calls_from_pairs(pairs), pairs.select("id", "replicon", bad.alias("sequence"))).select("id")


def _aa_sql(codon: str) -> str:
    at = lambda i: f"(strpos('{x.BASES}', {codon}[{i}]) - 1)"
    return f"'{x.RESIDUES}'[16 * {at(1)} + 4 * {at(2)} + {at(3)} + 1]"


# A coding sequence of two segments in each sequence; against the sequence in odd ones.
CODING = f"""(SELECT id, k AS aa_pos, CASE WHEN id % 2 = 0 THEN s[3 * k + 1:3 * k + 3] ELSE translate(reverse(s[length(s) - 3 * k - 2:length(s) - 3 * k]), 'ACGT', 'TGCA') END AS codon FROM (SELECT id, sequence[2:10] || sequence[14:25] AS s FROM {SEQUENCES}), range(7) t(k))"""


def _codons(spark, sf):
    s = sequences(spark, sf).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("replicon"), "id", "sequence")
    strand = F.when(F.col("id") % 2 == 0, 1).otherwise(-1)
    first = F.when(strand > 0, 1).otherwise(2)
    segment = lambda order, a, b: F.struct(order.alias("order"), F.lit(a).alias("start"), F.lit(b).alias("end"))
    segments = s.select("replicon", F.concat(F.lit("c"), F.col("id").cast("string")).alias("cds"), F.lit("g").alias("gene"), strand.alias("strand"), F.explode(F.array(segment(first, 1, 10), segment(3 - first, 13, 25))).alias("x")).select("replicon", "cds", "gene", "strand", "x.*")
    return v.codon_table(segments, s.select("replicon", "sequence"))


@query(f"SELECT 'c' || id::VARCHAR AS cds, aa_pos, codon, {_aa_sql('codon')} AS aa FROM {CODING}")
def codon_table(spark, sf):
    return _codons(spark, sf).groupBy("cds", "aa_pos", "aa").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "base"))), lambda b: b["base"]), "").alias("codon"))


NEXT = CODING.replace("sequence[2:10] || sequence[14:25] AS s", "b.sequence[2:10] || b.sequence[14:25] AS s").replace(f"SELECT id, b.sequence[2:10] || b.sequence[14:25] AS s FROM {SEQUENCES}", f"SELECT a.id, b.sequence[2:10] || b.sequence[14:25] AS s FROM {SEQUENCES} a JOIN {SEQUENCES} b ON b.id = a.id + 1")


@query(f"SELECT a.id, a.aa_pos AS start, {_aa_sql('a.codon')} AS ref, {_aa_sql('b.codon')} AS alt, {_aa_sql('a.codon')} || (a.aa_pos + 1)::VARCHAR || {_aa_sql('b.codon')} AS label FROM {CODING} a JOIN {NEXT} b USING (id, aa_pos) WHERE {_aa_sql('a.codon')} <> {_aa_sql('b.codon')}")
def nt_to_aa(spark, sf):
    """Residue variants of the next document's sequence against a document's own."""
    s = sequences(spark, sf)
    pairs = s.select("id", F.concat(F.lit("r"), F.col("id").cast("string")).alias("replicon"), F.col("sequence").alias("ref")).join(s.select((F.col("id") - 1).alias("id"), F.col("sequence").alias("qry")), "id")
    found = v.aa_from_nt(v.numbered(v.calls_from_pairs(pairs)), _codons(spark, sf))
    return found.select("id", "start", "ref", "alt", "label")


@query("SELECT sample, min(line)::INT AS start, (max(line) + 1)::INT AS \"end\", string_agg(ref, '' ORDER BY line) AS ref FROM (SELECT *, line - row_number() OVER (PARTITION BY sample ORDER BY line) AS run FROM (SELECT sample, line, min(ref) AS ref FROM " + CALLS + " WHERE alt <> 'A' GROUP BY ALL)) GROUP BY sample, run")
def aa_deletion_islands(spark, sf):
    """Runs of adjacent lines of an order."""
    own = calls(spark, sf).where("alt != 'A'").groupBy("sample", "line").agg(F.min("ref").alias("ref"))
    return v.islands(own, ["sample"], "line", "ref").select("sample", "start", "end", "ref")


@query("SELECT p_brand AS cds, sum(p_size)::BIGINT AS length FROM part GROUP BY 1 HAVING sum(p_size) % 3 <> 0")
def cds_length_check(spark, sf):
    return v.bad_lengths(table(spark, sf, "part").select(F.col("p_brand").alias("cds"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end")))


@query(f"SELECT 'c' || id::VARCHAR AS cds, CASE WHEN id % 2 = 0 THEN 1 ELSE 4 END AS aa_start, CASE WHEN id % 2 = 0 THEN 3 ELSE 6 END AS aa_end FROM {SEQUENCES}")
def peptide_range(spark, sf):
    """A peptide of the bases 4 to 10 of each coding sequence."""
    codons = _codons(spark, sf)
    peptides = codons.select("cds").distinct().select(F.concat(F.lit("p"), "cds").alias("peptide"), "cds", F.lit(4).alias("start"), F.lit(10).alias("end"))
    return v.peptide_ranges(peptides, codons).select("cds", "aa_start", "aa_end")


@query(f"WITH k AS (SELECT DISTINCT id, sequence[i:i + 4] AS kmer FROM {SEQUENCES}, range(1, 29) t(i)), n AS (SELECT id, count(*) AS n FROM k GROUP BY id), j AS (SELECT a.id, b.id AS reference, count(*) AS n_both FROM k a JOIN k b USING (kmer) WHERE b.id < 20 GROUP BY ALL), l AS (SELECT j.id, j.reference, n_both / (x.n + y.n - n_both) AS likeness FROM j JOIN n x ON x.id = j.id JOIN n y ON y.id = j.reference) SELECT s.id, r.reference, r.likeness FROM {SEQUENCES} s LEFT JOIN (SELECT * FROM l WHERE likeness >= 0.05 QUALIFY row_number() OVER (PARTITION BY id ORDER BY likeness DESC, reference) = 1) r USING (id)")
def kmer_assign(spark, sf):
    s = sequences(spark, sf)
    return v.best_reference(s, s.where("id < 20"), 5, 0.05)


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASES = "ACGT" * 13
GENOMES = f"(SELECT doc_id AS id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{BASES}') AS sequence FROM documents)"


def genomes(spark, sf):
    """The letters of every whole document as bases."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), LETTERS, BASES).alias("sequence"))


@query(f"""WITH g AS MATERIALIZED {GENOMES}, s AS MATERIALIZED (SELECT id, replace(sequence[length(sequence) // 8 + 1:], 'GATA', 'GACA') AS sequence FROM g),
t AS (SELECT 1 AS side, sequence, min(id) AS reference FROM s WHERE length(sequence) >= 21 GROUP BY sequence UNION ALL SELECT 2, sequence, min(id) FROM g WHERE length(sequence) >= 21 GROUP BY sequence),
u AS MATERIALIZED (SELECT *, md5(sequence) AS key FROM t),
e AS (SELECT side, key, sequence, unnest(range(1, length(sequence) - 19)) AS i FROM u),
k AS MATERIALIZED (SELECT DISTINCT side, key, ('0x' || md5(sequence[i:i + 20])[1:15])::BIGINT AS h FROM e),
z AS MATERIALIZED (SELECT side, key, count(*) AS n, (4 ** len(list_filter([64 * 4 ** j FOR j IN range(1, 16)], lambda x: x <= count(*))))::BIGINT AS scale FROM k GROUP BY side, key),
f AS MATERIALIZED (SELECT k.side, k.key, k.h, z.scale FROM k JOIN z USING (side, key) WHERE k.h % z.scale = 0),
m AS MATERIALIZED (SELECT side, key, m, count(*) AS c FROM f, (SELECT (4 ** j)::BIGINT AS m FROM range(0, 16) t(j)) WHERE m >= scale AND h % m = 0 GROUP BY ALL),
p AS (SELECT a.key, b.key AS other, greatest(a.scale, b.scale) AS m, count(*) AS n_both FROM f a JOIN f b USING (h) WHERE a.side = 1 AND b.side = 2 GROUP BY ALL),
l AS (SELECT p.key, p.other, u.reference, n_both / (a.c + b.c - n_both) AS estimate FROM p JOIN m a ON a.side = 1 AND a.key = p.key AND a.m = p.m JOIN m b ON b.side = 2 AND b.key = p.other AND b.m = p.m JOIN u ON u.side = 2 AND u.key = p.other),
c AS (SELECT * FROM (SELECT *, max(estimate) OVER (PARTITION BY key) AS top FROM l) WHERE estimate >= CASE WHEN top >= 0.5 THEN 0.5 ELSE 0.05 END QUALIFY row_number() OVER (PARTITION BY key ORDER BY estimate DESC, reference) <= 5),
x AS (SELECT c.key, c.other, c.reference, count(*) AS n_both FROM c JOIN k a ON a.side = 1 AND a.key = c.key JOIN k b ON b.side = 2 AND b.key = c.other AND b.h = a.h GROUP BY ALL),
y AS (SELECT x.key, x.reference, n_both / (a.n + b.n - n_both) AS likeness FROM x JOIN z a ON a.side = 1 AND a.key = x.key JOIN z b ON b.side = 2 AND b.key = x.other),
r AS (SELECT * FROM y WHERE likeness >= 0.05 QUALIFY row_number() OVER (PARTITION BY key ORDER BY likeness DESC, reference) = 1)
SELECT s.id, r.reference, r.likeness FROM s LEFT JOIN r ON r.key = md5(s.sequence)""")
def best_reference_by_sketch(spark, sf):
    """Every document's letters, shortened and changed in places, against all documents as references."""
    g = genomes(spark, sf)
    s = g.select("id", F.replace(F.expr("substring(sequence, cast(length(sequence) div 8 AS int) + 1)"), F.lit("GATA"), F.lit("GACA")).alias("sequence"))
    return sketches.best_by_sketch(s, g, hashed=sketches.md5_60)  # the SQL computes the same hash


GENES = "(SELECT p_partkey AS gene, p_partkey AS start, p_partkey + p_size % 4 AS \"end\" FROM part)"


@query(f"SELECT c.sample, c.line, min(g.gene) AS gene FROM (SELECT *, start + quantity AS stop FROM {CALLS}) c JOIN {GENES} g ON g.start >= c.start AND g.\"end\" <= c.stop GROUP BY ALL")
def interval_cover(spark, sf):
    """The first gene that a call covers; calls are as long as their quantity."""
    c = calls(spark, sf).select("sample", "line", F.lit("r").alias("replicon"), "start", (F.col("start") + F.col("quantity")).alias("end"))
    g = table(spark, sf, "part").select(F.lit("r").alias("replicon"), F.col("p_partkey").alias("gene"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size") % 4).alias("end"))
    return v.covered_genes(c, g).groupBy("sample", "line").agg(F.min("gene").alias("gene"))


@query(f"""SELECT sample, line, start, min(gene) AS gene, (2 * count(*))::INT AS n FROM (
    SELECT c.r, c.sample, c.line, c.start, arg_min(g.gene, (g.start, g.gene)) AS gene FROM (SELECT *, row_number() OVER () AS r, start + quantity * quantity * 400 AS stop FROM {CALLS} WHERE quantity > 45 OR line = 1) c
    JOIN {GENES} g ON g.start >= c.start AND g."end" <= c.stop GROUP BY c.r, c.sample, c.line, c.start) GROUP BY sample, line, start""")
def interval_cover_long(spark, sf):
    """Calls of up to a million bases beside short ones, each twice: both rows stay."""
    c = calls(spark, sf).where("quantity > 45 OR line = 1").select("sample", "line", F.lit("r").alias("replicon"), "start", (F.col("start") + F.col("quantity") * F.col("quantity") * 400).alias("end"))
    g = table(spark, sf, "part").select(F.lit("r").alias("replicon"), F.col("p_partkey").alias("gene"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size") % 4).alias("end"))
    out = v.covered_genes(c.unionByName(c), g).groupBy("sample", "line", "start").agg(F.min("gene").alias("gene"), F.count("*").cast("int").alias("n"))
    return out.select("sample", "line", "start", "gene", "n")


@query(f"SELECT c.sample, c.line, g.gene, count(*) AS positions FROM {CALLS} c JOIN {GENES} g ON c.start >= g.start AND c.start < g.\"end\" GROUP BY ALL")
def interval_join(spark, sf):
    """Calls within genes, by the genes' positions as keys."""
    g = table(spark, sf, "part").where("p_size % 4 > 0").select(F.col("p_partkey").alias("gene"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size") % 4).alias("end"))
    at = v.positions(g).select("gene", "pos")
    c = calls(spark, sf).select("sample", "line", "start")
    return c.join(at, c["start"] == at["pos"]).groupBy("sample", "line", "gene").agg(F.count("*").alias("positions"))


@query(f"SELECT c.sample, c.line, n.n_name AS cds FROM {CALLS} c LEFT JOIN (SELECT 'rep' || (n_nationkey % 2)::VARCHAR AS replicon, 'g' || (n_nationkey % 3)::VARCHAR AS gene, min(n_name) AS n_name FROM nation WHERE n_nationkey < 5 GROUP BY ALL) n USING (replicon, gene)")
def symbol_to_cds(spark, sf):
    part = lambda n: (F.col("n_nationkey") % n).cast("string")
    genes = table(spark, sf, "nation").where("n_nationkey < 5").groupBy(F.concat(F.lit("rep"), part(2)).alias("replicon"), F.concat(F.lit("g"), part(3)).alias("gene")).agg(F.min("n_name").alias("cds"))
    return v.cds_of_symbols(calls(spark, sf), genes).select("sample", "line", "cds")


LINKS = "(SELECT l_orderkey AS id, l_partkey AS variant, unnest([l_linenumber::BIGINT, l_linenumber::BIGINT + 1]) AS number FROM lineitem)"
NUMBERS = "(SELECT DISTINCT l_orderkey AS id, l_linenumber::BIGINT AS number FROM lineitem)"


def _parents(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    n = F.col("l_linenumber").cast("long")
    return v.parents_of(l.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("variant"), F.array(n, n + 1).alias("parents")), l.select(F.col("l_orderkey").alias("id"), n.alias("number")).distinct())


@query(f"SELECT id, variant, number FROM {LINKS} JOIN {NUMBERS} USING (id, number)")
def parents_of_variants(spark, sf):
    return _parents(spark, sf)[0].select("id", "variant", "number")


@query(f"SELECT id, variant, number FROM {LINKS} ANTI JOIN {NUMBERS} USING (id, number)")
def parents_missing(spark, sf):
    return _parents(spark, sf)[1].select("id", "variant", "number")


@query("SELECT 'nt' AS type, l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'cds', l_orderkey, count(DISTINCT l_linenumber % 3) FROM lineitem GROUP BY ALL")
def variant_union(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    a = l.select(F.lit("nt").alias("type"), F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("key"))
    b = l.select(F.lit("cds").alias("type"), F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 3).alias("key")).distinct()
    return a.unionByName(b).groupBy("type", "id").agg(F.count("*").alias("n"))


@query(f"SELECT sample, alt, string_agg(DISTINCT line::VARCHAR, ',' ORDER BY line::VARCHAR) AS parents, max(CASE WHEN ref = 'F' THEN 1 ELSE 0 END) AS frameshift FROM {CALLS} GROUP BY ALL")
def merged_variants(spark, sf):
    own = calls(spark, sf).withColumns({"parent": F.col("line"), "frameshift": F.col("ref") == "F"})
    return v.merged_variants(own, ["sample", "alt"])


# VCF text: from each line a row whose alts are C (shorter than the ref CAT in every second) and T, with two effects for C and one for T.
EFFECT = "{}|{}|{}|gene|id|transcript|feat|protein_coding|1/1|c.1|p.1|1|2|3|4|"
VCF_SQL = "(SELECT l_orderkey, l_linenumber, 'rep' || (l_linenumber % 2)::VARCHAR AS chrom, l_partkey::INT + 1 AS pos, CASE WHEN l_partkey % 2 = 0 THEN 'CAT' ELSE 'G' END AS ref, l_returnflag AS flag FROM lineitem)"


def _vcf(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    effect = lambda allele, what, impact: F.concat(F.lit(f"{allele}|{what}|{impact}|gene|id|transcript|feat|protein_coding|1/1|c.1|"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit("|1|2|3|4|"))
    info = F.when(F.col("l_returnflag") == "N", "DP=3").otherwise(F.concat(F.lit("DP=3;ANN="), effect("C", "stop_gained&splice", "HIGH"), F.lit(","), effect("C", "stop_gained", "HIGH"), F.lit(","), effect("T", "missense", "LOW"), F.lit(";ANN=ignored")))
    line = F.concat_ws("\t", F.concat(F.lit("rep"), (F.col("l_linenumber") % 2).cast("string")), (F.col("l_partkey") + 1).cast("string"), F.lit("."), F.when(F.col("l_partkey") % 2 == 0, "CAT").otherwise("G"), F.lit("C,T"), F.lit("."), F.lit("PASS"), info, F.lit("GT"), F.lit("1"))
    lines = l.select(line.alias("value")).unionByName(table(spark, sf, "region").select(F.concat(F.lit("##"), "r_name").alias("value")))
    return vcf_from_lines(lines)


@query(f"SELECT chrom, pos, ref, 'C,T' AS alt, flag <> 'N' AS has_ann, 1 AS genotypes FROM {VCF_SQL}")
def vcf_scan(spark, sf):
    return _vcf(spark, sf).select("chrom", "pos", "ref", "alt", v.has_ann().alias("has_ann"), F.size("genotypes").alias("genotypes"))


@query(f"SELECT DISTINCT l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR || '/' || (pos - 1)::VARCHAR AS key, a[1] AS allele, a[2] AS annotation, a[3] AS impact FROM {VCF_SQL}, (VALUES (['C', 'stop_gained', 'HIGH']), (['C', 'splice', 'HIGH']), (['T', 'missense', 'LOW'])) t(a) WHERE flag <> 'N'")
def vcf_ann_explode(spark, sf):
    return v.ann_rows(_vcf(spark, sf), ["chrom", "pos"]).select(F.col("hgvs_p").alias("key"), "allele", "annotation", "impact").distinct()


@query(f"SELECT chrom, CASE WHEN ref = 'CAT' THEN pos ELSE pos - 1 END AS start, CASE WHEN ref = 'CAT' THEN pos + 2 ELSE pos END AS \"end\", CASE WHEN ref = 'CAT' THEN '' ELSE ref END AS ref, CASE WHEN ref = 'CAT' THEN '' ELSE alt END AS alt FROM {VCF_SQL}, (VALUES ('C'), ('T')) t(alt)")
def vcf_to_zero_based(spark, sf):
    return v.zero_based(_vcf(spark, sf)).select("chrom", "start", "end", "ref", "alt")


@query("SELECT c.l_orderkey AS id, c.l_linenumber AS line, p_type AS ontology FROM lineitem c JOIN (SELECT DISTINCT p_partkey, p_type FROM part WHERE p_size < 25) p ON c.l_partkey = p_partkey WHERE l_returnflag <> 'N' OR p_partkey % 2 = 0")
def annotation_attach(spark, sf):
    """Annotations of parts; a call of flag N is a deletion, and so are the annotations of even parts."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    c = l.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.lit("r").alias("replicon"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 1).alias("end"), F.lit("G").alias("ref"), F.when(F.col("l_returnflag") == "N", " ").otherwise("T").alias("alt"))
    p = table(spark, sf, "part").where("p_size < 25").select(F.lit("r").alias("replicon"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + 1).alias("end"), F.lit("G").alias("ref"), F.col("p_type").alias("ontology"), F.explode(F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("T"), F.lit(""))).otherwise(F.array(F.lit("T")))).alias("alt"))
    return v.annotated(c, p).select("id", "line", "ontology")


@query("SELECT chrom, pos, ref, alt, string_agg(DISTINCT sample, ',' ORDER BY sample) AS samples FROM (SELECT 'rep' AS chrom, l_partkey AS pos, l_linestatus AS ref, l_returnflag AS alt, 's' || (l_orderkey % 50)::VARCHAR AS sample FROM lineitem) GROUP BY ALL")
def genotype_merge(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), (F.col("l_orderkey") % 50).cast("string")).alias("sample"), F.lit("rep").alias("chrom"), F.col("l_partkey").alias("pos"), F.col("l_linestatus").alias("ref"), F.col("l_returnflag").alias("alt"))
    return v.merged_genotypes(rows).withColumn("samples", F.array_join("samples", ","))


VCF_ROWS = """WITH c AS (SELECT 's' || (l_orderkey % 3)::VARCHAR AS id, 'rep' AS chrom, l_partkey AS start, CASE WHEN l_returnflag = 'N' THEN '' WHEN l_returnflag = 'R' THEN l_linestatus || 'RA' ELSE 'A' END AS alt, l_linestatus AS ref FROM lineitem),
s AS (SELECT * FROM c WHERE alt <> ''), a AS (SELECT chrom, start, ref, list_sort(list(DISTINCT alt)) AS alts FROM s GROUP BY ALL),
g AS (SELECT s.*, a.alts, list_position(a.alts, s.alt)::VARCHAR AS gt FROM s JOIN a USING (chrom, start, ref))
SELECT chrom, start + 1 AS pos, ref, array_to_string(alts, ',') AS alt, coalesce(min(gt) FILTER (id = 's0'), '0') AS s0, coalesce(min(gt) FILTER (id = 's1'), '0') AS s1, coalesce(min(gt) FILTER (id = 's2'), '0') AS s2 FROM g GROUP BY ALL
UNION ALL SELECT chrom, start, 'N' || ref, 'N', coalesce(min('1') FILTER (id = 's0'), './.'), coalesce(min('1') FILTER (id = 's1'), './.'), coalesce(min('1') FILTER (id = 's2'), './.') FROM c WHERE alt = '' GROUP BY chrom, start, ref"""


@query(VCF_ROWS)
def vcf_rows(spark, sf):
    """Genotypes of three samples; deletions are anchored on a reference of N."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    c = l.select(F.concat(F.lit("s"), (F.col("l_orderkey") % 3).cast("string")).alias("id"), F.lit("rep").alias("replicon"), F.col("l_partkey").alias("start"), F.col("l_linestatus").alias("ref"), F.when(F.col("l_returnflag") == "N", "").when(F.col("l_returnflag") == "R", F.concat("l_linestatus", F.lit("RA"))).otherwise("A").alias("alt"))
    longest = l.agg(F.max("l_partkey").alias("n")).select(F.lit("rep").alias("replicon"), F.expr("repeat('N', cast(n AS INT) + 1)").alias("sequence"))
    return v.vcf_rows(c, longest, ["s0", "s1", "s2"])


RECORDS = "(SELECT l_orderkey AS id, l_partkey::INT AS pos, l_returnflag AS flag, l_linenumber AS line FROM lineitem)"


def _records(spark, sf):
    """An aligner record for each order: substitutions at its parts of flag A, deletions of 3 at those of flag N, insertions at those of flag R."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")  # noqa: E741
    # Lines are dealt out once, by their order: both groupings are within tasks.
    l = l.repartition(max(tasks(l), spark.sparkContext.defaultParallelism), "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.min("l_returnflag").alias("l_returnflag"))  # noqa: E741
    pos = F.col("l_partkey")
    pick = lambda flag, s: F.collect_list(F.when(F.col("l_returnflag") == flag, s))
    return l.groupBy("l_orderkey").agg(
        pick("A", F.struct(pos.alias("pos"), F.lit("C").alias("refNuc"), F.lit("T").alias("qryNuc"))).alias("substitutions"),
        pick("N", F.struct(F.struct(pos.alias("begin"), (pos + 3).alias("end")).alias("range"))).alias("deletions"),
        pick("R", F.struct(pos.alias("pos"), F.lit("GG").alias("ins"))).alias("insertions"),
        pick("N", F.struct(F.array(F.struct((pos + 3 + pos % 2).alias("begin"))).alias("nucAbs"))).alias("frameShifts")).withColumn("l_orderkey", F.col("l_orderkey").cast("string")).withColumnRenamed("l_orderkey", "seqId")


def _reference(spark, sf):
    """As many bases as the parts need."""
    return table(spark, sf, "lineitem").agg(F.max("l_partkey").alias("n")).select(F.expr("repeat('A', cast(n AS INT) + 4)").alias("sequence"))


@query("""SELECT l_orderkey::VARCHAR AS id, l_partkey::INT AS start, CASE WHEN l_returnflag = 'N' THEN l_partkey::INT + 3 ELSE l_partkey::INT + 1 END AS "end", CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'N' THEN 'AAA' ELSE 'A' END AS ref, CASE l_returnflag WHEN 'A' THEN 'T' WHEN 'N' THEN '' ELSE 'AGG' END AS alt
FROM (SELECT l_orderkey, l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1)""")
def aligner_json_nt(spark, sf):
    """Calls of the records, of parts that an order has once."""
    once = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id"), F.col("l_partkey").cast("int").alias("start")).agg(F.count("*").alias("n")).where("n = 1")
    found = v.aligner_nt(cut(_records(spark, sf)), "rep", _reference(spark, sf))
    return found.join(once, ["id", "start"], "left_semi").select("id", "start", "end", "ref", "alt")


AA_UNITS = "(SELECT l_orderkey::VARCHAR AS id, l_partkey::INT AS p, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)"
AA_SQL = f"""WITH u AS MATERIALIZED (SELECT * FROM {AA_UNITS}),
    ends AS (SELECT DISTINCT id, p + 3 + p % 2 AS e FROM u WHERE f = 'N'),
    calls AS (SELECT id, p, f, row_number() OVER (PARTITION BY id ORDER BY p) AS number, CASE f WHEN 'N' THEN p + 3 WHEN 'R' THEN p + 1 END AS at FROM u),
    shifted AS (SELECT c.*, e.e IS NOT NULL AS fs FROM calls c LEFT JOIN ends e ON e.id = c.id AND e.e = c.at),
    muts AS (SELECT id, p AS nt, p // 3 + i AS pos FROM u, (VALUES (0), (1)) t(i) WHERE f = 'N'),
    gone AS (SELECT id, pos, min(nt) AS nt FROM muts GROUP BY 1, 2),
    runs AS (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS run FROM gone),
    tries AS (SELECT r.id, r.run, r.pos, o.turn, s.number, s.fs FROM runs r, (VALUES (0, 0), (1, 1), (2, 2), (3, 3), (4, -1), (5, -2), (6, -3)) o(turn, off) JOIN shifted s ON s.id = r.id AND s.p = r.nt + o.off),
    found AS (SELECT id, run, arg_min(number, pos * 10 + turn) AS number, arg_min(fs, pos * 10 + turn) AS fs FROM tries GROUP BY 1, 2),
    moved AS (SELECT id, min(number) AS number FROM shifted WHERE f = 'N' AND fs GROUP BY 1),
    dels AS (SELECT r.id, min(pos) AS a, max(pos) + 1 AS b, repeat('K', count(*)::INT) AS ref, '' AS alt, any_value(coalesce(f.number, m.number)) AS parent, any_value(coalesce(f.fs, m.number IS NOT NULL)) AS fs
        FROM runs r LEFT JOIN found f USING (id, run) LEFT JOIN moved m ON m.id = r.id GROUP BY r.id, r.run),
    subs AS (SELECT id, p // 3 AS a, p // 3 + 1 AS b, 'K' AS ref, 'R' AS alt, number AS parent, fs FROM shifted WHERE f = 'A')"""


@query(f"""{AA_SQL} SELECT id, 'g' AS cds, a::INT AS start, b::INT AS "end", ref, alt, array_to_string(list_sort(list(DISTINCT parent)), ',') AS parents, max(fs::INT) AS frameshift,
    CASE WHEN alt <> '' THEN ref || b::VARCHAR || alt WHEN b - a = 1 THEN 'del:' || b::VARCHAR ELSE 'del:' || (a + 1)::VARCHAR || '-' || b::VARCHAR END AS label
    FROM (SELECT * FROM dels UNION ALL SELECT * FROM subs) GROUP BY id, a, b, ref, alt""")
def aligner_json_aa(spark, sf):
    """Residue variants of the records: three adjacent residues are deleted at each deletion, one changes at each substitution."""
    own = cut(_records(spark, sf))
    aa = lambda p, i, qry: F.struct(F.lit("g").alias("cdsName"), (F.floor(p / 3) + i).alias("pos"), F.lit("K").alias("refAa"), F.lit(qry).alias("qryAa"))
    gone = F.transform("deletions", lambda d: F.struct(d["range"]["begin"].cast("string").alias("key"), F.array(aa(d["range"]["begin"], 0, "-"), aa(d["range"]["begin"], 1, "-")).alias("value")))
    subs = F.transform("substitutions", lambda s: F.struct(s["pos"].cast("string").alias("key"), F.array(aa(s["pos"], 0, "R")).alias("value")))
    none = "array<struct<cds: string, pos: bigint, ins: string>>"
    groups = "array<struct<name: string, changes: array<struct<pos: bigint, nucPos: bigint, refAa: string, qryAa: string, nucRanges: array<struct<begin: bigint, end: bigint>>>>>>"
    records = own.withColumns({"nucToAaMuts": F.map_from_entries(F.concat(gone, subs)), "aaInsertions": F.array().cast(none), "aaChangesGroups": F.array().cast(groups)})
    found = v.aligner_aa(records, v.aligner_nt(own, "rep", _reference(spark, sf)))
    return found.select("id", "cds", "start", "end", "ref", "alt", "parents", "frameshift", "label")
