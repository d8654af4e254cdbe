"""Deriving variants: from aligned pairs, CIGARs and aligner output to nucleotide and residue variants, and back.

Coordinates are 0-based and half open. A deletion has an empty alt. Tables of calls have: id (of the sequence), replicon, start, end,
ref, alt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import deleted, deletion_label, nt_frameshift, nt_label, residue, reverse_complement
from .scale import cut, dimension, few, side, tasks
from .sketches import hashes

ANN_FIELDS = ("allele", "annotation", "impact", "gene_name", "gene_id", "feature_type", "feature_id", "biotype", "rank", "hgvs_c", "hgvs_p", "cdna_pos", "cds_pos", "aa_pos", "distance", "errors")
# Offsets at which a residue deletion looks for its nucleotide variant, the first hit counts.
PARENT_OFFSETS = (0, 1, 2, 3, -1, -2, -3)


def _joined(order: str, value: str) -> Column:
    """Values of a group in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "")


def calls_from_pairs(pairs: DataFrame) -> DataFrame:
    """id, replicon, start, end, ref, alt from aligned pairs (id, replicon, qry, ref) of equal length with `-` for gaps.

    Only columns that differ leave the row; runs are found among those.
    """
    own = pairs.select("id", "replicon", F.split(F.rtrim("qry"), "").alias("q"), F.split(F.rtrim("ref"), "").alias("r"))
    at = F.filter(F.sequence(F.lit(0), F.size("r") - 1), lambda i: F.get("q", i) != F.get("r", i))
    diff = own.where(F.size("r") > 0).select("id", "replicon", F.explode(F.transform(at, lambda i: F.struct(i.alias("i"), F.get("q", i).alias("q"), F.get("r", i).alias("r"), F.get("q", i - 1).alias("pq"), F.get("r", i - 1).alias("pr")))).alias("x")).select("id", "replicon", "x.*")
    kind = F.when(F.col("q") == "-", "del").when(F.col("r") == "-", "ins").otherwise("snp")
    rows = Window.partitionBy("id", "replicon").orderBy("i")
    marked = diff.withColumn("kind", kind).withColumn("gaps", F.coalesce(F.sum(F.when(F.col("r") == "-", 1).otherwise(0)).over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = F.col("i") - F.row_number().over(Window.partitionBy("id", "replicon", "kind").orderBy("i"))
    runs = marked.withColumn("run", F.when(F.col("kind") == "snp", F.col("i")).otherwise(run)).groupBy("id", "replicon", "kind", "run").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.min("gaps").alias("gaps"), _joined("i", "q").alias("qs"), _joined("i", "r").alias("rs"), F.min_by("pq", "i").alias("pq"), F.min_by("pr", "i").alias("pr"))
    at = F.col("a") - F.col("gaps")
    ins = F.col("kind") == "ins"
    return runs.select("id", "replicon", F.when(ins, at - 1).otherwise(at).cast("int").alias("start"), F.when(ins, at).otherwise(F.col("b") + 1 - F.col("gaps")).cast("int").alias("end"), F.when(ins, F.coalesce(F.nullif("pr", F.lit("-")), F.lit("."))).otherwise(F.col("rs")).alias("ref"), F.when(F.col("kind") == "del", "").when(ins, F.concat(F.coalesce("pq", F.lit("")), "qs")).otherwise(F.col("qs")).alias("alt"))


def calls_from_cigar(rows: DataFrame) -> DataFrame:
    """Calls from (id, replicon, qry, ref, cigar) with operations = M X D I. Bases in M runs are compared, so ambiguous ones become calls.

    Only differences leave the row: sequences are not repeated for operations or bases.
    """
    ops = F.expr("transform(regexp_extract_all(cigar, '[0-9]+[=MXDI]', 0), o -> struct(int(regexp_extract(o, '^[0-9]+', 0)) AS n, right(o, 1) AS op))")
    own = rows.select("id", "replicon", F.split("qry", "").alias("q"), F.split("ref", "").alias("r"), ops.alias("ops"))
    empty = F.from_json(F.lit("[]"), "array<struct<n:int,op:string,rp:int,qp:int>>")
    moves = lambda x, *of: F.when(x["op"].isin(*of), x["n"]).otherwise(0)
    step = lambda acc, x: F.struct((acc["rp"] + moves(x, "=", "M", "X", "D")).alias("rp"), (acc["qp"] + moves(x, "=", "M", "X", "I")).alias("qp"), F.concat(acc["out"], F.array(F.struct(x["n"].alias("n"), x["op"].alias("op"), acc["rp"].alias("rp"), acc["qp"].alias("qp")))).alias("out"))
    placed = own.withColumn("placed", F.aggregate("ops", F.struct(F.lit(0).alias("rp"), F.lit(0).alias("qp"), empty.alias("out")), step)["out"])
    call = lambda start, end, ref, alt: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), ref.alias("ref"), alt.alias("alt"))
    part = lambda a, first, n: F.array_join(F.slice(a, first, n), "")
    same = lambda o: F.filter(F.transform(F.sequence(F.lit(0), o["n"] - 1), lambda d: call(o["rp"] + d, o["rp"] + d + 1, F.get("r", o["rp"] + d), F.get("q", o["qp"] + d))), lambda c: c["ref"] != c["alt"])
    gone = lambda o: F.array(call(o["rp"], o["rp"] + o["n"], part("r", o["rp"] + 1, o["n"]), F.lit("")))
    new = lambda o: F.array(call(o["rp"] - 1, o["rp"], F.when(o["rp"] == 0, ".").otherwise(F.get("r", o["rp"] - 1)), F.when(o["rp"] == 0, part("q", F.lit(1), o["n"])).otherwise(part("q", F.greatest(o["qp"], F.lit(1)), o["n"] + 1))))
    found = F.flatten(F.transform(F.filter("placed", lambda o: (o["op"] != "=") & (o["n"] > 0)), lambda o: F.when(o["op"] == "D", gone(o)).when(o["op"] == "I", new(o)).otherwise(same(o))))
    return placed.select("id", "replicon", F.explode_outer(found).alias("c")).where("c IS NOT NULL").select("id", "replicon", "c.*")


def numbered(calls: DataFrame, after: str | None = None) -> DataFrame:
    """calls with number, by position within each id; after: a column with the number to go on from."""
    n = F.row_number().over(Window.partitionBy("id").orderBy("start", "end", "ref", "alt"))
    return calls.withColumn("number", n if after is None else n + F.col(after))


def labelled(calls: DataFrame) -> DataFrame:
    return calls.withColumns({"frameshift": nt_frameshift("ref", "alt"), "label": nt_label()})


def reconstructed(references: DataFrame, calls: DataFrame) -> DataFrame:
    """id, replicon and the sequence that calls make of the reference (replicon, sequence).

    The reference is spliced between sorted edits, each of which knows how far the edits before it reach, so the work is that of the
    edits and the bases. Of several changes of one base the longest alt stays (an insertion behind a base that is changed too), of equals
    the greatest; a change inside a deletion stays. Changes behind the reference's end, and deletions that end before they start, do nothing.
    """
    gone = deleted("alt")
    edits = calls.where(~gone | (F.col("end") > F.col("start"))).select("id", "replicon", F.col("start").alias("at"), F.when(gone, F.col("end")).otherwise(F.col("start") + 1).alias("to"), F.when(gone, "").otherwise(F.col("alt")).alias("base"))
    # A deletion and a change of one base stay both, the change first.
    one = edits.groupBy("id", "replicon", "at", (F.col("base") == "").alias("gone")).agg(F.max("to").alias("to"), F.max(F.struct(F.length("base").alias("n"), "base")).alias("b"))
    earlier = Window.partitionBy("id", "replicon").orderBy("at", "gone").rowsBetween(Window.unboundedPreceding, -1)
    reach = one.withColumn("from", F.greatest(F.coalesce(F.max("to").over(earlier), F.lit(0)), F.lit(0)))
    by_id = reach.groupBy("id", "replicon").agg(F.array_sort(F.collect_list(F.struct("at", "gone", "from", F.col("b.base").alias("base")))).alias("edits"), F.greatest(F.max("to"), F.lit(0)).alias("reach"))
    # Bytes are cut without a walk over the text; texts that are more than ASCII are cut by characters.
    plain = references.select("replicon", F.length("sequence").alias("n"), F.when(F.length("sequence") == F.octet_length("sequence"), F.col("sequence").cast("binary")).alias("bytes"), F.when(F.length("sequence") != F.octet_length("sequence"), F.col("sequence")).alias("chars"))

    def cut(first: Column, after: Column) -> Column:
        long = F.greatest(after - first, F.lit(0))
        return F.coalesce(F.substring("bytes", first + 1, long).cast("string"), F.substring("chars", first + 1, long))

    parts = F.transform("edits", lambda e: F.concat(cut(e["from"], F.least(e["at"], F.col("n"))), F.when(e["at"] < F.col("n"), e["base"]).otherwise("")))
    return by_id.join(plain, "replicon").select("id", "replicon", F.concat(F.array_join(parts, ""), cut(F.col("reach"), F.col("n"))).alias("sequence"))


def reconstruction_failures(references: DataFrame, calls: DataFrame, originals: DataFrame) -> DataFrame:
    """id and replicon of the originals (id, replicon, sequence) that calls do not make of the reference."""
    made = reconstructed(references, calls).withColumn("made", F.sha2(F.col("sequence").cast("binary"), 256)).drop("sequence")
    plain = references.select("replicon", F.sha2(F.col("sequence").cast("binary"), 256).alias("plain"))
    return originals.join(made, ["id", "replicon"], "left").join(plain, "replicon").where(F.coalesce("made", "plain") != F.sha2(F.col("sequence").cast("binary"), 256)).select("id", "replicon")


def codon_table(segments: DataFrame, replicons: DataFrame) -> DataFrame:
    """replicon, cds, gene, aa_pos, slot (0-2), pos, base and aa from coding segments (replicon, cds, gene, order, start, end, strand).

    Positions run against the sequence on the reverse strand, where bases are complemented.
    """
    at = F.when(F.col("strand") < 0, F.reverse(F.sequence("start", F.col("end") - 1))).otherwise(F.sequence("start", F.col("end") - 1))
    # Bases are read in the segment's row: the sequence is not repeated for its positions.
    own = segments.join(dimension(replicons.select("replicon", "sequence")), "replicon").withColumn("bases", F.split("sequence", ""))
    each = own.select("replicon", "cds", "gene", "order", "strand", F.explode_outer(F.transform(at, lambda i: F.struct(i.alias("pos"), F.coalesce(F.get("bases", i.cast("int")), F.lit("")).alias("base")))).alias("x")).select("replicon", "cds", "gene", "order", "strand", "x.*")
    step = F.when(F.col("strand") < 0, -F.col("pos")).otherwise(F.col("pos"))
    within = Window.partitionBy("replicon", "cds").orderBy("order", step)
    own = each.withColumn("base", F.when(F.col("strand") < 0, reverse_complement("base")).otherwise(F.col("base")))
    # The other bases of a codon are the rows about a base: one pass, with no grouping to join with.
    near = {f"_{i}": F.coalesce(F.lag("base", -i).over(within), F.lit("")) for i in (-2, -1, 1, 2)}
    placed = own.withColumns({"_rn": F.row_number().over(within) - 1} | near).withColumns({"aa_pos": F.floor(F.col("_rn") / 3).cast("int"), "slot": (F.col("_rn") % 3).cast("int")})
    codon = F.when(F.col("slot") == 0, F.concat("base", "_1", "_2")).when(F.col("slot") == 1, F.concat("_-1", "base", "_1")).otherwise(F.concat("_-2", "_-1", "base"))
    return placed.select("replicon", "cds", "gene", "strand", "aa_pos", "slot", "pos", "base", residue(codon).alias("aa"))


def aa_from_nt(calls: DataFrame, codons: DataFrame) -> DataFrame:
    """Residue variants (id, replicon, cds, gene, start, end, ref, alt, label, parents) from calls with number, and a codon table.

    Alts are placed into codons by an equi-join on positions; a codon whose first base or all of which is deleted is a deleted
    residue, other partial gaps are not reported; adjacent deleted residues are one deletion.
    """
    # Codons are read twice. On disk a codon takes a byte or two, so it's their rows that say whether they are broadcast.
    codons = cut(codons)
    small = few(codons)
    gone = F.transform(F.sequence(F.col("start"), F.col("end") - 1), lambda i: F.struct(i.alias("pos"), F.lit("-").alias("base")))
    changed = F.transform(F.sequence(F.col("start"), F.col("end") - 1), lambda i: F.struct(i.alias("pos"), F.when(F.length("ref") == 1, F.col("alt")).otherwise(F.substring("alt", i - F.col("start") + 1, F.lit(1))).alias("base")))
    placed = calls.where("start >= 0").select("id", "replicon", "number", F.explode(F.when(deleted("alt"), gone).otherwise(changed)).alias("x")).select("id", "replicon", "number", "x.*")
    key = ["replicon", "cds", "aa_pos"]
    hit = placed.join(side(codons.select(*key, "slot", "strand", "pos"), small), ["replicon", "pos"])
    hit = hit.withColumn("base", F.when((F.col("strand") < 0) & (F.col("base") != "-"), reverse_complement("base")).otherwise(F.col("base")))
    one = hit.groupBy("id", *key, "slot").agg(F.max_by("base", F.length("base")).alias("base"), F.collect_set("number").alias("numbers"))
    changes = one.groupBy("id", *key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "base"))).alias("changes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("parents"))
    wide = codons.groupBy("replicon", "cds", "gene", "aa_pos", "aa").agg(F.map_from_entries(F.collect_list(F.struct("slot", "base"))).alias("bases"))
    slot = lambda i: F.coalesce(F.try_element_at("changes", F.lit(i)), F.try_element_at("bases", F.lit(i)), F.lit(""))
    both = changes.join(side(wide, small), key).withColumns({"codon": F.concat(slot(0), slot(1), slot(2)), "first": slot(0)})
    whole = F.col("codon")
    lost = (F.col("first") == "-") | (whole == "---")
    partial = F.contains(whole, F.lit("-")) & ~lost
    long = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(whole) / 3).cast("int") - 1), lambda i: F.coalesce(residue(F.substring(whole, i * 3 + 1, F.lit(3))), F.lit(""))), "")
    alt = F.when(lost, "-").when(F.length(whole) > 3, long).otherwise(residue(whole))
    out = both.where(~partial).withColumn("new", alt).where("new IS NOT NULL AND new != aa AND new != ''")
    subs = out.where("new != '-'").select("id", "replicon", "cds", "gene", F.col("aa_pos").alias("start"), (F.col("aa_pos") + 1).alias("end"), F.col("aa").alias("ref"), F.col("new").alias("alt"), "parents")
    dels = islands(out.where("new = '-'").select("id", "replicon", "cds", "gene", "aa_pos", "aa", "parents"), ["id", "replicon", "cds", "gene"], "aa_pos", "aa")
    every = subs.unionByName(dels)
    return every.withColumn("label", nt_label())


def islands(rows: DataFrame, keys: list[str], pos: str, ref: str) -> DataFrame:
    """Runs of adjacent positions as one deletion each: keys, start, end, ref (joined), alt '' and the union of parents."""
    run = F.col(pos) - F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    more = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("parents")))).alias("parents")] if "parents" in rows.columns else []
    return rows.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(pos).cast("int").alias("start"), (F.max(pos) + 1).cast("int").alias("end"), _joined(pos, ref).alias("ref"), F.lit("").alias("alt"), *more).drop("_run")


def merged_variants(variants: DataFrame, keys: list[str]) -> DataFrame:
    """Variants equal in keys as one: parents joined in order, frameshift if any has it."""
    return variants.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_set("parent")), lambda p: p.cast("string")), ",").alias("parents"), F.max(F.col("frameshift").cast("int")).alias("frameshift"))


def parents_of(variants: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variant, parent) links to calls that exist, and the links that don't. variants: id, variant, parents; calls: id, number."""
    links = variants.select("id", "variant", F.explode("parents").alias("number"))
    return links.join(calls.select("id", "number"), ["id", "number"]), links.join(calls.select("id", "number"), ["id", "number"], "left_anti")


#: Bases of a piece of a reference.
PIECE = 256


def _pieces(references: DataFrame) -> DataFrame:
    """replicon, _piece and _bases of references (replicon, sequence) in pieces, each with the next one behind it: a range of PIECE bases lies in one."""
    each = F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    two = F.transform(F.array(each), lambda p: F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.get(p, i + 1), F.lit("")))))
    return references.select("replicon", F.posexplode(two[0]).alias("_piece", "_bases"))


def _with_bases(rows: DataFrame, references: DataFrame) -> DataFrame:
    """rows (with replicon, _first and _n) and _bases: the n bases of the reference from there on, fewer behind its end.

    Pieces are joined, so no row walks the reference to its place. Ranges longer than a piece are put together once each.
    """
    pieces = dimension(_pieces(references))
    at = F.floor(F.col("_first") / PIECE).cast("int")
    part = lambda first, n: F.substring("_bases", (first - F.col("_piece") * PIECE + 1).cast("int"), n.cast("int"))
    short = rows.where(F.coalesce(F.col("_n"), F.lit(0)) <= PIECE).withColumn("_piece", at).join(pieces, ["replicon", "_piece"], "left").withColumn("_bases", F.coalesce(part(F.col("_first"), F.col("_n")), F.lit(""))).drop("_piece")
    long = rows.where(F.col("_n") > PIECE)
    ranges = long.select("replicon", "_first", "_n").distinct().withColumn("_piece", F.explode(F.sequence(at, F.floor((F.col("_first") + F.col("_n") - 1) / PIECE).cast("int"))))
    start = F.greatest(F.col("_first"), F.col("_piece") * PIECE)
    each = ranges.join(pieces, ["replicon", "_piece"]).withColumn("_bases", part(start, F.least(F.col("_first") + F.col("_n"), (F.col("_piece") + 1) * PIECE) - start))
    whole = each.groupBy("replicon", "_first", "_n").agg(_joined("_piece", "_bases").alias("_bases"))
    return short.unionByName(long.join(whole, ["replicon", "_first", "_n"], "left").withColumn("_bases", F.coalesce("_bases", F.lit(""))))


def aligner_nt(records: DataFrame, replicon: str, sequence: str | DataFrame) -> DataFrame:
    """Calls with number and frameshift from aligner records (seqId, substitutions, deletions, insertions, frameShifts) on one reference sequence, a text or a table of it (sequence)."""
    shifted = lambda pos: F.exists(F.coalesce("frameShifts", F.array()), lambda f: f["nucAbs"][0]["begin"] == pos) if "frameShifts" in records.columns else F.lit(False)
    references = records.sparkSession.createDataFrame([(sequence,)], "sequence string") if isinstance(sequence, str) else sequence.select("sequence")
    references = references.withColumn("replicon", F.lit(replicon))
    own = records.withColumn("id", F.col("seqId"))
    out = ("id", "replicon", "start", "end", "ref", "alt", "frameshift")
    subs = own.select("id", F.explode("substitutions").alias("x")).select("id", F.lit(replicon).alias("replicon"), F.col("x.pos").alias("start"), (F.col("x.pos") + 1).alias("end"), F.col("x.refNuc").alias("ref"), F.col("x.qryNuc").alias("alt"), F.lit(False).alias("frameshift"))
    dels = own.select("*", F.explode("deletions").alias("x")).select("id", F.lit(replicon).alias("replicon"), F.col("x.range.begin").alias("start"), F.col("x.range.end").alias("end"), F.lit("").alias("alt"), shifted(F.col("x.range.end")).alias("frameshift"))
    ins = own.select("*", F.explode("insertions").alias("x")).select("id", F.lit(replicon).alias("replicon"), F.col("x.pos").alias("start"), (F.col("x.pos") + 1).alias("end"), F.col("x.ins").alias("alt"), shifted(F.col("x.pos") + 1).alias("frameshift"))
    placed = _with_bases(dels.withColumn("_new", F.lit(False)).unionByName(ins.withColumn("_new", F.lit(True))).withColumns({"_first": F.col("start"), "_n": F.col("end") - F.col("start")}), references)
    placed = placed.withColumns({"ref": F.col("_bases"), "alt": F.when(F.col("_new"), F.concat("_bases", "alt")).otherwise(F.lit(""))})
    every = subs.select(*out).unionByName(placed.select(*out))
    return numbered(every.select("id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "ref", "alt", "frameshift", "replicon")).withColumn("label", nt_label())


def _lost_residues(gone: DataFrame, at: DataFrame) -> DataFrame:
    """id, cds, start, end, ref and p (parent, frameshift) of runs of adjacent residues. gone: id, cds, pos, ref, nt; at: id, nt, parent, frameshift.

    The call of a run is that of its first residue which has one at an offset of PARENT_OFFSETS, the first of these; of several at one place it's the
    least. Both tables are dealt to tasks once, by id and by rows: a residue looks at the places about its own, and nothing is repeated for its offsets.
    """
    n = max(tasks(at), at.sparkSession.sparkContext.defaultParallelism)
    one = gone.repartition(n, "id").groupBy("id", "cds", "pos").agg(F.min_by("ref", "nt").alias("ref"), F.min("nt").alias("nt"))
    run = F.col("pos") - F.row_number().over(Window.partitionBy("id", "cds").orderBy("pos"))
    lost = one.select("id", F.col("nt").cast("long").alias("place"), F.struct("cds", run.alias("run"), "pos", "ref").alias("lost"))
    known = at.where("id IS NOT NULL AND nt IS NOT NULL").repartition(n, "id").select("id", F.col("nt").cast("long").alias("place"), F.struct("parent", "frameshift").alias("call"))
    place = Window.partitionBy("id").orderBy("place")
    near = lost.unionByName(known, allowMissingColumns=True).withColumn("p", F.coalesce(*(F.min("call").over(place.rangeBetween(o, o)) for o in PARENT_OFFSETS)))
    each = near.where("lost IS NOT NULL").select("id", "p", "lost.*")
    return each.groupBy("id", "cds", "run").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), _joined("pos", "ref").alias("ref"), F.min_by("p", F.when(F.col("p").isNotNull(), F.col("pos"))).alias("p"))


def aligner_aa(records: DataFrame, calls: DataFrame) -> DataFrame:
    """Residue variants from aligner records (seqId, nucToAaMuts, aaInsertions, aaChangesGroups, frameShifts, deletions) and their calls (aligner_nt).

    Deletions of adjacent residues are one; their parent is the call at the nearest offset in PARENT_OFFSETS, or the one that a frame
    shift points to. A residue with an insertion at its place or next to it takes the inserted residues into its alt.
    """
    # Of calls only what residues need is stored.
    calls = cut(calls.select("id", "start", "end", deleted("alt").alias("gone"), "number", "frameshift"))
    muts = records.select(F.col("seqId").alias("id"), F.explode("nucToAaMuts").alias("nt", "list")).select("id", F.col("nt").cast("int").alias("nt"), F.explode("list").alias("x")).select("id", "nt", F.col("x.cdsName").alias("cds"), F.col("x.pos").cast("int").alias("pos"), F.col("x.refAa").alias("ref"), F.col("x.qryAa").alias("qry"))
    at = calls.select("id", F.col("start").alias("nt"), F.col("number").alias("parent"), "frameshift")
    shifts = records.select(F.col("seqId").alias("id"), F.explode("frameShifts").alias("f")).select("id", F.col("f.nucAbs")[0]["begin"].alias("end"))
    shifted = calls.where("gone").join(shifts, ["id", "end"]).groupBy("id").agg(F.min("number").alias("shift_parent"))
    dels = _lost_residues(muts.where("qry = '-'").drop("qry"), at).join(shifted, "id", "left")
    dels = dels.select("id", "cds", "start", "end", "ref", F.lit("").alias("alt"), F.coalesce("p.parent", "shift_parent").alias("parent"), F.coalesce(F.col("p.frameshift"), F.col("shift_parent").isNotNull()).alias("frameshift"))
    added = records.select(F.col("seqId").alias("id"), F.explode("aaInsertions").alias("x")).select("id", F.col("x.cds").alias("cds"), F.col("x.pos").cast("int").alias("ins_pos"), F.col("x.ins").alias("ins"))
    groups = records.select(F.col("seqId").alias("id"), F.explode("aaChangesGroups").alias("g")).select("id", F.col("g.name").alias("cds"), F.explode("g.changes").alias("c"))
    change = groups.select("id", "cds", (F.col("c.pos").cast("int") - 1).alias("ins_pos"), F.col("c.qryAa").alias("c_qry"), F.col("c.refAa").alias("c_ref"), F.col("c.pos").cast("int").alias("c_pos"), (F.col("c.nucPos") + F.col("c.nucRanges")[0]["end"] - F.col("c.nucRanges")[0]["begin"] - 1).cast("int").alias("c_nt"))
    known = cut(added.join(change.groupBy("id", "cds", "ins_pos").agg(*(F.first(c).alias(c) for c in ("c_qry", "c_ref", "c_pos", "c_nt"))), ["id", "cds", "ins_pos"]))
    small = few(known)
    longer = F.when(F.col("c_qry") == "*", F.col("ins")).otherwise(F.concat("c_qry", "ins"))
    own = cut(muts.where("qry != '-'").join(at, ["id", "nt"]))  # read twice
    # Insertions are few: it's they that are repeated for the residues next to them.
    beside = known.select("*", F.posexplode(F.array(F.col("ins_pos"), F.col("ins_pos") + 1, F.col("ins_pos") - 1)).alias("turn", "pos"))
    near = own.select("id", "cds", "pos", "nt").join(side(beside, small), ["id", "cds", "pos"])
    # An insertion goes to the first residue, by nucleotide, that it fits; a residue takes the insertion nearest to it.
    taken = near.withColumn("_r", F.row_number().over(Window.partitionBy("id", "cds", "ins_pos").orderBy("nt", "turn"))).where("_r = 1").withColumn("_s", F.row_number().over(Window.partitionBy("id", "cds", "pos", "nt").orderBy("turn"))).where("_s = 1")
    subs = own.join(side(taken.select("id", "cds", "pos", "nt", longer.alias("longer")), small), ["id", "cds", "pos", "nt"], "left").select("id", "cds", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "ref", F.coalesce("longer", "qry").alias("alt"), "parent", "frameshift")
    rest = at.withColumnRenamed("nt", "c_nt").join(side(known.join(taken, ["id", "cds", "ins_pos"], "left_anti"), small), ["id", "c_nt"]).select("id", "cds", F.col("c_pos").alias("start"), (F.col("c_pos") + 1).alias("end"), F.col("c_ref").alias("ref"), longer.alias("alt"), "parent", "frameshift")
    return merged_variants(dels.unionByName(subs).unionByName(rest), ["id", "cds", "start", "end", "ref", "alt"]).withColumn("label", nt_label())


def peptide_ranges(peptides: DataFrame, codons: DataFrame) -> DataFrame:
    """peptide, cds and the residues (half open) that its nucleotide range covers. peptides: peptide, cds, start, end."""
    inside = peptides.join(codons.select("cds", "pos", "aa_pos"), "cds").where("pos >= start AND pos < end")
    return inside.groupBy("peptide", "cds").agg(F.min("aa_pos").alias("aa_start"), (F.max("aa_pos") + 1).alias("aa_end"))


def bad_lengths(segments: DataFrame) -> DataFrame:
    """cds whose length is no multiple of 3."""
    return segments.groupBy("cds").agg(F.sum(F.col("end") - F.col("start")).alias("length")).where("length % 3 != 0")


def ann_rows(vcf: DataFrame, keys: list[str], info: str = "info") -> DataFrame:
    """keys and the fields of each effect in the first ANN of an INFO text; effects joined by & are rows of their own; duplicates removed."""
    ann = F.filter(F.split(info, ";"), lambda x: F.startswith(x, F.lit("ANN=")))
    each = vcf.select(*keys, F.get(ann, F.lit(0)).alias("ann")).where("ann IS NOT NULL").select(*keys, F.explode(F.split(F.expr("substring(ann, 5)"), ",")).alias("e")).select(*keys, F.split("e", r"\|").alias("f"))
    fields = [F.get("f", F.lit(i)).alias(n) for i, n in enumerate(ANN_FIELDS)]
    rows = each.where(F.size("f") == len(ANN_FIELDS)).select(*keys, *fields)
    return rows.withColumn("annotation", F.explode(F.split("annotation", "&"))).distinct()


def has_ann(info: str = "info") -> Column:
    return F.exists(F.split(info, ";"), lambda x: F.startswith(x, F.lit("ANN=")))


def zero_based(vcf: DataFrame) -> DataFrame:
    """vcf (pos, ref, alt) with one row for each alt and start, end, ref, alt as calls have them; deletions without their anchor."""
    each = vcf.withColumn("alt", F.explode(F.split("alt", ",")))
    gone = F.length("alt") < F.length("ref")
    return each.withColumns({"start": F.when(gone, F.col("pos")).otherwise(F.col("pos") - 1).cast("int"), "end": F.when(gone, F.col("pos") + F.length("ref") - 1).otherwise(F.col("pos")).cast("int"), "ref": F.when(gone, "").otherwise(F.col("ref")), "alt": F.when(gone, "").otherwise(F.col("alt"))})


def annotated(calls: DataFrame, annotations: DataFrame) -> DataFrame:
    """calls with the annotations of their allele: by replicon, start, end and alt, and ref except for deletions."""
    keys = ["replicon", "start", "end", "alt", "k_ref"]
    key = lambda df: df.withColumn("k_ref", F.when(deleted("alt"), "").otherwise(F.col("ref"))).withColumn("alt", F.trim("alt"))
    return key(calls).join(key(annotations).drop("ref"), keys).drop("k_ref")


def vcf_rows(calls: DataFrame, references: DataFrame, samples: list[str]) -> DataFrame:
    """chrom, pos, ref, alt and a genotype column for each of a few samples.

    Substitutions and insertions of one place are one row with several alts (0, 1, 2 ...); a deletion is a row of its own, anchored on
    the base before it, with ./. where a sample does not have it.
    """
    has = [F.max(F.col("id") == s).alias(f"_{i}") for i, s in enumerate(samples)]
    who = F.array(*(f"_{i}" for i in range(len(samples)))).alias("has") if samples else F.array().cast("array<boolean>").alias("has")
    subs = calls.where(~deleted("alt")).where("replicon IS NOT NULL AND start IS NOT NULL AND ref IS NOT NULL").groupBy(F.col("replicon").alias("chrom"), (F.col("start") + 1).alias("pos"), "ref", "alt").agg(F.count("*").alias("_n"), *has)
    place = subs.groupBy("chrom", "pos", "ref").agg(F.array_sort(F.collect_list(F.struct("alt", who))).alias("alts"))
    gt = lambda i: F.array_min(F.transform("alts", lambda x, n: F.when(x["has"][i], (n + 1).cast("string"))))
    sub_rows = place.select("chrom", "pos", "ref", F.array_join(F.transform("alts", lambda x: x["alt"]), ",").alias("alt"), *(F.coalesce(gt(i), F.lit("0")).alias(s) for i, s in enumerate(samples)))
    # Deletions are looked up once for all that have them.
    dels = calls.where(deleted("alt")).groupBy("replicon", "start", "ref").agg(F.count("*").alias("_n"), *has).drop("_n").join(dimension(references.select("replicon").distinct()), "replicon", "left_semi")
    anchored = _with_bases(dels.withColumns({"_first": F.greatest(F.col("start"), F.lit(1)) - 1, "_n": F.lit(1)}), references)
    del_rows = anchored.select(F.col("replicon").alias("chrom"), F.col("start").alias("pos"), F.concat("_bases", "ref").alias("ref"), F.col("_bases").alias("alt"), *(F.when(F.col(f"_{i}"), "1").otherwise("./.").alias(s) for i, s in enumerate(samples)))
    return sub_rows.unionByName(del_rows)


def merged_genotypes(rows: DataFrame) -> DataFrame:
    """Rows of several single-sample files (sample, chrom, pos, ref, alt) as one per allele with its sorted samples."""
    return rows.groupBy("chrom", "pos", "ref", "alt").agg(F.array_sort(F.collect_set("sample")).alias("samples"))


#: The logarithm of the smallest bin of genes and the step between levels of wider ones.
LEAST_LEVEL, LEVEL_STEP = 6, 2
#: The logarithm of the parts that a call looks through one after the other, until it finds a gene.
PART_LEVEL = 3


def _shifted(at: Column, bits: int) -> Column:
    return F.call_function("shiftright", at.cast("long"), F.lit(bits))


def _stairs(genes: Column) -> Column:
    """Of genes (g_start, gene, g_end) in order those that end before all earlier ones: the first that ends by a place is the first of all that do."""
    sooner = lambda acc, g: F.when((F.size(acc) == 0) | (g["g_end"] < F.element_at(acc, -1)["g_end"]), F.concat(acc, F.array(g))).otherwise(acc)
    return F.aggregate(genes, F.filter(genes, lambda g: F.lit(False)), sooner)


def _wide_bins(genes: DataFrame, levels: int) -> DataFrame:
    """replicon, _level, _bin and the stairs of each bin, of levels that are LEVEL_STEP bits wider than the one below; a level is made of the one below."""
    level = cut(genes.groupBy("replicon", F.lit(0).alias("_level"), _shifted(F.col("g_start"), LEAST_LEVEL).alias("_bin")).agg(F.array_sort(F.collect_list(F.struct("g_start", "gene", "g_end"))).alias("_genes")).withColumn("_genes", _stairs(F.col("_genes"))))
    out = level
    for i in range(1, levels):
        level = cut(level.groupBy("replicon", F.lit(i).alias("_level"), _shifted(F.col("_bin"), LEVEL_STEP).alias("_bin")).agg(F.array_sort(F.flatten(F.collect_list("_genes"))).alias("_genes")).withColumn("_genes", _stairs(F.col("_genes"))))
        out = out.unionByName(level)
    return out


def covered_genes(calls: DataFrame, genes: DataFrame) -> DataFrame:
    """calls with the first gene (by start, then name) that each covers as a whole. genes: replicon, gene, start, end.

    A call looks at the genes of the bin that it starts in and of the next one, which are one row, so short calls are joined once and stay where they
    are if the bins are few. Long calls that find none there go on by wider and wider bins, 3 of a level at most, of which only the genes that end before
    all earlier ones are kept: no call meets all the genes that it covers, whatever its length. Repeated calls stay. Calls and genes that end
    before they start, or have a null place, cover nothing and are covered by none.
    """
    place = ["replicon", "start", "end"]
    # Of genes of one place the first, then of one start those that end before all earlier names.
    own = genes.where(F.col("start") <= F.col("end")).groupBy("replicon", F.col("start").alias("g_start"), F.col("end").alias("g_end")).agg(F.min("gene").alias("gene"))
    sooner = F.min("g_end").over(Window.partitionBy("replicon", "g_start").orderBy("gene").rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("_sooner", sooner).where("_sooner IS NULL OR g_end < _sooner").drop("_sooner")
    at, parts = _shifted(F.col("g_start"), LEAST_LEVEL), 2 << (LEAST_LEVEL - PART_LEVEL)
    near = cut(own.withColumn("_bin", F.explode(F.array(at, at - 1))).groupBy("replicon", "_bin").agg(F.array_sort(F.collect_list(F.struct("g_start", "gene", "g_end"))).alias("_genes")).withColumn("_genes", F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.filter("_genes", lambda g: _shifted(g["g_start"], PART_LEVEL) - F.col("_bin") * (parts // 2) == p))))
    looked = calls.where(F.col("start") <= F.col("end")).withColumn("_bin", _shifted(F.col("start"), LEAST_LEVEL))
    span = looked.select(F.max(_shifted(F.col("end"), LEAST_LEVEL) - F.col("_bin")).alias("n")).first()["n"]
    part = (_shifted(F.col("start"), PART_LEVEL) - F.col("_bin") * (parts // 2)).cast("int")
    fits = lambda p: F.get(F.filter(F.get("_genes", part + p), lambda g: (g["g_start"] >= F.col("start")) & (g["g_end"] <= F.col("end"))), F.lit(0))
    first = looked.join(dimension(near), ["replicon", "_bin"], "left" if span is not None and span > 1 else "inner").select(*calls.columns, F.coalesce(*map(fits, range(parts)))["gene"].alias("gene"))
    if span is None or span <= 1:
        return first.where("gene IS NOT NULL")
    first = cut(first)
    levels = 1
    while span >> (LEVEL_STEP * (levels - 1)) > 4:
        levels += 1
    last = _shifted(F.col("end"), LEAST_LEVEL)
    rows, low = [], _shifted(F.col("start"), LEAST_LEVEL) + 2
    for i in range(levels):
        # From the first bin of a level that nothing narrower has, to where a wider one begins.
        wider = _shifted(low + ((1 << LEVEL_STEP) - 1), LEVEL_STEP)
        high = _shifted(last, LEVEL_STEP * i)
        if i < levels - 1:
            high = F.least(wider * (1 << LEVEL_STEP) - 1, high)
        rows.append(F.when(low <= high, F.arrays_zip(F.array_repeat(F.lit(i), (high - low + 1).cast("int")).alias("_level"), F.sequence(low, high).alias("_bin"))).otherwise(F.array().cast("array<struct<_level: int, _bin: bigint>>")))
        low = wider
    left = first.where("gene IS NULL").select(*place).distinct().where(last - _shifted(F.col("start"), LEAST_LEVEL) > 1)
    asked = left.select(*place, F.explode(F.concat(*rows)).alias("x")).select(*place, "x.*")
    met = asked.join(dimension(_wide_bins(own, levels)), ["replicon", "_level", "_bin"]).select(*place, F.get(F.filter("_genes", lambda g: g["g_end"] <= F.col("end")), F.lit(0)).alias("g")).where("g IS NOT NULL")
    far = met.groupBy(*place).agg(F.min(F.struct("g.g_start", "g.gene"))["gene"].alias("gene"))
    return first.where("gene IS NOT NULL").unionByName(first.where("gene IS NULL").drop("gene").join(dimension(far), place).select(*calls.columns, "gene"))


def positions(intervals: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """A row for each position of an interval: the key of an equi-join in place of a range join."""
    return intervals.withColumn("pos", F.explode(F.sequence(F.col(start), F.col(end) - 1)))


def kmers(sequences: DataFrame, k: int = 11) -> DataFrame:
    """id and its distinct k-mers, as 64-bit hashes."""
    return sequences.where(F.length("sequence") >= k).select("id", F.explode(hashes(F.col("sequence"), k)).alias("kmer"))


def best_reference(sequences: DataFrame, references: DataFrame, k: int = 11, least: float = 0.01) -> DataFrame:
    """id, its most similar reference and their k-mer Jaccard likeness; ids without one of at least `least` have nulls. references: id, sequence."""
    own, other = kmers(sequences, k), kmers(references, k).withColumnRenamed("id", "reference")
    sizes = own.groupBy("id").agg(F.count("*").alias("a"))
    ref_sizes = other.groupBy("reference").agg(F.count("*").alias("b"))
    both = own.join(other, "kmer").groupBy("id", "reference").agg(F.count("*").alias("both")).join(sizes, "id").join(ref_sizes, "reference")
    like = both.select("id", "reference", (F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("likeness")).where(F.col("likeness") >= least)
    best = like.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("likeness"), "reference"))).where("_r = 1").drop("_r")
    return sequences.select("id").join(best, "id", "left")


def cds_of_symbols(variants: DataFrame, genes: DataFrame) -> DataFrame:
    """variants with the accession of their gene's coding sequence, by (gene, replicon)."""
    return variants.join(dimension(genes.select("replicon", "gene", "cds")), ["replicon", "gene"], "left")
