"""Files from tables: delimited exports, sequences, VCF text, the variant store, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reshape import wide_profiles
from .variant_store import write_variants  # noqa: F401  a writer too


def export(df: DataFrame, path: str, columns: list[str], sep: str = "\t") -> None:
    """The columns as text with a header (an empty table has it too); columns that df lacks are empty."""
    out = df.select(*(F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))
    (out.coalesce(1) if out.isEmpty() else out).write.csv(path, sep=sep, header=True, emptyValue="")


def wide_table(samples: DataFrame, nt: DataFrame, aa: DataFrame, replicons: list[str], cds: list[tuple[str, str]], entity: str = "sample") -> DataFrame:
    """samples with a column of labels for each replicon, and for each replicon and cds (`replicon: cds`). nt: entity, replicon, label; aa has cds too."""
    own = aa.withColumn("place", F.concat_ws(": ", "replicon", "cds")).select(entity, "place", "label")
    out = samples.join(wide_profiles(nt, replicons, entity), entity, "left").join(wide_profiles(own, [f"{r}: {c}" for r, c in cds], entity, "place"), entity, "left")
    return out.fillna("", [*replicons, *(f"{r}: {c}" for r, c in cds)])


def fasta_lines(df: DataFrame, header: str = "id", sequence: str = "sequence", width: int = 80) -> DataFrame:
    """value: records with lines of at most width."""
    wrapped = F.regexp_replace(F.col(sequence), f"(.{{{width}}})(?=.)", "$1\n")
    return df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), wrapped).alias("value"))


def write_fasta(df: DataFrame, path: str, **named) -> None:
    fasta_lines(df, **named).write.text(path)


def vcf_lines(rows: DataFrame, samples: list[str]) -> DataFrame:
    """value and a sort key: a header and a line for each row (chrom, pos, ref, alt, genotypes), in order of chrom and pos."""
    head = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    top = rows.sparkSession.createDataFrame([(0, "", i, "", x) for i, x in enumerate(head)], "k int, chrom string, pos int, ref string, value string")
    dot = F.lit(".")
    body = rows.select(F.lit(1).alias("k"), "chrom", F.col("pos").cast("int").alias("pos"), "ref", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), dot, "ref", "alt", dot, dot, dot, F.lit("GT"), *(F.col(f"`{s}`") for s in samples)).alias("value"))
    return top.unionByName(body)


def write_vcf(rows: DataFrame, path: str, samples: list[str]) -> None:
    """The lines in order; parts of the result follow each other by name."""
    vcf_lines(rows, samples).orderBy("k", "chrom", "pos", "ref").select("value").write.text(path)


def write_reports(written: DataFrame, errors: DataFrame, path: str, key: str = "name") -> None:
    """Lists of the ids that were written and of the cells that could not be read."""
    written.select(F.col(key).cast("string")).distinct().write.mode("overwrite").text(f"{path}/ids")
    (errors.coalesce(1) if errors.isEmpty() else errors).write.mode("overwrite").csv(f"{path}/errors", header=True)
