"""Tables from files: sequences, metadata, aligner output, variant calls, lineages."""

from __future__ import annotations

import io
import lzma
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import completed_date, deleted, header_id, json_field


def _fasta_records(records: DataFrame, column: str = "value") -> DataFrame:
    """header, id and sequence (lines joined) of texts that each hold one record without its `>`."""
    own = F.regexp_replace(F.col(column), "\r", "")
    header = F.trim(F.substring_index(own, "\n", 1))
    body = F.when(F.contains(own, F.lit("\n")), F.regexp_replace(F.expr(f"substring(regexp_replace({column}, '\\r', ''), length(substring_index(regexp_replace({column}, '\\r', ''), '\\n', 1)) + 2)"), r"\s+", "")).otherwise("")
    return records.where(F.trim(F.col(column)) != "").select(header.alias("header"), header_id(header).alias("id"), body.alias("sequence"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """header, id and sequence of plain and gzip files; records are split by the reader, so large plain files are read in parts."""
    return _fasta_records(spark.read.option("lineSep", ">").text(path))


def _unpacked(content: bytes) -> bytes:
    if content[:6] == b"\xfd7zXZ\x00":
        return lzma.decompress(content)
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if len(names) != 1:
                raise ValueError(f"a zip of one file is needed, {len(names)} are in it")
            return z.read(names[0])
    if content[:2] == b"\x1f\x8b":
        import gzip

        return gzip.decompress(content)
    return content


def packed_fasta(files: DataFrame) -> DataFrame:
    """As read_fasta, from the contents (content: bytes) of plain, gzip, xz and single-file zip files, told apart by content. One file is one task's work: for many files."""

    def unpack(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                records = _unpacked(bytes(content)).decode("utf-8", "replace").split(">")
                for at in range(0, len(records), 1000):
                    yield pd.DataFrame({"value": records[at : at + 1000]})

    return _fasta_records(files.select("content").mapInPandas(unpack, "value string"))


def read_packed_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return packed_fasta(spark.read.format("binaryFile").load(path))


def read_metadata(spark: SparkSession, path: str | list[str], columns: list[str], sep: str = "\t") -> DataFrame:
    """Columns of a delimited file with a header, all as text, empty ones as null. columns: all columns of the file, in order."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=False)
    return raw.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in columns))


def renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The mapped columns under their properties' names (mapping: property to column)."""
    return df.select(*(F.col(f"`{c}`").alias(p) for p, c in mapping.items()))


ALIGNER_SCHEMA = """seqId string, substitutions array<struct<pos: bigint, refNuc: string, qryNuc: string>>, deletions array<struct<range: struct<begin: bigint, end: bigint>>>,
    insertions array<struct<pos: bigint, ins: string>>, frameShifts array<struct<nucAbs: array<struct<begin: bigint, end: bigint>>>>,
    nucToAaMuts map<string, array<struct<cdsName: string, pos: bigint, refAa: string, qryAa: string>>>, aaInsertions array<struct<cds: string, pos: bigint, ins: string>>,
    aaChangesGroups array<struct<name: string, changes: array<struct<pos: bigint, nucPos: bigint, refAa: string, qryAa: string, nucRanges: array<struct<begin: bigint, end: bigint>>>>>>"""


def read_aligner_json(spark: SparkSession, path: str, form: str = "lines") -> DataFrame:
    """Aligner records of a JSON-lines file (lines that are no JSON are skipped), a `list`, or an object with `results`."""
    if form == "lines":
        return spark.read.schema(ALIGNER_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("seqId IS NOT NULL")
    if form == "list":
        return spark.read.schema(ALIGNER_SCHEMA).json(path, multiLine=True)
    whole = T.StructType([T.StructField("results", T.ArrayType(T.StructType.fromDDL(ALIGNER_SCHEMA)))])
    return spark.read.schema(whole).json(path, multiLine=True).select(F.explode("results").alias("r")).select("r.*")


def vcf_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The nine fixed columns of VCF lines and the genotypes behind them; an alt of `.` is null."""
    f = F.split(F.col(column), "\t")
    get = lambda i: F.get(f, F.lit(i))
    return lines.where(~F.startswith(F.col(column), F.lit("#")) & (F.trim(F.col(column)) != "")).select(get(0).alias("chrom"), get(1).cast("int").alias("pos"), get(2).alias("vcf_id"), get(3).alias("ref"), F.nullif(get(4), F.lit(".")).alias("alt"), get(5).alias("qual"), get(6).alias("filter"), get(7).alias("info"), get(8).alias("format"), F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))).alias("genotypes"))


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return vcf_from_lines(spark.read.text(path))


def informative_variants(variants: DataFrame, include_nx: bool = False) -> DataFrame:
    """Variant rows (type nt or cds, alt) with empty text for null and blank alts, less those with N or X in their alt unless asked for."""
    own = variants.withColumn("alt", F.when(deleted("alt"), "").otherwise(F.col("alt")))
    unclear = F.contains("alt", F.when(F.col("type") == "nt", "N").otherwise("X"))
    return own if include_nx else own.where(~unclear)


def read_variants(spark: SparkSession, path: str, include_nx: bool = False) -> DataFrame:
    return informative_variants(spark.read.parquet(path), include_nx)


def read_lineages(spark: SparkSession, path: str) -> DataFrame:
    """lineage, children (comma list or none) and seq of a lineage table."""
    return spark.read.csv(path, sep="\t", header=True, schema="lineage string, children string").withColumn("seq", F.monotonically_increasing_id())


def read_clades(spark: SparkSession, paths: list[str]) -> DataFrame:
    """clade, gene, site, alt and seq of designation files, one after the other."""
    out = None
    for i, path in enumerate(paths):
        own = spark.read.csv(path, sep="\t", header=True, schema="clade string, gene string, site string, alt string").withColumn("seq", F.monotonically_increasing_id() + F.lit(i << 50))
        out = own if out is None else out.unionByName(own)
    return out


def read_json_lineages(spark: SparkSession, path: str) -> DataFrame:
    """lineage, parent and seq of a JSON list of {name, parent}, or of an object with such a list as lineages."""
    item = "struct<name: string, parent: string>"
    raw = spark.read.text(path, wholetext=True).select(F.coalesce(F.from_json(F.get_json_object("value", "$.lineages"), f"array<{item}>"), F.from_json("value", f"array<{item}>")).alias("x"))
    return raw.select(F.posexplode("x").alias("seq", "x")).select(F.col("x.name").alias("lineage"), F.col("x.parent").alias("parent"), "seq")


def lineage_notes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lineages of a notes table: the first word of the first column; withdrawn ones (with *) are left out."""
    name = F.substring_index(F.substring_index(F.col(column), "\t", 1), " ", 1)
    return lines.select(name.alias("lineage")).where((F.col("lineage") != "") & ~F.startswith("lineage", F.lit("*")) & (F.lower("lineage") != "lineage"))


def id_list(spark: SparkSession, ids: list[str], path: str | None = None) -> DataFrame:
    """Trimmed unique ids, from a list and the lines of a file."""
    own = spark.createDataFrame([(x,) for x in ids], "id string")
    every = own if path is None else own.unionByName(spark.read.text(path).toDF("id"))
    return every.select(F.trim("id").alias("id")).where("id != ''").distinct()


def first_of(columns: list[str], available: list[str]) -> Column:
    """The first of several columns that holds data; columns that the input lacks are passed over."""
    own = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns if c in available]
    return F.coalesce(*own) if own else F.lit(None).cast("string")


def harmonised_a(raw: DataFrame, targets: dict[str, list[str]], constants: dict[str, str], dates: list[str], typing: tuple[str, str] | None = None, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """Metadata with the first filled column for each target, constants and a field of a JSON cell; and the cells that could not be read.

    typing: (target, column of a JSON array with genomic_typing_result).
    """
    out = raw.select(*(first_of(cs, raw.columns).alias(t) for t, cs in targets.items()), *(F.lit(v).alias(t) for t, v in constants.items()), *([json_field(typing[1], "genomic_typing_result").alias(typing[0])] if typing else []))
    bad = [F.when(F.col(d).isNotNull() & F.col(d).try_cast("date").isNull(), F.struct(F.lit(d).alias("column"), F.col(d).alias("value"))) for d in dates]
    errors = out.select(key, F.explode(F.array_compact(F.array(*bad))).alias("e")).select(key, "e.*")
    return out.withColumns({d: F.col(d).try_cast("date") for d in dates}), errors


def harmonised_b(records: DataFrame, names: dict[str, str], dates: list[str], key: str, order: str = "seq") -> DataFrame:
    """Records with renamed columns (old to new) and completed dates; the first record of each key."""
    own = records.select(*(F.col(old).alias(new) for old, new in names.items()), order)
    first = own.groupBy(key).agg(F.min_by(F.struct(*[c for c in own.columns if c != key]), order).alias("x")).select(key, "x.*").drop(order)
    return first.withColumns({d: completed_date(d) for d in dates})
