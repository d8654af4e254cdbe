"""The variant store: rows of each distinct sequence once, laid out along a space-filling curve.

A row's place is the Morton key of its start and its allele's hash, so a file holds a rectangle of both: a region and an allele each
lie in few files. Rows are dealt to files by ranges of (reference, key, sequence), which splits an allele that most sequences carry. The number of
files comes from the number of rows. A manifest beside the data has what each file spans; reads by region or allele open only the files that it
names, and all files where there is no manifest (a write that ended before it). Files have Bloom filters on seqhash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import cut, dropped

KEYS = ("seqhash", "refhash", "start", "end", "ref", "alt", "type")
#: Bits of each side of a Morton key; rows of a file; places that the manifest tells apart on each side.
BITS, ROWS_A_FILE = 16, 4_000_000
MANIFEST = "_manifest"
#: Steps that spread the low 16 bits of a number to its even places: shift and mask. Fixed values.
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def spread(c: Column) -> Column:
    out = c.cast("long").bitwiseAND(F.lit(0xFFFF))
    for by, mask in SPREAD:
        out = out.bitwiseOR(F.shiftleft(out, by)).bitwiseAND(F.lit(mask))
    return out


def morton(x: Column, y: Column) -> Column:
    """The bits of two numbers of BITS bits, in turn; x has the higher of each two."""
    return F.shiftleft(spread(x), 1).bitwiseOR(spread(y))


def allele_place(start: Column, ref: Column, alt: Column) -> Column:
    """Where an allele lies on the curve's second side."""
    return F.xxhash64(start.cast("long"), F.coalesce(ref, F.lit("")), F.coalesce(alt, F.lit(""))).bitwiseAND(F.lit((1 << BITS) - 1))


def start_place(start: Column, last: int) -> Column:
    """Where a start lies on the curve's first side, whose end is the last start."""
    return F.greatest(F.lit(0).cast("long"), F.floor(start.cast("double") * (1 << BITS) / (last + 1)).cast("long"))


def write_variants(variants: DataFrame, path: str, rows_a_file: int = ROWS_A_FILE) -> None:
    """Replaces the store at path by the distinct variants. The commit protocol makes the replacement whole; the manifest follows."""
    spark, keys = variants.sparkSession, [c for c in KEYS if c in variants.columns]
    own = cut(variants.dropDuplicates(keys))
    try:
        rows, last = own.agg(F.count("*"), F.coalesce(F.max("start"), F.lit(0))).first()
        files = max(1, -(-rows // rows_a_file))
        placed = own.withColumn("_at", morton(start_place(F.col("start"), last), allele_place(F.col("start"), F.col("ref"), F.col("alt"))))
        dealt = placed.repartitionByRange(files, "reference_acc", "_at", F.xxhash64("seqhash")).sortWithinPartitions("reference_acc", "_at").drop("_at")
        (
            dealt.write.mode("overwrite").partitionBy("reference_acc").option("compression", "zstd")
            .option("parquet.bloom.filter.enabled#seqhash", "true").option("parquet.bloom.filter.expected.ndv#seqhash", str(max(1000, min(rows, rows_a_file)))).parquet(path)
        )
    finally:
        dropped(own)
    if rows:
        allele = allele_place(F.col("start"), F.col("ref"), F.col("alt"))
        spans = spark.read.parquet(path).groupBy("reference_acc", F.input_file_name().alias("file")).agg(F.min("start").alias("first"), F.max("start").alias("last"), F.min(allele).alias("low"), F.max(allele).alias("high"), F.count("*").alias("rows"))
        spans.coalesce(1).write.parquet(f"{path}/{MANIFEST}")


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """reference_acc, file, first and last start, low and high place of alleles, and rows of each file; None where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(f"{path}/{MANIFEST}")


def _opened(spark: SparkSession, path: str, meets: Column, rows: Column) -> DataFrame:
    """The rows that meet a condition, from the files whose spans meet another."""
    spans, whole = manifest(spark, path), spark.read.parquet(path)
    if spans is None:
        return whole.where(rows)
    files = [r.file for r in spans.where(meets).select("file").collect()]
    return (spark.read.schema(whole.schema).option("basePath", path).parquet(*files) if files else whole.limit(0)).where(rows)


def read_region(spark: SparkSession, path: str, reference: str, first: int, last: int) -> DataFrame:
    """The variants of a reference that start from first to last."""
    here = F.col("reference_acc") == reference
    return _opened(spark, path, here & (F.col("first") <= last) & (F.col("last") >= first), here & F.col("start").between(first, last))


def read_allele(spark: SparkSession, path: str, reference: str, start: int, ref: str, alt: str) -> DataFrame:
    """The rows of one variant of a reference: which sequences carry it."""
    here = F.col("reference_acc") == reference
    place = allele_place(F.lit(start), F.lit(ref), F.lit(alt))
    return _opened(spark, path, here & (F.col("first") <= start) & (F.col("last") >= start) & (F.col("low") <= place) & (F.col("high") >= place), here & (F.col("start") == start) & (F.col("ref") == ref) & (F.col("alt") == alt))
