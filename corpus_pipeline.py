"""The corpus pipeline: STAGES over documents, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainframe.llm.common import cleared, shared_dir, table
from strainframe.llm.line_dedup import line_dedup
from strainframe.llm.mixing import sampled
from strainframe.llm.near_dedup import kept
from strainframe.llm.quality_rules import quality_rules
from strainframe.llm.sentencepiece_codec import encoded

# Every stage carries columns beside doc_id, text, lang, source and n_chars as they are, whatever their names (but for
# n_lines and n_dropped, which line dedup takes for its own and drops), and returns no rows for no rows.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; rows of one doc_id and text are judged alike."""
    at = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    rejected = quality_rules(docs, with_row=True).where(~F.col("kept")).select(F.col("text_row").alias("row")).distinct()
    return docs.select(F.struct("*").alias("doc"), at.alias("row")).join(rejected, "row", "left_anti").select("doc.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their recurring lines, with n_chars of what is left. Null texts stay null; a text may become empty; repeated rows lose equal lines."""
    out = line_dedup(docs)
    return out.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns if c in out.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the least doc_id (null last), then the least text hash; one of repeated rows. Texts without words are alike if equal."""
    return kept(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target shares of tokens; null lang and source are values of their own, texts without words stay, repeated rows stay or go together."""
    return sampled(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of each row that is left. Null and empty texts have no ids."""
    return encoded(docs)


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near dedup", near_stage), ("mixing", mix_stage), ("encoding", encode_stage)]

#: Near-duplicates and the encoder have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name.replace(' ', '_')}"
        # What a stage's operator wrote on its way goes once the stage is written.
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
