"""The engine's tables bound to the test tables: orders are samples, lineitem their calls, events their typed properties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("date").alias("day"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """One call for each line: position is the part, ref the status, alt the flag (N is kept as a base of its own)."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("sample"), F.concat(F.lit("rep"), (F.col("l_linenumber") % 2).cast("string")).alias("replicon"), F.concat(F.lit("g"), (F.col("l_linenumber") % 3).cast("string")).alias("gene"), (F.col("l_partkey") - 1).cast("int").alias("start"), F.col("l_partkey").cast("int").alias("end"), F.col("l_linestatus").alias("ref"), F.col("l_returnflag").alias("alt"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("quantity"))


def placed(spark: SparkSession, sf: str) -> DataFrame:
    """Where a sample belongs: nation as replicon, region as reference."""
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    dims = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.select("o_orderkey", "o_custkey").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("sample"), F.col("n_name").alias("replicon"), F.col("r_name").alias("reference"))


def eav(spark: SparkSession, sf: str) -> DataFrame:
    """Typed properties of events: kind (text), value (float) and k (integer, from JSON)."""
    e = table(spark, sf, "events")
    row = lambda name, i, f, t: F.struct(F.lit(name).alias("name"), i.alias("value_integer"), f.alias("value_float"), t.alias("value_varchar"))
    none = lambda t: F.lit(None).cast(t)
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = F.array(row("k", k, none("double"), none("string")), row("score", none("bigint"), F.col("value"), none("string")), row("kind", none("bigint"), none("double"), F.col("event_type")))
    return e.select(F.col("event_id").alias("sample"), F.explode(rows).alias("x")).select("sample", "x.*")


def eav_text(spark: SparkSession, sf: str) -> DataFrame:
    """The properties with one value column, as text; floats by whole numbers."""
    return eav(spark, sf).select("sample", "name", F.coalesce(F.col("value_integer").cast("string"), F.floor("value_float").cast("string"), "value_varchar").alias("value")).where("value IS NOT NULL")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """A tree over customers: the parent of n is n div 2; one reference."""
    c = table(spark, sf, "customer")
    name = lambda k: F.concat(F.lit("L"), k.cast("string"))
    key = F.col("c_custkey")
    return c.select(name(key).alias("lineage"), F.when(key > 1, name(F.expr("c_custkey div 2"))).alias("parent"), F.lit("ref").alias("reference"))


def pseudo(c: Column) -> Column:
    """32 bases from a text."""
    return F.translate(F.md5(c), "0123456789abcdef", "ACGTACGTACGTACGT")


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), pseudo(F.col("text")).alias("sequence"))


def tables(spark: SparkSession, sf: str, **more) -> Tables:
    return Tables(samples=samples(spark, sf), nt=calls(spark, sf), aa=calls(spark, sf), placed=placed(spark, sf), eav_columns={"k": "value_integer", "score": "value_float", "kind": "value_varchar"}, **more)


# SQL of the bindings.
SAMPLES = "(SELECT o_orderkey AS sample, o_custkey AS cust, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price, o_orderdate::DATE AS day FROM orders)"
CALLS = "(SELECT l_orderkey AS sample, 'rep' || (l_linenumber % 2)::VARCHAR AS replicon, 'g' || (l_linenumber % 3)::VARCHAR AS gene, (l_partkey - 1)::INT AS start, l_partkey::INT AS \"end\", l_linestatus AS ref, l_returnflag AS alt, l_linenumber AS line, l_quantity::INT AS quantity FROM lineitem)"
PLACED = "(SELECT o_orderkey AS sample, n_name AS replicon, r_name AS reference FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
EAV = """(SELECT event_id AS sample, 'k' AS name, (props->>'$.k')::BIGINT AS value_integer, NULL::DOUBLE AS value_float, NULL::VARCHAR AS value_varchar FROM events
    UNION ALL SELECT event_id, 'score', NULL, value, NULL FROM events UNION ALL SELECT event_id, 'kind', NULL, NULL, event_type FROM events)"""
EAV_TEXT = f"(SELECT sample, name, coalesce(value_integer::VARCHAR, floor(value_float)::BIGINT::VARCHAR, value_varchar) AS value FROM {EAV} WHERE coalesce(value_integer::VARCHAR, value_float::VARCHAR, value_varchar) IS NOT NULL)"
EDGES = "(SELECT 'L' || c_custkey::VARCHAR AS lineage, CASE WHEN c_custkey > 1 THEN 'L' || (c_custkey // 2)::VARCHAR END AS parent, 'ref' AS reference FROM customer)"
SEQUENCES = "(SELECT doc_id AS id, translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence FROM documents)"


def nt(pos: int, alt: str, ref: str = "F", **more) -> dict:
    return {"label": "SNP Nt", "ref_nuc": ref, "ref_pos": pos, "alt_nuc": alt, **more}
