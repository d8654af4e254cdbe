"""Mixing sources to target weights (operator 2): iterative proportional fitting, with DataFrame functions only.

Documents fall into cells of source, language and topic (the register of the text). The cells' token counts are raked until
their sums by source, by language and by topic have the target shares. mix() keeps a document with probability min(1, rate x
raked / present tokens of its cell), by a hash of its id, with the weight that makes up for what sampling could not do.
sampled() returns documents without weights, so its fit is bounded: no cell is raked beyond what it has, and the sum is
the largest at which every value of a target share of LEAST_SHARE or more can reach it; smaller ones are taken whole if need be.

Targets are shares by value; without them a dimension's present shares to the power of its temperature, so large
sources shrink. Defined results: a null or empty text has no tokens and topic "empty"; null source and lang are values of their own ("");
cells without tokens are kept whole with weight 1; repeated rows are kept or dropped together; a value without a target keeps its share;
one with the target 0 loses all its documents with tokens; targets that are all 0 give no documents with tokens; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import met, small_enough, table, written

WORD = r"[^\x20\x09-\x0D]+"
TEMPERATURES = {"source": 0.5, "lang": 0.5, "topic": 0.7}
ROUNDS = 10
RATE = 1.0
SEED = "mix"
#: Cells that one task rakes; more are summed by value and joined with the sums.
BOUNDED_CELLS = 100_000
#: Passes of ROUNDS rounds end when all sums are as near to their goals, or after so many.
TOLERANCE, PASSES = 1e-4, 3
LEAST_SHARE = 0.02


def topic(text: Column, tokens: Column) -> Column:
    count = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    return (
        F.when(tokens == 0, "empty").when(5 * count("|") >= tokens, "table").when(5 * count("!") >= tokens, "shout").when(3 * count("#*$%&") >= tokens, "markup")
        .when(tokens < 50, "note").when(tokens > 1000, "long").otherwise("prose")
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, row, source, lang, topic and tokens of each document."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")), text.alias("text"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"))
    return own.select("doc_id", "source", "lang", topic(F.col("text"), F.col("tokens")).alias("topic"), "tokens")


def goals(cells: DataFrame, targets: dict[str, dict[str, float]] | None, total: float) -> dict[str, DataFrame]:
    """For each dimension its values' present tokens and goal shares, which sum to 1."""
    out = {}
    for dim, power in TEMPERATURES.items():
        present = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("present"))
        given = (targets or {}).get(dim)
        if given:
            wish = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in given.items() for x in (k, float(v)))), F.col(dim)) * total, "present")
        else:
            wish = F.pow("present", F.lit(power))
        present = written(present.withColumn("wish", wish), "goals")
        wishes = present.agg(F.sum("wish")).first()[0] or 0.0
        out[dim] = present.select(dim, F.col("present").alias(f"present_{dim}"), (F.col("wish") / wishes if wishes else F.lit(0.0)).alias(f"goal_{dim}"))
    return out


def _summed(out: DataFrame, dim: str, together: bool) -> DataFrame:
    """out with the sum of raked over each value of dim."""
    if together:
        return out.withColumn("_sum", F.sum("raked").over(Window.partitionBy(dim)))
    return met(out, written(out.groupBy(dim).agg(F.sum("raked").alias("_sum")), "sums"), [dim], "inner", F.struct(*TEMPERATURES))


def raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, bounded: bool = False) -> DataFrame:
    """cells (source, lang, topic, tokens) with raked, their tokens after the fit; bounded: none has more than it had."""
    cells = written(cells, "cells")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    by = goals(cells, targets, total)
    rate = 1.0
    if bounded:
        for dim, goal in by.items():
            least = goal.where(F.col(f"goal_{dim}") >= LEAST_SHARE).agg(F.min(F.col(f"present_{dim}") / (F.col(f"goal_{dim}") * total))).first()[0]
            rate = min(rate, least if least is not None else 1.0)
    together = small_enough(cells, BOUNDED_CELLS)
    out = (cells.coalesce(1) if together else cells).withColumn("raked", F.col("tokens").cast("double"))
    for dim, goal in by.items():
        out = met(out, goal.drop(f"present_{dim}"), [dim], "inner", F.struct(*TEMPERATURES))
    # A value's goal is what it can give at most.
    reach = lambda dim: F.least(F.col(f"goal_{dim}") * F.lit(total * rate), F.col(f"most_{dim}")) if bounded else F.col(f"goal_{dim}") * F.lit(total)
    if bounded:
        for dim in by:
            out = _summed(out, dim, together).withColumnRenamed("_sum", f"most_{dim}")
    for _ in range(PASSES):
        for _ in range(rounds):
            for dim in by:
                fitted = F.when(F.col("_sum") > 0, F.col("raked") * reach(dim) / F.col("_sum")).otherwise(F.lit(0.0))
                out = _summed(out, dim, together).withColumn("raked", F.least("tokens", fitted) if bounded else fitted).drop("_sum")
        out = written(out, "raked")
        off = [out.groupBy(dim).agg((F.abs(F.sum("raked") - F.first(reach(dim))) / F.lit(max(total, 1.0))).alias("off")).agg(F.max("off")).first()[0] for dim in by]
        if max(x or 0.0 for x in off) < TOLERANCE:
            break
        out = out.coalesce(1) if together else out
    return out.select("source", "lang", "topic", "tokens", "raked")


def probabilities(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE, bounded: bool = False) -> DataFrame:
    """source, lang and topic of each cell, and its documents' probability and weight."""
    fitted = raked(rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), targets, bounded=bounded)
    factor = F.lit(rate) * F.col("raked") / F.col("tokens")
    p = F.least(F.lit(1.0), factor)
    return fitted.select("source", "lang", "topic", p.alias("p"), F.when(p > 0, factor / p).otherwise(F.lit(0.0)).alias("weight"))


def chance(seed: str = SEED) -> Column:
    """A number in [0, 1) from the document's id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE) -> DataFrame:
    """The sampled documents: doc_id, source, lang, topic, tokens and weight."""
    rows = written(measured(docs), "measured")
    out = met(rows, probabilities(rows, targets, rate), ["source", "lang", "topic"], "left", F.col("doc_id"))
    out = out.withColumns({"p": F.coalesce("p", F.lit(1.0)), "weight": F.coalesce("weight", F.lit(1.0))})
    return out.where(chance() < F.col("p")).select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"))


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """docs, less the documents that a bounded fit leaves out: what stays has the target shares without weights."""
    rows = written(measured(docs), "measured")
    text = F.coalesce("text", F.lit(""))
    dims = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang")} | {"topic": topic(text, F.regexp_count(text, F.lit(WORD)).cast("long"))}
    own = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), *(v.alias(k) for k, v in dims.items()))
    out = met(own, probabilities(rows, targets, bounded=True), ["source", "lang", "topic"], "left", F.col("doc_id"))
    return out.where(chance() < F.coalesce("p", F.lit(1.0))).select("doc.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixing_sql(documents: str = "documents") -> str:
    """DuckDB SQL of mix() over a table or subquery, with its default parameters."""
    count = lambda chars: f"(length(t) - length(translate(t, '{chars}', '')))"
    dims = list(TEMPERATURES)
    steps, last, k = [], "w0", 0
    for _ in range(ROUNDS):
        for d in dims:
            k += 1
            steps.append(f"w{k} AS (SELECT * REPLACE (raked * goal_{d} * al / sum(raked) OVER (PARTITION BY {d}) AS raked) FROM {last})")
            last = f"w{k}"
    goals = ", ".join(f"g_{d} AS (SELECT {d}, pow(present, {p}) / sum(pow(present, {p})) OVER () AS goal_{d} FROM (SELECT {d}, sum(tokens)::DOUBLE AS present FROM cells GROUP BY {d}))" for d, p in TEMPERATURES.items())
    return f"""WITH base AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM {documents}),
    counted AS (SELECT *, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM base),
    measured AS (SELECT doc_id, source, lang, tokens, CASE WHEN tokens = 0 THEN 'empty' WHEN 5 * {count("|")} >= tokens THEN 'table' WHEN 5 * {count("!")} >= tokens THEN 'shout'
        WHEN 3 * {count("#*$%&")} >= tokens THEN 'markup' WHEN tokens < 50 THEN 'note' WHEN tokens > 1000 THEN 'long' ELSE 'prose' END AS topic FROM counted),
    cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM measured GROUP BY ALL HAVING sum(tokens) > 0), {goals},
    w0 AS (SELECT *, tokens AS raked, sum(tokens) OVER () AS al FROM cells {" ".join(f"JOIN g_{d} USING ({d})" for d in dims)}), {", ".join(steps)},
    p AS (SELECT source, lang, topic, least(1.0, raked / tokens) AS p, raked / tokens / least(1.0, raked / tokens) AS weight FROM {last})
    SELECT doc_id, source, lang, topic, tokens, round(coalesce(weight, 1.0), 6) AS weight FROM measured LEFT JOIN p USING (source, lang, topic)
    WHERE ('0x' || left(md5('{SEED}' || coalesce(doc_id::BIGINT::VARCHAR, '')), 8))::UBIGINT / 4294967296.0 < coalesce(p, 1.0)"""
