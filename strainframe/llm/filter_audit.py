"""Filter interaction audit (operator 13): five filters in all 120 orders, by wide packed counters.

Each text fails some of the filters; the failures are a mask of five bits. A table of integers has, for each mask, one
packed integer whose 64-bit fields hold what happens to such a text at each of the 600 steps (120 orders of five steps): kept,
removed, redundant, good and lost, toxic and lost, and which filter it alone fails. Every task adds the integers of its texts by
part, the sums of the tasks are added in two levels, and the sum of a part is cut into its fields. A field is at most the number of
rows, which is less than 2^63, so no field reaches the next.

Filters. A: under WORDS words. B: 100 * distinct words < DISTINCT * words. C: 100 * [A-Z] > UPPER * code points.
D: holds one of SYMBOLS. E: some smaller doc_id has the same text (by its 128-bit hash), anywhere in the table.

Defined results: a null text is empty, a null lang is the part of the empty string; rows of one doc_id never make each other
fail E, rows of a null doc_id neither fail E nor make others fail it, and they have no label; of several labels of one doc_id any 1
counts; repeated rows count each; an empty table has no parts and no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import met, table

FILTERS = "ABCDE"
WORDS, DISTINCT, UPPER, SYMBOLS = 200, 50, 3, b"#$%&*|"
CAPITALS, CONTINUATION = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
#: Outcomes with a field for each step; after them one field a filter for the texts that fail it alone.
OUTCOMES = ["kept", "removed", "redundant", "good_lost", "toxic_lost"]
FIELDS, BYTES = len(OUTCOMES) * STEPS + len(FILTERS), 8
#: Parts that a task holds sums of at a time; groups that the sums of tasks are added in first.
HELD_PARTS, SLOTS = 256, 64


def failures(text: bytes) -> int:
    """The mask of filters A to D that a text fails: bit i for the filter FILTERS[i]."""
    words = text.split()
    gone = lambda chars: len(text) - len(text.translate(None, chars))
    return (len(words) < WORDS) | (100 * len(set(words)) < DISTINCT * len(words)) << 1 | (100 * gone(CAPITALS) > UPPER * (len(text) - gone(CONTINUATION))) << 2 | (gone(SYMBOLS) > 0) << 3


def packed(mask: int, good: bool, toxic: bool) -> int:
    """One text's outcomes at all steps as an integer of FIELDS fields."""
    fields = np.zeros(FIELDS, dtype="<u8")
    at = fields[: len(OUTCOMES) * STEPS].reshape(len(OUTCOMES), STEPS)
    for o, order in enumerate(ORDERS):
        alive = True
        for s, letter in enumerate(order):
            step, fails = o * len(FILTERS) + s, mask >> FILTERS.index(letter) & 1
            removed = alive and fails
            at[1, step], at[2, step] = removed, fails and not alive
            at[3, step], at[4, step] = removed and good, removed and toxic
            alive = alive and not fails
            at[0, step] = alive
    if mask and not mask & mask - 1:
        fields[len(OUTCOMES) * STEPS + mask.bit_length() - 1] = 1
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int) -> dict[str, list]:
    """The rows of a part, from its sum."""
    fields = np.frombuffer(total.to_bytes(FIELDS * BYTES, "little"), dtype="<u8").astype(np.int64)
    at, alone = fields[: len(OUTCOMES) * STEPS].reshape(len(OUTCOMES), STEPS), fields[len(OUTCOMES) * STEPS :]
    letters = np.array([FILTERS.index(x) for order in ORDERS for x in order])
    removed = np.zeros(len(FILTERS), dtype=np.int64)
    np.add.at(removed, letters, at[1])
    out = {"filter_order": [o for o in ORDERS for _ in FILTERS], "step": [s + 1 for _ in ORDERS for s in range(len(FILTERS))]}
    return out | dict(zip(OUTCOMES, at, strict=True)) | {"unique_fails": alone[letters], "shapley": removed[letters]}


def _masked(batches):
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        keys, masks = pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array([failures(t) for t in texts], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, masks], names=["doc_id", "part", "key", "mask"])


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, hash of the text and mask of A to D of each row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(_masked, "doc_id long, part string, key binary, mask int")


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of all filters, good, toxic and how many rows n, for each text: copies are counted before they are shuffled."""
    rows = masked(docs).groupBy("doc_id", "key", "mask", "part").agg(F.count("*").alias("n"))
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic")).where("doc_id IS NOT NULL AND (quality OR toxic)")
    rows = met(rows, known, ["doc_id"], "left", F.col("key"))
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    texts = rows.groupBy("key", "mask", "part", has("quality").alias("good"), has("toxic").alias("toxic")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"))
    # A text has as many rows here as it has parts and labels, however many its copies.
    one_text = texts.withColumn("least", F.min("first").over(Window.partitionBy("key")))
    passing = F.col("unnamed") + F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("mask"), passing.alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - passing).alias("n"))))
    return one_text.select("part", "good", "toxic", both.alias("x")).select("part", "x.mask", "good", "toxic", "x.n").where("n > 0")


def _summed(batches):
    integers = {(m, g, t): packed(m, g, t) for m in range(1 << len(FILTERS)) for g in (False, True) for t in (False, True)}
    totals: dict[str, int] = defaultdict(int)
    slot = TaskContext.get().partitionId() % SLOTS

    def out():
        cols = [list(totals), [slot] * len(totals), [x.to_bytes(FIELDS * BYTES, "little") for x in totals.values()]]
        totals.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["part", "slot", "total"])

    for batch in batches:
        for part, mask, good, toxic, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            totals[part] += n * integers[mask, good, toxic]
            if len(totals) > HELD_PARTS:
                yield out()
    yield out()


def _added(key: tuple[pa.Scalar, ...], sums: pa.Table) -> pa.Table:
    total = sum(int.from_bytes(x, "little") for x in sums["total"].to_pylist())
    return pa.table({"part": pa.array([key[0].as_py()], pa.string()), "total": pa.array([total.to_bytes(FIELDS * BYTES, "little")], pa.binary())})


def _cut(key: tuple[pa.Scalar, ...], sums: pa.Table) -> pa.Table:
    rows = unpacked(sum(int.from_bytes(x, "little") for x in sums["total"].to_pylist()))
    return pa.table({"part": pa.array([key[0].as_py()] * STEPS, pa.string()), "filter_order": pa.array(rows["filter_order"], pa.string()), "step": pa.array(rows["step"], pa.int32())} | {c: pa.array(rows[c], pa.int64()) for c in COUNTS})


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step: 600 rows a part."""
    sums = counted(docs, labels).mapInArrow(_summed, "part string, slot int, total binary")
    sums = sums.groupBy("part", "slot").applyInArrow(_added, "part string, total binary")
    return sums.groupBy("part").applyInArrow(_cut, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def filter_audit_sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS b(letter, bit)),
o AS (SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
    FROM b p, b q, b r, b s, b t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, t.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step)),
x AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n * good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n * toxic ELSE 0 END) AS toxic_lost
    FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x"""
