import random
import time

from pyspark.sql import functions as F

from strainframe.operators import variants as v

CALLS = "id long, replicon string, start int, end int, ref string, alt string"


def plain(reference, calls):
    """Base by base: a deleted base is gone unless a change stands at it, of changes the longest alt and then the greatest wins."""
    bases, changed = list(reference), {}
    for start, end, alt in calls:
        if not (alt or "").strip():
            for i in range(max(start, 0), min(end, len(reference))):
                bases[i] = ""
    for start, _, alt in calls:
        if (alt or "").strip() and start < len(reference):
            changed[start] = max(changed.get(start, ""), alt, key=lambda a: (len(a), a))
    return changed.get(-1, "") + "".join(changed.get(i, b) for i, b in enumerate(bases))


def made(spark, reference, rows):
    references = spark.createDataFrame([("r", reference)], "replicon string, sequence string")
    return {r["id"]: r["sequence"] for r in v.reconstructed(references, spark.createDataFrame(rows, CALLS)).collect()}


def test_splicing_equals_base_by_base(spark):
    """Random edits that overlap, repeat, stand before the first base and behind the last."""
    pick = random.Random(5)
    for reference in ("ACGTACGTTTGACCA" * 3, "ACGÄTCGTñ" * 4):
        by_id = {}
        for k in range(150):
            calls = []
            for _ in range(pick.randrange(1, 12)):
                at = pick.randrange(-1, len(reference) + 2)
                if pick.random() < 0.4 and at >= 0:
                    calls.append((at, min(at + pick.randrange(1, 9), len(reference) + 2), pick.choice(["", None, " "])))
                else:
                    calls.append((at, at + 1, pick.choice(["A", "C", "GG", "TTA", "CAT"])))
            by_id[k] = calls + calls[:1]
        rows = [(k, "r", s, e, "N", a) for k, calls in by_id.items() for s, e, a in calls]
        assert made(spark, reference, rows) == {k: plain(reference, c) for k, c in by_id.items()}


def test_a_deletion_of_no_base_does_nothing(spark):
    assert made(spark, "ACGT", [(1, "r", 2, 2, "", ""), (1, "r", 0, 1, "A", "G")]) == {1: "GCGT"}


def test_many_edits_cost_about_what_few_do(spark):
    """Genomes of 30,000 bases with 3,000 edits each: no edit walks the genome, nor does a base look for its edit."""
    reference = spark.createDataFrame([("r", "ACGT" * 7500)], "replicon string, sequence string")

    def took(edits):
        calls = spark.range(40 * edits).selectExpr(f"id div {edits} AS id", "'r' AS replicon", f"cast((id % {edits}) * {30000 // edits} AS int) AS start", f"cast((id % {edits}) * {30000 // edits} + 1 AS int) AS end", "'A' AS ref", "IF(id % 3 = 0, '', 'T') AS alt")
        began = time.time()
        out = v.reconstructed(reference, calls).agg(F.count("*"), F.sum(F.length("sequence"))).first()
        assert tuple(out) == (40, 40 * 30000 - sum(1 for i in range(40 * edits) if i % 3 == 0))
        return time.time() - began

    took(10)
    assert took(3000) < 4 * took(10) + 3
