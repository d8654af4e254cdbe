import random

from pyspark.sql import functions as F

from strainframe.functions import notation

PROFILES, FACTS = "profile string, notation string", "sample long, kind string, replicon string, gene string, start int, end int, ref string, alt string"


def resolved(spark, rows):
    return notation.resolved(spark.createDataFrame(rows, PROFILES), spark.createDataFrame([("S",)], "gene string"), spark.createDataFrame([("r", "ref"), ("q", "ref")], "replicon string, reference string"))


def pairs(df):
    rows = [tuple(r) for r in df.select("profile", "sample").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def facts_of(pick, samples):
    rows = [(s, "nt", "r", None, 9, 10, "A", "G") for s in range(samples)]
    for s in range(samples):
        for _ in range(pick.randrange(8)):
            at = pick.randrange(12, 20)
            rows.append((s, "nt", pick.choice("rq"), None, at, at + 1, "A", pick.choice("CGT")))
        if pick.random() < 0.4:
            rows.append((s, "aa", "r", "S", 4, 5, "D", pick.choice(["G", "N", ""])))
        if pick.random() < 0.3:
            rows.append((s, "nt", "r", None, 30, 33, "AAA", pick.choice(["", None, " "])))
    return rows + rows[:40]


def test_by_rarest_equals_relational_division(spark):
    """Profiles of any mix: several alts, deletions, residues, two replicons, negated, repeated and wrong notations, only negated ones, ones that nobody carries."""
    pick = random.Random(11)
    facts = spark.createDataFrame(facts_of(pick, 150), FACTS)
    some = ["r:A10G", "S:D5G", "S:D5B", "r:del:31-33", "^S:D5N", "^r:del:31-33", "r:C99T", "nonsense"] + [f"{n}{r}:A{at}{alt}" for n in ("", "", "^") for r in "rq" for at in range(13, 21) for alt in "CGTRYN"]
    rows = [(f"p{k}", pick.choice(some[:7] if pick.random() < 0.4 else some)) for k in range(200) for _ in range(pick.randrange(1, 5))]
    profiles = resolved(spark, rows + rows[:9])
    plain = pairs(notation.matched(profiles, facts))
    assert len(plain) > 300
    assert pairs(notation.matched_by_rarest(profiles, facts)) == plain
    # Kept counts may be too high, also of mutations that are gone.
    more = facts.unionByName(spark.createDataFrame([(900, "nt", "r", None, 98, 99, "C", "T")] * 5, FACTS))
    assert pairs(notation.matched_by_rarest(profiles, facts, counted=notation.frequencies(more))) == plain


def test_a_dominant_mutation_is_no_key(spark):
    """2,000 samples carry one mutation that 300 profiles have: both meet at the profiles' rare ones, a 200th of the rows of the relational division."""
    facts = spark.range(2000).selectExpr("id AS sample", "explode(array(0, id % 400 + 1)) AS at").selectExpr("sample", "'nt' AS kind", "'r' AS replicon", "cast(NULL AS string) AS gene", "cast(at AS int) AS start", "cast(at + 1 AS int) AS end", "'A' AS ref", "'G' AS alt")
    profiles = resolved(spark, [(f"p{k}", n) for k in range(300) for n in ("r:A1G", f"r:A{k + 2}G")])
    w = notation.waiting(profiles, notation.frequencies(facts))
    carried = facts.withColumn("k_alt", F.col("alt")).select("sample", notation._mutation().alias("m")).distinct()
    met = notation.candidates(w, carried).count()
    keys = notation._keys(notation._wanted(profiles))
    before = notation._keyed(notation._with_alt(facts), keys).count()
    assert met == 300 * 5 and before == 300 * 2000 + 300 * 5 and before > 200 * 2 * met
    assert notation.matched_by_rarest(profiles, facts).count() == 1500


def test_empty_tables_and_places_of_nulls(spark):
    none, facts = spark.createDataFrame([], FACTS), spark.createDataFrame([(1, "aa", None, "x", 4, 5, "D", "G"), (2, "aa", "x", None, 4, 5, "D", "G")], FACTS)
    assert notation.matched_by_rarest(resolved(spark, [("p", "r:A1G")]), none).count() == 0
    assert notation.matched_by_rarest(resolved(spark, []), facts).count() == 0
    assert facts.withColumn("k_alt", F.col("alt")).select(notation._mutation()).distinct().count() == 2


def test_notations_of_one_file_are_parsed_by_several_tasks_once(spark):
    """a watch-list was parsed by one task, and anew by each pass over it."""
    own = spark.range(100_000).coalesce(1).selectExpr("concat('p', id) AS profile", "concat('r:A', id + 1, 'G') AS notation")
    found = notation.resolved(own, spark.createDataFrame([], "gene string"), spark.createDataFrame([("r", "ref")], "replicon string, reference string"))
    assert found.rdd.getNumPartitions() >= 5
    wanted = notation._wanted(found)
    assert wanted.count() == 100_000 and "regexp_extract" not in wanted._jdf.queryExecution().optimizedPlan().toString()
