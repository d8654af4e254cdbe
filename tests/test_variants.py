import random

from pyspark.sql import functions as F

from strainframe.operators import variants as v

CALLS = "id string, replicon string, start int, end int, ref string, alt string, number int"


def codons(spark, rows):
    slots = [("r", "c", "g", 1, aa_pos, s, p + s, bases[s], aa) for p, aa_pos, bases, aa in rows for s in range(3)]
    return spark.createDataFrame(slots, "replicon string, cds string, gene string, strand int, aa_pos int, slot int, pos int, base string, aa string")


def test_stop_gain(spark):
    calls = spark.createDataFrame([("a", "r", 27915, 27916, "C", "T", 1)], CALLS)
    row = v.aa_from_nt(calls, codons(spark, [(27915, 26, "CAA", "Q")])).collect()
    assert [(r["alt"], r["label"], r["parents"]) for r in row] == [("*", "Q27*", [1])]


def test_deletion_across_codons(spark):
    calls = spark.createDataFrame([("a", "r", 21764, 21770, "CATCAT", " ", 1)], CALLS)
    rows = v.aa_from_nt(calls, codons(spark, [(21763, 67, "CAT", "H"), (21766, 68, "CAT", "H"), (21769, 69, "GTC", "V")])).collect()
    assert [(r["start"], r["end"], r["label"]) for r in rows] == [(68, 70, "del:69-70")]


def test_pairs_and_cigars(spark):
    pairs = spark.createDataFrame([("a", "r", "TTACG--TAA", "--ACGTTTCA"), ("b", "r", "ACGT", "ACGT"), ("c", "r", "AC-TGGA", "ACGT--A")], "id string, replicon string, qry string, ref string")
    found = {(r["id"], r["start"], r["end"], r["ref"], r["alt"]) for r in v.calls_from_pairs(pairs).collect()}
    assert found == {("a", -1, 0, ".", "TT"), ("a", 3, 5, "TT", ""), ("a", 6, 7, "C", "A"), ("c", 2, 3, "G", ""), ("c", 3, 4, "T", "TGG")}
    cigar = spark.createDataFrame([("x", "r", "ACGGTTAG", "ACTAAGT", "2=1X1M1D2I1=")], "id string, replicon string, qry string, ref string, cigar string")
    found = {(r["start"], r["end"], r["ref"], r["alt"]) for r in v.calls_from_cigar(cigar).collect()}
    assert found == {(2, 3, "T", "G"), (3, 4, "A", "G"), (4, 5, "A", ""), (4, 5, "A", "GTT")}


def test_round_trip(spark):
    """What is called from random alignments makes the query of the reference again."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        qry, ref = [], []
        for _ in range(40):
            kind = rng.random()
            q, r = rng.choice("ACGT"), rng.choice("ACGT")
            if kind < 0.1 and (not ref or ref[-1] != "-"):
                qry.append("-"), ref.append(r)
            elif kind < 0.2 and (not qry or qry[-1] != "-"):
                qry.append(q), ref.append("-")
            else:
                qry.append(q), ref.append(q if kind < 0.8 else r)
        rows.append((str(i), str(i), "".join(qry), "".join(ref)))
    pairs = spark.createDataFrame(rows, "id string, replicon string, qry string, ref string")
    references = pairs.select("replicon", F.replace("ref", F.lit("-"), F.lit("")).alias("sequence"))
    originals = pairs.select("id", "replicon", F.replace("qry", F.lit("-"), F.lit("")).alias("sequence"))
    assert v.reconstruction_failures(references, v.calls_from_pairs(pairs), originals).count() == 0


def test_reverse_strand(spark):
    segments = spark.createDataFrame([("r", "c", "g", 1, 0, 6, -1)], "replicon string, cds string, gene string, order int, start int, end int, strand int")
    rows = v.codon_table(segments, spark.createDataFrame([("r", "TTACAT")], "replicon string, sequence string")).orderBy("aa_pos", "slot").collect()
    assert [(r["pos"], r["base"], r["aa"]) for r in rows] == [(5, "A", "M"), (4, "T", "M"), (3, "G", "M"), (2, "T", "*"), (1, "A", "*"), (0, "A", "*")]


def test_aligner_aa(spark):
    from strainframe.sources.readers import ALIGNER_SCHEMA

    record = {
        "seqId": "s", "substitutions": [{"pos": 0, "refNuc": "A", "qryNuc": "T"}, {"pos": 12, "refNuc": "A", "qryNuc": "C"}], "deletions": [{"range": {"begin": 4, "end": 10}}], "insertions": [{"pos": 20, "ins": "GGG"}], "frameShifts": [],
        "nucToAaMuts": {"0": [{"cdsName": "g", "pos": 0, "refAa": "K", "qryAa": "*"}], "12": [{"cdsName": "g", "pos": 4, "refAa": "K", "qryAa": "Q"}], "5": [{"cdsName": "g", "pos": 1, "refAa": "K", "qryAa": "-"}], "6": [{"cdsName": "g", "pos": 2, "refAa": "L", "qryAa": "-"}]},
        "aaInsertions": [{"cds": "g", "pos": 6, "ins": "G"}], "aaChangesGroups": [{"name": "g", "changes": [{"pos": 7, "nucPos": 18, "refAa": "K", "qryAa": "K", "nucRanges": [{"begin": 18, "end": 21}]}]}],
    }
    df = spark.createDataFrame([record], ALIGNER_SCHEMA)
    found = {(r["label"], r["parents"]) for r in v.aligner_aa(df, v.aligner_nt(df, "rep", "A" * 30)).collect()}
    assert found == {("K1*", "1"), ("K5Q", "3"), ("del:2-3", "2"), ("K8KG", "4")}


def test_lost_residues_find_their_calls(spark):
    """each lost residue was repeated for seven offsets. Against a loop: runs of several genes, calls at every offset or none, two records of one id, no id."""
    from strainframe.sources.readers import ALIGNER_SCHEMA

    rng = random.Random(3)
    records = []
    for i in range(40):
        starts = sorted(rng.sample(range(120), rng.randint(0, 12)))
        muts = {str(nt): [{"cdsName": c, "pos": rng.choice([nt // 3, nt // 3 + 1]), "refAa": "K", "qryAa": "-"} for c in rng.sample(["f", "g"], rng.randint(1, 2))] for nt in rng.sample(range(120), rng.randint(0, 15))}
        records.append({"seqId": f"s{min(i, 38)}" if i != 20 else None, "substitutions": [], "deletions": [{"range": {"begin": s, "end": s + 3}} for s in starts], "insertions": [], "frameShifts": [], "nucToAaMuts": muts, "aaInsertions": [], "aaChangesGroups": []})
    df = spark.createDataFrame(records, ALIGNER_SCHEMA)
    calls = v.aligner_nt(df, "rep", "A" * 130)
    found = v.aligner_aa(df, calls)
    got = {(r["id"], r["cds"], r["start"], r["end"]): r["parents"] for r in found.collect()}
    numbers = {}
    for c in calls.collect():
        numbers[c["id"], c["start"]] = min(c["number"], numbers.get((c["id"], c["start"]), 10**6))
    lost, want = {}, {}
    for r in records:
        for nt, xs in r["nucToAaMuts"].items():
            for x in xs:
                own = lost.setdefault((r["seqId"], x["cdsName"]), {})
                own[x["pos"]] = min(int(nt), own.get(x["pos"], 10**6))
    for (i, cds), own in lost.items():
        for a in own:
            if a - 1 not in own:
                b = next(p for p in range(a, 10**6) if p not in own)
                hits = [numbers[i, own[p] + o] for p in range(a, b) for o in v.PARENT_OFFSETS if i is not None and (i, own[p] + o) in numbers]
                want[i, cds, a, b] = str(hits[0]) if hits else ""
    assert got == want and len({p == "" for p in want.values()}) == 2
    plan = found._jdf.queryExecution().toString()
    assert "posexplode(array((nt" not in plan and "posexplode(array(pos" not in plan


def test_covered_genes_of_any_length(spark):
    """Against all pairs: calls of 1 to 1,000,000 bases, repeated rows, null and turned places, a replicon without genes."""
    import random

    rng = random.Random(6)
    genes = [(rng.choice(["a", "b"]), f"g{i}", s, s + rng.choice([0, 3, 50, 900, 40_000])) for i in range(300) for s in [rng.randrange(2_000_000)]]
    calls = [(i, rng.choice(["a", "b", "c"]), s, s + rng.choice([0, 1, 63, 64, 65, 5000, 65_536, 999_999])) for i in range(300) for s in [rng.choice([genes[i][2], rng.randrange(2_000_000)])]]
    calls += calls[:40] + [(900, "a", None, 5), (901, "a", 7, None), (902, None, 1, 5), (903, "a", 10**6, 5)]
    want = []
    for i, r, s, e in calls:
        inside = [(gs, g) for gr, g, gs, ge in genes if gr == r and None not in (s, e) and s <= gs and ge <= e]
        if inside:
            want.append((i, r, s, e, min(inside)[1]))
    c = spark.createDataFrame(calls, "call int, replicon string, start int, end int")
    g = spark.createDataFrame(genes, "replicon string, gene string, start int, end int")
    got = v.covered_genes(c, g)
    assert got.columns == ["call", "replicon", "start", "end", "gene"] and len(want) > 80
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert v.covered_genes(c.limit(0), g).count() == 0 and v.covered_genes(c, g.limit(0)).count() == 0


def test_a_call_is_two_rows_at_most(spark):
    spans = spark.createDataFrame([(s, s + n) for s in (0, 63, 64, 12_345_678) for n in (0, 1, 62, 63, 64, 255, 256, 10**6)], "start long, end long")
    level = v._level(F.col("end") - F.col("start") + 1)
    assert spans.where(v._bin(F.col("end"), level) - v._bin(F.col("start"), level) > 1).count() == 0


def test_codons_of_segments_in_one_pass(spark):
    segments = spark.createDataFrame([("r", "f", "g", 1, 0, 2, 1), ("r", "f", "g", 2, 3, 8, 1), ("r", "b", "g", 1, 4, 8, -1)], "replicon string, cds string, gene string, order int, start int, end int, strand int")
    df = v.codon_table(segments, spark.createDataFrame([("r", "ATCGATTG")], "replicon string, sequence string"))
    rows = [tuple(r) for r in df.select("cds", "aa_pos", "slot", "pos", "base", "aa").orderBy("cds", "aa_pos", "slot").collect()]
    # ATG ATT G forwards, CAA T backwards; the last codons lack bases.
    assert rows == [("b", 0, 0, 7, "C", "Q"), ("b", 0, 1, 6, "A", "Q"), ("b", 0, 2, 5, "A", "Q"), ("b", 1, 0, 4, "T", None)] + [
        ("f", i // 3, i % 3, p, b, "MI"[i // 3] if i < 6 else None) for i, (p, b) in enumerate(zip((0, 1, 3, 4, 5, 6, 7), "ATGATTG", strict=True))
    ]
    # The sequences are joined with; the bases of a codon are not grouped and joined with their rows again.
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan


def test_many_codons_are_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(v, "few", lambda df: False)
    calls = spark.createDataFrame([("s", "r", 1, 2, "T", "G", 1)], "id string, replicon string, start int, end int, ref string, alt string, number int")
    segments = spark.createDataFrame([("r", "f", "g", 1, 0, 6, 1)], "replicon string, cds string, gene string, order int, start int, end int, strand int")
    found = v.aa_from_nt(calls, v.codon_table(segments, spark.createDataFrame([("r", "ATGATT")], "replicon string, sequence string")))
    assert [(r.start, r.ref, r.alt) for r in found.collect()] == [(0, "M", "R")]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
