import pytest
from pyspark.sql import functions as F

from strainframe.functions import notation
from strainframe.functions import scalars as x


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column().alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "values", "expected"),
    [
        (lambda: x.harmonised("s"), {"s": " ac.u-g "}, "ACNTG"),
        (lambda: x.reference_sequence("s"), {"s": " acu-g "}, "ACT-G"),
        (lambda: x.nt_label(), {"ref": "C", "start": 240, "end": 241, "alt": "T"}, "C241T"),
        (lambda: x.nt_label(), {"ref": "CAT", "start": 4, "end": 7, "alt": " "}, "del:5-7"),
        (lambda: x.nt_label(frameshift="fs"), {"ref": "C", "start": 4, "end": 5, "alt": "", "fs": True}, "del:5*fs"),
        (lambda: x.aa_label(), {"gene": "S", "ref": "D", "start": 613, "end": 614, "alt": "G"}, "S:D614G"),
        (lambda: x.residue("c"), {"c": "TAA"}, "*"),
        (lambda: x.residue("c"), {"c": "CTN"}, "L"),
        (lambda: x.residue("c"), {"c": "NNN"}, "X"),
        (lambda: x.residue("c"), {"c": "CT"}, None),
        (lambda: x.translated("s"), {"s": "ATGCAATAAC"}, "MQ*"),
        (lambda: x.reverse_complement("s"), {"s": "ATGC"}, "GCAT"),
        (lambda: x.completed_date("s"), {"s": "2021"}, "2021-01-01"),
        (lambda: x.completed_date("s"), {"s": "2021-02"}, "2021-02-01"),
        (lambda: x.completed_date("s"), {"s": "2021-02-31"}, ""),
        (lambda: x.week_label(F.to_date("s")), {"s": "2018-12-31"}, "2019-W01"),
        (lambda: x.header_id("s"), {"s": ">AB.1|x y"}, "AB.1"),
        (lambda: x.molecule_tag("s"), {"s": "a [molecule=NC_1] b"}, "NC_1"),
        (lambda: x.parsed_bool("s"), {"s": "Off"}, False),
        (lambda: x.json_field("s", "a"), {"s": '[{"a": 3}]'}, "3"),
        (lambda: x.percent_text("a", "b"), {"a": 1, "b": 3}, "1 (33.33%)"),
        (lambda: x.first_value("a", "b"), {"a": 0, "b": 7}, "0"),
        (lambda: x.aa_frameshift("s"), {"s": "*"}, True),
    ],
)
def test_scalar(spark, column, values, expected):
    assert one(spark, column, **values) == expected


def test_rendering(spark):
    kind = "array<struct<name: string, items: array<struct<label: string, annotations: array<string>>>>>"
    df = spark.createDataFrame([([("MN908947.3", [("C241T", ["stop_gained HIGH"]), ("A405G", [])])],)], f"p {kind}")
    assert df.select(x.rendered_profile("p")).first()[0] == "MN908947.3(C241T(stop_gained HIGH), A405G)"
    assert df.select(x.rendered_profile("p", False)).first()[0] == "MN908947.3(C241T, A405G)"


def test_notation(spark):
    genes = spark.createDataFrame([("SH",), ("ORF1-a",)], "gene string")
    one_replicon = spark.createDataFrame([("NC_1", "r")], "replicon string, reference string")
    texts = ["A435G", "NC_1:A435G", "SH:K53E", "^NC_1:SH:del:34-35", "ORF1-a:del:7", "X:A1G", "A4GT", "SH:K53*", "nonsense", "A5N"]
    rows = {r["notation"]: r for r in notation.resolved(spark.createDataFrame([(t,) for t in texts], "notation string"), genes, one_replicon).collect()}
    assert rows["A435G"]["replicon"] == "NC_1" and rows["A435G"]["what"] == "snp"
    assert rows["SH:K53E"]["kind"] == "aa" and rows["SH:K53E"]["gene"] == "SH"
    assert rows["^NC_1:SH:del:34-35"]["negated"] and (rows["^NC_1:SH:del:34-35"]["first"], rows["^NC_1:SH:del:34-35"]["last"]) == (34, 35)
    assert rows["ORF1-a:del:7"]["gene"] == "ORF1-a"
    assert rows["X:A1G"]["error"] == "unknown name" and rows["nonsense"]["error"] == "not a notation"
    assert rows["A4GT"]["what"] == "ins" and rows["SH:K53*"]["alts"] == ["*"]
    assert set(rows["A5N"]["alts"]) == set("ACGTRYSWKMBDHVN")
    several = spark.createDataFrame([("NC_1", "r"), ("NC_2", "r")], "replicon string, reference string")
    assert notation.resolved(spark.createDataFrame([("A4G",)], "notation string"), genes, several).first()["error"] == "replicon needed"
