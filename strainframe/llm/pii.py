"""PII (operator 10): weak supervision over candidate spans, with DataFrame functions only.

Base spans come from strict patterns and their validators and always stay. Looser patterns give further candidates.
Labelers (pattern, gazetteer, context words, format, neighbours) vote on every candidate: 1, -1 or 0 for no opinion.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is, and a logistic span
classifier is trained on the resulting probabilities. Candidates that it accepts and that no base span overlaps are added.
Only the counts of patterns reach the driver: 4 kinds x 3^5 votes x 4 shapes at most, whatever the input.

Defined results: null and empty texts have no spans (base_sha256 is that of an empty string); repeated rows get equal results;
a null doc_id is kept; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_of, written

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Where a run of characters can't match from its start it can't match from its middle, so a search
# begins at a run's start or where the last match ended (\G); a card is a whole chain of digits.
LOCAL = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{LOCAL})[A-Za-z0-9][A-Za-z0-9._-]{{0,40}}\x20?(?:\(at\)|\[at\]|\{{at\}})\x20?[A-Za-z0-9-]{{1,40}}\x20?(?:\.|\(dot\)|\[dot\]|\{{dot\}})\x20?[A-Za-z]{{2,12}}(?![A-Za-z])",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?:[0-9]{4}[\x20-]){3}[0-9]{1,7}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+.-])(?<!\+[0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9.-])",
}
# Words before a span that speak for or against a kind, and top-level domains.
FOR = {"email": "mail|e-mail|contact|write|kontakt|correo|courriel", "ip": "ip|server|host|address|adresse", "card": "card|visa|mastercard|amex|karte|carte|tarjeta|credit|payment", "phone": "phone|call|tel|mobile|fax|dial|telefon|telefono|whatsapp"}
AGAINST = r"isbn|issn|version|order|invoice|serial|token|hash|sha|md5|id|ref|figure|page|section|doi"
DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|co|ch|at|it|nl|us|ca"
CONTEXT = 40
ACCEPT = 0.9
VOTES = ("pattern", "gazetteer", "context", "format", "neighbours")
SHAPES = 4


#: Matches that are put together at a time: an array grows by copying, so a longer one would cost the square of its length.
BLOCK = 256


def _bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def spans(text: Column, pattern: str, kind: int, strict: bool) -> Column:
    """Matches of a pattern, leftmost and not overlapping: array of (s, k, e, t, strict, before, after).

    Places are sums of the lengths of what lies between matches, and contexts come from there as well, so no match walks the text to
    its place. Sums are by block, then within each, so that the work grows with the text and not with the square of its matches.
    """
    empty = F.from_json(F.lit("[]"), "array<struct<s:int,k:int,e:int,t:string,strict:boolean,before:string,after:string>>")
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), lambda p, t: F.struct(p.alias("p"), t.alias("t"), (F.char_length(p) + F.coalesce(F.char_length(t), F.lit(0))).alias("n")))

    def followed(own: Column) -> Column:
        """The pieces, each with the character behind its match."""
        first = lambda y: F.coalesce(F.nullif(F.left(y["p"], F.lit(1)), F.lit("")), F.left(y["t"], F.lit(1)), F.lit(""))
        return F.zip_with(own, F.slice(own, F.lit(2), F.size(own)), lambda x, y: F.struct(x["p"].alias("p"), x["t"].alias("t"), x["n"].alias("n"), first(y).alias("after")))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.char_length(x["p"])
        before = F.right(F.concat(acc["tail"], x["p"]), F.lit(CONTEXT))
        found = F.struct(s.alias("s"), F.lit(kind).alias("k"), (acc["at"] + x["n"]).alias("e"), x["t"].alias("t"), F.lit(strict).alias("strict"), F.lower(before).alias("before"), x["after"].alias("after"))
        return F.struct((acc["at"] + x["n"]).alias("at"), F.right(F.concat(before, F.coalesce(x["t"], F.lit(""))), F.lit(CONTEXT)).alias("tail"), F.when(x["t"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(found))).alias("out"))

    def blocks(own: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(own), F.lit(BLOCK)), lambda i: F.slice(own, i, F.lit(BLOCK)))
        return _bound(cut, lambda every: F.flatten(F.zip_with(every, starts(every), lambda b, at: F.when(b.isNotNull(), inside(b, at)).otherwise(empty))))

    def starts(every: Column) -> Column:
        """Where each block begins, and behind them the text's end."""
        sizes = F.transform(every, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["n"]))
        return F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def inside(block: Column, at: Column) -> Column:
        tail = F.substring(text, F.greatest(F.lit(1), at - CONTEXT + 1), F.least(F.lit(CONTEXT), at))
        return F.aggregate(block, F.struct(at.alias("at"), tail.alias("tail"), empty.alias("out")), step)["out"]

    return F.when(F.rlike(text, F.lit(pattern)), _bound(pieces, lambda own: _bound(followed(own), blocks))).otherwise(empty)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(t: Column) -> Column:
    d = _digits(t)
    double = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    digit = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, double(digit(i))).otherwise(digit(i)))
    return (d != "") & (total % 10 == 0)


def valid(x: Column) -> Column:
    """What the validators say to a match of a strict pattern."""
    n = F.length(_digits(x["t"]))
    parts = F.forall(F.split(x["t"], r"\."), lambda p: p.try_cast("double") <= 255)
    return F.when(x["k"] == 0, True).when(x["k"] == 1, parts).when(x["k"] == 2, n.between(14, 19) & luhn(x["t"])).otherwise(n.between(10, 15))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its base spans and further candidates."""
    text = F.col("text")
    every = text_of(docs).select("doc_id", *(spans(text, p, k, strict).alias(f"{name}_{strict}") for strict, group in ((True, STRICT), (False, LOOSE)) for k, (name, p) in enumerate((n, group[n]) for n in KINDS)))
    strict, loose = (F.concat(*(F.col(f"{n}_{s}") for n in KINDS)) for s in (True, False))
    found = every.select("doc_id", F.filter(strict, valid).alias("base"), loose.alias("loose"))
    free = lambda x: ~F.exists(F.col("base"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    return found.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.filter("loose", free)).alias("loose"))


def votes(x: Column) -> Column:
    """Votes of the labelers on a candidate, and its shape."""
    t, digits = x["t"], _digits(x["t"])
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    kinds = lambda *of: F.when(x["k"] == 0, of[0]).when(x["k"] == 1, of[1]).when(x["k"] == 2, of[2]).otherwise(of[3])
    spoken = kinds(*(F.rlike(x["before"], F.lit(rf"\b(?:{FOR[k]})\b")) for k in KINDS))
    gazetteer = kinds(
        vote(F.rlike(F.lower(t), F.lit(rf"(?:\.|dot.?\x20?)(?:{DOMAINS})$")), F.rlike(t, F.lit(r"\.[0-9]+$"))),
        vote(F.contains(t, F.lit(":")) | ~F.rlike(t, F.lit(r"^(?:0|127|255)\.")), F.rlike(t, F.lit(r"^0\."))),
        vote(luhn(t) & F.rlike(digits, F.lit("^(?:3[47]|4|5[1-5]|6)")), ~luhn(t)),
        vote(F.rlike(digits, F.lit(r"^(?:1?[2-9][0-9]{2}[2-9][0-9]{6}|1[0-9]{10})$")), F.rlike(digits, F.lit(r"^0{3}"))))
    form = kinds(
        vote(F.length(t) <= 64, F.length(t) > 254), vote(F.length(t) >= 7, F.length(t) < 7),
        vote(F.rlike(t, F.lit(r"^(?:[0-9]{14,19}|(?:[0-9]{4}[\x20-]){3}[0-9]{1,7})$")), ~F.length(digits).between(13, 19)),
        vote(F.length(digits).between(10, 13), ~F.length(digits).between(8, 15)))
    joined = F.rlike(F.concat(F.right(x["before"], F.lit(1)), F.lit("|"), x["after"]), F.lit(r"[\p{L}\p{N}_]"))
    return F.struct(
        vote(x["strict"], F.lit(False)).alias("pattern"), gazetteer.alias("gazetteer"), vote(spoken, F.rlike(x["before"], F.lit(rf"\b(?:{AGAINST})\W{{0,4}}$"))).alias("context"), form.alias("format"), vote(~joined, joined).alias("neighbours"),
        F.least(F.lit(SHAPES - 1), F.floor(F.length(t) / 10)).cast("int").alias("shape"))


def reliabilities(counts: list[tuple[int, tuple[int, ...], float]], rounds: int = 60) -> list[float]:
    """Probability that a span of each vote pattern is personal data: a two-class mixture fitted by expectation-maximisation.

    counts: kind, votes, how many. Votes are taken as independent within a class; each kind has its own prior.
    """
    prior = [0.5] * len(KINDS)
    # How often a labeler says -1, 0, 1 for a true and for a false span; the start says that labelers are better than chance.
    rate = [[[0.15, 0.35, 0.5], [0.5, 0.35, 0.15]] for _ in VOTES]
    post = [0.5] * len(counts)
    for _ in range(rounds):
        for i, (kind, own, _) in enumerate(counts):
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(rate[j][0][v + 1] / rate[j][1][v + 1]) for j, v in enumerate(own))
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in range(len(KINDS)):
            of = [(p, n) for p, (k, _, n) in zip(post, counts, strict=True) if k == kind]
            prior[kind] = (sum(p * n for p, n in of) + 2) / (sum(n for _, n in of) + 4)
        for j in range(len(VOTES)):
            for side in (0, 1):
                seen = [4.0 * x for x in ([0.15, 0.35, 0.5], [0.5, 0.35, 0.15])[side]]
                for p, (_, own, n) in zip(post, counts, strict=True):
                    seen[own[j] + 1] += n * (p if side == 0 else 1 - p)
                rate[j][side] = [x / sum(seen) for x in seen]
    return post


def _inputs(kind: int, own: tuple[int, ...], shape: int) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(v == side) for v in own for side in (1, -1)), *(float(shape == s) for s in range(SHAPES))]


def classifier(rows: list[tuple[int, tuple[int, ...], int, float, float]], steps: int = 300, ridge: float = 1e-3) -> list[float]:
    """Logistic weights from kind, votes, shape, count and probability of each pattern."""
    data = [(_inputs(k, v, s), math.log1p(n), p) for k, v, s, n, p in rows]
    total, w = sum(n for _, n, _ in data) or 1.0, [0.0] * len(_inputs(0, (0,) * len(VOTES), 0))
    for _ in range(steps):
        slope = [ridge * x for x in w]
        for x, n, p in data:
            off = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True)))))) - p)
            for i, v in enumerate(x):
                if v:
                    slope[i] += off * v
        w = [a - 2.0 * g for a, g in zip(w, slope, strict=True)]
    return w


def scored(x: Column, w: list[float]) -> Column:
    """The classifier's probability for a candidate."""
    v, total = x["v"], F.lit(w[0])
    for k in range(len(KINDS)):
        total = total + F.when(x["k"] == k, w[1 + k]).otherwise(0.0)
    for j, name in enumerate(VOTES):
        at = 1 + len(KINDS) + 2 * j
        total = total + F.when(v[name] == 1, w[at]).when(v[name] == -1, w[at + 1]).otherwise(0.0)
    for s in range(SHAPES):
        total = total + F.when(v["shape"] == s, w[1 + len(KINDS) + 2 * len(VOTES) + s]).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def trained(found: DataFrame) -> list[float]:
    """The span classifier's weights, from all candidates."""
    each = found.select(F.explode(F.concat("base", "loose")).alias("x")).select(F.col("x.k").alias("kind"), F.col("x.v").alias("v"))
    counts = each.groupBy("kind", *(F.col(f"v.{name}").alias(name) for name in (*VOTES, "shape"))).agg(F.count("*").alias("n")).collect()
    rows = sorted((r["kind"], tuple(r[name] for name in VOTES), r["shape"], float(r["n"])) for r in counts)
    post = reliabilities([(k, v, n) for k, v, _, n in rows])
    return classifier([(k, v, s, n, p) for (k, v, s, n), p in zip(rows, post, strict=True)])


def pii(docs: DataFrame) -> DataFrame:
    """Counts, hash and list of the spans of each document."""
    # What is written has places and votes, not what was found.
    voted = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), votes(x).alias("v")))
    found = written(candidates(docs).select("doc_id", voted("base").alias("base"), voted("loose").alias("loose")), "spans")
    w = trained(found)
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")
    added = found.withColumn("added", F.filter("loose", lambda x: scored(x, w) >= ACCEPT)).withColumn("every", F.array_sort(F.concat("base", "added")))
    of = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return added.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("every").alias("spans"), F.size("added").alias("n_added"))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))
