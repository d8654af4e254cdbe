"""Line dedup (operator 8): a log-template tree of fixed depth, with DataFrame functions only.

Lines are in lower case, with tokens that hold a digit generalised to <*>. The tree has the token count at its first
level and the leading tokens below. A leaf holds several templates: one of all its lines, and one of the lines that share a run
of tokens; there are so many runs that lines that differ in no more places than a template allows share one. A template takes, position by
position, the token that most of its documents have. A template has variable places for a tenth of its tokens, MOST_FIELDS at most: a
long line that agrees with it in all others belongs to it, with several to each of them, and goes with the one of most documents; every other line is a template of its own.
A template found in least_documents documents or more is dropped from all of them but the first (least doc_id).

Copies of a text are one document here: documents count by their signature, the hash of the whole text. So copies
keep their lines; whole copies are the near-dedup's work. Texts that differ at all, near copies too, are documents of their own.

Defined results: a null text stays null, an empty one empty; lines of white space alone are never dropped; a text may become
empty; repeated rows lose equal lines; rows of a null doc_id are never first unless no other document has the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import met, table, written

#: Leading tokens below the token count; lines of so many tokens can differ from a template in DIFFERENT of them, MOST_FIELDS at most.
DEPTH, LONG, DIFFERENT, MOST_FIELDS = 3, 10, 0.1, 20
FIELD = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"


def normalised(text: Column) -> Column:
    """Lines as one array: lower case, single spaces, variable fields as <*>."""
    # Most white space is one space and most lines hold no digit: the patterns meet only what changes.
    lines = F.split(F.regexp_replace(F.lower(text), r"[^\S\n ][^\S\n]*+|\x20[^\S\n]++", " "), "\n")
    return F.transform(lines, lambda line: F.when(F.rlike(line, F.lit("[0-9]")), F.regexp_replace(line, FIELD, "<*>")).otherwise(line))


def _parsed(line: Column) -> Column:
    own = F.trim(line)
    n = F.octet_length(own) - F.octet_length(F.replace(own, F.lit(" "))) + 1
    return F.struct(F.xxhash64(own).alias("h"), F.when(own == "", 0).otherwise(n).alias("n"), F.xxhash64(F.substring_index(own, " ", DEPTH), n).alias("leaf"))


def parsed(docs: DataFrame) -> DataFrame:
    """doc_id, row, signature, and position, hash, token count and leaf of each line that is not blank."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), F.xxhash64("text").alias("signature"), normalised(F.coalesce("text", F.lit(""))).alias("_lines"))
    # The outer form, as the inner one would infer a filter on the array's size, which parses every text once more.
    every = own.select("doc_id", "row", "signature", F.posexplode_outer("_lines").alias("at", "line")).select("doc_id", "row", "signature", "at", _parsed(F.col("line")).alias("line"))
    return every.where("line.n > 0").select("doc_id", "row", "signature", "at", "line.h", "line.n", "line.leaf")


def _documents(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct documents of each key."""
    return df.groupBy(*keys, "signature").agg(F.count("*").alias("_")).groupBy(*keys).agg(F.count("*").alias("documents"))


def of_leaves(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """Lines whose leaf is among leaves."""
    return met(lines, leaves, ["leaf"], "left_semi", F.col("h"))


def _fields() -> Column:
    """How many places of a line a template leaves open."""
    return F.least(F.floor(F.size("words") * DIFFERENT), F.lit(MOST_FIELDS).cast("long"))


def _groups() -> Column:
    """The leaf and, for each of the runs that a line's tokens after the leading ones are cut into, the hash of leaf, run and its tokens."""
    runs = _fields() + 1
    end = lambda j: (DEPTH + F.floor(j * (F.size("words") - DEPTH) / runs)).cast("int")
    run = lambda j: F.xxhash64("leaf", j, F.slice("words", end(j) + 1, end(j + 1) - end(j)))
    return F.concat(F.array("leaf"), F.transform(F.sequence(F.lit(0).cast("long"), runs - 1), run))


def generalised(docs: DataFrame, lines: DataFrame, least_documents: int) -> DataFrame:
    """h and group of the long lines that belong to a template of a leaf which enough documents and two lines or more share."""
    long = lines.where(F.col("n") >= LONG)
    shared = _documents(long, "leaf").where(F.col("documents") >= least_documents).select("leaf")
    # Both sides have one row a leaf: no task meets all rows of a hot one.
    several = long.groupBy("leaf").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("leaf").join(shared, "leaf")
    several = written(several, "leaves")
    if several.isEmpty():
        return lines.sparkSession.createDataFrame([], "h long, leaf long")
    long = of_leaves(long, several)
    # One document of each line is enough to read its tokens from.
    sources = written(long.groupBy("leaf", "h").agg(F.min("row").alias("row")).select("row").distinct(), "sources")
    own = docs.select("text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"))
    own = met(own, sources, ["row"], "left_semi", F.lit(0))
    texts = own.select(F.explode_outer(normalised(F.coalesce("text", F.lit("")))).alias("line")).select(F.trim("line").alias("line"), _parsed(F.col("line")).alias("p")).where(F.col("p.n") >= LONG).select("line", "p.h", "p.leaf")
    texts = of_leaves(texts, several).groupBy("leaf", "h").agg(F.first("line").alias("line"))
    # Each line's tokens stand here once; its groups are rows of two hashes.
    texts = written(texts.select("leaf", "h", F.transform(F.split("line", " "), lambda t: F.xxhash64(t)).alias("words")), "texts")
    groups = written(texts.select("leaf", "h", F.explode(_groups()).alias("group")), "groups")
    # Groups of the same lines are one: near copies of a long line share most of their runs.
    held = groups.groupBy("group").agg(F.first("leaf").alias("leaf"), F.count("*").alias("n"), F.bit_xor("h").alias("all"), F.sum(F.col("h").cast("decimal(20,0)")).alias("sum")).where("n > 1")
    held = held.groupBy("leaf", "n", "all", "sum").agg(F.min("group").alias("group")).select("group")
    pairs = met(groups.select("h", "group"), held, ["group"], "left_semi", F.col("h"))
    texts = written(texts.select("h", "words").join(pairs, "h").select("h", "words", F.col("group").alias("leaf")), "words")
    tokens = texts.join(_documents(long, "h"), "h").select("leaf", "documents", F.posexplode_outer("words").alias("pos", "token"))
    # The heaviest token of a position, among equals that of the largest low bits.
    rank = F.col("w") * (1 << 24) + F.col("token").bitwiseAND(F.lit((1 << 24) - 1))
    chosen = tokens.groupBy("leaf", "pos", "token").agg(F.sum("documents").alias("w")).groupBy("leaf", "pos").agg(F.max_by("token", rank).alias("constant"))
    template = chosen.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("pos", "constant")))["constant"].alias("constants"))
    # Rows as long as lines: not broadcast by their number. Spark splits the rows of a hot leaf, as both sides are plain exchanges.
    both = texts.join(written(template, "constants"), "leaf")
    same = F.size(F.filter(F.zip_with("words", "constants", lambda a, b: a == b), lambda x: x))
    return both.where(F.size("words") - same <= _fields()).select("h", "leaf")


def recurring(docs: DataFrame, lines: DataFrame, least_documents: int) -> DataFrame:
    """h of the lines whose templates recur, and the first document of the template."""
    groups = generalised(docs, lines, least_documents)
    # A line that belongs to templates is counted for each of them; every other line is its own.
    groups = written(groups.groupBy("h").agg(F.collect_list("leaf").alias("templates")), "named")
    named = met(lines, groups, ["h"], "left", F.col("row")).withColumn("template", F.explode(F.coalesce("templates", F.array("h"))))
    counted = named.groupBy("template", "h", "signature").agg(F.min("doc_id").alias("first"))
    totals = counted.groupBy("template", "signature").agg(F.min("first").alias("first")).groupBy("template").agg(F.count("*").alias("documents"), F.min("first").alias("first")).where(F.col("documents") >= least_documents)
    found = counted.select("template", "h").distinct().join(totals, "template")
    return found.groupBy("h").agg(F.max(F.struct("documents", "template", "first"))["first"].alias("first"))


def line_dedup(docs: DataFrame, least_documents: int = 5) -> DataFrame:
    """docs with its text less the dropped lines, and n_lines and n_dropped in place of columns of these names."""
    lines = written(parsed(docs), "lines")
    common = written(recurring(docs, lines, least_documents), "templates")
    gone = met(lines, common, ["h"], "inner", F.col("row")).where(~F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    own = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"))
    text = F.col("doc.text")
    out = own.join(gone, "row", "left").select("doc", "gone", F.when(F.col("gone").isNotNull(), F.split(text, "\n")).alias("lines"))
    # What is left are the runs of lines between the dropped ones.
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    run = lambda a, b: F.slice("lines", a + 2, b - a - 1)
    left = F.array_join(F.flatten(F.zip_with(F.slice(edges, 1, F.size("gone") + 1), F.slice(edges, 2, F.size("gone") + 1), run)), "\n")
    return out.select(
        *(F.coalesce(left, text).alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")),
        (F.regexp_count(F.coalesce(text, F.lit("")), F.lit("\n")) + 1).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")
