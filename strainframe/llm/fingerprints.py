"""Document fingerprints (operator 4): spot signatures, with DataFrame functions only.

Common words are anchors. The content words that follow an anchor form its chain, and anchor and chain hash to one
signature; a fingerprint is the set of a text's signatures. Two fingerprints compare by Jaccard likeness, which set
lengths bound from above. In texts of few common words content words of a certain hash are anchors too.

Defined results: a null text is empty, with an empty fingerprint; a text of no word has one signature, its own hash;
two empty fingerprints are alike (1.0), an empty and another are not (0.0). near_copies() gives repeated rows, and rows of null
doc_id, the class of their fingerprint; an empty table has no classes. Documents follow each other by descending
doc_id, then by descending text hash; a null doc_id comes last; the last is followed by the first.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import met, table, text_of, written
from .near_dedup import relabelled

# Common words of English, German, French and Spanish.
ANCHORS = """the of and to in is that it for was on are as with be by this from or an at
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch
    le la les et des une du est que dans qui par pour sur pas au avec
    el los las del se por con una su para al lo como""".split()
MARK = "\u0001"
#: Content words of a chain. A text with fewer than SPOTS common words has one content word in HASHED as anchors too, by its hash.
CHAIN, SPOTS, HASHED = 2, 8, 8
#: Longer runs of letters, as in scripts without spaces, count as words of so many.
PIECE = 20
#: Signatures of more fingerprints than this are frequent, and looked for last.
FREQUENT = 32
#: Documents of a range of ids, about, and ranges at most.
TOGETHER, RANGES = 2048, 16_384


def _words(text: Column) -> Column:
    """Content words, each with the anchors that come before the next one behind a mark."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    plain = F.regexp_replace(plain, f"([^ ]{{{PIECE}}})", "$1 ")
    marked = F.regexp_replace(plain, f" (?:({'|'.join(sorted(set(ANCHORS)))})(?= ))", f"{MARK}$1")
    return F.split(F.rtrim(marked), " ")


def _signatures(words: Column, text: Column) -> Column:
    content = lambda w: F.substring_index(w, MARK, 1)
    common = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.contains(F.get(words, i), F.lit(MARK)))
    hashed = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.contains(F.get(words, i), F.lit(MARK)) | ((content(F.get(words, i)) != "") & (F.pmod(F.xxhash64(content(F.get(words, i))), F.lit(HASHED)) == 0)))
    chain = lambda i: F.xxhash64(F.substring_index(F.get(words, i), MARK, -1), *(content(F.get(words, i + k)) for k in range(1, CHAIN + 1)))
    few = F.size(words) - F.size(F.filter(words, lambda w: ~F.contains(w, F.lit(MARK)))) < SPOTS
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.sort_array(F.array_distinct(F.transform(F.when(few, hashed).otherwise(common), chain))))


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the sorted set of the text's signatures. The words are a column of their own, so they are split once."""
    found = df.withColumn("_words", _words(F.col(text))).withColumn("_found", _signatures(F.col("_words"), F.col(text)))
    return found.withColumn(out, F.when((F.size("_found") == 0) & (F.col(text) != ""), F.array(F.xxhash64(text))).otherwise(F.col("_found"))).drop("_words", "_found")


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 0 without a comparison where their lengths keep it under least."""
    m, n = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    full = both / (m + n - both)
    return F.when((m == 0) & (n == 0), F.lit(1.0)).when((m == 0) | (n == 0) | (F.least(m, n) < least * F.greatest(m, n)), F.lit(0.0)).otherwise(full)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with key, which ascends as documents follow each other."""
    doc_id = F.col("doc_id")
    return docs.withColumn("key", F.struct(doc_id.isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not(doc_id), F.lit(0)).cast("long").alias("down"), F.bitwise_not(F.xxhash64("text")).alias("hash")))


def bounds_of(docs: DataFrame) -> list[dict]:
    """The least key of each of the ranges to which Spark's sampling deals the documents' keys: RANGES at most, whatever the input."""
    keys = _keyed(docs.select("doc_id", "text")).select("key.*")
    parts = max(1, min(RANGES, -(-docs.count() // TOGETHER)))
    least = keys.repartitionByRange(parts, "none", "down", "hash").groupBy(F.spark_partition_id()).agg(F.min(F.struct("none", "down", "hash")).alias("key")).collect()
    return sorted((r["key"].asDict() for r in least), key=lambda k: (k["none"], k["down"], k["hash"]))


def with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """docs (doc_id, text, carried) with next_<column> of the document that follows by descending doc_id.

    Ranges of keys are window partitions, which no uneven, repeated or null ids fill up; the first document of a range goes
    to the end of the range before it as a guest too. Only rows equal in doc_id and text are bound to share a range.
    """
    bounds = bounds_of(docs)
    step = max(1, math.isqrt(len(bounds)))
    of = "struct<none:int,down:bigint,hash:bigint>"
    chunks = F.from_json(F.lit(json.dumps([bounds[i : i + step] for i in range(0, len(bounds), step)])), f"array<array<{of}>>")
    first = F.from_json(F.lit(json.dumps(bounds[::step])), f"array<{of}>")
    below = lambda of: F.size(F.filter(of, lambda b: b <= F.col("key")))
    placed = _keyed(docs).withColumn("_chunk", below(first) - 1).withColumn("_chunk_bounds", F.get(chunks, F.col("_chunk"))).withColumn("_at", below(F.col("_chunk_bounds")) - 1)
    own = F.col("_chunk") * step + F.col("_at")
    into = F.when(F.get("_chunk_bounds", F.col("_at")) == F.col("key"), F.array(own, F.pmod(own - 1, F.lit(max(1, len(bounds)))))).otherwise(F.array(own))
    every = placed.select("doc_id", "text", *carried, "key", F.posexplode_outer(into).alias("guest", "range"))
    order = Window.partitionBy("range").orderBy("guest", "key")
    return every.select("doc_id", "text", *carried, "guest", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *carried))).where("guest = 0").drop("guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to each other and to the next document's."""
    own = with_signatures(text_of(docs), "text", "signatures")
    n = F.char_length("text")
    edited = with_next(own, "signatures").withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - floor(char_length(text) / 2))"), F.expr("substring(next_text, 1, floor(char_length(text) / 2))")))
    both = with_signatures(edited.select("doc_id", "n_chars", "edited", "signatures", "next_signatures"), "edited", "edited_signatures")
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown("signatures").alias("fingerprint"), shown("edited_signatures").alias("edited_fingerprint"), likeness("signatures", "edited_signatures").alias("near_edited"), likeness("signatures", "next_signatures").alias("near_next"))


def _part(n: Column, least: float) -> Column:
    """The partition of sets of n signatures: the longest set that can be alike is in the next one at most."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(least))).cast("int")


def buckets(nodes: DataFrame, least: float) -> DataFrame:
    """key, node, n: where fingerprints (node, signatures) that may be alike meet, by length partition and signature.

    Of two sets of likeness least, both have a common signature among their first n - ceil(least * n) + 1, in any order;
    infrequent ones come first here. A set goes to its own partition and to those of the longer sets that it may be like.
    """
    each = nodes.select("node", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    frequent = written(each.groupBy("s").agg(F.count("*").alias("times")).where(F.col("times") > FREQUENT), "frequent")
    ordered = met(each, frequent, ["s"], "left", F.col("node")).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "s"))).alias("by"))
    first = F.slice("by", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)
    longest = F.floor(F.col("n") / least + 1e-9)
    placed = ordered.select("node", "n", F.explode(first).alias("at")).select("node", "n", "at.s", F.explode(F.sequence(_part(F.col("n"), least), _part(longest, least))).alias("part"))
    return placed.select(F.xxhash64("part", "s").alias("key"), "node", "n")


def linked(nodes: DataFrame, least: float) -> DataFrame | None:
    """node, label of the fingerprints (node, signatures) that are like another; None if there are none.

    Rounds of pivots: a bucket's pivots are held against its members of other classes and then leave it, and buckets of one
    class are done. Pivots double each round, so a bucket of copies ends early and a mixed one in rounds by its logarithm.
    """
    members = buckets(nodes, least)
    left = written(members.join(members.groupBy("key").agg(F.count("*").alias("meets")).where("meets > 1"), "key"), "members")
    busy = written(left.groupBy("node").agg(F.sum("meets").alias("met")), "busy")
    left, sets, labels, slots = left.drop("meets").join(busy, "node"), written(nodes.join(busy, "node").select("node", "signatures"), "sets"), None, 1
    while True:
        now = left.withColumn("label", F.col("node")) if labels is None else left.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
        now = written(now.join(several, "key"), "open")
        if now.isEmpty():
            return labels
        pivots = written(now.groupBy("key", F.pmod(F.xxhash64("node", F.lit(slots)), F.lit(slots)).alias("slot")).agg(F.max(F.struct("met", "node", "n", "label")).alias("pivot")).select("key", "pivot.node", "pivot.n", "pivot.label"), "pivots")
        apart = pivots.select("key", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("label").alias("pl")).join(now, "key").where(F.col("pl") != F.col("label"))
        fits = apart.where(F.least("n", "pn") >= F.greatest("n", "pn") * least - 1e-9).select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct()
        held = fits.join(sets.toDF("a", "s"), "a").join(sets.toDF("b", "t"), "b")
        links = written(held.where(likeness("s", "t", least) >= least).select("a", "b"), "links")
        labels = relabelled(labels, links)
        left, slots = now.drop("label").join(pivots.select("key", "node"), ["key", "node"], "left_anti"), 2 * slots


def near_copies(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and class_size (rows) of each document.

    Fingerprints of a likeness of least or more are linked, and classes are what links connect. Equal fingerprints are one throughout.
    """
    own = written(with_signatures(text_of(docs), "text", "signatures").select("doc_id", F.xxhash64("signatures").alias("node"), "signatures"), "signatures")
    labels = linked(own.where(F.size("signatures") > 0).groupBy("node").agg(F.first("signatures").alias("signatures")), least)
    found = own.select("doc_id", "node")
    found = found.withColumn("label", F.col("node")) if labels is None else found.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    found = written(found, "classes")
    heads = written(found.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "heads")
    return found.join(heads, "label").select("doc_id", "class_id", "class_size")


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
