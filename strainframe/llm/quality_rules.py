"""Quality rules (operator 7): base counts of each text, and cross-document line frequency.

Lines are normalised (lower case, digits as 0, white space as one space) and hashed. For each host the documents
that hold a line are counted. Copies of one text are one document here: a document counts by its signature, the hash
of its whole text, so texts that differ at all count each. Lines found in more documents than the limits allow are
removed, and a document that keeps too little is rejected.

Defined results: a null text is empty and has no words, so it fails the base rules; a null host and an empty one are one host;
repeated rows are judged alike, row by row; columns other than doc_id, text and the host are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import met, table, written

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5
DIGITS = bytes.maketrans(b"0123456789", b"0" * 10)
#: Odd multipliers of a window's five word hashes.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
CACHED_WORDS = 400_000

SCHEMA = """doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long,
    n_repeat_words long, signature long, lines array<struct<h: long, n: int>>, text_row long"""
LINES = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))
ARROW = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "signature")), ("lines", LINES), ("text_row", pa.int64())])


class WordHashes(dict):
    """Word to 64-bit hash; holds no more than CACHED_WORDS between batches."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def window_hashes(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """One 64-bit hash for each window of five words."""
    r = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(r) - WINDOW + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    k = r[:n] * MULTIPLIERS[0]
    for j in range(1, WINDOW):
        k = (k ^ (k >> np.uint64(29))) + r[j : j + n] * MULTIPLIERS[j]
    return k ^ (k >> np.uint64(32))


def repeated_words(windows: np.ndarray) -> int:
    """Words that lie in a window found twice or more."""
    if len(windows) < 2:
        return 0
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    inside = np.isin(windows, twice)
    edge = np.zeros(len(windows) + WINDOW, dtype=np.int32)
    at = np.flatnonzero(inside)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str, hashes: WordHashes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, signature and (hash, words) of each line with a word."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    windows = window_hashes(words, hashes)
    seen: set[bytes] = set()
    dup, lines = 0, []
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            if line in seen:
                dup += 1
            seen.add(line)
            plain = b" ".join(own).decode("utf-8", "replace").lower().encode().translate(DIGITS)
            lines.append({"h": xxhash.xxh3_64_intdigest(plain) - (1 << 63), "n": len(own)})
    spaces = len(raw) - len(raw.translate(None, SPACES))
    return len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeated_words(windows), xxhash.xxh3_64_intdigest(raw) - (1 << 63), lines


def _measured(batches):
    hashes = WordHashes()
    for batch in batches:
        ids, hosts, texts, rows = (batch.column(i) for i in range(4))
        for at in range(0, len(texts), 500):
            part = texts.slice(at, 500).to_pylist()
            if len(hashes) > CACHED_WORDS:
                hashes.clear()
            cols = list(zip(*(measure(t, hashes) for t in part), strict=True))
            yield pa.RecordBatch.from_arrays([ids.slice(at, 500), hosts.slice(at, 500), *(pa.array(c, f.type) for c, f in zip(cols, list(ARROW)[2:-1], strict=True)), rows.slice(at, 500)], schema=ARROW)


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """The base counts and the hashed lines of each document."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text.alias("text"), F.xxhash64(doc_id, text).alias("text_row")).mapInArrow(_measured, SCHEMA)


def quality_rules(docs: DataFrame, host: str = "source", least_documents: int = 10, share_of_host: float = 0.002, least_words: int = 10, most_repeated: int = 20, least_left: int = 5, least_kept: float = 0.2, with_row: bool = False) -> DataFrame:
    """One row per row of docs: the base counts, words_left, base_failed and kept; with_row adds text_row, xxhash64 of doc_id and text.

    A line is removed where more than least_documents documents of its host, and more than share_of_host of them,
    hold it. base_failed: fewer than least_words words, or more than most_repeated per cent of them in repeated windows.
    Not kept: base_failed, or fewer than least_left words or least_kept of all words are left after the removal.
    """
    base = written(measured(docs, host), "rules").withColumn("row", F.xxhash64("text_row", "host"))
    lines = base.select("row", "host", "signature", F.explode("lines").alias("line")).select("row", "host", "signature", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    sizes = base.groupBy("host", "signature").agg(F.count("*").alias("copies")).groupBy("host").agg(F.count("*").alias("host_documents"))
    found = lines.groupBy("host", "h", "signature").agg(F.count("*").alias("times")).groupBy("host", "h").agg(F.count("*").alias("documents"))
    common = found.where(F.col("documents") > least_documents).join(sizes, "host").where(F.col("documents") > share_of_host * F.col("host_documents")).select("host", "h")
    # A row that occurs more than once has its lines once here: rows of one hash have the same text and host.
    once = lines.groupBy("row", "host", "h").agg((F.sum("n") / F.count("*")).alias("n"), F.count("*").alias("times"))
    rows = base.groupBy("row").agg(F.count("*").alias("same"))
    gone = met(once, written(common, "common"), ["host", "h"], "left_semi", F.col("row"))
    removed = gone.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("gone")).join(rows, "row").select("row", F.round(F.col("gone") / F.col("same")).cast("long").alias("removed"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return base.join(removed, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left >= least_left) & (left >= least_kept * F.col("n_words"))).alias("kept"), left.alias("words_left"), *(["text_row"] if with_row else []))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
