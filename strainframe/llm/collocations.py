"""Phrase collocation mining (operator 12): prefix-free parsing.

Pieces of texts (between punctuation) are parsed into chunks by their content: a chunk ends where the hash of its last
OVERLAP words is a trigger, or with its piece, and the next chunk begins with these words. Equal chunks become one row of a
dictionary with the number of times they were parsed. Phrases are counted inside distinct chunks, weighted by that number. Every phrase
of up to OVERLAP + 1 words lies in a chunk whole, and the one that holds its first word outside the overlap with the next chunk counts it,
so what lies in an overlap is counted once.

Words are counted as they are parsed. Pairs of frequent words are counted by a hash first, and what the second, exact count looks at
are pairs whose hash is found LEAST times or more, and triples of two such pairs. That is asked of bit arrays of fixed size (FILTER_BITS,
broadcast): more phrases than they can tell apart make more rows, never other results.

Per lang, a candidate is a phrase of 2 or 3 words found LEAST times or more. Its score is the lowest over its cuts into two
parts, floor(1000000 * a * a / (l * r)), ties to the first cut; it goes if a longer candidate that holds it has 100 * f >= 50 * a.

Defined results: null and empty texts have no words, a null lang is `und`; repeated rows count each; A-Z are lowered and nothing else;
ties of score and frequency go by the bytes of the phrase; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import met, table, written

LEAST, TOP, SHADOWED, MOST_WORDS = 10, 2000, 50, 3
#: Words that consecutive chunks share; one pair of words in EVERY ends a chunk.
OVERLAP, EVERY = MOST_WORDS - 1, 16
FILTER_BITS = 1 << 26
#: Distinct words and hashes that a task holds before it hands them on; chunks it looks at together; hashes of words kept; groups of the first round of ranking.
HELD, TOGETHER, CACHED_WORDS, SLOTS = 200_000, 120_000, 400_000, 64
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Separators become one that is a token of its own, which no word can be.
PIECES = bytes.maketrans(SEPARATORS + bytes(range(65, 91)), b"." * len(SEPARATORS) + bytes(range(97, 123)))
END = b" . "
MIX, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


class Hashes(dict):
    """Word to 64-bit hash; the separator has 0."""

    def __init__(self) -> None:
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word) or 1
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
            self[b"."] = 0
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two hashes in their order."""
    k = (a ^ (a >> SHIFT)) * MIX + b
    k = (k ^ (k >> SHIFT)) * MIX
    return k ^ (k >> SHIFT)


def tokens_of(texts: list[bytes]) -> list[bytes]:
    """The words of texts, with the separator after each piece and text."""
    return END.join(texts).translate(PIECES).replace(b".", END).split() + [b"."]


def chunks(tokens: list[bytes], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, token after the last and whether it ends its piece, of each chunk."""
    stop = np.flatnonzero(h == 0)
    first = np.concatenate(([0], stop[:-1] + 1))
    first, stop = first[stop > first], stop[stop > first]
    # Tokens since the piece began, and until it ends.
    number = np.repeat(np.arange(len(first)), stop - first)
    at = np.flatnonzero(h != 0)
    since, until = at - first[number], stop[number] - at
    ends = at[(since >= OVERLAP) & (until > 1)]
    if len(ends):
        ends = ends[mixed(h[ends - 1], h[ends]) % np.uint64(EVERY) == 0]
    stops = np.sort(np.concatenate((stop, ends + 1)))
    return np.sort(np.concatenate((first, ends - OVERLAP + 1))), stops, h[stops] == 0


def distinct_words(tokens: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct tokens, and the number of each token among them."""
    found = tokens.dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)


PARSED = pa.schema([("lang", pa.string()), ("last", pa.bool_()), ("chunk", pa.binary()), ("n", pa.int64())])


def _rows(lang: str, lasts: pa.Array, found: list[bytes], ns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(found)), lasts, pa.array(found, pa.binary()), ns], schema=PARSED)


def _parsed(batches):
    hashes, words = Hashes(), defaultdict(Counter)

    def counted():
        for lang, found in words.items():
            found.pop(b".", None)
            yield _rows(lang, pa.nulls(len(found), pa.bool_()), list(found), pa.array(found.values(), pa.int64()))
        words.clear()

    for batch in batches:
        by_lang = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            by_lang[lang].append(text)
        for lang, texts in by_lang.items():
            for i in range(0, len(texts), 1000):
                tokens = tokens_of(texts[i : i + 1000])
                own, ids = distinct_words(pa.array(tokens, pa.binary()))
                counts = words[lang]
                for word, n in zip(own, np.bincount(ids).tolist(), strict=True):
                    counts[word] += n
                first, stop, last = chunks(tokens, hashes.of(own)[ids])
                # A chunk of one word has no phrase.
                several = stop - first > 1
                found = [b" ".join(tokens[a:b]) for a, b in zip(first[several].tolist(), stop[several].tolist(), strict=True)]
                yield _rows(lang, pa.array(last[several]), found, pa.repeat(pa.scalar(1, pa.int64()), len(found)))
        if sum(map(len, words.values())) > HELD:
            yield from counted()
    yield from counted()


def dictionary(docs: DataFrame) -> DataFrame:
    """lang, last (whether it ends its piece), chunk and how often it was parsed; and with last null: the words and how often they were found."""
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(_parsed, "lang string, last boolean, chunk binary, n long").groupBy("lang", "last", "chunk").agg(F.sum("n").alias("n"))


class Bits:
    """A bit array (a power of two of bits) that says of a 64-bit hash whether it may be in the set."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def __getitem__(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(64 * len(self.words) - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bits(hashes: DataFrame):
    """The column h of hashes as a broadcast bit array: FILTER_BITS / 64 numbers reach the driver at most."""
    at = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = hashes.select(F.shiftright(at, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(words.view(np.uint64))


def seeds(langs: list[str]) -> np.ndarray:
    known = {x: np.uint64(xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))) for x in set(langs)}
    return np.fromiter(map(known.__getitem__, langs), dtype=np.uint64, count=len(langs))


class Phrases:
    """Chunks as numbers of words, with the hash of lang and word, and which phrases begin at each."""

    def __init__(self, rows: pa.Table, hashes: Hashes) -> None:
        names = rows.column(0).combine_chunks().dictionary_encode()
        self.names, self.lang = names.dictionary.to_pylist(), names.indices.to_numpy().astype(np.int64)
        lasts, ns = rows.column(1).to_numpy(), rows.column(3).to_numpy()
        split = pc.split_pattern(rows.column(2).combine_chunks(), b" ")
        words, ids = distinct_words(split.flatten())
        # A separator of number and hash 0 follows each chunk.
        many = pc.list_value_length(split).to_numpy()
        size, stop = many + 1, np.cumsum(many + 1) - 1
        self.words, self.ids = pa.array([b".", *words], pa.binary()), np.zeros(len(ids) + len(many), dtype=np.int64)
        self.ids[np.arange(len(ids)) + np.repeat(np.arange(len(many)), many)] = ids + 1
        self.n_words, h = len(self.words), np.concatenate((np.zeros(1, dtype=np.uint64), hashes.of(words)))[self.ids]
        self.row = np.repeat(np.arange(len(stop)), size)
        self.left = stop[self.row] - np.arange(len(h))  # tokens from here to the end of the chunk
        self.n = ns[self.row]
        # Phrases that begin in the overlap belong to the next chunk.
        self.begins = (h != 0) & (self.left > np.where(lasts, 0, OVERLAP)[self.row])
        self.one = mixed(seeds(self.names)[self.lang[self.row]], h)
        self.two = np.append(mixed(self.one[:-1], h[1:]), np.uint64(0))

    def pairs(self, words: Bits) -> np.ndarray:
        """Where pairs of frequent words begin."""
        at = np.flatnonzero(self.begins & (self.left >= 2))
        often = words[self.one]
        return at[often[at] & often[at + 1]]

    def distinct(self, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each phrase among those of so many words at these places is first, and its number: told apart by lang and words."""
        key, size = self.lang[self.row[at]], len(self.names)
        for j in range(words):
            if size * self.n_words >= 1 << 62:
                key, size = np.unique(key, return_inverse=True)[1], len(at)
            key, size = key * self.n_words + self.ids[at + j], size * self.n_words
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
        return at[order[first]], (np.add.reduceat(self.n[at[order]], first) if len(first) else first)


def together(batches):
    """Batches as tables of TOGETHER rows or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            yield pa.Table.from_batches(held)
            held.clear()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, dtype=np.int64)
    return h[first], (np.add.reduceat(n, first) if len(h) else n)


def _word_hashes(batches):
    hashes = Hashes()
    for batch in batches:
        h = mixed(seeds(batch.column(0).to_pylist()), hashes.of(batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def frequent_pairs(chunk_rows: DataFrame, words) -> DataFrame:
    """h of the pairs of frequent words whose hash is found LEAST times or more."""

    def counted(batches):
        hashes, often = Hashes(), Bits(words.value)
        for rows in together(batches):
            phrases = Phrases(rows, hashes)
            at = phrases.pairs(often)
            h, n = _summed(phrases.two[at], phrases.n[at])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return chunk_rows.mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("h")


def counted_phrases(chunk_rows: DataFrame, words, pairs) -> DataFrame:
    """lang, words (how many), phrase and f of the phrases of several words found LEAST times or more."""

    def named(batches):
        hashes, often, together_often = Hashes(), Bits(words.value), Bits(pairs.value)
        for rows in together(batches):
            phrases = Phrases(rows, hashes)
            at = phrases.pairs(often)
            at = at[together_often[phrases.two[at]]]
            is_pair = np.zeros(len(phrases.ids) + 1, dtype=bool)
            # The second pair of a triple may begin in the overlap.
            whole = np.flatnonzero(phrases.left >= 3)
            is_pair[at] = True
            second = whole[is_pair[whole]] + 1
            second = second[often[phrases.one[second + 1]] & together_often[phrases.two[second]]]
            for size, places in ((2, at), (3, second - 1)):
                first, n = phrases.distinct(places, size)
                found = pc.binary_join_element_wise(*(phrases.words.take(pa.array(phrases.ids[first + j])) for j in range(size)), b" ")
                langs = pa.array(phrases.names, pa.string()).take(pa.array(phrases.lang[phrases.row[first]]))
                yield pa.RecordBatch.from_arrays([langs, pa.repeat(pa.scalar(size, pa.int32()), len(found)), found, pa.array(n, pa.int64())], names=["lang", "words", "phrase", "f"])

    rows = chunk_rows.mapInArrow(named, "lang string, words int, phrase binary, f long").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return rows.where(F.col("f") >= LEAST).withColumn("phrase", F.col("phrase").cast("string"))


def _score(l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) in decimals of 38 digits: exact up to counts of 10^15."""
    long = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (long(F.col("a")) * long(F.col("a"))).cast("decimal(31,0)"), long(l) * long(r))


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the TOP candidates of each lang."""
    parsed = written(dictionary(docs), "chunks")
    chunk_rows, found = parsed.where("last IS NOT NULL"), parsed.where("last IS NULL")
    words = found.where(F.col("n") >= LEAST)
    word_bits = bits(words.select("lang", "chunk").mapInArrow(_word_hashes, "h long"))
    pair_bits = bits(frequent_pairs(chunk_rows, word_bits))
    counts = written(counted_phrases(chunk_rows, word_bits, pair_bits), "phrases")
    f = counts.select("lang", "phrase", "f").unionByName(words.select("lang", F.col("chunk").cast("string").alias("phrase"), F.col("n").alias("f")))
    cands = counts.select("lang", "words", "phrase", F.col("f").alias("a"))
    # Each candidate with the longest candidates' frequency that holds it.
    around = cands.where("words = 3").select("lang", "a", F.split("phrase", " ").alias("w")).select("lang", "a", F.explode(F.array(F.concat_ws(" ", F.slice("w", 1, 2)), F.concat_ws(" ", F.slice("w", 2, 2)))).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    left = cands.join(around, ["lang", "phrase"], "left").where(~(F.coalesce(100 * F.col("held") >= SHADOWED * F.col("a"), F.lit(False)))).drop("held")
    w = F.split("phrase", " ")
    part = lambda a, n: F.concat_ws(" ", F.slice("w", a, n))
    cuts = left.withColumn("w", w).select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("head"), part(k + 1, F.col("words") - k).alias("rest")))).alias("cut")).select("lang", "phrase", "a", "cut.*")
    side = lambda name, c: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(c))
    # A word may be a part of very many candidates, a pair of no more than there are words.
    one = lambda c: ~F.contains(c, F.lit(" "))
    cuts = met(cuts, side("head", "l"), ["lang", "head"], "inner", F.col("phrase"), one("head"))
    cuts = met(cuts, side("rest", "r"), ["lang", "rest"], "inner", F.col("phrase"), one("rest"))
    best = cuts.withColumn("score", _score(F.col("l"), F.col("r"))).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = best.withColumn("slot", F.pmod(F.xxhash64("phrase"), F.lit(SLOTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slot").orderBy(*order))).where(F.col("rank") <= TOP)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= TOP)
    totals = found.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def collocations_sql() -> str:
    lowered = f"translate(coalesce(text, ''), '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lowered}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, piece, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
q AS (SELECT lang, word, lead(word, 1) OVER here AS second, lead(word, 2) OVER here AS third FROM t WINDOW here AS (PARTITION BY piece ORDER BY i)),
g AS (SELECT lang, 1 AS k, word AS phrase FROM q UNION ALL SELECT lang, 2, word || ' ' || second FROM q WHERE second IS NOT NULL UNION ALL SELECT lang, 3, word || ' ' || second || ' ' || third FROM q WHERE third IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10),
h AS (SELECT lang, phrase, max(a) AS held FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE k = 3) GROUP BY ALL),
s AS (SELECT c.* FROM c LEFT JOIN h ON c.k = 2 AND h.lang = c.lang AND h.phrase = c.phrase WHERE coalesce(100 * held < 50 * a, true)),
u AS (SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS head, array_to_string(w[i + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS i FROM s)),
x AS (SELECT u.lang, u.phrase, u.a, i, l.f AS l, r.f AS r, 1000000::HUGEINT * u.a * u.a // (l.f::HUGEINT * r.f) AS score FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.head JOIN f r ON r.lang = u.lang AND r.phrase = u.rest),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b QUALIFY rank <= 2000)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM z JOIN n USING (lang)"""
