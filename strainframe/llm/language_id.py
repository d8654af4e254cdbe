"""Language ID (operator 11): interpolated Kneser-Ney models of characters, one for each language.

Words are runs of letters in lower case, cut at LONGEST letters, with a mark before and after. Words of all documents to learn from are
counted by lang, their n-grams of up to ORDER characters come from the distinct words, and continuation counts of the lower
orders from the distinct n-grams of the next. A model is two sorted arrays of hashes for each order: of n-grams, with what is left of their
shares after the discount, and of contexts, with the share that goes to the next lower order; below all orders every character is alike.
N-grams of less than RAREST of their order's count in a lang are left to the lower orders, so a model has at most 1 / RAREST of either for each
order at any size of the corpus: that bounds what is broadcast, by 12 MB a lang.

A text has the lang whose model gives the least cross-entropy for each character. How far the next best lies behind, by the
root of the length, is calibrated by documents that a first pair of models hasn't seen (a quarter): the score is the share of right
answers at this margin, made monotone. A text is rejected below LEAST_SCORE, or above nearly all cross-entropies that its lang has there.

Learns from rows of known lang and doc_id whose crc32(doc_id) mod 4 is not 2; lang, source and doc_id are never inputs of a prediction.

Defined results: a null text, an empty one or one without letters is `und` with score 0, and every text is where there is nothing to learn from;
ties of cross-entropy go to the first lang by name; a null doc_id is predicted, never held out and never learned from; repeated rows count each
and get equal results; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

ORDER, LONGEST, RAREST = 5, 24, 1e-5
WORD = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{LONGEST - 1}}}")
BEGIN, END = "\x02", "\x03"
#: Words and grams that a task holds before it hands them on; cells of the matrix of words' log-likelihoods.
HELD, CACHED_CELLS = 200_000, 4_000_000
#: Bins of margins and of cross-entropies (in bits); the share of a lang's documents that lie under its ceiling.
MARGINS, ENTROPY_BIN, CEILING, LEAST_SCORE = 128, 0.0625, 0.999, 0.5
MIX = np.uint64(0x9E3779B97F4A7C15)


def _plain() -> bytes:
    """Each character of Latin-1 in lower case, or a space if it is no letter."""
    return "".join(c.lower() if regex.match(r"\p{L}", c) else " " for c in map(chr, range(256))).encode("latin-1")


PLAIN = _plain()


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    try:  # most texts; the same words by a faster way
        words = text.encode("latin-1").translate(PLAIN).decode("latin-1").split()
        if max(map(len, words), default=0) <= LONGEST:
            return words
    except UnicodeEncodeError:
        pass
    return WORD.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())


def _tallies(found: dict, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*((*k, *(n if isinstance(n, list) else [n])) for k, n in found.items()), strict=True)) or [[]] * len(names)
    found.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _worded(batches):
    found: dict[tuple, Counter] = defaultdict(Counter)

    def out():
        every = {(*k, w): n for k, words in found.items() for w, n in words.items()}
        found.clear()
        return _tallies(every, [pa.string(), pa.bool_(), pa.string(), pa.int64()], ["lang", "fits", "word", "n"])

    for batch in batches:
        for lang, fits, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found[lang, fits].update(words_of(text))
            if sum(map(len, found.values())) > HELD:
                yield out()
    yield out()


def _grammed(batches):
    found: dict[tuple, list] = defaultdict(lambda: [0, 0])
    out = lambda: _tallies(found, [pa.string(), pa.string(), pa.int64(), pa.int64()], ["lang", "gram", "c", "c_fit"])
    for batch in batches:
        for lang, word, c, c_fit in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            marked = BEGIN + word + END
            for i in range(2, len(marked) + 1):
                both = found[lang, marked[max(0, i - ORDER) : i]]
                both[0] += c
                both[1] += c_fit
            if len(found) > HELD:
                yield out()
    yield out()


def counted(docs: DataFrame) -> DataFrame:
    """lang, size, gram and its count c at its order (of the highest and of those that begin a word: occurrences; else continuations), c_fit without the calibrating documents."""
    rest = F.crc32(F.col("doc_id").cast("long").cast("string")) % 4
    known = docs.where((rest != 2) & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), (rest != 3).alias("fits"), F.col("text").cast("string").alias("text"))
    words = known.mapInArrow(_worded, "lang string, fits boolean, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("c"), F.sum(F.when(F.col("fits"), F.col("n")).otherwise(0)).alias("c_fit"))
    grams = words.mapInArrow(_grammed, "lang string, gram string, c long, c_fit long").groupBy("lang", "gram").agg(F.sum("c").alias("c"), F.sum("c_fit").alias("c_fit"))
    grams = written(grams.withColumn("size", F.char_length("gram")), "grams")
    levels = [grams.where(F.col("size") == ORDER)]
    for size in range(ORDER - 1, 0, -1):
        # How many different characters come before it.
        continued = levels[-1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c"), F.sum((F.col("c_fit") > 0).cast("long")).alias("c_fit"))
        levels.append(written(continued.withColumn("size", F.lit(size)).unionByName(grams.where(F.col("size") == size)), f"grams{size}"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def mixed(codes: list[np.ndarray]) -> np.ndarray:
    """The hash of n-grams, given as columns of code points."""
    h = np.full(len(codes[0]), len(codes), dtype=np.uint64)
    for c in codes:
        h = (h ^ (h >> np.uint64(31))) * MIX + c.astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def _hashes(grams: list[str], size: int) -> np.ndarray:
    if not size:
        return np.zeros(len(grams), dtype=np.uint64)
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), dtype=np.uint32).reshape(-1, size)
    return mixed(list(codes.T))


class Shares:
    """A sorted array of hashes, and for each the langs that have it with their shares."""

    def __init__(self, langs: list[int], hashes: list[np.ndarray], shares: list[np.ndarray]) -> None:
        h = np.concatenate((*hashes, np.empty(0, dtype=np.uint64)))
        order = np.argsort(h, kind="stable")
        self.keys, self.first = np.unique(h[order], return_index=True)
        self.n = np.diff(np.append(self.first, len(h)))
        self.lang = np.repeat(np.array(langs, dtype=np.int16), [len(x) for x in hashes])[order]
        self.share = np.concatenate((*shares, np.empty(0))).astype(np.float32)[order]

    def put(self, out: np.ndarray, where: np.ndarray, h: np.ndarray) -> None:
        """Sets out[position, lang] to the shares of h at the positions where."""
        if not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == h)
        at, where = at[known], where[known]
        n = self.n[at]
        entry = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[np.repeat(where, n), self.lang[entry]] = self.share[entry]


def shares_of(size: int, grams: list[str], counts: np.ndarray, contexts: list[str], sums: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shares of n-grams (counts), and of contexts (sums: of all n-grams that begin with one) what their n-grams leave to the lower order."""
    h, own = _hashes(contexts, size - 1), _hashes([g[:-1] for g in grams], size - 1)
    order = np.argsort(h)
    h, sums = h[order], sums[order]
    at = np.searchsorted(h, own)
    shares = (counts - discount) / sums[at]
    return _hashes(grams, size), shares, h, np.clip(1 - np.bincount(at, shares, len(h)), 1e-9, 1.0)


class Models:
    """All langs' models in the order of their names, and the calibration once there is one."""

    def __init__(self, langs: list[str], grams: list[Shares], contexts: list[Shares], characters: int) -> None:
        self.langs, self.grams, self.contexts, self.uniform = langs, grams, contexts, 1 / (characters + 1)
        self.scores, self.ceilings, self.name = np.zeros(MARGINS), np.full(len(langs), np.inf), uuid.uuid4().hex

    def words(self, words: list[str]) -> np.ndarray:
        """log2 of the likelihood of each word in each lang."""
        codes = np.frombuffer("".join(f"{BEGIN}{w}{END}" for w in words).encode("utf-32-le"), dtype=np.uint32)
        first = np.cumsum([0, *(len(w) + 2 for w in words[:-1])])
        since = np.arange(len(codes)) - np.repeat(first, [len(w) + 2 for w in words])
        p = np.full((len(codes), len(self.langs)), self.uniform)
        before = np.zeros(len(codes), dtype=np.uint64)
        for size, (grams, contexts) in enumerate(zip(self.grams, self.contexts, strict=True), 1):
            h = mixed([np.roll(codes, back) for back in range(size - 1, -1, -1)])  # of use where since >= size - 1
            at = np.flatnonzero((since >= size - 1) & (since > 0))
            lower, own = np.ones((len(codes), len(self.langs))), np.zeros((len(codes), len(self.langs)))
            contexts.put(lower, at, before[at - 1])
            grams.put(own, at, h[at])
            p = own + lower * p
            before = h
        p[since == 0] = 1.0
        return np.add.reduceat(np.log2(p), first, axis=0)


class Scorer:
    """Predictions of texts; keeps the log-likelihoods of words it has met, up to CACHED_CELLS numbers."""

    def __init__(self, models: Models) -> None:
        self.models, self.at = models, {}
        self.most = max(1000, CACHED_CELLS // max(1, len(models.langs)))
        self.logs = np.empty((0, len(models.langs)))

    def _learn(self, texts: list[list[str]]) -> None:
        """Makes sure that the words of texts are known."""
        if len(self.at) > self.most:
            self.at = {}
        new = [w for w in dict.fromkeys(w for words in texts for w in words) if w not in self.at]
        old, need = len(self.at), len(self.at) + len(new)
        if need > len(self.logs):
            grown = np.empty((2 * need, len(self.models.langs)))
            grown[:old] = self.logs[:old]
            self.logs = grown
        step = max(100, CACHED_CELLS // 20 // max(1, len(self.models.langs)))
        for i in range(0, len(new), step):
            part = new[i : i + step]
            self.logs[old + i : old + i + len(part)] = self.models.words(part)
        self.at |= zip(new, range(old, need), strict=True)

    def _judged(self, words: list[str]) -> tuple[int, float, float]:
        if not words:
            return -1, 0.0, 0.0
        at = np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))
        size = sum(map(len, words)) + len(words)
        bits = -self.logs[at].sum(axis=0) / size
        best = int(bits.argmin())
        others = np.append(np.delete(bits, best), -np.log2(self.models.uniform))
        return best, float(bits[best]), float(others.min() - bits[best]) * size**0.5

    def predicted(self, texts: list[str | None]) -> list[tuple[int, float, float]]:
        """Of each text: which lang (-1: none), its cross-entropy (bits a character) and the margin."""
        out = []
        for i in range(0, len(texts), 200):
            words = [words_of(t) if self.models.langs else [] for t in texts[i : i + 200]]
            self._learn(words)
            out += map(self._judged, words)
        return out


_last: list[Scorer] = []


def scorer_of(models: Models) -> Scorer:
    """The scorer that this process has for models: words that one task met are known to the next."""
    if not _last or _last[0].models.name != models.name:
        _last[:] = [Scorer(models)]
    return _last[0]


def margin_bin(margin: float) -> int:
    return int(min(MARGINS - 1, max(0.0, 12 * np.log2(1 + 4 * max(0.0, margin)))))


def monotone(right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shares of right answers that never fall from bin to bin: the nearest by squares (pools of adjacent violators). Empty bins go with their neighbours."""
    pools: list[list[float]] = []
    for r, m in zip(right, n, strict=True):
        pools.append([float(r), float(m), 1])
        while len(pools) > 1 and (pools[-1][1] == 0 or pools[-2][1] == 0 or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            r, m, k = pools.pop()
            pools[-1] = [pools[-1][0] + r, pools[-1][1] + m, pools[-1][2] + k]
    return np.concatenate([np.full(int(k), (r + 0.5) / (m + 1)) for r, m, k in pools])


def models(counts: DataFrame, column: str) -> Models:
    """The models by the counts of column: at most 1 / RAREST n-grams and contexts of each lang and order reach the driver."""
    rows = counts.where(F.col(column) > 0).select("lang", "size", "gram", F.expr("substring(gram, 1, size - 1)").alias("context"), F.col(column).alias("c"))
    totals = rows.groupBy("lang", "size").agg(F.sum("c").alias("total"), F.sum((F.col("c") == 1).cast("long")).alias("once"), F.sum((F.col("c") == 2).cast("long")).alias("twice")).toArrow().to_pylist()
    total = {(x["lang"], x["size"]): x["total"] for x in totals}
    # One row for each lang and order.
    least = F.broadcast(rows.sparkSession.createDataFrame([(lang, size, RAREST * n) for (lang, size), n in total.items()], "lang string, size int, least double"))
    kept = rows.join(least, ["lang", "size"]).where(F.col("c") >= F.col("least")).select("lang", "size", "gram", "c").toArrow()
    sums = rows.groupBy("lang", "size", "context").agg(F.sum("c").alias("c")).join(least, ["lang", "size"]).where(F.col("c") >= F.col("least")).select("lang", "size", "context", "c").toArrow()
    langs = sorted({lang for lang, _ in total})
    by = {}
    for name, rows_ in (("gram", kept), ("context", sums)):
        where = np.array(rows_["size"].to_pylist(), dtype=np.int64) + 10 * np.array([langs.index(x) for x in rows_["lang"].to_pylist()], dtype=np.int64)
        order = np.argsort(where, kind="stable")
        taken = rows_.take(pa.array(order))
        texts, c, where = taken[name].to_pylist(), taken["c"].to_numpy().astype(float), where[order]
        for k in np.unique(where):
            a, b = np.searchsorted(where, [k, k + 1])
            by[name, int(k)] = texts[a:b], c[a:b]
    discount = {(x["lang"], x["size"]): x["once"] / (x["once"] + 2 * x["twice"]) if x["once"] and x["twice"] else 0.5 for x in totals}
    grams, contexts = [], []
    for size in range(1, ORDER + 1):
        none = ([], np.empty(0))
        made = [shares_of(size, *by.get(("gram", size + 10 * i), none), *by.get(("context", size + 10 * i), none), discount.get((lang, size), 0.5)) for i, lang in enumerate(langs)]
        grams.append(Shares(range(len(langs)), [x[0] for x in made], [x[1] for x in made]))
        contexts.append(Shares(range(len(langs)), [x[2] for x in made], [x[3] for x in made]))
    characters = len({g for k, (texts, _) in by.items() if k[0] == "gram" and k[1] % 10 == 1 for g in texts})
    return Models(langs, grams, contexts, characters)


def calibrated(docs: DataFrame, first: Models, final: Models) -> Models:
    """final, with the scores and ceilings that first has on the documents it was not fitted on."""
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def judged(batches):
        scorer, found = scorer_of(shared.value), defaultdict(int)
        for batch in batches:
            for lang, (best, bits, margin) in zip(batch.column(0).to_pylist(), scorer.predicted(batch.column(1).to_pylist()), strict=True):
                if best >= 0:
                    found[scorer.models.langs[best], scorer.models.langs[best] == lang, margin_bin(margin), int(bits / ENTROPY_BIN)] += 1
        yield _tallies(found, [pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int64()], ["lang", "right", "margin", "bits", "n"])

    unseen = docs.where((F.crc32(F.col("doc_id").cast("long").cast("string")) % 4 == 3) & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    judged_rows = written(unseen.mapInArrow(judged, "lang string, right boolean, margin int, bits int, n long").groupBy("lang", "right", "margin", "bits").agg(F.sum("n").alias("n")), "judged")
    margins = judged_rows.groupBy("margin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)).alias("right")).toArrow().to_pylist()
    n, right = np.zeros(MARGINS), np.zeros(MARGINS)
    for x in margins:
        n[x["margin"]], right[x["margin"]] = x["n"], x["right"]
    final.scores = monotone(right, n)
    bits = defaultdict(list)
    for x in judged_rows.where("right").groupBy("lang", "bits").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        bits[x["lang"]].append((x["bits"], x["n"]))
    for i, lang in enumerate(final.langs):
        if seen := sorted(bits[lang]):
            upto = np.cumsum([m for _, m in seen])
            final.ceilings[i] = (seen[int(np.searchsorted(upto, CEILING * upto[-1]))][0] + 1) * ENTROPY_BIN
    return final


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits (cross-entropy for each character) and rejected, for each row of docs."""
    counts = written(counted(docs), "counts")
    final = calibrated(docs, models(counts, "c_fit"), models(counts, "c"))
    shared = docs.sparkSession.sparkContext.broadcast(final)

    def predicted(batches):
        scorer = scorer_of(shared.value)
        for batch in batches:
            got = scorer.predicted(batch.column(1).to_pylist())
            scores = [float(shared.value.scores[margin_bin(m)]) if b >= 0 else 0.0 for b, _, m in got]
            langs = [shared.value.langs[b] if b >= 0 else "und" for b, _, _ in got]
            rejected = [b < 0 or s < LEAST_SCORE or x > shared.value.ceilings[b] for (b, x, _), s in zip(got, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([x for _, x, _ in got], pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "bits", "rejected"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(predicted, "doc_id long, lang_pred string, score double, bits double, rejected boolean")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits", "rejected")


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
