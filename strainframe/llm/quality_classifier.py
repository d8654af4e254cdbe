"""Quality classifier (operator 3): a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins. Cyclic boosting visits one feature after the other; each visit fits a
shallow tree over the feature's bins to the logistic gradient and adds a small step of it to the feature's lookup
table. Then the pairs with the largest gain on what is left get tables of their own. A score is the sum of the
looked-up values, through the logistic function.

Learning uses a bounded sample of labelled rows (most_rows, by hash of doc_id) whose crc32(doc_id) mod 5 is not 0.
Labels, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts are scored as a text without words; a null doc_id is scored and never held out;
repeated labels of one doc_id count once, as their maximum; without usable labels every score is 0.5; repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_of, written
from .quality_rules import CACHED_WORDS, SYMBOLS, WordHashes, repeated_words, window_hashes

UPPER = bytes(range(65, 91))
FEATURES = ["log_words", "mean_word", "upper", "symbols", "shouts", "bars", "digits", "stops", "commas", "distinct", "repeated", "log_lines", "dup_lines", "log_longest", "short", "long", "non_ascii", "words_a_line", "capitals"]
BINS, COARSE, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE, SMOOTH, LEAVES = 80, 30, 0.15, 3.0, 4
THRESHOLD = 0.3


def features(text: str, hashes: WordHashes) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [0.0] * len(FEATURES)
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    lens = np.fromiter(map(len, words), dtype=np.int32, count=n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(n), lens.mean(), gone(UPPER) / size, gone(SYMBOLS) / n, raw.count(b"!") / n, raw.count(b"|") / n, gone(b"0123456789") / size, raw.count(b".") / n, raw.count(b",") / n,
        len(set(words)) / n, repeated_words(window_hashes(words, hashes)) / n, np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(lens.max()), (lens <= 3).mean(), (lens >= 16).mean(),
        len(raw.translate(None, bytes(range(128)))) / size, np.log1p(n / max(1, len(lines))), sum(map(bytes.isupper, words)) / n,
    ]


def _featured(batches):
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            if len(hashes) > CACHED_WORDS:
                hashes.clear()
            x = np.array([features(t, hashes) for t in batch.column(1).slice(at, 500).to_pylist()], dtype=np.float32).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), *(pa.array(x[:, j], pa.float32()) for j in range(len(FEATURES)))], names=["doc_id", *FEATURES])


def featured(docs: DataFrame) -> DataFrame:
    return text_of(docs).mapInArrow(_featured, "doc_id long, " + ", ".join(f"{f} float" for f in FEATURES))


class Gam:
    """Lookup tables for each feature and for some pairs of features."""

    def __init__(self) -> None:
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        self.base = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    @staticmethod
    def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Values of the bins by a tree of LEAVES leaves at most, from gradient and weight sums."""
        cuts = [0, len(g)]
        for _ in range(LEAVES - 1):
            best = (1e-6, 0)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1:
                    gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                    gain = gl**2 / (hl + SMOOTH) + (g[a:b].sum() - gl) ** 2 / (h[a:b].sum() - hl + SMOOTH) - g[a:b].sum() ** 2 / (h[a:b].sum() + SMOOTH)
                    k = int(gain.argmax())
                    best = max(best, (float(gain[k]), a + k + 1))
            if not best[1]:
                break
            cuts = sorted([*cuts, best[1]])
        out = np.empty(len(g))
        for a, b in zip(cuts, cuts[1:], strict=False):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + SMOOTH)
        return out

    @staticmethod
    def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """Gain and values of the best tree with one cut along each of two coarse features."""
        c = lambda a: np.cumsum(np.cumsum(a, 0), 1)[:-1, :-1]
        gs, hs = [], []
        for a, out in ((g, gs), (h, hs)):
            ll, row, col, al = c(a), np.cumsum(a.sum(1))[:-1, None], np.cumsum(a.sum(0))[None, :-1], a.sum()
            out += [ll, row - ll, col - ll, al - row - col + ll]
        gain = sum(x**2 / (y + SMOOTH) for x, y in zip(gs, hs, strict=True)) - g.sum() ** 2 / (h.sum() + SMOOTH)
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        v = [x[i, j] / (y[i, j] + SMOOTH) for x, y in zip(gs, hs, strict=True)]
        out = np.full(g.shape, v[3])
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1] = v[0], v[1], v[2]
        return float(gain[i, j]), out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if not len(y) or y.min() == y.max():
            self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
            return self
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        b, f = self.bins(x), np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j, t in enumerate(self.tables):
                p = 1 / (1 + np.exp(-f))
                step = RATE * self._tree(np.bincount(b[:, j], y - p, len(t)), np.bincount(b[:, j], p * (1 - p), len(t)))
                t += step
                f += step[b[:, j]]
        c, k = self._coarse(b), x.shape[1]

        def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            p, at = 1 / (1 + np.exp(-f)), c[:, i] * COARSE + c[:, j]
            return tuple(np.bincount(at, w, COARSE**2).reshape(COARSE, COARSE) for w in (y - p, p * (1 - p)))

        self.pairs = sorted(((i, j) for i in range(k) for j in range(i)), key=lambda ij: (-self._cross(*sums(*ij))[0], ij))[:PAIRS]
        self.pair_tables = [np.zeros((COARSE, COARSE)) for _ in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                step = RATE * self._cross(*sums(i, j))[1]
                t += step
                f += step[c[:, i], c[:, j]]
        return self

    def _coarse(self, b: np.ndarray) -> np.ndarray:
        return b * COARSE // np.array([len(t) for t in self.tables])

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        c, f = self._coarse(b), np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            f += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            f += t[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-f))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def fit(feats: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Gam:
    """The model, from at most most_rows labelled rows that are not held out, the first by hash of doc_id."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    share = most_rows / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = feats.join(known, "doc_id").select("doc_id", "y", *FEATURES).orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(most_rows).toPandas()
    return Gam().fit(rows[FEATURES].to_numpy(np.float32), rows["y"].to_numpy(float))


def quality_classifier(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    feats = written(featured(docs), "features")
    model = fit(feats, labels, most_rows)

    def scored(batches):
        for batch in batches:
            x = np.stack([np.asarray(c, dtype=np.float32) for c in batch.columns[1:]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    out = feats.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
