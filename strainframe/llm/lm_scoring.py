"""LM scoring (operator 5): masked pseudo-likelihood by a bidirectional window network.

The network predicts every token from the two tokens on either side of it; the sum of the log-probabilities scores
the document. Tokens are the corpus's most frequent words; other words are tokens by hash, counted in the corpus as well.
Probabilities are those of a word's class times the word's within it; a word known by its hash has an equal share of what
the corpus's words of that hash have together.

All documents are counted for the vocabulary and take part in training: each task trains on positions of all its
documents (every ROUNDS-th, another set in each round, so each position once), tasks' parameters are averaged by the positions they saw, and the next
round begins from there. So what is gathered grows with the input, and no task holds more than its own documents.

Defined results: null and empty texts have no tokens, log_prob 0 and a null mean; repeated rows get equal scores; a null
doc_id is scored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_of, written

CLASSES, MEMBERS, HASHED = 32, 32, 64
SIZE = CLASSES * MEMBERS
WORDS = SIZE - HASHED
WIDTH = 16
OFFSETS = np.array([-2, -1, 1, 2])
ROUNDS, BATCH, STEP = 2, 1024, 0.15
SLICES, FAN = 32, 64
#: Words that a task counts before it passes its counts on; tokens that are unpacked together, about; positions of a scoring step.
COUNTED, TOGETHER, SCORED = 300_000, 60_000, 16_384
SHAPES = [(len(OFFSETS), SIZE + 1, WIDTH), (WIDTH, CLASSES), (CLASSES,), (CLASSES, WIDTH, MEMBERS), (CLASSES, MEMBERS)]


def unpacked(flat: np.ndarray) -> list[np.ndarray]:
    """The network's parameters as views: context embeddings, class weights and biases, member weights and biases."""
    ends = np.cumsum([int(np.prod(s)) for s in SHAPES])
    return [part.reshape(s) for part, s in zip(np.split(flat, ends[:-1]), SHAPES, strict=True)]


def initial(counts: np.ndarray) -> np.ndarray:
    """Small random weights, and biases from the tokens' counts."""
    flat = np.random.default_rng(7).normal(0, 0.1, sum(int(np.prod(s)) for s in SHAPES)).astype(np.float32)
    e, c, bc, w, bw = unpacked(flat)
    e[:, SIZE] = 0
    by = (counts + 0.5).reshape(CLASSES, MEMBERS)
    bc[:] = np.log(by.sum(1) / by.sum())
    bw[:] = np.log(by / by.sum(1, keepdims=True))
    return flat


def _softmax(x: np.ndarray) -> np.ndarray:
    """Softmax of each row, in place."""
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], dtype=x.dtype))[:, None]
    return x


def by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the positions by the classes of their targets, and (class, start, end) of each class that occurs."""
    cls = (target // MEMBERS).astype(np.uint16)
    order = np.argsort(cls, kind="stable")
    ends = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
    return order, [(k, i, j) for k, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if j > i]


def hidden(params: list[np.ndarray], context: np.ndarray) -> np.ndarray:
    e = params[0]
    h = e[0].take(context[:, 0], axis=0)
    for o in range(1, len(OFFSETS)):
        h += e[o].take(context[:, o], axis=0)
    return np.tanh(h, out=h)


def log_probs(params: list[np.ndarray], context: np.ndarray, target: np.ndarray) -> np.ndarray:
    _, c, bc, w, bw = params
    order, slices = by_class(target)
    h, target = hidden(params, context[order]), target[order]
    at, x = np.arange(len(h)), np.empty((len(h), MEMBERS), dtype=h.dtype)
    for k, i, j in slices:
        np.matmul(h[i:j], w[k], out=x[i:j])
        x[i:j] += bw[k]
    found = np.zeros(len(h), dtype=h.dtype)
    for x, own in ((h @ c + bc, target // MEMBERS), (x, target % MEMBERS)):
        x -= x.max(1, keepdims=True)
        found += x[at, own]
        np.exp(x, out=x)
        found -= np.log(x @ np.ones(x.shape[1], dtype=x.dtype))
    out = np.empty_like(found)
    out[order] = found
    return out


def gradients(params: list[np.ndarray], context: np.ndarray, target: np.ndarray) -> list:
    """Mean gradients of the log loss; those of the embeddings as [(rows, values)], rows counted over all offsets."""
    _, c, bc, w, bw = params
    n = len(target)
    # Positions in the order of their classes: each class is a slice.
    order, slices = by_class(target)
    context, target = context[order], target[order]
    h, at = hidden(params, context), np.arange(n)
    g = _softmax(h @ c + bc)
    g[at, target // MEMBERS] -= 1
    g /= n
    x, gh = np.empty((n, MEMBERS), dtype=h.dtype), g @ c.T
    for k, i, j in slices:
        np.matmul(h[i:j], w[k], out=x[i:j])
        x[i:j] += bw[k]
    x = _softmax(x)
    x[at, target % MEMBERS] -= 1
    x /= n
    gw, gbw = np.zeros_like(w), np.zeros_like(bw)
    for k, i, j in slices:
        own = x[i:j]
        np.matmul(h[i:j].T, own, out=gw[k])
        gh[i:j] += own @ w[k].T
    gbw[[k for k, _, _ in slices]] = np.add.reduceat(x, [i for _, i, _ in slices])
    gh *= 1 - h * h
    rows = (context + np.arange(len(OFFSETS)) * (SIZE + 1)).ravel().astype(np.uint16)
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return [[(own[first], np.add.reduceat(gh.take(order // len(OFFSETS), axis=0), first))], h.T @ g, g.sum(0), gw, gbw]


def train(flat: np.ndarray, batches) -> tuple[np.ndarray, int]:
    """Adaptive gradient steps over batches of (context, target); the parameters and how many positions were seen."""
    flat = flat.copy()
    params, seen = unpacked(flat), 0
    squares = unpacked(np.full_like(flat, 1e-6))
    embeddings, embedded = params[0].reshape(-1, WIDTH), squares[0].reshape(-1, WIDTH)
    for context, target in batches:
        [(at, g)], *rest = gradients(params, context, target)
        total = embedded.take(at, axis=0) + g * g
        embedded[at] = total
        embeddings[at] = embeddings.take(at, axis=0) - STEP * g / np.sqrt(total)
        for p, s, g in zip(params[1:], squares[1:], rest, strict=True):
            s += g * g
            p -= STEP * g / np.sqrt(s)
        params[0][:, SIZE] = 0
        seen += len(target)
    return flat, seen


def padded(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of several documents with two empty places around each, and the positions of the tokens."""
    gap = np.full(2, SIZE, dtype=np.int64)
    ids = np.concatenate([gap, *(x for own in lists for x in (own, gap))])
    return ids, np.flatnonzero(ids != SIZE)


def _counted(batches):
    counts: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            counts.update(text.as_buffer().to_pybytes().split())
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
    if counts:
        yield out()


def vocabulary(texts: DataFrame) -> tuple[list[tuple[bytes, int]], np.ndarray, np.ndarray]:
    """The WORDS most frequent words of all documents with their counts; of each hash class, how many words and how many occurrences the others are."""
    counts = written(texts.select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    words = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    # What the vocabulary holds is counted and taken off again, so the table is not joined with it.
    kinds, many = np.zeros(HASHED), np.zeros(HASHED)
    for r in counts.groupBy((F.crc32("word") % HASHED).cast("int").alias("class")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect():
        kinds[r["class"]], many[r["class"]] = r["kinds"], r["n"]
    for word, n in words:
        kinds[zlib.crc32(word) % HASHED] -= 1
        many[zlib.crc32(word) % HASHED] -= n
    return words, kinds, many


class Ids(dict):
    """Word to token; words outside the vocabulary by hash."""

    def __missing__(self, word: bytes) -> int:
        t = WORDS + zlib.crc32(word) % HASHED
        if len(self) < 500_000:
            self[word] = t
        return t


def tokenised(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """doc_id and its tokens (two bytes each)."""

    def run(batches):
        ids = Ids((w, i) for i, w in enumerate(words))
        for batch in batches:
            out = [np.fromiter(map(ids.__getitem__, t.as_buffer().to_pybytes().split()), dtype=np.uint16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "tokens"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens binary")


def _lists(batches):
    """Documents' tokens, about TOGETHER at a time, with their rows' ids."""
    ids, lists, many = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(i)
            lists.append(np.frombuffer(t.as_buffer(), dtype=np.uint16).astype(np.int64))
            many += len(lists[-1])
            if many >= TOGETHER:
                yield ids, lists
                ids, lists, many = [], [], 0
    if ids:
        yield ids, lists


def targets(at: np.ndarray, turn: int) -> np.ndarray:
    """The positions that a round trains on; the rounds share all positions."""
    return at[turn % ROUNDS :: ROUNDS]


def averaged(tokens: DataFrame, flat: np.ndarray, turn: int) -> np.ndarray:
    """The tasks' parameters after a round of training from flat, averaged by the positions they saw."""
    shared = tokens.sparkSession.sparkContext.broadcast(flat)

    def run(batches):
        def examples():
            for _, lists in _lists(batches):
                ids, at = padded(lists)
                at = targets(at, turn)
                # Neighbouring positions are dealt to different steps.
                at = np.random.default_rng(turn).permutation(at)
                for k in range(0, len(at), BATCH):
                    own = at[k : k + BATCH]
                    yield ids[own[:, None] + OFFSETS], ids[own]

        after, seen = train(shared.value, examples())
        if seen:
            parts = np.array_split(after.astype(np.float64) * seen, SLICES)
            spread = int(abs(hash((seen, float(after[0]))))) % FAN
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([spread] * SLICES, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([seen] * SLICES, pa.int64())], names=["slice", "fan", "sums", "seen"])

    def add(of: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer(), dtype=np.float64) for x in of.column("sums")], axis=0)
        return pa.table({"slice": of.column("slice")[:1], "fan": of.column("fan")[:1], "sums": pa.array([total.tobytes()], pa.binary()), "seen": pa.array([sum(of.column("seen").to_pylist())], pa.int64())})

    schema = "slice int, fan int, sums binary, seen long"
    rows = tokens.mapInArrow(run, schema).groupBy("slice", "fan").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema).collect()
    if not rows:
        return flat
    return np.concatenate([np.frombuffer(r["sums"], dtype=np.float64) / r["seen"] for r in sorted(rows, key=lambda r: r["slice"])]).astype(np.float32)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob of each document."""
    texts = text_of(docs)
    words, kinds, many = vocabulary(texts)
    tokens = written(tokenised(texts, [w for w, _ in words]), "tokens")
    counts = np.zeros(SIZE)
    counts[: len(words)] = [n for _, n in words]
    counts[WORDS:] = many
    # A word of a hash class has an equal share of the class's probability.
    share = np.zeros(SIZE)
    share[WORDS:] = np.log(np.maximum(kinds, 1))
    flat = initial(counts)
    for turn in range(ROUNDS):
        flat = averaged(tokens, flat, turn)
    shared = docs.sparkSession.sparkContext.broadcast(flat)

    def score(batches):
        params = unpacked(shared.value)
        for doc_ids, lists in _lists(batches):
            ids, at = padded(lists)
            found = np.concatenate([log_probs(params, ids[at[k : k + SCORED, None] + OFFSETS], ids[at[k : k + SCORED]]) - share[ids[at[k : k + SCORED]]] for k in range(0, len(at), SCORED)] or [np.empty(0)])
            sizes = np.array([len(x) for x in lists])
            sums = np.concatenate([[0.0], np.cumsum(found, dtype=np.float64)])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums[ends] - sums[ends - sizes], pa.float64())], names=["doc_id", "n_tokens", "log_prob"])

    out = tokens.mapInArrow(score, "doc_id long, n_tokens long, log_prob double")
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
