"""MinHash near-dedup (operator 9): ProbMinHash sketches of weighted five-word shingles, banding, exact verification.

Each shingle (weight 1 + ln of its count) is a Poisson process whose arrivals fall on random registers; a register
keeps the shingle of its first arrival, and a shingle ends once its next arrival is later than all registers. Equal
registers estimate the probability Jaccard likeness. Bands of registers give buckets, and pairs within a bucket are
verified on whole shingle sets. Texts that repeat shingles have the bands of a second sketch too, of weights 1 (without repeats
both sketches are one), so pairs are found by the likeness of their sets as well. Texts that are equal are one node throughout.

A bucket's pairs are not all made. First every member is held against the bucket's pivot, the member that meets most
others over all buckets: of a text and its copies, the text. Linked texts become one class. Then, in buckets that still hold several
classes, the members outside the largest class are held against all of the bucket's members, in blocks of bounded size
whose intersections are counted by one matrix product. So every two members have been compared or are of one class.

Defined results: texts without words (null, empty, white space) are alike by equal text only; texts of one to four words
have one shingle, all their words; repeated rows are in one class; a null doc_id is given its class too. Class ids are the least doc_id
of a class (null if it has none). Texts are told apart by a 64-bit hash. Shingles are compared by 32 bits of theirs: of two
sets of 20,000 by chance 0.1 shingles are taken as shared. Columns beside doc_id and text are carried by kept() as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small_enough, table, text_of, written
from .quality_rules import CACHED_WORDS, WordHashes, window_hashes

REGISTERS, BANDS = 128, 32
SIMILARITY = 0.8
#: Link graphs of no more edges are walked in one task.
BOUNDED_EDGES = 50_000
#: Rows and bytes of a block, about, and shingles that a matrix product takes at once.
BLOCK, BLOCK_BYTES, COLUMNS = 256, 8_000_000, 20_000
#: Texts and shingles that one numpy step takes together, about.
STEP_TEXTS, STEP_SHINGLES = 400, 400_000
SKETCH = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64())), ("shingles", pa.binary())])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(raw: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, sorted, and their counts."""
    words = raw.split()
    found = window_hashes(words, hashes)
    if not len(found) and words:
        found = np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], dtype=np.uint64)
    return np.unique(found, return_counts=True)


def prob_min_hash(shingles: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Registers (texts x REGISTERS) of the texts whose shingles are given."""
    first = np.full(texts * REGISTERS, np.inf)
    out = np.zeros(texts * REGISTERS, dtype=np.uint64)
    time, turn = np.zeros(len(shingles)), 0
    while len(shingles):
        r = mix(shingles ^ np.uint64((turn * 0xD6E8FEB86659FD93) & (2**64 - 1)))
        time = time - np.log(((r >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52) / weights
        at = owner * REGISTERS + (mix(r) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        out[at[won]] = shingles[won]
        alive = time < first.reshape(texts, REGISTERS).max(1)[owner]
        shingles, weights, owner, time, turn = shingles[alive], weights[alive], owner[alive], time[alive], turn + 1
    return out.reshape(texts, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    parts = registers.reshape(len(registers), BANDS, -1)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        key = mix(key ^ parts[:, :, j])
    return key.view(np.int64)


def _sketched(batches):
    hashes = WordHashes()

    def step(ids: list, raws: list[bytes], sets: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s, _ in sets])
        registers = prob_min_hash(np.concatenate([s for s, _ in sets]), 1 + np.log(np.concatenate([c for _, c in sets])), np.repeat(np.arange(len(sets)), sizes), len(sets))
        keys = band_keys(registers)
        bands = [keys[i] if n else [] for i, n in enumerate(sizes)]
        if repeats := [i for i, (_, c) in enumerate(sets) if len(c) and c.max() > 1]:
            plain = np.concatenate([sets[i][0] for i in repeats])
            more = band_keys(prob_min_hash(plain, np.ones(len(plain)), np.repeat(np.arange(len(repeats)), sizes[repeats]), len(repeats)))
            for i, own in zip(repeats, more, strict=True):
                bands[i] = np.concatenate([bands[i], own])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([_signed(xxhash.xxh64_intdigest(r, 42)) for r in raws], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array([(s >> np.uint64(32)).astype(np.uint32).tobytes() for s, _ in sets], pa.binary())], schema=SKETCH)

    for batch in batches:
        ids, raws, sets, many = [], [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if len(hashes) > CACHED_WORDS:
                hashes.clear()
            raw = text.as_buffer().to_pybytes()
            ids.append(i)
            raws.append(raw)
            sets.append(shingles_of(raw, hashes))
            many += len(sets[-1][0])
            if len(ids) >= STEP_TEXTS or many >= STEP_SHINGLES:
                yield step(ids, raws, sets)
                ids, raws, sets, many = [], [], [], 0
        if ids:
            yield step(ids, raws, sets)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, node (hash of the text), band keys and the sorted shingles (32 bits each) of each document."""
    return text_of(docs).mapInArrow(_sketched, "doc_id long, node long, bands array<long>, shingles binary")


def _verified(least: float):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            sets = zip(batch.column(2), batch.column(3), strict=True)
            keep = []
            for x, y in sets:
                s, t = (np.frombuffer(v.as_buffer(), dtype=np.uint32) for v in (x, y))
                if min(len(s), len(t)) < least * max(len(s), len(t)):
                    keep.append(False)
                    continue
                s, t = np.unique(s), np.unique(t)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both >= least * (len(s) + len(t) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard likeness of at least `least`."""
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(_verified(least), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of every node that is not itself the least; large and small stars in turn."""
    now, before = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges"), None
    while True:
        if small_enough(now, BOUNDED_EDGES):
            now = now.coalesce(1)  # so few edges need no exchange
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = state


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels after more links: the links between labels are contracted, so only what is new is walked."""
    if labels is None:
        return components(links)
    ends = links
    for side in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"_{side}")), side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    more = components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    moved = labels.join(more.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return written(moved.unionByName(more), "labels")


def _crossed(least: float):
    """Links between the query and the member block of each row, by set intersections as a matrix product."""

    def sets(block: list[dict]) -> list[np.ndarray]:
        return [np.unique(np.frombuffer(x["shingles"], dtype=np.uint32)) for x in block]

    def run(batches):
        for batch in batches:
            for queries, members in zip(batch.column(0), batch.column(1), strict=True):
                q, m = queries.as_py(), members.as_py()
                s, t = sets(q), sets(m)
                common = np.intersect1d(np.concatenate(s), np.concatenate(t))
                both = np.zeros((len(q), len(m)), dtype=np.float32)
                for at in range(0, len(common), COLUMNS):
                    part = common[at : at + COLUMNS]
                    both += _matrix(s, part) @ _matrix(t, part).T
                sizes = np.array([len(x) for x in s])[:, None] + np.array([len(x) for x in t])[None, :]
                apart = np.array([x["label"] for x in q])[:, None] != np.array([x["label"] for x in m])[None, :]
                i, j = np.nonzero((both >= least * (sizes - both)) & apart)
                yield pa.RecordBatch.from_arrays([pa.array([q[k]["node"] for k in i], pa.int64()), pa.array([m[k]["node"] for k in j], pa.int64())], names=["a", "b"])

    return run


def _matrix(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), dtype=np.float32)
    for i, x in enumerate(sets):
        at = np.searchsorted(columns, x)
        at[at == len(columns)] = 0
        out[i, at[columns[at] == x]] = 1
    return out


def crossed(members: DataFrame, nodes: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Links (a, b) within buckets of several classes: what is outside a bucket's largest class against the bucket.

    Buckets of one largest class are taken together, so a pair that shares several buckets is compared once.
    """
    now = members.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = now.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("key", F.col("top.label").alias("largest"))
    held = written(now.join(groups, "key").groupBy("largest", "node", "label").agg(F.count("*").alias("_")).drop("_"), "held")
    outside = F.col("label") != F.col("largest")
    full = written(held.join(nodes, "node").select("largest", "node", "label", "shingles", F.xxhash64("node", F.lit(9)).alias("at")), "full")
    many = lambda rows, size: F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BYTES))
    size = F.length("shingles")
    blocks = full.groupBy("largest").agg(many(F.count("*"), F.sum(size)).alias("blocks"), many(F.count_if(outside), F.sum(F.when(outside, size))).alias("query_blocks"))
    blocks = F.broadcast(blocks) if small_enough(blocks, BROADCAST_ROWS) else blocks
    full = full.join(blocks, "largest")
    piece = F.collect_list(F.struct("node", "label", "shingles"))
    queries = full.where(outside).groupBy("largest", F.pmod("at", "query_blocks").alias("q")).agg(piece.alias("queries"))
    every = full.groupBy("largest", F.pmod("at", "blocks").alias("m")).agg(piece.alias("members"))
    # Numbers of blocks are paired first and meet their contents by block, so those of one class are dealt to many tasks.
    turns = blocks.select("largest", F.explode(F.expr("sequence(0L, query_blocks - 1)")).alias("q"), "blocks").select("largest", "q", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("m"))
    return turns.join(queries, ["largest", "q"]).join(every, ["largest", "m"]).select("queries", "members").mapInArrow(_crossed(least), "a long, b long").distinct()


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, node and label of each row of docs; rows of one label are one class."""
    sketches = written(sketched(docs), "sketches")
    sets = sketches.groupBy("node").agg(F.first("shingles").alias("shingles"))
    keys = sketches.select("node", F.explode("bands").alias("key")).distinct()
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keys.join(shared, "key"), "members")
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    nodes = written(sets.join(met, "node").drop("met"), "sets")
    pivots = members.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("pivot"))
    pairs = members.join(pivots, "key").where("pivot != node").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    labels = relabelled(None, written(verified(pairs, nodes, least), "links"))
    labels = relabelled(labels, written(crossed(members, nodes, labels, least), "links"))
    return sketches.select("doc_id", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_dedup(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and class_size (rows) of each row of docs."""
    found = written(classes(docs, least), "classes")
    # Written, so that both sides of the join are plain exchanges, whose hot labels Spark splits by itself.
    heads = written(found.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "heads")
    return found.join(heads, "label").select("doc_id", "class_id", "class_size")


def kept(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: the one of the least doc_id (null last), then of the least text hash; of rows equal in both, any one."""
    found = classes(docs, least)
    heads = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("head"))
    heads = written(heads.select(F.coalesce("head.doc_id", F.lit(0)).alias("id"), F.col("head.doc_id").isNull().alias("none"), F.col("head.node").alias("node")), "heads")
    doc_id = F.col("doc_id").cast("long")
    own = docs.select(F.struct("*").alias("doc"), F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"))
    out = own.join(heads, ["id", "none", "node"], "left_semi")
    again = found.groupBy("doc_id", "node").agg(F.count("*").alias("n")).where("n > 1")
    out = out if again.isEmpty() else out.dropDuplicates(["id", "none", "node"])
    return out.select("doc.*")


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
