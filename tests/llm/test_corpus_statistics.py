"""Language ID, collocations and the filter audit against plain versions, and their edge cases."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from strainframe.llm import collocations, common, filter_audit, language_id

SCHEMA = "doc_id long, text string, lang string, source string, n string, part string, chunk string, rank long"
SYLLABLES = {"en": "th ing er on the and of tion".split(), "de": "sch ein ung der ä ö keit und".split(), "fr": "é eau les ç que ment la è".split()}


def document(rng, lang, n):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", " ", "\t", ". ", ", ", "\n"]) for w in words)


@pytest.fixture(scope="module")
def rows():
    """Documents of three langs, copies, and the odd cases: null and empty texts, null langs and ids, repeated rows, very long words and texts."""
    rng = random.Random(11)
    out = [(i, document(rng, lang, rng.randint(1, 300)), lang) for i in range(150) for lang in [rng.choice(list(SYLLABLES))]]
    out += [(200 + i, out[3][1], "en") for i in range(5)] + [out[7], out[7], (7, "other text of a repeated id THE THE #", "de")]
    out += [(300, None, "en"), (301, "", "de"), (302, "12 34 ½ .,!", "fr"), (303, None, None), (304, document(rng, "de", 40), None), (None, document(rng, "fr", 50), "fr"), (None, out[3][1], "en"), (None, out[3][1], "en")]
    out += [(305, "of the" * 9000, "en"), (306, "of the and " * 4000, "en"), (307, "ABC DEF | $ the", ""), (308, "日本語のテキスト 日本語", "ja"), (309, "a\x0bb\x0cc d\re", "en"), (310, " \t\n", "en"), (311, "été \U0001f642 the", "fr")]
    return [(i, t, lang, "s", "n", "p", "c", 1) for i, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rest(doc_id, by):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % by


# Language ID


def plain_words(text):
    import unicodedata

    return regex.findall(r"\p{L}[\p{L}\p{M}]{0,23}", unicodedata.normalize("NFC", text or "").lower())


class PlainKneserNey:
    """Interpolated Kneser-Ney by the textbook, with dictionaries."""

    def __init__(self, words, order=5):
        top = Counter()
        for w in words:
            s = "\x02" + w + "\x03"
            for i in range(2, len(s) + 1):
                top[s[max(0, i - order) : i]] += 1
        self.counts = {order: {g: c for g, c in top.items() if len(g) == order}}
        for k in range(order - 1, 0, -1):
            own = Counter(g[1:] for g in self.counts[k + 1])
            self.counts[k] = own | Counter({g: c for g, c in top.items() if len(g) == k})
        self.discount, self.sums, self.kinds = {}, {}, {}
        for k, c in self.counts.items():
            once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            self.discount[k] = once / (once + 2 * twice) if once and twice else 0.5
            self.sums[k], self.kinds[k] = Counter(), Counter()
            for g, v in c.items():
                self.sums[k][g[:-1]] += v
                self.kinds[k][g[:-1]] += 1
        self.order = order

    def p(self, context, char, uniform):
        p = uniform
        for k in range(1, self.order + 1):
            if len(context) < k - 1:
                break
            h = context[len(context) - k + 1 :]
            if h in self.sums[k]:
                d, s = self.discount[k], self.sums[k][h]
                p = max(self.counts[k].get(h + char, 0) - d, 0) / s + d * self.kinds[k][h] / s * p
        return p

    def bits(self, words, uniform):
        total = n = 0
        for w in words:
            s = "\x02" + w + "\x03"
            for i in range(1, len(s)):
                total -= math.log2(self.p(s[:i], s[i], uniform))
                n += 1
        return total / n


def test_language_id_against_a_plain_model(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(language_id, "RAREST", 0.0)
    by = defaultdict(list)
    for i, t, lang, *_ in rows:
        if lang is not None and rest(i, 4) not in (2, None):
            by[lang] += plain_words(t)
    plain = {lang: PlainKneserNey(words) for lang, words in by.items() if words}
    uniform = 1 / (len({g for m in plain.values() for g in m.counts[1]}) + 1)
    got = defaultdict(list)
    for r in language_id.language_id(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t, *_ in [r for r in rows if r[0] is not None and r[0] != 7][::4]:
        r, words = got[i][0], plain_words(t)
        assert r.held_out == (rest(i, 4) == 2)
        if not words:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        bits = {lang: m.bits(words[:3000], uniform) for lang, m in plain.items()}
        if len(words) <= 3000:
            assert r.bits == pytest.approx(bits[r.lang_pred], rel=1e-4)
        assert bits[r.lang_pred] <= min(bits.values()) + 1e-4
        assert 0 <= r.score <= 1


def test_language_id_predicts(spark, docs, rows, empty):
    truth = {i: lang for i, t, lang, *_ in rows if i is not None and i < 150 and len(plain_words(t)) >= 5 and i != 7}
    out = [r for r in language_id.language_id(docs).collect() if r.doc_id in truth]
    held = [r for r in out if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert language_id.language_id(empty).count() == 0
    # Nothing to learn from.
    assert {r.lang_pred for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_models_are_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(language_id, "RAREST", 0.01)
    counts = language_id.counted(docs)
    models = language_id.models(counts, "c")
    assert all(np.bincount(x.lang).max(initial=0) <= 100 for x in models.grams + models.contexts)
    # Of any number of words at a time, and of characters that no lang has.
    for words in (["e"], ["e", "thing"], ["\u0416"]):
        assert np.isfinite(models.words(words)).all()
    together = models.words(["e", "thing", "und"])
    assert np.allclose(together, np.concatenate([models.words([w]) for w in ("e", "thing", "und")]))


def test_scores_never_fall():
    got = language_id.monotone(np.array([0, 5, 1, 0, 9]), np.array([0, 5, 2, 0, 9])).tolist()
    assert len(got) == 5 and got == sorted(got)


# Collocations


def plain_collocations(rows):
    f, n = Counter(), Counter()
    for _, t, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lowered):
            w = tuple(x for x in re.split(r"[ \t]+", piece) if x)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, w[i : i + k]) for i in range(len(w) - k + 1))
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= 10}
    held = Counter()
    for (lang, w), a in cands.items():
        if len(w) == 3:
            for part in (w[:2], w[1:]):
                held[lang, part] = max(held[lang, part], a)
    out = []
    for lang in {k[0] for k in cands}:
        scored = []
        for (g, w), a in cands.items():
            if g == lang and not (len(w) == 2 and 100 * held[g, w] >= 50 * a):
                score, k = min((1000000 * a * a // (f[g, w[:k]] * f[g, w[k:]]), k) for k in range(1, len(w)))
                scored.append((-score, -a, " ".join(w).encode(), f[g, w[:k]], f[g, w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:2000])]
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_collocations_against_plain_counts(spark, docs, rows, monkeypatch, bits):
    """Also where the bit array can tell nothing apart."""
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    got = sorted(tuple(r) for r in collocations.collocations(docs).collect())
    assert len(got) > 50 and got == plain_collocations(rows)


def test_collocations_repeat_words_alone_for_their_joins(spark, docs, rows, monkeypatch):
    made, dealt = [], common.dealt

    def seen(left, few, spread, hot=None):
        out = dealt(left, few, spread, hot)
        key = "head" if "head" in few.columns else "rest"
        words = few.where(~F.contains(key, F.lit(" "))).count()
        made.append((out[1].count(), common.SALTS * words + few.count() - words))
        return out

    monkeypatch.setattr(common, "dealt", seen)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    got = sorted(tuple(r) for r in collocations.collocations(docs).collect())
    assert got == plain_collocations(rows) and len(made) == 2 and all(a == b for a, b in made)


def test_collocations_of_no_rows(spark, empty):
    assert collocations.collocations(empty).count() == 0


def test_chunks_hold_every_phrase_once():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) + rng.choice([".", "", "\n"]) for _ in range(300)]
    tokens = collocations.tokens_of([t.encode() for t in texts])
    h = collocations.Hashes().of(tokens)
    found, want = Counter(), Counter()
    first, stop, last = collocations.chunks(tokens, h)
    assert (stop - first > 0).all() and not last.all()
    for a, b, ends in zip(first, stop, last, strict=True):
        for k in (1, 2, 3):
            found.update(tuple(tokens[i : i + k]) for i in range(a, b - k + 1) if ends or i < b - collocations.OVERLAP)
    for t in texts:
        for piece in re.split(r"[.\n]", t):
            w = piece.encode().split()
            for k in (1, 2, 3):
                want.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    assert found == want


def test_scores_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**12 + 7, 10**12 + 9, 10**13 + 1), (10, 10, 10)], "a long, l long, r long")
    assert [r[0] for r in df.select(collocations._score(F.col("l"), F.col("r"))).collect()] == [1000000 * a * a // (left * right) for a, left, right in [(10**12 + 7, 10**12 + 9, 10**13 + 1), (10, 10, 10)]]


# Filter audit


def plain_audit(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = {}
    for i, t, lang, *_ in rows:
        t = t or ""
        w = [x for x in re.split(r"[ \t-\r]+", t) if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        good, toxic = (any(k == i and x == 1 for k, *xs in labels for x in [xs[j]]) if i is not None else False for j in (0, 1))
        for order in itertools.permutations("ABCDE"):
            alive = True
            for step, letter in enumerate(order, 1):
                c = out.setdefault((lang or "", "".join(order), step), [0] * 6)
                gone = alive and fails[letter]
                c[1] += gone
                c[2] += fails[letter] and not alive
                c[3] += fails[letter] and sum(fails.values()) == 1
                c[4] += gone and good
                c[5] += gone and toxic
                alive = alive and not fails[letter]
                c[0] += alive
    total = Counter()
    for (part, order, step), c in out.items():
        total[part, order[step - 1]] += c[1]
    return sorted((*k, *c, total[k[0], k[1][k[2] - 1]]) for k, c in out.items())


def test_filter_audit_against_plain_counts(spark, docs, rows, empty):
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 320, 3)] + [(3, 0, 0), (3, 1, 1), (None, 1, 1)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.filter_audit(docs, marked)
    got = sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out.collect())
    assert got == plain_audit(rows, labels)
    assert filter_audit.filter_audit(empty, marked).count() == 0
    assert filter_audit.filter_audit(docs, marked.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_filter_audit_of_many_labels_broadcasts_none(spark, docs, rows, monkeypatch, tmp_path):
    """16 copies of each label took under 10 MB on disk, so Spark sent them through the driver."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 320, 3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    marked = spark.read.parquet(f"{tmp_path}/labels")
    assert "Broadcast" not in filter_audit.counted(docs, marked)._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.filter_audit(docs, marked).collect())
    assert got == plain_audit(rows, labels)


def test_packed_fields_never_reach_the_next():
    total = (2**63 - 1) * filter_audit.packed(0, True, True) + filter_audit.packed(31, True, False)
    rows = filter_audit.unpacked(total)
    assert rows["kept"].tolist() == [2**63 - 1] * 600
    assert rows["removed"].tolist() == [1, 0, 0, 0, 0] * 120 and rows["redundant"].tolist() == [0, 1, 1, 1, 1] * 120
    assert rows["good_lost"].sum() == 120 and rows["toxic_lost"].sum() == 0 and rows["shapley"].tolist() == [24] * 600
