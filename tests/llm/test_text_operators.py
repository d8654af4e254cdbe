"""Brute-force versions, exact round trips and edge cases of the text operators."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strainframe.llm import common, fingerprints, html_extraction, line_dedup, lm_scoring, mixing, near_dedup, pii, quality_classifier, quality_rules, sentencepiece_codec

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "on", "es", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Prose, copies, near copies, repeated lines, and the odd cases: null, empty, blanks, ties, very long."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        rows.append("\n".join(prose(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 5))))
    base = prose(rng, 200).split(" ")
    rows += [" ".join(base)] * 3
    for i in range(12):
        own = list(base)
        for _ in range(i % 5):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(50)}"
        rows.append(" ".join(own))
    rows += [f"{prose(rng, 30)}\nCopyright {2000 + i} Example Press, all rights reserved here\n{prose(rng, 12)}" for i in range(8)]
    rows += [None, "", "   \n\t ", "one", "two words", "the", "x" * 30_000, "word " * 5_000, "ünïcode 日本語 🙂 text", "A | B | C", "MAIL JOE!! NOW!!", "a@b.c 1.2.3.4 +1 (743) 555-3824 4111 1111 1111 1111"]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, "a text of no id at all but with words enough to be read", "de", "src1", 5))
    return spark.createDataFrame(rows, SCHEMA).withColumns({"h": F.lit("clash"), "n": F.lit(1), "label": F.lit(2), "row": F.lit("x"), "key": F.lit(0), "node": F.lit(0), "words": F.lit("w"), "tokens": F.lit("t")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_rules_counts(docs, texts):
    got = by_id(quality_rules.quality_rules(docs))
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        inside = {k + j for k, w in enumerate(windows) if w in twice for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(words) < 10 or 100 * len(inside) > 20 * len(words))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == expected
        assert not (expected[-1] and got[i]["kept"])


def test_quality_rules_reject_depleted_documents(spark):
    rng = random.Random(1)
    common = [prose(rng, 12) for _ in range(3)]
    rows = [(i, "\n".join([prose(rng, 40), *common]), "en", "host", 1) for i in range(60)]
    copies = prose(rng, 60)
    rows += [(100 + i, copies, "en", "host", 1) for i in range(60)]
    rows += [(200, "\n".join(common), "en", "host", 1), (201, "\n".join(common), "en", "other", 1)]
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)))
    assert not got[200]["kept"] and got[201]["kept"]
    assert all(got[i]["kept"] and got[i]["words_left"] == 40 for i in range(60)) and all(got[100 + i]["kept"] for i in range(60))


def test_quality_rules_count_every_text_of_boilerplate(spark):
    """Texts that are mostly one line of their host are all rejected, whatever its hash."""
    rows = []
    for seed in range(20):
        rng = random.Random(seed)
        line = prose(rng, 30)
        rows += [(100 * seed + i, f"{line}\n{prose(rng, 6)} own{i}", "en", f"host{seed}", 1) for i in range(100)]
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)))
    assert all(r["words_left"] == 7 and not r["kept"] for r in got.values())


def test_quality_classifier(spark, docs, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        t = prose(rng, rng.randint(20, 60))
        rows.append((i, t if good else t.upper().replace(" ", "!! "), "en", "s", 1))
        labels.append((i, int(good), 0))
    table = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([*labels, labels[0], (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality_classifier.quality_classifier(table, known))
    held = [i for i in got if got[i]["held_out"]]
    assert 60 < len(held) < 180 and all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) >= 0.97 * len(held)
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert {r["score"] for r in quality_classifier.quality_classifier(docs, known.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_classifier(empty, known).count() == 0


def test_gam_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality_classifier.Gam().fit(x[:3000], y[:3000])
    assert (1, 0) in m.pairs and ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_fingerprints(docs, texts, spark, empty):
    rows = by_id(fingerprints.fingerprints(docs))
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order[:-1]):
        t, after = texts[i] or "", texts[order[k + 1]] or ""
        if i == 3:
            continue  # the repeated row is followed by itself
        half = len(t) // 2
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    assert rows[60]["fingerprint"] == rows[61]["fingerprint"] and rows[62]["near_next"] == 1
    one = spark.createDataFrame([(1, "some text of the one", "en", "s", 1)], SCHEMA)
    assert fingerprints.fingerprints(one).first()["near_next"] == 1.0
    assert fingerprints.fingerprints(empty).count() == 0


def test_fingerprint_neighbours_over_ranges(spark, monkeypatch):
    """Extreme, uneven, repeated and null ids in ranges of two documents."""
    ids = [-9_200_000_000_000_000_000, 1, 2, 3, 3, 3, 3, 900, 5000, 70_000, 4 * 10**18, 9_200_000_000_000_000_000, None, None]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    monkeypatch.setattr(fingerprints, "TOGETHER", 2)
    assert 3 < len(fingerprints.bounds_of(df)) <= len(ids)
    got = {(r["doc_id"], r["text"]): r["next_text"] for r in fingerprints.with_next(df).collect()}
    rows = df.withColumn("h", F.xxhash64("text")).collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), -r["h"]))
    assert got == {(r["doc_id"], r["text"]): order[(k + 1) % len(order)]["text"] for k, r in enumerate(order)}


def test_fingerprints_against_plain_signatures(spark):
    """Signatures and likenesses by a plain reading of the method: the last common word of each run, and the two content words that follow it."""
    rng = random.Random(5)
    base = [rng.choice([*fingerprints.ANCHORS, *WORDS]) for _ in range(300)]
    given = [" ".join(rng.choice([*fingerprints.ANCHORS, *WORDS]) if rng.random() < k / 30 else w for w in base[: rng.randint(60, 300)]) for k in range(30)]

    def plain(t):
        spots, content = [], []
        for w in t.lower().split(" "):
            if w not in fingerprints.ANCHORS:
                content.append(w)
            elif spots and spots[-1][1] == len(content):
                spots[-1] = (w, len(content))
            else:
                spots.append((w, len(content)))
        return {(w, *content[at : at + 2]) for w, at in spots}

    got = by_id(fingerprints.fingerprints(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")))
    sets = [plain(t) for t in given]
    for i in range(len(given)):
        half, after = len(given[i]) // 2, given[i - 1]
        edited = plain((given[i][: len(given[i]) - half] + after[:half]).strip(" "))
        assert len(got[i]["fingerprint"].split(" ")) == len(sets[i]) and len(got[i]["edited_fingerprint"].split(" ")) == len(edited)
        assert got[i]["near_next"] == pytest.approx(len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1]))
        assert got[i]["near_edited"] == pytest.approx(len(sets[i] & edited) / len(sets[i] | edited))


def test_near_copies_against_all_pairs(spark, docs, texts, empty, monkeypatch):
    """Classes by all pairs of fingerprints, with edits of every strength; frequent signatures and several rounds of pivots included."""
    monkeypatch.setattr(fingerprints, "FREQUENT", 3)
    rng = random.Random(8)
    pool = [*fingerprints.ANCHORS, *WORDS]
    more = []
    for _ in range(6):
        base = [rng.choice(pool) for _ in range(rng.randint(40, 250))]
        more += [" ".join(rng.choice(pool) if rng.random() < k / 150 else w for w in base[: len(base) - rng.randint(0, 12)]) for k in range(12)]
    every = [*enumerate(texts), *((1000 + i, t) for i, t in enumerate([*more, *more[:5], "", None]))]
    df = spark.createDataFrame(every, "doc_id long, text string").withColumn("node", F.lit("of its own")).withColumn("signatures", F.lit(1))
    sets = by_id(fingerprints.with_signatures(fingerprints.text_of(df), "text", "signatures"))
    ids = sorted(i for i, _ in every)
    label = {i: i for i in ids}
    for i in ids:
        for j in (j for j in ids if j < i):
            s, t = (set(sets[k]["signatures"]) for k in (i, j))
            if s == t or len(s & t) >= 0.8 * len(s | t) > 0:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    got = by_id(fingerprints.near_copies(df))
    assert {i: got[i]["class_id"] for i in ids} == label
    assert len(set(label.values())) < len({tuple(r["signatures"]) for r in sets.values()})
    assert fingerprints.near_copies(empty).count() == 0


def base_spans(t):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]

    return sorted((m.start(), k, m.end(), n) for k, (n, p) in enumerate(kinds.items()) for m in re.finditer(p, t) if good(n, m[0]))


def test_pii_base_spans(spark, docs, texts, empty):
    rng = random.Random(4)
    pieces = ["a@b.c", "_x@d.e-f.g", "é", " ", "1.2.3.4", ".5", "999.1.1.1", "4111 1111 1111 1111", "4111111111111111", "-", "+1 (743) 555-3824", "+49", "12", "@", ".", "🙂", "mail ", "99999999999999999999", "x", "(", "+"]
    odd = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(400)] + ["1 2 3 4 5 6 7 " * 400, "a" * 20_000, "@" * 500, "1" * 20_000, "+" + "1 " * 2_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for source, given in ((df, odd), (docs, texts)):
        got = by_id(pii.pii(source))
        for i, t in enumerate(given):
            spans = base_spans(t or "")
            listed = ",".join(f"{n}:{s}:{e}" for s, _, e, n in spans)
            assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), t
            assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[3] == k for x in spans) for k in pii.KINDS]
            assert set(listed.split(",")) <= set(got[i]["spans"].split(",")) | {""}
    assert pii.pii(empty).count() == 0


def test_pii_places_and_contexts_of_many_matches(spark):
    """Matches over several blocks, some that touch, behind characters of several bytes: as a plain loop finds them."""
    rng, pattern = random.Random(8), r"[0-9]+[a-c]"
    made = ["".join(rng.choice(["12a", "7b", "é🙂", " Mail ", "x" * rng.randint(0, 60), "9"]) for _ in range(n)) for n in (0, 1, 5, 300, 2_500)] + ["1a" * (pii.BLOCK + k) for k in (-1, 0, 1)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = by_id(df.select("doc_id", pii.spans(F.col("text"), pattern, 2, True).alias("x")))
    for i, text in enumerate(made):
        want = [(m.start(), 2, m.end(), m.group(), True, text[max(0, m.start() - pii.CONTEXT) : m.start()].lower(), text[m.end() : m.end() + 1]) for m in re.finditer(pattern, text)]
        assert [tuple(x) for x in got[i]["x"]] == want


def test_pii_work_grows_with_the_text(spark):
    """100,000 addresses in one text: each of them walked the text to its place before, and this took minutes."""
    one = spark.createDataFrame([(1, " ".join(f"user{i}@host{i % 7}.com" for i in range(100_000)))], "doc_id long, text string")
    begin = time.time()
    assert pii.pii(one).select("n_email").first()[0] == 100_000
    assert time.time() - begin < 60


def test_pii_adds_what_the_base_misses(spark):
    rows = [(i, f"please call ({300 + i}) 555-01{i:02d} now, mail a{i}@example.com") for i in range(60)] + [(100, "mail joe (at) example (dot) com"), (101, "a clean text with 12 words and no data")]
    got = by_id(pii.pii(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(got[i]["n_added"] for i in range(60)) >= 55 and "email:5:31" in got[100]["spans"] and got[101]["spans"] == ""


def test_reliabilities():
    good, bad, mixed = (0, (1, 1, 1, 1, 1), 100.0), (0, (0, -1, -1, -1, -1), 100.0), (0, (0, 1, 1, 1, -1), 10.0)
    post = pii.reliabilities([good, bad, mixed])
    assert post[0] > 0.95 and post[1] < 0.05 and all(0 <= p <= 1 for p in post) and not any(map(math.isnan, post))


def test_html(spark):
    page = "<html><body><div class='top'>Site name</div><nav><a>menu</a></nav><div class='c'><p>Hello &amp; w<b>or</b>ld<br>again {}<p>Two {}</div><div class='end'>Same tail</div><div class='comments'>me too</div></body>"
    rows = [(i, f"http://a.com/{i}", page.format(i, i)) for i in range(8)]
    rows += [(20, "http://b.com", "<p>x</p><script>var t='</p>'; if (a<b) c()</script><article><h1>T&eacute;</h1><header><h2>in</h2></header><aside>no</aside><p> a \n b </article><footer>f"), (21, None, None), (22, "bad url", ""), (23, "http://c.com/", "plain &lt;text&gt; <b"), (24, "http://c.com/", "<!-- open <p>x"), (25, "http://c.com", "<" * 3000)]
    got = {r["page_id"]: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x"))).collect()}
    assert [got[i]["text"] for i in (0, 7)] == ["Hello & world again 0\nTwo 0", "Hello & world again 7\nTwo 7"]
    assert got[20]["text"] == "Té\nin\na b" and got[21]["text"] == got[22]["text"] == got[24]["text"] == ""
    assert got[23]["text"].startswith("plain <text>") and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_site_tree_finds_low_branches(spark):
    page = "<html><body><div class='banner1'>Only here {0}</div><div class='x'>{0} words of its own {0}</div><div class='y'>the same words</div></body>"
    df = spark.createDataFrame([(1, page.format(i)) for i in range(10)] + [(2, page.format(0))], "host long, html string")
    low = {(r["host"], r["path"]) for r in html_extraction.low_branches(df).collect()}
    path = 0
    for part in ("html.", "body.", "div.y"):
        path = html_extraction._key(part, path)
    assert low == {(1, path)}


@pytest.mark.parametrize("rows", [200_000, 0])
def test_the_tree_removes_what_no_word_names(spark, monkeypatch, rows):
    """Pages without article: what every page of the host has goes by the tree alone, and stays on a host of one page; a deep page is read whole."""
    monkeypatch.setattr(html_extraction, "BROADCAST_ROWS", rows)
    page = "<html><body><div class='q1'><ul><li>Home</li><li>Shop</li></ul></div><div class='q2'><p>Story {0} of many</p><div class='reply'>so {0} said</div></div><div class='q3'>Call us any time</div></body></html>"
    data = [(i, f"http://a.com/{i}", page.format(i)) for i in range(3)] + [(10, "http://b.com/", page.format(10)), (11, "http://c.com/", "<div>" * 3000 + "deep"), (12, "http://a.com/0", page.format(0))]
    data += [(20 + i, f"http://d.com/{i}", f"<article><p class='reply'>Text {i}</p><div class='related'>own part {i}</div><div class='ad'>buy</div></article>") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in (0, 1, 2, 12)] == ["Story 0 of many", "Story 1 of many", "Story 2 of many", "Story 0 of many"]
    assert got[10] == "Home\nShop\nStory 10 of many\nCall us any time" and got[11] == "deep"
    assert [got[20 + i] for i in range(2)] == [f"Text {i}\nown part {i}" for i in range(2)]


def test_copies_of_pages_keep_their_text(spark):
    page = "<html><body><div class='c'><p>Words of page {0}</p><p>and more {0}</p></div></body></html>"
    rows = [(i, "http://same.com/", page.format(0)) for i in range(6)] + [(10 + i, f"http://two.com/{i}", page.format(i % 2)) for i in range(10)] + [(20 + i, None, page.format(7)) for i in range(5)]
    rows += [(30 + i, f"http://near.com/{i}", f"<!-- {i} -->" + page.format(i % 2)) for i in range(10)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "Words of page {0}\nand more {0}"
    assert got == {i: text.format(0 if i < 10 else 7 if 20 <= i < 30 else i % 2) for i, _, _ in rows}


def test_site_tree_and_articles(spark):
    """What holds an article stays although its text is on most pages; what is on all pages goes from inside the article."""
    page = "<html><body><div class='w'>{1}<article><p>{0}</p><div class='tail'>Share it with your friends</div></article></div></body></html>"
    rows = [(i, f"http://a.com/{i}", page.format("Own words" if i < 7 else f"Rare words {i}", "<!-- -->" * i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Rare words 7" and all("Own words" in t for i, t in got.items() if i < 7)


def test_line_dedup(spark, docs, empty):
    rng = random.Random(6)
    shared = prose(rng, 60)
    rows = [(i, "\n".join([*(prose(rng, 20) for _ in range(6)), shared, f"Page {i} of 99"]), "en", "s", 1) for i in range(12)]
    copy = "\n".join(prose(rng, 15) for _ in range(3))
    rows += [(100 + i, copy, "en", "s", 1) for i in range(10)]
    words = shared.split(" ")
    rows += [(200, " ".join([*words[:30], "changed", *words[31:]]), "en", "s", 1), (201, None, "en", "s", 1), (202, "", "en", "s", 1), (203, " \n ", "en", "s", 1)]
    got = by_id(line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)))
    assert got[0]["n_dropped"] == 0 and all(got[i]["n_dropped"] == 2 and shared not in got[i]["text"] for i in range(1, 12))
    assert all(got[100 + i]["text"] == copy for i in range(10))
    assert got[200]["text"] == "" and got[201]["text"] is None and got[202]["text"] == "" and got[203]["text"] == " \n "
    assert line_dedup.line_dedup(docs).count() == docs.count() and line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_counts_every_text(spark):
    """A passage in five texts recurs, whatever its hash and however short the texts are."""
    rng = random.Random(12)
    rows = [(5 * k + i, f"{prose(rng, 12)} {5 * k + i}x\n{line}", "en", "s", 1) for k, line in enumerate(f"passage{chr(97 + j)} " + prose(rng, 14) for j in range(20)) for i in range(5)]
    got = by_id(line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)))
    assert [got[i]["n_dropped"] for i in range(100)] == [0, 1, 1, 1, 1] * 20


def test_line_dedup_templates_of_one_leaf(spark):
    """Two templates of one leaf and of equal weight recur, each but in its first document; a line of neither stays."""
    names = "ann bob cleo dan eve fay gus hal ida jon kit leo".split()
    lines = [f"in the end {'the old mill by that river was' if i % 2 else 'a new road over these hills is'} sold to {n}" for i, n in enumerate(names)]
    rows = [(i, f"text of {n} alone\n{line}", "en", "s", 1) for i, (n, line) in enumerate(zip(names, lines, strict=True))] + [(50, "in the end nobody at all could say why it had come so far", "en", "s", 1)]
    got = by_id(line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)))
    assert [got[i]["n_dropped"] for i in (*range(12), 50)] == [0, 0, *[1] * 10, 0]


def shingle_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().split()
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def brute_classes(texts):
    sets, label = shingle_sets(texts), list(range(len(texts)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (texts[a] or "") == (texts[b] or "") or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return [root(a) for a in range(len(texts))]


def test_near_dedup_against_all_pairs(spark, docs, texts, empty):
    got = by_id(near_dedup.near_dedup(docs))
    assert [got[i]["class_id"] for i in range(len(texts))] == brute_classes(texts)
    assert near_dedup.near_dedup(empty).count() == 0
    assert near_dedup.kept(docs).count() == len(set(brute_classes(texts))) + 1


def test_near_dedup_chains(spark):
    """Copies of copies, and edits around the limit: links that no pivot sees."""
    rng = random.Random(9)
    rows = []
    for _ in range(4):
        own = prose(rng, 120).split(" ")
        for k in range(40):
            if k % 4 == 0:
                at = list(own)
            at = list(at)
            for _ in range(rng.randint(0, 3)):
                at[rng.randrange(len(at))] = f"w{rng.randrange(30)}"
            rows.append(" ".join(at))
    got = by_id(near_dedup.near_dedup(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")))
    assert [got[i]["class_id"] for i in range(len(rows))] == brute_classes(rows)


def test_near_dedup_finds_texts_with_repeats(spark):
    """Texts that repeat a quarter of themselves 300 times meet their near copies without repeats."""
    rows = []
    for k in range(100):
        words = [f"w{k}x{j}" for j in range(200)]
        edited = list(words)
        for j in (110, 140, 170):
            edited[j] = f"edit{k}x{j}"
        part = " ".join(words[:50])
        rows += [" ".join(edited), " ".join(words) + "".join(f" {part}" for _ in range(300))]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(*(shingle_sets(rows)[i::2] for i in (0, 1)), strict=True))
    got = by_id(near_dedup.near_dedup(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")))
    assert [got[i]["class_id"] for i in range(len(rows))] == [i - i % 2 for i in range(len(rows))]


def test_prob_min_hash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    shingles = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = np.ones(300), np.ones(300)
    a[:50], b[250:] = 4.0, 3.0
    expected = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(300))
    reg = near_dedup.prob_min_hash(np.concatenate([shingles, shingles]), np.concatenate([a, b]), np.repeat([0, 1], 300), 2)
    assert abs((reg[0] == reg[1]).mean() - expected) < 0.13


def test_mixing_reaches_targets(spark, docs, empty):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice([20, 80])), rng.choice(["en", "en", "en", "de"]), "big" if i % 3 else f"s{i % 2}", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    targets = {"source": {"big": 0.4, "s0": 0.3, "s1": 0.3}, "lang": {"en": 0.5, "de": 0.5}}
    cells = mixing.measured(df).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    fitted = mixing.raked(cells, targets, 30).toPandas()
    for dim, goals in targets.items():
        got = fitted.groupby(dim)["raked"].sum() / fitted["raked"].sum()
        assert all(abs(got[k] - g) < 1e-3 for k, g in goals.items())
    sample = mixing.mix(df, targets).toPandas()
    weighed = (sample.tokens * sample.weight).groupby(sample.source).sum()
    assert abs(weighed["big"] / weighed.sum() - 0.4) < 0.06 and len(sample) < 3000
    # Without weights: the sample itself has the target shares.
    ids = {r["doc_id"] for r in mixing.sampled(df, targets).collect()}
    left = mixing.measured(df).toPandas().query("doc_id in @ids")
    for dim, goals in targets.items():
        got = left.groupby(dim)["tokens"].sum() / left["tokens"].sum()
        assert all(abs(got[k] - g) < 0.05 for k, g in goals.items()), got
    none = mixing.mix(df, {"lang": {"de": 0.0, "en": 1.0}}).toPandas()
    assert set(none.lang) == {"en"}
    assert mixing.mix(docs).count() > 0 and mixing.mix(empty).count() == 0 and mixing.sampled(empty).count() == 0


def test_mixing_of_many_cells(spark, monkeypatch):
    """Cells beyond one task, and joins beyond a broadcast, are raked to the same result."""
    rng = random.Random(3)
    cells = spark.createDataFrame([(f"s{i}", rng.choice("ab"), rng.choice("xyz"), rng.randint(1, 900)) for i in range(30)], "source string, lang string, topic string, tokens long")
    fit = lambda: {(r["source"], r["lang"], r["topic"]): round(r["raked"], 6) for r in mixing.raked(cells, rounds=3).collect()}
    monkeypatch.setattr(mixing, "PASSES", 1)
    expected = fit()
    monkeypatch.setattr(mixing, "BOUNDED_CELLS", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert fit() == expected


def test_sentencepiece_equals_the_library(spark, docs, texts, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    m = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = by_id(sentencepiece_codec.encoded(docs))
    assert all(list(got[i]["ids"]) == m.encode(t or "") and got[i]["round_trip"] for i, t in enumerate(texts))
    back = by_id(sentencepiece_codec.decoded(sentencepiece_codec.encoded(docs)))
    assert all(back[i]["text"] == (t or "") for i, t in enumerate(texts))
    assert sentencepiece_codec.encoded(empty).count() == 0
    rng = random.Random(1)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Pieces.load())
    odd = ["".join(rng.choice("abcdefghij tionéü.,!-_=\n  0123456789(){}<>/日本🙂\t") for _ in range(rng.randint(1, 60))) for _ in range(2000)] + [" " * 40, "a" * 300]
    ids, sizes = codec.encode(odd)
    ends = np.cumsum(sizes)
    assert all(ids[e - n : e].tolist() == m.encode(t) for t, n, e in zip(odd, sizes, ends, strict=True)) and codec.decode(ids, sizes) == odd


def test_unigram_viterbi():
    pieces = ["<unk>", "▁a", "▁", "a", "b", "ab", "aba", "▁ab"]
    scores = [0, -2.0, -3.0, -2.5, -2.5, -3.5, -4.5, -2.8]
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Pieces(pieces, scores, [], 0, {0}, "unigram"))

    def best(word):
        if not word:
            return 0.0, []
        return max((s + codec.score[word[:k]], [codec.id_of[word[:k]], *p]) for k in range(1, len(word) + 1) if word[:k] in codec.id_of for s, p in [best(word[k:])])

    words = ["ab", "aba", "abab", "abba", "b", "aab"]
    ids, sizes = codec.encode(words)
    ends = np.cumsum(sizes)
    for w, n, e in zip(words, sizes, ends, strict=True):
        own = ids[e - n : e].tolist()
        assert sum(scores[i] for i in own) == pytest.approx(best("▁" + w)[0])


def test_lm_gradients_and_learning():
    rng = np.random.default_rng(0)
    flat = lm_scoring.initial(rng.integers(1, 50, lm_scoring.SIZE).astype(float)).astype(np.float64)
    context, target = rng.integers(0, lm_scoring.SIZE, (40, 4)), rng.integers(0, lm_scoring.SIZE, 40)
    rows, *rest = lm_scoring.gradients(lm_scoring.unpacked(flat), context, target)
    loss = lambda f: -lm_scoring.log_probs(lm_scoring.unpacked(f), context, target).mean()
    sizes = np.cumsum([0, *(int(np.prod(s)) for s in lm_scoring.SHAPES)])
    for at, g in ((sizes[1] + 7, rest[0].ravel()[7]), (sizes[2] + 3, rest[1][3]), (sizes[3] + 100, rest[2].ravel()[100])):
        step = np.zeros_like(flat)
        step[at] = 1e-5
        assert (loss(flat + step) - loss(flat - step)) / 2e-5 == pytest.approx(g, abs=1e-6)
    token, g = rows[0][0][0], rows[0][1][0]
    step = np.zeros_like(flat)
    step[token * lm_scoring.WIDTH] = 1e-5
    assert (loss(flat + step) - loss(flat - step)) / 2e-5 == pytest.approx(g[0], abs=1e-6)


def test_lm_trains_on_every_position():
    at = np.arange(101)
    assert sorted(np.concatenate([lm_scoring.targets(at, turn) for turn in range(lm_scoring.ROUNDS)])) == list(at)


def test_lm_scores(spark, docs, empty):
    """A text whose words follow from their neighbours scores better than the same words shuffled; nothing depends on the order of rows."""
    rng = random.Random(2)
    cycle = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(cycle[(i + k) % 12] for k in range(400))) for i in range(60)]
    mixed = rows[0][1].split(" ")
    rng.shuffle(mixed)
    rows += [(100, " ".join(mixed)), (101, None), (102, ""), (103, "w1")]
    got = by_id(lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[0]["mean_log_prob"] > got[100]["mean_log_prob"] + 0.5 and got[0]["n_tokens"] == 400
    assert got[101]["log_prob"] == got[102]["log_prob"] == 0 and got[101]["mean_log_prob"] is None and got[103]["n_tokens"] == 1
    assert lm_scoring.lm_scores(docs).count() == docs.count() and lm_scoring.lm_scores(empty).count() == 0


def extracted(spark, pages):
    rows = html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    return {r.page_id: r.text for r in rows}


def test_html_keeps_articles_found_at_two_urls(spark):
    body = '<article><h1>Title here</h1><div class="body"><p>First paragraph of words that matter.</p><p>Second paragraph, it has words too.</p></div></article>'
    got = extracted(spark, [(i, f"http://h.org/a?ref={i}", f"<html><body>{body}<footer>foot {i}</footer></body></html>") for i in range(2)])
    assert set(got.values()) == {"Title here\nFirst paragraph of words that matter.\nSecond paragraph, it has words too."}


def test_html_reads_attributes_one_by_one(spark):
    got = extracted(spark, [
        (0, "http://a.org", '<article><p>One.</p><div title="a hidden gem"><p>stays</p></div><div data-id="comment-12">stays too</div><div hidden>goes</div><div class="x comment-list">goes</div></article>'),
        (1, "http://b.org", '<div data-role="menu"><p>All of the text</p></div>'),
        (2, "http://c.org", '<article><p>see <span hidden>secret</span><a class="ad" href=x>buy</a> this <b>bold</b> <label>name</label>end</p><p>next</p></article><article class="comment"><p>I disagree</p></article>'),
        (3, "http://d.org", '<article><p>un<span hidden>closed</p><p>seen</p></article>'),
    ])
    assert got == {0: "One.\nstays\nstays too", 1: "All of the text", 2: "see this bold end\nnext", 3: "un\nseen"}


def test_the_tree_leaves_the_larger_part_of_an_article():
    body = " ".join(WORDS)
    page = f"<article><div class='a'><p>{body}</p></div><div class='b'><p>seven</p></div></article>"
    paths = {t: p for p, t in html_extraction.parse(page, everything=True)[0]}
    inside = {p: i for p, _, i in html_extraction.parse(page, everything=True)[1]}
    large, small = (inside[paths[t]] for t in (body, "seven"))
    assert [t for _, t in html_extraction.main_blocks(page, frozenset(large))] == [body, "seven"]
    assert [t for _, t in html_extraction.main_blocks(page, frozenset(small))] == [body]


def test_line_dedup_of_very_long_lines(spark):
    rng, rows = random.Random(1), []
    base = [rng.choice(WORDS) + chr(97 + rng.randrange(26)) for _ in range(20_000)]
    for i in range(6):
        own = list(base)
        for _ in range(15):
            own[rng.randrange(10, len(own))] = "changed" + chr(97 + rng.randrange(26))
        rows.append((i, " ".join(own) + f"\nown line of {'abcdef'[i]}", "en", "s", 1))
    rows.append((9, " ".join(base[:10] + [rng.choice(WORDS) for _ in range(19_990)]), "en", "s", 1))
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == rows[0][1] and got[9] == rows[-1][1]
    assert all(got[i] == f"own line of {'abcdef'[i]}" for i in range(1, 6))
