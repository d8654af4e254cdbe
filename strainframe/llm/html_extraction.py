"""HTML extraction (operator 6): a site style tree for each host.

The pages of a host are merged by the paths of their elements (tag and class). For each container of the merged tree,
content importance comes from the entropy of its contents over the host's pages (a content on every page says nothing,
one on a single page says most), and presentation importance from the entropy of its children's tag sequences. Containers of
low importance are removed from each page, beside those that say themselves what they are (nav, footer, class="ad", ...);
inside an article fewer words say so. Pages of a host whose articles (without an article: whose blocks) are the same are copies, whatever else differs, and
count as one page. Of an article the tree removes no branch that holds half of its words or more and LEAST_BODY words, as near copies share one. Paragraphs, headings and the like, html, body,
an article or main element and what holds one on any page of the host are never of low importance; containers inside an article can be.
Where a page has an article, the text is what it holds. A page that would lose all its text to the tree keeps it, less its noise.
Elements nested below DEPTH containers are judged with the container at that depth.

Text: character references decoded, white space in a block as one space, blocks in page order joined by one line
feed. Defined results: null and empty html give an empty text; a null or bad url is a host of its own kind (empty); repeated
rows give equal texts; markup that does not end ends with the page; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, met, small_enough, table, written

# Element names of HTML by kind, and words that class, id and role use for what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br".split())
NOISE_TAGS = frozenset("head nav footer aside form button select textarea iframe svg canvas object dialog menu noscript template audio video map fieldset option".split())
NOISE_WORDS = frozenset("""ad ads advert adverts advertisement banner nav navbar navigation menu sidebar footer header cookie cookies consent notice popup
    modal promo sponsor sponsored share sharing social related comment comments reply respond disqus breadcrumb breadcrumbs newsletter subscribe signup
    login search form widget toolbar pagination pager skip alert masthead copyright contentinfo complementary dialog""".split())
#: Of these, words that an article may use for its own parts.
OWN_WORDS = frozenset("related reply respond header search alert login widget share sharing social skip pagination pager form dialog complementary".split())
#: Elements that are text: no word and no tree removes them.
TEXTUAL = frozenset("html body p h1 h2 h3 h4 h5 h6 blockquote pre li tr td th tbody thead dd dt figcaption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN = frozenset(["article", "main"])
#: Words by which an article says that it is a reader's comment.
COMMENT_WORDS = frozenset("comment comments reply respond".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|title|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[!?][^>]*(?:>|\Z)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
LEAST_PAGES, LEAST_IMPORTANCE, PRESENTATION, DEPTH = 2, 0.35, 0.1, 64
#: Words from which on a branch may be an article's body.
LEAST_BODY = 20


def _key(text: str, above: int = 0) -> int:
    """A 64-bit hash of a text, or of an element (tag and class) below the path of a hash."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), above & (2**64 - 1)) - (1 << 63)


def _noise(tag: str, attrs: str, in_main: bool) -> tuple[bool, str]:
    """Whether an element says that it is not the article; its class as part of its path."""
    bad, style = tag in NOISE_TAGS or tag == "header" and not in_main, ""
    if "=" in attrs or "hidden" in attrs.lower():
        for m in ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "class" and tag not in MAIN:
                style = value
            if tag in ("html", "body"):
                continue
            if name in ("class", "id", "role"):
                said = NOISE_WORDS.intersection(re.split(r"[^a-z0-9]+", value))
                if tag in MAIN:
                    bad = bad or tag == "article" and bool(said & COMMENT_WORDS)
                else:
                    bad = bad or bool(said) and not (in_main and (tag in TEXTUAL or said <= OWN_WORDS))
            else:
                bad = bad or name == "hidden" or name == "aria-hidden" and value == "true"
    return bad, style


def parse(html: str, low: frozenset = frozenset(), everything: bool = False) -> tuple[list[tuple[int, str]], list[tuple], set[int]]:
    """Blocks (path, text) that no noise or low branch holds, elements (path, tags of children, containers they are in), and the paths of what holds an article or main.

    With such an element the blocks are those in it. everything: all blocks, noise or not, for the site's tree. Paths are hashes.
    """
    blocks: list[tuple[int, str, bool]] = []
    nodes: list[tuple] = []
    stack: list[tuple] = []  # tag, path, noise, tags of children, containers
    holders: set[int] = set()
    text: list[str] = []
    inline: list[tuple[str, bool]] = []  # open inline elements of the block
    noise = mains = unseen = 0
    met_main = False

    def flush() -> None:
        nonlocal unseen
        inline.clear()
        unseen = 0
        if text:
            if not noise and (block := " ".join(entities.unescape("".join(text)).split())):
                blocks.append((stack[-1][1] if stack else 0, block, mains > 0))
            text.clear()

    def pop() -> None:
        nonlocal noise, mains
        tag, path, bad, children, inside = stack.pop()
        noise -= bad
        mains -= tag in MAIN
        if everything:
            nodes.append((path, tuple(children), inside))

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at and not noise and not unseen:
            text.append(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif m[2]:
                if any(x == tag for x, _ in inline):
                    while (closed := inline.pop())[0] != tag:
                        unseen -= closed[1]
                    unseen -= closed[1]
            elif tag not in VOID:
                own = tag == "label" or bool(m[4]) and _noise(tag, m[4], mains > 0)[0]
                inline.append((tag, own and not everything))
                unseen += own and not everything
            continue
        flush()
        if m[2]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    while len(stack) > depth:
                        pop()
                    break
            continue
        if tag in VOID:
            continue
        if stack and stack[-1][0] == "p":
            pop()
        while stack and stack[-1][0] in CLOSES.get(tag, ()):
            pop()
        bad, style = _noise(tag, m[4], mains > 0)
        bad = bad and not everything
        path = _key(f"{tag}.{style}", stack[-1][1] if stack else 0)
        judged = tag not in TEXTUAL and tag not in MAIN
        if judged and not bad and path in low:
            bad = True
        if stack and (not stack[-1][3] or stack[-1][3][-1] != tag):
            stack[-1][3].append(tag)
        if tag in MAIN:
            holders.add(path)
            holders.update(x[1] for x in stack)
        if not m[4].endswith("/"):
            inside = stack[-1][4] if stack else ()
            stack.append((tag, path, bad, [], (*inside, path) if judged and len(inside) < DEPTH else inside))
            noise += bad
            mains += tag in MAIN
            met_main = met_main or tag in MAIN and not noise
    if at < len(html) and not noise and not unseen:
        text.append(html[at:])
    flush()
    while stack:
        pop()
    return [(p, t) for p, t, inside in blocks if inside or not met_main or everything], nodes, holders


CONTENT, CHILDREN, PAGE, HOLDS = 0, 1, 2, 3
STYLED = pa.schema([("host", pa.int64()), ("path", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64()), ("above", pa.list_(pa.int64())), ("n", pa.float64())])


def _styled(batches):
    """The site trees' contents and children's tags by host and path, each counted once a page, of whose copies each counts in part; above: the containers of a path."""
    for batch in batches:
        rows: dict[tuple, float] = defaultdict(float)
        above: dict[int, tuple] = {}
        for host, html, copies in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            blocks, nodes, holders = parse(html, everything=True)
            found = {(path, CONTENT, _key(text)) for path, text in blocks} | {(path, CHILDREN, _key(" ".join(children))) for path, children, _ in nodes}
            for x in found | {(path, HOLDS, 0) for path in holders} | {(0, PAGE, 0)}:
                rows[host, *x] += 1 / copies
            above |= {path: inside for path, _, inside in nodes}
        cols = list(zip(*((h, p, k, f, above[p] if k == CHILDREN else None, n) for (h, p, k, f), n in rows.items()), strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, STYLED, strict=True)], schema=STYLED)


def signature(html: str) -> int:
    """What copies of a page have in common: the blocks of its articles, or all where there is none."""
    return _key("\n".join(t for _, t in parse(html)[0]))


def _signed(batches):
    for batch in batches:
        signs = pa.array([signature(x) for x in batch.column(2).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signs], names=["page", "host", "sign"])


def with_copies(pages: DataFrame) -> DataFrame:
    """host, html and how many rows of the host are copies of it."""
    own = pages.select("host", "html", F.xxhash64("host", "html").alias("page"))
    # Rows of one page are counted before they are dealt, and pages of one sign once more.
    signs = written(own.select("page", "host", "html").mapInArrow(_signed, "page long, host long, sign long").groupBy("page", "host", "sign").agg(F.count("*").alias("n")), "signs")
    several = signs.groupBy("host", "sign").agg(F.sum("n").alias("copies")).where("copies > 1")
    copies = met(signs, several, ["host", "sign"], "inner", F.col("page")).select("page", "copies")
    return met(own, copies, ["page"], "left", F.col("html")).select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))


def low_branches(pages: DataFrame) -> DataFrame:
    """host and path of each branch of low importance (pages: host as a 64-bit hash, html)."""
    rows = with_copies(pages).mapInArrow(_styled, "host long, path long, kind int, feature long, above array<long>, n double")
    found = rows.groupBy("host", "path", "kind", "feature").agg(F.greatest(F.lit(1.0), F.round(F.sum("n"))).alias("n"), F.first("above", ignorenulls=True).alias("above"))
    logs = F.when((F.col("kind") == CONTENT), F.log("n"))
    styles = F.when(F.col("kind") == CHILDREN, F.col("n") * F.log("n"))
    paths = found.groupBy("host", "path").agg(F.sum(logs).alias("logs"), F.count(logs).alias("contents"), F.sum(styles).alias("styles"), F.sum(F.when(F.col("kind") == CHILDREN, F.col("n"))).alias("seen"), F.max(F.when(F.col("kind") == PAGE, F.col("n"))).alias("m"), F.first("above", ignorenulls=True).alias("above"), F.max(F.col("kind") == HOLDS).alias("holds"))
    paths = written(paths, "paths")  # the pages are parsed once for it
    hosts = paths.where(F.col("m") >= LEAST_PAGES).select("host", "m")
    inside = paths.where("contents > 0").select("host", F.explode("above").alias("path"), "logs", "contents").groupBy("host", "path").agg(F.sum("logs").alias("logs"), F.sum("contents").alias("contents"))
    rated = inside.join(paths.where("NOT holds").select("host", "path", "styles", "seen"), ["host", "path"]).join(hosts, "host")
    # A content on k of m pages has entropy log k / log m; children's sequences have the entropy of their shares.
    content = 1 - F.col("logs") / F.col("contents") / F.log("m")
    presentation = F.least(F.lit(1.0), (F.log("seen") - F.col("styles") / F.col("seen")) / F.log("m"))
    importance = (1 - PRESENTATION) * content + PRESENTATION * F.coalesce(presentation, F.lit(0.0))
    return rated.where(importance < LEAST_IMPORTANCE).select("host", "path")


def _paths(batches):
    """page, host and path of each container of each page."""
    for batch in batches:
        found = [(page, host, path) for page, host, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for path in {p for _, _, inside in parse(html, everything=True)[1] for p in inside}]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*found, strict=True)) or [[]] * 3)], names=["page", "host", "path"])


def _words(blocks: list[tuple[int, str]]) -> int:
    return sum(len(t.split()) for _, t in blocks)


def main_blocks(html: str, low: frozenset = frozenset()) -> list[tuple[int, str]]:
    """The blocks of a page without its low branches: of an article never the larger part."""
    blocks, nodes, holders = parse(html)
    if not low:
        return blocks
    if holders:
        # What each low branch alone would take, and what all would.
        whole = _words(blocks)
        body = lambda left: (gone := whole - _words(left)) >= LEAST_BODY and 2 * gone >= whole
        low = frozenset(p for p in low if not body(parse(html, frozenset([p]))[0]))
        left = parse(html, low)[0]
        return blocks if body(left) else left or blocks
    return parse(html, low)[0] or blocks


def _texts(htmls: list[str], lows: list) -> tuple[list[str], list[int]]:
    texts = []
    for html, low in zip(htmls, lows, strict=True):
        low = frozenset(low or ())
        if low:
            low &= {p for _, _, inside in parse(html, everything=True)[1] for p in inside}
        texts.append("\n".join(t for _, t in main_blocks(html, low)))
    return texts, [len(t) for t in texts]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.xxhash64(host).alias("host"))
    low = written(low_branches(own.select("host", "html")), "low")
    if small := small_enough(low, BROADCAST_ROWS):
        hosts = defaultdict(set)
        for h, path in low.collect():  # BROADCAST_ROWS pairs of numbers at most
            hosts[h].add(path)
        shared = pages.sparkSession.sparkContext.broadcast(dict(hosts))
    else:
        # Each page with its own low branches, however many its host has.
        own = own.withColumn("page", F.xxhash64("host", "html"))
        paths = own.select("page", "host", "html").mapInArrow(_paths, "page long, host long, path long").distinct()
        mine = met(paths, low, ["host", "path"], "left_semi", F.col("page")).groupBy("page").agg(F.collect_list("path").alias("low"))
        own = own.join(mine, "page", "left")

    def extracted(batches):
        for batch in batches:
            keys = batch.column(3).to_pylist()
            texts, sizes = _texts(batch.column(2).to_pylist(), [shared.value.get(h) for h in keys] if small else keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return own.select("page_id", "url", "html", "host" if small else "low").mapInArrow(extracted, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
