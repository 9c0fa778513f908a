"""Main text by site style trees: whole pages of a host are merged into one tree of element nodes (a path of tags, classes
and ids), each with its presentation styles (sequences of child tags) and its contents (blocks of text).

A node whose styles vary from page to page is important, and so is a content that few pages have. A block's composite
importance weighs both; a branch is as important as its most important block, and branches of low importance go. What an
element says of itself comes in as a factor: names of what an article never holds (menus, adverts, forms) are of no
importance, vague ones only tip the balance where the site's pages speak against the block too. An article element is
believed where it holds most of the page's important text; a teaser in one doesn't silence the story beside it."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import deflated, inflated, materialise, numbered, run_count, ship

#: Fixed values of HTML: elements without content, with raw text, that start a block, and that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - frozenset("body caption html option optgroup legend tbody td tfoot th thead tr".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "p": ("p",)}
FENCES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
#: Elements whose presentation says that they are not the article, and words of classes, ids and roles that say so: surely or vaguely.
NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe object embed svg canvas audio video button select textarea input menu dialog head title".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored nav navbar navigation menu menubar sidebar footer masthead breadcrumb breadcrumbs pagination "
    "cookie cookies consent gdpr notice notification notifications popup modal newsletter subscribe subscription signup login comment comments commentlist respond disqus replies".split()
)
VAGUE_WORDS = frozenset("promo promotion promoted side rail toolbar pager alert overlay toast share sharing social related recommended recommendations trending discussion widget widgets contentinfo complementary search skip hidden".split())
#: Noise words that inside an article may be its own, so that the site's pages decide, and words that say nothing at a name's end.
EDITORIAL = frozenset("banner notice notification notifications sponsor masthead".split())
GENERIC = frozenset("box block wrap wrapper container inner outer area section list item items slot unit bar body content text thread row col column group panel top bottom left right info holder zone".split())
#: Site header words count outside an article only.
HEADER_WORDS = frozenset(("header", "topbar", "top"))
#: Weight of contents against styles, the factor of vague words, the importance under which a branch goes, pages without
#: a content that each estimate starts from, so that few pages say little, the factor of what is outside the article, and
#: the share of the important text from which an article is believed.
CONTENT, VAGUE, LEAST, UNSEEN, OUTSIDE, MAJORITY = 0.9, 0.25, 0.15, 4, 0.1, 0.5

#: Bytes of html of a run.
RUN_BYTES = 8 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_WORD = re.compile(r"[A-Za-z]+")
_DIGITS = re.compile(r"\d+")
_HOST = re.compile(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


@dataclass(slots=True)
class Node:
    tag: str
    path: int = 0
    factor: float = 1.0  # what it and its ancestors say of themselves
    zone: int = 0  # in an article 2, in another main part 1, else 0
    block: bool = True
    omit: bool = False  # inline, and not for reading
    owner: Node | None = None  # the innermost block
    kids: list[str] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)  # blocks, in page order
    texts: list[tuple[Node, str]] = field(default_factory=list)  # blocks of text with their element


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for k, a, b, c in _ATTR.findall(raw):
        found.setdefault(k.lower(), html.unescape(a or b or c))
    return found


def _noisy(named: str, zone: int) -> float:
    """The factor of a name: a compound is what its last telling word says, and inside an article no more than vague if that isn't noise."""
    factor = 1.0
    for token in named.split():
        words = [w.lower() for w in _WORD.findall(token)]
        if NOISE_WORDS.intersection(words):
            telling = [w for w in words if w not in GENERIC] or words
            if zone < 2 or telling[-1] in NOISE_WORDS and not EDITORIAL.issuperset(NOISE_WORDS.intersection(words)):
                return 0.0
            factor = VAGUE
    return factor


def _step(parent: Node, tag: str, raw: str) -> Node:
    """A child with its path (tag, and class and id without digits) and what its presentation says."""
    at = _attributes(raw) if raw and not raw.isspace() else {}
    named = f"{at.get('class', '')} {at.get('id', '')} {at.get('role', '')}".strip()
    words = {w.lower() for w in _WORD.findall(named)}
    node = Node(tag, xxhash.xxh64_intdigest(f"{parent.path:x}/{tag}.{_DIGITS.sub('', named)}") >> 1, parent.factor, parent.zone, tag in BLOCKS)
    hidden = "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower()
    if not node.block:
        node.omit = parent.omit or hidden or tag in NOISE_TAGS
        node.owner = parent.owner
        return node
    node.owner = node
    page_level = tag in ("html", "body", "article", "main")
    said = 1.0 if page_level and not words & {"comment", "comments"} else _noisy(named, parent.zone)
    node.factor *= said
    if not said or tag in NOISE_TAGS or hidden or not parent.zone and (tag == "header" or bool(words & HEADER_WORDS) and not page_level):
        node.factor = 0.0
    elif words & VAGUE_WORDS and not page_level:
        node.factor *= VAGUE
    if node.factor and tag == "article":
        node.zone = 2
    elif node.factor and (tag == "main" or "main" in at.get("role", "") or at.get("itemprop") == "articleBody"):
        node.zone = max(1, node.zone)
    return node


def parse(page: str) -> Page:
    """A lenient reading in one pass, whatever the depth: unclosed elements end where HTML ends them, unmatched end tags
    are ignored, comments are dropped."""
    out = Page()
    root = Node("")
    root.owner = root
    out.nodes.append(root)
    stack, at = [root], 0
    open_ = Counter()
    held: list[str] = []

    def end() -> None:
        if held and (text := tidy("".join(held))):
            out.texts.append((stack[-1].owner, text))
        held.clear()

    def close(i: int) -> None:
        while len(stack) > i:
            if stack[-1].block:
                end()
            open_[stack.pop().tag] -= 1

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            held.append(" " if stack[-1].omit else page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if open_[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
        elif m[2]:
            tag = m[2].lower()
            for closed in (("p",) if tag in ENDS_P and tag != "p" else ()) + SAME.get(tag, ()):
                if not open_[closed]:
                    continue
                fence = FENCES.get(closed, ("table",) if closed in ("tr", "td", "th", "tbody", "thead", "tfoot") else ())
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == closed:
                        close(i)
                        break
                    if stack[i].tag in fence or closed == "p" and stack[i].block:
                        break
            node = _step(stack[-1], tag, m[3])
            stack[-1].owner.kids.append(tag)
            if node.block:
                end()
                out.nodes.append(node)
            elif tag == "br" or node.omit:
                held.append(" ")
            if tag in RAW:
                found = _CLOSE[tag].search(page, at)
                at = found.start() if found else len(page)
            elif tag not in VOID and (node.block or not m[3].endswith("/")):  # a slash means nothing on a block with content
                stack.append(node)
                open_[tag] += 1
    if at < len(page):
        held.append(" " if stack[-1].omit else page[at:])
    close(1)
    end()
    return out


def tidy(text: str) -> str:
    return " ".join(html.unescape(text).split())


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def features(page: Page) -> set[tuple[int, int, int]]:
    """(path, kind, value) of a page's element nodes: that they are there (0), their styles (1), their contents (2)."""
    found = {(n.path, 0, 0) for n in page.nodes}
    found |= {(n.path, 1, digest(" ".join(n.kids))) for n in page.nodes}
    return found | {(n.path, 2, digest(text)) for n, text in page.texts}


def main_text(page: Page, styles: dict[int, float], contents: dict[tuple[int, int], float]) -> str:
    """The important blocks, joined by two line ends. styles: the presentation importance of the site's nodes; contents: how
    important contents of more than one page are. Blocks outside the articles (or else the main parts) count as little where
    those hold most of the page's important text."""
    values = []
    for node, text in page.texts:
        value = node.factor and node.factor * ((1 - CONTENT) * styles.get(node.path, 1.0) + CONTENT * contents.get((node.path, digest(text)), 1.0))
        values.append(value if value >= LEAST else 0.0)
    mass = lambda least: sum(v * len(t) for v, (n, t) in zip(values, page.texts, strict=True) if n.zone >= least)
    zone = next((z for z in (2, 1) if mass(0) and mass(z) >= MAJORITY * mass(0)), 0)
    return "\n\n".join(t for v, (n, t) in zip(values, page.texts, strict=True) if v * (1 if n.zone >= zone else OUTSIDE) >= LEAST)


NODES = {"batch": pa.int32(), "host": pa.string(), "path": pa.int64(), "kind": pa.int32(), "value": pa.int64(), "n": pa.int64()}
TEXTS = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()}


def _table(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(names.items(), cols, strict=True)})


def _pages(table: pa.Table):
    for i, body in enumerate(inflated(table.column("body"))):
        yield i, parse(body.decode("utf-8", "replace"))


def _count(table: pa.Table, firsts: pa.Table) -> pa.Table:
    """Features of each host in a run, with their number of pages; equal pages of a host count once."""
    if not firsts.num_rows:
        return _table(NODES, [])
    table = table.filter(pc.is_in(table.column("row"), firsts.column("row")))
    hosts = table.column("host").to_pylist()
    n: Counter[tuple] = Counter()
    for i, page in _pages(table):
        n.update((hosts[i], *f) for f in features(page))
    batch = firsts.column("batch")[0].as_py()
    return _table(NODES, [(batch, *k, v) for k, v in n.items()])


def _extract(table: pa.Table, said: pa.Table) -> pa.Table:
    styles: dict[str, dict] = {}
    contents: dict[str, dict] = {}
    pages: dict[tuple, int] = {}
    for host, path, m, style in zip(*(said.filter(pc.equal(said.column("kind"), 0)).column(c).to_pylist() for c in ("host", "path", "m", "style")), strict=True):
        styles.setdefault(host, {})[path] = style
        pages[host, path] = m
    for host, path, value, n in zip(*(said.filter(pc.equal(said.column("kind"), 2)).column(c).to_pylist() for c in ("host", "path", "value", "m")), strict=True):
        contents.setdefault(host, {})[path, value] = content_importance(n, pages[host, path])
    hosts, ids, urls = (table.column(c).to_pylist() for c in ("host", "doc_id", "url"))
    rows = []
    for i, page in _pages(table):
        text = main_text(page, styles.get(hosts[i], {}), contents.get(hosts[i], {}))
        rows.append((ids[i], urls[i], text, len(text)))
    return _table(TEXTS, rows)


def importances(nodes: DataFrame) -> DataFrame:
    """From counts (batch, host, path, kind, value, n): for each batch, of its nodes that several pages have, on how many they
    are and the importance of their presentation (kind 0), and on how many pages its contents are, if on several (kind 2).

    Entropies are to the base of the number of pages with the node, UNSEEN more added. A path has a row per batch and
    style, a content one per batch: no host, path or content is hot."""
    key = ["host", "path"]
    log = lambda c: F.log(F.col(c).cast("double"))
    pages = nodes.filter("kind = 0").groupBy(*key).agg(F.sum("n").alias("m")).filter("m > 1")
    each = nodes.filter("kind = 1").groupBy(*key, "value").agg(F.sum("n").alias("n"))
    styles = each.groupBy(*key).agg(F.sum("n").alias("all"), F.sum(F.col("n") * log("n")).alias("logs"))
    entropy = (log("all") - F.col("logs") / F.col("all")) / F.log(F.col("m") + F.lit(float(UNSEEN)))
    known = pages.join(styles, key).select(*key, "m", entropy.alias("style"))
    here = nodes.filter("kind = 0").select("batch", *key).join(known, key)
    texts = nodes.filter("kind = 2")
    shared = texts.select("batch", *key, "value").join(texts.groupBy(*key, "value").agg(F.sum("n").alias("m")).filter("m > 1"), [*key, "value"])
    return here.select("batch", *key, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("value"), "m", "style").unionByName(
        shared.select("batch", *key, F.lit(2).alias("kind"), "value", "m", F.lit(None).cast("double").alias("style"))
    )


def content_importance(n: int, m: int) -> float:
    """Of a content on n of the m pages with its node: what the entropy of its places leaves of 1."""
    return max(0.0, 1 - math.log(n) / math.log(m + UNSEEN))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    Runs of pages, sized by their text, count the features of their hosts' nodes; the counts are summed per host, path and
    value, and each run gets back what several pages share. A host, however large, is only ever counts; equal pages of a
    host count once, so that copies don't make each other noise.

    Null html is an empty page. Null urls, and those without a host, belong to no site. Very long and very deep pages are read in
    one pass. Repeated rows are pages of their own, which count once as equal pages do. Other columns are ignored; an empty table gives an empty result."""
    ship(pages.sparkSession)
    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST.pattern, 1))
    body = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    pages, row = numbered(pages, "row")
    rows = pages.select(F.col(id_col).cast("long").alias("doc_id"), url.alias("url"), host.alias("host"), body.alias("body"), F.col(row).alias("row"))
    n = run_count(pages.sparkSession, rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0, RUN_BYTES)
    batch = F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("batch")
    # pages without a host share nothing with each other
    firsts = rows.filter("host != ''").groupBy("host", F.md5("body").alias("md5")).agg(F.min("row").alias("row")).select("row", batch)
    dealt = rows.select("*", batch).mapInArrow(deflated, "doc_id long, url string, host string, body binary, row long, batch int")
    counted = dealt.groupBy("batch").cogroup(firsts.select("batch", "row").groupBy("batch"))
    nodes = materialise(counted.applyInArrow(_count, "batch int, host string, path long, kind int, value long, n long"), "nodes")
    said = materialise(importances(nodes), "importance")
    return dealt.groupBy("batch").cogroup(said.groupBy("batch")).applyInArrow(_extract, "page_id long, url string, text string, n_chars long")
