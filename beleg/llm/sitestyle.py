"""Main text of web pages with a site style tree.

All pages of a host are merged into one tree. Its nodes are element paths (block elements with their classes, below body);
a node keeps, over the distinct pages that have it, how they present it (the sequence of child tags) and what they say in it
(hashes of its text blocks). Over m pages,

* presentation importance is the entropy of the presentations, base m;
* content importance is 1 - the mean, over occurrences, of log_m(pages with the same text);
* a node's importance is (1 - GAMMA) presentation + GAMMA content, and a branch's is the mean of its nodes' by occurrences.

Branches below ``LEAST`` on hosts with ``MIN_PAGES`` distinct pages are removed from each page. What a page itself declares to be no
article (elements and classes of menus, footers, forms and so on, fixed lists below) goes first, on any host; a form only unless
it holds an article or main element, or all text of the page.

Elements without class or id in a main or article element (plain ones) are told apart by their text: each text under a path is a
node, and its content importance is 1 - log_m(pages with the text) over the m pages with the path. So a line that is repeated
on all pages goes and its siblings stay; the branches around count such nodes, but their removal leaves them alone. Only the first
plain text of a page, its title or lead, always stays.

Text outside main and article elements is judged by importance like text inside. On hosts without a tree (too few pages) it
counts only where it is longer than the text inside.

Equal pages of a host count once, so copies don't make an article look like a template. Counts are pre-aggregated; a hot
host's pages are split by Spark in the join with its (single-row) list of removed branches.

Defined results: null or empty html, or no text: empty string, 0. Null urls are a host of their own. Unclosed elements, comments
and attributes end with the page or where HTML closes them. Repeated rows are extracted one by one. An empty table gives an
empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beleg.llm.tables import cut_lineage, map_rows
from beleg.llm.urls import host_and_path

GAMMA = 0.9
LEAST = 0.3
MIN_PAGES = 4

# Element and class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre section summary table caption tbody thead tfoot tr td th ul".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog button select optgroup option datalist svg foreignobject canvas object audio video map fieldset head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer colophon sidebar aside ad ads adv advert adverts advertisement "
    "advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login comment comments reply replies respond disqus discussion feedback share sharing social related recommended recommendations "
    "widget widgets toolbar pagination pager copyright disclaimer search form skip".split())
NOISE_FIRST = NOISE_NAMES - {"header", "form", "search", "related", "login", "notice", "alert", "feedback"}
RESCUE = frozenset("content main article body text story wrapper container page".split())
EXEMPT_FIRST = frozenset("has with no without is".split())

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|</[^A-Za-z>][^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_CLOSED_BY: dict[str, frozenset[str]] = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]),
}
# Elements on top of the stack that end before a start tag of the noise elements that are no blocks; before any block, option and svg end.
_ENDS_BEFORE: dict[str, frozenset[str]] = {"option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"]), "button": frozenset(["button"])}
_ENDS_BEFORE_BLOCK = frozenset(["option", "svg"])
_BARRIER = frozenset("table ul ol dl div article section main body html td th blockquote aside nav".split())


def is_noise_name(name: str, inside: bool) -> bool:
    """Whether one class or id says that an element is no article text; inside: whether it lies in an article."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in EXEMPT_FIRST:
        return False
    if words[-1] in NOISE_NAMES:
        return not (inside and words[-1] == "header")
    return words[0] in NOISE_FIRST and words[-1] not in RESCUE


@dataclass
class Element:
    tag: str
    path: str
    noise: bool
    inside: bool
    named: bool
    forms: tuple[int, ...] = ()  # the forms around, by number on the page
    children: list[str] = field(default_factory=list)


@dataclass
class Page:
    blocks: list[tuple[str, str, bool, bool]] = field(default_factory=list)  # path, text, inside an article, plain there
    styles: dict[str, str] = field(default_factory=dict)  # path -> child tags


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text else {}


def _opened(tag: str, text: str, parent: Element) -> Element:
    attributes = _attributes(text)
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    inside = parent.inside or tag in ("article", "main") or attributes.get("role") == "main"
    noise = parent.noise or (tag in NOISE_TAGS and tag != "form") or (tag == "header" and not parent.inside) or attributes.get("role", "").lower() in NOISE_ROLES
    noise = noise or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
    if not noise and tag not in ("html", "body", "main", "form"):
        noise = any(is_noise_name(n, parent.inside) for n in names)
    path = parent.path if tag in ("html", "body") else f"{parent.path}/{'.'.join([tag, *sorted(set(names))])}"
    return Element(tag, path, noise, inside, bool(names) or (parent.named and parent.inside), parent.forms)


def parse(source: str | None) -> Page:
    """Text blocks in page order, without those that the page declares to be no article."""
    page, stack, pieces = Page(), [Element("", "", False, False, False)], []
    owner, forms, holding, n_forms = stack[0], [], set(), 0  # whose text the pieces are; forms around each block; forms with an article

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                page.blocks.append((owner.path, text, owner.inside, owner.inside and not owner.named))
                forms.append(owner.forms)

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            done = stack.pop()
            if not done.noise:
                page.styles.setdefault(done.path, " ".join(done.children))

    def text_of(start: int, end: int) -> None:
        nonlocal owner
        if start < end and not stack[-1].noise:
            owner = stack[-1]
            raw = source[start:end]
            pieces.append(html.unescape(raw) if "&" in raw else raw)

    at, source = 0, source or ""
    while at < len(source):
        m = _TAG.search(source, at)
        if m is None:
            text_of(at, len(source))
            break
        text_of(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag), 0)
                if depth and tag not in ("html", "body"):
                    close(depth)
            elif tag in NOISE_TAGS:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag), 0)
                if depth and any(e.tag in BLOCK for e in stack[depth:]):
                    close(depth)
                elif depth:  # the text around goes on
                    del stack[depth:]
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in BLOCK:
            flush()
            while stack[-1].tag in _ENDS_BEFORE_BLOCK:
                stack.pop()
            if stack[-1].tag == "p":
                close(len(stack) - 1)
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag in _CLOSED_BY.get(tag, ()):
                    close(d)
                elif stack[d].tag in _BARRIER:
                    break
            if stack[-1].children[-1:] != [tag]:  # runs of one tag count once
                stack[-1].children.append(tag)
            if tag != "hr":
                parent = stack[-1]
                stack.append(_opened(tag, m[3], parent))
                if tag == "form":
                    stack[-1].forms += (n_forms,)
                    n_forms += 1
                elif stack[-1].inside and not parent.inside:
                    holding.update(parent.forms)
        elif tag in NOISE_TAGS:
            while stack[-1].tag in _ENDS_BEFORE.get(tag, ()):
                stack.pop()
            if tag != "svg" or not m[3].endswith("/"):
                stack.append(_opened(tag, m[3], stack[-1]))
    close(1)
    # A form that holds the article, or all text of the page, is no noise.
    outside = [b for b, around in zip(page.blocks, forms) if holding.issuperset(around)]
    page.blocks = outside or page.blocks
    return page


def main_text(page: Page, removed: frozenset[str] | None) -> str:
    """The page's text without the removed branches and plain texts (None: its host has no tree)."""
    if not removed:
        kept = page.blocks
    else:
        lead = next((b for b in page.blocks if b[3]), None)
        kept = [b for b in page.blocks if b is lead or not (_node(b[0], b[1]) in removed if b[3] else any(p in removed for p in _branches(b[0])))]
    if removed is None:
        inside = [b for b in kept if b[2]]
        if 2 * sum(len(b[1]) for b in inside) >= sum(len(b[1]) for b in kept):
            kept = inside
    return "\n".join(b[1] for b in kept)


def _node(path: str, text: str) -> str:
    """The node of a plain text."""
    return f"{path}#{_hash(text)}"


def _branches(path: str) -> list[str]:
    """The path and all its prefixes."""
    parts = path.split("/")
    return ["/".join(parts[:n]) for n in range(2, len(parts) + 1)]


def _hash(value: str) -> int:
    number = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"))
    return number - (1 << 64) if number >> 63 else number


def tree_rows(pages: DataFrame) -> DataFrame:
    """One row per page: host, a hash of its blocks, and its nodes with text: path, presentation and hashes of their text or plain text."""

    def run(hosts: list, sources: list) -> Iterator[dict[str, list]]:
        hashes, nodes = [], []
        for source in sources:
            page, own = parse(source), {}
            for path, text, _, plain in page.blocks:
                own.setdefault((path, plain), set()).add(_hash(text))
            hashes.append(_hash("\0".join(b[1] for b in page.blocks)))
            nodes.append([{"path": p, "plain": plain, "style": _hash(page.styles.get(p, "")), "texts": sorted(t)} for (p, plain), t in own.items()])
        yield {"host": hosts, "page": hashes, "nodes": nodes}

    return map_rows(pages, "host string, page long, nodes array<struct<path:string,plain:boolean,style:long,texts:array<long>>>", run, "host", "html")


def removed_branches(pages: DataFrame, least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, removed): the branches and plain texts below the least importance, of hosts that have a tree."""
    distinct = tree_rows(pages).filter(F.size("nodes") > 0).dropDuplicates(["host", "page"])
    nodes = cut_lineage(distinct.select("host", F.explode("nodes").alias("n")).select("host", "n.*"), "nodes")
    key = ["host", "path", "plain"]
    m = nodes.groupBy(*key).agg(F.count("*").alias("m")).filter(F.col("m") >= min_pages)
    texts = nodes.select(*key, F.explode("texts").alias("t")).groupBy(*key, "t").agg(F.count("*").alias("n"))

    styles = nodes.filter("NOT plain").groupBy(*key, "style").agg(F.count("*").alias("n")).groupBy(*key).agg(F.sum(F.col("n") * F.log("n")).alias("style_sum"))
    sums = texts.filter("NOT plain").groupBy(*key).agg(F.sum(F.col("n") * F.log("n")).alias("text_sum"), F.sum("n").alias("n"))
    presentation = 1 - F.col("style_sum") / F.col("m") / F.log("m")
    content = 1 - F.col("text_sum") / F.col("n") / F.log("m")
    known = m.join(styles, key).join(sums, key).select("host", "path", "n", (F.col("n") * ((1 - GAMMA) * presentation + GAMMA * content)).alias("weight"))

    alone = GAMMA * (1 - F.log("n") / F.log("m"))  # a plain text presents nothing
    low = F.concat("path", F.lit("#"), F.col("t").cast("string"))
    plain = texts.filter("plain").join(m, key).groupBy("host", "path").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * alone).alias("weight"), F.collect_list(F.when(alone < least, low)).alias("low"))
    plain = cut_lineage(plain, "plain")

    parts = F.split("path", "/")
    branches = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    nodes = known.unionByName(plain.select("host", "path", "n", "weight")).filter(F.size(parts) > 1)
    branch = nodes.select("host", F.explode(branches).alias("branch"), "n", "weight").groupBy("host", "branch").agg((F.sum("weight") / F.sum("n")).alias("importance"))
    found = branch.select("host", F.when(F.col("importance") < least, F.array("branch")).otherwise(F.array().cast("array<string>")).alias("low")).unionByName(plain.select("host", "low"))
    return found.groupBy("host").agg(F.flatten(F.collect_list("low")).alias("removed"))


def judge(pages: DataFrame, least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    hosted = pages.select("page_id", "url", "html", host_and_path(F.col("url"))[0])
    removed = cut_lineage(removed_branches(hosted, least, min_pages), "branches")

    def run(ids: list, urls: list, sources: list, removed: list) -> Iterator[dict[str, list]]:
        texts = [main_text(parse(s), None if r is None else frozenset(r)) for s, r in zip(sources, removed)]
        yield {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    joined = hosted.select(F.col("page_id").cast("long"), "url", "html", "host").join(removed, "host", "left")
    return map_rows(joined, "page_id long, url string, text string, n_chars long", run, "page_id", "url", "html", "removed")
