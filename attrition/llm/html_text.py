"""Main text of web pages by site style trees.

The pages of one host are merged into a style tree: a node is a path of block
elements with their classes, as they look the same on every page. For each node
two entropies over the host's m pages say how much it tells: that of its content
(the text below it) and that of its presentation (the elements below it), both
divided by log m, so that 0 stands for the same on all pages and 1 for different
on each. Branches whose importance is low are taken out of every page, besides
those whose element, role or class names them menu, header, footer, sidebar,
notice, advert, form or reader comments. A class is such a name only as a whole
(``site-footer``, not ``has-sidebar`` or ``market-share``), and where names would leave
nothing of a page, they don't count. Pages with the same main text count once, so
that mirrored articles don't look like boilerplate. Any host of two different pages has
a tree: of few pages only what is the same on all of them is as low as ``LOW``.

Parsing takes time in proportion to the page, however deep its elements or broken
its tags: the digest of a node is that of its children's. Pages are parsed in Python; counts and entropies are Spark aggregates, which are
combined before the shuffle, so a host with a third of all pages is no hot key.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, read_table

MIN_PAGES = 2           # different pages of a host, without which nothing can be the same
LOW = 0.3               # importance at or below which a branch goes
PRESENTATION = 0.1      # weight of presentation against content
SALTS = 64              # pieces that the pages of a host are dealt to

# HTML elements by what they do to text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr "
             "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes template svg".split())
NOISE = set("nav header footer aside form menu dialog head button select option fieldset "
            "object applet audio video canvas".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu "
            "menubar toolbar status".split())
# Names in class or id that tell what a branch is.
NAMES = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
            "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar footer masthead "
            "comment comments commentlist reply replies respond disqus notice notices cookie "
            "cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login "
            "social share sharing related recommended pagination pager widget widgets copyright disclaimer "
            "skip".split())
# What may stand beside such a name in one class, and what undoes it.
BESIDE = set("site page main top bottom left right inner outer global header content container wrapper wrap box block "
             "section area list item items bar panel link links post posts article articles news story stories "
             "module group primary secondary mobile desktop sticky fixed text body inline form button".split())
UNDONE = set("has no not with without".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
                   r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _named(attributes: dict[str, str], names: set[str]) -> bool:
    """Whether a class or the id is one of the names, alone or with words that change nothing."""
    for token in (attributes.get("class", "") + " " + attributes.get("id", "")).lower().split():
        parts = [x for x in re.split(r"[^a-z0-9]+", token) if x]
        if parts and parts[0] not in UNDONE and not names.isdisjoint(parts) and all(
                x in names or x in NAMES or x in BESIDE or len(x) < 3 or x.isdigit() for x in parts):
            return True
    return False


def _noisy(tag: str, attributes: dict[str, str], in_main: bool, by_name: bool) -> bool:
    if tag == "header" and in_main:
        return False
    if tag in NOISE or attributes.get("role", "").lower() in ROLES or "hidden" in attributes:
        return True
    if attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    if tag in ("html", "body", "main") or not by_name:
        return False
    if tag == "article":
        return _named(attributes, {"comment", "comments", "reply", "related", "ad", "advert", "promo"})
    return _named(attributes, NAMES) or (not in_main and _named(attributes, {"header"}))


class Page:
    """The block elements of a page and its text blocks outside noise, in page order.

    An element has a parent (-1 at the top), a step (tag and classes) and a style: the
    digest of the steps down to it. A block is (element, text, inside the article). Text is
    decoded and its white space collapsed. Unclosed elements end with their parent, a
    paragraph at the next block; what comes behind a cut tag is text.
    """

    def __init__(self, html: str, by_name: bool = True):
        self.parents: list[int] = []
        self.steps: list[str] = []
        self.styles: list[int] = []
        self.blocks: list[tuple[int, str, bool]] = []
        self._read(html, by_name)

    def _open(self, parent: int, step: str) -> int:
        self.parents.append(parent)
        self.steps.append(step)
        self.styles.append(_digest(str(self.styles[parent]) if parent >= 0 else "", step))
        return len(self.steps) - 1

    def _read(self, html: str, by_name: bool) -> None:
        # of open elements: (tag, element or -1 of an inline one, noisy, article); places of the block elements there
        stack: list[tuple[str, int, bool, bool]] = []
        solid: list[int] = []
        opened: Counter = Counter()
        parts: list[str] = []
        at, noise, main, here = 0, 0, 0, -1
        last = html.rfind(">") + 1        # no tag ends behind it

        def flush() -> None:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                self.blocks.append((here, text, main > 0))

        def pop() -> None:
            nonlocal noise, main, here
            tag, element, noisy, is_main = stack[-1]
            if element >= 0:
                flush()
                solid.pop()
                here = self.parents[element]
            stack.pop()
            opened[tag] -= 1
            noise -= noisy
            main -= is_main

        def close(tags: set[str], stop: set[str]) -> None:
            if not any(opened[t] for t in tags):
                return
            for place in reversed(solid):
                if stack[place][0] in tags:
                    while len(stack) > place:
                        pop()
                    return
                if stack[place][0] in stop:
                    return

        while at < last:
            m = TOKEN.search(html, at, last)
            if m is None:
                break
            if not noise and m.start() > at:
                parts.append(entities.unescape(html[at:m.start()]))
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if m[0].startswith("<!--") and not m[0].endswith("-->") or m[0].startswith("<![CDATA[") and \
                        not m[0].endswith("]]>"):
                    end = html.find("-->" if m[0].startswith("<!--") else "]]>", m.start() + 4)
                    at = end + 3 if end >= 0 else len(html)
                continue
            if m[1] or m[4]:
                if opened[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                elif tag == "p" and not noise:
                    flush()
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag in VOID:
                if tag in ("br", "hr") and not noise:
                    parts.append(" ")
                continue
            attributes = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(m[3] or m[6] or "")}
            opened[tag] += 1
            if tag in INLINE:
                noisy = _noisy(tag, attributes, main > 0, by_name)
                stack.append((tag, -1, noisy, False))
                noise += noisy
                continue
            opened[tag] -= 1
            if not noise:
                flush()
            close({"p"}, SCOPE | {"td", "th", "li", "blockquote", "nav", "header", "footer", "aside", "form"})
            if tag in CLOSES:
                close(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
            is_main = tag in ("article", "main") or attributes.get("role", "").lower() == "main"
            noisy = _noisy(tag, attributes, main > 0 or is_main, by_name)
            is_main = is_main and not noise and not noisy
            here = self._open(here, ".".join([tag, *sorted(set(attributes.get("class", "").split()))]))
            solid.append(len(stack))
            stack.append((tag, here, noisy, is_main))
            opened[tag] += 1
            noise += noisy
            main += is_main
        if not noise and at < len(html):
            rest = re.split(r"<!--|<!\[CDATA\[", html[at:], maxsplit=1)[0]
            parts.append(entities.unescape(re.sub(r"<[/a-zA-Z!][^<>]*\Z", "", rest)))
        flush()

    def article(self) -> list[tuple[int, str]]:
        """(element, text) of the blocks of the article if the page marks one, else of all."""
        inside = [b for b in self.blocks if b[2]]
        return [(element, text) for element, text, _ in inside or self.blocks]

    def outside(self, gone: set[int]) -> list[str]:
        """Texts of the article outside elements of the styles in ``gone``."""
        out = []
        for style, parent in zip(self.styles, self.parents):
            out.append(style in gone or (parent >= 0 and out[parent]))
        return [text for element, text in self.article() if element < 0 or not out[element]]

    def nodes(self) -> Iterator[tuple[int, int, int]]:
        """(style, content, presentation) of every style above some text of the article."""
        below: dict[int, list] = {}       # of an element: texts and elements in it, in page order
        for element, text in self.article():
            what: int | str = text
            while element >= 0:
                known = element in below
                below.setdefault(element, []).append(what)
                if known:
                    break
                what, element = element, self.parents[element]
        digests: dict[int, tuple[str, str]] = {}
        by_style: dict[int, list[tuple[str, str]]] = {}
        for element in sorted(below, reverse=True):     # children come behind their parents
            own = below[element]
            digests[element] = (
                str(_digest(*["#" + x if isinstance(x, str) else digests[x][0] for x in own])),
                str(_digest(*["#" if isinstance(x, str) else self.steps[x] + digests[x][1] for x in own])))
        for element in sorted(below):
            by_style.setdefault(self.styles[element], []).append(digests[element])
        for style, all_ in by_style.items():
            yield style, _digest(*[c for c, _ in all_]), _digest(*[s for _, s in all_])


def read_page(html: str | None) -> Page:
    """The page; if names leave no text of it, without regard to names."""
    page = Page(html or "")
    return page if page.blocks or not html else Page(html, False)


def _main(html: str | None) -> list[tuple[int, str]]:
    return read_page(html).article()


def _digest(*parts: str) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p.encode("utf-8", "surrogatepass") + b"\0")
    return int.from_bytes(h.digest(), "big", signed=True)


def style_tree(pages: DataFrame, presentation: float = PRESENTATION) -> DataFrame:
    """host, node, pages, importance of the style nodes of every host. Runs a job
    when called: pages are parsed once, their nodes go to the shared folder."""
    def parse(batches):
        for batch in batches:
            rows = []
            for host, page in zip(batch["host"], batch["html"]):
                read = read_page(page)
                whole = _digest(*[t for _, t in read.article()])
                rows.extend((host, node, whole, content, shape) for node, content, shape in read.nodes())
            yield pd.DataFrame(rows, columns=["host", "node", "whole", "content", "shape"])

    rows = _hosted(pages).select("host", "html").mapInPandas(
        parse, "host string, node long, whole long, content long, shape long")
    once = checkpointed(rows.groupBy("host", "node", "whole").agg(
        F.min("content").alias("content"), F.min("shape").alias("shape")))

    def entropy(kind: str) -> DataFrame:
        counts = once.groupBy("host", "node", kind).agg(F.count(F.lit(1)).alias("c"))
        return counts.groupBy("host", "node").agg(
            F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("s")).select(
            "host", "node", "pages", F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages"))
                                            / F.log("pages")).otherwise(1.0).alias(kind))
    both = entropy("content").join(entropy("shape").drop("pages"), ["host", "node"])
    return both.select("host", "node", "pages", (
        (1 - F.lit(presentation)) * F.col("content") + F.lit(presentation) * F.col("shape")).alias("importance"))


def _hosted(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html"), F.lower(F.coalesce(
        F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW,
            salts: int = SALTS) -> DataFrame:
    """page_id, url and the main text of every row of ``pages`` (page_id, url, html).

    Null or empty pages, and pages without main text, give an empty text; a null
    url belongs to the host ''. Rows that repeat an id are all returned. Text is
    never cut; other columns are ignored.
    """
    poor = style_tree(pages).where((F.col("pages") >= min_pages) & (F.col("importance") <= low))
    # the low nodes of one host's tree; spread, as a host may have a third of all pages
    by_host = poor.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("poor")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def text(batches):
        for batch in batches:
            texts = []
            for page, gone in zip(batch["html"], batch["poor"]):
                gone = set() if gone is None else {int(x) for x in gone}
                texts.append(" ".join(read_page(page).outside(gone)))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    salted = _hosted(pages).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    rows = salted.join(by_host, ["host", "salt"], "left").select("page_id", "url", "html", "poor")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInPandas(text, f"page_id {kind}, url string, text string")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(read_table(spark, sf_dir, "pages"))
    return got.withColumn("n_chars", F.length("text").cast("long"))
