"""Main text of web pages: page structure first, then site templates.

A tolerant parser turns a page into runs of text, each with the hashes of the element subtrees
that hold it. Elements that say what they are (menus, forms, adverts, comments) go by rule. What a
site repeats without saying so goes by count: subtree hashes are counted per host over pages whose
main text differs, and a subtree on most of a host's pages is part of its template.

Pages are parsed twice, once to count subtrees and once to write the text: only hashes are written
or shuffled in between, never text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import arrow_map, column, cut, prepare, texts

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt td th tr".split()
)
SCOPE = frozenset("html body article section div main td th table aside blockquote".split())
#: A start tag of the key ends an open element of the value, up to the nearest of the listed holders.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Elements that are never main text.
DROPPED = RAW | frozenset("head nav footer aside svg canvas template select button dialog menu object audio video datalist map".split())
#: Words of class and id attributes that name such elements.
NAMES = frozenset(
    "ad ads adbox adsbygoogle advert advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Words that may stand beside those of NAMES without changing what the element is, as in site-nav or comment-list.
PARTS = frozenset(
    "site page main primary secondary global local top bottom left right header head foot side box block bar list links link items item area section container wrapper wrap inner outer content row col column slot unit form thread post posts article articles story stories user reader text buttons button icons media mobile desktop sticky fixed small large the and".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CONTENT = frozenset(("article", "main"))
#: Whether an element is kept, goes unless it holds the page's content, or goes always.
KEPT, NAMED, GONE = range(3)
#: Characters of a block from which it counts as prose when a body is weighed against the articles in it, and
#: how many times their prose it takes for the articles to be teasers.
PROSE, OUTWEIGHS = 80, 2

#: A subtree is a template's if it is on so many pages of different text, and on this share of its host's.
LEAST_PAGES = 10
LEAST_SHARE = 0.5
#: Subtrees of all hosts' templates up to which they are broadcast (8 bytes each); beyond it pages are shuffled by host.
BROADCAST = 1_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
_RAW_END = {tag: re.compile(f"</{tag}(?![^\\s/>])", re.IGNORECASE) for tag in RAW}


def is_name(token: str) -> bool:
    """Whether one class or id names an element that is no main text: by all of its words, so that has-sidebar doesn't."""
    if token.lower() in NAMES:
        return True
    words = [w.lower() for w in _WORD.findall(token)]
    return not NAMES.isdisjoint(words) and all(w in NAMES or w in PARTS or w.isdigit() for w in words)


@lru_cache(1 << 16)
def by_attributes(attributes: str) -> tuple[int, bool]:
    """What an element's attributes say of it: KEPT, NAMED or GONE, and whether it is the page's content."""
    verdict, content = KEPT, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value.lower()):
            return GONE, False
        if name == "role" and value.lower() in ROLES or name in ("class", "id") and any(map(is_name, value.split())):
            verdict = NAMED
        content |= name == "role" and value.lower() == "main" or name == "itemprop" and value.lower() == "articlebody"
    return verdict, content


class Page:
    """A parsed page: ``runs`` of (block, text, hashes of the subtrees around it, innermost first)."""

    def __init__(self, source: str):
        self.tags: list[str] = []
        self.parent: list[int] = []
        self.verdict: list[int] = []
        self.content: list[bool] = []
        self.parts: list[list[bytes]] = []
        self.hash: list[int] = []
        self.stack: list[int] = []
        self.block = 0
        self.raw_runs: list[tuple[int, str, int]] = []
        self._read(source)
        while self.stack:
            self._close()
        self.inside = self._choose()
        self.runs = [(block, text, self._path(k)) for block, text, k in self.inside]

    def _choose(self) -> list[tuple[int, str, int]]:
        """The runs of the main text."""
        n = range(len(self.tags))
        gone, named = [False] * len(n), [False] * len(n)
        for k in n:  # parents come first
            up = self.parent[k]
            gone[k] = self.verdict[k] == GONE or up >= 0 and gone[up]
            named[k] = self.verdict[k] == NAMED or up >= 0 and named[up]
        content = [k for k in n if self.content[k] and not gone[k]]
        if content and all(named[k] for k in content) and self._prose([r for r in self.raw_runs if not gone[r[2]] and not named[r[2]]], PROSE) <= OUTWEIGHS * self._prose(self._under([k for k in content if self.verdict[k] == KEPT], gone), 1):
            # What holds all of the page's content isn't what its name says.
            for k in content:
                while self.verdict[k] == KEPT and (k := self.parent[k]) >= 0:
                    if self.verdict[k] == NAMED:
                        self.verdict[k] = KEPT
            for k in n:
                up = self.parent[k]
                named[k] = self.verdict[k] == NAMED or up >= 0 and named[up]
        visible = [r for r in self.raw_runs if not gone[r[2]] and not named[r[2]]]
        holder = {k: self.tags[k] != "article" for k in content if not named[k]}
        if not holder:
            return self._headless(visible, {})
        # The nearest holder of each element, main elements before articles.
        within = [0] * len(n)
        for k in n:
            up = within[self.parent[k]] if self.parent[k] >= 0 else 0
            within[k] = max(up, 2 if holder.get(k) else 1 if k in holder else 0)
        main = [r for r in visible if within[r[2]] == 2]
        if any(text.strip() for _, text, _ in main):
            return main
        articles = [r for r in visible if within[r[2]]]
        rest = self._headless([r for r in visible if not within[r[2]]], {})
        return articles if self._prose(rest, PROSE) <= OUTWEIGHS * self._prose(articles, 1) else self._headless(visible, holder)

    def _under(self, roots: list[int], gone: list[bool]) -> list[tuple[int, str, int]]:
        """Runs in elements of ``roots`` that aren't gone."""
        under = [False] * len(self.tags)
        for k in roots:
            under[k] = True
        for k, up in enumerate(self.parent):
            under[k] = under[k] or up >= 0 and under[up]
        return [r for r in self.raw_runs if under[r[2]] and not gone[r[2]]]

    def _headless(self, runs: list[tuple[int, str, int]], holder: dict[int, bool]) -> list[tuple[int, str, int]]:
        """Runs that are in no header, but for headers within a holder of content."""
        head = [False] * len(self.tags)
        for k, tag in enumerate(self.tags):
            up = self.parent[k]
            head[k] = k not in holder and (tag == "header" or up >= 0 and head[up])
        return [r for r in runs if not head[r[2]]]

    def _prose(self, runs: list[tuple[int, str, int]], least: int) -> int:
        """Characters, outside links, of blocks that have ``least`` of them."""
        blocks: dict[int, int] = {}
        for block, text, k in runs:
            while k >= 0 and self.tags[k] in INLINE and self.tags[k] != "a":
                k = self.parent[k]
            if k < 0 or self.tags[k] != "a":
                blocks[block] = blocks.get(block, 0) + len(text.strip())
        return sum(x for x in blocks.values() if x >= least)

    def _path(self, k: int) -> list[int]:
        out = []
        while k >= 0 and self.tags[k] not in ("body", "html") and self.tags[k] not in CONTENT:
            out.append(self.hash[k])
            k = self.parent[k]
        return out

    def _open(self, tag: str, attributes: str) -> None:
        verdict, content = by_attributes(attributes) if attributes and not attributes.isspace() else (KEPT, False)
        if tag in DROPPED:
            verdict = GONE
        elif verdict == NAMED and tag in ("html", "body", "main"):
            verdict = KEPT
        elif tag == "form" and verdict == KEPT:
            verdict = NAMED
        self.tags.append(tag)
        self.parent.append(self.stack[-1] if self.stack else -1)
        self.verdict.append(verdict)
        self.content.append(content or tag in CONTENT)
        self.parts.append([tag.encode()])
        self.hash.append(0)
        self.stack.append(len(self.tags) - 1)

    def _close(self) -> None:
        k = self.stack.pop()
        self.hash[k] = xxhash.xxh64_intdigest(b"\0".join(self.parts[k])) >> 1
        if self.stack:
            self.parts[self.stack[-1]].append(self.hash[k].to_bytes(8, "little"))
        self.parts[k] = []

    def _close_to(self, names: frozenset | set, holders: frozenset | set) -> None:
        """Close the innermost open element of ``names`` that stands within the nearest of ``holders``."""
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.tags[self.stack[at]]
            if tag in names:
                while len(self.stack) > at:
                    self._close()
                return
            if tag in holders:
                return

    def _text(self, text: str) -> None:
        if not text:
            return
        if not self.stack:
            self._open("body", "")
        k = self.stack[-1]
        if "&" in text:
            text = html.unescape(text)
        plain = text.split()
        if plain:
            self.parts[k].append(" ".join(plain).encode("utf-8", "replace"))
        if self.verdict[k] != GONE:
            self.raw_runs.append((self.block, text, k))

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            if not m:
                self._text(source[at:])
                return
            self._text(source[at : m.start()])
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                if tag not in INLINE:
                    self.block += 1
                self._close_to({tag}, frozenset() if tag not in INLINE else SCOPE)
                continue
            tag = (m[2] or m[4] or "").lower()
            if not tag:
                continue
            attributes = m[3] or m[5] or ""
            if tag == "br":
                self._text(" ")
                continue
            if tag not in INLINE:
                self.block += 1
            if tag in VOID:
                continue
            if tag in ENDS_P:
                self._close_to({"p"}, SCOPE)
            if tag in IMPLIED:
                self._close_to(*IMPLIED[tag])
            self._open(tag, attributes)
            if tag in RAW:
                end = _RAW_END[tag].search(source, at)
                end = end.start() if end else size
                self.parts[self.stack[-1]].append(source[at:end].encode("utf-8", "replace"))
                at = end
            elif attributes.endswith("/") and tag in ("svg", "path"):
                self._close()


def joined(runs: list[tuple[int, str]]) -> str:
    """Blocks of runs in page order: white space inside a block becomes one space, blocks are lines."""
    blocks: dict[int, list[str]] = {}
    for block, text in runs:
        blocks.setdefault(block, []).append(text)
    return "\n".join(x for x in (" ".join("".join(parts).split()) for parts in blocks.values()) if x)


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; empty where it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[^:/?#]+:)?//(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#\s]*)", 1)), F.lit(""))


def _count_maker():
    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                signature, subtrees = [], []
                for source in texts(b, "html"):
                    found = Page(source.decode("utf-8", "replace")).runs
                    signature.append(xxhash.xxh64_intdigest(joined([(k, t) for k, t, _ in found]).encode("utf-8", "replace")) >> 1)
                    subtrees.append(list({h for _, _, p in found for h in p}))
                yield {"host": column(b, "host"), "signature": signature, "subtrees": subtrees}

        return run

    return make


def _text_maker():
    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                out = []
                for source, template in zip(texts(b, "html"), column(b, "template").to_pylist(), strict=True):
                    gone = set(template or ())
                    out.append(joined([(block, text) for block, text, path in Page(source.decode("utf-8", "replace")).runs if gone.isdisjoint(path)]))
                yield {"page_id": column(b, "page_id"), "url": column(b, "url"), "text": out, "n_chars": [len(t) for t in out]}

        return run

    return make


def templates(pages: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    """(host, template): hashes of each host's template subtrees, for ``pages`` (host as a hash, html).

    A template's subtree is on a share of the host's pages, so a host has no more of them than a
    page has subtrees, divided by that share.
    """
    parsed = cut(arrow_map(pages, _count_maker(), "host long, signature long, subtrees array<bigint>"), "subtrees")
    total = parsed.select("host", "signature").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    each = parsed.select("host", F.explode("subtrees").alias("subtree"), "signature").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    found = each.join(total, "host").where(F.col("n") >= least_share * F.col("pages"))
    return cut(found.groupBy("host").agg(F.collect_list("subtree").alias("template")), "templates")


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, broadcast: int = BROADCAST) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page.

    The main text is that of a page's main elements, else of its articles, else of its body; and of
    its body too where that has far more prose than the articles, which then are teasers. Elements
    that are by tag, name, role or style menus, headers, footers, sidebars, notices, adverts, forms,
    comments, code or hidden don't belong to it, unless all of the page's main elements or articles
    are in those that a name or role marks. Nor do subtrees of the site's template. Pages of the
    same main text count once towards a template; pages without a host have none. Null html gives
    an empty text; repeated rows stay repeated. An empty table gives no rows.
    """
    prepare(df.sparkSession)
    url = F.col(f"`{url_col}`").cast("string")
    pages = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"), F.when(host_of(url) != "", F.xxhash64(host_of(url))).alias("host"))
    sites = templates(pages.where(F.col("host").isNotNull()).select("host", "html"), least_pages, least_share)
    size = sites.agg(F.sum(F.size("template"))).first()[0] or 0
    marked = pages.join(F.broadcast(sites) if size <= broadcast else sites.hint("merge"), "host", "left")
    return arrow_map(marked.select("page_id", "url", "html", "template"), _text_maker(), "page_id long, url string, text string, n_chars long")
