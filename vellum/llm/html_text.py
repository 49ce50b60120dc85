"""Main text of web pages by consensus of each host's pages.

Every page is parsed leniently into block elements. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are known
by their tags, roles and class names and left out. A class name counts if all its words say so
(``related-posts``, not ``related-work``); paragraphs and the like inside an article are left out as adverts
or comments only. A page's own main text are all its outermost article and main elements, else the innermost
container with all text outside of links. The page votes for the path of that container (of the one with
most text, where there are several). A path is the chain of tags with their first class, digits made alike.
Spark counts the votes per host, and each page is then extracted anew at its host's winning path together
with its own container, so text that only one of them holds is kept. The whole body as winner says nothing.

Text: character references are decoded, white space inside a block becomes one
space, blocks are joined by a line break in page order.

Defined cases: a null or empty page, and one without text, gives an empty text; a
null or odd address has the empty host; unclosed and crossing tags close as in a
browser, about; memory grows with the page, however deep it is; repeated rows are extracted alike (and vote each); ties of a vote
go to more text, then to the later path; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import slices, table

# Names of elements and of page parts.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split()
)
CONTAINERS = frozenset("html body main article section div center table tbody tr td".split())
LEFT_OUT = frozenset("head nav header footer aside form menu dialog noscript template button select option svg canvas video audio object iframe".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
    "footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion "
    "related search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget alert disclaimer teaser "
    "contentinfo complementary dialog".split()
)
REMARKS = frozenset("comment comments disqus".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising promo sponsor sponsored".split())
# Words that a name may have beside those above.
PLAIN = frozenset(
    "area article articles bar block blocks body bottom box button buttons content container div footer global header icons inner item items left "
    "link links list main mobile module outer page panel post posts primary right row secondary section site slot thread top unit up wrap wrapper "
    "message overlay form and".split()
)
# Elements that hold running text.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table tbody tr td th".split())
# An opening p closes an open p; these close an open one of their own kind or group.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
BROADCAST_HOSTS = 200_000
SALTS = 64

_TAG = re.compile(
    r"<(?:!--(?:.*?--!?>|.*)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>)", re.S
)
_NAMED = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
_CUT = re.compile(r"<[/!a-zA-Z][^<>]*$")  # a tag that the end of the page cuts


class Page:
    """Block elements of a page with their text."""

    def __init__(self, html: str) -> None:
        self.tags: list[str] = []
        self.labels: list[str] = []
        self.depths: list[int] = []
        self.main: list[bool] = []  # an article or main element, or in one
        self.parents: list[int] = []
        self.out: list[bool] = []  # left out, itself or by what it lies in
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters outside of links
        self._stack: list[int] = []
        self._inline: list[str] = []  # inline elements that are left out and still open
        self._links = 0
        self._text: list[str] = []
        self._free = 0
        self._open("html", "", False)
        self._parse(html)
        self._flush()

    def _open(self, tag: str, label: str, out: bool) -> None:
        parent = self._stack[-1] if self._stack else -1
        self.tags.append(tag)
        self.parents.append(parent)
        self.labels.append(tag + label)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
        self.main.append(tag in ("article", "main") or (parent >= 0 and self.main[parent]))
        self.out.append(out or (parent >= 0 and self.out[parent]))
        self._stack.append(len(self.tags) - 1)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1], text, self._free))
            self._text, self._free = [], 0

    def _say(self, text: str) -> None:
        if text and not self._inline and not self.out[self._stack[-1]]:
            text = unescape(text) if "&" in text else text
            self._text.append(text)
            if not self._links:
                self._free += len(text)

    def _close(self, tag: str) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            if self.tags[self._stack[depth]] == tag:
                del self._stack[depth:]
                return

    def _shut(self, kinds: set[str]) -> None:
        """Close open elements of these kinds at the end of the stack, up to the next container."""
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[depth]]
            if tag in kinds:
                del self._stack[depth:]
            elif tag in CONTAINERS or tag in ("ul", "ol", "dl"):
                return

    def _parse(self, html: str) -> None:
        at, find = 0, _TAG.search
        while m := find(html, at):
            self._say(html[at : m.start()])
            at = m.end()
            end, tag, given = m.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if self._inline and tag not in BLOCKS:
                if end and tag == self._inline[-1]:
                    self._inline.pop()
                elif not end and tag == self._inline[-1]:
                    self._inline.append(tag)
                if tag not in RAW or end:
                    continue
            if end:
                if tag in BLOCKS:
                    self._flush()
                    self._inline.clear()
                    self._close(tag)
                    self._links = 0
                elif tag == "a":
                    self._links = 0
                continue
            if tag in RAW and not given.rstrip().endswith("/"):
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = close.end() if close else len(html)
                continue
            if tag == "br":
                self._say("\n")
                continue
            label, said = self._named(given) if "=" in given else ("", set())
            if tag in ("html", "body"):
                out = False
            elif tag in ("article", "main"):
                out = bool(said & REMARKS)
            elif tag in RUNNING and self.main[self._stack[-1]]:
                out = bool(said & (REMARKS | ADVERTS))
            else:
                out = tag in LEFT_OUT or bool(said)
            if tag in BLOCKS:
                self._flush()
                self._inline.clear()
                self._links = 0
                if tag == "html":
                    continue
                self._shut({"p"} | CLOSES.get(tag, set()))
                if tag not in VOID:
                    self._open(tag, label, out)
            elif out and tag not in VOID and not given.rstrip().endswith("/"):
                self._inline.append(tag)
            elif tag == "a":
                self._links = 1
        self._say(_CUT.sub("", html[at:]))

    @staticmethod
    def _named(given: str) -> tuple[str, set[str]]:
        """The first class with digits made alike, and what the names say of the element: words of ``NOT_TEXT``."""
        label, said = "", set()
        for m in _NAMED.finditer(given):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "class" and value.split():
                label = "." + _DIGITS.sub("#", value.split()[0]).replace(">", "")
            for name in value.split():
                words = {x.lower() for x in _PIECES.findall(name)}
                if words <= NOT_TEXT | PLAIN:
                    said |= words & NOT_TEXT
        return label, said

    def scores(self) -> list[int]:
        score = [0] * len(self.tags)
        for node, _, free in self.blocks:
            score[node] += free
        for node in range(len(self.tags) - 1, 0, -1):
            score[self.parents[node]] += score[node]
        return score

    def best(self) -> list[int]:
        """The outermost article and main elements with text, that with most first; else the innermost container with all text."""
        score = self.scores()
        whole = [0] * len(self.tags)
        for node, text, _ in self.blocks:
            whole[node] += len(text)
        for node in range(len(self.tags) - 1, 0, -1):
            whole[self.parents[node]] += whole[node]
        named = [n for n in range(1, len(self.tags)) if whole[n] and self.main[n] and not self.main[self.parents[n]]]
        if named:
            return sorted(named, key=lambda n: (-score[n], n))
        inside = [-1] * len(self.tags)  # of each element the container in it with all of its text
        for node in range(1, len(self.tags)):
            parent = self.parents[node]
            if self.tags[node] in CONTAINERS and score[node] and score[node] == score[parent]:
                inside[parent] = node
        node = 0
        while inside[node] >= 0:
            node = inside[node]
        return [node]

    def path(self, node: int) -> str:
        labels = []
        while node >= 0:
            labels.append(self.labels[node])
            node = self.parents[node]
        return ">".join(reversed(labels))

    def at(self, path: str) -> set[int]:
        """The elements with a path."""
        labels = path.split(">")
        on = [False] * len(self.tags)
        for node, (label, depth) in enumerate(zip(self.labels, self.depths, strict=True)):
            on[node] = depth < len(labels) and label == labels[depth] and (node == 0 or on[self.parents[node]])
        return {n for n, here in enumerate(on) if here and self.depths[n] == len(labels) - 1}

    def text(self, path: str | None) -> str:
        """Text of the page's own best containers and of those with this path, unless that is the whole body."""
        nodes = set(self.best())
        if path is not None and path.count(">") > 1:
            nodes |= self.at(path)
        within = [False] * len(self.tags)
        for node in range(len(self.tags)):
            within[node] = node in nodes or (node > 0 and within[self.parents[node]])
        return "\n".join(text for node, text, _ in self.blocks if within[node])


def host_of(url: Column) -> Column:
    whole = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(whole, r"^www\.", "")


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, pages, chars``: how many pages of a host have their text at a path."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "html"):
            found: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
            for host, html in zip(some.column("host").to_pylist(), some.column("html").to_pylist(), strict=True):
                page = Page(html or "")
                node = page.best()[0]
                if page.blocks:
                    count = found[host, page.path(node)]
                    count[0] += 1
                    count[1] += page.scores()[node]
            yield pa.RecordBatch.from_pydict(
                {
                    "host": pa.array([h for h, _ in found], pa.string()),
                    "path": pa.array([p for _, p in found], pa.string()),
                    "pages": pa.array([n for n, _ in found.values()], pa.int64()),
                    "chars": pa.array([n for _, n in found.values()], pa.int64()),
                }
            )

    slim = pages.select(host_of(F.col("url")).alias("host"), "html")
    return (
        slim.mapInArrow(work, "host string, path string, pages bigint, chars bigint")
        .groupBy("host", "path")
        .agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"))
    )


def winners(counted: DataFrame) -> DataFrame:
    return counted.groupBy("host").agg(F.max_by("path", F.struct("pages", "chars", "path")).alias("path"))


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "html"):
            texts = [Page(h or "").text(p) for h, p in zip(some.column("html").to_pylist(), some.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    won = table(winners(votes(rows)), "host-paths")
    hosted = rows.withColumn("host", host_of(F.col("url")))
    if won.count() <= BROADCAST_HOSTS:  # a few MB of short texts
        joined = hosted.join(F.broadcast(won), "host", "left")
    else:  # the pages of a large host go to many tasks
        salted = won.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hosted.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint")
