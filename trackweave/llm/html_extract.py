"""Main text of web pages with a site style tree.

Pages of one host are merged into a tree whose nodes are paths of block elements
(tag, classes and id). For every node two entropies over the pages that have it
are computed, to the base of their number: of its presentation styles (its
sequence of child elements) and of its contents. A node that looks and reads the
same everywhere has importance near 0, one that differs everywhere near 1; on
fewer than ``MIN_PAGES`` pages nothing can be said and it counts as important.
Branches below ``RATIO`` times the importance of the host's body are removed
from each page. Elements whose tag or class says what they are (menus, forms,
adverts, comments, ...) have importance 0; names of inline elements and headings say
nothing, and in or around an article only whole names or strong words do. Inside an ``article`` or ``main`` the
tree decides as it does elsewhere, but over pages whose articles differ, so copies
of one article on a host do not remove each other.

What is left of the page's articles (else of ``main``, else of the body) is its
text: character references decoded, white space inside a block turned into one
space, blocks joined by line breaks.

Statistics combine before the shuffle. What goes back to the pages is one list of
removed paths per host; it is broadcast if it is small, else joined by host.

Edge cases: a null or empty page has an empty text, as has one without an
article's text. A null or strange url has no host and no style tree. Repeated
pages count and come back. Broken markup is read as browsers mostly do: unknown
end tags are ignored, paragraphs and list items close each other, unclosed
elements end with the page, a tag that never ends is dropped if no other follows and
else is text. Reading takes time linear in the page, also of such tags and quotes.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import store

MIN_PAGES = 5
RATIO = 0.3
STYLE_SHARE = 0.3
# Removed paths (8 bytes each) that may be broadcast.
BROADCAST_PATHS = 1_000_000

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|(!--)|[!?/])")
_EVENT = re.compile(r"[>\"']")
_ANGLE = re.compile(r"[<>]")
_MARKS = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var br wbr img".split()
)
# Elements and class names that are not part of an article.
NOISE_TAGS = frozenset(
    "head script style nav header footer aside form button select textarea noscript iframe template svg dialog "
    "menu fieldset object canvas title noembed noframes".split()
)
NOISE_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notification "
    "newsletter subscribe subscription share sharing social comment comments reply replies respond disqus related "
    "recommended popup modal overlay widget login signup search toolbar pagination skip".split()
)
# Those that also count as a part of a longer name, wherever they are.
STRONG_MARKS = frozenset("ad ads advert adverts advertisement comments disqus newsletter".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROOTS = ("article", "main")


class Tags:
    """Tags of a source, found from left to right in time linear in its length.

    A tag ends at the first ``>`` outside quotes. Where that search has failed once it
    is not tried again: every quote is followed at most once, and places before the
    next quote or end share it.
    """

    def __init__(self, source: str):
        self.source = source
        self.event: tuple[int, int] = (0, -1)  # the next event of all places in this range
        self.followed: set[int] = set()

    def end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; -1 if never."""
        low, high = self.event
        if not low <= at <= high:
            found = _EVENT.search(self.source, at)
            self.event = low, high = at, found.start() if found else len(self.source)
        while high < len(self.source):
            if self.source[high] == ">":
                return high
            if high in self.followed:
                return -1
            self.followed.add(high)
            close = self.source.find(self.source[high], high + 1)
            found = _EVENT.search(self.source, close + 1) if close >= 0 else None
            high = found.start() if found else len(self.source)
        return -1

    def after(self, at: int) -> tuple[int, int, str, str, str]:
        """The next tag, comment or declaration: start, end, "/" of an end tag, name and attributes."""
        source, size = self.source, len(self.source)
        while opened := _OPEN.search(source, at):
            start, at = opened.span()
            if opened[2] and (end := self.end(at)) >= 0:
                return start, end + 1, opened[1], opened[2].lower(), source[at:end]
            if not opened[2] or opened[1]:
                close = "-->" if opened[3] else ">"
                end = source.find(close, at)
                return start, end + len(close) if end >= 0 else size, "", "", ""
            if not _ANGLE.search(source, at):
                return start, size, "", "", ""
        return size, size, "", "", ""


def _names(attributes: str) -> tuple[str, ...]:
    """Class, id and role names, in lower case, their words (of letters) joined by hyphens."""
    values = [next(filter(None, m[1:]), "") for m in _MARKS.findall(attributes)]
    names = re.sub("([a-z])([A-Z])", r"\1-\2", " ".join(values)).lower().split()
    return tuple(name for n in names if (name := "-".join(re.findall("[a-z]+", n))))


def _noisy(tag: str, names: tuple[str, ...], content: bool) -> bool:
    """Whether names say that an element is no part of an article. Those of a heading say
    nothing; in an article or main, or around one (``content``), only whole names do, or
    strong words of longer ones, and ``header`` may be an article's own."""
    if tag in HEADINGS or tag in ("html", "body"):
        return False
    for name in names:
        if name in NOISE_MARKS and not (content and name == "header"):
            return True
        if not (STRONG_MARKS if content else NOISE_MARKS).isdisjoint(name.split("-")):
            return True
    return False


class Page:
    """Elements of a page and its texts, in order.

    ``nodes`` has (parent, tag, marks) per block element; ``parts`` has (node,
    text) and (node, None) at block boundaries.
    """

    def __init__(self, source: str):
        self.nodes: list[tuple[int, str, tuple[str, ...]]] = [(-1, "", ())]
        self.parts: list[tuple[int, str | None]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        nodes, parts = self.nodes, self.parts
        open_: list[tuple[str, int]] = [("", 0)]  # tag and node of open elements
        counts: Counter[str] = Counter()  # of open elements
        at, end = 0, len(source)

        def pop_to(depth: int) -> None:
            while len(open_) > depth:
                tag, node = open_.pop()
                counts[tag] -= 1
                if tag not in INLINE:
                    parts.append((node, None))

        def find(tags: tuple[str, ...], until: tuple[str, ...]) -> int:
            if any(counts[t] for t in tags):
                for depth in range(len(open_) - 1, 0, -1):
                    if open_[depth][0] in tags:
                        return depth
                    if open_[depth][0] in until:
                        break
            return 0

        tags = Tags(source)
        while at < end:
            stop, next_, closing, tag, attributes = tags.after(at)
            if stop > at:
                parts.append((open_[-1][1], source[at:stop]))
            at = next_
            if not tag:
                continue
            if closing:
                depth = find((tag,), ())
                if depth:
                    pop_to(depth)
                elif tag == "p":
                    parts.append((open_[-1][1], None))
                continue
            if tag in VOID:
                parts.append((open_[-1][1], " " if tag in INLINE else None))
                continue
            if tag in INLINE:
                counts[tag] += 1
                open_.append((tag, open_[-1][1]))
                continue
            if depth := find(("p",), ("table", "button", "div", "section", "article", "aside", "form", "td")):
                pop_to(depth)
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                if depth := find(same, ("ul", "ol", "dl", "table", "select")):
                    pop_to(depth)
            counts[tag] += 1
            parts.append((open_[-1][1], None))
            nodes.append((open_[-1][1], tag, _names(attributes)))
            open_.append((tag, len(nodes) - 1))
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                at = close.start() if close else end
        pop_to(1)

    def paths(self) -> list[int]:
        """A 64-bit hash of the path of every node."""
        out: list[int] = []
        for parent, tag, marks in self.nodes:
            above = out[parent] if parent >= 0 else 0
            out.append(xxhash.xxh64_intdigest(f"{above}/{tag}.{'.'.join(marks)}") - 2**63)
        return out

    def flags(self, removed: frozenset[int] | set[int]) -> tuple[list[bool], list[str]]:
        """Per node: whether it is cut out, and the root (article, main or none) it is in."""
        cut: list[bool] = []
        root: list[str] = []
        holds = [False] * len(self.nodes)
        for number in range(len(self.nodes) - 1, 0, -1):
            parent, tag, _ = self.nodes[number]
            holds[number] |= tag in ROOTS
            holds[parent] |= holds[number]
        paths = self.paths() if removed else []
        for number, (parent, tag, marks) in enumerate(self.nodes):
            above = cut[parent] if parent >= 0 else False
            inside = root[parent] if parent >= 0 else ""
            noise = tag in NOISE_TAGS and not (tag == "header" and inside == "article")
            noise = noise or _noisy(tag, marks, bool(inside) or holds[number])
            cut.append(above or noise or bool(removed) and tag not in ROOTS and paths[number] in removed)
            root.append("article" if "article" in (tag, inside) else tag if tag in ROOTS else inside)
        return cut, root

    def text(self, removed: frozenset[int] | set[int]) -> str:
        cut, root = self.flags(removed)
        kept = {r for node, part in self.parts if part and part.strip() and not cut[node] for r in (root[node],)}
        wanted = next((r for r in ROOTS if r in kept), None)
        blocks, block = [], []
        for node, part in [*self.parts, (0, None)]:
            if part is None:
                line = " ".join(html.unescape("".join(block)).split())
                if line:
                    blocks.append(line)
                block = []
            elif not cut[node] and (wanted is None or root[node] == wanted or (wanted == "main" and root[node] == "article")):
                block.append(part)
        return "\n".join(blocks)

    def statistics(self) -> Iterator[tuple[int, bool, int, int, int | None]]:
        """(path, is body, style, content, article) of every path: digests over its nodes,
        and for those inside an article or main over all of these of the page."""
        n = len(self.nodes)
        styles, contents = [[] for _ in range(n)], [[] for _ in range(n)]
        for node, part in self.parts:
            if part and part.strip():
                contents[node].append(" ".join(part.split()))
        paths = self.paths()
        digests = [0] * n
        for node in range(n - 1, -1, -1):
            parent, tag, marks = self.nodes[node]
            digests[node] = xxhash.xxh64_intdigest("\n".join(contents[node]))
            if parent >= 0:
                styles[parent].append(f"{tag}.{'.'.join(marks)}")
                contents[parent].append(str(digests[node]))
        _, root = self.flags(frozenset())
        tops = [k for k in range(1, n) if root[k] and not root[self.nodes[k][0]]]
        article = xxhash.xxh64_intdigest("\n".join(str(digests[k]) for k in tops)) - 2**63
        joined: dict[int, tuple[bool, list[str], list[str]]] = {}
        inside: dict[int, bool] = {}
        for node in range(1, n):
            body, style, content = joined.setdefault(paths[node], (self.nodes[node][1] == "body", [], []))
            style += styles[node]
            content.append(str(digests[node]))
            inside[paths[node]] = bool(root[node])
        for path, (body, style, content) in joined.items():
            digests_ = (xxhash.xxh64_intdigest("\n".join(each)) - 2**63 for each in (style, content))
            yield path, body, *digests_, article if inside[path] else None


def _host():
    return F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, importance, pages, body of every node of every host."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                hosts, out = rows.column("host").to_pylist(), []
                for host, source in zip(hosts, rows.column("html").to_pylist()):
                    out += [(host, *node) for node in Page(source or "").statistics()]
                columns = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 3))],
                    names=["host", "path", "body", "style", "content", "article"],
                )

    every = store(
        pages.select(_host().alias("host"), "html")
        .filter("host != ''")
        .mapInArrow(work, "host string, path long, body boolean, style long, content long, article long")
    )
    # Pages with the same article count once for what is inside it.
    found = every.filter("article is null").unionByName(every.filter("article is not null").distinct())

    def entropy(column: str) -> DataFrame:
        counts = found.groupBy("host", "path", column).agg(F.count("*").cast("double").alias("n"), F.max("body").alias("body"))
        sums = counts.groupBy("host", "path").agg(
            F.sum("n").alias("pages"), F.sum(F.col("n") * F.log2("n")).alias("inner"), F.max("body").alias("body")
        )
        value = (F.log2("pages") - F.col("inner") / F.col("pages")) / F.log2("pages")
        return sums.select("host", "path", "pages", "body", F.when(F.col("pages") > 1, value).otherwise(1.0).alias(column))

    both = entropy("style").join(entropy("content").drop("pages", "body"), ["host", "path"])
    importance = STYLE_SHARE * F.col("style") + (1 - STYLE_SHARE) * F.col("content")
    return both.select("host", "path", importance.alias("importance"), "pages", "body")


def removed_paths(tree: DataFrame) -> DataFrame:
    """host, paths: the branches to remove from the pages of a host."""
    bodies = tree.filter("body").groupBy("host").agg(F.max("importance").alias("of_body"))
    low = (F.col("pages") >= MIN_PAGES) & (F.col("importance") < RATIO * F.col("of_body"))
    return tree.filter(~F.col("body")).join(bodies, "host").filter(low).select("host", "path")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    low = store(removed_paths(store(style_tree(pages))))
    lists = low.groupBy("host").agg(F.collect_set("path").alias("paths"))
    if low.count() <= BROADCAST_PATHS:
        lists = F.broadcast(lists)
    rows = pages.select("page_id", "url", "html", _host().alias("host")).join(lists, "host", "left")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [
                    Page(source or "").text(frozenset(paths or ()))
                    for source, paths in zip(part.column("html").to_pylist(), part.column("paths").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        part.column("url"),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return rows.select("page_id", "url", "html", "paths").mapInArrow(
        work, f"page_id {kinds['page_id']}, url string, text string, n_chars long"
    )
