"""Main text of web pages with a site style tree.

Pages of a host are merged into one tree: a node is a path of tags with their classes;
it carries the presentation styles (sequences of child tags) and the contents that the
host's distinct pages show there.  The importance of a page's branch is

    PRESENTATION * H(styles of its node) + (1 - PRESENTATION) * (1 - log(n) / log(m))

where H is the styles' entropy over m pages in units of log m, and n of the m pages
show the same content there: varied places count much, what a site repeats counts
little.  Pages with the same main text count once, so a host's copies of one article
do not make it look like a frame, while a line that stands in nearly all its articles
does.  Branches under ``LEAST`` are removed, and paragraphs, headings, list items and
the like of an explicit article under ``LEAST_INSIDE``, on hosts with ``PAGES`` distinct
main texts or more; with fewer there is nothing to compare.  Elements that by their
kind never hold an article (menus, headers and footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments, by tag, role or class) are removed on any host.

If a page has ``article`` or ``main`` elements, only those hold its text, else its body
does.  Character references are decoded, white space inside a block becomes one space
(a line break counts as white space), blocks are joined by one newline.

Defined cases: null and empty html give ""; a null or odd URL belongs to a host "";
pages with the same main text count once in a host's statistics; repeated rows each get their row; an
empty table gives an empty result; other columns play no part.  Unclosed elements end
where HTML ends them, unclosed comments and scripts at the end of the page.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded, cut
from .frames import map_arrow, narrow
from .urls import parts

PAGES, LEAST, LEAST_INSIDE, PRESENTATION = 5, 0.35, 0.15, 0.1
#: Entries of pages' lists of removed contents that may be broadcast; beyond them the join shuffles.
MARKS = 1_000_000

_NAME = r"[a-zA-Z][a-zA-Z0-9:-]*"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)({_NAME})((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)({_NAME})([^>]*)>|<[!?][^>]*>", re.S)
_CLASS = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "template")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("body html td th tr tbody thead tfoot li dd dt option optgroup".split())
_PROTECTED = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption table ul ol dl tr tbody thead figure".split())
#: Never part of an article: by tag, by role, by a word of class or id.
_NOISE_TAGS = frozenset("head nav footer aside form button select option input dialog menu svg canvas object audio video map fieldset".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments reply replies respond disqus discussion share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager skip".split())
_WORD = re.compile(r"[a-z]+")


def _attributes(text: str) -> tuple[bool, str]:
    """Whether classes, id or role mark noise, and the class as part of the node's name."""
    noise, name = False, ""
    for key, value in _CLASS.findall(text):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "class" or key == "id":
            noise |= not _NOISE_WORDS.isdisjoint(_WORD.findall(value))
            name = name or "." + value if key == "class" else name
        elif key == "role":
            noise |= value in _NOISE_ROLES
        else:
            noise |= key == "hidden" or value == "true"
    return noise, name


class Page:
    """Blocks and styles of a page.  A block is (node, text, holds: inside an article, protected)."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, str, bool, bool]] = []
        self.styles: dict[str, str] = {}
        self.explicit = False
        # element: tag, node, noise, inside an article, protected, tags of children
        self.stack: list[tuple[str, str, bool, bool, bool, list[str]]] = [("", "", False, False, False, [])]
        self.buffer: list[str] = []
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        search = _TOKEN.search
        while at < end:
            found = search(source, at)
            if found is None:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            closing, tag, rest = found.group(1, 2, 3)
            if tag is None:
                closing, tag, rest = found.group(4, 5, 6)
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                self._close(tag)
            elif tag in _RAW:
                stop = _RAW[tag].search(source, at)
                at = stop.end() if stop else end
            else:
                self._open(tag, rest)
        self._flush()
        while len(self.stack) > 1:
            self._pop()

    def _text(self, text: str) -> None:
        if not self.stack[-1][2]:
            self.buffer.append(text)

    def _flush(self) -> None:
        if not self.buffer:
            return
        text = "".join(self.buffer)
        self.buffer = []
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            _, node, noise, inside, protected, _ = self.stack[-1]
            if not noise:
                self.blocks.append((node, text, inside, protected))

    def _pop(self) -> None:
        tag, node, _, _, _, children = self.stack.pop()
        if tag in _BLOCK:
            self.styles[node] = " ".join(children)

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._text(" ")
            return
        depth = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] == tag), 0)
        if not depth:
            if tag in _BLOCK:
                self._flush()
            return
        if any(x[0] in _BLOCK for x in self.stack[depth:]):
            self._flush()
        while len(self.stack) > depth:
            self._pop()

    def _end(self, tags: frozenset[str], scope: frozenset[str]) -> None:
        """Close the innermost of ``tags``, unless an element of ``scope`` stands between."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i][0] in scope:
                return

    def _open(self, tag: str, rest: str) -> None:
        block = tag in _BLOCK
        if block:
            self._flush()
            if tag in _CLOSES_P:
                self._end(_P, _SCOPE)
            if tag in _SIBLINGS:
                self._end(*_SIBLINGS[tag])
        elif tag == "br":
            self._text(" ")
        _, node, noise, inside, protected, children = self.stack[-1]
        if not children or children[-1] != tag:
            children.append(tag)
        if tag in _VOID or rest.endswith("/") and tag not in _BLOCK:
            return
        bad, name = _attributes(rest) if rest else (False, "")
        if tag in ("body", "html", "article", "main") and not noise and tag != "article":
            bad = False
        noise = noise or bad or tag in _NOISE_TAGS or tag == "header" and not inside
        if tag in ("article", "main") and not noise:
            inside = self.explicit = True
        inner = node
        if block:
            inner = f"{node}/{tag}{name}"
            protected = inside and tag in _PROTECTED
        self.stack.append((tag, inner, noise, inside, protected, []))

    def kept(self) -> list[tuple[str, str, bool, bool]]:
        return [b for b in self.blocks if b[2]] if self.explicit else self.blocks


_P = frozenset(["p"])
_SCOPE = frozenset("button table td th article section div aside main body li blockquote".split())
_LISTS = frozenset("ul ol menu dl table body article".split())
_SIBLINGS = {
    "li": (frozenset(["li"]), _LISTS), "dd": (frozenset(["dd", "dt"]), _LISTS), "dt": (frozenset(["dd", "dt"]), _LISTS),
    "option": (frozenset(["option"]), frozenset(["select"])), "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody"]), frozenset(["table"])), "tfoot": (frozenset(["tbody", "thead"]), frozenset(["table"])),
}


def _key(*parts_: str) -> int:
    """A 64-bit digest."""
    data = "\0".join(parts_).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page the key of its main text, and its nodes: (node, is a content, key of the style or content, protected)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            rows, mains = [], []
            for source in part.column(3).to_pylist():
                page = Page(source or "")
                kept = page.kept()
                seen = {(_key(node), False, _key(style), False) for node, style in page.styles.items()}
                seen |= {(_key(node), True, _key(text), protected) for node, text, _, protected in kept}
                mains.append(_key(*(text for _, text, _, _ in kept)))
                rows.append([{"node": a, "content": b, "value": c, "protected": d} for a, b, c, d in seen])
            kind = pa.list_(pa.struct([("node", pa.int64()), ("content", pa.bool_()), ("value", pa.int64()), ("protected", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(mains, pa.int64()), pa.array(rows, kind)], ["page_id", "html_key", "host", "main", "nodes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = []
            for source, low in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                page = Page(source or "")
                drop = {(x["node"], x["value"]) for x in low or ()}
                texts.append("\n".join(text for node, text, _, _ in page.kept() if not drop or (_key(node), _key(text)) not in drop))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def style_tree(nodes: DataFrame) -> DataFrame:
    """Contents of low importance, from (page_id, html_key, host, main, nodes): host, node, value, importance."""
    pages = nodes.groupBy("host", "main").agg(F.min_by("nodes", F.struct("html_key", "page_id")).alias("nodes"))  # copies of a main text count once
    sizes = pages.groupBy("host").agg(F.count("*").alias("m")).filter(F.col("m") >= PAGES)
    flat = pages.select("host", F.explode("nodes").alias("x")).select("host", "x.*")
    counts = flat.groupBy("host", "node", "content", "value", "protected").agg(F.count("*").alias("n"))
    styles = counts.filter("not content").groupBy("host", "node").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    styles = styles.select("host", "node", (F.log("all") - F.col("nlogn") / F.col("all")).alias("h"))
    contents = counts.filter("content and n > 1").drop("content").join(bounded(sizes), "host").join(styles, ["host", "node"], "left")
    importance = PRESENTATION * F.coalesce(F.col("h"), F.lit(0.0)) / F.log("m") + (1 - PRESENTATION) * (1 - F.log("n") / F.log("m"))
    least = F.when(F.col("protected"), LEAST_INSIDE).otherwise(LEAST)
    return contents.withColumn("importance", importance).filter(F.col("importance") < least).groupBy("host", "node", "value").agg(F.min("importance").alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (page_id, url, text, n_chars) per row of ``pages``."""
    kind = dict(pages.dtypes)[id_col]
    base = narrow(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html_key", F.xxhash64("html")).withColumn("host", parts(F.col("url"))[0])
    nodes = cut(map_arrow(base.select("page_id", "html_key", "host", "html"), _nodes, f"page_id {kind}, html_key long, host string, main long, nodes array<struct<node: long, content: boolean, value: long, protected: boolean>>"))
    low = cut(style_tree(nodes))
    leaves = nodes.select("page_id", "html_key", "host", F.explode("nodes").alias("x")).filter("x.content").select("page_id", "html_key", "host", "x.node", "x.value").distinct()
    marks = leaves.join(bounded(low.select("host", "node", "value")), ["host", "node", "value"]).groupBy("page_id", "html_key").agg(F.collect_set(F.struct("node", "value")).alias("low"))
    marks = cut(marks.select(F.col("page_id").alias("of"), F.col("html_key").alias("of_key"), "low"))
    entries = marks.agg(F.sum(F.size("low") + 1)).first()[0] or 0
    marks = F.broadcast(marks) if entries <= MARKS else marks
    joined = base.join(marks, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("html_key") == F.col("of_key")), "left")
    return map_arrow(joined.select("page_id", "url", "html", "low"), _extract, f"page_id {kind}, url string, text string, n_chars long")
