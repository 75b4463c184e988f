"""Main text of web pages by equivalence classes of tokens.

A page is a sequence of tokens: tags, told apart by their path of tags and classes, and text blocks. Tokens with the same
occurrence vector over the pages of a host form an equivalence class. A vector is summed up by its support, its total and
the sum of count times a hash of the page, so that it is aggregated before it is shuffled, however many pages a host has.
Classes with enough tokens and pages make the host's template, in the order of the page with the smallest hash. A class holds
on a page if its tokens stand there in that order, and nests if all of them lie in one slot of the classes before it. Text
blocks that belong to the template itself are template text; the blocks between its tokens are slots.

The host's main slot holds the article: the innermost path whose largest element on each page holds, over the host, `MAIN` or more
of the unlinked text, counted on pages of which it holds an eighth or more; on a page it is that element. Tags refine it: where the slot lies inside an `article` or `main`, that is taken
whole. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments inside it are left out by their
tags and class names, and lists of links by their slot's share of links over the host. Pages of hosts without a template have
only tags and names; without either, template text and lists of links go.
Copies of a page are one page of their host: each counts for its share.

Defined cases: null html counts as empty and gives empty text; pages of hosts with few pages, and null or odd urls (one host
of their own), have no template and go by names and each block's own links; unclosed and misnested tags close with their parents; repeated rows
and null ids are extracted like any other; other columns pass through `extract`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Tokens and pages that a class needs, and its share of a host's pages.
LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE = 3, 3, 0.5
#: Share of a text in links that makes a list of links of it; share of a host's unlinked text that the main slot holds; share
#: of a page's unlinked text from which on an element counts towards it.
LINKED, MAIN, LEAST_HELD = 0.5, 0.75, 0.125

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_RAW = {"script", "style", "textarea", "xmp", "noembed", "noframes", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_OUT = {"head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "iframe", "object", "svg", "canvas", "audio", "video", "menu", "dialog", "title", "map"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOP = {"ul", "ol", "dl", "table", "tbody", "div", "section", "article", "main", "body", "select", "blockquote"}
_JUNK = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|adslot|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|notification\w*|alert\w*|newsletter\w*|subscri\w*|signup|sign-up|sidebar\w*|side-bar|rail|widget\w*|"
    r"comment\w*|disqus\w*|respond|replies|discussion|share|sharing|social\w*|follow|breadcrumb\w*|menu\w*|nav\w*|navbar|footer\w*|related|recommend\w*|recirc\w*|popup\w*|pop-up|modal\w*|overlay|login|search\w*|toolbar|pagination|pager|tags|"
    r"skip|copyright|contentinfo|complementary|navigation|masthead|topbar|top-bar|disclaimer|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
_HEAD = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header|banner)(?=$|[\s_-])", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


@dataclass(slots=True)
class _Open:
    """An open element: its tag, the key of its path, whether it is in an article or left out, its depth and what it holds."""

    tag: str
    path: int
    article: bool
    out: bool
    depth: int
    first: int
    chars: int = 0


class Page:
    """The tokens of one page: keys in order, and its text blocks."""

    def __init__(self, html: str):
        self.keys: list[int] = []
        #: (place among the keys, key, slot path, text, characters in links, inside an article, left out by its tags)
        self.blocks: list[tuple[int, int, int, str, int, bool, bool]] = []
        #: (depth, key, first block, block after the last, unlinked characters) of each element that holds text
        self.elements: list[tuple[int, int, int, int, int]] = []
        self._stack: list[_Open] = []
        self._text: list[tuple[str, bool]] = []
        self._read(html)
        while self._stack:
            self._leave()

    def _flush(self) -> None:
        if self._text:
            whole = " ".join(unescape("".join(t for t, _ in self._text)).split())
            if whole:
                linked = sum(len(t.strip()) for t, a in self._text if a)
                up = self._block_parent()
                key = _key(f"{up.path}\n{whole}")
                self.blocks.append((len(self.keys), key, up.path, whole, min(linked, len(whole)), up.article, up.out))
                up.chars += len(whole) - min(linked, len(whole))
                self.keys.append(key)
            self._text.clear()

    def _block_parent(self) -> _Open:
        for x in reversed(self._stack):
            if x.tag not in _INLINE:
                return x
        return _Open("", 0, False, False, 0, 0)

    def _leave(self) -> _Open:
        x = self._stack.pop()
        if x.tag not in _INLINE and len(self.blocks) > x.first:
            self.elements.append((x.depth, x.path, x.first, len(self.blocks), x.chars))
            self._block_parent().chars += x.chars
        return x

    def _pop(self, i: int) -> None:
        if any(x.tag not in _INLINE for x in self._stack[i:]):
            self._flush()
        while len(self._stack) > i:
            x = self._leave()
            if x.tag not in _INLINE:
                self.keys.append(_key(f"{x.path}/"))

    def _open(self, tag: str, rest: str) -> None:
        if tag not in _INLINE:
            self._flush()
        if tag in _CLOSES_P:
            for i in range(len(self._stack) - 1, -1, -1):
                if self._stack[i].tag == "p":
                    self._pop(i)
                    break
                if self._stack[i].tag not in _INLINE:
                    break
        if tag in _SAME:
            for i in range(len(self._stack) - 1, -1, -1):
                if self._stack[i].tag in _SAME[tag]:
                    self._pop(i)
                    break
                if self._stack[i].tag in _STOP:
                    break
        up = self._stack[-1] if self._stack else _Open("", 0, False, False, 0, 0)
        names = " ".join(_CAMEL.sub("-", v.strip("\"'")) for _, v in _NAMES.findall(rest)) if "=" in rest else ""
        article = up.article or tag in ("article", "main") or (tag == "div" and bool(re.search(r"(?:^|\s)articleBody(?:$|\s)", rest)))
        root = tag in ("html", "body", "article", "main")
        out = up.out or tag in _OUT or (tag == "header" and not up.article) or (not root and bool(names) and bool(_JUNK.search(names) or (not up.article and _HEAD.search(names)))) or bool(rest and not root and _HIDDEN.search(rest))
        path = _key(f"{up.path}>{tag}.{names}")  # of a fixed size, however deep
        if tag in _VOID:
            if tag in ("br", "wbr"):
                self._text.append((" " if tag == "br" else "", False))
            elif tag not in _INLINE:
                self.keys.append(path)
            return
        self._stack.append(_Open(tag, path, article, out, up.depth + (tag not in _INLINE), len(self.blocks)))
        if tag not in _INLINE:
            self.keys.append(path)

    def _read(self, html: str) -> None:
        at = 0
        while at < len(html):
            m = _TOKEN.search(html, at)
            if m is None:
                self._add(html[at:])
                break
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            tag = (m.group(2) or m.group(5) or "").lower()
            if not tag:
                continue
            if m.group(1) or m.group(4):
                if tag == "p" and not any(x.tag == "p" for x in self._stack):
                    self._flush()
                for i in range(len(self._stack) - 1, -1, -1):
                    if self._stack[i].tag == tag:
                        self._pop(i)
                        break
                    if tag in _INLINE and self._stack[i].tag not in _INLINE:
                        break
                continue
            rest = m.group(3) or m.group(6) or ""
            self._open(tag, rest)
            if tag in _RAW and not rest.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                if tag == "textarea" or tag == "title":
                    self._add(html[at : end.start() if end else len(html)])
                at = end.start() if end else len(html)
        self._flush()

    def _add(self, text: str) -> None:
        self._text.append((text, any(x.tag == "a" for x in self._stack)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, kind, n, vector, chars, linked, page, place, copies) of each distinct token of a page; kind 2 is a slot's path, kind 3 the
    path of elements around text, with the largest one's characters and its depth as place, kind 4 the whole page."""
    for batch in batches:
        for a, b in C.text_chunks(batch.column(1)):
            rows: list[tuple] = []
            for name, html, copies in zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(3)), strict=True):
                page = Page(html or "")
                h = _key(html or "")
                mark = xxhash.xxh32_intdigest(h.to_bytes(8, "little"))
                texts = {x[1] for x in page.blocks}
                first: dict[int, int] = {}
                for i, k in enumerate(page.keys):
                    first.setdefault(k, i)
                rows += [(name, k, int(k in texts), n, n * mark, 0, 0, h, first[k], copies) for k, n in Counter(page.keys).items()]
                chars: dict[int, list[int]] = {}
                for _, _, path, text, linked, _, _ in page.blocks:
                    x = chars.setdefault(path, [0, 0])
                    x[0], x[1] = x[0] + len(text), x[1] + linked
                rows += [(name, p, 2, 1, 0, c, l, h, 0, copies) for p, (c, l) in chars.items()]
                held: dict[tuple[int, int], int] = {}
                for depth, key, _, _, c in page.elements:
                    held[depth, key] = max(held.get((depth, key), 0), c)
                if page.blocks:
                    held[0, 0] = sum(len(x[3]) - x[4] for x in page.blocks)
                rows += [(name, k, 3 if depth else 4, 1, 0, c, 0, h, depth, copies) for (depth, k), c in held.items() if c >= LEAST_HELD * held[0, 0]]
            names = ["host", "key", "kind", "n", "vector", "chars", "linked", "page", "place", "copies"]
            kinds = (pa.string(), pa.int64(), pa.int32(), *(pa.int64(),) * 7)
            cols = zip(*rows, strict=True) if rows else ((),) * 10
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=names)


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, linked, main): each host's template tokens with their class, order and pages, its slots of mostly links, and
    its main slot.

    pages has host and html. Counts per host and token are summed before and after the shuffle; what is collected for a host
    is its template, whose tokens each stand on half of its pages or more, so at most twice a page's tokens."""
    pages = pages.select("host", "html", F.xxhash64(F.coalesce("html", F.lit(""))).alias("sum"))
    copies = C.written(pages.groupBy("host", "sum").agg(F.count("*").alias("copies")), "copies")
    repeated = C.written(copies.where("copies > 1"), "repeated")
    weighed = C.looked_up(pages, repeated, ["host", "sum"], "left").select("host", "html", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    counts = weighed.mapInArrow(_counted, "host string, key long, kind int, n long, vector long, chars long, linked long, page long, place long, copies long")
    share = lambda c: F.sum(c / F.col("copies"))
    sums = counts.groupBy("host", "key", "kind").agg(
        F.round(share(F.lit(1))).cast("long").alias("support"), F.sum("n").alias("total"), F.sum(F.col("vector").cast("decimal(20,0)")).alias("vector"), share(F.col("chars")).alias("chars"), share(F.col("linked")).alias("linked"), F.min(F.struct("page", "place")).alias("first")
    )
    sums = C.written(sums.where(F.col("support") >= LEAST_PAGES), "tokens")
    sizes = C.written(copies.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    frequent = C.looked_up(sums, sizes, ["host"]).where(F.col("support") >= F.col("pages") * LEAST_SHARE)
    tokens = frequent.where("kind < 2")
    classes = tokens.groupBy("host", "support", "total", "vector").agg(F.count("*").alias("size")).where(F.col("size") >= LEAST_TOKENS)
    kept = tokens.join(classes, ["host", "support", "total", "vector"])
    token = F.struct(F.col("support"), F.xxhash64("vector", "total").alias("class"), F.col("first.place").alias("place"), "key", "kind")
    made = kept.groupBy("host").agg(F.sort_array(F.collect_list(token)).alias("tokens"))
    linked = frequent.where((F.col("kind") == 2) & (F.col("linked") > F.col("chars") * LINKED)).groupBy("host").agg(F.collect_list("key").alias("linked"))
    whole = frequent.where("kind = 4").select("host", F.col("chars").alias("all"))
    held = frequent.where("kind = 3").join(whole, "host").where(F.col("chars") >= F.col("all") * MAIN)
    main = held.groupBy("host").agg(F.max(F.struct(F.col("first.place").alias("depth"), "chars", "key"))["key"].alias("main"))
    return C.written(made.join(linked, "host", "full_outer").join(main, "host", "full_outer"), "templates")


def main_text(page: Page, tokens: list[dict] | None, linked: set[int], main: int | None = None) -> tuple[str, int, int]:
    """The article of a page, the number of template tokens that hold on it, and of slots with text between them."""
    constant: set[int] = set()
    places: list[int] = []
    if tokens:
        at: dict[int, list[int]] = {}
        for i, k in enumerate(page.keys):
            at.setdefault(k, []).append(i)
        classes: dict[int, list[dict]] = {}
        for t in tokens:
            classes.setdefault(t["class"], []).append(t)
        for members in sorted(classes.values(), key=lambda m: (-m[0]["support"], -len(m), m[0]["class"])):
            found = [at.get(t["key"], ()) for t in sorted(members, key=lambda t: t["place"])]
            if any(len(f) != 1 for f in found):
                continue
            line = [f[0] for f in found]
            if line != sorted(line):
                continue
            slot = np.searchsorted(places, [line[0], line[-1]])
            if places and slot[0] != slot[1] and line[0] > places[0]:
                continue
            places = sorted({*places, *line})
            constant |= {t["key"] for t in members if t["kind"] == 1}
    named = {i for i, x in enumerate(page.blocks) if x[5] and not x[6]}
    largest = max((e for e in page.elements if e[1] == main), key=lambda e: (e[4], -e[2]), default=None)
    slot = {i for i in range(largest[2], largest[3]) if not page.blocks[i][6]} if largest else set()
    if slot and not slot <= named:  # the template decides, also against the tags
        chosen = {i for i in slot if page.blocks[i][2] not in linked}
    elif named:  # the tags of the article around the slot, or alone
        chosen = named
    else:
        chosen = {i for i, x in enumerate(page.blocks) if not x[6] and x[1] not in constant and x[2] not in linked and (tokens or x[4] <= len(x[3]) * LINKED)}
    out = [page.blocks[i][3] for i in sorted(chosen)]
    slots = len({int(np.searchsorted(places, b[0])) for b in page.blocks if b[1] not in constant})
    return "\n".join(out), len(places), slots


def _extracted(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            html, tokens, linked, main = (names.index(x) for x in ("__html", "__template", "__linked", "__slot"))
            for a, b in C.text_chunks(batch.column(html)):
                part = batch.slice(a, b - a)
                rows = []
                for i, text in enumerate(part.column(html).to_pylist()):
                    t, k, m = (part.column(c)[i].as_py() for c in (tokens, linked, main))
                    rows.append(main_text(Page(text or ""), t, set(k or ()), m))
                out, n, slots = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in keep), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(slots, pa.int64())], names=[*keep, "__main", "__tokens", "__slots"])

    return run


HOST = r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """pages with __main (its article), __tokens (template tokens that hold on it) and __slots (its slots with text)."""
    name = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1))
    rows = pages.select("*", name.alias("__host"), F.col(html_col).alias("__html"))
    made = templates(rows.select(F.col("__host").alias("host"), F.col("__html").alias("html"))).select(F.col("host").alias("__host"), F.col("tokens").alias("__template"), F.col("linked").alias("__linked"), F.col("main").alias("__slot"))
    joined = C.looked_up(rows, made, ["__host"], "left")
    return joined.mapInArrow(_extracted(pages.columns), C.with_fields(pages, __main="string", __tokens="long", __slots="long"))


def op7_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = extract(pages)
    return found.select("page_id", "url", F.col("__main").alias("text"), F.length("__main").cast("long").alias("n_chars"), F.col("__tokens").alias("template_tokens"), F.col("__slots").alias("slots"))
