"""Main text of web pages by consensus host paths.

1. Every page is parsed into its blocks and containers. A container's score is the text of its own
   blocks, less what stands in links, and most of its parts' scores; the best one is the page's own choice.
2. A choice is generalised to a path of tags and classes (digits and ids left out). In Spark, the
   pages of each host vote for the paths, weighted by how much of a page's text they hold.
3. Each page is extracted again from the containers at the path its host elected, or at its own
   choice where the host's path is missing, with what stands directly in the containers around them.

Boilerplate is what stands in elements that say so by their tag, and in those that say so by a class,
id or role. Some of these words are weak: where nothing else would be left, they do not count. Nor do
strong ones and forms around nearly all that a page tells (see `MAIN`): an article may stand in a form. It is
left out piece by piece, also inside a block. Parsing takes time and memory in proportion to the page.

What stands beside the chosen containers, under the same parent, is told too unless it is mostly links or
recurs: blocks outside of the pages' own choices are counted by host in Spark, and those that stand on
several pages and a good share of them are the host's, not the page's, and so is all that stands in a container
of a class in which such a block stands.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .common import cut, maybe_broadcast, text_or_empty

#: HTML element names and what they mean.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select option datalist textarea button head title".split())
AROUND = frozenset("nav header footer aside form menu dialog".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDER = frozenset("article main section div td body".split())
NOISE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr popup modal newsletter nav navbar navigation menu breadcrumb breadcrumbs sidebar "
                  "related share sharing comment comments disqus replies footer masthead pagination login search".split())
WEAK = frozenset("banner notice notices alert overlay subscribe signup side aside widget widgets recommended social reply foot header topbar toolbar pager legal copyright skip".split())
#: Parts of names that only say what shape a thing has: beside them the others decide.
SHAPE = frozenset("area bar block box btn button buttons body bottom card cell col column container content div element fixed form group holder horizontal icon icons inner inline item items label large left line link links list "
                  "main mobile outer page panel post posts right row section site slot small sticky text title top unit vertical wrap wrapper zone js is has the".split())
#: What a start tag ends when it comes while that is open, up to a container.
ENDS = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
_OPENS = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<!--|<!\[CDATA\[|<[!?]|</")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_MARK = re.compile("[\"'>]")
_SPACE = re.compile(r"\s+")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe")}
#: How much of a part's score goes to the container around it.
PASSED = 0.97
#: An element that says it is boilerplate is the main text all the same if it holds so many characters that are not linked,
#: so many times what stands elsewhere, and nothing in it says so again (as each of a list of comments would).
MAIN, ELSEWHERE = 500, 20
#: A block recurs on a host if it stands on so many of its pages, and on this share of them.
RECURS, RECURS_SHARE = 3, 0.2


class _Node:
    __slots__ = ("tag", "cls", "up", "at", "key")

    def __init__(self, tag, cls, up, at):
        self.tag, self.cls, self.up, self.at = tag, cls, up, at
        step = tag + "".join(f".{c}" for c in cls)
        self.key = b"" if up is None else hashlib.blake2b(up.key + step.encode("utf-8", "replace"), digest_size=12).digest()

    def place(self) -> int | None:
        """A hash of the path of a container that has a class."""
        return int.from_bytes(self.key[:8], "little", signed=True) if self.cls else None

    def path(self) -> str:
        """The last steps, and a hash of all."""
        parts, x = [], self
        while x is not None and x.tag != "#" and len(parts) < 6:
            parts.append(x.tag + "".join(f".{c}" for c in x.cls))
            x = x.up
        return ">".join(reversed(parts)) + "#" + self.key.hex()


class Page:
    """A page's blocks, in order: text, text without weakly named boilerplate, how much of it is linked, and the innermost container."""

    def __init__(self):
        self.nodes = [_Node("#", (), None, 0)]
        self.blocks: list[tuple[str, str, int, _Node]] = []

    def told(self) -> list[tuple[str, int, _Node]]:
        """The blocks that count: (text, linked characters, container)."""
        if any(t for _, t, _, _ in self.blocks):
            return [(t, min(n, len(t)), x) for _, t, n, x in self.blocks if t]
        return [(t, min(n, len(t)), x) for t, _, n, x in self.blocks if t]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(text)} if text else {}


def block_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _named(words: list[str]) -> int:
    """2 if a class, id or role names boilerplate, 1 if it does so weakly."""
    most = 0
    for word in words:
        parts = [x for x in re.split(r"[^a-z]+", word) if x]
        said = [x for x in parts if x not in SHAPE]
        if said and all(x in NOISE or x in WEAK for x in said):
            most = max(most, 2 if any(x in NOISE for x in said) else 1)
    return most


def _tag_end(html: str, at: int, dead: set[int]) -> int:
    """Behind the ``>`` that ends a tag, quoted ones aside; -1 if there is none.

    ``dead`` holds the marks from which a quote was found not to end, so that no stretch is gone through twice.
    """
    seen, i = [], at
    while True:
        m = _MARK.search(html, i)
        if m is None or m.start() in dead:
            break
        k = m.start()
        if html[k] == ">":
            return k + 1
        seen.append(k)
        i = html.find(html[k], k + 1) + 1
        if not i:
            break
    dead.update(seen)
    return html.find(">", at) + 1 or -1


def parse(html: str) -> Page:
    """A page's blocks; parsed again without the boilerplate mark of an element that holds what the page tells."""
    page, marked = _parsed(html, -1)
    told = sum(max(0, len(t) - n) for t, _, n, _ in page.blocks)
    best = max(marked, key=lambda m: m[1] * (m[2] == 0), default=None)
    if best and best[2] == 0 and best[1] >= MAIN and best[1] >= ELSEWHERE * told:
        page, _ = _parsed(html, best[0])
    return page


def _parsed(html: str, spared: int) -> tuple[Page, list[list[int]]]:
    """The page, and of each outermost strongly marked element its place in the page, unlinked characters and how many
    marked elements it holds. The one at ``spared`` counts as not marked."""
    page = Page()
    marked: list[list[int]] = []
    nodes = page.nodes
    # open elements: tag, container, level of boilerplate (3: never told, 2: left out, 1: weakly named)
    stack: list[tuple[str, _Node, int]] = [("#", nodes[0], 0)]
    where: dict[str, list[int]] = {}  # places of open elements by tag
    holders, solid, articles = [0], [0], 0  # open containers; open blocks that a paragraph cannot hold
    buf: list[str] = []
    firm: list[str] = []
    linked = links = 0

    def flush():
        nonlocal linked
        if buf:
            whole = _SPACE.sub(" ", unescape("".join(buf))).strip()
            if whole:
                clean = whole if len(firm) == len(buf) else _SPACE.sub(" ", unescape("".join(firm))).strip()
                page.blocks.append((whole, clean, linked, stack[-1][1]))
            buf.clear()
            firm.clear()
        linked = 0

    def say(text):
        nonlocal linked
        level = stack[-1][2]
        if level == 2:
            if not links and text.strip():
                marked[-1][1] += len(text)
        elif level < 2:
            buf.append(text)
            if level == 0:
                firm.append(text)
            if links:
                linked += len(text)

    def pop_to(i):
        nonlocal articles, links
        if any(stack[k][0] in BLOCK for k in range(i, len(stack))):
            flush()
        while len(stack) > i:
            tag, _, _ = stack.pop()
            where[tag].pop()
            if tag == "a":
                links -= 1
            if tag in ("article", "main"):
                articles -= 1
            for opened in (holders, solid):
                if opened[-1] == len(stack):
                    opened.pop()

    at, size = 0, len(html)
    dead: set[int] = set()
    while at < size:
        m = _OPENS.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        opening = m[0]
        if not m[2]:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(opening, ">")
            at = html.find(close, m.end())
            if at < 0:
                break
            at += len(close)
            continue
        end = _tag_end(html, m.end(), dead)
        if end < 0:  # a tag that the page ends in
            break
        inside, at = html[m.end() : end - 1], end
        tag = m[2].lower()
        if m[1]:
            if where.get(tag):
                i = where[tag][-1]
                if tag in BLOCK or holders[-1] < i:
                    pop_to(i)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                say(" ")
            continue
        if tag in _RAW:
            e = _RAW[tag].search(html, at)
            at = e.end() if e else size
            continue
        if tag in BLOCK:
            i = max((where[t][-1] for t in ENDS.get(tag, ("p",)) if where.get(t)), default=-1)
            if i > 0 and solid[-1] <= i:
                pop_to(i)
            flush()
        if inside.rstrip().endswith("/") and tag in SILENT:
            continue
        a = _attributes(inside)
        classes = tuple(sorted({re.sub(r"\d+", "#", c.lower()) for c in a.get("class", "").split()}))
        level = stack[-1][2]
        named = 0 if tag in ("body", "html", "article", "main") else _named([*classes, *a.get("id", "").lower().split(), a.get("role", "").lower()])
        own = tag == "header" and articles > 0 and named < 2  # an article's own heading
        if level == 3 or tag in SILENT or "hidden" in a or a.get("aria-hidden") == "true":
            level = 3
        elif (tag in AROUND and not own or named == 2 and not own) and m.start() != spared:
            if level < 2:
                marked.append([m.start(), 0, int(tag in AROUND and tag != "form")])
            else:
                marked[-1][2] += 1
            level = 2
        elif not own and m.start() != spared:
            level = max(level, named)
        if tag == "a":
            links += 1
        if tag in ("article", "main"):
            articles += 1
        node = stack[-1][1]
        if tag in HOLDER or level and tag in BLOCK:
            node = _Node(tag, classes, node, len(nodes))
            nodes.append(node)
        where.setdefault(tag, []).append(len(stack))
        if tag in HOLDER:
            holders.append(len(stack))
        if tag in BLOCK and tag != "p":
            solid.append(len(stack))
        stack.append((tag, node, level))
    flush()
    return page, marked


def choose(page: Page) -> _Node | None:
    """The container with the best score; the first of equal ones, the outer one before its parts."""
    score, first = [0.0] * len(page.nodes), [len(page.blocks)] * len(page.nodes)
    told = page.told()
    chars, linked = [0] * len(page.nodes), [0] * len(page.nodes)
    for text, n, node in told:
        chars[node.at] += len(text)
        linked[node.at] += n
    for k, (text, _, node) in enumerate(told):
        score[node.at] += len(text) * (1 - linked[node.at] / chars[node.at])
        first[node.at] = min(first[node.at], k)
    best = None
    for node in reversed(page.nodes):  # parts come after what holds them
        i = node.at
        whole = node.tag in ("article", "main", "section", "div", "body", "#")
        if node.up is not None:
            up = node.up.at
            score[up] += (PASSED if whole else 1) * score[i]
            first[up] = min(first[up], first[i])
        if not whole:
            continue
        mine = score[i] * {"article": 1.3, "main": 1.15}.get(node.tag, 1.0), -first[i], -i
        if first[i] < len(page.blocks) and (best is None or mine > best[0]):
            best = mine, node
    return best[1] if best else None


def chosen(page: Page, path: str | None) -> list[_Node]:
    """The containers at a path that hold text; without any, the page's own choice."""
    tops = []
    if path is not None:
        key = bytes.fromhex(path.rsplit("#", 1)[1])
        tops = [x for x in page.nodes if x.key == key]
        if tops:
            ids = {id(x) for x in _under(page, tops)[1]}
            if not any(id(node) in ids for _, _, node in page.told()):
                tops = []
    if not tops:
        own = choose(page)
        tops = [own] if own is not None else []
    return tops


def _under(page: Page, tops: list[_Node]) -> tuple[list[bool], list[_Node]]:
    mark = [False] * len(page.nodes)
    for x in tops:
        mark[x.at] = True
    for node in page.nodes[1:]:
        mark[node.at] = mark[node.at] or mark[node.up.at]
    return mark, [x for x in page.nodes if mark[x.at]]


def text_at(page: Page, path: str | None, recurring: frozenset = frozenset()) -> str:
    """The blocks in the chosen containers, and what stands directly in those around them or in their neighbours if it is not
    mostly links; of neighbours nothing that recurs on the host, and where their class is another one sentences only."""
    tops = chosen(page, path)
    told = page.told()
    if not tops:
        return "\n\n".join(t for t, _, _ in told)
    inside, _ = _under(page, tops)
    beside, _ = _under(page, [x for x in page.nodes if x.up is not None and any(x.up is y.up for y in tops)])
    around = [False] * len(page.nodes)
    for x in tops:
        x = x.up
        while x is not None and not around[x.at]:
            around[x.at] = True
            x = x.up
    return "\n\n".join(t for t, n, node in told if inside[node.at] or 2 * n < len(t) and (around[node.at] or beside[node.at] and _goes_with(t, node, tops) and block_hash(t) not in recurring and node.place() not in recurring))


def _goes_with(text: str, node: _Node, tops: list[_Node]) -> bool:
    """Whether a block beside the choice may be more of it: in a container of no other class, or as a sentence."""
    return not node.cls or any(node.cls == x.cls for x in tops) or text.rstrip("\"'»”’)]")[-1:] in tuple(".!?…。！？:")


def _votes(batches):
    """For each page its vote (path and weight), and a row for each different block beside its choice."""
    for b in batches:
        rows: list[tuple] = []
        for host, url, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            page = parse(h.as_py())
            top = choose(page)
            if top is None:
                rows.append((host, url, None, 0.0, None, None))
                continue
            inside, _ = _under(page, [top])
            told = page.told()
            rows.append((host, url, top.path(), round(sum(len(t) for t, _, node in told if inside[node.at]) / sum(len(t) for t, _, _ in told), 3), None, None))
            rows += [(host, url, None, None, *x) for x in {(block_hash(t), node.place()) for t, n, node in told if not inside[node.at] and 2 * n < len(t)}]
        cols = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], ["host", "page", "path", "weight", "block", "place"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, path.

    Nulls: null html is empty and has empty text; pages with a null url are one host. A host's ties go
    to the path first in order. Repeated rows vote and return as often as they come. Nothing is cut,
    whatever the length of a page. Empty tables give empty tables.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), text_or_empty(html_col).alias("html"))
    said = cut(map_arrow(base.select("host", F.xxhash64("page_id", "url").alias("page"), "html"), _votes, "host string, page long, path string, weight double, block long, place long"))
    # summed where the pages are, so that a large host is a few rows per task
    votes = said.filter("path is not null").groupBy("host", "path").agg(F.sum(F.col("weight").cast("decimal(20,3)")).alias("w"))
    best = Window.partitionBy("host").orderBy(F.desc("w"), "path")
    elected = votes.withColumn("r", F.row_number().over(best)).filter("r = 1").select("host", "path")
    # a block of a host is counted once a page; those on a good share of the pages are few, however many pages there are
    pages_of = said.filter("block is null").groupBy("host", "page").agg(F.lit(1).alias("x")).groupBy("host").agg(F.count("*").alias("pages"))
    blocks = said.filter("block is not null").groupBy("host", "block", "place", "page").agg(F.lit(1).alias("x")).groupBy("host", "block", "place").agg(F.count("*").alias("n"))
    blocks = blocks.join(pages_of, "host").filter((F.col("n") >= RECURS) & (F.col("n") >= F.col("pages") * RECURS_SHARE)).groupBy("host").agg(F.array_union(F.collect_set("block"), F.collect_set("place")).alias("blocks"))
    elected = cut(elected.join(blocks, "host", "full"))
    kind = {f.name: f.dataType.simpleString() for f in base.schema.fields}

    def again(batches):
        for b in batches:
            texts = [text_at(parse(h.as_py()), p.as_py(), frozenset(x.as_py() or ())) for h, p, x in zip(b.column("html"), b.column("path"), b.column("blocks"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b.column("path")],
                ["page_id", "url", "text", "n_chars", "path"])

    both = base.join(maybe_broadcast(elected), "host", "left").select("page_id", "url", "html", "path", "blocks")
    return map_arrow(both, again, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long, path string")
