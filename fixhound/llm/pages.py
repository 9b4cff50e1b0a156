"""Main text of web pages: differencing of neighbouring pages, and structure where a page marks its article.

Pages are cut into blocks at block-level tags. Parts that are never an article (menus, headers,
footers, sidebars, notices, adverts, forms, comments, by tag, role, class or id) go. All pages of a
host are ordered by URL path, so the page with the nearest path is next to each; the two pages'
lines are aligned by their longest common subsequence, and lines that both have are the site's own
and deleted. If a pair shares most of its text, the pages are copies rather than siblings and
the neighbour on the other side is taken instead, or none. Of a page with an article or main element,
blocks outside of it go as well, and its paragraphs, headings, lists and tables stay though a neighbour
has them too: there differencing decides on blocks of no such kind (`div`, `section`, `center`).
"""

from __future__ import annotations

import html
import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import slices

_RAW = "script|style|noscript|template|textarea|title|iframe|object|svg|canvas|math|select|audio|video|xmp|noembed|noframes"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{_RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that say nothing of what they hold.
_PLAIN = frozenset("div section center".split())
_INLINE_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_GONE_TAGS = frozenset("nav footer aside form menu dialog button head search".split())
_GONE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id: the part is no article, whatever it holds.
_GONE_NAMES = frozenset("comment comments commentlist disqus replies respond ad ads advert adverts advertisement adsense sponsor sponsored promo".split())
#: Words of a class or id: the part is no article unless it holds one.
_ODD_NAMES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer header masthead banner cookie cookies consent gdpr notice notification "
    "alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations widget pagination pager toolbar search".split()
)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A pair of pages whose common lines hold more than this share of either text are copies.
COPY_SHARE = 0.6


class _Node:
    __slots__ = ("tag", "gone", "odd", "holds", "parts", "main")

    def __init__(self, tag: str, gone: bool = False, odd: bool = False, main: bool = False):
        self.tag, self.gone, self.odd, self.main = tag, gone, odd, main
        self.holds = False
        self.parts: list[_Node | str] = []


def _opened(tag: str, attrs: str) -> _Node:
    gone, odd, main = False, tag in _GONE_TAGS or tag == "header", tag in ("article", "main")
    if attrs and ("=" in attrs or "hidden" in attrs):
        for name, value in _ATTRIBUTE.findall(attrs):
            name, value = name.lower(), html.unescape(value.strip("\"'"))
            if name in ("class", "id"):
                words = {w.lower() for w in _NAME_WORD.findall(value)}
                gone |= bool(words & _GONE_NAMES)
                odd |= bool(words & _ODD_NAMES)
            elif name == "role":
                odd |= value.lower() in _GONE_ROLES
                main |= value.lower() == "main"
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                odd = True
            elif name == "style" and "display:none" in value.replace(" ", "").lower():
                odd = True
    if tag in ("html", "body", "main"):
        gone = odd = False
    return _Node(tag, gone, odd, main)


def parse(page: str) -> _Node:
    """A tolerant tree of the page's elements and texts."""
    root = _Node("#root")
    stack = [root]
    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            stack[-1].parts.append(text)
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["raw"]:
                stack[-1].parts.append(" ")
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _VOID:
            stack[-1].parts.append(_Node("hr") if tag == "hr" else " " if tag == "br" else "")
            continue
        if tag in _BLOCKS:
            while len(stack) > 1 and stack[-1].tag not in _BLOCKS:
                if any(n.tag == "p" for n in stack):
                    stack.pop()
                else:
                    break
            if stack[-1].tag == "p":
                stack.pop()
            ends = _INLINE_ENDS.get(tag)
            while ends and stack[-1].tag in ends:
                stack.pop()
        node = _opened(tag, m["attrs"] if m["tag"] else m["attrs2"])
        if node.main or tag == "h1":
            for above in reversed(stack):
                if above.holds:
                    break
                above.holds = True
        stack[-1].parts.append(node)
        stack.append(node)
    return root


def _dropped(node: _Node) -> bool:
    return node.gone or (node.odd and not node.holds)


def _mains(root: _Node) -> list[_Node]:
    """The outermost article or main elements; of a main element with articles, the articles."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if _dropped(node):
            continue
        if node.main and (node.tag == "article" or not any(isinstance(p, _Node) and p.holds for p in node.parts)):
            found.append(node)
            continue
        inner = [p for p in node.parts if isinstance(p, _Node)]
        if node.main and not _mains_below(inner):
            found.append(node)
            continue
        todo.extend(reversed(inner))
    return found


def _mains_below(nodes: list[_Node]) -> bool:
    todo = list(nodes)
    while todo:
        node = todo.pop()
        if _dropped(node):
            continue
        if node.main:
            return True
        todo.extend(p for p in node.parts if isinstance(p, _Node))
    return False


#: What differencing may do with a line: nothing, as it's outside of the page's article and goes anyhow; delete it; nothing, as it's the article's.
OUTSIDE, OPEN, ARTICLE = range(3)
_OWN = ARTICLE + 1  # text of the mark itself, where plain blocks are open


def marked_lines(page: str) -> tuple[list[str], list[int]]:
    """All blocks of the page but those of dropped parts, and the kind of each; all are open if it marks no article."""
    root = parse(page)
    mains = {id(node) for node in _mains(root)}
    out: list[str] = []
    kinds: list[int] = []
    held: list[str] = []
    kind = outside = OUTSIDE if mains else OPEN

    def close() -> None:
        nonlocal kind
        line = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if line:
            out.append(line)
            kinds.append(min(kind, ARTICLE))
        kind = outside

    # (node, at, whether only headings count, kind of its texts)
    stack: list[tuple[_Node, int, bool, int]] = [(root, 0, False, outside)]
    while stack:
        node, at, titles, own = stack.pop()
        if at == len(node.parts):
            if node.tag in _BLOCKS or id(node) in mains:
                close()
            continue
        stack.append((node, at + 1, titles, own))
        part = node.parts[at]
        if isinstance(part, str):
            if not titles:
                held.append(part)
                if part.strip():
                    kind = max(kind, own)
            continue
        if part.gone or (part.odd and not part.holds):
            if part.tag in _BLOCKS:
                close()
            continue
        inner = own
        if id(part) in mains:
            inner = _OWN
        elif mains and own != OUTSIDE and part.tag in _BLOCKS:
            # a plain block in a list item or table stays the article's
            inner = OPEN if part.tag in _PLAIN and own != ARTICLE else ARTICLE
        if part.tag in _BLOCKS or id(part) in mains:
            close()
        heading = part.tag in _HEADINGS
        stack.append((part, 0, (titles or part.tag == "header") and not heading and not part.main, inner))
    close()
    return out, kinds


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Places in `a` of a longest common subsequence of both (Hunt and Szymanski)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < min(len(a), len(b)) - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict[str, list[int]] = {}
    for j in range(len(b) - tail - 1, start - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i in range(start, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif ends[k] != j:
                ends[k] = j
                links[k] = link
    middle = []
    link = links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(start), *reversed(middle), *range(len(a) - tail, len(a))]


def without_shared(page: list[str], kinds: list[int], others: list[list[str]]) -> list[str]:
    """The page's lines less those outside its article and the open ones in common with the first of `others` that is no copy of it."""
    gone: set[int] = set()
    for other in others:
        shared = common_lines(page, other)
        size = sum(len(page[i]) for i in shared)
        if size <= COPY_SHARE * min(sum(map(len, page)), sum(map(len, other))):
            gone = set(shared)
            break
    return [line for i, (line, kind) in enumerate(zip(page, kinds)) if kind == ARTICLE or (kind == OPEN and i not in gone)]


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


_RESULT = "page_id bigint, url string, text string, n_chars bigint"


def _result(ids: tuple, urls: tuple, texts: tuple[str, ...]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
        ["page_id", "url", "text", "n_chars"],
    )


def extract(pages: DataFrame) -> DataFrame:
    """`page_id`, `url`, `text` (blocks joined by line feeds, empty if none) and `n_chars` of every page.

    A null page counts as empty. A null URL stands for a host of its own kind with an empty path.
    Pages with the same URL are neighbours like others; repeated rows each give a row. Blocks are
    never cut short.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, "html"):
                for row in part.to_pylist():
                    row["lines"], row["kinds"] = marked_lines(row.pop("html"))
                    yield row

    def differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of host and path; each is kept until its next neighbour is known."""
        made: list[tuple] = []
        size = 0
        before = now = None
        for row in itertools.chain(rows(batches), [None]):
            if now is not None:
                made.append((now["page_id"], now["url"], _closest(before, now, row)))
                size += len(made[-1][2])
                if size >= 1 << 20 or len(made) >= 1000:
                    yield _result(*zip(*made))
                    made, size = [], 0
            before, now = now, row
        if made:
            yield _result(*zip(*made))

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.\-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][\w+.\-]*://[^/?#]*)?([^?#]*)", 1), F.lit(""))
    ordered = pages.select("page_id", "url", host.alias("host"), path.alias("path"), "html")
    keys = ["host", "path", "page_id", "url"]
    # the texts are cut behind the shuffle: dealing by ranges reads what comes before it twice
    return ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(differenced, _RESULT)


def _closest(before: dict | None, page: dict, after: dict | None) -> str:
    """The page's text, by its neighbours of the same host, that with the longer common path first."""
    beside = [n for n in (before, after) if n is not None and n["host"] == page["host"]]
    beside.sort(key=lambda n: -_common_prefix(n["path"], page["path"]))
    return "\n".join(without_shared(page["lines"], page["kinds"], [n["lines"] for n in beside]))
