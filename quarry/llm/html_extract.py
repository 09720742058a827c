"""Main text of web pages by minimum-cut labelling.

A page becomes text blocks in page order. A classifier weighs what a block's text and its place in the document tree say for and
against content; the weight is the capacity to one terminal. Blocks that follow each other are joined by an edge that falls with
the tree distance between them, and the nearest blocks under one parent by another, both of the size of the weights. The minimum cut, found by
maximum flow (level graphs and blocking flows), is the cheapest labelling; blocks on the content side are the text. So a short line among
paragraphs stays, and a sentence among menus goes, whatever the classifier says of it alone.

Cases: null and empty pages give an empty text; unclosed and stray tags, a missing head or body and text outside any element are
read as browsers would in outline; repeated rows give equal results; nothing is dropped for length.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Element names of the HTML standard, and words that sites name parts of a page with.
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
_UNSHOWN = frozenset("svg math canvas object video audio select button datalist map head".split())
_OF_HEAD = frozenset("title meta link style script base noscript template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 dd dt td blockquote pre".split())
_OUT = frozenset("nav footer aside form menu dialog".split())
_IN = frozenset("article main".split())
_BAD = frozenset("ad ads adsense adslot advert adverts advertisement banner promo promos promotion sponsor sponsored nav navbar navigation menu menus masthead footer foot sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommend recommended recommendations trending popular breadcrumb breadcrumbs crumbs pagination pager paging comment comments disqus reply replies respond discussion search toolbar copyright legal disclaimer tags metadata contentinfo complementary teaser teasers".split())
_GOOD = frozenset("article main content post entry story body text hentry articlebody prose".split())
_STATES = frozenset("enabled disabled open closed allowed has no with without count on off".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WORD = re.compile(r"[a-z]+")
#: Shares of a page's text beyond which a form is the page's frame and tells nothing.
FRAME = 0.6
DECAY, SURE = 0.6, 4.0


class Block:
    """text; the element it is under; what its ancestors say, with and without forms; its element; the share of its text in links; the path to the root."""

    __slots__ = ("text", "parent", "place", "unformed", "tag", "linked", "path")

    def __init__(self, text: str, parent: int, place: float, unformed: float, tag: str, linked: float, path: tuple[int, ...]):
        self.text, self.parent, self.place, self.unformed, self.tag, self.linked, self.path = text, parent, place, unformed, tag, linked, path


def _named(attributes: str, whole: bool) -> float:
    """What class, id and role say: a word of boilerplate at either end of a name tells against, unless the name tells a state (has-sidebar,
    comments-enabled); whole: only names that are such a word and nothing else count, as articles carry names of their topics."""
    good = False
    for _, a, b, c in _NAMES.findall(attributes):
        for name in (a or b or c).lower().split():
            words = _WORD.findall(name)
            if not words or not _STATES.isdisjoint(words):
                continue
            if len(words) == 1 or not whole:
                if words[0] in _BAD or words[-1] in _BAD or words == ["header"] or words[-1] == "header" and words[0] in ("site", "page", "global", "top"):
                    return -SURE
            good = good or words[0] in _GOOD and words[-1] not in ("meta", "info", "footer")
    return 1.0 if good else 0.0


def _placed(tag: str, attributes: str, above: float) -> float:
    """What an element and its ancestors say of the text in it."""
    own = 0.0
    if tag in _OUT:
        own = -SURE
    elif tag == "header":
        own = 0.0 if above > 0 else -SURE
    else:
        named = _named(attributes, tag in _IN) if "=" in attributes and tag not in ("body", "html") else 0.0
        own = named if named < 0 else max(named, 1.6 if tag in _IN else 0.0) if above >= 0 else 0.0
    return max(-SURE, min(SURE, (DECAY * above if above > 0 else above) + own)) if own >= 0 or above <= 0 else own


def blocks(html: str) -> list[Block]:
    """Blocks with text, white space made single and character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, float, float, int]] = [("", 0.0, 0.0, 0)]  # element, what it says, the same without forms, number
    text: list[str] = []
    seen = links = number = 0
    in_link = False
    hidden: str | None = None
    low = html.lower() if len(html) < 1 << 20 else None
    last_close: dict[str, int] = {}

    def closes_after(tag: str, at: int) -> bool:
        """There is an end tag further on; else the element does not hide the rest of the page."""
        if tag not in last_close:
            last_close[tag] = (low if low is not None else html.lower()).rfind(f"</{tag}")
        return last_close[tag] >= at

    def flush() -> None:
        nonlocal links, seen
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                tag, place, unformed, own = stack[-1]
                up = stack[-2][3] if len(stack) > 1 and tag in _LEAVES else own
                out.append(Block(joined, up, place, unformed, tag, links / max(1, seen), tuple(x[3] for x in stack[-12:])))
            text.clear()
        seen = links = 0

    at, end = 0, len(html)
    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        if hidden is None and m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            n = len(piece.strip())
            seen += n
            links += n if in_link else 0
        at = m.end()
        tag, attributes = m.group(2) or m.group(5), m.group(3) or m.group(6) or ""
        if not tag:
            continue
        tag, closing = tag.lower(), (m.group(1) or m.group(4)) == "/"
        if hidden is not None:
            if tag == hidden:
                hidden = None if closing else hidden
                continue
            if hidden == "head" and tag not in _OF_HEAD or closing and tag in _BLOCK and tag == stack[-1][0]:
                hidden = None  # what encloses it ends, or the head has
            elif tag in _RAW and not closing:
                close = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(html, at)
                at = close.end() if close else end if hidden != "head" or tag != "title" else at
                continue
            else:
                continue
        if tag in _RAW:
            if not closing and closes_after(tag, at):
                close = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(html, at)
                at = close.end() if close else end
            elif not closing and tag in ("script", "style"):
                at = end
            continue
        if tag in _UNSHOWN:
            if not closing and not attributes.endswith("/") and (tag == "head" or closes_after(tag, at)):
                hidden = tag
            text.append(" ")
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in _BLOCK:
            continue
        flush()
        in_link = False
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body") and tag not in ("html", "body", "article", "main"):
                    break
            continue
        if tag in _VOID:
            continue
        while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] in _ENDS.get(tag, ())):
            stack.pop()
        number += 1
        _, above, unformed, _ = stack[-1]
        stack.append((tag, _placed(tag, attributes, above), _placed("div" if tag == "form" else tag, attributes, unformed), number))
    if hidden is None and at < end:
        text.append(html[at:])
        seen += end - at
    flush()
    return out


def weight(b: Block, place: float) -> int:
    """For content if positive, against it if negative, in thousandths: what the place says, and length, element, links and punctuation."""
    n = len(b.text)
    z = 0.45 * place + (0.6 if n >= 200 else 0.35 if n >= 80 else 0.0 if n >= 25 else -0.35)
    z += 0.3 if b.tag in ("p", "pre", "blockquote") else 0.6 if b.tag in ("h1", "h2", "h3") else 0.0
    z -= 2.0 * b.linked * (1 if n < 400 else 0.5)
    if b.text[-1] in ".!?…\"”»" and n >= 40:
        z += 0.2
    return int(1000 * z)


#: Edges between neighbours whose paths meet right above them, and between the nearest blocks under one parent.
NEXT, SIBLING = 700, 500


def distance(a: Block, b: Block) -> int:
    """Steps in the document tree from one block's element to the other's (of paths cut short, at least that many)."""
    same = len(set(a.path) & set(b.path))
    return len(a.path) + len(b.path) - 2 * same


def min_cut(excess: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut. excess: capacity from the source, or if negative to the sink; edges (a, b, capacity)
    hold both ways. Phases of level graph and blocking flow: their number grows with the different lengths of shortest paths, not with the paths."""
    n, excess = len(excess), list(excess)
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    for a, b, c in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += (b, a)
        room += (c, c)
    while True:
        level = [-1] * n
        front = [i for i in range(n) if excess[i] > 0]
        for i in front:
            level[i] = 0
        found, depth = False, 0
        while front and not found:
            depth += 1
            after = []
            for i in front:
                for e in near[i]:
                    j = to[e]
                    if room[e] > 0 and level[j] < 0:
                        level[j] = depth
                        after.append(j)
                        found = found or excess[j] < 0
            front = after
        if not found:
            return [x >= 0 for x in level]
        arc = [0] * n
        for source in range(n):
            if level[source]:
                continue
            while excess[source] > 0:
                path: list[int] = []
                i = source
                while not (excess[i] < 0 and path):
                    while arc[i] < len(near[i]):
                        e = near[i][arc[i]]
                        if room[e] > 0 and level[to[e]] == level[i] + 1:
                            break
                        arc[i] += 1
                    if arc[i] < len(near[i]):
                        path.append(near[i][arc[i]])
                        i = to[path[-1]]
                    elif path:
                        i = to[path.pop() ^ 1]
                        arc[i] += 1
                    else:
                        break
                if not path:
                    break
                flow = min(excess[source], -excess[i], min(room[e] for e in path))
                excess[source] -= flow
                excess[i] += flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def labelled(html: str | None) -> tuple[list[Block], list[int], list[bool]]:
    """Blocks, the classifier's weight of each, and the labels of the cut."""
    found = blocks(html) if html else []
    total = sum(len(b.text) for b in found)
    framed = sum(len(b.text) for b in found if b.place != b.unformed) > FRAME * total
    weights = [weight(b, b.unformed if framed else b.place) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT * 2 // max(2, distance(found[i - 1], b))))
        if (j := last.get(b.parent)) is not None:
            edges.append((j, i, SIBLING))
        last[b.parent] = i
    return found, weights, min_cut(weights, edges)


def extract(html: str | None) -> str:
    found, _, content = labelled(html)
    return "\n".join(b.text for b, keep in zip(found, content) if keep)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text)."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def read(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([extract(h) for h in b.column(2).to_pylist()], pa.string())], names=["id", "url", "text"])

    out = own.mapInArrow(read, T.StructType([own.schema["id"], own.schema["url"], T.StructField("text", T.StringType())]))
    return out.toDF(id_col, url_col, "text")
