"""Operator 10: main text of pages by a minimum cut between content and boilerplate blocks."""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame

from headrace.llm.common import with_results

#: Elements that begin and end blocks of text. All others are inline: they neither part text nor add white space.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN_TAGS = frozenset("head script style title template noscript svg math object canvas audio video iframe select button "
                        "textarea datalist noembed noframes xmp".split())
#: An open p ends where one of these begins; items end where the next like item begins.
ENDS_P = BLOCK_TAGS - frozenset("br body html head option optgroup caption".split())
ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "option": ("option",)}
SCOPES = frozenset("ul ol dl table article aside section div nav body main header footer form".split())
#: Boilerplate words in class and id names.
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|popup|modal|cookies?|consent|notices?|nav|navbar|navigation|"
    r"menu|breadcrumbs?|side-?bar|foot(?:er)?|head(?:er)?|masthead|comments?|disqus|repl(?:y|ies)|share|sharing|social|related|"
    r"recommend(?:ed|ations)?|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|widget|copyright|legal)(?:$|[\s_\d-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body-?text|prose)(?:$|[\s_-])", re.I)
#: Log-odds of content, in hundredths, by what stands above a block and by its text.
ODDS = {"article": 450, "main": 350, "content_name": 250, "nav": -800, "footer": -800, "header": -600, "aside": -800, "form": -800,
        "dialog": -800, "menu": -800, "boiler_name": -800, "head_in_article": 900, "bare": 100}
#: Smoothness of neighbours in page order, by the steps between them in the tree, in hundredths.
NEIGHBOUR, SIBLING = 80, 60

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                     r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


_UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)


@dataclass
class Block:
    text: str
    path: tuple[int, ...]  # element numbers from the root
    odds: int
    links: int  # characters inside links


def element_odds(tag: str, names: str, inside: int) -> int:
    """Log-odds that an element adds to the blocks below it."""
    odds = ODDS.get(tag, 0) if tag not in ("head_in_article", "bare") else 0
    if tag == "header" and inside > 0:
        odds += ODDS["head_in_article"]  # an article's own header holds its headline
    if names and tag not in ("html", "body"):
        if BOILER.search(names):
            odds += ODDS["boiler_name"]
        elif tag != "article" and CONTENT.search(names):
            odds += ODDS["content_name"]
    return odds


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. Unclosed, crossed and cut-off markup is taken as browsers do, roughly:
    an end tag closes up to its nearest opener of the scope, without one it is ignored."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, number, summed odds, hidden
    held: list[str] = []
    links = depth_a = number = 0

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, tuple(e[1] for e in stack if e[0] in BLOCK_TAGS), stack[-1][2], links))
            held.clear()
        links = 0

    def pop_to(i: int) -> None:
        nonlocal depth_a
        if any(e[0] in BLOCK_TAGS for e in stack[i:]):
            flush()
        depth_a -= sum(e[0] == "a" for e in stack[i:])
        del stack[i:]

    def text(piece: str) -> None:
        nonlocal links
        if piece and not stack[-1][3]:
            held.append(piece)
            if depth_a:
                links += len(piece)

    at = 0
    while True:
        lt = page.find("<", at)
        m = _MARKUP.match(page, lt) if lt >= 0 else None
        if lt < 0:
            text(page[at:])
            break
        if m is None:  # a bare "<" is text
            text(page[at:lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag not in BLOCK_TAGS and stack[i][0] in SCOPES:
                    break  # inline elements don't close blocks around them
            else:
                if tag in ("p", "br"):
                    flush()
            continue
        if tag in BLOCK_TAGS:
            flush()
            ends = ("p",) if tag in ENDS_P else ()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends or stack[i][0] in ENDS_LIKE.get(tag, ()):
                    pop_to(i)
                    if stack[-1][0] not in ENDS_LIKE.get(tag, ()):
                        break
                elif stack[i][0] in SCOPES:
                    break
        if tag in VOID_TAGS:
            continue
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(m[3])) if m[3] else ""
        above = stack[-1]
        hidden = above[3] or tag in HIDDEN_TAGS or bool(m[3] and _UNSEEN.search(m[3]))
        if tag == "body":  # ends an unclosed head
            hidden = False
        number += 1
        if m[3].endswith("/") and tag in ("svg", "math"):
            continue
        stack.append((tag, number, above[2] + element_odds(tag, names, above[2]), hidden))
        depth_a += tag == "a"
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if tag in ("script", "style", "iframe", "noembed", "noframes", "xmp") and not end:
                at = len(page)
            elif end:
                at = end.start()
    flush()
    return out


def classifier(block: Block) -> int:
    """Log-odds of content in hundredths: position, length, links and marks of sentences."""
    n = len(block.text)
    odds = block.odds + ODDS["bare"] + min(n, 400) // 2
    odds -= 300 * block.links // n
    if block.text[-1] in ".!?:;\"')”…":
        odds += 40
    return odds


def min_cut(odds: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Content side of the minimum cut.

    Node v pays ``odds[v]`` if it is content with negative odds or boilerplate with positive ones; an
    edge (u, v, w) pays w if its ends differ. Max-flow by Dinic's method: level search from all
    unsaturated sources at once, then blocking flow. What the source still reaches is content.
    """
    n = len(odds)
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for u, v, w in edges:
        out[u].append(len(to))
        out[v].append(len(to) + 1)
        to += [v, u]
        room += [w, w]
    supply = [max(o, 0) for o in odds]
    demand = [max(-o, 0) for o in odds]
    while True:
        level = [-1] * n
        queue = deque(v for v in range(n) if supply[v])
        for v in queue:
            level[v] = 0
        met = False
        while queue:
            u = queue.popleft()
            met = met or demand[u] > 0
            for e in out[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if not met:
            return [x >= 0 for x in level]
        following = [0] * n
        for s in range(n):
            while supply[s] and level[s] == 0:
                trail, u = [], s
                while not demand[u]:
                    while following[u] < len(out[u]):
                        e = out[u][following[u]]
                        if room[e] and level[to[e]] == level[u] + 1:
                            break
                        following[u] += 1
                    if following[u] == len(out[u]):  # dead end: step back
                        if not trail:
                            break
                        e = trail.pop()
                        u = to[e ^ 1]
                        following[u] += 1
                        continue
                    trail.append(e)
                    u = to[e]
                if not demand[u]:
                    break
                flow = min([supply[s], demand[u], *(room[e] for e in trail)])
                supply[s] -= flow
                demand[u] -= flow
                for e in trail:
                    room[e] -= flow
                    room[e ^ 1] += flow


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Neighbours in page order, weaker the more tree steps lie between them; and the last block of the same parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            a, k = found[i - 1].path, 0
            while k < min(len(a), len(b.path)) and a[k] == b.path[k]:
                k += 1
            steps = len(a) + len(b.path) - 2 * k
            out.append((i - 1, i, NEIGHBOUR // (1 + steps)))
        parent = b.path[:-1]
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, SIBLING))
        last[parent] = i
    return out


def main_blocks(page: str | None) -> list[str]:
    """Blocks labelled as content, in page order. NULL and empty pages have none."""
    found = blocks(page) if page else []
    return [b.text for b, keep in zip(found, min_cut([classifier(b) for b in found], edges(found))) if keep]


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``: kept blocks joined by one space; '' if none.

    Repeated rows keep a row each; extra columns are ignored.
    """
    def compute(values: list) -> list[dict]:
        texts = [" ".join(main_blocks(v)) for v in values]
        return [{"text": t, "n_chars": len(t)} for t in texts]

    return with_results(pages, ["page_id", "url"], compute, "text string, n_chars long", "html")
