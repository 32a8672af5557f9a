"""A web page as a tree of containers and text blocks, and the score of its containers.

No page is too broken: tags that HTML closes by itself are closed, stray end tags are ignored,
and what is cut off ends at the page's end. Inline tags leave no trace; block tags, rows, cells
and line breaks part blocks.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Names of HTML's elements by their kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label link mark meta nobr q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr"
    " main menu nav ol p pre section summary table ul".split()
) | _HEADINGS
_CONTAINERS = frozenset("article body center div main section td".split())
#: What a start tag closes, and the elements beyond which it does not look.
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_P_SCOPE = frozenset("table td th caption button object template".split())
#: Elements that hold no article text; a header does where it belongs to an article.
_NEVER = frozenset(
    "script style title head textarea iframe noembed noframes noscript template svg canvas audio video object select button"
    " option datalist dialog nav aside footer form menu".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class names and ids that tell what is not the article.
_OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promos promotion banner"
    " banners comment comments commentlist respond replies disqus discussion nav navbar navigation menu menus submenu breadcrumb"
    " breadcrumbs footer colophon sidebar sidebars widget widgets cookie cookies consent gdpr notice notices alert alerts popup"
    " modal overlay newsletter subscribe subscription signup login share sharing shares social related recommended"
    " recommendations pagination pager masthead topbar toolbar skip search copyright".split()
)
_PERHAPS = frozenset("header head top side rail aside".split())
_ARTICLE = frozenset("article content main body post story entry text blog page".split())
_LAYOUT = frozenset("with has no wrapper container layout".split())

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in _RAW}


@dataclass
class Block:
    """Text between two borders: its container, its characters, and those of links."""

    node: int
    text: str
    linked: int
    heading: bool


@dataclass
class Page:
    """Nodes in page order: parent, tag, path, depth, whether they are no article; and the blocks."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    step: list[str] = field(default_factory=lambda: [""])
    path: list[str] = field(default_factory=lambda: [""])
    depth: list[int] = field(default_factory=lambda: [0])
    other: list[bool] = field(default_factory=lambda: [False])
    semantic: list[bool] = field(default_factory=lambda: [False])
    end: list[int] = field(default_factory=lambda: [0])  # one more than the last node inside
    blocks: list[Block] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    if len(raw) < 3:
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _is_other(tag: str, words: list[str], role: str, in_article: bool) -> bool:
    if tag in _NEVER or role in _ROLES:
        return True
    if tag == "header":
        return not in_article
    if tag in ("html", "body", "main", "article") and not {"comment", "comments"} & set(words):
        return False
    names = set(words)
    if names & _LAYOUT and not {"comment", "comments", "ad", "ads", "cookie"} & names:
        return False
    return bool(names & _OTHER) or bool(names & _PERHAPS and not names & _ARTICLE and not in_article)


def parse(text: str) -> Page:
    """The page of a whole html text."""
    page = Page()
    # Open elements: (tag, node or -1 for an inline one). Text gathers until a border.
    stack: list[tuple[str, int]] = [("", 0)]
    pieces: list[str] = []
    counts: dict[tuple[int, str], int] = {}
    linked, links, node = 0, 0, 0

    def border() -> None:
        nonlocal linked
        if pieces:
            words = " ".join(html.unescape("".join(pieces)).split())
            if words:
                page.blocks.append(Block(node, words, min(linked, len(words)), page.tag[node] in _HEADINGS))
            pieces.clear()
        linked = 0

    def pop(to: int) -> None:
        """Closes the open elements from place ``to`` on."""
        nonlocal node, links
        if any(n >= 0 for _, n in stack[to:]):
            border()
        for tag, n in stack[to:]:
            if n >= 0:
                page.end[n] = len(page.tag)
            elif tag == "a":
                links -= 1
        del stack[to:]
        node = next(n for _, n in reversed(stack) if n >= 0)

    def close(names: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> None:
        """Closes the outermost open element of the names within the scope."""
        found = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in scope:
                break
            if stack[k][0] in names:
                found = k
        if found:
            pop(found)

    at = 0
    while at < len(text):
        m = _TAG.search(text, at)
        if not m:
            break
        if m.start() > at:
            pieces.append(text[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            place = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if tag in _INLINE:
                # An inline end tag closes nothing but inline elements.
                if place and all(n < 0 for _, n in stack[place:]):
                    pop(place)
            elif tag == "br" or tag == "p" and not place:
                border()
            elif place:
                pop(place)
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in _INLINE:
            attributes = _attributes(m[3]) if tag == "span" else {}
            if tag not in _VOID and not attributes:
                if tag == "a":
                    close({"a"}, _P_SCOPE)
                    links += 1
                stack.append((tag, -1))
            if not attributes:
                continue
        elif tag in _VOID:
            if tag in ("br", "hr"):
                border()
            continue
        else:
            attributes = _attributes(m[3])
        words = [w.lower() for w in _WORD.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")]
        in_article = any(page.tag[n] in ("article", "main") for _, n in stack if n >= 0)
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDDEN.search(attributes.get("style", "")))
        other = hidden or _is_other(tag, words, attributes.get("role", "").lower(), in_article)
        if tag == "span" and not other:
            stack.append((tag, -1))
            continue
        if tag in _CLOSES_P:
            close({"p"}, _P_SCOPE)
        if tag in _CLOSED_BY:
            close(*_CLOSED_BY[tag])
        if tag != "span":
            border()
        elif pieces:  # an advert within a line is a node of its own, and the line goes on after it
            border()
        names = ".".join(sorted({_DIGITS.sub("#", c) for c in attributes.get("class", "").split()}))
        step = tag if tag in ("html", "body") else tag + (f".{names}" if names else "") + (f"#{_DIGITS.sub('#', attributes['id'])}" if attributes.get("id") and tag not in ("html", "body") else "")
        named = step != tag or tag in ("article", "main", "body", "html")
        counts[(node, tag)] = counts.get((node, tag), 0) + (not named)
        parent = node
        page.parent.append(parent)
        page.tag.append(tag)
        page.step.append(step)
        page.path.append(f"{page.path[parent]}/{step}" + ("" if named else f"[{counts[(node, tag)]}]"))
        page.depth.append(page.depth[parent] + 1)
        page.other.append(other)
        page.semantic.append(not other and (tag == "article" or attributes.get("itemprop") == "articleBody"))
        page.end.append(0)
        node = len(page.tag) - 1
        stack.append((tag, node))
        if tag in _RAW:
            closing = _CLOSE[tag].search(text, at)
            at = closing.start() if closing else len(text)
    if at < len(text):
        pieces.append(text[at:])
        linked += (len(text) - at) * (links > 0)
    pop(1)
    border()
    page.end[0] = len(page.tag)
    return page


def _others_within(page: Page) -> list[int]:
    """Per node, the depth of the innermost element above or at it that is no article (-1: none)."""
    out = [-1] * len(page.tag)
    for n in range(1, len(page.tag)):
        out[n] = page.depth[n] if page.other[n] else out[page.parent[n]]
    return out


def text_of(page: Page, nodes: list[int]) -> str:
    """Text of the containers in page order, without what is no article inside them."""
    within, taken, end = _others_within(page), [], -1
    for n in sorted(nodes):
        if n >= end:
            end = page.end[n]
            taken += [(n, end)]
    out, k = [], 0
    for block in page.blocks:
        while k < len(taken) and block.node >= taken[k][1]:
            k += 1
        if k < len(taken) and block.node >= taken[k][0] and within[block.node] <= page.depth[taken[k][0]]:
            out.append(block.text)
    return " ".join(out)


def _lines(page: Page) -> set[int]:
    """Containers that serve as paragraphs: without elements of their own, beside others of their kind."""
    seen: dict[tuple[int, str], list[int]] = {}
    for n in range(1, len(page.tag)):
        if page.tag[n] in ("div", "section") and page.end[n] == n + 1:
            seen.setdefault((page.parent[n], page.step[n]), []).append(n)
    return {n for same in seen.values() if len(same) > 1 for n in same}


def scores(page: Page) -> dict[int, float]:
    """Score of the containers: a block's characters outside links, less what it loses by links, for
    its container, half for the next one above, a third for the one above that. The body and what
    is above it have what lies in them directly, as they hold everything."""
    within, lines, out = _others_within(page), _lines(page), {}

    def container(n: int) -> int:
        while n and (page.tag[n] not in _CONTAINERS or n in lines):
            n = page.parent[n]
        return n

    for block in page.blocks:
        if within[block.node] >= 0:
            continue
        worth = float(max(len(block.text) - 2 * block.linked, 0))
        n = container(block.node)
        for share in (1, 2, 3):
            if share > 1 and (not n or page.tag[n] == "body"):
                break
            out[n] = out.get(n, 0.0) + worth / share
            n = container(page.parent[n]) if n else 0
    return out


def _climbed(page: Page, n: int, within: list[int]) -> int:
    """The highest container whose further text is only headings, or containers of the same kind."""
    while n and page.parent[n] > 0 and page.tag[page.parent[n]] in _CONTAINERS - {"body"}:
        up, step = page.parent[n], page.step[n]
        more = False
        for block in page.blocks:
            if up <= block.node < page.end[up] and not n <= block.node < page.end[n] and within[block.node] < 0:
                child = block.node
                while child != up and page.parent[child] != up:
                    child = page.parent[child]
                if not block.heading and (child == up or page.step[child] != step):
                    more = True
                    break
        if more:
            return n
        n = up
    return n


def candidates(page: Page) -> list[tuple[int, float]]:
    """Containers that may be the article, best first, with their share of the page's text (0 to 1).

    A sole ``article`` element that is not nested in another wins. Otherwise the best score
    does, and with it those apart from it that have three tenths of its score.
    """
    within = _others_within(page)
    worth = [(b.node, max(len(b.text) - 2 * b.linked, 0)) for b in page.blocks if within[b.node] < 0]
    total = sum(w for _, w in worth)
    if not total:
        return []

    def share(n: int) -> float:
        return sum(w for k, w in worth if n <= k < page.end[n]) / total

    marked, end = [], -1
    for n in range(1, len(page.tag)):
        if page.semantic[n] and n >= end and within[n] < 0:
            marked.append(n)
            end = page.end[n]
    if len(marked) == 1 and share(marked[0]) > 0:
        return [(marked[0], share(marked[0]))]
    found = sorted(scores(page).items(), key=lambda x: (-x[1], x[0]))
    out: list[tuple[int, float]] = []
    for n, score in found:
        if out and score < 0.3 * found[0][1]:
            break
        n = _climbed(page, n, within)
        if all(n >= page.end[k] or k >= page.end[n] for k, _ in out):
            out.append((n, share(n)))
    return out
