"""A small, forgiving HTML reader: enough of the tree-building rules for text extraction.

A page is read in one pass into its block elements - nested as a browser would nest them - and the
blocks of text in them. Inline elements are no nodes: their text is their block's.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

# Element names of HTML, by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
# A start tag on the left ends an open element on the right, up to the given limits.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_P_LIMITS = BLOCK - {"p"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?P<close>>|\Z)",
    re.S,
)
# A quote opens a value only after "="; a stray one is a character of its tag.
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
#: Attributes that say what an element is; a tag without one of these words isn't looked into.
_MARKED = re.compile(r"class|\bid\b|role|hidden", re.I)

# Elements that never hold article text, and words of a class, id or role that say so.
BOILER_TAGS = frozenset(
    "head title script style noscript template iframe nav header footer aside form button select option textarea input "
    "label fieldset dialog menu svg canvas object embed audio video map".split()
)
BOILER_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side aside header masthead topbar footer foot cookie cookies consent gdpr notice "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations trending comment comments respond reply replies disqus widget toolbar pagination pager search legal "
    "copyright skip hidden".split()
)
CONTENT_TAGS = ("article", "main")


@dataclass(frozen=True)
class Kind:
    """What a start tag says: its element, its name in a tree (with classes, digits as 0), and whether
    the element (never) or only its class, id or role (not) is that of article text."""

    tag: str
    name: str
    never: bool = False
    marked: bool = False
    content: bool = False


@dataclass
class Page:
    """Block elements in page order, the root first, and blocks of text."""

    kinds: list[Kind] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    path: list[int] = field(default_factory=list)  # a hash of the names down to a node
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, characters in links


_kinds: dict[tuple[str, str], Kind] = {}


def kind_of(tag: str, attrs: str) -> Kind:
    key = (tag, attrs if _MARKED.search(attrs) else "")
    got = _kinds.get(key)
    if got is None:
        if len(_kinds) > 50_000:
            _kinds.clear()
        got = _kinds[key] = _kind(*key)
    return got


def _kind(tag: str, attrs: str) -> Kind:
    a = {n.lower(): html.unescape(v.strip("\"'")) for n, v in _ATTR.findall(attrs)}
    classes = {*a.get("class", "").lower().split(), *(["#" + a["id"].lower()] if a.get("id") else [])}
    name = ".".join([tag, *sorted({re.sub(r"\d+", "0", m) for m in classes})])
    if tag in BOILER_TAGS:
        return Kind(tag, name, never=True)
    content = tag in CONTENT_TAGS or a.get("role", "").lower() == "main"
    if tag in ("html", "body", *CONTENT_TAGS):
        return Kind(tag, name, content=content)
    marks = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}").lower()
    marked = any(w in BOILER_WORDS for w in re.findall(r"[a-z]+", marks))
    return Kind(tag, name, "hidden" in a or a.get("aria-hidden") == "true", marked, content and not marked)


_ROOT = Kind("#root", "#root")


def read(source: str | None) -> Page:
    """Never fails; unclosed elements end with their parents. Depth costs no recursion."""
    page = Page([_ROOT], [-1], [0])
    source = source or ""
    # open elements: tag, node, is a block, inside a link, inside an inline element that holds no text
    stack: list[tuple[str, int, bool, bool, bool]] = [("#root", 0, True, False, False)]
    pending: list[str] = []
    links = 0
    at = 0
    hashed: dict[tuple[int, str], int] = {}

    def flush(node: int) -> None:
        nonlocal links
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                page.blocks.append((node, text, min(links, len(text))))
        links = 0

    def text_to(upto: int) -> None:
        nonlocal links
        if upto > at and not stack[-1][4]:
            piece = source[at:upto]
            if "&" in piece:
                piece = html.unescape(piece)
            pending.append(piece)
            if stack[-1][3]:
                links += len(piece.strip())

    def close(names, limits) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                for _, node, is_block, _, _ in reversed(stack[i:]):
                    if is_block:
                        flush(node)
                del stack[i:]
                return
            if stack[i][0] in limits:
                return

    search = _TOKEN.search
    while m := search(source, at):
        text_to(m.start())
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            close((tag,), () if tag in BLOCK else {"td", "th", "article", "body"} - {tag})
            continue
        block = tag in BLOCK
        if block:
            close(("p",), _P_LIMITS)
        if tag in CLOSES:
            close(*CLOSES[tag])
        attrs = m["attrs"]
        _, node, _, linked, silent = stack[-1]
        if not silent:
            kind = kind_of(tag, attrs)
            if block:
                flush(node)
                key = (page.path[node], kind.name)
                if key not in hashed:
                    hashed[key] = xxhash.xxh64_intdigest(f"{key[0]}/{kind.name}") >> 1
                page.kinds.append(kind)
                page.parent.append(node)
                page.path.append(hashed[key])
                node = len(page.kinds) - 1
            elif kind.never or kind.marked:  # an inline advert or button leaves its block whole
                silent = True
            elif tag == "br":
                pending.append(" ")
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else len(source)
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            stack.append((tag, node, block and not silent, linked or tag == "a", silent))
        elif block and not silent:
            flush(node)
    text_to(len(source))
    for _, node, is_block, _, _ in reversed(stack):
        if is_block:
            flush(node)
    return page
