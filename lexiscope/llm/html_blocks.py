"""HTML pages to leaf blocks with their paths and feature vectors (helpers of the block labeller)."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass, field

import numpy as np

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)>"  # quotes count after "=" only
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")
#: Elements by behaviour (fixed values).
BLOCK = frozenset("address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split())
#: Controls that stand inside a line: their own text is a block, the line around them goes on.
CONTROLS = frozenset("button select textarea datalist output".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe object title math canvas audio video".split())
#: Elements whose content isn't markup but runs to their own end tag; in svg and math it is markup.
RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.IGNORECASE) for n in "script style noscript iframe title textarea xmp".split()}
HEAD_END = re.compile(r"(?:</head|<body)(?=[\s/>]|\Z)", re.IGNORECASE)
SCRIPT = re.compile(r"<!--(-*>)?|-->|<(/?)script(?=[\s/>]|\Z)", re.IGNORECASE)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Names in tags, classes, ids and roles by what they stand for (fixed values).
ROLES = {
    "main": "article main content post entry story body text",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs",
    "header": "header masthead topbar logo branding",
    "footer": "footer copyright colophon contentinfo",
    "side": "aside sidebar side rail widget related recommended trending complementary",
    "notice": "notice banner cookie cookies consent alert popup modal overlay gdpr toast dialog disclaimer",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion adsense",
    "form": "form input button select option textarea fieldset label search login signup subscribe newsletter",
    "comment": "comment comments reply replies respond disqus discussion reviews feedback",
    "share": "share sharing social follow tags meta byline",
    "heading": "h1 h2 h3 h4 h5 h6",
    "paragraph": "p pre blockquote",
    "list": "li ul ol dl dt dd",
    "table": "table tr td th",
}
ROLE_OF = {name: i for i, names in enumerate(ROLES.values()) for name in names.split()}
PATH_DIMS, WORD_DIMS, NUMBERS = 24, 16, 5
WIDTH = len(ROLES) + PATH_DIMS + WORD_DIMS + NUMBERS


@dataclass
class Leaf:
    """A block of text between block-level tags."""

    path: tuple[tuple[str, ...], ...]
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def raw_end(page: str, name: str, at: int) -> int:
    """Where the end tag of the raw element ``name`` begins whose content begins at ``at``; -1 without one.

    In a script, "<!-- <script" hides one "</script" up to "-->", as in browsers, unless that leaves no end at all.
    """
    first = RAW[name].search(page, at)
    if first is None or name != "script":
        return first.start() if first else -1
    escaped = nested = False
    for m in SCRIPT.finditer(page, at):
        if m[2] is None:
            escaped, nested = (escaped, nested) if m[1] else (True, nested) if m[0] != "-->" else (False, False)
        elif m[2] and not nested:
            return m.start()
        elif escaped:
            nested = not m[2]
    return first.start()


def leaves(page: str | None) -> list[Leaf]:
    """Blocks of a page in order. Scripts, styles, comments and the title aren't blocks."""
    page = page or ""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...], Leaf | None]] = []
    leaf, hidden, depth, at, in_link = None, "", 0, 0, 0
    in_head: bool | None = None
    endless: set[str] = set()

    def close(names: frozenset | set, stop: frozenset = frozenset(("div", "ul", "ol", "table", "td", "body"))) -> None:
        nonlocal in_link, leaf
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                in_link -= sum(x[0] == "a" for x in stack[i:])
                if stack[i][0] in CONTROLS:
                    leaf = stack[i][2]
                del stack[i:]
                return
            if stack[i][0] in stop - names:
                return

    def add(raw: str) -> None:
        nonlocal leaf
        if not hidden and raw:
            if leaf is None:
                if raw.isspace():
                    return
                leaf = Leaf(tuple(names for _, names, _ in stack))
                out.append(leaf)
            leaf.parts.append(html.unescape(raw) if "&" in raw else raw)
            if in_link:
                leaf.linked += len(raw)

    def content_end(name: str) -> int:
        """Where raw content from ``at`` on ends. Without an end tag: of hidden elements with the head or page, else -1."""
        end = -1 if name in endless else raw_end(page, name, at)
        if end >= 0:
            return end
        endless.add(name)
        if name not in HIDDEN:
            return -1
        m = HEAD_END.search(page, at) if in_head else None
        return m.start() if m else len(page)

    while m := MARKUP.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), m[1]
        opens = not closing and not m[3].endswith("/")
        of_head = tag == "head" or (tag == "body" and not closing)
        if hidden:
            if in_head and of_head:
                hidden = ""
            else:
                if tag == hidden and (closing or opens):
                    depth += -1 if closing else 1
                    hidden = hidden if depth else ""
                elif opens and tag in RAW and hidden not in ("svg", "math"):
                    at = max(at, content_end(tag))
                continue
        if of_head:
            in_head = in_head is None and tag == "head" and not closing
        if tag == "head":
            leaf = None
            continue
        if tag in HIDDEN:
            if opens and tag in RAW:
                at = content_end(tag)
            elif opens:
                hidden, depth = tag, 1
            continue
        around = leaf
        if tag in BLOCK or tag in CONTROLS:
            leaf = None
        if closing:
            close({tag}, frozenset() if tag in BLOCK else frozenset(("p", "div", "li", "td", "article", "section")))
        elif tag not in VOID:
            if tag in ENDS_P:
                close({"p"})
            if tag in CLOSES:
                close(CLOSES[tag])
            words = [tag]
            if "=" in m[3]:
                words += [n for a in ATTRIBUTE.finditer(m[3]) for n in NAME.findall((a[1] or a[2] or a[3] or "").lower())]
            stack.append((tag, tuple(words), around if tag in CONTROLS else None))
            in_link += tag == "a"
            if tag in RAW and (end := content_end(tag)) >= 0:
                add(page[at:end])
                at = end
    add(page[at:])
    return [x for x in out if x.text]


class Features:
    """Feature rows of leaf sequences; remembers hashed names and words."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, float]] = {}
        self.paths: dict[tuple, np.ndarray] = {}

    def place(self, word: str, dims: int) -> tuple[int, float]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            h = zlib.crc32(word.encode("utf-8", "replace"))
            found = self.known[word] = (h >> 1, 1.0 if h & 1 else -1.0)
        return found[0] % dims, found[1]

    def path(self, path: tuple[tuple[str, ...], ...]) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) > 50_000:
                self.paths.clear()
            v = np.zeros(len(ROLES) + PATH_DIMS, dtype=np.float32)
            for names in path:
                for n in names:
                    if n in ROLE_OF:
                        v[ROLE_OF[n]] = 1.0
                    i, sign = self.place(n, PATH_DIMS)
                    v[len(ROLES) + i] += 0.3 * sign
            self.paths[path] = v
        return self.paths[path]

    def rows(self, page: list[Leaf]) -> np.ndarray:
        x = np.zeros((len(page), WIDTH), dtype=np.float32)
        first = len(ROLES) + PATH_DIMS
        for k, leaf in enumerate(page):
            text = leaf.text
            words = text.lower().split()
            x[k, :first] = self.path(leaf.path)
            for w in words:
                i, sign = self.place(w, WORD_DIMS)
                x[k, first + i] += sign
            x[k, first : first + WORD_DIMS] *= 0.5 / len(words) ** 0.5
            stops = sum(map(text.count, ".,;!?"))
            x[k, first + WORD_DIMS :] = (np.log1p(len(text)) / 6, leaf.linked / max(1, len(text)), min(1.0, 5 * stops / len(text)), k / len(page), min(1.0, len(leaf.path) / 10))
        return x
