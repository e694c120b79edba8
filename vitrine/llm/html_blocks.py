"""Blocks of a page: text between block boundaries, with the tags and attribute words above it."""
from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*)>)", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW = frozenset("script style template svg math canvas audio video textarea".split())
#: What an opening tag closes first, and at which tags the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, {"html"}),
}
#: Blocks that may stand inside a paragraph's line box do not end it; all others do.
KEEPS_P = frozenset("button iframe object option select optgroup noscript".split())


@dataclass
class Page:
    """One entry per block: its text, tokens of its path, and how many of its characters are in links."""

    texts: list[str] = field(default_factory=list)
    paths: list[tuple[str, ...]] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the words of its class, id, role and item names; ``hidden`` where it is not shown."""
    out = [tag]
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop"):
            out += [f".{p.lower()}" for p in _PIECE.findall(value)]
        elif bare or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out.append(".hidden")
    return tuple(dict.fromkeys(out))


def parse(source: str, known: dict[tuple[str, str], tuple[str, ...]]) -> Page:
    """Cut a page into blocks. ``known`` keeps the tokens of tags that came before.

    Tags that are never closed end with the block that holds them; ``<br>`` and any
    tag of a block part words, inline tags do not. Comments, scripts and styles
    give no text. White space in a block becomes one space.
    """
    page = Page()
    stack: list[tuple[str, tuple[str, ...]]] = []
    places: dict[str, list[int]] = {}  # of each tag, its places in the stack
    path: dict[str, int] = {}  # of each token on the path, how many open elements have it
    parts: list[str] = []
    linked, links = 0, 0
    at, n = 0, len(source)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                page.texts.append(text)
                page.paths.append(tuple(path))
                page.linked.append(linked)
            parts.clear()
        linked = 0

    def close(names: set[str] | frozenset[str], stops: set[str] | frozenset[str] = frozenset()) -> bool:
        last = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=-1)
        to = last(names)
        if to < 0 or last(stops) > to:
            return False
        while len(stack) > to:
            gone, tokens = stack.pop()
            places[gone].pop()
            for token in tokens:
                path[token] -= 1
                if not path[token]:
                    del path[token]
        return True

    while at < n:
        found = _TAG.search(source, at)
        if not found:
            parts.append(source[at:])
            linked += links and n - at
            break
        if found.start() > at:
            parts.append(source[at:found.start()])
            linked += links and found.start() - at
        at = found.end()
        tag = found[2] or found[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
        if closing:
            if tag in BLOCKS:
                flush()
                close({tag})
            elif tag == "a":
                links = 0
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in RAW and not attributes.endswith("/"):
            flush()
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if tag in BLOCKS:
            flush()
            links = 0
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag not in KEEPS_P:
                close({"p"}, {"table", "td", "th", "button", "object"})
            if tag not in VOID:
                key = (tag, attributes)
                tokens = known.get(key)
                if tokens is None:
                    if len(known) > 20_000:
                        known.clear()
                    tokens = known[key] = _tokens(tag, attributes)
                places.setdefault(tag, []).append(len(stack))
                stack.append((tag, tokens))
                for token in tokens:
                    path[token] = path.get(token, 0) + 1
        elif tag == "a":
            links = 1
        elif tag == "br":
            parts.append(" ")
    flush()
    return page
