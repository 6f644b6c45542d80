"""Lenient HTML reading: one page in, its elements and text runs out.

This is the only per-page Python in the package. It follows the tokenizer and the cheap
tree-repair rules of the HTML Living Standard; choosing, pruning and assembling is left to
Spark expressions (see ``operators.extract``). Every pattern is possessive, an end tag looks at
a bounded number of open elements, and only tags asked for are listed per scope, so reading is
linear in the size of the page.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from html import unescape
from html.entities import html5

from pagequarry.settings import NOISE_TAGS

# Fixed values from the HTML standard.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW_TEXT = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base link meta script style title template noscript".split())
CLOSES_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu "
    "nav ol p plaintext pre search section summary table ul xmp".split()
)
SPECIAL = CLOSES_P | frozenset(
    "applet body button caption col colgroup frameset head html iframe marquee noembed "
    "noframes noscript object script select style tbody td template textarea tfoot th thead "
    "title tr".split()
)
SCOPE = frozenset(
    "applet button caption html marquee object table td template th".split()
)
# start tag -> (open elements it ends, elements the search for them does not leave)
ENDS = {
    "li": ({"li"}, SPECIAL - {"address", "div", "p", "li"}),
    "dd": ({"dd", "dt"}, SPECIAL - {"address", "div", "p", "dd", "dt"}),
    "dt": ({"dd", "dt"}, SPECIAL - {"address", "div", "p", "dd", "dt"}),
    "a": ({"a"}, SCOPE),
    "button": ({"button"}, SCOPE - {"button"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table", "template"}),
    "td": ({"td", "th"}, {"tr", "table", "template"}),
    "th": ({"td", "th"}, {"tr", "table", "template"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table", "template"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table", "template"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table", "template"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Text below these is of its own kind and is only seen by the element itself.
TEXT_CONTAINERS = ("rt", "rp", "style", "script", "template")

# barrier for the search of an end tag's element
_END_BARRIERS = {tag: SCOPE - {tag} for tag in SPECIAL} | {"li": SCOPE | {"ol", "ul"}}
# start tags that can do more than add an element to the body
_STRUCTURAL = frozenset(["html", "head", "body", "frameset", *HEAD_ONLY, *CLOSES_P, *ENDS, *HEADINGS])

# open elements looked at one by one before those further down are found by their tag
_NEAR = 48

# text, then a tag without attributes: by far the most frequent tokens
_SIMPLE = re.compile(r"([^<]*+)<(/?)([A-Za-z][A-Za-z0-9]*+)>")
_OPEN = re.compile(r"<(?:!(--)|(/?)([A-Za-z][^\t\n\f\r />]*+)|[!?/])")
_COMMENT_END = re.compile(r"-->|(?<!<!)--!>")
_TAG_REST = re.compile(
    r"((?:[\t\n\f\r /]*+[^\t\n\f\r />][^\t\n\f\r />=]*+"
    r"(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:\"[^\"]*+\"|'[^']*+'|[^\t\n\f\r >\"'][^\t\n\f\r >]*+))?+)*+)"
    r"([\t\n\f\r /]*+)>"
)
_HREF = re.compile(
    r"[\t\n\f\r /]*+([^\t\n\f\r />][^\t\n\f\r />=]*+)"
    r"(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\t\n\f\r >\"'][^\t\n\f\r >]*+)))?+"
)
_RAW_END = {
    tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in RAW_TEXT | ESCAPABLE_RAW_TEXT
}
_REFERENCE = re.compile(r"&(#\w+;?|\w+;|\w+(?![\w=]))", re.A)


def _href(attributes: str) -> str | None:
    """Decoded value of the first ``href``; "" when it has none, None when there is no href."""
    for name, *values in _HREF.findall(attributes):
        if name.lower() == "href":
            return _REFERENCE.sub(
                lambda m: unescape(m[0]) if m[1][0] == "#" or m[1] in html5 else m[0],
                "".join(values),
            )
    return None


class PageReader:
    """Elements and text runs of one page, in document order.

    An element covers the half-open range ``first..last`` of text runs below it. ``scopes``
    lists the distinct sets of open tags, as far as they are among ``scope_tags``; elements
    (themselves included) and text runs point into it, so "is this inside a nav?" is one lookup.
    """

    def __init__(self, html: str, scope_tags: Collection[str] = NOISE_TAGS):
        self._scope_tags = frozenset(scope_tags)
        self.scopes: list[list[str]] = [[]]
        self.scope_kinds: list[str | None] = [None]
        self.tags: list[str] = []
        self.element_scopes: list[int] = []
        self.firsts: list[int] = []
        self.lasts: list[int] = []
        self.hrefs: list[str | None] = []
        self.texts: list[str] = []
        self.text_scopes: list[int] = []

        self._stack: list[tuple[str, int, int]] = []  # tag, element, scope
        self._open: dict[str, list[int]] = {}  # by tag, the depths of its open elements
        self._scope_ids: dict[tuple[int, str], int] = {}
        self._has_body = False
        self._pending: list[str] = []
        self._read(html)

    # -- tokens ------------------------------------------------------------------------

    def _read(self, html: str) -> None:
        position, size = 0, len(html)
        simple, pending = _SIMPLE.match, self._pending
        while position < size:
            token = simple(html, position)
            if token is not None:
                text, closing, tag = token.groups()
                if text:
                    pending.append(unescape(text) if "&" in text else text)
                position, tag, attributes, empty = token.end(), tag.lower(), "", tag in VOID
            else:
                token = _OPEN.search(html, position)
                text = html[position : token.start() if token else size]
                if text:
                    pending.append(unescape(text) if "&" in text else text)
                if token is None:
                    break
                if token[3] is None:  # a comment, or something like one
                    self._flush()
                    if token[1]:
                        end = _COMMENT_END.search(html, token.start() + 2)
                        position = end.end() if end else size
                    else:
                        position = html.find(">", token.end() - 1) + 1 or size
                    continue
                rest = _TAG_REST.match(html, token.end())
                if rest is None:
                    break  # a tag cut off by the end of the page
                closing, tag, position, attributes = token[2], token[3].lower(), rest.end(), rest[1]
                empty = tag in VOID or rest[2].endswith("/")
            if closing:
                self._end_tag(tag)
                continue
            self._start_tag(tag, _href(attributes) if tag == "a" else None, empty)
            if tag in _RAW_END and not empty:
                end = _RAW_END[tag].search(html, position)
                stop = end.start() if end else size
                raw = html[position:stop]
                pending.append(unescape(raw) if tag in ESCAPABLE_RAW_TEXT else raw)
                position = stop
        self._flush()
        self._pop_to(0)

    # -- tree --------------------------------------------------------------------------

    def _start_tag(self, tag: str, href: str | None, empty: bool) -> None:
        stack, count = self._stack, self._open.get
        if tag in _STRUCTURAL:
            if (
                tag == "html" and self.tags
                or tag == "body" and self._has_body
                or tag == "head" and (self._has_body or "head" in self._open)
            ):
                return
            self._flush()
            if tag == "body":
                self._enter_body(implied=False)
            elif not (tag in HEAD_ONLY or tag in ("html", "head", "frameset") or count("template")):
                self._enter_body()
            if tag in CLOSES_P and count("p"):
                self._close(("p",), SCOPE)
            if tag in ENDS:
                ended, barrier = ENDS[tag]
                if any(map(count, ended)):
                    self._close(ended, barrier)
            if tag in HEADINGS and stack and stack[-1][0] in HEADINGS:
                self._pop_to(len(stack) - 1)
        else:
            self._flush()
            if not self._has_body and not count("template"):
                self._enter_body()
        self._push(tag, href)
        if empty:
            self._pop_to(len(stack) - 1)

    def _end_tag(self, tag: str) -> None:
        if tag in ("html", "body") or not self._open.get(tag):
            return  # what follows the end of the body still belongs to it
        self._flush()
        self._close((tag,), _END_BARRIERS.get(tag, SPECIAL))

    def _close(self, tags, barrier) -> None:
        """End the nearest open element of ``tags`` unless one of ``barrier`` comes first."""
        stack = self._stack
        near = max(0, len(stack) - _NEAR)
        for depth in range(len(stack) - 1, near - 1, -1):
            tag = stack[depth][0]
            if tag in tags:
                return self._pop_to(depth)
            if tag in barrier:
                return
        if near:  # deeper down, only the topmost element of each tag is looked at
            depth = max((self._open[t][-1] for t in tags if self._open.get(t)), default=-1)
            if depth >= 0 and all(self._open[t][-1] < depth for t in barrier if self._open.get(t)):
                self._pop_to(depth)

    def _enter_body(self, implied: bool = True) -> None:
        if not self._has_body:
            self._has_body = True
            self._pop_to(1 if self._stack and self._stack[0][0] == "html" else 0)
            if implied:
                self._push("body", None)

    def _push(self, tag: str, href: str | None) -> None:
        stack, tags = self._stack, self.tags
        parent = stack[-1][2] if stack else 0
        scope = self._scope_ids.get((parent, tag))
        if scope is None:
            scope = self._new_scope(parent, tag)
        self._open.setdefault(tag, []).append(len(stack))
        stack.append((tag, len(tags), scope))
        tags.append(tag)
        self.element_scopes.append(scope)
        self.firsts.append(len(self.texts))
        self.lasts.append(-1)
        self.hrefs.append(href)

    def _new_scope(self, parent: int, tag: str) -> int:
        kind = tag if tag in TEXT_CONTAINERS else self.scope_kinds[parent]
        listed = tag not in self._scope_tags or tag in self.scopes[parent]
        if listed and kind == self.scope_kinds[parent]:
            scope = parent
        else:
            scope = len(self.scopes)
            self.scopes.append(self.scopes[parent] if listed else [*self.scopes[parent], tag])
            self.scope_kinds.append(kind)
        self._scope_ids[parent, tag] = scope
        return scope

    def _pop_to(self, depth: int) -> None:
        stack, last = self._stack, len(self.texts)
        while len(stack) > depth:
            tag, element, _ = stack.pop()
            self._open[tag].pop()
            self.lasts[element] = last

    def _flush(self) -> None:
        """Store the pending text run below the innermost open element."""
        pending, stack = self._pending, self._stack
        if not pending:
            return
        text = pending[0] if len(pending) == 1 else "".join(pending)
        pending.clear()
        if not text:
            return
        if not self._has_body and (not stack or stack[-1][0] in ("html", "head")):
            if text.isspace():
                return
            self._enter_body()
            self._push("p", None)  # bare text makes a paragraph of its own
        self.texts.append(text)
        self.text_scopes.append(stack[-1][2] if stack else 0)
