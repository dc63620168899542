"""HTML tokens.

``scan`` walks a document and calls a sink, which may veto a text element's mode
(its answer to ``open_tag``) and may stop the walk. It works on slices found by
compiled patterns, never character by character, in time linear in the document.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

from ..functions.entities import decode_attribute, decode_entities
from ..functions.text import SPACE, ascii_lower

RAW_TEXT = frozenset("script style iframe xmp noembed noframes".split())
RCDATA = frozenset("title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: A tag without attributes.
BARE_TAG = re.compile(r"<(/?)([A-Za-z][^ \t\n\f\r/>]*)>")
NAME = re.compile(r"[^ \t\n\f\r/>]+")
GAP = re.compile(r"[ \t\n\f\r/]*")
ATTR_NAME = re.compile(r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*")
EQUALS = re.compile(r"[ \t\n\f\r]*=[ \t\n\f\r]*")
UNQUOTED = re.compile(r"[^ \t\n\f\r>]*")
COMMENT_END = re.compile(r"--!?>")
OPEN_COMMENT_TAIL = re.compile(r"(?:--!|--|-)\Z")
DOCTYPE = re.compile(r"<!doctype", re.IGNORECASE)
TEXT_END = {n: re.compile(rf"</{n}(?=[ \t\n\f\r/>])", re.IGNORECASE) for n in RAW_TEXT | RCDATA}
#: A character reference that what follows may still lengthen.
OPEN_REFERENCE = re.compile(r"&(?:#[xX]?[0-9a-fA-F]*|[A-Za-z0-9]*)\Z")
DECLARATIONS = ("<!--", "<!doctype", "<![cdata[")
SCRIPT_MARK = re.compile(r"<!--(?!-?>)|-->|<(/?)script(?=[ \t\n\f\r/>])", re.IGNORECASE)

RawAttr = tuple[str, str | None]


class Sink(Protocol):
    def open_tag(self, name: str, attrs: list[RawAttr], self_closing: bool) -> bool: ...
    def close_tag(self, name: str) -> None: ...
    def text(self, raw: str, decode: bool) -> None: ...
    def comment(self, data: str) -> None: ...
    def doctype(self, data: str) -> None: ...
    def cdata(self, data: str) -> None: ...
    def should_continue(self) -> bool: ...


def read_attributes(html: str, at: int) -> tuple[list[RawAttr], bool, int] | None:
    """(attributes as written, whether a slash ends the tag, position after its ">"). None: the input ends first."""
    attrs: list[RawAttr] = []
    n = len(html)
    after_value = False
    while True:
        gap = GAP.match(html, at)
        end = gap.end()
        if end >= n:
            return None
        if html[end] == ">":
            slash = html[end - 1] == "/" and end > at if after_value else html[end - 1] == "/"
            return attrs, slash, end + 1
        name = ATTR_NAME.match(html, end)
        at = name.end()
        value = None
        after_value = False
        if eq := EQUALS.match(html, at):
            at = eq.end()
            if at >= n:
                return None
            quote = html[at]
            if quote in "\"'":
                close = html.find(quote, at + 1)
                if close < 0:
                    return None
                value, at = html[at + 1 : close], close + 1
            else:
                m = UNQUOTED.match(html, at)
                value, at = m[0], m.end()
                after_value = True
        attrs.append((name[0], value))


def first_wins(attrs: list[RawAttr]) -> list[RawAttr]:
    """Attributes decoded; of names that differ in ASCII case only the first stays."""
    if not attrs:
        return attrs
    seen: set[str] = set()
    out = []
    for name, value in attrs:
        key = ascii_lower(name)
        if key not in seen:
            seen.add(key)
            out.append((name, value if value is None else decode_attribute(value)))
    return out


def script_end(html: str, at: int) -> int:
    """Where the end tag of a script begins, or -1."""
    state = 0  # 1: escaped, 2: doubly so
    for m in SCRIPT_MARK.finditer(html, at):
        mark = m[0]
        if mark == "-->":
            state = 0
        elif mark == "<!--":
            state = state or 1
        elif m[1]:
            if state < 2:
                return m.start()
            state = 1
        elif state == 1:
            state = 2
    return -1


def ends_here(html: str, lt: int) -> bool:
    """Whether the declaration, end tag or text element that begins at lt ends in html, so that nothing after html changes it."""
    if html.startswith("<!", lt):
        rest = html[lt : lt + 9].lower()
        if any(d.startswith(rest) and d != rest for d in DECLARATIONS):
            return False
        if rest.startswith("<!--"):
            return html.startswith((">", "->"), lt + 4) or COMMENT_END.search(html, lt + 4) is not None
        return html.find("]]>" if html.startswith("<![CDATA[", lt) else ">", lt) >= 0
    if html[lt + 1] in "/?":
        return html.find(">", lt) >= 0
    name = ascii_lower(NAME.match(html, lt + 1)[0])
    if name == "script":
        got = read_attributes(html, lt + 7)
        return got is not None and script_end(html, got[2]) >= 0
    return name != "plaintext" and (name not in TEXT_END or TEXT_END[name].search(html, lt) is not None)


def scan(html: str, sink: Sink, final: bool = True) -> int:
    """Returns how many characters were read: all, or up to where the sink stopped it. If html isn't final, more is to come, and
    what that may still change isn't read: a construct that doesn't end here, a reference at the end."""
    at, n = 0, len(html)
    find, bare = html.find, BARE_TAG.match
    on_text, on_open, on_close, go_on = sink.text, sink.open_tag, sink.close_tag, sink.should_continue
    while at < n:
        if not go_on():
            return at
        lt = find("<", at)
        if lt >= 0 and (m := bare(html, lt)) and (final or m[1] or ends_here(html, lt)):
            if lt > at:
                on_text(html[at:lt], True)
            at = m.end()
            if m[1]:
                on_close(m[2])
            elif on_open(m[2], [], False):
                tag = ascii_lower(m[2])
                if tag in TEXT_END:
                    at = text_element(html, at, tag, sink)
                elif tag == "plaintext":
                    if at < n:
                        on_text(html[at:], False)
                    return n
            continue
        if lt < 0 or lt + 1 >= n:
            end = n
            if not final:
                end = lt if lt >= 0 else m.start() if (m := OPEN_REFERENCE.search(html, at)) else n
            if end > at:
                sink.text(html[at:end], True)
            return end
        c = html[lt + 1]
        if not final and (c in "/!?" or c.isascii() and c.isalpha()) and (lt + 2 >= n or not ends_here(html, lt)):
            if lt > at:
                sink.text(html[at:lt], True)
            return lt
        if ("a" <= c <= "z") or ("A" <= c <= "Z"):
            if lt > at:
                sink.text(html[at:lt], True)
            name = NAME.match(html, lt + 1)
            end = name.end()
            if end < n and html[end] == ">":
                attrs, slash, at = [], False, end + 1
            else:
                got = read_attributes(html, end)
                if got is None:
                    return n if final else lt
                attrs, slash, at = got
            opened = sink.open_tag(name[0], attrs, slash)
            if opened:
                tag = ascii_lower(name[0])
                if tag in TEXT_END:
                    at = text_element(html, at, tag, sink)
                elif tag == "plaintext":
                    if at < n:
                        sink.text(html[at:], False)
                    return n
        elif c == "/":
            if lt + 2 >= n:
                sink.text(html[at:], True)
                return n
            d = html[lt + 2]
            if lt > at:
                sink.text(html[at:lt], True)
            if d == ">":
                at = lt + 3
            elif ("a" <= d <= "z") or ("A" <= d <= "Z"):
                name = NAME.match(html, lt + 2)
                end = name.end()
                if end < n and html[end] == ">":
                    at = end + 1
                else:
                    got = read_attributes(html, end)
                    if got is None:
                        return n if final else lt
                    at = got[2]
                sink.close_tag(name[0])
            else:
                at = bogus(html, lt + 2, sink)
        elif c == "!":
            if lt > at:
                sink.text(html[at:lt], True)
            at = declaration(html, lt, sink)
        elif c == "?":
            if lt > at:
                sink.text(html[at:lt], True)
            at = bogus(html, lt + 1, sink)
        else:
            # text up to the next "<" that can begin markup
            sink.text(html[at : lt + 1], True)
            at = lt + 1
    return n


def text_element(html: str, at: int, tag: str, sink: Sink) -> int:
    """The text of a text element; position of its end tag, or the end."""
    if tag == "script":
        end = script_end(html, at)
    else:
        m = TEXT_END[tag].search(html, at)
        end = m.start() if m else -1
    if end < 0:
        end = len(html)
    if end > at:
        sink.text(html[at:end], tag in RCDATA)
    return end


def bogus(html: str, at: int, sink: Sink) -> int:
    end = html.find(">", at)
    if end < 0:
        sink.comment(html[at:])
        return len(html)
    sink.comment(html[at:end])
    return end + 1


def declaration(html: str, lt: int, sink: Sink) -> int:
    n = len(html)
    if html.startswith("<!--", lt):
        at = lt + 4
        if html.startswith(">", at) or html.startswith("->", at):
            sink.comment("")
            return html.index(">", at) + 1
        m = COMMENT_END.search(html, at)
        if m:
            sink.comment(html[at : m.start()])
            return m.end()
        sink.comment(OPEN_COMMENT_TAIL.sub("", html[at:]))
        return n
    if DOCTYPE.match(html, lt):
        end = html.find(">", lt)
        sink.doctype(html[lt + 9 : end if end >= 0 else n].strip(SPACE))
        return end + 1 if end >= 0 else n
    if html.startswith("<![CDATA[", lt):
        end = html.find("]]>", lt + 9)
        sink.cdata(html[lt + 9 : end if end >= 0 else n])
        return end + 3 if end >= 0 else n
    return bogus(html, lt + 2, sink)


class TokenList:
    """A sink that keeps tokens: dicts as rows of the tokens table. Every text element takes its mode."""

    def __init__(self, on_token: Callable[[dict], None] | None = None):
        self.tokens: list[dict] = []
        self.emit = on_token or self.tokens.append
        self.run: list[str] = []

    def _flush(self) -> None:
        if self.run:
            content = "".join(self.run)
            self.run = []
            self.emit({"kind": "text", "tag": None, "name_src": None, "attrs": [], "self_closing": False, "content": content})

    def _token(self, kind: str, content: str | None = None, name: str | None = None, attrs: list[RawAttr] | None = None, self_closing: bool = False) -> None:
        self._flush()
        self.emit({"kind": kind, "tag": None if name is None else ascii_lower(name), "name_src": name, "attrs": [{"name": a, "value": v} for a, v in attrs or []], "self_closing": self_closing, "content": content})

    def should_continue(self) -> bool:
        return True

    def open_tag(self, name: str, attrs: list[RawAttr], self_closing: bool) -> bool:
        self._token("open", name=name, attrs=first_wins(attrs), self_closing=self_closing)
        return True

    def close_tag(self, name: str) -> None:
        self._token("close", name=name)

    def text(self, raw: str, decode: bool) -> None:
        self.run.append(decode_entities(raw) if decode else raw)

    def comment(self, data: str) -> None:
        self._token("comment", data)

    def doctype(self, data: str) -> None:
        self._token("doctype", data)

    def cdata(self, data: str) -> None:
        self._token("cdata", data)

    def finish(self) -> list[dict]:
        self._flush()
        return self.tokens


def tokenize(html: str) -> list[dict]:
    sink = TokenList()
    scan(html, sink)
    return sink.finish()
