"""Document trees: a bounded, well-defined repair of malformed markup.

``TreeBuilder`` is a sink of the tokenizer. Elements are plain Python objects in
lists while the tree is repaired; ``pre`` numbers and interval labels are given
once at the end. Insertion mode is the nearest table part or select on the stack
of open elements, kept beside the stack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from ..functions.entities import decode_entities
from ..functions.text import SPACE, ascii_lower
from .tokenizer import RAW_TEXT, VOID, RawAttr, first_wins, scan

MAX_OPEN = 512

FORMATTING = frozenset("a b em i strong big code font nobr s small strike tt u".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTION = frozenset("tbody thead tfoot".split())
CELL = frozenset("td th".split())
#: What only tables hold.
TABLE_PARTS = SECTION | CELL | {"tr", "caption", "colgroup", "col"}
TABLE_KINDS = TABLE_PARTS - {"col"} | {"table"}
SPECIAL = TABLE_PARTS | HEADING | frozenset(
    """table select li dt dd p plaintext article aside body button div footer form head header html iframe main nav ol pre script section style
    textarea title ul xmp noembed noframes address applet blockquote center details dialog dir dl fieldset figcaption figure frameset hgroup
    listing marquee menu noscript object search summary template""".split()
)
CLOSES_P = HEADING | frozenset(
    """article aside div footer form header hr li main nav ol p pre section table ul xmp address blockquote center details dialog dir dl fieldset
    figcaption figure hgroup listing menu search summary dt dd plaintext""".split()
)
STANDARD = frozenset("table template td th caption applet marquee object".split())
LIST_ITEM = STANDARD | {"ol", "ul"}
BUTTON = STANDARD | {"button"}
TABLE_SCOPE = frozenset("table template".split())
DROPS_NEWLINE = frozenset("pre textarea listing".split())
VERBATIM = RAW_TEXT | {"plaintext"}
#: Element name -> insertion mode of what is inside.
MODES = {"table": "table", "tr": "row", "caption": "caption", "colgroup": "colgroup", "select": "select"} | dict.fromkeys(SECTION, "section") | dict.fromkeys(CELL, "cell")
FOSTERS = frozenset({"table", "tr"}) | SECTION


class Node:
    __slots__ = ("kind", "tag", "name", "attrs", "parent", "children", "text", "self_closing", "pre", "end", "depth")

    def __init__(self, kind: str, tag: str | None = None, name: str | None = None, attrs: list[RawAttr] | None = None, text: str | None = None, self_closing: bool = False):
        self.kind, self.tag, self.name, self.attrs, self.text, self.self_closing = kind, tag, name, attrs if attrs is not None else [], text, self_closing
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.pre = self.end = self.depth = 0

    def append(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def place(self) -> int:
        """Its index among its siblings. What moves is near the end."""
        siblings = self.parent.children
        at = len(siblings) - 1
        while siblings[at] is not self:
            at -= 1
        return at

    def insert_before(self, node: Node) -> None:
        node.parent = self.parent
        self.parent.children.insert(self.place(), node)

    def detach(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.place()]
            self.parent = None

    def attr(self, name: str) -> str | None:
        key = ascii_lower(name)
        return next((v for a, v in self.attrs if ascii_lower(a) == key), None)

    def clone(self) -> Node:
        return Node("element", self.tag, self.name, list(self.attrs), None, self.self_closing)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))


class TreeBuilder:
    def __init__(self, on_create: Callable[[Node], None] | None = None, on_close: Callable[[Node], None] | None = None):
        self.root = Node("root")
        self.stack: list[Node] = []
        self.modes: list[str] = []
        self.run: list[tuple[str, bool]] = []
        self.comment_parent: Node | None = None
        self.on_create, self.on_close = on_create, on_close
        self.stopped = False

    # The stack

    @property
    def current(self) -> Node:
        return self.stack[-1] if self.stack else self.root

    @property
    def mode(self) -> str:
        return self.modes[-1] if self.modes else "body"

    def _push(self, node: Node) -> None:
        self.stack.append(node)
        self.modes.append(MODES.get(node.tag) or self.mode)

    def _cut(self, at: int) -> list[Node]:
        """Close the open elements from `at` on."""
        gone = self.stack[at:]
        del self.stack[at:]
        del self.modes[at:]
        if self.on_close:
            for node in reversed(gone):
                self.on_close(node)
        return gone

    def _restack(self, stack: list[Node]) -> None:
        if self.on_close:
            stay = set(map(id, stack))
            for node in reversed(self.stack):
                if id(node) not in stay:
                    self.on_close(node)
        self.stack, self.modes = [], []
        for node in stack:
            self._push(node)

    def _in_scope(self, names: frozenset[str] | set[str], bounds: frozenset[str]) -> int:
        """Place on the stack of the innermost element of these names, -1 if a boundary comes first."""
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i].tag
            if tag in names:
                return i
            if tag in bounds:
                return -1
        return -1

    def _close(self, names: frozenset[str] | set[str], bounds: frozenset[str]) -> bool:
        i = self._in_scope(names, bounds)
        if i >= 0:
            self._cut(i)
        return i >= 0

    def _close_last(self, names: frozenset[str] | set[str]) -> None:
        self._close(names, frozenset())

    def _clear_back(self, names: frozenset[str] | set[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in names:
                self._cut(i + 1)
                return

    def _open(self, name: str) -> bool:
        return any(n.tag == name for n in self.stack)

    # Insertion

    def _created(self, node: Node) -> None:
        if self.on_create:
            self.on_create(node)

    def _place(self, node: Node, foster: bool) -> None:
        """Append to the current node, or, fostered, put before the innermost open table."""
        if foster:
            table = next((n for n in reversed(self.stack) if n.tag == "table"), None)
            if table is not None and table.parent is not None:
                table.insert_before(node)
                return
        self.current.append(node)

    def _insert(self, node: Node, foster: bool = False, push: bool = True) -> bool:
        self._place(node, foster and self.current.tag in FOSTERS)
        opened = push and node.tag not in VOID and len(self.stack) < MAX_OPEN
        if opened:
            self._push(node)
        self._created(node)
        if not opened and self.on_close:
            self.on_close(node)
        return opened

    def _imply(self, tag: str) -> None:
        self._insert(Node("element", tag, tag))

    # Tokens

    def should_continue(self) -> bool:
        return not self.stopped

    def open_tag(self, name: str, attrs: list[RawAttr], self_closing: bool) -> bool:
        self._end_run()
        self.comment_parent = None
        tag = ascii_lower(name)
        node = Node("element", tag, name, first_wins(attrs), None, self_closing)
        foster = False
        while True:
            mode = self.mode
            if mode == "select":
                if tag in ("input", "textarea", "keygen") or (tag in TABLE_KINDS - {"colgroup"} and self._open("table")):
                    self._close_last({"select"})
                    continue
                if tag == "option":
                    self._pop_current("option")
                elif tag == "optgroup":
                    self._pop_current("option")
                    self._pop_current("optgroup")
                elif tag == "select":
                    self._close_last({"select"})
                    return False
                elif tag != "script":
                    return False
                return self._insert(node)
            if mode in ("cell", "caption"):
                if tag in TABLE_PARTS:
                    self._close_last(CELL if mode == "cell" else {"caption"})
                    continue
            elif mode == "colgroup":
                if tag != "col":
                    if self.current.tag != "colgroup":
                        return False
                    self._cut(len(self.stack) - 1)
                    continue
            elif mode == "row":
                if tag in CELL:
                    self._clear_back({"tr"})
                elif tag in TABLE_PARTS or tag == "table":
                    self._close_last({"tr"})
                    continue
                else:
                    foster = True
            elif mode == "section":
                if tag == "tr":
                    self._clear_back(SECTION)
                elif tag in CELL:
                    self._clear_back(SECTION)
                    self._imply("tr")
                elif tag in TABLE_PARTS or tag == "table":
                    self._close_last(SECTION)
                    continue
                else:
                    foster = True
            elif mode == "table":
                if tag in SECTION or tag in ("caption", "colgroup"):
                    self._clear_back({"table"})
                elif tag == "tr" or tag in CELL:
                    self._clear_back({"table"})
                    self._imply("tbody")
                    if tag != "tr":
                        self._imply("tr")
                elif tag == "col":
                    self._clear_back({"table"})
                    self._imply("colgroup")
                elif tag == "table":
                    self._close_last({"table"})
                else:
                    foster = True
            elif tag in TABLE_PARTS:
                return False
            break
        if foster:
            if tag in ("script", "style") or (tag == "input" and ascii_lower(node.attr("type") or "") == "hidden"):
                foster = False
            elif tag == "form":
                self._insert(node, push=False)
                return False
        if tag == "a" and self._in_scope({"a"}, STANDARD) >= 0:
            self._adopt("a")
        self._implied_closes(tag)
        return self._insert(node, foster)

    def _pop_current(self, tag: str) -> None:
        if self.current.tag == tag:
            self._cut(len(self.stack) - 1)

    def _implied_closes(self, tag: str) -> None:
        if tag in ("li", "dt", "dd"):
            same = {"li"} if tag == "li" else {"dt", "dd"}
            for i in range(len(self.stack) - 1, -1, -1):
                other = self.stack[i].tag
                if other in same:
                    self._cut(i)
                    break
                if other in SPECIAL and other not in ("address", "div", "p"):
                    break
        if tag in CLOSES_P:
            self._close({"p"}, BUTTON)
        if tag in HEADING and self.current.tag in HEADING:
            self._cut(len(self.stack) - 1)
        elif tag in ("option", "optgroup"):
            self._pop_current("option")

    def close_tag(self, name: str) -> None:
        self._end_run()
        tag = ascii_lower(name)
        if tag in ("body", "html") and self.mode not in ("select", "colgroup"):
            self.comment_parent = None
            if self._in_scope({"body"}, STANDARD) >= 0:
                html = next((n for n in self.stack if n.tag == "html"), None) if tag == "body" else None
                self.comment_parent = html or self.root
            return
        self.comment_parent = None
        if tag == "br":
            self.open_tag("br", [], False)
            return
        if tag in VOID:
            return
        while True:
            if self.stack and self.current.tag == tag:
                self._cut(len(self.stack) - 1)
                return
            mode = self.mode
            if mode == "select":
                if tag in TABLE_KINDS - {"colgroup"}:
                    if self._in_scope({tag}, TABLE_SCOPE) < 0:
                        return
                    self._close_last({"select"})
                    continue
                if tag in ("option", "select"):
                    self._close({tag}, frozenset({"select"}) - {tag})
                elif tag == "optgroup" and len(self.stack) > 1 and self.current.tag == "option" and self.stack[-2].tag == "optgroup":
                    self._cut(len(self.stack) - 2)
                return
            if mode == "colgroup" and tag != "colgroup":
                if self.current.tag != "colgroup":
                    return
                self._cut(len(self.stack) - 1)
                if tag in ("body", "html"):
                    self.close_tag(name)
                    return
                continue
            break
        if tag in FORMATTING:
            self._adopt(tag)
        elif tag in TABLE_KINDS:
            self._close({tag}, TABLE_SCOPE - {tag})
        elif tag == "p":
            if not self._close({"p"}, BUTTON):
                self._insert(Node("element", "p", "p"), foster=True, push=False)
        elif tag == "li":
            self._close({"li"}, LIST_ITEM)
        elif tag in ("dt", "dd"):
            self._close({tag}, STANDARD)
        elif tag in HEADING:
            self._close(HEADING, STANDARD)
        else:
            self._close({tag}, STANDARD if tag in SPECIAL else SPECIAL - {tag})

    def _adopt(self, tag: str) -> None:
        for _ in range(8):
            at = self._in_scope({tag}, STANDARD)
            if at < 0:
                return
            if at == len(self.stack) - 1:
                self._cut(at)
                return
            block_at = next((i for i in range(at + 1, len(self.stack)) if self.stack[i].tag in SPECIAL), -1)
            if block_at < 0:
                self._reopen([n for n in self._cut(at)[1:] if n.tag in FORMATTING])
                return
            formatting, block = self.stack[at], self.stack[block_at]
            ancestor = self.stack[at - 1] if at else self.root
            kept: list[Node] = []
            moved = block
            for nth, node in enumerate(reversed(self.stack[at + 1 : block_at])):
                if nth < 3 and node.tag in FORMATTING:
                    copy = node.clone()
                    moved.detach()
                    copy.append(moved)
                    self._created(copy)
                    kept.append(copy)
                    moved = copy
            moved.detach()
            if ancestor.tag in FOSTERS:
                above = self.stack[:at]
                next(n for n in reversed(above) if n.tag == "table").insert_before(moved)
            else:
                ancestor.append(moved)
            copy = formatting.clone()
            for child in block.children:
                child.parent = copy
            copy.children, block.children = block.children, []
            block.append(copy)
            self._created(copy)
            self._restack([*self.stack[:at], *reversed(kept), block, copy, *self.stack[block_at + 1 :]])

    def _reopen(self, elements: list[Node]) -> None:
        """Clones of formatting elements that were cut off, of identical ones the innermost three."""
        count: dict[tuple, int] = {}
        stay = []
        for node in reversed(elements):
            key = (node.tag, tuple(node.attrs))
            count[key] = count.get(key, 0) + 1
            if count[key] <= 3:
                stay.append(node)
        for node in reversed(stay):
            self._insert(node.clone(), foster=True)

    # Text

    def text(self, raw: str, decode: bool) -> None:
        if not raw:
            return
        self.run.append((raw, decode))

    def cdata(self, data: str) -> None:
        if data:
            self.run.append((data, False))

    def _skip_newline(self, parts: list[tuple[str, bool]]) -> str:
        raw, decode = parts[0]
        cut = 2 if raw.startswith("\r\n") else 1 if raw[:1] in ("\n", "\r") else 0
        out = self._decoded([(raw[cut:], decode), *parts[1:]])
        # a referenced line feed goes as well, if no written one did
        return out[1:] if not cut and out.startswith("\n") else out

    @staticmethod
    def _decoded(parts: list[tuple[str, bool]]) -> str:
        return "".join(decode_entities(s) if d else s for s, d in parts)

    def _end_run(self) -> None:
        """What text has come since the last other token becomes one node."""
        if not self.run:
            return
        parts, self.run = self.run, []
        parent = self.current
        fresh = parent.tag in DROPS_NEWLINE and not parent.children
        content = self._skip_newline(parts) if fresh else self._decoded(parts)
        if not content:
            return
        if parent.tag in VERBATIM:
            self._add_text(content, False)
            return
        blank = not content.strip(SPACE)
        if not blank:
            self.comment_parent = None
        if self.mode == "colgroup":
            rest = content.lstrip(SPACE)
            lead = content[: len(content) - len(rest)]
            if lead:
                self._add_text(lead, False)
            if not rest:
                return
            if self.current.tag != "colgroup":
                return
            self._cut(len(self.stack) - 1)
            content = rest
        if self.current.tag in FOSTERS:
            self._add_text(content, bool(content.strip(SPACE)))
        else:
            self._add_text(content, False)

    def _add_text(self, content: str, foster: bool) -> None:
        node = Node("text", text=content)
        self._place(node, foster)
        self._created(node)

    def comment(self, data: str) -> None:
        self._end_run()
        self._add_leaf(Node("comment", text=data))

    def doctype(self, data: str) -> None:
        self._end_run()
        self._add_leaf(Node("doctype", text=data))

    def _add_leaf(self, node: Node) -> None:
        (self.comment_parent or self.current).append(node)
        self._created(node)

    def finish(self) -> Node:
        self._end_run()
        self._cut(0)
        return self.root


def build(html: str) -> Node:
    builder = TreeBuilder()
    scan(html, builder)
    return builder.finish()
