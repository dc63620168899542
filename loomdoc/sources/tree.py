"""A finished document as columns: nodes in pre-order, and what is asked of them, worked out once when it is.

Node i is element i of every list. Text content of a node is a slice of the
document's text, markup a slice of the document's markup; both are cut here, where
a slice costs its own length.
"""

from __future__ import annotations

from functools import cached_property

from ..functions.entities import escape_attribute, escape_text
from ..functions.text import tokens_of
from .builder import DROPS_NEWLINE, VERBATIM, Node, build
from .tokenizer import VOID

#: Names whose source case isn't kept. The elements that are known by name.
KNOWN = frozenset(
    """a abbr area article aside b base body br button col div em embed footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input li
    link main meta nav noembed noframes ol p param plaintext pre script section select source span strong style table tbody td textarea th thead
    title tr track ul video wbr xmp""".split()
)


class Tree:
    def __init__(self, root: Node):
        nodes: list[Node] = []
        parent: list[int] = []
        stack = [(root, -1)]
        while stack:
            node, up = stack.pop()
            i = len(nodes)
            nodes.append(node)
            parent.append(up)
            if node.children:
                stack.extend([(c, i) for c in reversed(node.children)])
        self.nodes, self.parent = nodes, parent
        self.end = end = list(range(len(nodes)))
        for i in range(len(nodes) - 1, 0, -1):
            if end[parent[i]] < end[i]:
                end[parent[i]] = end[i]

    @classmethod
    def of(cls, html: str) -> Tree:
        return cls(build(html))

    def __len__(self) -> int:
        return len(self.nodes)

    @cached_property
    def is_element(self) -> list[bool]:
        return [n.kind == "element" for n in self.nodes]

    @cached_property
    def depth(self) -> list[int]:
        out = [0] * len(self.nodes)
        for i in range(1, len(out)):
            out[i] = out[self.parent[i]] + 1
        return out

    @cached_property
    def ordinals(self) -> tuple[list[int | None], list[int | None], list[int | None], list[int | None]]:
        """(place among element siblings, place from the end, place among those of its name, the element sibling before); null for others."""
        n = len(self.nodes)
        index: list[int | None] = [None] * n
        from_end: list[int | None] = [None] * n
        of_type: list[int | None] = [None] * n
        before: list[int | None] = [None] * n
        last: dict[int, int] = {}
        named: dict[tuple[int, str], int] = {}
        for i, element in enumerate(self.is_element):
            if element:
                up = self.parent[i]
                prev = last.get(up)
                before[i] = prev
                index[i] = 1 if prev is None else index[prev] + 1
                last[up] = i
                key = (up, self.nodes[i].tag)
                of_type[i] = named[key] = named.get(key, 0) + 1
        for i, k in enumerate(index):
            if k is not None:
                from_end[i] = index[last[self.parent[i]]] - k + 1
        return index, from_end, of_type, before

    @cached_property
    def text_at(self) -> list[int]:
        """Where each node's text begins in the document's text, and where all ends."""
        out, at = [], 0
        for n in self.nodes:
            out.append(at)
            if n.kind == "text":
                at += len(n.text)
        out.append(at)
        return out

    @cached_property
    def text(self) -> str:
        return "".join([n.text for n in self.nodes if n.kind == "text"])

    def text_len(self, i: int) -> int:
        return self.text_at[self.end[i] + 1] - self.text_at[i] if self.nodes[i].kind in ("element", "root", "text") else 0

    @cached_property
    def markup(self) -> tuple[str, list[int], list[int], list[int], list[int]]:
        """(document's markup; where each node's begins and how long it is; the same of what is inside)."""
        n = len(self.nodes)
        end = self.end
        start, size, inner, inner_size = [0] * n, [0] * n, [0] * n, [0] * n
        closing = [""] * n
        parts: list[str] = []
        at = 0
        open_: list[int] = []

        def leave() -> None:
            nonlocal at
            j = open_.pop()
            inner_size[j] = at - inner[j]
            if closing[j]:
                parts.append(closing[j])
                at += len(closing[j])
            size[j] = at - start[j]

        for i, node in enumerate(self.nodes):
            while open_ and end[open_[-1]] < i:
                leave()
            start[i] = at
            kind = node.kind
            if kind == "element":
                tag = node.tag
                name = tag if tag in KNOWN else node.name
                if node.attrs:
                    s = f"<{name}{''.join([f' {a}' if v is None else f' {a}="{escape_attribute(v)}"' for a, v in node.attrs])}>"
                else:
                    s = f"<{name}>"
                first = node.children[0] if node.children else None
                if tag in DROPS_NEWLINE and first is not None and first.kind == "text" and first.text[0] in "\r\n":
                    s += "\n"
                if tag not in VOID:
                    closing[i] = f"</{name}>"
            elif kind == "text":
                s = node.text if node.parent is not None and node.parent.tag in VERBATIM else escape_text(node.text)
            elif kind == "comment":
                s = f"<!--{node.text}-->"
            elif kind == "doctype":
                s = f"<!DOCTYPE {node.text}>"
            else:
                s = ""
            parts.append(s)
            at += len(s)
            inner[i] = at
            open_.append(i)
        while open_:
            leave()
        return "".join(parts), start, size, inner, inner_size

    # A node's columns, by name

    def column(self, name: str, rows: list[int] | None = None) -> list:
        """Values of a column of NODE, or of text_content, inner_html, outer_html, for all nodes or for some."""
        at = range(len(self.nodes)) if rows is None else rows
        nodes = self.nodes
        if name == "pre":
            return list(at)
        if name == "subtree_end":
            return [self.end[i] for i in at]
        if name == "parent":
            return [None if self.parent[i] < 0 else self.parent[i] for i in at]
        if name == "depth":
            return [self.depth[i] for i in at]
        if name == "kind":
            return [nodes[i].kind for i in at]
        if name == "tag":
            return [nodes[i].tag for i in at]
        if name == "name_src":
            return [nodes[i].name for i in at]
        if name == "is_void":
            return [nodes[i].tag in VOID for i in at]
        if name == "self_closing":
            return [nodes[i].self_closing for i in at]
        if name in ("elem_index", "elem_from_end", "type_index", "prev_elem"):
            which = self.ordinals[("elem_index", "elem_from_end", "type_index", "prev_elem").index(name)]
            return [which[i] for i in at]
        if name == "text":
            return [nodes[i].text for i in at]
        if name == "attrs":
            return [nodes[i].attrs for i in at]
        if name == "id":
            return [nodes[i].attr("id") if nodes[i].attrs else None for i in at]
        if name == "classes":
            return [tokens_of(nodes[i].attr("class") or "") if nodes[i].attrs else [] for i in at]
        if name == "text_start":
            return [self.text_at[i] for i in at]
        if name == "text_len":
            return [self.text_len(i) for i in at]
        if name == "text_content":
            return [self.text[(a := self.text_at[i]) : a + self.text_len(i)] for i in at]
        html, start, size, inner, inner_size = self.markup
        if name == "outer_html":
            return [html[start[i] : start[i] + size[i]] for i in at]
        if name == "inner_html":
            return [html[inner[i] : inner[i] + inner_size[i]] for i in at]
        which = {"html_start": start, "html_len": size, "inner_start": inner, "inner_len": inner_size}[name]
        return [which[i] for i in at]
