"""Selectors, paths and axes evaluated within each document: one pass over the pages, no shuffle.

A page is one row and its nodes are in pre-order, so a step is a walk over a few
lists: a descendant is a running maximum of matched intervals, a child looks at its
parent, siblings at the sibling before. What a path finds is all that leaves the
pass, with the columns that are asked for; strings are cut for those nodes alone.

    find(pages, Path().select("nav li a[href]"), ("attrs", "text_content"))
    find(pages, Path().select("ul").select("body li > a").axis("ancestors"))
    summaries(pages, Path().xpath("/html/body/nav"))

Steps work on what the step before found; the first on the whole document. A
selector's ancestors may be outside what it is asked within.

Defined cases: see ``sources.dom``; a document without matches has no rows in
``find`` and a row with n = 0 in ``summaries``; the order of a document's rows is
that of its nodes, or of ``place`` where an axis has an order of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import ascii_lower, tokens_of
from ..sources.dom import NODE_TYPES, SLICE_NODES, ParseOptions, arrow_of, documents, ids_schema, sources
from ..sources.tree import KNOWN, Tree
from .css import Branch, Part, parse_selector
from .xpath import Expression, XPathError, parse_xpath
from .xpath import Step as XStep

#: Of a node found: the node that an axis began at, and its place among what was found from there.
FOUND = "ctx int, place int"
AXES = ("descendants", "descendants_bfs", "children", "ancestors", "siblings", "parent", "first_child", "next_sibling", "prev_sibling")


# A simple selector on one node


def part_test(part: Part) -> Callable[[Tree, int], bool]:
    kind, name, op, value = part.kind, part.name, part.op, part.value
    if kind == "any":
        return lambda t, i: True
    if kind == "tag":
        return lambda t, i: t.nodes[i].tag == name
    if kind == "class":
        return lambda t, i: name in tokens_of(t.nodes[i].attr("class") or "") if t.nodes[i].attrs else False
    if kind == "id":
        return lambda t, i: t.nodes[i].attr("id") == name if t.nodes[i].attrs else False
    if kind == "first":
        return lambda t, i: t.ordinals[0][i] == 1
    if kind == "last":
        return lambda t, i: t.ordinals[1][i] == 1
    if kind == "nth":
        a, b = part.nth

        def nth(t: Tree, i: int) -> bool:
            past = t.ordinals[0][i] - b
            return past == 0 if a == 0 else past % a == 0 and past // a >= 0

        return nth
    if kind == "not":
        inner = [part_test(p) for p in part.inner]
        return lambda t, i: not all(p(t, i) for p in inner)
    test = {
        "exists": lambda v: True,
        "=": lambda v: v == value,
        "~=": lambda v: value in tokens_of(v),
        "^=": lambda v: value != "" and v.startswith(value),
        "$=": lambda v: value != "" and v.endswith(value),
        "*=": lambda v: value != "" and value in v,
    }[op]
    key = ascii_lower(name)

    def attr(t: Tree, i: int) -> bool:
        for a, v in t.nodes[i].attrs:
            if ascii_lower(a) == key:
                return test(v or "")
        return False

    return attr


def compound_hits(tree: Tree, parts: tuple[Part, ...], among: list[int] | None = None) -> list[int]:
    """The elements that a compound accepts, of all or of some."""
    at = among if among is not None else range(len(tree))
    rest = parts
    if parts[0].kind == "tag":
        name, nodes = parts[0].name, tree.nodes
        at = [i for i in at if nodes[i].tag == name]
        rest = parts[1:]
    else:
        element = tree.is_element
        at = [i for i in at if element[i]]
    for part in rest:
        test = part_test(part)
        at = [i for i in at if test(tree, i)]
    return at


def related(tree: Tree, hits: list[int], combinator: str) -> list[int]:
    """Nodes that a combinator leads to from hits, in document order."""
    end, parent = tree.end, tree.parent
    if combinator == " ":
        out, upto = [], -1
        for i in hits:  # below an earlier hit's nodes there is nothing new
            if end[i] > upto:
                out.extend(range(max(i, upto) + 1, end[i] + 1))
                upto = end[i]
        return out
    hit = set(hits)
    if combinator == ">":
        return [i for i in range(1, len(tree)) if parent[i] in hit]
    if combinator == "+":
        before = tree.ordinals[3]
        return [i for i, b in enumerate(before) if b is not None and b in hit]
    first: dict[int, int] = {}
    for i in hits:
        first.setdefault(parent[i], i)
    return [i for i in range(1, len(tree)) if first.get(parent[i], i) < i]


def branch_hits(tree: Tree, branch: Branch) -> list[int]:
    hits = compound_hits(tree, branch.compounds[0])
    for combinator, compound in zip(branch.combinators, branch.compounds[1:], strict=True):
        if not hits:
            return hits
        hits = compound_hits(tree, compound, related(tree, hits, combinator))
    return hits


def select(tree: Tree, css: str) -> list[int]:
    """The elements that match a selector list, in document order."""
    branches = parse_selector(css)
    if len(branches) == 1:
        return branch_hits(tree, branches[0])
    return sorted({i for b in branches for i in branch_hits(tree, b)})


def covered(tree: Tree, roots: list[int]) -> list[int]:
    """Roots and what is below them, once each, in document order."""
    out, upto = [], -1
    for i in sorted(set(roots)):
        if tree.end[i] > upto:
            out.extend(range(max(i, upto + 1), tree.end[i] + 1))
            upto = tree.end[i]
    return out


def xstep_hits(tree: Tree, step: XStep, among: list[int]) -> list[int]:
    nodes, p = tree.nodes, step.predicate
    at = [i for i in among if tree.is_element[i] and (step.name == "*" or nodes[i].tag == step.name)]
    if p is None:
        return at
    if p.kind == "position":
        return [i for i in at if tree.ordinals[2][i] == p.position]
    if p.kind == "contains":  # an empty string is contained in everything, a missing attribute too
        return [i for i in at if p.value in (nodes[i].attr(p.attr) or "")]
    test = part_test(Part("attr", p.attr, "exists" if p.kind == "attr" else "=", p.value))
    return [i for i in at if test(tree, i)]


def xpath(tree: Tree, e: Expression, contexts: list[int] | None) -> list[int]:
    """What an expression finds from the root, or from contexts, once each, in document order."""
    if e.axis == "parent":
        return sorted({tree.parent[i] for i in contexts or [] if tree.parent[i] >= 0})
    if e.axis == "descendant":
        hits = xstep_hits(tree, e.steps[0], range(len(tree)) if contexts is None else covered(tree, contexts))
    else:
        hits = [0] if contexts is None else sorted(set(contexts))
        for step in e.steps:
            hits = xstep_hits(tree, step, related(tree, hits, ">"))
    if e.text:
        return [i for i in related(tree, hits, ">") if tree.nodes[i].kind == "text"]
    return hits


def axis(tree: Tree, name: str, ctx: int) -> list[int]:
    """The nodes of an axis, in the axis' order."""
    end, parent = tree.end, tree.parent
    if name == "descendants":
        return list(range(ctx, end[ctx] + 1))
    if name == "descendants_bfs":
        return sorted(range(ctx, end[ctx] + 1), key=lambda i: tree.depth[i])
    if name == "ancestors":
        out, i = [], parent[ctx]
        while i >= 0:
            out.append(i)
            i = parent[i]
        return out
    if name == "parent":
        return [parent[ctx]] if parent[ctx] >= 0 else []
    if name in ("children", "first_child"):
        out, i = [], ctx + 1
        while i <= end[ctx]:
            out.append(i)
            i = end[i] + 1
        return out[:1] if name == "first_child" else out
    if parent[ctx] < 0:
        return []
    if name in ("siblings", "next_sibling"):
        out, i = [], end[ctx] + 1
        while i <= end[parent[ctx]]:
            out.append(i)
            i = end[i] + 1
        return out[:1] if name == "next_sibling" else out
    i = ctx - 1  # the last node of the sibling before, or the parent
    if i == parent[ctx]:
        return []
    while parent[i] != parent[ctx]:
        i = parent[i]
    return [i]


@dataclass(frozen=True)
class Path:
    """Steps, checked when they are added."""

    steps: tuple[tuple[str, object], ...] = ()

    def _and(self, kind: str, what: object) -> Path:
        return Path((*self.steps, (kind, what)))

    def all(self) -> Path:
        """Every node."""
        return self._and("all", None)

    def select(self, css: str) -> Path:
        parse_selector(css)
        return self._and("select", css)

    def xpath(self, expression: str) -> Path:
        return self._and("xpath", parse_xpath(expression))

    def axis(self, name: str) -> Path:
        if name not in AXES:
            raise ValueError(f"no axis {name!r}: {', '.join(AXES)}")
        return self._and("axis", name)

    def first(self) -> Path:
        """The first node found in each document."""
        return self._and("first", None)

    def where(self, test: Callable[[Tree, int], bool]) -> Path:
        """Nodes that a function of the tree and the node's number accepts."""
        return self._and("where", test)

    def by_tag(self, tag: str | None) -> Path:
        """Elements of a name; None: all whose name isn't a known one."""
        if tag is None:
            return self._and("where", lambda t, i: t.is_element[i] and t.nodes[i].tag not in KNOWN)
        low = ascii_lower(tag)
        return self._and("where", lambda t, i: t.is_element[i] and t.nodes[i].tag == low)

    def by_id(self, value: str) -> Path:
        test = part_test(Part("id", value))
        return self._and("where", lambda t, i: t.is_element[i] and test(t, i)).first()

    def by_class(self, name: str) -> Path:
        test = part_test(Part("class", name))
        return self._and("where", lambda t, i: t.is_element[i] and test(t, i))

    def by_attr(self, name: str, value: str) -> Path:
        test = part_test(Part("attr", name, "=", value))
        return self._and("where", lambda t, i: t.is_element[i] and test(t, i))

    def kind(self) -> str:
        """What the path gives, as a result of XPath has it: nodes, or strings after /text()."""
        kind = "nodes"
        for name, what in self.steps:
            kind = "strings" if name == "xpath" and what.text else kind if name in ("first", "where") else "nodes"
        return kind

    def run(self, tree: Tree) -> tuple[list[int], list[int], list[int]]:
        """(nodes, the nodes that they were found from, their places there)."""
        found: list[int] | None = None
        ctx: list[int] = []
        place: list[int] = []
        for name, what in self.steps:
            if name == "axis":
                roots = [0] if found is None else sorted(set(found))
                got = [(c, k, i) for c in roots for k, i in enumerate(axis(tree, what, c))]
                ctx, place, found = ([g[0] for g in got], [g[1] for g in got], [g[2] for g in got])
                continue
            if name in ("first", "where"):
                at = range(len(tree)) if found is None else found
                if found is None:
                    ctx, place = list(at), [0] * len(tree)
                if name == "first":
                    keep = [min(range(len(at)), key=lambda k: at[k])] if len(at) else []
                else:
                    keep = [k for k, i in enumerate(at) if what(tree, i)]
                found, ctx, place = [at[k] for k in keep], [ctx[k] for k in keep], [place[k] for k in keep]
                continue
            if name == "all":
                found = list(range(len(tree)))
            elif name == "xpath":
                found = xpath(tree, what, found)
            elif found is None:
                found = select(tree, what)
            else:
                inside = set(covered(tree, found))
                found = [i for i in select(tree, what) if i in inside]
            ctx, place = found, list(range(len(found)))
        return (found or []), ctx, place


def find(pages: DataFrame, path: Path, columns: tuple[str, ...] = ("pre", "tag"), id_col: str = "page_id", html_col: str = "html", options: ParseOptions = ParseOptions(), ctx_columns: tuple[str, ...] = ()) -> DataFrame:
    """A row per node found: doc, doc_id, ctx, place and the columns asked for, of NODE or text_content, inner_html, outer_html; those of
    ctx_columns are of the node that an axis began at, their names after "ctx_". html_col is STRING or BINARY; pages may be a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "doc_id", "ctx", "place", *columns, *[f"ctx_{c}" for c in ctx_columns]]
        for batch in batches:
            row: list[int] = []
            held: list[list] = [[] for _ in names[2:]]

            def flush() -> pa.RecordBatch:
                at = pa.array(row, pa.int32())
                made = [pa.array(held[0], pa.int32()), pa.array(held[1], pa.int32()), *[arrow_of(c, v) for c, v in zip((*columns, *ctx_columns), held[2:], strict=True)]]
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *made], names)

            for i, (text, _, _) in enumerate(sources(batch, options)):
                if text is None:
                    continue
                tree = Tree.of(text)
                nodes, ctx, place = path.run(tree)
                row.extend([i] * len(nodes))
                values = [ctx, place, *[tree.column(c, nodes) for c in columns], *[tree.column(c, ctx) for c in ctx_columns]]
                for to, more in zip(held, values, strict=True):
                    to.extend(more)
                if len(row) >= SLICE_NODES:
                    yield flush()
                    row, held = [], [[] for _ in names[2:]]
            if row:
                yield flush()

    rows = documents(pages, id_col, html_col)
    fields = [f"{c} {NODE_TYPES.get(c, 'string')}" for c in columns] + [f"ctx_{c} {NODE_TYPES.get(c, 'string')}" for c in ctx_columns]
    return rows.mapInArrow(run, ", ".join([ids_schema(rows), FOUND, *fields]))


SUMMARY = "n long, text string, first_pre int, first_html string, first_inner_html string, first_attrs array<struct<name:string,value:string>>, kind string, error string"


def summaries(pages: DataFrame, path: Path, id_col: str = "page_id", html_col: str = "html", options: ParseOptions = ParseOptions(), strings: bool = True) -> DataFrame:
    """A row per document: how many nodes the path finds, their texts one after another, the first one's number, markup, inner markup
    and attributes, what kind of result it is, and the document's error. Without strings, the counts alone are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n", "text", "first_pre", "first_html", "first_inner_html", "first_attrs", "kind", "error"]
        kind = path.kind()
        for batch in batches:
            held: list[list] = [[] for _ in names]
            first = size = 0

            def flush(upto: int) -> pa.RecordBatch:
                ids = batch.slice(first, upto - first)
                none = pa.array([a is None for a in held[5]])
                attrs = arrow_of("attrs", [a or [] for a in held[5]])
                attrs = pa.ListArray.from_arrays(attrs.offsets, attrs.values, mask=none)
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), None, pa.string(), pa.string())
                made = [attrs if k is None else pa.array(v, k) for v, k in zip(held, kinds, strict=True)]
                return pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), *made], ["doc", "doc_id", *names])

            for i, (text, _, error) in enumerate(sources(batch, options)):
                if text is None:
                    values = [None] * 6 + [kind, error]
                else:
                    tree = Tree.of(text)
                    nodes = path.run(tree)[0]
                    values = [len(nodes), None, nodes[0] if nodes else None, None, None, None, kind, None]
                    if strings:
                        values[1] = "".join(tree.column("text_content", nodes))
                    if strings and nodes:
                        values[3:6] = [tree.column(c, nodes[:1])[0] for c in ("outer_html", "inner_html", "attrs")]
                for to, value in zip(held, values, strict=True):
                    to.append(value)
                size += sum(len(v) for v in values if isinstance(v, str))
                if size >= SLICE_NODES * 100:
                    yield flush(i + 1)
                    held, first, size = [[] for _ in names], i + 1, 0
            if held[0]:
                yield flush(batch.num_rows)

    rows = documents(pages, id_col, html_col)
    return rows.mapInArrow(run, f"{ids_schema(rows)}, {SUMMARY}")


__all__ = ["AXES", "Path", "XPathError", "axis", "covered", "find", "select", "summaries", "xpath"]
