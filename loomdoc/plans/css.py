"""CSS selectors: their grammar, and their plans over tables of nodes.

Nodes that were kept in a table are asked here; pages are asked by ``plans.inside``,
which needs no shuffle. A selector is parsed on the driver. Its compounds become row predicates over
element rows; its combinators become window functions that all use one shuffle by
document: a descendant is a running maximum of matched intervals, a child looks
at the last row one level up, siblings look back within their parent. Evaluation
goes from left to right over whole documents; roots are applied last.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, has_token
from ..operators.projections import attr_or_empty, has_attr, has_class

MAX_TEXT = 16 << 10
MAX_BRANCHES = 64
MAX_COMBINATORS = 64
MAX_PARTS = 256
MAX_NOT = 16


class SelectorError(ValueError):
    """A selector that is malformed, not supported, or too large."""


@dataclass(frozen=True)
class Part:
    """kind: tag, any, class, id, attr, first, last, nth, not."""

    kind: str
    name: str = ""
    op: str = ""
    value: str = ""
    nth: tuple[int, int] = (0, 0)
    inner: tuple[Part, ...] = ()


@dataclass(frozen=True)
class Branch:
    """Compounds from left to right, and the combinator before each but the first."""

    compounds: tuple[tuple[Part, ...], ...]
    combinators: tuple[str, ...] = field(default=())


SPACE = re.compile(r"[ \t\n\r\f]*")
IDENT = re.compile(r"(?:[A-Za-z0-9_-]|[^\x00-\x7f]|\\[^\n\r\f])(?:[A-Za-z0-9_-]|[^\x00-\x7f]|\\(?:[0-9a-fA-F]{1,6}(?:\r\n|[ \t\n\r\f])?|[^\n\r\f]))*")
ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})(?:\r\n|[ \t\n\r\f])?|(\r\n|[\n\r\f])|(.)|\Z)", re.DOTALL)
BARE = re.compile(r"(?:\\(?:[0-9a-fA-F]{1,6}(?:\r\n|[ \t\n\r\f])?|[^\n\r\f])|[^\] \t\n\r\f])+")
QUOTED = re.compile(r'"((?:[^"\\]|\\(?:\r\n|.|\Z))*)"|\'((?:[^\'\\]|\\(?:\r\n|.|\Z))*)\'', re.DOTALL)
NTH = re.compile(r"[ \t\n\r\f]*(?:(odd|even)(?![A-Za-z0-9_-])|([+-]?)(\d*)[nN](?:[ \t\n\r\f]*([+-])[ \t\n\r\f]*(\d+))?|([+-]?\d+))[ \t\n\r\f]*\)", re.IGNORECASE)
TYPE_START = re.compile(r"[A-Za-z_]|[^\x00-\x7f]|\\[^\n\r\f]")


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return "�" if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)
        return m[3] or ""

    return ESCAPE.sub(one, text) if "\\" in text else text


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.parts, self.not_depth = text, 0, 0, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def space(self) -> bool:
        start = self.at
        self.at = SPACE.match(self.text, start).end()
        return self.at > start

    def take(self, c: str) -> None:
        if self.peek() != c:
            raise SelectorError(f"expected {c!r} at position {self.at}")
        self.at += 1

    def ident(self) -> str:
        m = IDENT.match(self.text, self.at)
        if not m:
            raise SelectorError(f"expected identifier at position {self.at}")
        # the first code point may itself be a longer escape
        if m[0].startswith("\\"):
            m = re.compile(r"(?:\\(?:[0-9a-fA-F]{1,6}(?:\r\n|[ \t\n\r\f])?|[^\n\r\f])|[A-Za-z0-9_-]|[^\x00-\x7f])+").match(self.text, self.at)
        self.at = m.end()
        return unescape(m[0])

    def value(self) -> str:
        self.space()
        if self.peek() in ("'", '"'):
            m = QUOTED.match(self.text, self.at)
            if not m:
                raise SelectorError("unclosed quote in attribute value")
            self.at = m.end()
            return unescape(m[1] if m[1] is not None else m[2])
        m = BARE.match(self.text, self.at)
        if not m:
            raise SelectorError(f"expected value at position {self.at}")
        self.at = m.end()
        return unescape(m[0])

    def attribute(self) -> Part:
        self.take("[")
        self.space()
        name = self.ident()
        self.space()
        if self.peek() == "]":
            self.at += 1
            return Part("attr", name, "exists")
        op = next((o for o in ("~=", "^=", "$=", "*=", "=") if self.text.startswith(o, self.at)), None)
        if op is None:
            raise SelectorError(f"unknown attribute operator at position {self.at}")
        self.at += len(op)
        value = self.value()
        self.space()
        self.take("]")
        return Part("attr", name, op, value)

    def nth(self) -> tuple[int, int]:
        m = NTH.match(self.text, self.at)
        if not m:
            raise SelectorError("invalid :nth-child expression")
        self.at = m.end()
        word, sign, a, b_sign, b, alone = m.groups()
        if word:
            return (2, 1) if word.lower() == "odd" else (2, 0)
        pair = (0, int(alone)) if alone else (int(f"{sign}{a or 1}"), int(f"{b_sign}{b}") if b else 0)
        if not all(-(1 << 31) <= x < 1 << 31 for x in pair):
            raise SelectorError("integer in :nth-child is out of range")
        return pair

    def pseudo(self) -> Part:
        self.take(":")
        name = ascii_lower(self.ident())
        if name in ("first-child", "last-child"):
            return Part(name[:-6])
        if name == "nth-child":
            self.take("(")
            return Part("nth", nth=self.nth())
        if name == "not":
            if self.not_depth >= MAX_NOT:
                raise SelectorError(f":not() nesting exceeds {MAX_NOT} levels")
            self.take("(")
            self.space()
            self.not_depth += 1
            inner = self.compound()
            self.not_depth -= 1
            self.space()
            self.take(")")
            return Part("not", inner=inner)
        raise SelectorError(f"unknown pseudo-class ':{name}'")

    def compound(self) -> tuple[Part, ...]:
        out: list[Part] = []
        if self.peek() == "*":
            self.at += 1
            out.append(Part("any"))
        elif TYPE_START.match(self.text, self.at):
            out.append(Part("tag", ascii_lower(self.ident())))
        while True:
            c = self.peek()
            if c == ".":
                self.at += 1
                out.append(Part("class", self.ident()))
            elif c == "#":
                self.at += 1
                out.append(Part("id", self.ident()))
            elif c == "[":
                out.append(self.attribute())
            elif c == ":":
                out.append(self.pseudo())
            else:
                break
            if len(out) + self.parts > MAX_PARTS:
                raise SelectorError(f"more than {MAX_PARTS} simple selectors")
        if not out:
            raise SelectorError(f"expected a selector at position {self.at}")
        self.parts += len(out)
        if self.parts > MAX_PARTS:
            raise SelectorError(f"more than {MAX_PARTS} simple selectors")
        return tuple(out)

    def branch(self) -> Branch:
        self.parts = 0
        compounds, combinators = [self.compound()], []
        while True:
            spaced = self.space()
            c = self.peek()
            if c and c in ">+~":
                self.at += 1
                self.space()
                combinators.append(c)
            elif spaced and c and c != ",":
                combinators.append(" ")
            else:
                return Branch(tuple(compounds), tuple(combinators))
            if len(combinators) > MAX_COMBINATORS:
                raise SelectorError(f"more than {MAX_COMBINATORS} combinators")
            compounds.append(self.compound())


@lru_cache(256)
def parse_selector(css: str) -> tuple[Branch, ...]:
    """The branches of a comma list."""
    if len(css.encode("utf-8", "surrogatepass")) > MAX_TEXT:
        raise SelectorError(f"selector longer than {MAX_TEXT} bytes")
    reader = _Reader(css.strip(" \t\n\r\f"))
    out = [reader.branch()]
    while reader.peek() == ",":
        reader.at += 1
        reader.space()
        out.append(reader.branch())
        if len(out) > MAX_BRANCHES:
            raise SelectorError(f"more than {MAX_BRANCHES} selectors in a list")
    if reader.at < len(reader.text):
        raise SelectorError(f"unexpected input at position {reader.at}")
    return tuple(out)


def parse_single_selector(css: str) -> Branch:
    branches = parse_selector(css)
    if len(branches) > 1:
        raise SelectorError("a single selector has no commas")
    return branches[0]


def compound_of(css: str) -> tuple[Part, ...]:
    """The simple selectors of a selector that asks of a node and its attributes alone: no combinators, no places among siblings."""
    branch = parse_single_selector(css)

    def places(parts: tuple[Part, ...]) -> bool:
        return any(p.kind in ("first", "last", "nth") or places(p.inner) for p in parts)

    if branch.combinators or places(branch.compounds[0]):
        raise SelectorError("a node alone can't tell its place")
    return branch.compounds[0]


def part_predicate(part: Part) -> Column:
    """What a simple selector asks of an element row; never null."""
    kind, name, value = part.kind, part.name, part.value
    if kind == "tag":
        p = F.col("tag") == name
    elif kind == "any":
        return F.lit(True)
    elif kind == "class":
        p = has_class(name)
    elif kind == "id":
        p = F.col("id") == name
    elif kind == "first":
        p = F.col("elem_index") == 1
    elif kind == "last":
        p = F.col("elem_from_end") == 1
    elif kind == "nth":
        a, b = part.nth
        past = F.col("elem_index").cast("long") - F.lit(b).cast("long")
        p = past == 0 if a == 0 else (past % F.lit(a).cast("long") == 0) & (past * (1 if a > 0 else -1) >= 0)
    elif kind == "not":
        return ~compound_predicate(part.inner)
    elif part.op == "exists":
        p = has_attr(name)
    elif part.op == "=":
        p = attr_or_empty(name) == value
    elif part.op == "~=":
        p = has_token(attr_or_empty(name), value)
    elif not value:
        return F.lit(False)
    else:
        p = {"^=": Column.startswith, "$=": Column.endswith, "*=": Column.contains}[part.op](attr_or_empty(name), F.lit(value))
    return F.coalesce(p, F.lit(False))


def compound_predicate(parts: tuple[Part, ...]) -> Column:
    return reduce(lambda a, b: a & b, map(part_predicate, parts))


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'element'")


def related(rows: DataFrame, flag: str, combinator: str, out: str) -> DataFrame:
    """rows with column out: whether the combinator leads to the row from one whose flag is set."""
    document = Window.partitionBy("doc").orderBy("pre")
    siblings = Window.partitionBy("doc", "parent").orderBy("pre")
    before = (Window.unboundedPreceding, -1)
    if combinator == " ":
        reach = F.max(F.when(F.col(flag), F.col("subtree_end"))).over(document.rowsBetween(*before))
        return rows.withColumn(out, F.coalesce(reach >= F.col("pre"), F.lit(False)))
    if combinator == "+":
        return rows.withColumn(out, F.coalesce(F.lag(flag).over(siblings), F.lit(False)))
    if combinator == "~":
        return rows.withColumn(out, F.coalesce(F.max(flag).over(siblings.rowsBetween(*before)), F.lit(False)))
    # Each row twice: as a parent at its level, as a child one level up. A child's parent is the last row of that level before it.
    role, level = f"{out}_role", f"{out}_level"
    twice = rows.withColumn(role, F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(level, F.col("depth") - F.col(role))
    levels = Window.partitionBy("doc", level).orderBy("pre")
    last = F.last(F.when(F.col(role) == 0, F.struct("pre", F.col(flag).alias("hit"))), ignorenulls=True).over(levels.rowsBetween(*before))
    twice = twice.withColumn(out, last).where(F.col(role) == 1).drop(role, level)
    return twice.withColumn(out, F.coalesce((F.col(f"{out}.pre") == F.col("parent")) & F.col(f"{out}.hit"), F.lit(False)))


def flagged(nodes: DataFrame, css: str, out: str = "matched") -> DataFrame:
    """Element rows with a boolean column: whether they match the selector list."""
    rows, flags = elements(nodes), []
    for k, branch in enumerate(parse_selector(css)):
        flag = f"{out}_{k}_0"
        rows = rows.withColumn(flag, compound_predicate(branch.compounds[0]))
        for i, (combinator, compound) in enumerate(zip(branch.combinators, branch.compounds[1:], strict=True), 1):
            reached, last, flag = f"{out}_{k}_{i}r", flag, f"{out}_{k}_{i}"
            rows = related(rows, last, combinator, reached)
            rows = rows.withColumn(flag, F.col(reached) & compound_predicate(compound)).drop(reached, last)
        flags.append(flag)
    return rows.withColumn(out, reduce(lambda a, b: a | b, map(F.col, flags))).drop(*flags)


def select(nodes: DataFrame, css: str) -> DataFrame:
    """The element rows that match; document order is (doc, pre)."""
    branches = parse_selector(css)
    if all(not b.combinators for b in branches):  # row predicates alone: no shuffle
        return elements(nodes).where(reduce(lambda a, b: a | b, (compound_predicate(b.compounds[0]) for b in branches)))
    return flagged(nodes, css).where("matched").drop("matched")


def select_first(nodes: DataFrame, css: str) -> DataFrame:
    """Each document's first match."""
    return first_per_document(select(nodes, css))


def first_per_document(rows: DataFrame) -> DataFrame:
    names = rows.columns
    return rows.groupBy("doc").agg(F.min_by(F.struct(*names), "pre").alias("first")).select("first.*")


def select_within(nodes: DataFrame, roots: DataFrame, css: str) -> DataFrame:
    """Matches among the roots (doc, pre) and what is below them. Ancestors that a selector asks for may be outside."""
    marks = roots.select("doc", "pre").distinct().withColumn("is_root", F.lit(True))
    rows = flagged(nodes, css).join(marks, ["doc", "pre"], "left")
    window = Window.partitionBy("doc").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("is_root"), F.col("subtree_end"))).over(window)
    return rows.withColumn("covered", reach >= F.col("pre")).where("matched and covered").drop("matched", "covered", "is_root")


# Lookups


def find_by_tag(nodes: DataFrame, tag: str | None) -> DataFrame:
    """Elements of a name; None: all whose name isn't a known one."""
    from ..sources.tree import KNOWN

    if tag is None:
        return elements(nodes).where(~F.col("tag").isin(*sorted(KNOWN)))
    return elements(nodes).where(F.col("tag") == ascii_lower(tag))


def find_by_id(nodes: DataFrame, value: str) -> DataFrame:
    return first_per_document(elements(nodes).where(F.col("id") == value))


def find_by_class(nodes: DataFrame, name: str) -> DataFrame:
    return elements(nodes).where(has_class(name))


def find_by_attr(nodes: DataFrame, name: str, value: str) -> DataFrame:
    return elements(nodes).where(attr_or_empty(name) == value)


def document_index(nodes: DataFrame) -> dict[str, DataFrame]:
    """Tables by which ids, classes and tags are looked up: first node of an id, nodes of a class, nodes of a tag."""
    rows = elements(nodes)
    return {
        "ids": rows.where("id is not null").groupBy("doc", "doc_id", "id").agg(F.min("pre").alias("pre")),
        "classes": rows.select("doc", "doc_id", F.explode(F.array_distinct("classes")).alias("class"), "pre"),
        "tags": rows.select("doc", "doc_id", "tag", "pre"),
    }


def selection_summary(selected: DataFrame) -> DataFrame:
    """Per document: how many nodes a selection has, their texts one after another, its first node. Needs text_content."""
    ordered = F.array_sort(F.collect_list(F.struct("pre", "text_content")))
    return selected.groupBy("doc", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(ordered, lambda x: x["text_content"]), "").alias("text"), F.min("pre").alias("first_pre"))
