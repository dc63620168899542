"""A subset of XPath 1.0: its grammar, and its plans over tables of nodes; pages are asked by ``plans.inside``.

    //name  //name[pred]  //*  //*[@a]  //*[@a='v']  /a/b[pred]/c  ..
    and /text() after any of those but ..

pred: @a, @a='v', contains(@a,'s'), position()=N, N. Positions count same-name
element siblings before anything else is asked. // includes the context node.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..operators.projections import attr_or_empty, has_attr
from .css import related

NAME = r"[A-Za-z0-9_:.\-\u0080-\U0010ffff]+"
LITERAL = r"""(?:'[^']*'|"[^"]*")"""
S = r"[ \t\n\r\f]*"
PREDICATE = re.compile(
    rf"""\[{S}(?:contains\({S}@(?P<c_attr>{NAME}){S},{S}(?P<c_value>{LITERAL}){S}\)|position\(\){S}={S}(?P<pos>\d+)|(?P<short>\d+)|@(?P<attr>{NAME}){S}(?:={S}(?P<value>{LITERAL}))?){S}\]"""
)
STEP = re.compile(rf"{S}({NAME})")


class XPathError(ValueError):
    """An expression outside the subset."""


@dataclass(frozen=True)
class Predicate:
    """kind: attr, equals, contains, position."""

    kind: str
    attr: str = ""
    value: str = ""
    position: int = 0


@dataclass(frozen=True)
class Step:
    name: str  # "*": any element
    predicate: Predicate | None = None


@dataclass(frozen=True)
class Expression:
    """axis: descendant (one step), path, parent."""

    axis: str
    steps: tuple[Step, ...] = ()
    text: bool = False


def _predicate(text: str, at: int) -> tuple[Predicate | None, int]:
    if text[at : at + 1] != "[":
        return None, at
    m = PREDICATE.match(text, at)
    if not m:
        raise XPathError(f"unsupported predicate at: {text[at:]}")
    if m["c_attr"]:
        p = Predicate("contains", m["c_attr"], m["c_value"][1:-1])
    elif m["attr"]:
        p = Predicate("attr", m["attr"]) if m["value"] is None else Predicate("equals", m["attr"], m["value"][1:-1])
    else:
        p = Predicate("position", position=int(m["pos"] or m["short"]))
    return p, m.end()


def parse_xpath(expression: str) -> Expression:
    text = expression.strip(" \t\n\r\f")
    wants_text = text.endswith("/text()")
    if wants_text:
        text = text[: -len("/text()")]
    if text == ".." and not wants_text:
        return Expression("parent")
    if text.startswith("//"):
        at = 2
        while text[at : at + 1] in tuple(" \t\n\r\f"):
            at += 1
        if text[at : at + 1] == "*":
            predicate, at = _predicate(text, at + 1)
            if predicate and predicate.kind not in ("attr", "equals"):
                raise XPathError("this predicate isn't supported on //*")
            step = Step("*", predicate)
        else:
            m = STEP.match(text, at)
            if not m:
                raise XPathError(f"expected a name at: {text[at:]}")
            predicate, at = _predicate(text, m.end())
            step = Step(ascii_lower(m[1]), predicate)
        if text[at:].strip(" \t\n\r\f"):
            raise XPathError(f"unexpected input at: {text[at:]}")
        return Expression("descendant", (step,), wants_text)
    if text.startswith("/"):
        at, steps = 0, []
        while at < len(text):
            if text[at] != "/":
                raise XPathError(f"expected '/' at: {text[at:]}")
            m = STEP.match(text, at + 1)
            if not m:
                raise XPathError(f"expected a name at: {text[at:]}")
            predicate, at = _predicate(text, m.end())
            steps.append(Step(ascii_lower(m[1]), predicate))
        return Expression("path", tuple(steps), wants_text)
    raise XPathError(f"expected '/' or '//' at: {text}")


def step_predicate(step: Step) -> Column:
    test = F.col("kind") == "element"
    if step.name != "*":
        test &= F.col("tag") == step.name
    p = step.predicate
    if p is None:
        return test
    if p.kind == "attr":
        more = has_attr(p.attr)
    elif p.kind == "equals":
        more = attr_or_empty(p.attr) == p.value
    elif p.kind == "contains":
        # an empty string is contained in everything, a missing attribute too
        more = F.coalesce(attr_or_empty(p.attr), F.lit("")).contains(p.value)
    else:
        more = F.col("type_index") == p.position
    return test & F.coalesce(more, F.lit(False))


def _under(nodes: DataFrame, contexts: DataFrame | None) -> DataFrame:
    """nodes with ctx: whether a row is a context (without contexts: the root), and covered: whether it is at or below one."""
    if contexts is None:
        return nodes.withColumn("ctx", F.col("parent").isNull()).withColumn("covered", F.lit(True))
    marks = contexts.select("doc", "pre").distinct().withColumn("ctx", F.lit(True))
    rows = nodes.join(marks, ["doc", "pre"], "left").withColumn("ctx", F.coalesce("ctx", F.lit(False)))
    window = Window.partitionBy("doc").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("covered", F.coalesce(F.max(F.when(F.col("ctx"), F.col("subtree_end"))).over(window) >= F.col("pre"), F.lit(False)))


def xpath(nodes: DataFrame, expression: str, contexts: DataFrame | None = None) -> DataFrame:
    """The node rows that an expression finds from each document's root or from contexts (doc, pre), once each.
    With /text(), the text nodes right under them: their strings are in column text. Order is (doc, pre)."""
    e = parse_xpath(expression)
    columns = nodes.columns
    if e.axis == "parent":
        if contexts is None:
            return nodes.where(F.lit(False))
        own = nodes.join(contexts.select("doc", "pre").distinct(), ["doc", "pre"], "left_semi")
        up = own.where("parent is not null").select("doc", F.col("parent").alias("pre")).distinct()
        return nodes.join(up, ["doc", "pre"], "left_semi")
    if e.axis == "descendant" and contexts is None and not e.text:
        return nodes.where(step_predicate(e.steps[0]))
    rows = _under(nodes, contexts)
    if e.axis == "descendant":
        rows = rows.withColumn("hit", step_predicate(e.steps[0]) & F.col("covered"))
    else:
        flag = "ctx"
        for i, step in enumerate(e.steps):
            rows = related(rows, flag, ">", f"under_{i}")
            rows = rows.withColumn(f"hit_{i}", F.col(f"under_{i}") & step_predicate(step)).drop(f"under_{i}", flag)
            flag = f"hit_{i}"
        rows = rows.withColumnRenamed(flag, "hit")
    if e.text:
        rows = related(rows, "hit", ">", "hit_text").where("hit_text and kind = 'text'")
    else:
        rows = rows.where("hit")
    return rows.select(*columns)
