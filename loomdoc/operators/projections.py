"""Columns of a node row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, lower_column


def _named(name: str, attrs: str = "attrs") -> Column:
    return F.filter(attrs, lambda a: lower_column(a["name"]) == ascii_lower(name))


def attr(name: str, attrs: str = "attrs") -> Column:
    """An attribute's value; null if it is missing or has none."""
    return F.try_element_at(_named(name, attrs), F.lit(1))["value"]


def has_attr(name: str) -> Column:
    return F.exists("attrs", lambda a: lower_column(a["name"]) == ascii_lower(name))


def attr_or_empty(name: str) -> Column:
    """The value for comparisons: "" if it has none; null if the attribute is missing."""
    return F.when(has_attr(name), F.coalesce(attr(name), F.lit("")))


def has_class(name: str) -> Column:
    return F.array_contains("classes", name) if name else F.lit(False)


def own_text() -> Column:
    return F.coalesce("text", F.lit(""))


def has_children() -> Column:
    return F.col("subtree_end") > F.col("pre")


def is_kind(kind: str) -> Column:
    return F.col("kind") == kind


def describe() -> Column:
    """A node in short, for people."""
    shown = F.when(is_kind("element"), F.concat(F.lit("<"), "tag", F.lit(">"))).otherwise(F.concat(F.lit("#"), "kind"))
    return F.format_string("%s pre=%d depth=%d", shown, "pre", "depth")
