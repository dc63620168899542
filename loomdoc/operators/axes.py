"""Traversal axes over tables of nodes: each takes the nodes and a set of context rows (doc, pre). Pages are asked by ``plans.inside``.

Results carry ctx, the context's pre. Every axis is linear in what it gives: a
context's descendants are the numbers up to its end, ancestors a walk up the
parents of its document, all others a join on the parent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _contexts(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """Contexts with their own labels."""
    keys = contexts.select("doc", F.col("pre").alias("ctx")).distinct()
    own = nodes.select("doc", F.col("pre").alias("ctx"), F.col("subtree_end").alias("ctx_end"), F.col("parent").alias("ctx_parent"))
    return own.join(keys, ["doc", "ctx"])


def descendants(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """Each context and what is below it; order by pre."""
    below = _contexts(nodes, contexts).select("doc", "ctx", F.explode(F.sequence("ctx", "ctx_end")).alias("pre"))
    return nodes.join(below, ["doc", "pre"])


def descendants_bfs(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """As descendants, with bfs: the place in level order, from 0."""
    order = Window.partitionBy("doc", "ctx").orderBy("depth", "pre")
    return descendants(nodes, contexts).withColumn("bfs", F.row_number().over(order) - 1)


def children(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    keys = contexts.select(F.col("doc").alias("ctx_doc"), F.col("pre").alias("ctx")).distinct()
    return nodes.join(keys, (nodes["doc"] == keys["ctx_doc"]) & (nodes["parent"] == keys["ctx"])).drop("ctx_doc")


def ancestors(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """Without the context itself, with the root; order by depth, deepest first."""

    def walk(tree: pa.Table, asked: pa.Table) -> pa.Table:
        up = dict(zip(tree.column("pre").to_pylist(), tree.column("parent").to_pylist(), strict=True))
        ctx, pre = [], []
        for c in asked.column("ctx").to_pylist():
            i = up.get(c)
            while i is not None:
                ctx.append(c)
                pre.append(i)
                i = up.get(i)
        doc = asked.column("doc")[0].as_py() if len(asked) else 0
        return pa.table({"doc": pa.array(np.full(len(ctx), doc, np.int64)), "ctx": pa.array(ctx, pa.int32()), "pre": pa.array(pre, pa.int32())})

    keys = contexts.select("doc", F.col("pre").alias("ctx")).distinct()
    above = nodes.select("doc", "pre", "parent").groupBy("doc").cogroup(keys.groupBy("doc")).applyInArrow(walk, "doc long, ctx int, pre int")
    return nodes.join(above, ["doc", "pre"])


def siblings(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """Later siblings of any kind."""
    c = _contexts(nodes, contexts).withColumnRenamed("doc", "ctx_doc")
    return nodes.join(c, (nodes["doc"] == c["ctx_doc"]) & (nodes["parent"] == c["ctx_parent"])).where("pre > ctx").drop("ctx_doc", "ctx_end", "ctx_parent")


def parent(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    c = _contexts(nodes, contexts).withColumnRenamed("doc", "ctx_doc")
    return nodes.join(c, (nodes["doc"] == c["ctx_doc"]) & (nodes["pre"] == c["ctx_parent"])).drop("ctx_doc", "ctx_end", "ctx_parent")


def neighbours(nodes: DataFrame) -> DataFrame:
    """nodes with first_child, next_sibling and prev_sibling; one shuffle by document at most."""
    near = Window.partitionBy("doc", "parent").orderBy("pre")
    out = nodes.withColumn("next_sibling", F.when(F.col("parent").isNotNull(), F.lead("pre").over(near))).withColumn("prev_sibling", F.when(F.col("parent").isNotNull(), F.lag("pre").over(near)))
    return out.withColumn("first_child", F.when(F.col("subtree_end") > F.col("pre"), F.col("pre") + 1))
