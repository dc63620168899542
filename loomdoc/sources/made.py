"""Trees that are made by hand, without a parser and its repair."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .builder import Node
from .dom import NODE, NODE_FIELDS, arrow_of
from .tree import Tree


def nodes_of(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Nodes of trees that were made by hand: rows (doc_id, node, parent, position, kind, tag, text, attrs) to rows of NODE, without
    repair. Nodes are named by any numbers; roots have a null parent; position orders siblings. One task a document."""
    keyed = rows.select(F.xxhash64(doc_id).alias("doc"), F.col(doc_id).alias("doc_id"), "node", "parent", "position", "kind", "tag", "text", "attrs")
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        found = sorted(table.select(["node", "parent", "position", "kind", "tag", "text", "attrs"]).to_pylist(), key=lambda r: (r["position"] or 0, r["node"]))
        made = {r["node"]: Node(r["kind"], r["tag"], r["tag"], [(a["name"], a["value"]) for a in r["attrs"] or []], r["text"]) for r in found}
        root = Node("root")
        for r in found:
            (root if r["parent"] is None else made[r["parent"]]).append(made[r["node"]])
        tree = Tree(root)
        ids = [table.column(n).take(pa.array([0] * len(tree), pa.int32())).combine_chunks() for n in ("doc", "doc_id")]
        return pa.Table.from_arrays([*ids, *[arrow_of(n, tree.column(n)) for n in NODE_FIELDS]], ["doc", "doc_id", *NODE_FIELDS])

    return keyed.groupBy("doc").applyInArrow(build, f"doc long, doc_id {id_type}, {NODE}")


def to_html(nodes: DataFrame) -> DataFrame:
    """(doc, doc_id, doc_html): the markup of tables of nodes, from their own columns; one task a document."""
    id_type = nodes.schema["doc_id"].dataType.simpleString()

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("pre")
        made: list[Node] = []
        names = ("kind", "tag", "name_src", "attrs", "text", "parent", "self_closing")
        for kind, tag, name, attrs, text, parent, closing in zip(*(table.column(n).to_pylist() for n in names), strict=True):
            made.append(Node(kind, tag, name, [(a["name"], a["value"]) for a in attrs or []], text, bool(closing)))
            if parent is not None:
                made[parent].append(made[-1])
        ids = [table.column(n).slice(0, 1).combine_chunks() for n in ("doc", "doc_id")]
        return pa.Table.from_arrays([*ids, pa.array([Tree(made[0]).markup[0]], pa.string())], ["doc", "doc_id", "doc_html"])

    rows = nodes.select("doc", "doc_id", "pre", "kind", "tag", "name_src", "attrs", "text", "parent", "self_closing")
    return rows.groupBy("doc").applyInArrow(write, f"doc long, doc_id {id_type}, doc_html string")
