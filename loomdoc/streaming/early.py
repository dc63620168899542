"""Parsing that stops at the first node that a predicate accepts.

``created`` stops as soon as the node is made, elements when their start tag is
read and texts when their run ends; ``closed`` stops when a matching element
leaves the stack of open elements, or the document ends. The rest of the document
is not read. Bytes are decoded whole first, so what is read is what a whole parse
would have read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.css import compound_of
from ..plans.inside import part_test
from ..sources.builder import Node, TreeBuilder
from ..sources.dom import ParseOptions, documents, ids_schema, sources
from ..sources.tokenizer import scan
from ..sources.tree import Tree

EARLY = "matched boolean, completeness string, chars_consumed long, node_count int, pre int, tag string, text string, text_content string, outer_html string, doc_text string, doc_html string, error string"
NodePredicate = Callable[[Node], bool]


class EarlyStop:
    """First match of one document."""

    def __init__(self, predicate: NodePredicate, mode: str = "created"):
        if mode not in ("created", "closed"):
            raise ValueError("mode is created or closed")
        self.predicate, self.mode, self.match, self.done = predicate, mode, None, False
        self.builder = TreeBuilder(self._created, self._closed if mode == "closed" else None)

    def _created(self, node: Node) -> None:
        if self.match is None and self.predicate(node):
            self.match = node
            if self.mode == "created" or node.kind != "element":
                self._stop()

    def _closed(self, node: Node) -> None:
        if node is self.match:
            self._stop()

    def _stop(self) -> None:
        self.done = True
        self.builder.stopped = True

    def run(self, html: str) -> tuple[Node | None, int, Node]:
        """(the match, characters read, the root as far as it was built)."""
        read = scan(html, self.builder)
        if not self.done:
            self.builder.finish()
        return self.match, read, self.builder.root


def has_tag(tag: str) -> NodePredicate:
    return lambda node: node.kind == "element" and node.tag == tag


def accepts(css: str) -> NodePredicate:
    """Elements that a selector without combinators and positions accepts, as far as their start tag tells."""
    tests = [part_test(p) for p in compound_of(css)]

    class One:
        """A tree of the node alone."""

        def __init__(self, node: Node):
            self.nodes = [node]

    return lambda node: node.kind == "element" and all(t(One(node), 0) for t in tests)


def parse_until(pages: DataFrame, predicate: NodePredicate, mode: str = "created", id_col: str = "page_id", html_col: str = "html", options: ParseOptions = ParseOptions()) -> DataFrame:
    """A row per document: its first match and the document as far as it was built. completeness is Created or SubtreeComplete, or Done
    without a match; html_col is STRING or BINARY. The predicate goes to the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"matched": pa.bool_(), "completeness": pa.string(), "chars_consumed": pa.int64(), "node_count": pa.int32(), "pre": pa.int32()}
        kinds |= dict.fromkeys(("tag", "text", "text_content", "outer_html", "doc_text", "doc_html", "error"), pa.string())
        for batch in batches:
            out = []
            for text, _, error in sources(batch, options):
                row = dict.fromkeys(kinds) | {"matched": False, "error": error}
                if not error:
                    match, read, root = EarlyStop(predicate, mode).run(text or "")
                    tree = Tree(root)
                    row |= {"matched": match is not None, "chars_consumed": read, "node_count": len(tree), "completeness": "Done", "doc_text": tree.text, "doc_html": tree.markup[0]}
                    if match is not None:
                        i = tree.nodes.index(match)
                        row |= {"completeness": "Created" if mode == "created" else "SubtreeComplete", "pre": i, "tag": match.tag, "text": match.text}
                        row |= {c: tree.column(c, [i])[0] for c in ("text_content", "outer_html")}
                out.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[n] for r in out], k) for n, k in kinds.items()]], ["doc", "doc_id", *kinds])

    rows = documents(pages, id_col, html_col)
    return rows.mapInArrow(run, f"{ids_schema(rows)}, {EARLY}")
