"""Documents and their nodes as DataFrames.

``parse`` gives one row per document: its text, its markup, and its nodes as an
array in pre-order, so node i is element i. ``nodes`` explodes that array.
Text content and markup of a node are slices of the document's two strings, so
they cost no join and no aggregation. ``plans.inside`` finds nodes within documents
and gives those alone; it is the way to ask a table of pages something, while
``nodes`` is for node tables that are kept and asked often.

Python sees a document once, here; whatever follows is a plan that Catalyst
optimises. Size limits are checked before parsing. Rows leave Python in slices of
``SLICE_NODES`` nodes, so memory doesn't grow with Arrow's batches.

``doc`` numbers the rows of a table and is the key of everything within documents;
``doc_id`` is the id column as it is, of any type.

Defined cases: rows that share an id, or have none, are documents of their own; a
null document is a row with a null everywhere but its ids and no nodes; an
oversized one has its error in words and no nodes; an empty one has its root alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import decode_or_detect
from .builder import Node
from .tokenizer import TokenList, scan
from .tree import KNOWN, Tree

__all__ = ["KNOWN", "NODE", "ParseOptions", "delimiters", "documents", "nodes", "number", "parse", "parse_html", "parse_one", "read_pages", "replace_documents", "tokens"]

NODE = (
    "pre int, subtree_end int, parent int, depth int, kind string, tag string, name_src string, is_void boolean, self_closing boolean, "
    "elem_index int, elem_from_end int, type_index int, prev_elem int, text string, attrs array<struct<name:string,value:string>>, id string, "
    "classes array<string>, text_start int, text_len int, html_start int, html_len int, inner_start int, inner_len int"
)
NODE_FIELDS = [f.split()[0] for f in NODE.split(", ")]
NODE_TYPES = dict(f.split(" ", 1) for f in NODE.split(", "))
DOCS = f"node_count int, encoding string, error string, doc_text string, doc_html string, nodes array<struct<{', '.join(f.replace(' ', ':', 1) for f in NODE.split(', '))}>>"
ATTRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
#: Nodes that a slice of parsed documents has about.
SLICE_NODES = 50_000


@dataclass(frozen=True)
class ParseOptions:
    max_input_size: int = 256 << 20

    def check(self, size: int) -> str | None:
        limit = min(self.max_input_size, (1 << 31) - 1)
        return f"InputTooLarge: {size} bytes, limit {limit}" if size > limit else None


def number(root: Node) -> tuple[list[dict], str, str]:
    """(rows in pre-order, text, markup) of a finished tree."""
    tree = Tree(root)
    columns = [tree.column(n) for n in NODE_FIELDS]
    rows = [dict(zip(NODE_FIELDS, values, strict=True)) for values in zip(*columns, strict=True)]
    for row in rows:
        row["attrs"] = [{"name": a, "value": v} for a, v in row["attrs"]]
    return rows, tree.text, tree.markup[0]


def read_source(source: str | bytes | None, options: ParseOptions) -> tuple[str | None, str | None, str | None]:
    """(text, encoding if it was detected, error). A size limit holds for bytes as they come and as decoded."""
    if source is None:
        return None, None, None
    size = len(source) if isinstance(source, bytes) else len(source) if source.isascii() else len(source.encode("utf-8", "surrogatepass"))
    if error := options.check(size):
        return None, None, error
    if not isinstance(source, bytes):
        return source, None, None
    text, encoding = decode_or_detect(source)
    error = options.check(len(text.encode("utf-8", "surrogatepass")))
    return (None if error else text), encoding, error


def parse_one(source: str | bytes | None, options: ParseOptions = ParseOptions()) -> dict:
    """A document's row, without its ids."""
    text, encoding, error = read_source(source, options)
    out: dict = {"node_count": None, "encoding": encoding, "error": error, "doc_text": None, "doc_html": None, "nodes": []}
    if text is not None:
        out["nodes"], out["doc_text"], out["doc_html"] = number(Tree.of(text).nodes[0])
        out["node_count"] = len(out["nodes"])
    return out


def arrow_of(name: str, values: list) -> pa.Array:
    """A column of NODE, or a string made from one, as Arrow."""
    kind = NODE_TYPES.get(name, "string")
    if name == "attrs":
        flat = [a for attrs in values for a in attrs]
        offsets = [0]
        for attrs in values:
            offsets.append(offsets[-1] + len(attrs))
        pair = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.string())], ["name", "value"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pair)
    return pa.array(values, {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[kind])


def documents(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", error_col: str | None = None) -> DataFrame:
    """(doc, doc_id, html, error) of pages. A scan of fewer splits than there are cores is dealt over all of them: parsing is bound by
    CPU, and a small table is one split. Rows are dealt by their own numbers, so a rerun deals them alike. What comes out of a
    shuffle is left as it is. A stream's documents are numbered by a hash of their ids; each comes once."""
    error = F.col(error_col) if error_col else F.lit(None)
    doc = F.xxhash64(id_col) if pages.isStreaming else F.monotonically_increasing_id()
    rows = pages.select(doc.alias("doc"), F.col(id_col).alias("doc_id"), F.col(html_col).alias("html"), error.cast("string").alias("error"))
    if pages.isStreaming:
        return rows
    plan = pages._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":  # it has a shuffle, and counting its partitions would run it
        return rows
    n = pages.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n, "doc") if plan.execute().getNumPartitions() < n else rows


def sources(batch: pa.RecordBatch, options: ParseOptions) -> Iterator[tuple[str | None, str | None, str | None]]:
    """read_source of each row of documents; an error that a row has already stays."""
    for source, error in zip(batch.column(2), batch.column(3), strict=True):
        yield (None, None, error.as_py()) if error.is_valid else read_source(source.as_py(), options)


def ids_schema(rows: DataFrame) -> str:
    return f"doc long, doc_id {rows.schema['doc_id'].dataType.simpleString()}"


def parse(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", options: ParseOptions = ParseOptions(), error_col: str | None = None) -> DataFrame:
    """A row per document: doc, doc_id and DOCS. html_col is STRING or BINARY; of bytes the encoding is detected. error_col, if there is
    one, has the errors of documents that couldn't be read. pages may be a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {n: [] for n in NODE_FIELDS}
            docs: list[tuple] = []
            first = total = 0

            def flush(upto: int) -> pa.RecordBatch:
                offsets = [0]
                for d in docs:
                    offsets.append(offsets[-1] + (d[0] or 0))
                nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([arrow_of(n, v) for n, v in held.items()], NODE_FIELDS))
                kinds = {"node_count": pa.int32(), "encoding": pa.string(), "error": pa.string(), "doc_text": pa.string(), "doc_html": pa.string()}
                cols = [pa.array([d[k] for d in docs], kind) for k, kind in enumerate(kinds.values())]
                ids = batch.slice(first, upto - first)
                return pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), *cols, nodes], ["doc", "doc_id", *kinds, "nodes"])

            for i, (text, encoding, error) in enumerate(sources(batch, options)):
                if text is None:
                    docs.append((None, encoding, error, None, None))
                else:
                    tree = Tree.of(text)
                    docs.append((len(tree), encoding, error, tree.text, tree.markup[0]))
                    for n, to in held.items():
                        to.extend(tree.column(n))
                    total += len(tree)
                if total >= SLICE_NODES:
                    yield flush(i + 1)
                    held, docs = {n: [] for n in NODE_FIELDS}, []
                    first, total = i + 1, 0
            if docs:
                yield flush(batch.num_rows)

    rows = documents(pages, id_col, html_col, error_col)
    return rows.mapInArrow(run, f"{ids_schema(rows)}, {DOCS}")


def nodes(parsed: DataFrame, where: Column | None = None, text_content: bool = False, inner_html: bool = False, outer_html: bool = False) -> DataFrame:
    """A row per node; `where` filters on node columns before any string is cut."""
    out = parsed.select("doc", "doc_id", "doc_text", "doc_html", F.explode("nodes").alias("n")).select("doc", "doc_id", "doc_text", "doc_html", "n.*")
    if where is not None:
        out = out.where(where)
    for wanted, name, source, start in ((text_content, "text_content", "doc_text", "text"), (inner_html, "inner_html", "doc_html", "inner"), (outer_html, "outer_html", "doc_html", "html")):
        if wanted:
            out = out.withColumn(name, F.substring(F.col(source), F.col(f"{start}_start") + 1, F.col(f"{start}_len")))
    return out.drop("doc_text", "doc_html")


def parse_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", options: ParseOptions = ParseOptions(), text_content: bool = False, inner_html: bool = False, outer_html: bool = False, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Every node of pages: a row each, doc, doc_id and the columns of NODE (or those named), and what else is wanted of each."""
    from ..plans.inside import Path, find

    wanted = [n for n, on in (("text_content", text_content), ("inner_html", inner_html), ("outer_html", outer_html)) if on]
    return find(pages, Path().all(), (*(columns or NODE_FIELDS), *wanted), id_col, html_col, options).drop("ctx", "place")


def replace_documents(kept: DataFrame, pages: DataFrame, id_col: str = "page_id", html_col: str = "html", options: ParseOptions = ParseOptions()) -> DataFrame:
    """kept, as parse gives it, with the documents of pages parsed again in place of those that have their ids. A document that is
    too large now leaves the one before as it was; ids are equal if they are or if both are null, and new ones are added."""
    new = parse(pages, id_col, html_col, options)
    good = new.where("error is null")
    gone = good.select(F.col("doc_id").alias("new_id")).distinct()
    stay = kept.join(gone, kept["doc_id"].eqNullSafe(gone["new_id"]), "left_anti")
    last = stay.agg(F.max("doc")).first()[0]
    return stay.unionByName(good.withColumn("doc", F.col("doc") + F.lit(-1 if last is None else last) + 1))


def read_pages(spark: SparkSession, paths: str | list[str], options: ParseOptions = ParseOptions()) -> DataFrame:
    """(page_id, html, error) of files: the path, the bytes, and an error in words for a file that can't be read or is too large,
    which then isn't read at all."""
    files = spark.read.format("binaryFile").load(paths)
    large = F.col("length") > min(options.max_input_size, (1 << 31) - 1)
    error = F.when(large, F.concat(F.lit("InputTooLarge: "), "length", F.lit(f" bytes, limit {min(options.max_input_size, (1 << 31) - 1)}")))
    found = files.where(~large).select(F.col("path").alias("page_id"), F.col("content").alias("html"), F.lit(None).cast("string").alias("error"))
    return found.unionByName(files.where(large).select(F.col("path").alias("page_id"), F.lit(None).cast("binary").alias("html"), error.alias("error")))


TOKEN = "seq int, kind string, tag string, name_src string, attrs array<struct<name:string,value:string>>, self_closing boolean, content string"


def tokens(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", options: ParseOptions = ParseOptions()) -> DataFrame:
    """A row per token: doc, doc_id, seq and the token. html_col is STRING or BINARY; a document that is too large, or null, has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"kind": pa.string(), "tag": pa.string(), "name_src": pa.string(), "attrs": ATTRS, "self_closing": pa.bool_(), "content": pa.string()}
        for batch in batches:
            for i, (text, _, _) in enumerate(sources(batch, options)):
                sink = TokenList()
                if text:
                    scan(text, sink)
                found = sink.finish()
                for at in range(0, len(found), SLICE_NODES):
                    part = found[at : at + SLICE_NODES]
                    cols = [pa.array([t[n] for t in part], k) for n, k in kinds.items()]
                    ids = [batch.column(k).take(pa.array([i] * len(part), pa.int32())) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(range(at, at + len(part)), pa.int32()), *cols], ["doc", "doc_id", "seq", *kinds])

    rows = documents(pages, id_col, html_col)
    return rows.mapInArrow(run, f"{ids_schema(rows)}, {TOKEN}")


DELIMITERS = np.frombuffer("<>\"'".encode("utf-32-le"), "<u4")


def delimiters(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc, doc_id, pos, byte): every one of < > " ' in the text, by character position from 0, in one pass over its code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, source in enumerate(batch.column(2)):
                chars = np.frombuffer((source.as_py() or "").encode("utf-32-le", "surrogatepass"), "<u4")
                at = np.flatnonzero(np.isin(chars, DELIMITERS))
                ids = [batch.column(k).take(pa.array(np.full(len(at), i, np.int32))) for k in (0, 1)]
                found = pa.array([chr(c) for c in chars[at].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*ids, pa.array(at.astype(np.int32)), found], ["doc", "doc_id", "pos", "byte"])

    rows = documents(pages, id_col, html_col)
    return rows.mapInArrow(run, f"{ids_schema(rows)}, pos int, byte string")
