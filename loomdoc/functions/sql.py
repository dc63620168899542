"""SQL names for the engine's functions: html_nodes, html_tokens, html_select and html_xpath (table functions), html_decode, html_text, html_escape,
html_unescape, detect_encoding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.inside import Path
from ..sources.dom import NODE, NODE_FIELDS, TOKEN, ParseOptions, parse_one
from ..sources.tokenizer import tokenize
from ..sources.tree import Tree
from .encoding import decode_or_detect, detect
from .entities import decode_entities, escape_text


def _scalar(f, kind: str, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], arrow)

    return run


class HtmlNodes:
    def eval(self, html: str) -> Iterator[tuple]:
        for row in parse_one(html, ParseOptions())["nodes"]:
            yield tuple([(a["name"], a["value"]) for a in row[n]] if n == "attrs" else row[n] for n in NODE_FIELDS)


class HtmlTokens:
    def eval(self, html: str) -> Iterator[tuple]:
        for i, t in enumerate(tokenize(html or "")):
            yield (i, t["kind"], t["tag"], t["name_src"], [(a["name"], a["value"]) for a in t["attrs"]], t["self_closing"], t["content"])


FOUND = "pre int, tag string, text_content string, inner_html string, outer_html string"


class HtmlSelect:
    def eval(self, html: str, css: str) -> Iterator[tuple]:
        yield from _found(html, Path().select(css))


class HtmlXPath:
    def eval(self, html: str, expression: str) -> Iterator[tuple]:
        yield from _found(html, Path().xpath(expression))


def _found(html: str, path: Path) -> Iterator[tuple]:
    tree = Tree.of(html or "")
    nodes = path.run(tree)[0]
    return zip(*(tree.column(f.split()[0], nodes) for f in FOUND.split(", ")), strict=True)


def register(spark: SparkSession) -> None:
    spark.udf.register("html_text", _scalar(lambda v: parse_one(v, ParseOptions())["doc_text"], "string", pa.string()))
    spark.udf.register("html_unescape", _scalar(decode_entities, "string", pa.string()))
    spark.udf.register("html_escape", _scalar(escape_text, "string", pa.string()))
    spark.udf.register("detect_encoding", _scalar(detect, "string", pa.string()))
    spark.udf.register("html_decode", _scalar(lambda v: decode_or_detect(v)[0], "string", pa.string()))
    spark.udtf.register("html_nodes", F.udtf(HtmlNodes, returnType=NODE))
    spark.udtf.register("html_select", F.udtf(HtmlSelect, returnType=FOUND))
    spark.udtf.register("html_xpath", F.udtf(HtmlXPath, returnType=FOUND))
    spark.udtf.register("html_tokens", F.udtf(HtmlTokens, returnType=TOKEN))
