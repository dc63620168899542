"""Paths within documents: against the plain matcher and against the plans over tables of nodes."""

import pytest
from pyspark.sql import functions as F

from loomdoc.operators import axes
from loomdoc.operators.projections import attr
from loomdoc.plans import css
from loomdoc.plans.inside import AXES, Path, find, summaries
from loomdoc.plans.xpath import XPathError, xpath
from loomdoc.sources import dom
from loomdoc.sources.dom import ParseOptions
from loomdoc.sources.tree import Tree

from .test_queries import PAGES, SELECTORS, TREES, expected


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").cache()


@pytest.fixture(scope="module")
def nodes(pages):
    return dom.parse_html(pages, text_content=True).cache()


def places(df):
    return sorted((r.doc_id, r.pre) for r in df.select("doc_id", "pre").collect())


def here(path):
    """What a path finds, without Spark."""
    return sorted((d, i) for d, html in enumerate(PAGES) for i in path.run(Tree.of(html))[0])


@pytest.mark.parametrize("selector", SELECTORS)
def test_select(selector):
    assert here(Path().select(selector)) == expected(selector)


@pytest.mark.parametrize("expression", ["//DIV", "//*[@href]", "//p[@data-k='']", "//p[contains(@class, 'a')]", "//p[contains(@nope, '')]", "//p[2]", "//p[0]", "/div/p", "/div[2]/ul[@class]", "//p/text()", "/div/text()", ".."])
def test_xpath(nodes, expression):
    assert here(Path().xpath(expression)) == places(xpath(nodes, expression))


def test_steps_after_steps(pages, nodes):
    ul = css.select(nodes, "ul")
    for path, rows in (
        (Path().select("ul").select("div *"), css.select_within(nodes, ul, "div *")),
        (Path().select("ul").xpath("/li"), xpath(nodes, "/li", ul)),
        (Path().select("ul").xpath("//ul"), xpath(nodes, "//ul", ul)),
        (Path().select("li").xpath(".."), xpath(nodes, "..", css.select(nodes, "li"))),
        (Path().select("div p").first(), css.select_first(nodes, "div p")),
        (Path().by_tag(None), css.find_by_tag(nodes, None)),
        (Path().by_tag("LI"), css.find_by_tag(nodes, "LI")),
        (Path().by_id("i1"), css.find_by_id(nodes, "i1")),
        (Path().by_class("b"), css.find_by_class(nodes, "b")),
        (Path().by_attr("DATA-K", ""), css.find_by_attr(nodes, "DATA-K", "")),
        (Path().select("ul").where(lambda t, i: t.depth[i] > 2), ul.where("depth > 2")),
    ):
        assert here(path) == places(rows) == places(find(pages, path))


def test_axes(pages, nodes):
    ctx = css.select(nodes, "ul, .c")
    near = axes.neighbours(nodes)

    def triples(df, column="pre"):
        return sorted((r.doc_id, r.ctx, r[column]) for r in df.collect() if r[column] is not None)

    for name in AXES:
        got = find(pages, Path().select("ul, .c").axis(name))
        if name in ("first_child", "next_sibling", "prev_sibling"):
            want = triples(near.join(ctx.select("doc", "pre"), ["doc", "pre"], "left_semi").withColumn("ctx", F.col("pre")), name)
        else:
            want = triples(getattr(axes, name)(nodes, ctx))
        assert triples(got) == want, name
    bfs = [(r.doc_id, r.ctx, r.place, r.pre) for r in find(pages, Path().select("ul, .c").axis("descendants_bfs")).orderBy("doc_id", "ctx", "place").collect()]
    assert bfs == [(r.doc_id, r.ctx, r.bfs, r.pre) for r in axes.descendants_bfs(nodes, ctx).orderBy("doc_id", "ctx", "bfs").collect()]
    up = [r.depth for r in find(pages, Path().select("li").axis("ancestors"), ("depth",)).orderBy("doc_id", "ctx", "place").collect()]
    assert all(b < a or b >= 0 for a, b in zip(up, up[1:])) and up.count(0) == len(expected("li"))
    assert here(Path().axis("children")) == sorted((d, r["pre"]) for d, t in enumerate(TREES) for r in t if r["parent"] == 0)


def test_columns_are_those_of_tables(pages, nodes):
    names = [c for c in nodes.columns if c not in ("doc", "doc_id")]
    got = find(pages, Path().all(), (*dom.NODE_FIELDS, "text_content", "inner_html", "outer_html"))
    sliced = dom.nodes(dom.parse(pages), text_content=True, inner_html=True, outer_html=True)
    assert sorted(map(repr, got.select("doc_id", *names, "inner_html", "outer_html").collect())) == sorted(map(repr, sliced.select("doc_id", *names, "inner_html", "outer_html").collect()))


def test_summaries(pages):
    got = {r.doc_id: r for r in summaries(pages, Path().select("p")).collect()}
    rows = find(pages, Path().select("p"), ("pre", "text_content", "outer_html", "inner_html", "attrs")).orderBy("doc_id", "pre").collect()
    for d in range(len(PAGES)):
        mine = [r for r in rows if r.doc_id == d]
        assert (got[d].n, got[d].text, got[d].kind, got[d].error) == (len(mine), "".join(r.text_content for r in mine), "nodes", None)
        first = mine[0] if mine else None
        assert (got[d].first_pre, got[d].first_html, got[d].first_inner_html, got[d].first_attrs) == ((first.pre, first.outer_html, first.inner_html, first.attrs) if first else (None,) * 4)
    assert summaries(pages, Path().xpath("//p/text()")).first().kind == "strings"
    few = summaries(pages, Path().select("p"), options=ParseOptions(20)).where("error is not null")
    assert few.count() == sum(len(p.encode()) > 20 for p in PAGES) and few.where("n is not null").count() == 0


def test_one_pass_and_no_shuffle(spark, tmp_path):
    spark.range(8).selectExpr("id AS page_id", "'<ul><li><a href=x>t</a></ul>' AS html").repartition(8).write.parquet(str(tmp_path / "p"))
    read = spark.read.option("maxPartitionBytes", "1k").parquet(str(tmp_path / "p"))
    for path in (Path().select("ul > li > a"), Path().xpath("/ul/li[1]/a"), Path().select("a").axis("ancestors"), Path().select("ul").axis("descendants_bfs"), Path().select("ul").select("ul li > a")):
        plan = find(read, path)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and plan.count("FileScan") == 1 and "Window" not in plan and "Join" not in plan
        assert "doc_id" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


@pytest.mark.parametrize("kind", ["bigint", "string", "struct<a:int>"])
def test_repeated_and_null_ids_are_documents_of_their_own(spark, kind):
    html = ["<ul><li>a<li>b</ul><p>c", "<div><p>d</p></div><ul></ul>", "<ul><p>e</p><li>f</ul>", "<p>g"]
    key = {"bigint": "1L", "string": "'one'", "struct<a:int>": "named_struct('a', 1)"}[kind]
    rows = spark.createDataFrame(list(enumerate(html)), "n int, html string").selectExpr(f"CASE WHEN n < 2 THEN {key} END AS page_id", "html")
    nodes = dom.parse_html(rows, text_content=True).cache()
    for selector, want in (("ul > li", ["a", "b", "f"]), ("ul p", ["e"]), ("div > p", ["d"]), ("li + li", ["b"]), ("ul ~ p", ["c"])):
        assert sorted(r.text_content for r in css.select(nodes, selector).collect()) == want
        assert sorted(r.text_content for r in find(rows, Path().select(selector), ("text_content",)).collect()) == want
    assert nodes.schema["doc_id"].dataType.simpleString() == kind
    assert axes.ancestors(nodes, css.select(nodes, "li")).count() == 6
    assert css.select_first(nodes, "p").count() == 4


def test_replaced_documents(spark):
    kept = dom.parse(spark.createDataFrame([(1, "<p>a"), (2, "<p>b"), (None, "<p>c")], "page_id long, html string"))
    new = spark.createDataFrame([(2, "<i>new"), (None, "<i>null"), (3, "<i>three"), (1, "x" * 100)], "page_id long, html string")
    got = dom.replace_documents(kept, new, options=ParseOptions(50))
    assert {r.doc_id: r.doc_html for r in got.collect()} == {1: "<p>a</p>", 2: "<i>new</i>", None: "<i>null</i>", 3: "<i>three</i>"}
    assert got.select("doc").distinct().count() == 4 and got.columns == kept.columns


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<meta charset=latin1><a href=é>x".encode("latin-1"))
    (tmp_path / "b.html").write_bytes(b"y" * 500)
    pages = dom.read_pages(spark, str(tmp_path), ParseOptions(100))
    got = {r.doc_id.rsplit("/", 1)[1]: r for r in dom.parse(pages, error_col="error").collect()}
    assert got["a.html"].encoding == "windows-1252" and got["b.html"].error.startswith("InputTooLarge") and got["b.html"].nodes == []
    link = find(pages, Path().select("a"), ("attrs",)).select(attr("href").alias("h")).collect()
    assert [r.h for r in link] == ["é"]


def test_tokens_of_bytes_and_limits(spark):
    df = spark.createDataFrame([("x", bytearray(b"<meta charset=latin1>\xe9<b>")), ("y", bytearray(b"<i>" * 50)), (None, None)], "page_id string, html binary")
    got = [(r.doc_id, r.kind, r.content or r.tag) for r in dom.tokens(df, options=ParseOptions(100)).orderBy("doc_id", "seq").collect()]
    assert got == [("x", "open", "meta"), ("x", "text", "é"), ("x", "open", "b")]


def test_large_batches_leave_in_slices(spark, monkeypatch):
    many = spark.range(40).selectExpr("id AS page_id", "repeat('<b>x</b>', 3000) AS html").coalesce(1)
    parsed = dom.parse(many)
    assert parsed.agg(F.sum("node_count"), F.sum(F.size("nodes"))).first()[0] == 40 * 6001
    assert find(many, Path().select("b")).count() == 40 * 3000


def test_bad_paths():
    with pytest.raises(css.SelectorError):
        Path().select("p >")
    with pytest.raises(XPathError):
        Path().xpath("//a//b")
    with pytest.raises(ValueError):
        Path().axis("following")
