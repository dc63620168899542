"""Selectors, paths and axes: Spark plans against a plain matcher on random trees."""

import random

import pytest
from pyspark.sql import functions as F

from loomdoc.operators import axes
from loomdoc.plans import css
from loomdoc.plans.xpath import XPathError, parse_xpath, xpath
from loomdoc.sources import dom
from loomdoc.sources.builder import build
from loomdoc.sources.dom import number


def random_page(rng, n=40):
    tags, out, open_ = ["div", "p", "span", "ul", "li", "x-y"], [], []
    for _ in range(n):
        if open_ and rng.random() < 0.4:
            out.append(f"</{open_.pop()}>")
            continue
        tag = rng.choice(tags)
        attrs = "".join(rng.choice(["", ' class="a b"', " class=c", f" id=i{rng.randrange(4)}", ' data-k="v w"', " data-k", ' href="/q.html"']) for _ in range(2))
        out.append(f"<{tag}{attrs}>{rng.choice(['', 't', '<!--c-->'])}")
        open_.append(tag)
    return "".join(out)


PAGES = [random_page(random.Random(i)) for i in range(12)] + ["", "just text", "<p class=a>x<p class=b>y"]


@pytest.fixture(scope="module")
def nodes(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")
    return dom.parse_html(pages, text_content=True).cache()


TREES = [number(build(h))[0] for h in PAGES]


def attr(row, name):
    """None: missing."""
    return next((a["value"] or "" for a in row["attrs"] if a["name"].lower() == name.lower()), None)


def matches_part(row, part):
    k, v = part.kind, None
    if k in ("tag", "any"):
        return k == "any" or row["tag"] == part.name
    if k == "class":
        return part.name in row["classes"]
    if k == "id":
        return row["id"] == part.name
    if k == "first":
        return row["elem_index"] == 1
    if k == "last":
        return row["elem_from_end"] == 1
    if k == "nth":
        a, b = part.nth
        return any(a * n + b == row["elem_index"] for n in range(200))
    if k == "not":
        return not all(matches_part(row, p) for p in part.inner)
    v = attr(row, part.name)
    if v is None:
        return False
    w = part.value
    return {"exists": True, "=": v == w, "~=": w != "" and w in v.split(), "^=": w != "" and v.startswith(w), "$=": w != "" and v.endswith(w), "*=": w != "" and w in v}[part.op]


def matches(rows, row, branch, i=None):
    i = len(branch.compounds) - 1 if i is None else i
    if row["kind"] != "element" or not all(matches_part(row, p) for p in branch.compounds[i]):
        return False
    if i == 0:
        return True
    c = branch.combinators[i - 1]
    if c == " ":
        near = [r for r in rows if r["pre"] < row["pre"] <= r["subtree_end"]]
    elif c == ">":
        near = [rows[row["parent"]]]
    else:
        near = [r for r in rows if r["kind"] == "element" and r["parent"] == row["parent"] and r["pre"] < row["pre"]]
        near = near[-1:] if c == "+" else near
    return any(matches(rows, r, branch, i - 1) for r in near)


def expected(selector):
    branches = css.parse_selector(selector)
    return sorted((d, r["pre"]) for d, rows in enumerate(TREES) for r in rows if any(matches(rows, r, b) for b in branches))


def found(df):
    return sorted((r.doc_id, r.pre) for r in df.select("doc_id", "pre").collect())


SELECTORS = [
    "div", "DIV", "x-Y", "*", ".a", "p.a.b", "#i1", "[href]", "[data-k]", "[data-k='']", "[data-k~=w]", "[data-k~='']", "[href^='/q']", "[href$=.html]", "[href*='']",
    "li:first-child", "li:last-child", ":nth-child(2n+1)", ":nth-child(-n+2)", ":nth-child(3)", "p:not(.a)", ":not(:not(.c))", "div p", "div > p", "div + p", "p ~ span",
    "div > ul li p", "ul > li + li ~ p", "div div > span, #i0, .c > *", "* + *", "* * *", "p > p > p", ":not(div) > .a", "span ~ * > [class]",
]


@pytest.mark.parametrize("selector", SELECTORS)
def test_select(nodes, selector):
    assert found(css.select(nodes, selector)) == expected(selector)


@pytest.mark.parametrize(
    "bad",
    ["", ">", "div >", ", p", "p,", "div..a", "[a", "[a|=b]", "[a=b i]", ":hover", ":nth-child(x)", ":nth-child(99999999999)", "p::before", ":not()", ":not(a b)", "a{", "1a", "#", "x" * 20000, ",".join("a" * 65), " ".join("a" * 66), "." + ".".join("a" * 300), ":not(" * 17 + "a" + ")" * 17],
)
def test_bad_selectors(bad):
    with pytest.raises(css.SelectorError):
        css.parse_selector(bad)


def test_escapes():
    assert css.parse_selector(r".a\:b\31 x")[0].compounds[0][0].name == "a:b1x"
    assert css.parse_selector(r'[a="\"\41 b"]')[0].compounds[0][0].value == '"Ab'
    assert css.parse_selector("[a=x.y]")[0].compounds[0][0].value == "x.y"
    assert css.parse_selector(r"\64 iv")[0].compounds[0][0].name == "div"


def test_first_within_and_lookups(nodes):
    all_p = expected("div p")
    assert found(css.select_first(nodes, "div p")) == [min(x for x in all_p if x[0] == d) for d in sorted({d for d, _ in all_p})]
    roots = css.select(nodes, "ul")
    ul = expected("ul")
    want = [(d, p) for d, p in expected("div *") if any(r <= p <= TREES[d][r]["subtree_end"] for e, r in ul if e == d)]
    assert found(css.select_within(nodes, roots, "div *")) == want
    assert found(css.find_by_tag(nodes, None)) == expected("x-y")
    assert found(css.find_by_attr(nodes, "DATA-K", "")) == expected("[data-k='']")
    ids = css.document_index(nodes)["ids"].collect()
    assert sorted((r.doc_id, r.pre) for r in ids if r.id == "i1") == found(css.find_by_id(nodes, "i1"))


def test_select_uses_one_shuffle(nodes, spark):
    plan = css.select(spark.createDataFrame(nodes.limit(1).collect(), nodes.schema), "div p > span + *")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc#") == 1


def names(step, rows, parents):
    return [r for r in rows if r["kind"] == "element" and r["parent"] in parents and r["tag"] == step]


def test_xpath(nodes):
    assert found(xpath(nodes, "//DIV")) == expected("div")
    assert found(xpath(nodes, "//*[@href]")) == expected("[href]")
    assert found(xpath(nodes, "//p[@data-k='']")) == expected("p[data-k='']")
    assert found(xpath(nodes, "//p[contains(@class, 'a')]")) == expected("p[class*=a]")
    assert found(xpath(nodes, "//p[contains(@nope, '')]")) == expected("p")
    second = [(d, r["pre"]) for d, rows in enumerate(TREES) for r in rows if r["tag"] == "p" and r["type_index"] == 2]
    assert found(xpath(nodes, "//p[2]")) == found(xpath(nodes, "//p[ position() = 2 ]")) == second
    assert found(xpath(nodes, "//p[0]")) == []
    want = []
    for d, rows in enumerate(TREES):
        level = {0}
        for step in ("div", "p"):
            level = {r["pre"] for r in names(step, rows, level)}
        want += [(d, p) for p in sorted(level)]
    assert found(xpath(nodes, "/div/p")) == want
    texts = [(d, r["pre"]) for d, rows in enumerate(TREES) for r in rows if r["kind"] == "text" and rows[r["parent"]]["tag"] == "p"]
    assert found(xpath(nodes, "//p/text()")) == texts
    ul = css.select(nodes, "ul")
    assert found(xpath(nodes, "/li", ul)) == expected("ul > li")
    assert found(xpath(nodes, "//ul", ul)) == expected("ul")
    up = sorted({(d, TREES[d][p]["parent"]) for d, p in expected("li")})
    assert found(xpath(nodes, "..", css.select(nodes, "li"))) == up
    assert found(xpath(nodes, "..")) == []


@pytest.mark.parametrize("bad", ["", "p", "//", "//a//b", "//a/b", "//*[1]", "//a[last()]", "//a[@x>1]", "/a[", "//a | //b", "../a", "//a[@x='y]", "//a[contains(text(),'x')]"])
def test_bad_paths(bad):
    with pytest.raises(XPathError):
        parse_xpath(bad)


def test_axes(nodes):
    ctx = css.select(nodes, "ul, .c")
    keys = expected("ul, .c")

    def pairs(df):
        return sorted((r.doc_id, r.ctx, r.pre) for r in df.collect())

    assert pairs(axes.descendants(nodes, ctx)) == sorted((d, c, r["pre"]) for d, c in keys for r in TREES[d] if c <= r["pre"] <= TREES[d][c]["subtree_end"])
    assert pairs(axes.children(nodes, ctx)) == sorted((d, c, r["pre"]) for d, c in keys for r in TREES[d] if r["parent"] == c)
    assert pairs(axes.ancestors(nodes, ctx)) == sorted((d, c, r["pre"]) for d, c in keys for r in TREES[d] if r["pre"] < c <= r["subtree_end"])
    assert pairs(axes.siblings(nodes, ctx)) == sorted((d, c, r["pre"]) for d, c in keys for r in TREES[d] if r["parent"] == TREES[d][c]["parent"] and r["pre"] > c)
    assert pairs(axes.parent(nodes, ctx)) == sorted((d, c, TREES[d][c]["parent"]) for d, c in keys)
    order = [(r.doc_id, r.ctx, r.pre) for r in axes.descendants_bfs(nodes, ctx).orderBy("doc_id", "ctx", "bfs").collect()]
    assert order == [(d, c, r["pre"]) for d, c in keys for r in sorted((r for r in TREES[d] if c <= r["pre"] <= TREES[d][c]["subtree_end"]), key=lambda r: (r["depth"], r["pre"]))]
    near = {(r.doc_id, r.pre): r for r in axes.neighbours(nodes).collect()}
    for d, rows in enumerate(TREES):
        for r in rows:
            kids = [x["pre"] for x in rows if x["parent"] == r["pre"]]
            assert near[d, r["pre"]].first_child == (kids[0] if kids else None)
            for a, b in zip(kids, kids[1:]):
                assert near[d, a].next_sibling == b and near[d, b].prev_sibling == a


def test_text_content_by_join(nodes):
    inner = nodes.where("kind = 'text'").select("doc", F.col("pre").alias("tpre"), F.col("text").alias("t"))
    rows = css.select(nodes, "div").join(inner, "doc").where("tpre between pre and subtree_end")
    want = rows.groupBy("doc", "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tpre", "t"))), lambda x: x["t"]), "").alias("joined"), F.first("text_content").alias("sliced"))
    assert want.where("joined <> sliced").count() == 0
