"""The catalogue of queries over the driver's tables, and the same rows in DuckDB SQL.

The SQL knows the fixed template of ``pages``; the queries don't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.encoding import detect_encoding, html_decode
from .functions.entities import C1, html_escape, html_escape_attribute, html_named, html_unescape, numeric_reference
from .operators.projections import attr, attr_or_empty, describe, has_children
from .plans import css
from .plans.inside import Path, find, summaries
from .sources import dom
from .streaming import chunks, early

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def page_nodes(spark: SparkSession, sf_dir: str, **wanted) -> DataFrame:
    return dom.parse_html(table(spark, sf_dir, "pages"), **wanted)


def found(spark: SparkSession, sf_dir: str, path: Path, *columns: str, **options) -> DataFrame:
    """What a path finds in the pages: one pass, no shuffle."""
    return find(table(spark, sf_dir, "pages"), path, columns, **options)


def page_id() -> Column:
    return F.col("doc_id").alias("page_id")


def big(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


# SQL parts

def dec(x: str) -> str:
    """Text of markup, for the four references that pages have."""
    return f"replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


def markup(x: str) -> str:
    """Markup as it is written again."""
    return f"replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"


LINKS = f"""l0 AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS texts FROM pages),
l AS (SELECT page_id, {dec("hrefs[i]")} AS href, {dec("texts[i]")} AS text, i AS n, len(hrefs) AS of FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS i FROM l0))"""
PARAGRAPHS = f"""p0 AS (SELECT page_id, string_split(regexp_extract(html, '</h1>(.*)</article>', 1, 's'), '<p>') AS parts FROM pages),
p AS (SELECT page_id, i - 1 AS n, parts[i] LIKE '<b>%' AS bold, {dec("replace(replace(replace(parts[i], '</p>', ''), '<b>', ''), '<br>', '')")} AS text
      FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM p0))"""
#: pages without what is inside their script, which looks like a tag
BARE = """b AS (SELECT page_id, regexp_replace(html, '<script>.*?</script>', '<script>x</script>', 's') AS html FROM pages)"""


def links_where(condition: str, columns: str = "page_id, href, text") -> str:
    return f"WITH {LINKS} SELECT {columns} FROM l WHERE {condition}"


LINK = ("attrs", "text_content")


def anchors(rows: DataFrame) -> DataFrame:
    return rows.select(page_id(), attr("href").alias("href"), F.col("text_content").alias("text"))


def counts(spark: SparkSession, sf_dir: str, path: Path) -> DataFrame:
    """How many nodes a path finds in each page, where it finds any."""
    return summaries(table(spark, sf_dir, "pages"), path, strings=False).where("n > 0").select(page_id(), "n")


def per_page(sql: str) -> str:
    """Counts of at least one."""
    return f"SELECT page_id, n FROM ({sql}) WHERE n > 0"


def count_of(pattern: str, source: str = "pages") -> str:
    return per_page(f"SELECT page_id, len(regexp_extract_all(html, '{pattern}'))::BIGINT AS n FROM {source}")


# Projections and selectors


@query("links", links_where("true"))
def links(spark, sf_dir):
    return anchors(found(spark, sf_dir, Path().select("nav li a[href]"), *LINK))


def _text_query(name: str, selector: str, pattern: str) -> None:
    @query(name, f"SELECT page_id, {dec(f'regexp_extract(html, {pattern!r}, 1, {chr(39)}s{chr(39)})')} AS value FROM pages")
    def run(spark, sf_dir):
        return found(spark, sf_dir, Path().select(selector), "text_content").select(page_id(), F.col("text_content").alias("value"))


_text_query("title", "title", "<title>(.*?)</title>")
_text_query("h1_text", "article > h1", "<h1>(.*?)</h1>")
_text_query("footer_text", "footer", "<footer>(.*?)</footer>")
_text_query("ad_text", "div.ad", '<div class="ad">(.*?)</div>')


@query("paragraph_text", f"WITH {PARAGRAPHS} SELECT page_id, n::BIGINT AS n, text FROM p")
def paragraph_text(spark, sf_dir):
    rows = found(spark, sf_dir, Path().select("article p"), "type_index", "text_content")
    return rows.select(page_id(), F.col("type_index").cast("long").alias("n"), F.col("text_content").alias("text"))


@query("tag_histogram", f"WITH {BARE} SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM b) GROUP BY tag")
def tag_histogram(spark, sf_dir):
    return found(spark, sf_dir, Path().select("*"), "tag").groupBy("tag").agg(big("n"))


_KINDS = f"""WITH {BARE}, k AS (
  SELECT 'element' AS kind, len(regexp_extract_all(html, '<[a-z]')) AS n FROM b UNION ALL SELECT 'comment', len(regexp_extract_all(html, '<!--')) FROM b
  UNION ALL SELECT 'doctype', len(regexp_extract_all(html, '<!DOCTYPE')) FROM b UNION ALL SELECT 'text', len(regexp_extract_all(html, '>[^<]+')) FROM b UNION ALL SELECT 'root', 1 FROM b)"""


@query("node_kind_counts", f"{_KINDS} SELECT kind, sum(n)::BIGINT AS n FROM k GROUP BY kind")
def node_kind_counts(spark, sf_dir):
    return found(spark, sf_dir, Path().all(), "kind").groupBy("kind").agg(big("n"))


@query("node_count", f"WITH {BARE} SELECT page_id, (1 + len(regexp_extract_all(html, '<[a-z!]')) + len(regexp_extract_all(html, '>[^<]+')))::BIGINT AS n FROM b")
def node_count(spark, sf_dir):
    return dom.parse(table(spark, sf_dir, "pages")).select(page_id(), F.col("node_count").cast("long").alias("n"))


def _count_query(name: str, selector: str, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        return counts(spark, sf_dir, Path().select(selector))


_count_query("child", "ul > li", count_of("<li>"))
_count_query("descendant", "nav a", count_of('<a href="'))
_count_query("general_sibling", "h1 ~ p", count_of("<p>"))
_count_query("child_chain", "body > nav > ul > li > a", count_of('<a href="'))
_count_query("sibling_chain", "head + body nav ~ article p", count_of("<p>"))
_count_query("wildcard", "article *", per_page(f"WITH {BARE} SELECT page_id, len(regexp_extract_all(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<[a-z]'))::BIGINT AS n FROM b"))
_count_query("no_match", "table td, nav p", "SELECT page_id, 0::BIGINT AS n FROM pages WHERE false")


@query("adjacent", f"WITH {PARAGRAPHS} SELECT page_id, text FROM p WHERE n = 1")
def adjacent(spark, sf_dir):
    return found(spark, sf_dir, Path().select("h1 + p"), "text_content").select(page_id(), F.col("text_content").alias("text"))


def _item_query(name: str, selector: str, condition: str) -> None:
    @query(name, links_where(condition, "page_id, text"))
    def run(spark, sf_dir):
        return found(spark, sf_dir, Path().select(selector), "text_content").select(page_id(), F.col("text_content").alias("text"))


_item_query("nth_odd", "li:nth-child(odd)", "n % 2 = 1")
_item_query("nth_formula", "li:nth-child(-2n+5)", "n <= 5 AND n % 2 = 1")
_item_query("first_child", "li:first-child", "n = 1")
_item_query("last_child", "li:last-child", "n = of")
_item_query("not_first", "li:not(:first-child)", "n > 1")


def _attr_query(name: str, selector: str, condition: str) -> None:
    @query(name, links_where(condition))
    def run(spark, sf_dir):
        return anchors(found(spark, sf_dir, Path().select(selector), *LINK))


_attr_query("attr_eq", 'a[href="/de"]', "href = '/de'")
_attr_query("attr_prefix", "a[HREF^='/th']", "starts_with(href, '/th')")
_attr_query("attr_suffix", "a[href$=er]", "ends_with(href, 'er')")
_attr_query("attr_substr", "a[href*='on']", "contains(href, 'on')")
_attr_query("attr_exists", "[href]", "true")
_attr_query("select_first", "li:first-child > a", "n = 1")
_count_query("attr_includes", 'div[class~="ad"]', count_of('<div class="ad">'))
_count_query("selector_list", "h1, title, nav a, a", per_page("SELECT page_id, (2 + len(regexp_extract_all(html, '<a href=\"')))::BIGINT AS n FROM pages"))


@query("select_first_link", links_where("n = 1"))
def select_first_link(spark, sf_dir):
    return anchors(found(spark, sf_dir, Path().select("a").first(), *LINK))


@query("scoped_select", links_where("true"))
def scoped_select(spark, sf_dir):
    return anchors(found(spark, sf_dir, Path().select("ul").select("body li > a"), *LINK))


@query("selection_summary", f"WITH {LINKS} SELECT page_id, count(*) AS n, string_agg(text, '' ORDER BY n) AS text FROM l GROUP BY page_id")
def selection_summary(spark, sf_dir):
    return summaries(table(spark, sf_dir, "pages"), Path().select("a")).where("n > 0").select(page_id(), "n", "text")


@query("find_by_tag", count_of("<p>"))
def find_by_tag(spark, sf_dir):
    return counts(spark, sf_dir, Path().by_tag("P"))


@query("find_by_class", count_of('class="ad"'))
def find_by_class(spark, sf_dir):
    return counts(spark, sf_dir, Path().by_class("ad"))


@query("find_by_attr", count_of('lang="en"'))
def find_by_attr(spark, sf_dir):
    return counts(spark, sf_dir, Path().by_attr("LANG", "en"))


@query("find_by_id", "SELECT page_id, 0::BIGINT AS n FROM pages WHERE false")
def find_by_id(spark, sf_dir):
    return counts(spark, sf_dir, Path().by_id("main"))


@query("find_unknown", "SELECT page_id, 0::BIGINT AS n FROM pages WHERE false")
def find_unknown(spark, sf_dir):
    return counts(spark, sf_dir, Path().by_tag(None))


@query("document_index", f"WITH {BARE} SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM b) GROUP BY ALL")
def document_index(spark, sf_dir):
    return css.document_index(page_nodes(spark, sf_dir))["tags"].groupBy(page_id(), "tag").agg(big("n"))


@query("top_tags", f"WITH {BARE} SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM b) GROUP BY tag ORDER BY n DESC, tag LIMIT 5")
def top_tags(spark, sf_dir):
    return tag_histogram(spark, sf_dir).orderBy(F.desc("n"), "tag").limit(5)


# XPath


def _xpath_query(name: str, expression: str, condition: str) -> None:
    @query(name, links_where(condition))
    def run(spark, sf_dir):
        return anchors(found(spark, sf_dir, Path().xpath(expression), *LINK))


_xpath_query("xpath_desc", "//A", "true")
_xpath_query("xpath_attr", "//a[@href='/de']", "href = '/de'")
_xpath_query("xpath_contains", "//a[contains(@href, 'on')]", "contains(href, 'on')")
_xpath_query("xpath_contains_empty", "//a[contains(@nothing, '')]", "true")
_xpath_query("xpath_wild", "//*[@href]", "true")
_xpath_query("xpath_abs", "/html/body/nav/ul/li[position()=2]/a", "n = 2")


@query("xpath_pos", links_where("n = 1", "page_id, text"))
def xpath_pos(spark, sf_dir):
    return found(spark, sf_dir, Path().xpath("//li[1]"), "text_content").select(page_id(), F.col("text_content").alias("text"))


@query("xpath_text", f"WITH {PARAGRAPHS} SELECT page_id, text FROM p WHERE NOT bold AND text <> ''")
def xpath_text(spark, sf_dir):
    return found(spark, sf_dir, Path().xpath("//p/text()"), "text").select(page_id(), "text")


@query("xpath_abs_text", f"SELECT page_id, {dec('''regexp_extract(html, '<title>(.*?)</title>', 1, 's')''')} AS text FROM pages")
def xpath_abs_text(spark, sf_dir):
    return found(spark, sf_dir, Path().xpath("/html/head/title/text()"), "text").select(page_id(), "text")


@query("xpath_parent", "SELECT page_id, 'ul' AS tag FROM pages WHERE contains(html, '<li>')")
def xpath_parent(spark, sf_dir):
    return found(spark, sf_dir, Path().select("li").xpath(".."), "tag").select(page_id(), "tag")


@query("xpath_in_selection", links_where("n = 1"))
def xpath_in_selection(spark, sf_dir):
    return anchors(found(spark, sf_dir, Path().select("ul").xpath("/li[1]/a"), *LINK))


# Axes


@query("ancestors_depth", links_where("true", "page_id, href, 6::BIGINT AS n"))
def ancestors_depth(spark, sf_dir):
    rows = found(spark, sf_dir, Path().select("a").axis("ancestors"), "parent", ctx_columns=("attrs",))
    # the root is the last of them: its place says how many there are
    return rows.where("parent is null").select(page_id(), attr("href", "ctx_attrs").alias("href"), (F.col("place") + 1).cast("long").alias("n"))


@query("children", "SELECT page_id, unnest(['element', 'comment', 'element', 'element', 'element']) AS kind, unnest(['nav', NULL, 'div', 'article', 'footer']) AS tag FROM pages")
def children(spark, sf_dir):
    return found(spark, sf_dir, Path().select("body").axis("children"), "kind", "tag").select(page_id(), "kind", "tag")


@query("siblings", "SELECT page_id, unnest(['comment', 'element', 'element', 'element']) AS kind, unnest([NULL, 'div', 'article', 'footer']) AS tag FROM pages")
def siblings(spark, sf_dir):
    return found(spark, sf_dir, Path().select("nav").axis("siblings"), "kind", "tag").select(page_id(), "kind", "tag")


@query("parents", count_of('<a href="'))
def parents(spark, sf_dir):
    return counts(spark, sf_dir, Path().select("a").axis("parent").by_tag("li"))


@query("descendants", per_page("SELECT page_id, (2 + 3 * len(regexp_extract_all(html, '<li>')))::BIGINT AS n FROM pages"))
def descendants(spark, sf_dir):
    return counts(spark, sf_dir, Path().select("nav").axis("descendants"))


@query("bfs_order", links_where("true", "page_id, text, (1 + of + n)::BIGINT AS place"))
def bfs_order(spark, sf_dir):
    rows = found(spark, sf_dir, Path().select("nav").axis("descendants_bfs").by_tag("a"), "text_content")
    return rows.select(page_id(), F.col("text_content").alias("text"), F.col("place").cast("long").alias("place"))


@query("neighbours", "SELECT page_id, 'nav' AS tag, 'ul' AS first_tag, 'body' AS up_tag, 'comment' AS next_tag, NULL::VARCHAR AS prev_tag FROM pages UNION ALL SELECT page_id, 'div', 'text', 'body', 'article', 'comment' FROM pages")
def neighbours(spark, sf_dir):
    from functools import reduce

    def one(name: str, alias: str) -> DataFrame:
        rows = found(spark, sf_dir, Path().select("nav, div").axis(name), "kind", "tag", ctx_columns=("tag",))
        return rows.select("doc_id", F.col("ctx_tag").alias("tag"), F.lit(alias).alias("which"), F.coalesce("tag", "kind").alias("name"))

    names = {"first_child": "first_tag", "parent": "up_tag", "next_sibling": "next_tag", "prev_sibling": "prev_tag"}
    rows = reduce(DataFrame.unionByName, (one(k, v) for k, v in names.items()))
    return rows.groupBy(page_id(), "tag").agg(*[F.max(F.when(F.col("which") == v, F.col("name"))).alias(v) for v in names.values()])


# Serialization and node projections


@query("outer_html_ad", f"""SELECT page_id, {markup('''regexp_extract(html, '<div class="ad">.*?</div>', 0, 's')''')} AS value FROM pages""")
def outer_html_ad(spark, sf_dir):
    return found(spark, sf_dir, Path().select(".ad"), "outer_html").select(page_id(), F.col("outer_html").alias("value"))


@query("inner_html_nav", f"SELECT page_id, {markup('''regexp_extract(html, '<nav>(.*?)</nav>', 1, 's')''')} AS value FROM pages")
def inner_html_nav(spark, sf_dir):
    return found(spark, sf_dir, Path().select("nav"), "inner_html").select(page_id(), F.col("inner_html").alias("value"))


_PARTS = """q0 AS (SELECT page_id, html, string_split(regexp_extract(html, '</h1>(.*)</article>', 1, 's'), '<p>') AS parts FROM pages),
q AS (SELECT page_id, string_agg(CASE WHEN parts[i] LIKE '<b>%' THEN '<p>' || parts[i] || '</b></p>' ELSE '<p>' || replace(parts[i], '</p>', '') || '</p>' END, '' ORDER BY i) AS body
      FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM q0) GROUP BY page_id)"""


@query("to_html", f"WITH {_PARTS} SELECT page_id, {markup("regexp_extract(html, '(.*</h1>)', 1, 's') || body || regexp_extract(html, '(</article>.*)', 1, 's') || CASE WHEN ends_with(html, '</html>') THEN '' ELSE '</body></html>' END")} AS value FROM pages JOIN q USING (page_id)")
def to_html(spark, sf_dir):
    return dom.parse(table(spark, sf_dir, "pages")).select(page_id(), F.col("doc_html").alias("value"))


@query("document_text_length", f"WITH {BARE} SELECT b.page_id, (length({dec('''regexp_replace(b.html, '<[^>]*>', '', 'gs')''')}) - 1 + length(regexp_extract(p.html, '<script>(.*?)</script>', 1, 's')))::BIGINT AS n FROM b JOIN pages p USING (page_id)")
def document_text_length(spark, sf_dir):
    return dom.parse(table(spark, sf_dir, "pages")).select(page_id(), F.length("doc_text").cast("long").alias("n"))


@query("attrs_exploded", f"WITH {LINKS} SELECT page_id, 'href' AS name, href AS value FROM l UNION ALL SELECT page_id, 'lang', regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) FROM pages UNION ALL SELECT page_id, 'charset', 'utf-8' FROM pages UNION ALL SELECT page_id, 'class', 'ad' FROM pages")
def attrs_exploded(spark, sf_dir):
    rows = found(spark, sf_dir, Path().all(), "attrs").select(page_id(), F.explode("attrs").alias("a"))
    return rows.select("page_id", F.col("a.name").alias("name"), F.col("a.value").alias("value"))


@query("leaf_elements", per_page("SELECT page_id, (1 + len(regexp_extract_all(html, '<br>')))::BIGINT AS n FROM pages"))
def leaf_elements(spark, sf_dir):
    rows = found(spark, sf_dir, Path().select("*"), "pre", "subtree_end", "is_void").where("is_void").where(~has_children())
    return rows.groupBy(page_id()).agg(big("n"))


@query("describe_comments", "SELECT page_id, '#comment' AS kind, regexp_extract(html, '<!--(.*?)-->', 1, 's') AS text FROM pages")
def describe_comments(spark, sf_dir):
    rows = found(spark, sf_dir, Path().all(), "pre", "depth", "kind", "tag", "text").where("kind = 'comment'")
    return rows.select(page_id(), F.substring_index(describe(), " ", 1).alias("kind"), "text")


@query("duplicate_links", f"WITH {LINKS} SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM l GROUP BY href HAVING count(*) > 1")
def duplicate_links(spark, sf_dir):
    rows = links(spark, sf_dir).groupBy("href").agg(big("n"), F.countDistinct("page_id").alias("pages"))
    return rows.where("n > 1")


# Scalar functions


@query("escape_text", "SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS value FROM documents")
def escape_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", html_escape(F.col("text")).alias("value"))


@query("escape_attr", """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS value FROM documents""")
def escape_attr(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", html_escape_attribute(F.col("text")).alias("value"))


@query("unescape_roundtrip", "SELECT doc_id, text AS value FROM documents")
def unescape_roundtrip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", html_unescape(html_escape_attribute(F.col("text")), attribute=True).alias("value"))


_C1_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in C1.items())


@query("numeric_refs", f"SELECT p_partkey, CASE p_partkey + 31 {_C1_CASES} ELSE chr((p_partkey + 31)::INTEGER) END AS value FROM part")
def numeric_refs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", numeric_reference(F.col("p_partkey") + 31).alias("value"))


@query("named_refs", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN '&' WHEN 1 THEN '©' WHEN 2 THEN '·' WHEN 3 THEN '≂̸' END AS value FROM nation")
def named_refs(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("amp", "copy", "middot", "NotEqualTilde", "Copy"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", html_named(name).alias("value"))


# Tokens and sources


@query("tokens_by_kind", f"""WITH {BARE}, k AS (
  SELECT 'open' AS kind, len(regexp_extract_all(html, '<[a-z]')) AS n FROM b UNION ALL SELECT 'close', len(regexp_extract_all(html, '</[a-z]')) FROM b
  UNION ALL SELECT 'comment', len(regexp_extract_all(html, '<!--')) FROM b UNION ALL SELECT 'doctype', len(regexp_extract_all(html, '<!DOCTYPE')) FROM b
  UNION ALL SELECT 'text', len(regexp_extract_all(html, '>[^<]+')) FROM b) SELECT kind, sum(n)::BIGINT AS n FROM k GROUP BY kind""")
def tokens_by_kind(spark, sf_dir):
    return dom.tokens(table(spark, sf_dir, "pages")).groupBy("kind").agg(big("n"))


@query("delimiters", "SELECT page_id, c AS byte, (length(html) - length(replace(html, c, '')))::BIGINT AS n FROM pages, (VALUES ('<'), ('>'), ('\"')) AS d(c) WHERE contains(html, c)")
def delimiters(spark, sf_dir):
    return dom.delimiters(table(spark, sf_dir, "pages")).where("byte <> \"'\"").groupBy(page_id(), "byte").agg(big("n"))


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("raw"))


@query("detect_encoding", "SELECT page_id, 'UTF-8' AS encoding FROM pages")
def detect_encodings(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", detect_encoding(F.col("raw")).alias("encoding"))


@query("decode_bytes", "SELECT page_id, md5(html) AS digest FROM pages")
def decode_bytes(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", F.md5(html_decode(F.col("raw"))["text"]).alias("digest"))


@query("parse_bytes", links_where("true"))
def parse_bytes(spark, sf_dir):
    return anchors(find(raw_pages(spark, sf_dir), Path().select("a"), LINK, html_col="raw"))


@query("too_large", "SELECT page_id, strlen(html) > 2000 AS too_large FROM pages")
def too_large(spark, sf_dir):
    parsed = dom.parse(table(spark, sf_dir, "pages"), options=dom.ParseOptions(2000))
    return parsed.select(page_id(), F.coalesce(F.col("error").startswith("InputTooLarge"), F.lit(False)).alias("too_large"))


@query("stream_chunks", links_where("true"))
def stream_chunks(spark, sf_dir):
    whole = chunks.assemble(chunks.chunked(raw_pages(spark, sf_dir), 64))
    return anchors(find(whole, Path().select("a"), LINK, "doc_id", "raw"))


@query("stream_links", links_where("true"))
def stream_links(spark, sf_dir):
    """A stream of chunks, put together as state and asked like any pages, until what is there is read."""
    from .streaming.files import run_available

    def links_of(stream: DataFrame) -> DataFrame:
        return anchors(find(chunks.assemble_stream(stream, ttl_ms=None), Path().select("a"), LINK, "doc_id", "raw"))

    return run_available(chunks.chunked(raw_pages(spark, sf_dir), 2048), links_of)


@query("decoded_chunks", "SELECT page_id, md5(html) AS digest FROM pages")
def decoded_chunks(spark, sf_dir):
    from .streaming.incremental import decode_chunks

    rows = decode_chunks(chunks.chunked(raw_pages(spark, sf_dir), 100))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return rows.groupBy(page_id()).agg(F.md5(text).alias("digest"))


@query("early_stop_first_article", "SELECT page_id, true AS matched, strpos(html, '<article>') + 8 AS consumed FROM pages")
def early_stop_first_article(spark, sf_dir):
    found = early.parse_until(table(spark, sf_dir, "pages"), early.has_tag("article"))
    return found.select(page_id(), "matched", F.col("chars_consumed").alias("consumed"))


@query("early_stop_heading", f"SELECT page_id, {dec('''regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')''')} AS text, strpos(html, '</h1>') + 4 AS consumed FROM pages")
def early_stop_heading(spark, sf_dir):
    found = early.parse_until(table(spark, sf_dir, "pages"), early.has_tag("h1"), "closed")
    return found.select(page_id(), F.col("text_content").alias("text"), F.col("chars_consumed").alias("consumed"))


@query("lang_of_pages", "SELECT regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, count(*) AS n FROM pages GROUP BY lang")
def lang_of_pages(spark, sf_dir):
    return found(spark, sf_dir, Path().select("html"), "attrs").groupBy(attr_or_empty("lang").alias("lang")).agg(big("n"))


# What no page of the tables has: markup made of a table's values, and what must become of it


def made(spark: SparkSession, sf_dir: str, html: str) -> DataFrame:
    """(page_id, html) for each nation; html is SQL over k, its key, and name."""
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", "n_name AS name").selectExpr("cast(k AS bigint) AS page_id", f"{html} AS html")


def _repair_query(name: str, html: str, becomes: str) -> None:
    """html and becomes: patterns in which {k} and {n} stand for a nation's key and name."""

    def sql(pattern: str) -> str:
        return "replace(replace('" + pattern.replace("'", "''") + "', '{k}', cast(k AS varchar(9))), '{n}', name)"

    @query(name, f"SELECT k::BIGINT AS page_id, {sql(becomes)} AS value FROM (SELECT n_nationkey AS k, n_name AS name FROM nation)".replace("\\n", "' || chr(10) || '"))
    def run(spark, sf_dir):
        pages = made(spark, sf_dir, sql(html).replace("\\n", "' || chr(10) || '").replace("varchar(9)", "string"))
        return dom.parse(pages).select(page_id(), F.col("doc_html").alias("value"))


_repair_query("repair_rows", "<table>{n}<td>{k}<th>h<tr><td>2</table>", "{n}<table><tbody><tr><td>{k}</td><th>h</th></tr><tr><td>2</td></tr></tbody></table>")
_repair_query("repair_columns", "<table><col width={k}><thead><tr><td>{n}<tfoot><tr><td>f</table>", '<table><colgroup><col width="{k}"></colgroup><thead><tr><td>{n}</td></tr></thead><tfoot><tr><td>f</td></tr></tfoot></table>')
_repair_query("foster_elements", "<section><table><em>{n}</em><tr><td>{k}</table></section>", "<section><em>{n}</em><table><tbody><tr><td>{k}</td></tr></tbody></table></section>")
_repair_query("select_filter", "<select><em>{n}</em><optgroup><option>{k}<option>2<optgroup></select>", "<select>{n}<optgroup><option>{k}</option><option>2</option></optgroup><optgroup></optgroup></select>")
_repair_query("adoption", "<i>{n}<section>{k}</i>tail</section>", "<i>{n}</i><section><i>{k}</i>tail</section>")
_repair_query("implied_closes", "<ol><li>{n}<li>{k}</ol><dl><dt>a<dd>b</dl><h4>{n}<h5>{k}", "<ol><li>{n}</li><li>{k}</li></ol><dl><dt>a</dt><dd>b</dd></dl><h4>{n}</h4><h5>{k}</h5>")
_repair_query("script_escapes", "<script>if(a<b)<!--<script>{n}</script>{k}--></script><u>{k}", "<script>if(a<b)<!--<script>{n}</script>{k}--></script><u>{k}</u>")
_repair_query("bogus_and_cdata", "{n}<![CDATA[<{k}>]]></ x><?pi {k}><!y>", "{n}&lt;{k}&gt;<!-- x--><!--?pi {k}--><!--y-->")
_repair_query("first_attribute", "<q TITLE={n} title=no data-k='{k}' data-K lang>t</q>", '<q TITLE="{n}" data-k="{k}" lang>t</q>')
_repair_query("leading_newline", "<pre>\\n{n}\\n</pre><p>\\n{k}", "<pre>{n}\\n</pre><p>\\n{k}</p>")
_repair_query("after_body", "<html><body>{n}</body><!--{k}--></html><!--e-->", "<html><body>{n}</body><!--{k}--></html><!--e-->")
_repair_query("table_veto", "<select><style></select><b>{n}</b></style>{k}", "<select></select><b>{n}</b>{k}")


@query("depth_cap", "SELECT n_nationkey::BIGINT AS page_id, (500 + n_nationkey + 1)::BIGINT AS n, least(500 + n_nationkey, 513)::BIGINT AS deepest FROM nation")
def depth_cap(spark, sf_dir):
    rows = find(made(spark, sf_dir, "repeat('<div>', 500 + k)"), Path().all(), ("depth",))
    return rows.groupBy(page_id()).agg(big("n"), F.max("depth").cast("long").alias("deepest"))


@query("custom_elements", "SELECT n_nationkey::BIGINT AS page_id, 'x-' || lower(n_name) AS tag, 'X-' || n_name AS name_src, n_nationkey::VARCHAR AS text FROM nation")
def custom_elements(spark, sf_dir):
    rows = find(made(spark, sf_dir, "'<p>a</p><X-' || name || '>' || k || '</x-' || name || '>'"), Path().by_tag(None), ("tag", "name_src", "text_content"))
    return rows.select(page_id(), "tag", "name_src", F.col("text_content").alias("text"))


_IDS = "'<div id=a><p id=n' || k || '>' || name || '</p><p id=n' || k || '>again</p></div><p id=N' || k || '>other'"


@query("ids", "SELECT n_nationkey::BIGINT AS page_id, n_name AS text FROM nation WHERE n_nationkey = 7")
def ids(spark, sf_dir):
    return find(made(spark, sf_dir, _IDS), Path().by_id("n7"), ("text_content",)).select(page_id(), F.col("text_content").alias("text"))


@query("id_selector", "SELECT n_nationkey::BIGINT AS page_id, unnest([n_name, 'again']) AS text FROM nation WHERE n_nationkey = 7")
def id_selector(spark, sf_dir):
    return find(made(spark, sf_dir, _IDS), Path().select("#a > p#n7"), ("text_content",)).select(page_id(), F.col("text_content").alias("text"))


@query("document_ids", "SELECT n_nationkey::BIGINT AS page_id, unnest(['a', 'n' || n_nationkey, 'N' || n_nationkey]) AS id, unnest([1, 2, 6])::INTEGER AS pre FROM nation")
def document_ids(spark, sf_dir):
    return css.document_index(dom.parse_html(made(spark, sf_dir, _IDS)))["ids"].select(page_id(), "id", "pre")


@query("first_of_selection", "SELECT n_nationkey::BIGINT AS page_id, 2::BIGINT AS n, n_name || 'again' AS text, n_name AS inner_html, 'n' || n_nationkey AS id FROM nation")
def first_of_selection(spark, sf_dir):
    rows = summaries(made(spark, sf_dir, _IDS), Path().select("div p"))
    return rows.select(page_id(), "n", "text", F.col("first_inner_html").alias("inner_html"), attr("id", "first_attrs").alias("id"))


@query("result_kinds", "SELECT n_nationkey::BIGINT AS page_id, unnest(['nodes', 'strings', 'nodes']) AS kind, unnest([3, 3, 0])::BIGINT AS n FROM nation")
def result_kinds(spark, sf_dir):
    from functools import reduce

    pages = made(spark, sf_dir, _IDS)
    rows = (summaries(pages, Path().xpath(x), strings=False).select(page_id(), "kind", "n") for x in ("//p", "//p/text()", "//table"))
    return reduce(DataFrame.unionByName, rows)


@query("repeated_ids", "SELECT n_regionkey::BIGINT AS page_id, count(*) AS n FROM nation GROUP BY n_regionkey")
def repeated_ids(spark, sf_dir):
    """Documents that share an id stay documents of their own: each has its own list."""
    rows = table(spark, sf_dir, "nation").selectExpr("cast(n_regionkey AS bigint) AS page_id", "'<ul><li>' || n_name || '</li></ul>' AS html")
    return css.select(dom.parse_html(rows), "ul > li:first-child").groupBy(page_id()).agg(big("n"))


@query("ids_of_any_type", "SELECT CASE WHEN n_regionkey > 0 THEN n_name END AS page_id, count(*) AS n FROM nation GROUP BY ALL")
def ids_of_any_type(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").selectExpr("CASE WHEN n_regionkey > 0 THEN n_name END AS page_id", "'<p>' || n_name AS html")
    return find(rows, Path().select("p")).groupBy(page_id()).agg(big("n"))


@query("legacy_encodings", """SELECT n_nationkey::BIGINT AS page_id, unnest(['windows-1252', 'windows-1252', 'UTF-16BE', 'UTF-8', 'UTF-8']) AS encoding,
       unnest(['é' || n_name, 'ü' || n_name, '日' || n_name, 'ß' || n_name, 'ø' || n_name]) AS text FROM nation""")
def legacy_encodings(spark, sf_dir):
    """A label of another name, a content type in bytes, a byte order mark, a label that can't be, and a declaration in a comment."""
    raws = (
        "encode('<meta charset=\"latin1\"><p>é' || name, 'ISO-8859-1')",
        "encode('<meta http-equiv=\"Content-Type\" content=\"text/html; charset=iso-8859-1\"><p>ü' || name, 'ISO-8859-1')",
        "encode('<p>日' || name, 'UTF-16')",
        "encode('<meta charset=utf-16le><p>ß' || name, 'UTF-8')",
        "encode('<!-- <meta charset=latin1> --><p>ø' || name, 'UTF-8')",
    )
    from functools import reduce

    pages = reduce(DataFrame.unionByName, (made(spark, sf_dir, raw) for raw in raws))
    return dom.parse(pages).select(page_id(), "encoding", F.col("doc_text").alias("text"))


@query("reparsed", "SELECT n_nationkey::BIGINT AS page_id, CASE WHEN n_nationkey % 3 = 0 THEN 'new ' || n_name ELSE n_name END AS text FROM nation UNION ALL SELECT 100 + n_nationkey, 'new ' || n_name FROM nation WHERE n_nationkey % 3 = 0")
def reparsed(spark, sf_dir):
    """A third of the documents again, a third too large to take their place, and some that weren't there."""
    kept = dom.parse(made(spark, sf_dir, "'<p>' || name"))
    third = made(spark, sf_dir, "CASE k % 3 WHEN 0 THEN '<p>new ' || name WHEN 1 THEN repeat('x', 1000) END").where("html is not null")
    more = made(spark, sf_dir, "'<p>new ' || name").where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 100)
    rows = dom.replace_documents(kept, third.unionByName(more), options=dom.ParseOptions(200))
    return rows.select(page_id(), F.col("doc_text").alias("text"))


@query("early_stop_bytes", "SELECT n_nationkey::BIGINT AS page_id, CASE WHEN n_nationkey < 20 THEN 'SubtreeComplete' END AS completeness, CASE WHEN n_nationkey < 20 THEN 'é' || n_name END AS text, CASE WHEN n_nationkey < 20 THEN '<meta charset=\"latin1\"><h1>é' || n_name || '</h1>' END AS partial, n_nationkey >= 20 AS too_large FROM nation")
def early_stop_bytes(spark, sf_dir):
    """Stops in bytes of a legacy encoding, with the document as far as it was built; some are too large."""
    raw = made(spark, sf_dir, "encode('<meta charset=latin1><h1>é' || name || '</h1><p>rest' || CASE WHEN k >= 20 THEN repeat('x', 1000) ELSE '' END, 'ISO-8859-1')")
    rows = early.parse_until(raw, early.accepts("h1"), "closed", options=dom.ParseOptions(500))
    return rows.select(page_id(), "completeness", F.col("text_content").alias("text"), F.col("doc_html").alias("partial"), F.col("error").isNotNull().alias("too_large"))


@query("made_trees", "SELECT n_regionkey::BIGINT AS page_id, '<ul>' || string_agg('<li>' || n_name || '</li>', '' ORDER BY n_nationkey) || '</ul>' AS value FROM nation GROUP BY n_regionkey")
def made_trees(spark, sf_dir):
    """Trees from rows: a region's list of nations."""
    from .sources.made import nodes_of, to_html

    rows = table(spark, sf_dir, "nation").selectExpr("cast(n_regionkey AS bigint) AS doc_id", "n_nationkey AS k", "n_name AS name")
    none = "cast(array() AS array<struct<name:string,value:string>>) AS attrs"
    lists = rows.select("doc_id").distinct().selectExpr("doc_id", "-1 AS node", "cast(null AS int) AS parent", "0 AS position", "'element' AS kind", "'ul' AS tag", "cast(null AS string) AS text", none)
    items = rows.selectExpr("doc_id", "2 * k AS node", "-1 AS parent", "k AS position", "'element' AS kind", "'li' AS tag", "cast(null AS string) AS text", none)
    texts = rows.selectExpr("doc_id", "2 * k + 1 AS node", "2 * k AS parent", "0 AS position", "'text' AS kind", "cast(null AS string) AS tag", "name AS text", none)
    return to_html(nodes_of(lists.unionByName(items).unionByName(texts))).select(page_id(), F.col("doc_html").alias("value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of all pages, with their texts."""
    return links(spark, sf_dir)
