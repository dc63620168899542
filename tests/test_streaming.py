"""Chunks in batch and as a stream, early stop, SQL functions."""

import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomdoc.functions.sql import register
from loomdoc.plans.inside import Path, find
from loomdoc.sources import dom
from loomdoc.sources.dom import ParseOptions, parse_one
from loomdoc.sources.tokenizer import tokenize
from loomdoc.streaming import chunks, early, files
from loomdoc.streaming.incremental import StreamParser, StreamTokenizer, decode_chunks

PAGES = ["<p>é</p>" * 30, "", '<meta charset="latin1"><pre>\r\nx' + "y" * 2000, "<script>a</script" + " b" * 700 + ">c"]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(i, bytearray(p.encode("latin-1" if "latin1" in p else "utf-8"))) for i, p in enumerate(PAGES)]
    return spark.createDataFrame(rows, "page_id long, raw binary").cache()


@pytest.mark.parametrize("size", [1, 7, 64, 1024, 65536])
def test_batch_chunks(raw, size):
    got = {r.doc_id: (r.doc_html, r.encoding) for r in chunks.parse_chunks(chunks.chunked(raw, size)).collect()}
    want = {r.page_id: bytes(r.raw) for r in raw.collect()}
    assert got == {i: (p["doc_html"], p["encoding"]) for i, p in ((i, parse_one(b, ParseOptions())) for i, b in want.items())}


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(chunks.PROVIDER, chunks.ROCKSDB)
    yield
    spark.conf.unset(chunks.PROVIDER)


def streamed(spark, schema, path, name, plan):
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    query = plan(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path / "ck")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def test_stream_of_chunks(spark, raw, tmp_path, rocksdb):
    cut = chunks.chunked(raw, 64)
    # late, shuffled, repeated before and after the document is done
    for i, part in enumerate((cut.where("seq % 2 = 1"), cut.where("seq % 2 = 1"), cut.where("seq % 2 = 0"), cut.where("seq = 0"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    got = streamed(spark, cut.schema, tmp_path, "parsed_chunks", lambda s: chunks.parse_stream(s, ttl_ms=None))
    want = {r.page_id: parse_one(bytes(r.raw), ParseOptions()) for r in raw.collect()}
    assert {r.doc_id: (r.doc_html, r.encoding, r.error) for r in got} == {i: (p["doc_html"], p["encoding"], None) for i, p in want.items()} and len(got) == len(want)
    assert {r.doc_id: [n.tag for n in r.nodes] for r in got} == {i: [n["tag"] for n in p["nodes"]] for i, p in want.items()}


def test_a_path_on_a_stream(spark, raw, tmp_path, rocksdb):
    cut = chunks.chunked(raw, 100).withColumn("doc_id", F.concat(F.lit("page "), "doc_id"))
    cut.repartition(3).write.parquet(str(tmp_path / "in"))
    got = streamed(spark, cut.schema, tmp_path, "paths", lambda s: find(chunks.assemble_stream(s, ttl_ms=None), Path().select("p"), ("text_content",), "doc_id", "raw"))
    assert [(r.doc_id, r.text_content) for r in got] == [("page 0", "é")] * 30


def test_stream_limit(spark, raw, tmp_path, rocksdb):
    cut = chunks.chunked(raw.where("page_id = 2"), 512)
    for i, part in enumerate((cut.where("seq < 3"), cut.where("seq >= 3"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    errors = [r.error.split(":")[0] for r in streamed(spark, cut.schema, tmp_path, "limited", lambda s: chunks.parse_stream(s, ParseOptions(1000), ttl_ms=None))]
    assert sorted(errors) == ["InputTooLarge"] + ["ParserTerminated"] * (len(errors) - 1) and len(errors) > 1


class Kept:
    """A value or a map of state, in memory; calls are counted."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, {"update": 0, "containsKey": 0}

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        self.calls["containsKey"] += 1
        return key in self.map

    def updateValue(self, key, value):
        self.calls["update"] += 1
        self.map[key] = value

    def iterator(self):
        return iter(list(self.map.items()))

    def clear(self):
        self.map = {}


def test_only_what_waits_is_state():
    """Chunks of a document that is whole in one micro-batch are never written, those that wait are once, repeats or not."""
    whole = chunks.Assembler(ParseOptions(), None)
    whole.about, whole.chunks = Kept(), Kept()
    rows = [Row(doc_id=1, seq=i, chunk=bytes([97 + i]), is_last=i == 3) for i in (2, 0, 3, 1, 2)]
    assert [tuple(r) for r in whole.handleInputRows((1,), iter(rows), None)] == [(1, b"abcd", None)]
    assert whole.chunks.calls == {"update": 0, "containsKey": 0} and whole.about.value == (3, 4, 4, "Done")
    assert list(whole.handleInputRows((1,), iter(rows), None)) == []
    late = chunks.Assembler(ParseOptions(), None)
    late.about, late.chunks = Kept(), Kept()
    got = [[tuple(r) for r in late.handleInputRows((1,), iter(part), None)] for part in (rows[:2], rows[:1], rows[2:])]
    assert got == [[], [], [(1, b"abcd", None)]] and late.chunks.calls["update"] == 2 and not late.chunks.map
    small = chunks.Assembler(ParseOptions(3), None)
    small.about, small.chunks = Kept(), Kept()
    got = [[r.error.split(":")[0] for r in small.handleInputRows((1,), iter(part), None)] for part in (rows[:2], rows[2:])]
    assert got == [[], ["InputTooLarge"]] and not small.chunks.map and small.about.value[3] == "Error"


def test_many_splits_are_not_dealt_anew(spark, tmp_path):
    """As many files as the table has splits, all read and then gone; a table of one split is dealt, and comes in several micro-batches."""
    pages = spark.range(60).selectExpr("id AS page_id", "encode(concat('<p>', repeat('x', 900), id), 'UTF-8') AS raw")
    for name, splits in (("many", 6), ("one", 1)):
        pages.repartition(splits).write.parquet(str(tmp_path / name))
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    try:
        for name in ("many", "one"):
            there = []

            def texts(stream, there=there):
                there.extend(files_in(spark))
                return find(chunks.assemble_stream(stream, ttl_ms=None), Path().select("p"), ("text_content",), "doc_id", "raw")

            got = files.run_available(chunks.chunked(spark.read.parquet(str(tmp_path / name)), 256), texts).collect()
            assert sorted((r.doc_id, r.text_content) for r in got) == [(i, "x" * 900 + str(i)) for i in range(60)]
            assert len(there) == (6 if name == "many" else 4) and not files_in(spark)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_null_id_among_numbers_in_a_stream(spark):
    """It is one document's id, and the others keep theirs."""
    pages = spark.range(60).selectExpr("if(id = 3, null, id) AS page_id", "encode(concat(repeat('<p>', 20), id), 'UTF-8') AS raw")
    got = files.run_available(chunks.chunked(pages, 16), lambda s: chunks.assemble_stream(s, ttl_ms=None)).collect()
    assert {(r.doc_id, bytes(r.raw)) for r in got} == {(None if i == 3 else i, b"<p>" * 20 + b"%d" % i) for i in range(60)} and len(got) == 60


def files_in(spark):
    import pathlib

    return list(pathlib.Path(files.own_dir(spark).removeprefix("file://")).glob("stream-*/in/*.parquet"))


def test_a_stream_forgets(spark, raw, tmp_path, rocksdb):
    """With a time to live, and without RocksDB an error that says so."""
    cut = chunks.chunked(raw, 700)
    cut.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cut.schema).parquet(str(tmp_path / "in"))
    assert chunks.assemble_stream(stream, ttl_ms=1000).columns == ["doc_id", "raw", "error"]
    spark.conf.unset(chunks.PROVIDER)
    with pytest.raises(ValueError, match="RocksDB"):
        chunks.assemble_stream(stream)


HARD = PAGES + [
    "a&ampb &am", "x&#38", "t&copy", "<!-- a --!> b <!-", "<!DOCTYPE html><!doctyp", "<![CDATA[ x ]]> y <![CDA", "<p a='1>2' b>t</p", "<script><!--<script>a</script>b--></script>c", "<title>a&amp;</titl>b</title>",
    "<plaintext>a<b>&amp;", "<textarea>\r\nq</textarea></>", "a < b << c <3 </ x>", "<?pi><!x", "<select><style></select>b</style>", "<",
]


@pytest.mark.parametrize("size", [1, 2, 5, 64])
def test_tokens_and_trees_piece_by_piece(size):
    for html in HARD:
        one = StreamTokenizer()
        for at in range(0, len(html), size):
            one.feed(html[at : at + size])
        assert one.finish() == tokenize(html), html
        raw = html.encode("latin-1" if "latin1" in html else "utf-8")
        parser = StreamParser()
        for at in range(0, len(raw), size):
            parser.feed(raw[at : at + size])
        assert parser.finish().markup[0] == parse_one(raw)["doc_html"], html
        with pytest.raises(ValueError, match="ParserTerminated"):
            parser.feed(b"x")


def test_piecewise_limits_and_time():
    parser = StreamParser(ParseOptions(10))
    parser.feed(b"12345")
    with pytest.raises(ValueError, match="InputTooLarge"):
        parser.feed(b"678901")
    with pytest.raises(ValueError, match="ParserTerminated"):
        parser.finish()
    began, tokens = time.process_time(), StreamTokenizer()
    for _ in range(40_000):
        tokens.feed("<!-- x ")
    assert tokens.buffered > 200_000 and len(tokens.finish()) == 1 and time.process_time() - began < 5


def test_chunks_decoded_as_they_come(spark):
    text = '<meta charset="shift_jis">' + "日本" * 900
    df = spark.createDataFrame([("a", bytearray(text.encode("shift_jis"))), (None, bytearray(b"x"))], "page_id string, raw binary")
    got = {}
    for r in decode_chunks(chunks.chunked(df, 7)).orderBy("doc_id", "seq").collect():
        got[r.doc_id] = got.get(r.doc_id, "") + r.text
    assert got == {"a": text, None: "x"}


def test_early_stop(spark):
    html = "<div><p id=x>a<b>c</b></p>rest</div><p>later"
    df = spark.createDataFrame([(1, html), (2, "<i>no</i>"), (3, None)], "page_id long, html string")
    created = {r.doc_id: r for r in early.parse_until(df, early.has_tag("p")).collect()}
    assert (created[1].completeness, created[1].chars_consumed, created[1].outer_html) == ("Created", html.index("a<b>"), '<p id="x"></p>')
    assert (created[2].matched, created[2].completeness, created[2].chars_consumed) == (False, "Done", 9)
    assert not created[3].matched
    closed = {r.doc_id: r for r in early.parse_until(df, early.has_tag("p"), "closed").collect()}
    assert (closed[1].completeness, closed[1].text_content, closed[1].chars_consumed) == ("SubtreeComplete", "ac", html.index("rest"))
    text = early.parse_until(df, lambda n: n.kind == "text" and n.text == "c").where("doc_id = 1").first()
    assert (text.text, text.chars_consumed) == ("c", html.index("</p>"))


def test_sql_functions(spark):
    register(spark)
    rows = spark.sql("select tag, classes, attrs from html_nodes('<p class=\"a b\" x>t')").collect()
    assert [r.tag for r in rows] == [None, "p", None] and rows[1].classes == ["a", "b"] and rows[1].attrs[1].value is None
    pages = "(select '<ul><li>a<li class=x>b</ul>' h union all select null)"
    found = spark.sql(f"select s.* from {pages}, lateral html_select(h, 'ul > li + li') s").collect()
    assert [tuple(r) for r in found] == [(4, "li", "b", "b", '<li class="x">b</li>')]
    assert [r.text_content for r in spark.sql(f"select s.* from {pages}, lateral html_xpath(h, '/ul/li[1]') s").collect()] == ["a"]
    assert [r.kind for r in spark.sql("select kind from html_tokens('<p>t</p>')").collect()] == ["open", "text", "close"]
    row = spark.sql("select html_text('<b>a</b>&lt;') t, html_escape('<') e, html_unescape('&copy;') u, detect_encoding(X'FFFE') d, html_decode(X'EFBBBF41') h").first()
    assert tuple(row) == ("a<", "&lt;", "©", "UTF-16LE", "A")


def test_null_and_oversized_documents(spark):
    df = spark.createDataFrame([(1, None), (2, "<p>x" * 10), (3, "")], "page_id long, html string")
    got = {r.doc_id: r for r in dom.parse(df, options=ParseOptions(30)).collect()}
    assert (got[1].node_count, got[1].error, got[2].node_count, got[3].node_count) == (None, None, None, 1)
    assert got[2].error.startswith("InputTooLarge")
    assert dom.nodes(dom.parse(df)).groupBy("doc_id").agg(F.count("*")).count() == 2


def test_delimiters(spark):
    df = spark.createDataFrame([(1, "a<b c='\"'>")], "page_id long, html string")
    assert [(r.pos, r.byte) for r in dom.delimiters(df).orderBy("pos").collect()] == [(1, "<"), (6, "'"), (7, '"'), (8, "'"), (9, ">")]
