"""References, escapes and encodings."""

import pytest
from pyspark.sql import functions as F

from loomdoc.functions import encoding as enc
from loomdoc.functions import entities as ent


@pytest.mark.parametrize(
    ("text", "as_text", "as_attribute"),
    [
        ("&amp;&lt;&nosuch;&", "&<&nosuch;&", "&<&nosuch;&"),
        ("&notit; &not=1 &not", "¬it; ¬=1 ¬", "&notit; &not=1 ¬"),
        ("&notin; &ampx &copy2", "∉ &x ©2", "∉ &ampx &copy2"),
        ("&#65;&#x41&#X42;&#0;&#x110000;&#xD800;", "AAB���", "AAB���"),
        ("&#128;&#x81;&#159;", "€\x81Ÿ", "€\x81Ÿ"),
        ("&#99999999999999999999;&#;&#x;&#xg", "�&#;&#x;&#xg", "�&#;&#x;&#xg"),
        ("&NotEqualTilde;&AMP&GT;", "≂̸&>", "≂̸&>"),
        ("&#000000000000065;", "A", "A"),
    ],
)
def test_decode(text, as_text, as_attribute):
    assert ent.decode_entities(text) == as_text
    assert ent.decode_attribute(text) == as_attribute


def test_names():
    assert len(ent.NAMED) == 2125 and len(ent.LEGACY) == 106
    assert ent.decode_named("copy") == "©" and ent.decode_named("Copy") is None
    assert ent.longest_named_prefix("notin;") == ("∉", 5)
    assert ent.longest_named_prefix("notinx") == ("¬", 3)
    assert ent.longest_named_prefix("zzz") is None
    assert ent.decode_numeric("4g") is None and ent.decode_numeric("26", True) == "&"


def test_columns(spark):
    df = spark.createDataFrame([(1, "a&<>\"'"), (2, None)], "id int, s string")
    rows = df.select("id", ent.html_escape(F.col("s")).alias("t"), ent.html_escape_attribute(F.col("s")).alias("a"), ent.html_unescape(ent.html_escape_attribute(F.col("s"))).alias("u")).orderBy("id").collect()
    assert tuple(rows[0])[1:] == ("a&amp;&lt;&gt;\"'", "a&amp;&lt;&gt;&quot;&#39;", "a&<>\"'")
    assert tuple(rows[1])[1:] == (None, None, None)
    values = [0, 65, 128, 129, 0xD800, 0x110000, 0x1F600, -1]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").select("i", ent.numeric_reference(F.col("v")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [ent.decode_number(v) if v >= 0 else "�" for v in values]


@pytest.mark.parametrize(
    ("raw", "name"),
    [
        (b"\xef\xbb\xbfx", "UTF-8"),
        (b"\xff\xfea\0", "UTF-16LE"),
        (b"\xfe\xff\0a", "UTF-16BE"),
        (b"plain", "UTF-8"),
        (b'<meta charset="ISO-8859-1">', "windows-1252"),
        (b"<META CHARSET=shift_jis >", "Shift_JIS"),
        (b"<meta charset=utf-16>", "UTF-8"),
        (b"<meta charset=x-user-defined>", "windows-1252"),
        (b'<meta http-equiv="Content-Type" content="text/html; charset=koi8-r">', "KOI8-R"),
        (b'<meta content="text/html; charset=koi8-r">', "UTF-8"),
        (b'<meta charset=bad><meta charset="euc-kr">', "EUC-KR"),
        (b'<!-- <meta charset="gbk"> --><p>', "UTF-8"),
        (b'<!--><meta charset="gbk">', "GBK"),
        (b'<a x="<meta charset=gbk>"><meta charset=big5>', "Big5"),
        (b'<metax charset="gbk">', "UTF-8"),
        (b'<? > <meta/charset="gbk">', "GBK"),
        (b" " * 1100 + b'<meta charset="gbk">', "UTF-8"),
        (b'<meta charset="gb', "UTF-8"),
    ],
)
def test_detect(raw, name):
    assert enc.detect(raw) == name


def test_decode_encodings():
    assert enc.decode(b"\x80\x81\x99", "windows-1252") == "€\x81™"
    assert enc.decode(b"\xef\xbb\xbfa\xff\xe2\x82b", "UTF-8") == "a��b"
    assert enc.decode("日本".encode("cp932"), "Shift_JIS") == "日本"
    assert enc.decode(b"\xff\xfea\0", "UTF-16LE") == "a"
    assert enc.for_label(" Latin1\n") == "windows-1252" and enc.for_label("nope") is None
    assert enc.bom_length(b"\xef\xbb\xbf", "UTF-8") == 3 and enc.bom_length(b"\xef\xbb\xbf", "UTF-16LE") == 0
    text = '<meta charset="windows-1251">' + "Привет" * 500
    raw = text.encode("cp1251")
    for size in (1, 7, 64, 5000):
        assert "".join(enc.decode_stream(iter([raw[i : i + size] for i in range(0, len(raw), size)]))) == text


def test_every_label_has_a_codec():
    import codecs

    for name in set(enc.BY_LABEL.values()) - {"x-user-defined"}:
        codecs.lookup(enc.codec_of(name))


def test_decode_column(spark):
    df = spark.createDataFrame([(1, bytearray(b'<meta charset="latin1">\xe9')), (2, None)], "id int, raw binary")
    got = df.select("id", enc.html_decode(F.col("raw")).alias("d"), enc.detect_encoding(F.col("raw")).alias("e")).orderBy("id").collect()
    assert (got[0].d.text[-1], got[0].d.encoding, got[0].e) == ("é", "windows-1252", "windows-1252")
    assert got[1].d is None and got[1].e is None
