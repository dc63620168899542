"""Which encoding a page is in, and its text.

Detection: a byte order mark, else a <meta> within the first 1,024 bytes, else
UTF-8. Decoding never fails; malformed input becomes U+FFFD. Labels follow the
WHATWG standard: a label's family is found by Python's codec lookup after the
few names that the standard maps elsewhere.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = b" \t\n\f\r"
MARKS = (("UTF-8", b"\xef\xbb\xbf"), ("UTF-16LE", b"\xff\xfe"), ("UTF-16BE", b"\xfe\xff"))
PRESCAN = 1024

# Labels of the WHATWG Encoding Standard by encoding, where Python's codec lookup would give another one or none.
LABELS = {
    "UTF-8": "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf-8 utf8 x-unicode20utf8",
    "windows-1252": "ansi_x3.4-1968 ascii cp1252 cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii windows-1252 x-cp1252",
    "windows-1254": "cp1254 csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5 windows-1254 x-cp1254",
    "windows-874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874",
    "ISO-8859-2": "csisolatin2 iso-8859-2 iso-ir-101 iso8859-2 iso88592 iso_8859-2 iso_8859-2:1987 l2 latin2",
    "ISO-8859-5": "csisolatincyrillic cyrillic iso-8859-5 iso-ir-144 iso8859-5 iso88595 iso_8859-5 iso_8859-5:1988",
    "ISO-8859-7": "csisolatingreek ecma-118 elot_928 greek greek8 iso-8859-7 iso-ir-126 iso8859-7 iso88597 iso_8859-7 iso_8859-7:1987 sun_eu_greek",
    "ISO-8859-15": "csisolatin9 iso-8859-15 iso8859-15 iso885915 iso_8859-15 l9",
    "windows-1250": "cp1250 windows-1250 x-cp1250",
    "windows-1251": "cp1251 windows-1251 x-cp1251",
    "windows-1253": "cp1253 windows-1253 x-cp1253",
    "windows-1255": "cp1255 windows-1255 x-cp1255",
    "windows-1256": "cp1256 windows-1256 x-cp1256",
    "windows-1257": "cp1257 windows-1257 x-cp1257",
    "windows-1258": "cp1258 windows-1258 x-cp1258",
    "macintosh": "csmacintosh mac macintosh x-mac-roman",
    "IBM866": "866 cp866 csibm866 ibm866",
    "KOI8-R": "cskoi8r koi koi8 koi8-r koi8_r",
    "KOI8-U": "koi8-ru koi8-u",
    "GBK": "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "gb18030": "gb18030",
    "Big5": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "EUC-JP": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "ISO-2022-JP": "csiso2022jp iso-2022-jp",
    "Shift_JIS": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "EUC-KR": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "UTF-16BE": "unicodefffe utf-16be",
    "UTF-16LE": "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le",
    "x-user-defined": "x-user-defined",
}
BY_LABEL = {label: name for name, labels in LABELS.items() for label in labels.split()}
for _n in (3, 4, 6, 8, 10, 13, 14, 16):
    for _label in (f"iso-8859-{_n}", f"iso8859-{_n}", f"iso8859{_n}", f"iso_8859-{_n}"):
        BY_LABEL.setdefault(_label, f"ISO-8859-{_n}")
CODECS = {"GBK": "gb18030", "Big5": "big5hkscs", "Shift_JIS": "cp932", "EUC-KR": "cp949", "windows-874": "cp874", "macintosh": "mac_roman", "IBM866": "cp866"}


def for_label(label: str) -> str | None:
    """The encoding that a label names."""
    return BY_LABEL.get(label.strip(" \t\n\f\r").lower())


def bom_length(raw: bytes, encoding: str) -> int:
    return next((len(mark) for name, mark in MARKS if name == encoding and raw.startswith(mark)), 0)


def _attribute(raw: bytes, at: int) -> tuple[bytes, bytes, int] | None:
    """(name, value, position after) of the attribute at or after `at`; no name: the tag ends there. None: cut off."""
    n = len(raw)
    while at < n and raw[at] in SPACE + b"/":
        at += 1
    if at >= n:
        return None
    if raw[at] == 0x3E:
        return b"", b"", at
    start = at
    while at < n and raw[at] not in SPACE + b"/>" and (raw[at] != 0x3D or at == start):
        at += 1
    name = raw[start:at].lower()
    while at < n and raw[at] in SPACE:
        at += 1
    if at >= n:
        return None
    if raw[at] != 0x3D:
        return name, b"", at
    at += 1
    while at < n and raw[at] in SPACE:
        at += 1
    if at >= n:
        return None
    if raw[at] in b"\"'":
        end = raw.find(raw[at : at + 1], at + 1)
        return None if end < 0 else (name, raw[at + 1 : end].lower(), end + 1)
    start = at
    while at < n and raw[at] not in SPACE + b">":
        at += 1
    return None if at >= n else (name, raw[start:at].lower(), at)


def charset_in_content(content: bytes) -> str | None:
    at = 0
    while (at := content.find(b"charset", at)) >= 0:
        at += 7
        rest = content[at:].lstrip(SPACE)
        if not rest.startswith(b"="):
            continue
        rest = rest[1:].lstrip(SPACE)
        if rest[:1] in (b'"', b"'"):
            end = rest.find(rest[:1], 1)
            return None if end < 0 else rest[1:end].decode("latin-1")
        for i, b in enumerate(rest):
            if b in SPACE + b";":
                rest = rest[:i]
                break
        return rest.decode("latin-1") or None
    return None


def _declared(attrs: dict[bytes, bytes]) -> str | None:
    if b"charset" in attrs:
        label: str | None = attrs[b"charset"].decode("latin-1")
    elif attrs.get(b"http-equiv") == b"content-type":
        label = charset_in_content(attrs.get(b"content", b""))
    else:
        return None
    found = for_label(label) if label else None
    if found in ("UTF-16LE", "UTF-16BE"):
        return "UTF-8"
    return "windows-1252" if found == "x-user-defined" else found


def prescan(raw: bytes) -> str | None:
    """The encoding that a <meta> in the first bytes declares."""
    raw, at = raw[:PRESCAN], 0
    while (at := raw.find(b"<", at)) >= 0:
        if raw.startswith(b"<!--", at):
            end = raw.find(b"-->", at + 2)
            if end < 0:
                return None
            at = end + 3
            continue
        following = raw[at + 1 : at + 2]
        closing = following == b"/" and raw[at + 2 : at + 3].isalpha()
        if following.isalpha() or closing:
            is_meta = raw[at + 1 : at + 5].lower() == b"meta" and raw[at + 5 : at + 6] in (b" ", b"\t", b"\n", b"\f", b"\r", b"/")
            at += 1 + closing
            while at < len(raw) and raw[at] not in SPACE + b"/>":
                at += 1
            attrs: dict[bytes, bytes] = {}
            while True:
                got = _attribute(raw, at)
                if got is None:
                    return None
                name, value, at = got
                if not name:
                    break
                attrs.setdefault(name, value)
            if is_meta and (found := _declared(attrs)):
                return found
        elif following in (b"!", b"/", b"?"):
            at = raw.find(b">", at)
            if at < 0:
                return None
        at += 1
    return None


def detect(raw: bytes) -> str:
    for name, mark in MARKS:
        if raw.startswith(mark):
            return name
    return prescan(raw) or "UTF-8"


def _missing(error: UnicodeError) -> tuple[str, int]:
    """Bytes that windows code pages leave out are C1 controls; all else is U+FFFD."""
    if isinstance(error, UnicodeDecodeError):
        bad = error.object[error.start : error.end]
        if len(bad) == 1 and 0x80 <= bad[0] <= 0x9F and error.encoding.startswith(("cp125", "charmap")):
            return chr(bad[0]), error.end
        return "�", error.end
    raise error


codecs.register_error("html-replace", _missing)


def codec_of(encoding: str) -> str:
    return CODECS.get(encoding) or encoding.replace("windows-", "cp")


def decode(raw: bytes, encoding: str) -> str:
    """The text of raw without the encoding's own byte order mark."""
    raw = raw[bom_length(raw, encoding) :]
    if encoding == "x-user-defined":
        return "".join(chr(b) if b < 128 else chr(0xF780 + b - 128) for b in raw)
    return raw.decode(codec_of(encoding), "html-replace")


def decode_or_detect(raw: bytes) -> tuple[str, str]:
    encoding = detect(raw)
    return decode(raw, encoding), encoding


class Decoder:
    """Bytes of one document to text as they come, once enough is there to tell the encoding."""

    def __init__(self) -> None:
        self.held, self.encoding, self.codec = b"", None, None

    def _begin(self) -> bytes:
        raw, self.held = self.held, b""
        self.encoding = detect(raw)
        self.codec = codecs.getincrementaldecoder(codec_of(self.encoding))("html-replace")
        return raw[bom_length(raw, self.encoding) :]

    def feed(self, chunk: bytes) -> str:
        if self.codec is None:
            self.held += chunk
            if len(self.held) < PRESCAN:
                return ""
            chunk = self._begin()
        return self.codec.decode(chunk)

    def finish(self) -> str:
        rest = self._begin() if self.codec is None else b""
        return self.codec.decode(rest, True)


def decode_stream(chunks: Iterable[bytes]) -> Iterator[str]:
    """Chunks of one document decoded as they come."""
    decoder = Decoder()
    for chunk in chunks:
        if text := decoder.feed(chunk):
            yield text
    if text := decoder.finish():
        yield text


def detect_encoding(raw: Column) -> Column:
    """The name of the encoding of a BINARY column."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else detect(v) for v in values.to_pylist()], pa.string())

    return run(raw)


def html_decode(raw: Column, encoding: Column | None = None) -> Column:
    """STRUCT<text, encoding> of a BINARY column; detected if no encoding is given."""

    @F.arrow_udf("struct<text:string,encoding:string>")
    def run(values: pa.Array, names: pa.Array) -> pa.Array:
        out = []
        for v, name in zip(values.to_pylist(), names.to_pylist(), strict=True):
            name = name or (detect(v) if v is not None else None)
            out.append(None if v is None else {"text": decode(v, name), "encoding": name})
        return pa.array(out, pa.struct([("text", pa.string()), ("encoding", pa.string())]))

    return run(raw, F.lit(None).cast("string") if encoding is None else encoding)
