"""Character references and escaping.

Names come from the standard library's table of WHATWG references. Escapes are
Columns; decoding is an Arrow function, since a longest match over 2,231 names
isn't a Column.
"""

from __future__ import annotations

import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that end with a semicolon, without it; and those that also work without one.
NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
LEGACY = {k: v for k, v in html5.items() if not k.endswith(";")}
LONGEST_LEGACY = max(map(len, LEGACY))
#: What bytes 0x80 to 0x9F mean in windows-1252; None: nothing, the number stands for itself.
C1 = {i: bytes([i]).decode("cp1252") for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|([A-Za-z][A-Za-z0-9]*)(;?))")


def decode_named(name: str) -> str | None:
    """The characters of a name without its semicolon, case counting."""
    return NAMED.get(name)


def decode_number(value: int) -> str:
    if value in C1:
        return C1[value]
    if value == 0 or value > 0x10FFFF or 0xD800 <= value <= 0xDFFF:
        return "�"
    return chr(value)


def decode_numeric(digits: str, hexadecimal: bool = False) -> str | None:
    """None if there is anything but digits."""
    if not re.fullmatch(r"[0-9a-fA-F]+" if hexadecimal else r"[0-9]+", digits):
        return None
    digits = digits.lstrip("0")
    return decode_number(0x110000 if len(digits) > 8 else int(digits or "0", 16 if hexadecimal else 10))


def longest_named_prefix(text: str) -> tuple[str, int] | None:
    """(characters, length of the name without semicolon) of the longest name that text begins with; whole names need their semicolon unless they are legacy ones."""
    m = re.match(r"[A-Za-z][A-Za-z0-9]*", text)
    if not m:
        return None
    name = m[0]
    if text[m.end() : m.end() + 1] == ";" and name in NAMED:
        return NAMED[name], len(name)
    for n in range(min(len(name), LONGEST_LEGACY), 1, -1):
        if name[:n] in LEGACY:
            return LEGACY[name[:n]], n
    return None


def _replace(m: re.Match, attribute: bool) -> str:
    hex_digits, digits, name, semicolon = m.groups()
    if name is None:
        return decode_numeric(hex_digits or digits, hex_digits is not None) or m[0]
    if semicolon and name in NAMED:
        return NAMED[name]
    for n in range(min(len(name), LONGEST_LEGACY), 1, -1):
        if name[:n] in LEGACY:
            follows = name[n : n + 1] or semicolon or m.string[m.end() : m.end() + 1]
            if attribute and (follows == "=" or (follows.isalnum() and follows.isascii())):
                return m[0]
            return LEGACY[name[:n]] + name[n:] + semicolon
    return m[0]


def decode_entities(text: str) -> str:
    if "&" not in text:
        return text
    return REFERENCE.sub(lambda m: _replace(m, False), text)


def decode_attribute(text: str) -> str:
    if "&" not in text:
        return text
    return REFERENCE.sub(lambda m: _replace(m, True), text)


def escape_text(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attribute(text: str) -> str:
    return escape_text(text).replace('"', "&quot;").replace("'", "&#39;")


def html_escape(c: Column) -> Column:
    """Text as markup."""
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def html_escape_attribute(c: Column) -> Column:
    c = html_escape(c)
    for plain, escaped in (('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def _arrow(f):
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], pa.string())

    return run


def html_unescape(c: Column, attribute: bool = False) -> Column:
    """Text with its character references decoded; a null stays null."""
    return F.arrow_udf(_arrow(decode_attribute if attribute else decode_entities), "string")(c)


def html_named(c: Column) -> Column:
    return F.arrow_udf(_arrow(decode_named), "string")(c)


def numeric_reference(value: Column) -> Column:
    """The character of a numeric reference's value: a Column throughout."""
    table = F.create_map(*[F.lit(x) for k, v in C1.items() for x in (k, v)])
    bad = (value == 0) | (value > 0x10FFFF) | value.between(0xD800, 0xDFFF) | (value < 0)
    # a code point as UTF-32 bytes
    text = F.decode(F.unhex(F.lpad(F.hex(value.cast("long")), 8, "0")), "UTF-32")
    return F.when(bad, "�").when(value.between(0x80, 0x9F), F.coalesce(F.element_at(table, value.cast("int")), text)).otherwise(text)
