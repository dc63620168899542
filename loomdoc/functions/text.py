"""ASCII case and HTML white space, the same in Python and in Columns.

HTML folds A-Z only and has five white-space characters; str.lower, str.split,
Spark's lower and \\s all do more.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\f\r"
SPACES = re.compile(r"[ \t\n\f\r]+")
UPPER_TO_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def ascii_lower(s: str) -> str:
    return s.lower() if s.isascii() else s.translate(UPPER_TO_LOWER)


def tokens_of(value: str) -> list[str]:
    """A value's white-space separated tokens."""
    return [t for t in SPACES.split(value) if t]


def lower_column(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def token_column(c: Column) -> Column:
    return F.filter(F.split(c, r"[ \t\n\f\r]+"), lambda t: t != "")


def has_token(c: Column, token: str) -> Column:
    """Whether a token is in a value; the empty one never is."""
    if not token or SPACES.search(token):
        return F.lit(False)
    return F.array_contains(token_column(c), token)
