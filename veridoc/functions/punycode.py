"""Punycode (RFC 3492) on Columns, by the standard library's codec in Arrow batches; null where a text can't be coded.

`to_ascii` and `to_unicode` work on host names and on the host of a mail address, label by label, without case folding.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Dots that separate labels (RFC 3490), and the prefix of coded labels.
DOTS = r"[.\u3002\uFF0E\uFF61]"
PREFIX = "xn--"
#: What can be wrong with a text; such texts give null.
ERRORS = {
    "overflow": "Overflow: input needs wider integers to process",
    "not-basic": "Illegal input >= 0x80 (not a basic code point)",
    "invalid-input": "Invalid input",
}


def encode_text(s: str) -> str:
    return s.encode("punycode").decode("ascii")


def decode_text(s: str) -> str:
    return s.encode("ascii").decode("punycode")


def _by_label(s: str, fn: Callable[[str], str]) -> str:
    mailbox, at, host = s.partition("@") if "@" in s else ("", "", s)
    host = host.partition("@")[0]
    return mailbox + at + ".".join(map(fn, re.split(DOTS, host)))


def to_ascii_text(s: str) -> str:
    return _by_label(s, lambda x: PREFIX + encode_text(x) if re.search(r"[^\0-\x7e]", x) else x)


def to_unicode_text(s: str) -> str:
    return _by_label(s, lambda x: decode_text(x[len(PREFIX) :].lower()) if x.startswith(PREFIX) else x)


def _column(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    def total(s: str | None) -> str | None:
        try:
            return None if s is None else fn(s)
        except (UnicodeError, ValueError, OverflowError):
            return None

    def apply(s: Column) -> Column:
        @F.pandas_udf(StringType())
        def coded(texts: pd.Series) -> pd.Series:
            return texts.map(total).astype(object)

        return coded(s)

    return apply


encode, decode, to_ascii, to_unicode = (_column(fn) for fn in (encode_text, decode_text, to_ascii_text, to_unicode_text))


def code_points(s: Column) -> Column:
    """The code points of a text as an array; built-in functions only."""
    return F.when(s == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(s, "(?s)(?<=.)(?=.)"), F.ascii))


def from_code_points(points: Column) -> Column:
    """The text of an array of code points."""
    return F.array_join(F.transform(points, lambda p: F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32")), "")
