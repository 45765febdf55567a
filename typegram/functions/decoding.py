"""Decoding of source bytes: byte order mark, else declared coding (PEP 263), else UTF-8; NULL when it fails."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: UTF-32 before UTF-16: the little-endian mark of the one begins with that of the other.
BOMS = (
    (codecs.BOM_UTF8, "utf-8"),
    (codecs.BOM_UTF32_LE, "utf-32-le"),
    (codecs.BOM_UTF32_BE, "utf-32-be"),
    (codecs.BOM_UTF16_LE, "utf-16-le"),
    (codecs.BOM_UTF16_BE, "utf-16-be"),
)
#: The declaration stands in the first line, or in the second after a blank or comment line.
DECLARED = r"\A(?:[ \t\f]*(?:#[^\n]*)?\n)?[ \t\f]*#[^\n]*?coding[:=][ \t]*([-\w.]+)"
_DECLARED = re.compile(DECLARED.encode())


def decode_source(data: bytes | None) -> str | None:
    if data is None:
        return None
    data = bytes(data)
    for bom, name in BOMS:
        if data.startswith(bom):
            try:
                return data[len(bom):].decode(name)
            except UnicodeDecodeError:
                return None
    name = "utf-8"
    if b"coding" in data and (m := _DECLARED.match(data)):
        name = m.group(1).decode("ascii", "replace")
    try:
        return data.decode(name)
    except (UnicodeDecodeError, LookupError, ValueError):
        return None


def decode_python(data: bytes | None) -> str | None:
    """As Python reads its sources: a UTF-8 mark or a declaration counts, other byte order marks don't."""
    if data is None or any(bytes(data[:len(b)]) == b for b, n in BOMS if n != "utf-8"):
        return None
    return decode_source(data)


@F.pandas_udf(T.StringType())
def _decode_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else decode_source(b))


def _is_special(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 3))
    marked = head.startswith("EFBBBF") | head.startswith("FFFE") | head.startswith("FEFF") | (head == "0000FE")
    return marked | data.cast("string").rlike(DECLARED)


def decoded(data: Column) -> Column:
    """JVM-side for plain UTF-8; only rows with a mark or a declaration travel to Python."""
    special = _is_special(data)
    text = data.cast("string")
    plain = F.when(~special & F.is_valid_utf8(text), text)
    return F.coalesce(plain, _decode_udf(F.when(special, data)))
