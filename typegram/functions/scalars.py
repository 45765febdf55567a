"""Scalar functions of names and numbers."""

from __future__ import annotations

import base64
import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_name(text: Column) -> Column:
    """A legal symbol of at most 32 characters; blank ones are TOKEN."""
    s = F.regexp_replace(F.regexp_replace(text, r"\s+", "_"), r"[^A-Za-z0-9_]", "_")
    s = F.substring(F.regexp_replace(s, r"^_+|_+$", ""), 1, 32)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("TOKEN"))


def log10_of(exact: Column) -> Column:
    """log10 of an integer of any size given as text: of its leading digits plus the others' number."""
    d = F.regexp_replace(exact, "^0+", "")
    lead = F.substring(d, 1, 15)
    return F.when(F.length(d) > 0, F.log10(lead.cast("double")) + F.length(d) - F.length(lead))


def log2_of(exact: Column) -> Column:
    return log10_of(exact) / F.lit(math.log10(2))


def compact(exact: Column) -> Column:
    """Numbers of more than 15 digits as d.ddde+n."""
    n = F.length(exact)
    return F.when(n <= 15, exact).otherwise(F.concat(F.substring(exact, 1, 1), F.lit("."), F.substring(exact, 2, 3), F.lit("e+"), (n - 1).cast("string")))


def nice_step(span: float, ticks: int = 5) -> float:
    """The least of 1, 2, 5 times a power of ten that divides a span into at most so many steps."""
    if span <= 0:
        return 1.0
    raw = span / ticks
    power = 10 ** math.floor(math.log10(raw))
    return next(m * power for m in (1, 2, 5, 10) if m * power >= raw * (1 - 1e-12))


def base32_name(text: str, length: int = 12) -> str:
    return base64.b32encode(hashlib.sha256(text.encode()).digest()).decode().rstrip("=").lower()[:length]


def unique_hash_names(df: DataFrame, column: str, start: int = 8) -> DataFrame:
    """df with short_name, the hash prefix of start characters; groups that collide get their whole hash."""
    h = F.sha2(F.col(column).cast("string"), 256)
    short = F.substring(h, 1, start)
    w = Window.partitionBy("_short")
    rows = df.withColumns({"_hash": h, "_short": short})
    collides = F.min(column).over(w) != F.max(column).over(w)
    return rows.withColumn("short_name", F.when(collides, F.col("_hash")).otherwise(F.col("_short"))).drop("_hash", "_short")


def is_binary(data: Column) -> Column:
    """Whether bytes hold a NUL."""
    return F.hex(data).rlike("^(?:..)*00")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.length(F.regexp_replace(F.substr(text, F.lit(1), offset), r"[^\n]", "")) + 1
