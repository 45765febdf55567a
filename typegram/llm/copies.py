"""Records that differ only in formatting: canonical keys, hot keys in two levels, the smallest identifier kept.

Defined cases: NULL or undecodable data, and data without any letter or digit, belong to no set; a NULL
identifier names no record and is left out; NULL urls agree with each other only; empty tables give no rows;
ties cannot arise, as the smallest identifier of a set is kept and repeated rows of one identifier count once.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typegram.functions.decoding import decoded
from typegram.llm.syntax import json_parses
from typegram.session import cut, written

NOT_ALNUM = r"[^\p{L}\p{N}]+"
_PLAIN = re.compile(r"[\W_]+")
_TOKEN = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*")|([^\s{}\[\],:"]+))', re.S)
#: A key with more rows than this share of all rows is hot; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
SALTS = 64


def letters(text: str) -> str:
    return _PLAIN.sub("", text).lower()


def canonical_json(text: str) -> str | None:
    """Letters and digits of valid JSON with the fields of every object in sorted order; None for other text.

    Keys and values are taken as written, so escapes count as in the text itself.
    """
    if not json_parses(text):
        return None
    stack: list[list] = [["", []]]  # kind, finished parts; of objects: field texts
    field: list[str] = [""]
    for m in _TOKEN.finditer(text):
        sign = m.group(1)
        if sign is None:
            field[-1] += letters(m.group(2) or m.group(3))
        elif sign in "{[":
            stack.append([sign, []])
            field.append("")
        elif sign == ",":
            stack[-1][1].append(field[-1])
            field[-1] = ""
        elif sign in "}]":
            kind, parts = stack.pop()
            parts.append(field.pop())
            field[-1] += "".join(sorted(parts) if kind == "{" else parts)
    return field[0]


@F.pandas_udf(T.BinaryType())
def _json_key(text: pd.Series) -> pd.Series:
    def key(t):
        c = canonical_json(t) if t is not None else None
        return None if c is None else hashlib.md5(c.encode("utf-8", "surrogatepass")).digest()

    return text.map(key)


def _norm(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, NOT_ALNUM, ""))


def url_key(url: Column) -> Column:
    """Letters and digits of a url, the &-separated fields after ? in sorted order; NULL stays NULL."""
    at = F.instr(url, "?")
    fields = F.array_sort(F.transform(F.split(F.substr(url, at + 1), "&"), _norm))
    return F.when(at > 0, F.concat(_norm(F.substr(url, F.lit(1), F.greatest(at, F.lit(1)))), F.array_join(fields, ""))).otherwise(_norm(url))


def data_keys(df: DataFrame, id_col: str, data: str, *more: Column) -> DataFrame:
    """id, data_key (16 bytes) and further columns of all rows whose data decode and hold a letter or digit.

    Rows agree in data_key when their letters and digits agree as written or, for valid JSON, in any order of fields.
    """
    text = decoded(F.col(data))
    rows = df.select(F.col(id_col).alias("id"), text.alias("t"), *more).filter("id IS NOT NULL AND t IS NOT NULL")
    names = [c for c in rows.columns if c not in ("id", "t")]
    jsonish = F.when(F.col("t").rlike(r"\A\s*[\{\[]"), F.col("t"))
    rows = rows.select("id", _norm(F.col("t")).alias("n"), _json_key(jsonish).alias("c"), *names).filter("n <> ''")
    return linked_keys(written(rows.select("id", F.unhex(F.md5("n")).alias("p"), "c", *names)))


def linked_keys(rows: DataFrame) -> DataFrame:
    """rows(id, p, c, ...) with data_key instead of p and c: keys as written, c the canonical key of valid JSON or NULL."""
    by_text = canonical_of_text(rows.filter("c IS NOT NULL").select("p", "c").distinct())
    names = [x for x in rows.columns if x not in ("id", "p", "c")]
    return rows.join(by_text, "p", "left").select("id", F.coalesce("label", "p").alias("data_key"), *names)


def canonical_of_text(edges: DataFrame) -> DataFrame:
    """p, label: one label for all texts p that are linked through canonical forms c.

    A text has one canonical form except where different structures are spelled by the same letters;
    only those need more than the first round.
    """
    labels = edges.groupBy("p").agg(F.min("c").alias("label"), F.max("c").alias("other"))
    if labels.filter("label <> other").isEmpty():
        return labels.select("p", "label")
    edges, labels = cut(edges), cut(labels.select("p", "label"))
    while True:
        of_c = edges.join(labels, "p").groupBy("c").agg(F.min("label").alias("label"))
        new = cut(edges.join(of_c, "c").groupBy("p").agg(F.min("label").alias("label")))
        if new.join(labels.withColumnRenamed("label", "old"), "p").filter("label <> old").isEmpty():
            return new
        labels = new


def sets(keyed: DataFrame, hot_share: int = HOT_SHARE, salts: int = SALTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hot sets, other sets, hot keys) of keyed(id, k): k, kept_id, copies.

    Hot keys are found exactly from partial counts. They are aggregated by (k, salt), then by k; all others by one
    shuffle. There are at most hot_share hot keys, whatever the size of the input, so they may be broadcast.
    """
    counts = keyed.groupBy("k").agg(F.count("*").alias("n"))
    total = keyed.count()
    hot = cut(counts.filter(F.col("n") > max(total / hot_share, 1000)).select("k"))
    level1 = keyed.join(F.broadcast(hot), "k").groupBy("k", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(
        F.min("id").alias("kept_id"), F.count_distinct("id").alias("copies"))
    hot_sets = level1.groupBy("k").agg(F.min("kept_id").alias("kept_id"), F.sum("copies").alias("copies"))
    rest = keyed.join(F.broadcast(hot), "k", "left_anti")
    other = rest.groupBy("k").agg(F.min("id").alias("kept_id"), F.count_distinct("id").alias("copies"))
    return hot_sets, other, hot


def keyed_records(df: DataFrame, id_col: str, data: str, url: str) -> DataFrame:
    rows = data_keys(df, id_col, data, url_key(F.col(url)).alias("u"))
    whole = F.concat(F.hex("data_key"), F.coalesce(F.concat(F.lit("="), "u"), F.lit("")))
    return written(rows.select("id", F.unhex(F.md5(whole)).alias("k")).distinct())


def records(df: DataFrame, id_col: str = "source_id", data: str = "data", url: str = "url", **options) -> DataFrame:
    """kept_id, copies: one row per record, with the number of rows it stands for."""
    hot_sets, other, _ = sets(keyed_records(df, id_col, data, url), **options)
    return hot_sets.unionByName(other).select("kept_id", "copies")


def copies(df: DataFrame, id_col: str = "source_id", data: str = "data", url: str = "url", **options) -> DataFrame:
    """kept_id, copy_id: one row per row other than the smallest identifier of its set."""
    keyed = keyed_records(df, id_col, data, url)
    hot_sets, other, hot = sets(keyed, **options)
    of_hot = keyed.join(F.broadcast(hot_sets.select("k", "kept_id")), "k")
    of_other = keyed.join(F.broadcast(hot), "k", "left_anti").join(other.filter("copies > 1").select("k", "kept_id"), "k")
    return of_hot.unionByName(of_other).filter("id <> kept_id").select("kept_id", F.col("id").alias("copy_id"))
