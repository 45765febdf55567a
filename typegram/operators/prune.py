"""Pruning of grammars: generating, reachable, defined and useful symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typegram.operators import grammar as g
from typegram.operators.closure import _rounds, reachable
from typegram.session import cut


def _numbered(p: DataFrame) -> DataFrame:
    """lhs, rhs, prod_id: numbers that stay, as the rows are materialised."""
    return cut(p.select("lhs", "rhs").withColumn("prod_id", F.monotonically_increasing_id()))


def _derivable(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Generating symbols, numbered productions, and (prod_id, n): distinct nonterminals of each that don't generate.

    Semi-naive: every round only counts down the productions that mention a symbol found in the last one.
    """
    rows = _numbered(p)
    names = F.array_distinct(F.transform(F.filter("rhs", lambda s: s["kind"] == "N"), lambda s: s["value"]))
    mentions = cut(rows.select("prod_id", F.explode(names).alias("node")))
    need = cut(rows.select("prod_id", "lhs", F.size(names).cast("long").alias("n")))
    found = delta = cut(need.filter("n = 0").select(F.col("lhs").alias("node")).distinct())
    for i in _rounds():
        if delta.isEmpty():
            return found, rows, need
        hits = mentions.join(delta, "node").groupBy("prod_id").agg(F.count("*").alias("m"))
        need = cut(need.join(hits, "prod_id", "left").select("prod_id", "lhs", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n"), F.col("m").isNotNull().alias("hit")))
        delta = cut(need.filter("hit AND n = 0").select(F.col("lhs").alias("node")).distinct().join(found, "node", "left_anti"))
        need = need.drop("hit")
        found = found.unionByName(delta)
        if i % 8 == 7:
            found = cut(found)


def generating(p: DataFrame) -> DataFrame:
    """node: least set of left sides with a production of terminals and generating nonterminals only."""
    return _derivable(p)[0]


def keep_known(p: DataFrame, known: DataFrame) -> DataFrame:
    """Productions all of whose symbols, left and right, are known nodes (terminals always are)."""
    known = known.select("node").distinct()
    rows = _numbered(p)
    used = rows.select("prod_id", F.explode(F.filter("rhs", lambda s: s["kind"] == "N")).alias("s")).select("prod_id", F.col("s.value").alias("node"))
    bad = used.join(known, "node", "left_anti").select("prod_id").distinct()
    return rows.join(bad, "prod_id", "left_anti").join(known.withColumnRenamed("node", "lhs"), "lhs", "left_semi").select("lhs", "rhs")


def generating_only(p: DataFrame) -> DataFrame:
    """Productions without any symbol that does not generate."""
    _, rows, need = _derivable(p)
    return rows.join(need.filter("n = 0").select("prod_id"), "prod_id", "left_semi").select("lhs", "rhs")


def symbol_edges(p: DataFrame) -> DataFrame:
    return p.select(F.col("lhs").alias("src"), F.explode("rhs").alias("s")).filter("s.kind = 'N'").select("src", F.col("s.value").alias("dst")).distinct()


def reachable_symbols(p: DataFrame, start: str = g.START) -> DataFrame:
    return reachable(symbol_edges(p), p.sparkSession.createDataFrame([(start,)], "node string"))


def reachable_only(p: DataFrame, start: str = g.START) -> DataFrame:
    return p.join(reachable_symbols(p, start).withColumnRenamed("node", "lhs"), "lhs", "left_semi").select("lhs", "rhs")


def defined_only(p: DataFrame) -> DataFrame:
    """Drops productions that mention a symbol without productions, until none does (greatest fixpoint)."""
    p = cut(p.select("lhs", "rhs").distinct())
    n = p.count()
    for _ in _rounds():
        q = cut(keep_known(p, p.select(F.col("lhs").alias("node")).distinct()))
        m = q.count()
        if m == n:
            return q
        p, n = q, m


def useful(p: DataFrame, start: str = g.START) -> DataFrame:
    """Generating productions first, then those reachable from start."""
    return reachable_only(cut(generating_only(p)), start)
