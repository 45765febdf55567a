"""Chomsky normal form as joins; helper symbols are named by what they stand for, so equal suffixes share one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typegram.operators import grammar as g
from typegram.operators.closure import closure
from typegram.operators.prune import useful
from typegram.session import cut


def without_empty(p: DataFrame, reject: bool = False) -> DataFrame:
    """Drops empty right sides, or raises where there is one."""
    if reject and not p.filter(F.size("rhs") == 0).isEmpty():
        raise ValueError("empty productions have no normal form here")
    return p.filter(F.size("rhs") > 0)


def _lifted_name(value):
    return F.concat(F.lit("@token:"), value)


def lifted(p: DataFrame) -> DataFrame:
    """Terminals in right sides of two symbols or more become nonterminals of their own."""
    long = F.size("rhs") > 1
    lift = F.transform("rhs", lambda s: F.when(s["kind"] == "T", F.struct(F.lit("N").alias("kind"), _lifted_name(s["value"]).alias("value"))).otherwise(s))
    tokens = p.filter(long).select(F.explode("rhs").alias("s")).filter("s.kind = 'T'").select(
        _lifted_name(F.col("s.value")).alias("lhs"), F.array("s").alias("rhs")).distinct()
    return p.select("lhs", F.when(long, lift).otherwise(F.col("rhs")).alias("rhs")).unionByName(tokens).distinct()


def binarised(p: DataFrame) -> DataFrame:
    """Right sides of more than two symbols as chains over shared suffixes; unit productions stay."""
    p = lifted(p)
    long = p.filter(F.size("rhs") > 2)
    name = lambda i: F.concat(F.lit("@rest:"), F.array_join(F.transform(F.slice("rhs", i + 1, F.size("rhs")), lambda s: s["value"]), " "))
    rest = lambda i: F.struct(F.lit("N").alias("kind"), name(i).alias("value"))
    links = long.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("rhs") - 2))).select(
        F.when(F.col("i") == 0, F.col("lhs")).otherwise(name(F.col("i"))).alias("lhs"),
        F.when(F.col("i") == F.size("rhs") - 2, F.slice("rhs", F.col("i") + 1, F.lit(2))).otherwise(
            F.array(F.get("rhs", F.col("i")), rest(F.col("i") + 1))).alias("rhs"))
    return p.filter(F.size("rhs") <= 2).unionByName(links).distinct()


def without_units(p: DataFrame) -> DataFrame:
    """Copies the other productions of every symbol to all that reach it by unit productions."""
    p = cut(p)
    others = p.filter(~g.is_unit())
    reach = closure(g.unit_edges(p), p.select(F.col("lhs").alias("node")).distinct())
    return reach.join(others, reach["dst"] == others["lhs"]).select(F.col("src").alias("lhs"), "rhs").distinct()


def to_cnf(p: DataFrame, start: str = g.START, reject_empty: bool = False) -> DataFrame:
    return useful(cut(without_units(binarised(without_empty(p, reject_empty)))), start)


def shape_violations(p: DataFrame) -> DataFrame:
    """Productions that are neither one terminal nor two nonterminals."""
    ok = (F.size("rhs") == 1) & (F.col("rhs")[0]["kind"] == "T") | (F.size("rhs") == 2) & F.forall("rhs", lambda s: s["kind"] == "N")
    return p.filter(~ok)
