"""Lowering of typed expression rows E:T into the layers of Python's precedence.

P primary, W power, F factor, M term, S sum, E expression; E -> S -> M -> F -> W -> P per type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typegram.operators.grammar import symbol

LAYERS = ("E", "S", "M", "F", "W", "P")
SUM, TERM, POWER, PREFIX = ("+", "-"), ("*", "/", "//", "%"), ("**",), ("+", "-", "~")


def _at(layer: str, name: Column) -> Column:
    return F.concat(F.lit(layer), F.substring(name, 2, 1 << 20))


def _relabel(layer: str, s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), F.when((s["kind"] == "N") & s["value"].startswith("E:"), _at(layer, s["value"])).otherwise(s["value"]).alias("value"))


def lowered(p: DataFrame) -> DataFrame:
    """p with its E rows moved to their layers and alias rows between the layers of every type."""
    e = F.col("lhs").startswith("E:")
    size, first = F.size("rhs"), F.get("rhs", F.lit(0))
    second, third = F.get("rhs", F.lit(1)), F.get("rhs", F.lit(2))
    expr = lambda s: (s["kind"] == "N") & s["value"].startswith("E:")
    binary = (size == 3) & expr(first) & (second["kind"] == "T") & expr(third)
    op = second["value"]
    prefix = (size == 2) & (first["kind"] == "T") & first["value"].isin(*PREFIX) & expr(second)
    layer = (F.when(binary & op.isin(*SUM), "S").when(binary & op.isin(*TERM), "M").when(binary & op.isin(*POWER), "W").when(prefix, "F").otherwise("P"))
    sides = {"S": ("S", "M"), "M": ("M", "F"), "W": ("P", "F")}
    rhs = F.col("rhs")
    out = F.when(layer == "F", F.array(first, _relabel("F", second)))
    for name, (a, b) in sides.items():
        out = out.when(layer == name, F.array(_relabel(a, first), second, _relabel(b, third)))
    leading = F.transform(rhs, lambda s, i: F.when((i == 0), _relabel("P", s)).otherwise(s))
    out = out.otherwise(leading)
    moved = p.select(F.when(e, F.concat(layer, F.substring("lhs", 2, 1 << 20))).otherwise(F.col("lhs")).alias("lhs"), F.when(e, out).otherwise(leading).alias("rhs"))
    names = p.select(F.explode(F.concat(F.array("lhs"), F.transform("rhs", lambda s: s["value"]))).alias("name")).filter(F.col("name").startswith("E:")).distinct()
    steps = F.explode(F.array(*(F.struct(_at(a, F.col("name")).alias("lhs"), F.array(symbol("N", _at(b, F.col("name")))).alias("rhs")) for a, b in zip(LAYERS, LAYERS[1:], strict=False))))
    aliases = names.select(steps.alias("x")).select("x.lhs", "x.rhs")
    return moved.unionByName(aliases).distinct()


