"""Counts over derivations: inside counts by length, shortest witnesses, longest words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typegram.operators import grammar as g
from typegram.operators.closure import _rounds, longest_paths, transitive
from typegram.operators.prune import useful
from typegram.session import cut


def inside_counts(cnf: DataFrame, max_length: int) -> DataFrame:
    """symbol, length, derivations (exact up to 38 digits; more raise an error)."""
    one = F.lit(1).cast("decimal(38,0)")
    terminal = cnf.filter(F.size("rhs") == 1)
    binary = cut(cnf.filter(F.size("rhs") == 2).select("lhs", F.col("rhs")[0]["value"].alias("left"), F.col("rhs")[1]["value"].alias("right")))
    table = cut(terminal.groupBy(F.col("lhs").alias("symbol"), F.lit(1).alias("length")).agg(F.sum(one).alias("derivations")))
    for n in range(2, max_length + 1):
        a = table.select(F.col("symbol").alias("left"), F.col("length").alias("la"), F.col("derivations").alias("da"))
        b = table.select(F.col("symbol").alias("right"), F.col("length").alias("lb"), F.col("derivations").alias("db"))
        new = binary.join(a, "left").join(b, "right").filter(F.col("la") + F.col("lb") == n).groupBy(F.col("lhs").alias("symbol"), F.lit(n).alias("length")).agg(
            F.sum((F.col("da") * F.col("db")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("derivations"))
        table = cut(table.unionByName(new))
    return table


def shortest_witness(p: DataFrame) -> DataFrame:
    """symbol, length, word: the shortest, then least, terminal word of each generating symbol of a binarised grammar."""
    unit = cut(g.unit_edges(p))
    terminal = p.filter((F.size("rhs") == 1) & (F.col("rhs")[0]["kind"] == "T")).select(F.col("lhs").alias("symbol"), F.array(F.col("rhs")[0]["value"]).alias("word"))
    binary = cut(p.filter(F.size("rhs") == 2).select("lhs", F.col("rhs")[0]["value"].alias("left"), F.col("rhs")[1]["value"].alias("right")))
    least = lambda df: df.groupBy("symbol").agg(F.min(F.struct(F.size("word").alias("n"), F.col("word"))).alias("s"))
    best = cut(least(terminal))
    for _ in _rounds():
        w = best.select("symbol", F.col("s.word").alias("word"))
        a, b = w.select(F.col("symbol").alias("left"), F.col("word").alias("wa")), w.select(F.col("symbol").alias("right"), F.col("word").alias("wb"))
        pairs = binary.join(a, "left").join(b, "right").select(F.col("lhs").alias("symbol"), F.concat("wa", "wb").alias("word"))
        up = unit.join(w, unit["dst"] == w["symbol"]).select(F.col("src").alias("symbol"), "word")
        new = cut(least(w.unionByName(pairs).unionByName(up)))
        if new.join(best.withColumnRenamed("s", "old"), "symbol", "left").filter("old IS NULL OR s <> old").isEmpty():
            return new.select("symbol", F.col("s.n").alias("length"), F.col("s.word").alias("word"))
        best = new


def longest_word(cnf: DataFrame, start: str = g.START) -> int | None:
    """Length of the longest word, 0 for the empty language, None where there is no bound."""
    p = cut(useful(cnf, start))
    if p.isEmpty():
        return 0
    edges = cut(p.filter(F.size("rhs") == 2).select(F.col("lhs").alias("src"), F.explode("rhs").alias("s")).select("src", F.col("s.value").alias("dst")).distinct())
    if not edges.isEmpty() and not transitive(edges).filter("src = dst").isEmpty():
        return None
    depth = (longest_paths(edges).agg(F.max("level")).first()[0] or 0) if not edges.isEmpty() else 0
    length = cut(p.select(F.col("lhs").alias("node"), F.lit(1).alias("n")).distinct().filter("node IS NOT NULL"))
    binary = cut(p.filter(F.size("rhs") == 2).select("lhs", F.col("rhs")[0]["value"].alias("left"), F.col("rhs")[1]["value"].alias("right")))
    for _ in range(depth):
        a, b = length.select(F.col("node").alias("left"), F.col("n").alias("na")), length.select(F.col("node").alias("right"), F.col("n").alias("nb"))
        new = binary.join(a, "left").join(b, "right").select(F.col("lhs").alias("node"), (F.col("na") + F.col("nb")).alias("n"))
        length = cut(length.unionByName(new).groupBy("node").agg(F.max("n").alias("n")))
    return length.filter(F.col("node") == start).first().n
