"""Fixpoints over edge relations (src, dst): reachability, closure by doubling, strong components, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typegram.session import cut

MAX_ROUNDS = 1000


def _rounds():
    yield from range(MAX_ROUNDS)
    raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: the seeds and all they lead to. Semi-naive: only the last frontier is joined."""
    edges = cut(edges.select("src", "dst").distinct())
    seen = frontier = cut(seeds.select("node").distinct())
    for _ in _rounds():
        new = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(new.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


def transitive(edges: DataFrame) -> DataFrame:
    """src, dst of all paths of one edge or more, in about log2(diameter) rounds.

    Semi-naive doubling: the pairs found last, continued by all pairs. A shortest path of more than 2**k and at most
    2**(k + 1) edges begins with a shortest one of 2**k, which the last round found.
    """
    paths = delta = cut(edges.select("src", "dst").distinct())
    for _ in _rounds():
        d, p = delta.alias("d"), paths.alias("p")
        longer = d.join(p, F.col("d.dst") == F.col("p.src")).select("d.src", "p.dst").distinct()
        delta = cut(longer.join(paths, ["src", "dst"], "left_anti"))
        if delta.isEmpty():
            return paths
        paths = cut(paths.unionByName(delta))


def closure(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Reflexive and transitive: every node (by default every end of an edge) reaches itself."""
    nodes = nodes.select("node") if nodes is not None else ends(edges)
    own = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    return transitive(edges).unionByName(own).distinct()


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node of its strong component."""
    c = cut(closure(edges))
    back = c.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return c.join(back, ["src", "dst"]).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component"))


def condensed(edges: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """Edges between different components."""
    comp = cut(comp if comp is not None else components(edges))
    a = comp.select(F.col("node").alias("src"), F.col("component").alias("a"))
    b = comp.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    return edges.join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def longest_paths(edges: DataFrame) -> DataFrame:
    """node, level: edges on the longest path that leads to it; for acyclic relations."""
    edges = cut(edges.select("src", "dst").distinct())
    level = cut(ends(edges).withColumn("level", F.lit(0)))
    frontier = level
    for _ in _rounds():
        step = frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("new"))
        frontier = cut(step.join(level, "node").filter("new > level").select("node", F.col("new").alias("level")))
        if frontier.isEmpty():
            return level
        level = cut(level.unionByName(frontier).groupBy("node").agg(F.max("level").alias("level")))


def supertypes(edges: DataFrame, access: str | None = None) -> DataFrame:
    """type, super: all proper supertypes over edges sub (src) -> super (dst), public ones only when access is given."""
    e = edges if access is None else edges.filter(F.col(access) == "public")
    return transitive(e).filter("src <> dst").select(F.col("src").alias("type"), F.col("dst").alias("super"))


def downward(edges: DataFrame, needed: DataFrame) -> DataFrame:
    """Edges super -> sub whose both ends lie below a needed type."""
    below = cut(reachable(edges, needed))
    return edges.join(below.withColumnRenamed("node", "src"), "src", "left_semi").join(below.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
