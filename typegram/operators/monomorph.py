"""Instances of generic types and calls over ground types, and their parameterised alternative."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typegram.operators.closure import closure
from typegram.operators.grammar import symbol
from typegram.operators.ordering import take_per
from typegram.operators.types import depth, substitute


def admissible(ground: DataFrame, bounds: DataFrame, edges: DataFrame) -> DataFrame:
    """generic, variable, type: ground types below all bounds of a variable; without bounds any.

    bounds(generic, variable, bound or NULL); edges sub -> super. An equi-join on the bound, not a product: only
    variables without any bound meet all ground types.
    """
    below = closure(edges).select(F.col("src").alias("type"), F.col("dst").alias("bound"))
    bound = bounds.filter("bound IS NOT NULL")
    needed = bound.groupBy("generic", "variable").agg(F.count_distinct("bound").alias("n"))
    met = bound.join(below, "bound").join(ground.select("type").distinct(), "type", "left_semi").groupBy("generic", "variable", "type").agg(F.count_distinct("bound").alias("m"))
    bounded = met.join(needed, ["generic", "variable"]).filter("m = n").select("generic", "variable", "type")
    free = bounds.groupBy("generic", "variable").agg(F.max("bound").alias("b")).filter("b IS NULL").select("generic", "variable", F.lit("*").alias("any"))
    every = ground.select("type").distinct().withColumn("any", F.lit("*"))
    return bounded.unionByName(free.join(every, "any").select("generic", "variable", "type"))


def bindings(domains: DataFrame, variables: Sequence[str] | int) -> DataFrame:
    """generic, binding map: all choices of a type per variable of each generic (at most three variables)."""
    out = None
    names = domains.select("generic", "variable").distinct().groupBy("generic").agg(F.sort_array(F.collect_set("variable")).alias("vars"))
    k = variables if isinstance(variables, int) else len(variables)
    if k > 3:
        raise ValueError("more than three type variables")
    rows = names.select("generic", "vars", F.create_map().cast("map<string,string>").alias("binding"))
    for i in range(k):
        v = rows.filter(F.size("vars") > i).withColumn("variable", F.get("vars", F.lit(i)))
        done = rows.filter(F.size("vars") <= i)
        out = v.join(domains, ["generic", "variable"]).select("generic", "vars", F.map_concat("binding", F.create_map("variable", "type")).alias("binding"))
        rows = done.unionByName(out)
    return rows.filter(F.size("vars") == F.size(F.map_keys("binding"))).select("generic", "binding")


def instantiated(calls: DataFrame, bound: DataFrame, max_depth: int = 2) -> DataFrame:
    """calls(generic, result, receiver, name, params) with the variables of each binding replaced; ground and shallow ones stay."""
    rows = calls.join(bound, "generic")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, result, receiver, name, params, binding in zip(*(pdf[c] for c in ("generic", "result", "receiver", "name", "params", "binding")), strict=True):
                b = dict(binding)
                known = frozenset(b)
                types = [None if t is None else substitute(t, b, known) for t in (result, receiver, *params)]
                if types[0] is None or receiver is not None and types[1] is None or None in types[2:] or any(t is not None and depth(t) > max_depth for t in types):
                    continue
                out.append((g, types[0], types[1], name, types[2:]))
            yield pd.DataFrame(out, columns=["generic", "result", "receiver", "name", "params"])

    schema = "generic string, result string, receiver string, name string, params array<string>"
    return rows.select("generic", "result", "receiver", "name", "params", "binding").mapInPandas(run, schema).distinct()


def parameterised(calls: DataFrame, domains: DataFrame) -> DataFrame:
    """lhs, rhs of domain rows: variable -> domain symbol -> each admissible type; calls keep their variables."""
    name = F.concat(F.lit("@domain:"), "generic", F.lit("."), "variable")
    to_domain = domains.select(F.concat("generic", F.lit("."), "variable").alias("lhs"), F.array(symbol("N", name)).alias("rhs")).distinct()
    return to_domain.unionByName(domains.select(name.alias("lhs"), F.array(symbol("N", F.col("type"))).alias("rhs"))).distinct()


def depth_budget(uses: DataFrame, max_depth: int) -> DataFrame:
    """variable, budget of uses(variable, nesting): least room over its occurrences."""
    return uses.groupBy("variable").agg(F.min(F.lit(max_depth) - F.col("nesting")).alias("budget"))


def ground_types(constructors: DataFrame, base: DataFrame, max_depth: int, per_level: int) -> DataFrame:
    """type, depth: base types and constructor<args> built from them level by level.

    constructors(name, arity 1 or 2). A level meets all earlier types through the constructor's arity; the cut of a level
    is the first per_level of each constructor in order of name, so its size is bounded by the constructors.
    """
    from typegram.session import cut

    pool = cut(base.select("type").distinct().withColumn("depth", F.lit(0)))
    one = F.lit(1).alias("k")
    for level in range(1, max_depth + 1):
        args = take_per(pool.select("type", "depth", one), ["k"], [F.col("depth"), F.col("type")], per_level).select("k", "type")
        cons = constructors.select("name", "arity", one)
        unary = cons.filter("arity = 1").join(args, "k").select("name", F.concat("name", F.lit("<"), "type", F.lit(">")).alias("type"))
        second = args.withColumnRenamed("type", "second")
        binary = cons.filter("arity = 2").join(args, "k").join(second, "k").select("name", F.concat("name", F.lit("<"), "type", F.lit(","), "second", F.lit(">")).alias("type"))
        new = take_per(unary.unionByName(binary), ["name"], [F.col("type")], per_level).select("type").join(pool, "type", "left_anti")
        pool = cut(pool.unionByName(new.withColumn("depth", F.lit(level))))
    return pool


def subtype_rules(types: DataFrame, edges: DataFrame, top: str | None = None) -> DataFrame:
    """super -> sub for all proper pairs of known types; the top type is above all and gets no row per pair."""
    known = types.select("type").distinct()
    c = closure(edges).filter("src <> dst")
    c = c.join(known.withColumnRenamed("type", "src"), "src", "left_semi").join(known.withColumnRenamed("type", "dst"), "dst", "left_semi")
    if top is not None:
        c = c.filter((F.col("dst") != top) & (F.col("src") != top))
    return c.select(F.col("dst").alias("lhs"), F.array(symbol("N", F.col("src"))).alias("rhs"))


def inherited_methods(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """type, signature: own methods and those of all supertypes, each signature once (edges sub -> super)."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).union(methods.select("owner")).distinct()
    reach = closure(edges, nodes)
    return reach.join(methods, reach["dst"] == methods["owner"]).select(F.col("src").alias("type"), "signature").distinct()


def external_types(bases: DataFrame, types: DataFrame) -> DataFrame:
    """types with a row of kind EXTERNAL for every base that is not among them."""
    missing = bases.select(F.col("base").alias("name")).distinct().join(types.select("name"), "name", "left_anti")
    return types.select("name", "kind").unionByName(missing.withColumn("kind", F.lit("EXTERNAL")))


def erased_cover(types: DataFrame) -> DataFrame:
    """Types below the top type that no erased form of theirs stands for already."""
    erased: Column = F.regexp_extract("type", r"\A([^<]*)", 1)
    forms = types.filter(~F.col("type").contains("<")).select(F.col("type").alias("e"))
    return types.withColumn("e", erased).filter(F.col("type").contains("<")).join(forms, "e", "left_anti").select("type").unionByName(
        types.filter(~F.col("type").contains("<")).select("type"))
