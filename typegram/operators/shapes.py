"""Shapes of signatures and generic subtype tests by unification."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typegram.operators.closure import longest_paths, transitive
from typegram.operators.ordering import first_per
from typegram.operators.types import parse, render, substitute, variables


def normalised(types: list[str | None], known: frozenset[str]) -> list[str | None]:
    """Types with their variables renamed in order of first use."""
    names: dict[str, str] = {}

    def walk(key: str) -> str:
        name, args, nullable = parse(key)
        if not args and name in known:
            return names.setdefault(name, f"${len(names)}") + ("?" if nullable else "")
        return render(name, tuple(map(walk, args)), nullable)

    return [None if t is None else walk(t) for t in types]


def with_shape(callables: DataFrame) -> DataFrame:
    """callables(owner, name, result, params, type_vars) with shape, equal for signatures equal up to renaming."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["shape"] = [f"{n}:" + ";".join(normalised([r, *p], frozenset(v))) for n, r, p, v in zip(pdf["name"], pdf["result"], pdf["params"], pdf["type_vars"], strict=True)]
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in callables.schema)
    return callables.mapInPandas(run, f"{schema}, shape string")


def receivers(callables: DataFrame, edges: DataFrame) -> DataFrame:
    """owner, shape, receiver: the topmost type of each owner's line (edges sub -> super) that declares the shape.

    The receiver is erased when the shape uses none of its type variables.
    """
    shaped = with_shape(callables)
    up = transitive(edges)
    level = longest_paths(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))  # 0 at the top
    own = shaped.select("owner", "shape")
    line = own.join(up, own["owner"] == up["src"]).select("owner", "shape", F.col("dst").alias("at")).unionByName(own.select("owner", "shape", F.col("owner").alias("at")))
    declares = shaped.select(F.col("owner").alias("at"), "shape", F.col("shape").contains("$").alias("generic"))
    found = line.join(declares, ["at", "shape"]).join(level.withColumnRenamed("node", "at"), "at", "left")
    best = first_per(found, ["owner", "shape"], [F.coalesce("level", F.lit(0)), F.col("at")])
    erased = F.regexp_replace("at", r"<.*", "")
    return best.select("owner", "shape", F.when(F.col("generic"), F.col("at")).otherwise(erased).alias("receiver"))


def unify(pattern: str, target: str, known: frozenset[str], binding: dict[str, str] | None = None) -> dict[str, str] | None:
    """Binding of the pattern's variables that makes it the target; a nullable target takes both."""
    binding = dict(binding or {})
    (pn, pa, pq), (tn, ta, tq) = parse(pattern), parse(target)
    if pq and not tq:
        return None
    if not pa and pn in known:
        bare = render(tn, ta)
        if binding.setdefault(pn, bare) != bare:
            return None
        return binding
    if pn != tn or len(pa) != len(ta):
        return None
    for x, y in zip(pa, ta, strict=True):
        got = unify(x, y, known, binding)
        if got is None:
            return None
        binding = got
    return binding


def is_subtype(actual: str, expected: str, templates: list[tuple[str, str]], known: frozenset[str], max_depth: int = 8, top: str | None = None) -> bool:
    """Whether actual lies below expected along templates (super, sub) with variables, in at most max_depth steps."""
    if expected == top:
        return True
    seen, frontier = {actual}, [actual]
    for _ in range(max_depth + 1):
        if expected in frontier or any(t + "?" == expected for t in frontier):
            return True
        nxt = []
        for t in frontier:
            nullable = t.endswith("?")
            for above, below in templates:
                b = unify(below, t[:-1] if nullable else t, known)
                if b is not None and (s := substitute(above, b, known)) is not None:
                    s += "?" if nullable and not s.endswith("?") else ""
                    if s not in seen:
                        seen.add(s)
                        nxt.append(s)
        frontier = nxt
        if not frontier:
            break
    return False


def admissible_arguments(types: DataFrame, priority: dict[str, int], limit: int) -> DataFrame:
    """type, depth of candidates for type arguments: plain names, best priority, then depth, then name; at most limit."""
    ranks = types.sparkSession.createDataFrame(list(priority.items()) or [("", 0)], "name string, priority int")
    t = types.filter(F.col("type").rlike(r"\A[\w.]+(<[\w.<>,? ]+>)?\z")).withColumn("name", F.regexp_extract("type", r"\A([\w.]+)", 1))
    depth = F.length(F.regexp_replace("type", "[^<]", ""))
    return t.join(F.broadcast(ranks), "name", "left").select("type", depth.alias("depth"), F.coalesce("priority", F.lit(1 << 20)).alias("priority")).orderBy("priority", "depth", "type").limit(limit)


def supporting_rules(types: DataFrame) -> DataFrame:
    """Rows a displayed type needs: its alternatives, its erased form, and empty or tuple displays."""
    from typegram.operators.assign import generic, parts
    from typegram.operators.grammar import SCHEMA

    empty = {"list": ["[", "]"], "dict": ["{", "}"], "tuple": ["(", ")"], "set": ["set", "(", ")"]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, todo, seen = [], list(pdf["type"]), set()
            while todo:
                t = todo.pop()
                if t in seen:
                    continue
                seen.add(t)
                alternatives = parts(t)
                if len(alternatives) > 1:
                    rows += [(t, [("N", x)]) for x in alternatives]
                    todo += alternatives
                    continue
                base, args = generic(t)
                if args and base != t:
                    rows.append((base, [("N", t)]))
                    todo += [x for x in args if x not in ("...", "()")]
                if base in empty:
                    rows.append((t, [("T", x) for x in empty[base]]))
                if base == "tuple" and args and "..." not in args and args != ("()",):
                    inner = [s for i, x in enumerate(args) for s in ([("T", ",")] if i else []) + [("N", x)]]
                    rows.append((t, [("T", "("), *inner, *([("T", ",")] if len(args) == 1 else []), ("T", ")")]))
            yield pd.DataFrame(rows, columns=["lhs", "rhs"])

    return types.select("type").distinct().mapInPandas(run, SCHEMA).distinct()


def qualified(names: DataFrame, profile: DataFrame) -> DataFrame:
    """name -> spoken under an import profile(module, alias): the longest module that prefixes the name is written as its alias."""
    from typegram.operators.relations import prefix_matches

    hit = prefix_matches(names, profile).join(profile, "module")
    best = first_per(hit, ["name"], [F.desc(F.length("module")), F.col("alias")])
    rest = F.expr("substring(name, length(module) + 1)")
    return names.select("name").distinct().join(best.select("name", F.concat("alias", rest).alias("s")), "name", "left").select("name", F.coalesce("s", "name").alias("spoken"))


def unqualified(spoken: DataFrame, profile: DataFrame) -> DataFrame:
    """The inverse: alias.rest -> module.rest."""
    first = F.substring_index("spoken", ".", 1)
    p = profile.select(F.col("alias").alias("_a"), "module")
    rest = F.expr("substring(spoken, length(_a) + 1)")
    return spoken.join(p, first == F.col("_a"), "left").select("spoken", F.coalesce(F.concat("module", rest), "spoken").alias("name"))


def variables_of(types: DataFrame, known: list[str]) -> DataFrame:
    """type, variables in order of first use."""
    k = frozenset(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"type": pdf["type"], "variables": [variables(t, k) for t in pdf["type"]]})

    return types.select("type").distinct().mapInPandas(run, "type string, variables array<string>")
