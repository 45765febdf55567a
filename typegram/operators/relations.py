"""Joins that analysis runs need: merges by priority, hints, spans, collisions, precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typegram.operators.ordering import first_per


def fetch_members(sources: DataFrame, wanted: DataFrame, key: str = "member") -> tuple[DataFrame, DataFrame]:
    """Rows of wanted members, and wanted members that no row has."""
    return sources.join(wanted, key, "left_semi"), wanted.join(sources.select(key), key, "left_anti")


def merged_by_priority(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row per key from several sources, the first source that has it; a source's own ties by order."""
    rows = None
    for i, part in enumerate(parts):
        part = part.withColumn("_priority", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return first_per(rows, keys, [F.col("_priority"), *order]).drop("_priority")


def outer_merged(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer merge: values of the left where it has them, else of the right; where says which sides had the key."""
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    la, lb = F.col("a._in"), F.col("b._in")
    both = left.withColumn("_in", F.lit(1)).alias("a").join(right.withColumn("_in", F.lit(1)).alias("b"), on, "full_outer")
    where = F.when(la.isNotNull() & lb.isNotNull(), "both").when(la.isNotNull(), "left").otherwise("right")
    return both.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), *(F.coalesce(f"a.{v}", f"b.{v}").alias(v) for v in values), where.alias("found_in"))


def overlapping(spans: DataFrame, others: DataFrame, key: str, bucket: int) -> DataFrame:
    """Pairs of spans(key, id, begin, end) and others(key, other_id, from, to) that share a position, both ends included.

    Every span is listed under the buckets it touches, so the range join is an equi-join on (key, bucket); a pair that
    meets in several buckets is kept in the first.
    """
    at = lambda c: F.floor(F.col(c) / bucket).cast("long")
    a = spans.withColumn("_b", F.explode(F.sequence(at("begin"), at("end"))))
    b = others.withColumn("_b", F.explode(F.sequence(at("from"), at("to"))))
    first = F.greatest(at("begin"), at("from"))
    return a.join(b, [key, "_b"]).filter((F.col("begin") <= F.col("to")) & (F.col("end") >= F.col("from")) & (F.col("_b") == first)).drop("_b")


def hinted(targets: DataFrame, hints: DataFrame, keys: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """Hints with the target at their keys; optional fields must agree where the hint has them, else the hint is stale."""
    t = targets.alias("t")
    h = hints.alias("h")
    agree = F.lit(True)
    for c in optional:
        agree = agree & (F.col(f"h.{c}").isNull() | F.col(f"h.{c}").eqNullSafe(F.col(f"t.{c}")))
    on = [F.col(f"h.{k}") == F.col(f"t.{k}") for k in keys]
    found = h.join(t, on, "left").select(*(F.col(f"h.{c}").alias(c) for c in hints.columns), (F.col(f"t.{keys[0]}").isNotNull() & agree).alias("fits"))
    return found.groupBy(*hints.columns).agg(F.max("fits").alias("fits")).withColumn("status", F.when(F.col("fits"), "matched").otherwise("stale")).drop("fits")


def colliding_names(types: DataFrame, tokens: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Type names that are tokens as well, but for allowed ones."""
    out = types.select("name").distinct().join(tokens.select(F.col("token").alias("name")), "name", "left_semi")
    return out if allowed is None else out.join(allowed.select("name"), "name", "left_anti")


def preferred_names(df: DataFrame, column: str, preferred: DataFrame) -> DataFrame:
    """Column with canonical spellings replaced by display names of preferred(canonical, display)."""
    p = preferred.select(F.col("canonical").alias(column), F.col("display").alias("_d"))
    return df.join(p, column, "left").withColumn(column, F.coalesce("_d", column)).drop("_d")


def compatible(artifacts: DataFrame, wanted: dict[str, str], least: dict[str, int], none_of: Sequence[str] = ()) -> DataFrame:
    """module of artifacts(module, key, value) whose values equal the wanted ones, reach the bounds and lack capped queries."""
    keys = [*wanted, *least, *none_of]
    wide = artifacts.filter(F.col("key").isin(keys)).groupBy("module").pivot("key", keys).agg(F.first("value"))
    ok = F.lit(True)
    for k, v in wanted.items():
        ok = ok & F.col(f"`{k}`").eqNullSafe(F.lit(v))
    for k, n in least.items():
        ok = ok & (F.col(f"`{k}`").cast("long") >= n)
    for k in none_of:
        ok = ok & (F.coalesce(F.col(f"`{k}`").cast("long"), F.lit(0)) == 0)
    return wide.filter(F.coalesce(ok, F.lit(False))).select("module")


def with_precedence(names: DataFrame, candidates: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The best candidate(name, ...) of each name, exact spelling before others in order."""
    return first_per(names.select("name").distinct().join(candidates, "name"), ["name"], order)


def prefix_matches(names: DataFrame, modules: DataFrame) -> DataFrame:
    """name, module of dotted names and modules that are the name or a dotted prefix of it; an equi-join on prefixes."""
    parts = F.split("name", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    return names.select("name", F.explode(prefixes).alias("module")).join(modules.select("module").distinct(), "module", "left_semi").select("name", "module")


def resolved_imports(edges: DataFrame, definitions: DataFrame, rounds: int = 64) -> DataFrame:
    """symbol, definition: where imported symbols are defined, along edges(symbol, target, rank); least rank wins.

    Pointers double, so a chain of n steps takes about log2(n) rounds; symbols on cycles never meet a definition.
    """
    from typegram.session import cut

    ends = cut(definitions.select("symbol").distinct())
    step = first_per(edges, ["symbol"], [F.col("rank"), F.col("target")]).select("symbol", "target")
    at = cut(step.join(ends, "symbol", "left_anti").unionByName(ends.select("symbol", F.col("symbol").alias("target"))))
    for _ in range(rounds):
        nxt = at.select(F.col("symbol").alias("target"), F.col("target").alias("after"))
        moved = cut(at.join(nxt, "target", "left").select("symbol", F.coalesce("after", "target").alias("target"), (F.col("after") != F.col("target")).alias("moved")))
        at = moved.select("symbol", "target")
        if moved.filter("moved").isEmpty():
            break
    return at.join(ends.withColumnRenamed("symbol", "target"), "target", "left_semi").select("symbol", F.col("target").alias("definition"))
