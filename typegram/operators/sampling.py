"""Deterministic samples, quotas and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typegram.operators.ordering import indexed, take_per


def seeded_hash(seed: int, *parts: Column) -> Column:
    """Hex of sha256(seed NUL part NUL part ...); fixed width, so it sorts like the number."""
    return F.sha2(F.concat_ws("\0", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def bottom_k(df: DataFrame, member: str, seed: int, k: int) -> DataFrame:
    """The k distinct members of least (hash, member); a bounded heap per task, then of the tasks."""
    return df.select(member).filter(F.col(member).isNotNull()).distinct().withColumn("h", seeded_hash(seed, F.col(member))).orderBy("h", member).limit(k)


def least_hash_per(df: DataFrame, group: str, seed: int, parts: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per group: that of least hash of its parts (ties by the parts)."""
    order = F.struct(seeded_hash(seed, *(F.col(p) for p in parts)).alias("h"), *(F.col(p) for p in parts))
    return df.groupBy(group).agg(F.min_by(F.struct(*keep), order).alias("s")).select(group, "s.*")


def top_with_minimum(counts: DataFrame, name: str, count: str, top: int, least: int = 1, excluded: Sequence[str] = ("__future__",),
                     explicit: Sequence[str] = ()) -> DataFrame:
    """Names of at least `least` counts, without excluded ones, cut to `top` (0: no cut), united with explicit ones."""
    ranked = counts.filter((F.col(count) >= least) & ~F.col(name).isin(*excluded)).orderBy(F.desc(count), name)
    ranked = ranked.limit(top) if top else ranked
    if not explicit:
        return ranked
    asked = counts.sparkSession.createDataFrame([(x,) for x in explicit], f"{name} string").join(counts, name, "left").select(
        name, F.coalesce(count, F.lit(0)).alias(count))
    return ranked.unionByName(asked).distinct()


def shard(df: DataFrame, order: Sequence[str], shards: int, index: int | None = None) -> DataFrame:
    """Rows of position % shards = index in a total order, or all rows with their shard."""
    rows = indexed(df, order, "source_index").withColumn("shard", F.col("source_index") % shards)
    return rows if index is None else rows.filter(F.col("shard") == index)


def quota(total: int, workers: int) -> list[int]:
    """total split into workers parts that differ by one at most, larger parts first."""
    q, r = divmod(total, workers)
    return [q + (i < r) for i in range(workers)]


def quotas(df: DataFrame, total: str, workers: str) -> DataFrame:
    """One row per worker with its quota."""
    w = F.explode(F.sequence(F.lit(0), F.col(workers) - 1)).alias("worker")
    rows = df.select("*", w)
    return rows.withColumn("quota", F.expr(f"{total} div {workers}") + F.when(F.col("worker") < F.col(total) % F.col(workers), 1).otherwise(0))


def rank_draw(seed: int, limit: int, *parts: Column) -> Column:
    """A uniform draw from [0, limit) that depends on seed and parts only."""
    return F.pmod(F.conv(F.substring(seeded_hash(seed, *parts), 1, 15), 16, 10).cast("long"), F.lit(limit))


def stratified(df: DataFrame, strata: Sequence[str], seed: int, key: str, n: int) -> DataFrame:
    """n rows per stratum in order of the seeded hash of their key."""
    return take_per(df, strata, [seeded_hash(seed, F.col(key)), F.col(key)], n)


def fill_deficit(have: DataFrame, pool: DataFrame, group: str, key: str, target: int, seed: int) -> DataFrame:
    """Rows of the pool that fill every group up to target, none that is already there."""
    missing = pool.join(have.select(key), key, "left_anti")
    count = have.groupBy(group).agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy(group).orderBy(seeded_hash(seed, F.col(key)), F.col(key)))
    return missing.withColumn("rn", rn).join(count, group, "left").filter(F.col("rn") <= F.lit(target) - F.coalesce("n", F.lit(0))).drop("rn", "n")


def until_quota(df: DataFrame, order: Sequence[str], accepted: Column, n: int) -> DataFrame:
    """Rows in order up to and including the n-th accepted one."""
    from typegram.operators.ordering import running

    rows = running(df, order, {"accepted_so_far": accepted.cast("int").cast("long")})
    return rows.filter((F.col("accepted_so_far") < n) | (F.col("accepted_so_far") == n) & accepted)
