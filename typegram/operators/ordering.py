"""Global order without a single task: range partitions, their totals as offsets, windows inside each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typegram.session import written


def running(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """df with, per name in sums, the sum of that column over all rows up to this one in a total order.

    Only one row of totals per partition is gathered, whatever the number of rows.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.withColumns({f"_v_{k}": v for k, v in sums.items()}).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged)
    totals = ranged.groupBy("_part").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_part")
    return out.withColumns({k: F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) + F.col(f"_o_{k}") for k in sums}).drop(
        "_part", *(f"_v_{k}" for k in sums), *(f"_o_{k}" for k in sums))


def indexed(df: DataFrame, order: Sequence[Column | str], name: str = "index", partitions: int | None = None) -> DataFrame:
    """df with the position (from 0) of each row in a total order."""
    return running(df, order, {name: F.lit(1).cast("long")}, partitions).withColumn(name, F.col(name) - 1)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in a total order."""
    return take_per(df, keys, order, 1)


def take_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")
