"""Aggregates of evaluation runs: frequencies, funnels, ratios, running metrics, percentiles, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typegram.operators.ordering import running


def document_frequency(df: DataFrame, items: str, name: str = "item") -> DataFrame:
    """Records per item, counted once a record."""
    return df.select(F.explode(F.array_distinct(items)).alias(name)).groupBy(name).agg(F.count("*").alias("files"))


def funnel(df: DataFrame, **stages: Column) -> DataFrame:
    """One row per stage with the rows that pass it and all stages before."""
    passed, names = F.lit(True), list(stages)
    columns = []
    for name in names:
        passed = passed & F.coalesce(stages[name], F.lit(False))
        columns.append(F.count_if(passed).alias(name))
    one = df.agg(F.count("*").alias("all"), *columns)
    return one.select(F.posexplode(F.array(*(F.struct(F.lit(n).alias("stage"), F.col(n).alias("n")) for n in ["all", *names])))).select(
        F.col("pos").alias("step"), "col.stage", F.col("col.n").alias("rows"))


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def percent_text(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("n/a")).otherwise(F.format_string("%.2f%%", x * 100))


def run_ratios(df: DataFrame, *groups: str) -> DataFrame:
    """Recall, precision, coverage and mean seconds of evaluation runs; NULL where the whole is 0."""
    names = ("recognized", "evaluated", "precision_accepted", "precision_checked", "precision_requested")
    sums = df.groupBy(*groups).agg(*(F.sum(c).alias(c) for c in names))
    return sums.withColumns({"recall": ratio(F.col("recognized"), F.col("evaluated")), "precision": ratio(F.col("precision_accepted"), F.col("precision_checked")),
                             "coverage": ratio(F.col("precision_checked"), F.col("precision_requested"))})


def merged_counters(df: DataFrame, counters: str) -> DataFrame:
    """Sum by key of a map column over all rows, in long form."""
    return df.select(F.explode(counters).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("value"))


def as_map(long: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """A long counter as one map; for counters of known, few keys."""
    return long.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("counters"))


def running_run_metrics(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Running recall, precision and coverage after each run, in a total order."""
    names = ("recognized", "evaluated", "precision_accepted", "precision_checked", "precision_requested")
    rows = running(df, order, {f"run_{c}": F.col(c) for c in names})
    return rows.withColumns({"recall": ratio(F.col("run_recognized"), F.col("run_evaluated")),
                             "precision": ratio(F.col("run_precision_accepted"), F.col("run_precision_checked")),
                             "coverage": ratio(F.col("run_precision_checked"), F.col("run_precision_requested"))})


def rank_with_ties(df: DataFrame, groups: Sequence[str], score: Column, order: Column) -> DataFrame:
    """rank1 = strictly better + tied before + 1, and the number of ties."""
    w = Window.partitionBy(*groups).orderBy(score.desc())
    ordered = Window.partitionBy(*groups).orderBy(score.desc(), order)
    return df.withColumns({"strictly_better": F.rank().over(w) - 1, "rank1": F.row_number().over(ordered),
                           "tied_total": F.count("*").over(Window.partitionBy(*groups, score))}).withColumn(
        "tied_before", F.col("rank1") - 1 - F.col("strictly_better"))


def slice_ends(df: DataFrame, length: str, size: str, groups: Sequence[str] = ()) -> DataFrame:
    """Ends of the slices of words of equal length: prefix sums over lengths."""
    w = Window.partitionBy(*groups).orderBy(length).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("slice_end", F.sum(size).over(w))


def history(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, n: int = 3) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumns({f"prev{i}": F.lag(value, i).over(w) for i in range(1, n + 1)})


def medians(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """The lower median (a member of the group) and the interpolated one."""
    return df.groupBy(*groups).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("lower_median"), F.median(value).alias("median"))


def censored_summary(df: DataFrame, groups: Sequence[str], measured: Column, value: Column, bound: Column) -> DataFrame:
    """Minimum, maximum and mean of measured values and of the bounds of censored ones, apart."""
    v, b = F.when(measured, value), F.when(~measured, bound)
    return df.groupBy(*groups).agg(
        F.count(v).alias("measured"), F.min(v).alias("measured_min"), F.max(v).alias("measured_max"), F.round(F.avg(v), 6).alias("measured_mean"),
        F.count(b).alias("censored"), F.min(b).alias("censored_min"), F.max(b).alias("censored_max"), F.round(F.avg(b), 6).alias("censored_mean"))


def log_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges of equal width in log10; one value becomes the range from its half to its double."""
    import math

    if low == high:
        low, high = low / 2, high * 2
    a, b = math.log10(low), math.log10(high)
    return [10 ** (a + (b - a) * i / bins) for i in range(bins + 1)]


def log_histogram(df: DataFrame, value: str, bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """Counts per log-spaced bin of positive values; the last bin is closed. Bins without values are absent."""
    rows = df.filter(F.col(value) > 0).select(*groups, F.log10(value).alias("x"))
    ends = rows.groupBy(*groups).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    two = F.log10(F.lit(2.0))
    ends = ends.select(*groups, F.when(F.col("lo") == F.col("hi"), F.col("lo") - two).otherwise(F.col("lo")).alias("lo"),
                       F.when(F.col("lo") == F.col("hi"), F.col("hi") + two).otherwise(F.col("hi")).alias("hi"))
    if groups:
        a, b = rows.alias("a"), ends.alias("b")
        on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
        both = a.join(b, on).select(*(F.col(f"a.{g}").alias(g) for g in groups), "x", "lo", "hi")
    else:
        one = ends.first()
        if one is None or one.lo is None:
            return rows.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
        both = rows.withColumns({"lo": F.lit(one.lo), "hi": F.lit(one.hi)})
    b = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    return both.groupBy(*groups, b.alias("bin")).agg(F.count("*").alias("n"))


def paired_improvement(df: DataFrame, before: str, after: str, *groups: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.count_if(F.col(after) < F.col(before)).alias("improved"), F.count_if(F.col(after) == F.col(before)).alias("equal"),
                                   F.count_if(F.col(after) > F.col(before)).alias("worse"), F.count_if(F.col(after).isNull() | F.col(before).isNull()).alias("unpaired"))


def ambiguous(df: DataFrame, keys: Sequence[str], descriptor: str) -> DataFrame:
    """Keys with more than one distinct descriptor."""
    return df.groupBy(*keys).agg(F.count_distinct(descriptor).alias("descriptors")).filter("descriptors > 1")
