"""Incremental evaluation metrics: foreachBatch totals that survive restarts, quarantine, deadlines, lazy slices."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTERS = ("recognized", "evaluated", "precision_accepted", "precision_checked", "precision_requested")


class RunningTotals:
    """Totals per group after each micro-batch. A batch's totals are written under its id, so a repeated batch replaces itself."""

    def __init__(self, spark: SparkSession, path: str, groups: list[str], counters: tuple[str, ...] = COUNTERS):
        self.spark, self.path, self.groups, self.counters = spark, path.rstrip("/"), groups, counters

    def update(self, batch: DataFrame, epoch: int) -> None:
        sums = batch.groupBy(*self.groups).agg(*(F.sum(c).alias(c) for c in self.counters))
        sums.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def totals(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows.groupBy(*self.groups).agg(*(F.sum(c).alias(c) for c in self.counters))

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per event-time window and key; rows later than the watermark are left out of append output."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def quarantined(df: DataFrame, f: Callable[[pd.Series], dict], schema: str, key: str, retries: int = 1, seconds: float | None = None) -> DataFrame:
    """key, f's fields, status, error: a row that fails, or exceeds its seconds, becomes a failure row after its retries."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, row in pdf.iterrows():
                status, error, out = "failed", None, {}
                for _attempt in range(retries + 1):
                    began = time.monotonic()
                    try:
                        out = f(row)
                        late = seconds is not None and time.monotonic() - began > seconds
                        status, error = ("timeout", f"over {seconds} s") if late else ("ok", None)
                        if late:
                            out = {}
                        break
                    except Exception as e:  # noqa: BLE001 - any failure becomes a row
                        error = f"{type(e).__name__}: {e}"
                rows.append((row[key], *(out.get(n) for n in names), status, error))
            yield pd.DataFrame(rows, columns=[key, *names, "status", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.mapInPandas(run, f"`{key}` {kind}, {schema}, status string, error string")
