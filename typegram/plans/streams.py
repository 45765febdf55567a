"""Queries that run a stream to its end and give the result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from typegram.plans.registry import query
from typegram.session import shared_dir, table
from typegram.streaming.metrics import RunningTotals, windowed_counts


def _stream(spark, sf_dir, name):
    """The table's files as a stream; a single file is found by its name in the folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


@query("stream_running_totals", """
SELECT source, sum(recognized)::BIGINT AS recognized, sum(evaluated)::BIGINT AS evaluated, sum(precision_accepted)::BIGINT AS precision_accepted, sum(precision_checked)::BIGINT AS precision_checked,
 sum(precision_requested)::BIGINT AS precision_requested FROM aggregate_run GROUP BY source
""")
def stream_running_totals(spark, sf_dir):
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    totals = RunningTotals(spark, f"{base}/totals", ["source"])
    totals.start(_stream(spark, sf_dir, "aggregate_run"), f"{base}/checkpoint").awaitTermination()
    return totals.totals()


@query("stream_event_windows", """
SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL
""")
def stream_event_windows(spark, sf_dir):
    name = f"w{uuid.uuid4().hex}"
    counts = windowed_counts(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day", "100 days")
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option(
        "checkpointLocation", f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}").start()
    q.awaitTermination()
    return spark.table(name).withColumn("start", F.col("start").cast("timestamp_ntz"))
