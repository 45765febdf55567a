"""Uniform sample of k distinct members from pieces that arrive one after another.

The reservoir's members lie in hash-partitioned slots. With n members seen and m new ones in an arriving batch, the number
of new ones in the sample is hypergeometric. It is split over the slots of the batch, as many old ones are evicted
uniformly, split over the slots of the sample likewise, and every slot picks by a seeded hash of the member. Only counts
per slot are drawn on the driver. A member that was seen before is no new one, so every distinct member is equally likely,
however often it was sent.

State lies in a folder all executors share: a table of the new members of each batch, a table of the sample after it, and
a small file, put in place by one rename, that makes both count. A batch whose epoch is committed changes nothing; one that
broke off is done anew, by the same draws. So a restarted reservoir goes on where the last commit stands.

Defined cases: rows with NULL member are no members; NULL arrival times come first; a sample of k or fewer members is
everything; of rows with one member the first arrival is kept, among equal ones the smallest piece and position, and among
rows that agree in those any one; k = 0 and an empty table give no rows.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typegram.session import shared_dir

#: Slots of the reservoir: a bound of what is drawn on the driver. Tables of seen members that are read one by one.
SLOTS, PARTS = 64, 16
#: What arrives within so many seconds is one batch, where a table is replayed.
EVERY = 86_400


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn without replacement."""
    if n <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return min(n, good)
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    share = good / (good + bad)
    reach = int(14 * sqrt(n * share * (1 - share))) + 60  # beyond it lies less than any random number tells apart
    # probabilities by their ratios to the mode's, so that nothing cancels however large the counts are
    x = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    up = np.cumprod((good - x) * (n - x) / ((x + 1) * (float(bad - n) + x + 1)))
    y = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    down = np.cumprod(y * (float(bad - n) + y) / ((good - y + 1) * (n - y + 1)))
    weights = np.concatenate([down[::-1], [1.0], up])
    at = int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), "right"))
    return mode - len(down) + min(at, len(weights) - 1)


def spread(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How n drawn without replacement fall on groups of these sizes."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i in np.flatnonzero(counts):
        if n <= 0:
            break
        c = int(counts[i])
        out[i] = hypergeometric(rng, c, rest - c, n)
        n, rest = n - int(out[i]), rest - c
    return out


class Reservoir:
    """The sample kept up to date batch by batch, as foreachBatch of a stream calls it."""

    def __init__(self, spark: SparkSession, path: str, k: int, seed: int = 0, member: str = "member", piece: str = "piece_no",
                 position: str = "position", arrived: str = "arrived_at", keep: tuple[str, ...] = ("data",), slots: int = SLOTS):
        self.spark, self.path, self.k, self.seed, self.slots, self.keep = spark, path.rstrip("/"), k, seed, slots, keep
        self.columns = {"m": F.col(member), "t": F.unix_micros(F.col(arrived).cast("timestamp")), "p": F.col(piece), "o": F.col(position)}
        self.names = (member, piece, position)
        self.state = self._committed() or {"version": 0, "epoch": None, "seen": 0, "parts": [], "held": [0] * slots, "sample": None}

    @property
    def seen(self) -> int:
        return self.state["seen"]

    def _fs(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _committed(self) -> dict | None:
        at, fs = self._fs("commit-*.json")
        files = sorted(str(x.getPath().getName()) for x in fs.globStatus(at) or ())
        if not files:
            return None
        at, fs = self._fs(files[-1])
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        name = f"commit-{state['version']:09d}.json"
        (draft, fs), (final, _) = self._fs(f"draft-{uuid.uuid4().hex}"), self._fs(name)
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if not fs.rename(draft, final):
            raise RuntimeError(f"{name} was committed by another writer")
        self.state = state

    def update(self, batch: DataFrame, epoch: int | None = None) -> None:
        state = self.state
        if epoch is not None and state["epoch"] is not None and epoch <= state["epoch"]:
            return
        version = state["version"] + 1
        order = F.struct("t", "p", "o")
        rows = batch.select(*(c.alias(x) for x, c in self.columns.items())).filter("m IS NOT NULL").groupBy("m").agg(F.min(order).alias("f"))
        rows = rows.select("m", F.pmod(F.xxhash64("m", F.lit(self.seed)), F.lit(self.slots)).cast("int").alias("slot"), "f.*")
        part, kept = f"seen-{version}", f"sample-{version}"
        if state["parts"]:  # the batch is the smaller side: only those of its members that were seen come back from the seen ones
            rows = self._table(rows, f"batch-{version}")
            seen = self.spark.read.schema("m " + rows.schema["m"].dataType.simpleString()).parquet(*(f"{self.path}/{x}" for x in state["parts"]))
            rows = rows.join(seen.join(rows.select("m"), "m", "left_semi"), "m", "left_anti")
        rows = self._table(rows, part)
        new = np.zeros(self.slots, np.int64)
        for s, c in rows.groupBy("slot").agg(F.count("*")).collect():
            new[s] = c
        rng = np.random.default_rng((self.seed, version))
        held, m = np.array(state["held"], np.int64), int(new.sum())
        into = min(m, self.k) if not state["seen"] else m if state["seen"] + m <= self.k else hypergeometric(rng, m, state["seen"], self.k)
        stay = min(int(held.sum()), self.k - into)
        take, rest = spread(rng, new, into), spread(rng, held, stay)
        parts = []
        if into or not state["sample"]:
            parts.append(self._with_data(batch, self._pick(rows, take, 2 * version)))
        if state["sample"]:
            parts.append(self._pick(self.spark.read.parquet(f"{self.path}/{state['sample']}"), rest, 2 * version + 1))
        reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(f"{self.path}/{kept}")
        seen_in = [*state["parts"], part] if m else state["parts"]
        if len(seen_in) > PARTS:
            self._table(self.spark.read.parquet(*(f"{self.path}/{x}" for x in seen_in)).select("m"), f"seen-to-{version}")
            seen_in = [f"seen-to-{version}"]
        self._commit({"version": version, "epoch": epoch, "seen": state["seen"] + m, "parts": seen_in, "held": [int(x) for x in take + rest], "sample": kept})

    def _table(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def _pick(self, rows: DataFrame, take: np.ndarray, salt: int) -> DataFrame:
        """As many rows of each slot, the first ones by a hash that is new for every draw."""
        wanted = self.spark.createDataFrame([(i, int(c)) for i, c in enumerate(take) if c], "slot int, take bigint")
        order = Window.partitionBy("slot").orderBy(F.xxhash64("m", F.lit(self.seed + 7919 * (salt + 1))), "m")
        return rows.join(F.broadcast(wanted), "slot").withColumn("r", F.row_number().over(order)).filter("r <= take").drop("r", "take")

    def _with_data(self, batch: DataFrame, chosen: DataFrame) -> DataFrame:
        source = batch.select(*(c.alias(x) for x, c in self.columns.items()), *(F.col(c).alias(f"k_{c}") for c in self.keep))
        c, s = chosen.alias("c"), source.alias("s")
        on = reduce(Column.__and__, (F.col(f"c.{x}").eqNullSafe(F.col(f"s.{x}")) if x != "m" else F.col("c.m") == F.col("s.m") for x in "mtpo"))
        return s.join(c, on).select("c.*", *(F.col(f"s.k_{x}") for x in self.keep)).dropDuplicates(["m"])

    def sample(self) -> DataFrame | None:
        """member, piece, position and kept columns; None where nothing has arrived yet."""
        if not self.state["sample"]:
            return None
        got = self.spark.read.parquet(f"{self.path}/{self.state['sample']}")
        return got.select(*(F.col(x).alias(n) for x, n in zip("mpo", self.names, strict=True)), *(F.col(f"k_{x}").alias(x) for x in self.keep))


def sample(df: DataFrame, k: int, seed: int = 0, member: str = "member", piece: str = "piece_no", position: str = "position",
           arrived: str = "arrived_at", keep: tuple[str, ...] = ("data",), every: int = EVERY, slots: int = SLOTS) -> DataFrame:
    """member, piece, position and kept columns of the sample after all of df arrived, in batches of `every` seconds."""
    spark = df.sparkSession
    reservoir = Reservoir(spark, f"{shared_dir(spark).rstrip('/')}/typegram-{uuid.uuid4().hex}", k, seed, member, piece, position, arrived, keep, slots)
    names = list(dict.fromkeys((member, piece, position, arrived, *keep)))
    at = F.coalesce(F.floor(F.unix_micros(F.col(arrived).cast("timestamp")) / (every * 1_000_000)), F.lit(-(2**62)))
    folder = f"{shared_dir(spark).rstrip('/')}/typegram-{uuid.uuid4().hex}"
    # each task's rows of a batch are one file: a large batch keeps the tasks of the scan, and none is moved
    df.filter(F.col(member).isNotNull()).select(*names, at.alias("_batch")).write.partitionBy("_batch").parquet(folder)
    arriving = spark.read.schema(df.select(*names, at.alias("_batch")).schema).parquet(folder)
    for r in arriving.select("_batch").distinct().orderBy("_batch").toLocalIterator():  # one row per batch, as they arrived
        reservoir.update(arriving.filter(F.col("_batch") == r[0]).drop("_batch"))
    got = reservoir.sample()
    return df.select(member, piece, position, *keep).limit(0) if got is None else got
