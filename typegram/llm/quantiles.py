"""Percentiles per group from dyadic count sketches.

A value is encoded as the leading BITS bits of its order-preserving bit pattern, so equal codes differ by a relative
2**-(BITS - 12) at most. For every binary resolution of the codes whose nodes are more than a sketch has counters there is
one signed sketch of DEPTH rows and WIDTH counters; the coarser ones are plain counters, one per node, whatever the data.
Every task sketches its own rows and nothing else is shuffled. Sketches add up: parts of one day, days of one year, or a
deletion with negative weights. Ranks are inverted by descending the resolutions from the coarsest.

A sketch is a table of rows that add up. As sketching is linear, a row may hold counters, or updates (codes and weights)
that are still to be put into counters, where these take less room; every percentile is read from counters alone.

Stated error: the returned value's rank is within RANK_ERROR * n of the wanted rank with high probability, and the value
is at most a relative VALUE_ERROR below a value of that rank.

Defined cases: NULL and NaN are no values, -0.0 is 0.0, infinities are values; NULL group columns form a group; groups
without values and empty tables give no rows; ties count each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typegram.session import written

BITS, DEPTH, WIDTH = 26, 5, 4096
#: The finest resolution of plain counters.
PLAIN = (DEPTH * WIDTH).bit_length() - 1
RANK_ERROR, VALUE_ERROR = 0.01, 2.0 ** -(BITS - 12)
#: Values a task holds before it gives out what it has, codes that travel as updates, and rows of one group that are added
#: up by one task.
HELD, UPDATES, FAN_IN = 2_000_000, 1 << 15, 512
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)

_SHIFT = np.uint64(64 - BITS)
_TOP = np.uint64(1 << 63)


def encode(values: np.ndarray) -> np.ndarray:
    bits = (np.asarray(values, np.float64) + 0.0).view(np.uint64)
    ordered = np.where(bits & _TOP, ~bits, bits | _TOP)
    return (ordered >> _SHIFT).astype(np.int64)


def decode(codes: np.ndarray) -> np.ndarray:
    """The value of least magnitude with this code."""
    ordered = np.asarray(codes, np.int64).astype(np.uint64) << _SHIFT
    positive = (ordered & _TOP) > 0
    filled = ordered | ((np.uint64(1) << _SHIFT) - np.uint64(1))
    return np.where(positive, ordered ^ _TOP, ~filled).view(np.float64) + 0.0


def _mix(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + seed
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = (np.arange(BITS * DEPTH + DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1, 1)


def _cells(nodes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter among all of a level's and sign, per row of its sketch and node."""
    h = _mix(nodes[None, :], _SEEDS[level * DEPTH + 1:(level + 1) * DEPTH + 1])
    at = (h & np.uint64(WIDTH - 1)).astype(np.int64) + np.arange(0, DEPTH * WIDTH, WIDTH)[:, None]
    return at, 1 - 2 * (h >> np.uint64(63) == 0)


def _summed(nodes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes with their weights; those that cancel out go."""
    order = np.argsort(nodes, kind="stable")
    nodes, weights = nodes[order], weights[order]
    first = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1])) if len(nodes) else np.empty(0, np.int64)
    total = np.add.reduceat(weights, first) if len(first) else weights
    return nodes[first][total != 0], total[total != 0]


class Sketch:
    """Counters of all resolutions: `plain` of resolution PLAIN, whose sums are the coarser ones, and `signed` of the finer."""

    def __init__(self) -> None:
        self.plain = np.zeros(1 << PLAIN, np.int64)
        self.signed = np.zeros((BITS - PLAIN, DEPTH, WIDTH), np.int64)

    def update(self, codes: np.ndarray, weights: np.ndarray) -> Sketch:
        nodes, weights = _summed(codes, weights)
        for level in range(BITS, PLAIN, -1):
            at, sign = _cells(nodes, level)
            counters = self.signed[level - PLAIN - 1].reshape(-1)
            if at.size > counters.size:  # sums of weights below 2**53 are exact as doubles
                counters += np.bincount(at.reshape(-1), (sign * weights).reshape(-1), counters.size).astype(np.int64)
            else:
                np.add.at(counters, at, sign * weights)
            nodes, weights = _summed(nodes >> 1, weights)
        np.add.at(self.plain, nodes, weights)
        return self

    def add(self, packed: bytes) -> None:
        x = np.frombuffer(zlib.decompress(packed), "<i8")
        self.plain += x[:1 << PLAIN]
        self.signed += x[1 << PLAIN:].reshape(self.signed.shape)

    def packed(self) -> bytes:
        return zlib.compress(np.concatenate([self.plain, self.signed.reshape(-1)]).astype("<i8").tobytes(), 1)

    def invert(self, wanted: Sequence[float]) -> tuple[int, list[float | None]]:
        """n and the value at each wanted percentile: of rank ceil(p * n), at least 1."""
        n = int(self.plain.sum())
        if n <= 0:
            return n, [None] * len(wanted)
        rank = np.maximum(1.0, np.ceil(np.array(wanted, float) * n - 1e-9))
        # the plain resolutions at once: the descent through exact sums ends where the running sum reaches the rank
        below = np.cumsum(self.plain)
        node = np.searchsorted(below, rank, "left")
        here = self.plain[node].astype(float)
        rank = rank - (below[node] - here)
        for level in range(PLAIN + 1, BITS + 1):
            left, right = self._count(level, np.concatenate([node * 2, node * 2 + 1])).reshape(2, -1)
            left = np.clip(left, 0, here)
            # the halves sum up to their parent: spread what is over evenly
            left = np.where(right > 0, np.clip((left + here - np.minimum(right, here)) / 2, 0, here), left)
            down = rank > left
            rank, here, node = np.where(down, rank - left, rank), np.where(down, here - left, left), node * 2 + down
        return n, decode(node).tolist()

    def _count(self, level: int, nodes: np.ndarray) -> np.ndarray:
        at, sign = _cells(nodes, level)
        return np.median(self.signed[level - PLAIN - 1].reshape(-1)[at] * sign, axis=0)


SKETCH = "codes binary, weights binary, cells binary"


def _schema(df: DataFrame, groups: Sequence[str]) -> str:
    return ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups) + ", "


def _row(codes: np.ndarray, weights: np.ndarray, updates: int = UPDATES) -> tuple[bytes | None, bytes | None, bytes | None]:
    """Updates of distinct codes as they travel."""
    if len(codes) > updates:
        return None, None, Sketch().update(codes, weights).packed()
    return codes.astype("<i4").tobytes(), weights.astype("<i8").tobytes(), None


def _sketched(groups: list[str], weight: int, updates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        schema, size = None, 0

        def out() -> pa.RecordBatch:
            g, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(g << BITS | c, kind="stable")
            g, c = g[order], c[order]
            first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])))
            g, c, w = g[first], c[first], np.diff(np.append(first, len(g))) * weight
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            rows = [_row(c[a:b], w[a:b], updates) for a, b in zip(starts, np.append(starts[1:], len(g)), strict=True)]
            keys = list(ids)
            columns = [pa.array([keys[k][i] for k in g[starts]], schema.field(i).type) for i in range(len(groups))]
            columns += [pa.array([r[i] for r in rows], pa.binary()) for i in range(3)]
            return pa.RecordBatch.from_arrays(columns, [*groups, "codes", "weights", "cells"])

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            of = np.zeros(batch.num_rows, np.int64)
            for i in range(len(groups)):
                d = batch.column(i).dictionary_encode("encode")
                of = np.unique(of * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)
            _, first, of = np.unique(of, return_index=True, return_inverse=True)
            keys = zip(*(batch.column(i).take(pa.array(first)).to_pylist() for i in range(len(groups))), strict=True) if groups else [()]
            of_key = np.array([ids.setdefault(k, len(ids)) for k in keys], np.int64)
            held.append((of_key[of], encode(batch.column(len(groups)).to_numpy(zero_copy_only=False))))
            size += batch.num_rows
            if size > HELD:
                yield out()
                held.clear()
                size = 0
        if held:
            yield out()

    return run


def sketch(df: DataFrame, value: str, groups: Sequence[str], weight: int = 1, updates: int = UPDATES) -> DataFrame:
    """groups, codes, weights, cells: rows that add up. weight -1 makes the sketch of rows to be taken away."""
    groups = list(groups)
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*groups, F.col(value).cast("double").alias("value"))
    return rows.mapInArrow(_sketched(groups, weight, updates), _schema(df, groups) + SKETCH)


def _added(pdf: pd.DataFrame | dict[str, list]) -> tuple[np.ndarray, np.ndarray, Sketch | None]:
    """Sum of all rows: updates, and counters where any row holds them."""
    codes = [np.frombuffer(x, "<i4").astype(np.int64) for x in pdf["codes"] if x is not None]
    weights = [np.frombuffer(x, "<i8") for x in pdf["weights"] if x is not None]
    updates = _summed(np.concatenate(codes), np.concatenate(weights)) if codes else (np.empty(0, np.int64), np.empty(0, np.int64))
    cells = [x for x in pdf["cells"] if x is not None]
    if not cells:
        return *updates, None
    total = Sketch()
    for x in cells:
        total.add(x)
    return *updates, total


def _merge(key: tuple, pdf: pd.DataFrame, groups: list[str]) -> pd.DataFrame:
    codes, weights, total = _added(pdf)
    row = _row(codes, weights) if total is None else (None, None, total.update(codes, weights).packed())
    return pd.DataFrame([[*key[:len(groups)], *row]], columns=[*groups, "codes", "weights", "cells"])


def _few(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """At most about FAN_IN rows a group: those of more are first added up by several tasks."""
    rows = written(sketches.select(*groups, "codes", "weights", "cells"))
    many = rows.groupBy(*groups).agg(F.ceil(F.count("*") / FAN_IN).alias("tasks")).filter("tasks > 1")
    if many.isEmpty():
        return rows
    a, b = rows.alias("a"), many.alias("b")
    on = F.lit(True)
    for g in groups:
        on = on & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    names = [F.col(f"a.{c}") for c in rows.columns]
    spread = a.join(b, on).select(*names, F.pmod(F.monotonically_increasing_id(), "tasks").alias("task"))
    added = spread.groupBy(*groups, "task").applyInPandas(lambda key, pdf: _merge(key, pdf, groups), _schema(rows, groups) + SKETCH)
    return a.join(b, on, "left_anti").select(*rows.columns).unionByName(added)


def merged(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sum of all sketches with equal groups, one row each."""
    groups = list(groups)
    return _few(sketches, groups).groupBy(*groups).applyInPandas(lambda key, pdf: _merge(key, pdf, groups), _schema(sketches, groups) + SKETCH)


def percentiles(sketches: DataFrame, groups: Sequence[str], wanted: Sequence[float] = PERCENTILES) -> DataFrame:
    """groups, n, p, estimate, rank_error, value_error of sketches, merged or in parts; groups without values are left out."""
    groups, wanted = list(groups), [float(p) for p in wanted]

    def read(key: tuple, rows: pa.Table) -> pa.Table:
        codes, weights, total = _added({c: rows.column(c).to_pylist() for c in ("codes", "weights", "cells")})
        n, values = (total or Sketch()).update(codes, weights).invert(wanted)
        m = len(wanted) if n > 0 else 0
        columns = [pa.array([k.as_py()] * m, rows.schema.field(g).type) for g, k in zip(groups, key, strict=True)]
        columns += [pa.array([n] * m, pa.int64()), pa.array(wanted[:m], pa.float64()), pa.array(values[:m], pa.float64()),
                    pa.array([RANK_ERROR] * m, pa.float64()), pa.array([VALUE_ERROR] * m, pa.float64())]
        return pa.Table.from_arrays(columns, [*groups, "n", "p", "estimate", "rank_error", "value_error"])

    # as many tasks as there are partitions: small rows take long to read
    parts = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _few(sketches, groups).repartition(parts, *groups) if groups else _few(sketches, groups)
    return rows.groupBy(*groups).applyInArrow(read, _schema(sketches, groups) + "n bigint, p double, estimate double, rank_error double, value_error double")


def by_dimension(df: DataFrame, id_col: str, value: str, measure: str, **dimensions) -> DataFrame:
    """measure, dim, val, x: every distinct row once per dimension, once for all dimensions together (val joined by |, NULL as
    nothing) and once for all rows, ready to be sketched."""
    rows = df.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(value).cast("double").alias("x"), *(c.cast("string").alias(f"d_{d}") for d, c in dimensions.items()))
    rows = rows.filter(F.col("x").isNotNull() & ~F.isnan("x")).distinct()
    dims = F.array(F.struct(F.lit("all").alias("dim"), F.lit(None).cast("string").alias("val")),
                   F.struct(F.lit(" ".join(dimensions)).alias("dim"), F.concat_ws("|", *(F.coalesce(f"d_{d}", F.lit("")) for d in dimensions)).alias("val")),
               *(F.struct(F.lit(d).alias("dim"), F.col(f"d_{d}").alias("val")) for d in dimensions))
    return rows.select(F.lit(measure).alias("measure"), F.explode(dims).alias("g"), "x").select("measure", "g.dim", "g.val", "x")
