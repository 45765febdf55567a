import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st

from typegram.llm import quantiles as q


@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=50))
def test_codes_keep_order_and_value(xs):
    c = q.encode(np.array(sorted(xs)))
    assert (np.diff(c) >= 0).all()
    for x, y in zip(sorted(xs), q.decode(c), strict=True):
        if math.isfinite(x) and abs(x) > 1e-300:
            assert abs(y) <= abs(x) and abs(x - y) <= abs(x) * q.VALUE_ERROR


def sketched(values):
    return q.Sketch().update(q.encode(np.asarray(values, float)), np.ones(len(values), np.int64))


@pytest.mark.parametrize("kind", ["lognormal", "spikes", "tails", "uniform", "negative"])
def test_rank_error(kind):
    rng = np.random.default_rng(4)
    n = 300_000
    x = {"lognormal": lambda: rng.lognormal(1, 2, n), "spikes": lambda: np.where(rng.random(n) < 0.4, 60.0, rng.gamma(2, 30, n)), "tails": lambda: rng.pareto(0.3, n),
         "uniform": lambda: rng.random(n), "negative": lambda: rng.normal(0, 1e-3, n)}[kind]()
    x.sort()
    got, values = sketched(x).invert([0.01, 0.25, 0.5, 0.75, 0.99])
    assert got == n
    for p, v in zip([0.01, 0.25, 0.5, 0.75, 0.99], values, strict=True):
        slack = abs(v) * q.VALUE_ERROR + 1e-300
        low, high = np.searchsorted(x, v - slack, "left"), np.searchsorted(x, v + slack, "right")
        assert max(0, low - p * n, p * n - high) <= q.RANK_ERROR * n


def test_small_groups():
    n, v = sketched([5.0, 1.0, 3.0, 2.0, 4.0]).invert([0.0, 0.2, 0.5, 1.0])
    assert n == 5 and v == [1.0, 1.0, 3.0, 5.0]


SCHEMA = "g string, x double, code long, w long"


def run(spark, rows, groups=("g",)):
    df = spark.createDataFrame([(g, x, 0, 0) for g, x in rows], SCHEMA)
    return {(r.g, r.p): (r.n, r.estimate) for r in q.percentiles(q.sketch(df, "x", groups), groups, [0.5]).collect()}


def test_nulls_nans_ties_and_groups(spark):
    nan = float("nan")
    got = run(spark, [("a", 1.0), ("a", 1.0), ("a", 9.0), ("a", None), ("a", nan), (None, 2.0), ("empty", None), ("inf", float("inf")), ("z", -0.0), ("z", 0.0)])
    assert got == {("a", 0.5): (3, 1.0), (None, 0.5): (1, 2.0), ("inf", 0.5): (1, float("inf")), ("z", 0.5): (2, 0.0)}
    assert run(spark, []) == {}


@pytest.mark.parametrize(("updates", "fan_in", "held"), [(1 << 15, 512, 2_000_000), (100, 512, 3000), (100, 2, 3000), (0, 3, 10**9)])
def test_merging_and_deletion(spark, monkeypatch, updates, fan_in, held):
    """The counters of a sum are those of the whole, however its parts were cut, packed and added up."""
    monkeypatch.setattr(q, "FAN_IN", fan_in)
    monkeypatch.setattr(q, "HELD", held)
    rng = np.random.default_rng(1)
    x = rng.lognormal(0, 1, 20_000)
    day = lambda a, w=1: q.sketch(spark.createDataFrame(pd.DataFrame({"g": "g", "x": a})).repartition(4), "x", ["g"], w, updates)

    def cells(s):
        (r,) = s.collect()
        codes, weights, total = q._added(pd.DataFrame([r.asDict()]))
        return (total or q.Sketch()).update(codes, weights)

    whole, once = cells(q.merged(day(x[:8_000]).unionByName(day(x[8_000:])), ["g"])), sketched(x)
    assert (whole.plain == once.plain).all() and (whole.signed == once.signed).all()
    n, (m,) = cells(q.merged(day(x).unionByName(day(x[:10_000], -1)), ["g"])).invert([0.5])
    assert n == 10_000 and abs(np.mean(x[10_000:] <= m) - 0.5) < q.RANK_ERROR
    gone = day(x[:100]).unionByName(day(x[:100], -1))
    assert q.percentiles(gone, ["g"]).isEmpty()


def test_several_group_columns(spark):
    df = spark.createDataFrame([(a, b, float(i)) for i, (a, b) in enumerate([("a", 1), ("a", 2), (None, 1), ("a", None), (None, None), ("a", 1)])], "a string, b long, x double")
    got = {(r.a, r.b): (r.n, r.estimate) for r in q.percentiles(q.sketch(df, "x", ["a", "b"]), ["a", "b"], [1.0]).collect()}
    assert got == {("a", 1): (2, 5.0), ("a", 2): (1, 1.0), (None, 1): (1, 2.0), ("a", None): (1, 3.0), (None, None): (1, 4.0)}


def test_repeated_rows_count_once(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 5.0, "a"), (1, 5.0, "a"), (2, 7.0, None), (None, 9.0, "a")], "id long, x double, d string")
    rows = q.by_dimension(df, "id", "x", "m", kind=F.col("d"), other=F.lit("o"))
    assert sorted((r.dim, r.val or "", r.x) for r in rows.collect()) == [("all", "", 5.0), ("all", "", 7.0), ("kind", "", 7.0), ("kind", "a", 5.0), ("kind other", "a|o", 5.0), ("kind other", "|o", 7.0), ("other", "o", 5.0), ("other", "o", 7.0)]
