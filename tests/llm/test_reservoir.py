import numpy as np
import pytest
from pyspark.sql import functions as F

from typegram.llm import reservoir

SCHEMA = "piece_no long, position int, member string, data binary, arrived_at timestamp, m string, slot int"


def frame(spark, rows):
    df = spark.createDataFrame([(p, o, m, None if m is None else m.encode(), t, "", 0) for p, o, m, t in rows], "piece_no long, position int, member string, data binary, t long, m string, slot int")
    return df.withColumn("arrived_at", F.timestamp_seconds("t")).drop("t").select("piece_no", "position", "member", "data", "arrived_at", "m", "slot")


def pieces(n, repeats=3):
    rows = [(1 + i // 20, i % 20, f"m{i}", 100 + i // 20) for i in range(n)]
    return rows + [(500 + k, i, f"m{i}", 900) for k in range(repeats) for i in range(0, n, 5)] + [(1, 0, "m0", 100), (7, 3, None, 50)]


def test_size_and_distinct_members(spark):
    got = reservoir.sample(frame(spark, pieces(200)), 50, seed=1).collect()
    assert len(got) == 50 == len({r.member for r in got})
    assert all(r.data == r.member.encode() for r in got)
    assert {r.piece_no for r in got} <= set(range(1, 11))  # first arrivals
    again = reservoir.sample(frame(spark, pieces(200)).repartition(7), 50, seed=1).collect()
    assert {r.member for r in got} == {r.member for r in again}


def test_small_empty_and_zero(spark):
    df = frame(spark, pieces(20))
    assert reservoir.sample(df, 100).count() == 20 and reservoir.sample(df, 0).isEmpty()
    assert reservoir.sample(frame(spark, [(1, 1, None, 1)]), 5).isEmpty()
    assert reservoir.sample(spark.createDataFrame([], SCHEMA), 5).isEmpty()
    assert reservoir.sample(frame(spark, [(1, 1, "a", None), (2, 1, "b", 5)]), 5).count() == 2


def test_inclusion_is_uniform_over_repeats(spark):
    df = frame(spark, pieces(40, repeats=6)).cache()
    hits = {f"m{i}": 0 for i in range(40)}
    for s in range(8):
        for r in reservoir.sample(df, 20, seed=s, every=500, slots=4).collect():
            hits[r.member] += 1
    often = np.mean([hits[f"m{i}"] for i in range(0, 40, 5)])
    rest = np.mean([hits[f"m{i}"] for i in range(40) if i % 5])
    assert sum(hits.values()) == 160 and abs(often - rest) < 2.2


@pytest.mark.parametrize("size", [10**9, 10**10, 10**12, 10**14, 10**17])
def test_huge_hypergeometric(size):
    rng = np.random.default_rng(0)
    got = [reservoir.hypergeometric(rng, 3 * size, 7 * size, 1000) for _ in range(400)]
    assert abs(np.mean(got) - 300) < 4 and 12.7 < np.std(got) < 16.3
    assert reservoir.hypergeometric(rng, 5, 0, 9) == 5 and reservoir.hypergeometric(rng, 0, 5, 3) == 0


def test_huge_hypergeometric_near_its_ends():
    rng = np.random.default_rng(1)
    few = [reservoir.hypergeometric(rng, 10**9, 10**15, 10**6) for _ in range(400)]
    assert abs(np.mean(few) - 1) < 0.2 and abs(np.var(few) - 1) < 0.3
    all_but = [reservoir.hypergeometric(rng, 10**10, 5, 10**10) for _ in range(50)]
    assert set(all_but) <= {10**10 - 5 + i for i in range(6)}


def batches(spark):
    return [frame(spark, [(a, i, f"m{i}", a) for i in range(a, a + 30)] + [(a, 99, "m0", a)]) for a in range(0, 90, 30)]


def test_incremental_and_restart(spark, tmp_path):
    r = reservoir.Reservoir(spark, str(tmp_path), 30, seed=2)
    for e, b in enumerate(batches(spark)):
        r.update(b, e)
        r = reservoir.Reservoir(spark, str(tmp_path), 30, seed=2)  # as after a crash
        before = sorted(x.member for x in r.sample().collect())
        r.update(b, e)  # the batch comes again
        assert sorted(x.member for x in r.sample().collect()) == before and r.seen == 30 * (e + 1)
    assert len(before) == 30 == len(set(before)) and len({int(m[1:]) // 30 for m in before}) == 3


def test_a_batch_that_broke_off_is_done_anew(spark, tmp_path, monkeypatch):
    first, second, _ = batches(spark)
    r = reservoir.Reservoir(spark, str(tmp_path), 30, seed=2)
    r.update(first, 0)

    def lost(state):
        raise OSError("lost")

    monkeypatch.setattr(r, "_commit", lost)
    with pytest.raises(OSError, match="lost"):
        r.update(second, 1)
    r = reservoir.Reservoir(spark, str(tmp_path), 30, seed=2)
    assert r.seen == 30
    r.update(second, 1)
    once = reservoir.Reservoir(spark, f"{tmp_path}/once", 30, seed=2)
    for e, b in enumerate((first, second)):
        once.update(b, e)
    assert {x.member for x in r.sample().collect()} == {x.member for x in once.sample().collect()} and r.seen == 60


def test_stream(spark, tmp_path):
    """A stream of files that breaks off after the first batch and goes on with a new reservoir."""
    for i, b in enumerate(batches(spark)):
        b.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []

    def step(df, epoch):
        if len(seen) == 1:
            seen.append("broken")
            raise RuntimeError("broken")
        reservoir.Reservoir(spark, f"{tmp_path}/state", 30).update(df, epoch)
        seen.append(epoch)

    for _ in range(2):
        q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception as e:  # noqa: BLE001 - the planned failure
            assert "broken" in str(e)
    r = reservoir.Reservoir(spark, f"{tmp_path}/state", 30)
    assert seen == [0, "broken", 1, 2] and r.seen == 90 and r.sample().count() == 30


@pytest.mark.parametrize("n", [0, 3, 10])
def test_spread(n):
    got = reservoir.spread(np.random.default_rng(1), np.array([4, 0, 6]), n)
    assert got.sum() == n and (got <= [4, 0, 6]).all()
