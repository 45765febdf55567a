import random
from collections import Counter

import pytest

from typegram.llm import terms


def brute(records, max_n, weights=None):
    occ, rec = Counter(), Counter()
    for r, t in enumerate(records):
        seen = set()
        for i in range(len(t or [])):
            for n in range(1, max_n + 1):
                g = t[i:i + n]
                if len(g) == n and None not in g:
                    occ[tuple(g)] += 1 if weights is None else weights[r][i]
                    seen.add(tuple(g))
        rec.update(seen)
    return {k: (v, rec[k]) for k, v in occ.items()}


def run(df, max_n, **o):
    return {tuple(r.term.split(terms.SEP)): (r.occurrences, r.records) for r in terms.frequencies(df, "terms", max_n=max_n, **o).collect()}


@pytest.mark.parametrize("max_n", [1, 3])
def test_ngrams_match_brute_force(spark, max_n):
    rng = random.Random(max_n)
    records = [[rng.choice(["a", "ab", "b", "b\x01", None]) for _ in range(rng.randint(0, 9))] for _ in range(60)] + [None, []]
    df = spark.createDataFrame([(r, 1) for r in records], "terms array<string>, n int").repartition(5)
    assert run(df, max_n) == brute(records, max_n)


def test_hot_first_term_is_salted(spark, monkeypatch):
    """The rows of a hot first term reach the stack from several tasks, apart, and add up."""
    records = [["hot", f"w{i % 7}", "hot", "cold"] for i in range(300)]
    df = spark.range(0, 300, 1, 6).selectExpr("array('hot', concat('w', id % 7), 'hot', 'cold') AS terms")
    stack = terms._stack

    def seen(max_n):
        run_ = stack(max_n)
        return lambda batches: (p.assign(records=p["records"] + 1_000_000) for p in run_(batches))

    assert run(df, 2, hot_floor=10) == brute(records, 2) == run(df, 2)
    monkeypatch.setattr(terms, "_stack", seen)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    partial = {k: v[1] // 1_000_000 for k, v in run(df, 2, hot_floor=10).items()}
    unsalted = {k: v[1] // 1_000_000 for k, v in run(df, 2).items()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert partial[("hot",)] > 1 and partial[("cold",)] == partial[("w1",)] == 1 and set(unsalted.values()) == {1}


def test_terms_with_the_separator(spark):
    records = [["a\x1fb", "c"], ["a", "b\x1fc"], ["a", "b"]]
    df = spark.createDataFrame([(r,) for r in records], "terms array<string>")
    got = {(r.term, r.n): r.occurrences for r in terms.frequencies(df, "terms", max_n=2).collect()}
    assert got[("a\x1fb", 1)] == 1 and got[("a", 1)] == 2 and got[("b", 1)] == 1 and got[("c", 1)] == 1 and got[("a\x1fb", 2)] == 1


def test_weights(spark):
    df = spark.createDataFrame([(["a", "b"], [3, None]), (["a"], [-2]), (["c"], None)], "terms array<string>, w array<long>")
    assert run(df, 1, weights="w") == {("a",): (3, 2), ("b",): (0, 1), ("c",): (1, 1)}


def test_empty(spark):
    assert terms.frequencies(spark.createDataFrame([], "terms array<string>"), "terms").isEmpty()


def test_marks(spark):
    scans = spark.createDataFrame([
        (1, 1, {"math": 9}, "2024-01-01"), (1, 2, {"math": 5, "re": 2}, "2024-01-02"), (1, 2, {"math": 5, "re": 2}, "2024-01-02"), (2, 1, {"re": 1, "os": 1}, None), (3, 1, None, None), (None, 1, {"zz": 99}, None)],
        "scan_id long, attempt int, frequencies map<string,long>, finished_at string")
    archives = spark.createDataFrame([("a", 10, "2024-01-01"), ("a", 40, "2024-02-01"), ("b", 10, "2024-01-01")], "archive string, archive_python_files long, snapshot_at string")
    got = {r.root: (r.files, r.scans, r.mark) for r in terms.marked_roots(scans, archives).collect()}
    assert got == {"math": (5, 1, "common"), "re": (3, 2, None), "os": (1, 1, "rare")}
