import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["doc_frequency_topk", "running_recall_precision", "useful_productions", "interval_overlap", "import_scan_roots", "fourgram_scores", "stream_positions"])
def test_queries_match_sql(spark, name):
    import collections
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    cur = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    want = collections.Counter(tuple(clean(v) for v in r) for r in cur.fetchall())
    got = collections.Counter(tuple(clean(r[n]) for n in names) for r in entry.queries()[name](spark, SMALL).collect())
    assert got == want
