import random

from pyspark.sql import functions as F

from typegram.llm import copies

SCHEMA = "source_id long, data binary, url string, id string, k string"


def rows(spark, data):
    return spark.createDataFrame([(i, None if d is None else d if isinstance(d, bytes) else d.encode(), u, "x", "y") for i, d, u in data], SCHEMA)


def found(df, **o):
    return {(r.kept_id, r.copy_id) for r in copies.copies(df, **o).collect()}


def brute(data):
    """Union-find over all pairs that agree."""
    from typegram.functions.decoding import decode_source

    def url(u):
        if u is None:
            return None
        base, _, q = u.partition("?")
        return copies.letters(base) + "".join(sorted(map(copies.letters, q.split("&"))))

    ok = []
    for i, d, u in data:
        t = decode_source(None if d is None else d if isinstance(d, bytes) else d.encode())
        if i is not None and t and copies.letters(t):
            ok.append((i, copies.letters(t), copies.canonical_json(t), url(u)))
    parent = {i: i for i, *_ in ok}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    # texts join first, then urls split them
    text = {i: i for i, *_ in ok}

    def troot(i):
        while text[i] != i:
            i = text[i]
        return i

    for a in ok:
        for b in ok:
            if a[1] == b[1] or a[2] is not None and a[2] == b[2]:
                x, y = sorted((troot(a[0]), troot(b[0])))
                text[y] = x
    for a in ok:
        for b in ok:
            if troot(a[0]) == troot(b[0]) and a[3] == b[3]:
                x, y = sorted((root(a[0]), root(b[0])))
                parent[y] = x
    return {(root(i), i) for i in parent if root(i) != i}


CASES = [
    (5, "A b_c!", "http://x/p?a=1&b=2"), (3, "ab c", "HTTP://X/p?b=2&a=1"), (9, "abc", "http://x/p?a=1&b=3"), (1, '{"a": 1, "b": {"c": 2, "d": 3}}', None),
    (2, '{"b": {"d": 3, "c": 2}, "a": 1}', None), (4, '"a1bc2d3', None), (6, '{"b": 1, "a": 1', None), (7, None, None), (8, "", None), (10, "--- !", None), (11, b"\xff\xfe\xfa", None),
    (12, "é1".encode("utf-16"), ""), (13, "É 1", ""), (14, "É 1", None), (None, "abc", None), (15, "x" * 200_000, "u"), (16, "X " * 200_000, "u"),
]


def test_cases_match_brute_force(spark):
    got = found(rows(spark, CASES))
    assert got == brute(CASES)
    assert (1, 2) in got and (1, 4) in got and (3, 5) in got and (12, 13) in got and (15, 16) in got


def test_random_rows_match_brute_force(spark):
    rng = random.Random(3)
    texts = ["ab c", "A,bc", '{"x": 1, "y": 2}', '{"y": 2, "x": 1}', '{"x1": "y2"}', "x1y2", "", None, "?"]
    urls = [None, "http://a?x=1&y=2", "http://a?y=2&x=1", "HTTP://A ", ""]
    data = [(i, rng.choice(texts), rng.choice(urls)) for i in range(150)]
    assert found(rows(spark, data)) == brute(data)


def test_hot_keys_take_two_levels(spark):
    df = spark.range(4000).select((F.col("id") + 1).alias("source_id"), F.when(F.col("id") < 3000, F.lit("Hot text")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).cast("binary").alias("data"),
                                  F.lit(None).cast("string").alias("url"))
    keyed = copies.keyed_records(df, "source_id", "data", "url")
    hot_sets, _, hot = copies.sets(keyed)
    assert hot.count() == 1 and hot_sets.first().copies == 3000
    got = found(df)
    assert len(got) == 2999 and {k for k, _ in got} == {1}
    assert copies.records(df).count() == 1001


def test_repeated_rows_and_empty_table(spark):
    assert found(rows(spark, [(1, "a", None)] * 3)) == set()
    empty = spark.createDataFrame([], SCHEMA)
    assert copies.copies(empty).isEmpty() and copies.records(empty).isEmpty()


def test_linked_canonical_forms(spark):
    """One spelling with two structures joins the sets of both."""
    edges = spark.createDataFrame([(b"1", b"a"), (b"1", b"b"), (b"2", b"b"), (b"2", b"c"), (b"3", b"z")], "p binary, c binary")
    got = {bytes(r.p): bytes(r.label) for r in copies.canonical_of_text(edges).collect()}
    assert got == {b"1": b"a", b"2": b"a", b"3": b"z"}


def test_canonical_json():
    assert copies.canonical_json('{"b": [1, {"z": 1, "y": 2}], "a": "X\\n"}') == "axnb1y2z1"
    assert copies.canonical_json("{bad}") is None and copies.canonical_json("NaN") is None and copies.canonical_json("[2, 1]") == "21"


def test_deep_and_long_json_keeps_the_free_order_of_fields():
    digits = "7" * 5000
    assert copies.canonical_json('{"a": %s, "b": 1}' % digits) == copies.canonical_json('{"b": 1, "a": %s}' % digits) is not None
    deep = "[" * 12_000 + '{"a": 1, "b": 2}' + "]" * 12_000
    assert copies.canonical_json(deep) == copies.canonical_json(deep.replace('"a": 1, "b": 2', '"b": 2, "a": 1')) == "a1b2"
    assert copies.canonical_json("[" * 12_000) is None and copies.canonical_json('{"a": NaN}') is None
