import random

import numpy as np
import pandas as pd

from typegram.llm import overlap

SCHEMA = "source_id long, data binary, split string, id string, side string, words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if t is None else t.encode(), s, "", "", "") for i, t, s in rows], SCHEMA)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute(rows):
    import typegram.llm.copies as c

    out = set()
    side = lambda s: {"train": 1, "test": 2, "valid": 2}.get((s or "").strip().lower())
    rows = [(i, t, side(s)) for i, t, s in rows if t and side(s) and c.letters(t)]
    for i, t, s in rows:
        for j, u, v in rows:
            if s == 2 and v == 1:
                a, b = overlap.words_of(t), overlap.words_of(u)
                same = c.letters(t) == c.letters(u) or c.canonical_json(t) is not None and c.canonical_json(t) == c.canonical_json(u)
                if same or lcs(a, b) * 5 >= 4 * max(len(a), len(b)):
                    out.add((min(i, j), max(i, j)))
    return out


def found(df, **o):
    return {(r.id_a, r.id_b) for r in overlap.found(df, **o).collect()}


def corpus(seed, n=40, families=8):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows, k = [], 0
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 90))]
        for _ in range(n // families):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                p = rng.randrange(len(t))
                t[p:p + 1] = rng.choice([[], [rng.choice(vocab)], [t[p], rng.choice(vocab)]])
            k += 1
            rows.append((k, " ".join(t), rng.choice(["train", "Train ", "test", "valid", None, "TEST"])))
    return rows


def test_random_families_match_brute_force(spark):
    rows = corpus(1) + [(900, None, "train"), (901, "", "test"), (902, "--", "test"), (903, "--", "train"), (904, "only", "test"), (905, "ONLY!", "train"),
                        (906, '{"a": 1, "b": 2}', "test"), (907, '{"b": 2, "a": 1}', "train"), (908, "foo_bar", "valid"), (909, "foobar", "train"), (910, "x", "other")]
    got = found(frame(spark, rows))
    assert got == brute(rows)
    assert {(904, 905), (906, 907), (908, 909)} <= got


def test_short_texts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        t = list("abcdefghij")[:rng.randint(4, 10)]
        t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((i, " ".join(t), rng.choice(["train", "test"])))
    assert found(frame(spark, rows)) == brute(rows)


def test_intervals_above_the_cap_are_joined_in_full(spark):
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join([*base, f"u{i}"]), "train" if i % 2 else "test") for i in range(40)]
    assert found(frame(spark, rows), cap=4) == brute(rows) and len(brute(rows)) == 400


def test_long_text_and_empty_table(spark):
    long = " ".join(f"n{i}" for i in range(30_000))
    rows = [(1, long, "train"), (2, long + " tail", "valid"), (3, long[: len(long) // 2], "test")]
    assert found(frame(spark, rows)) == {(1, 2)}
    assert overlap.found(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_report(spark):
    df = frame(spark, [(1, "a b c d e f g h", "train"), (2, "a b c d e f g h", "test"), (3, "q r s", "test")]).withColumnRenamed("words", "dataset")
    r = overlap.report(df).first()
    assert (r.split, r.rows, r.leaked_rows, r.pairs) == ("test", 2, 1, 1)


def test_common_words():
    import numpy as np

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert overlap.common_words(np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()) == lcs(a, b)


def test_scattered_edits_at_the_border(spark):
    """Every fifth word differs, so no run has five words; still nothing is missed."""
    rng = random.Random(1)
    rows = []
    for k, n in enumerate([20, 35, 50, 64, 65, 100, 200] * 3):
        t = [f"v{rng.randrange(900)}" for _ in range(n)]
        u = [f"x{k}y{i}" if i % 5 == 2 and i < n - n % 5 else w for i, w in enumerate(t)]
        rows += [(2 * k, " ".join(t), "test"), (2 * k + 1, " ".join(u), "train")]
    assert found(frame(spark, rows)) == {(2 * k, 2 * k + 1) for k in range(21)}


def test_profiles_bound_the_overlap():
    import numpy as np
    from collections import Counter

    rng = random.Random(8)
    texts = [[rng.randrange(40) for _ in range(rng.randint(1, 400))] for _ in range(40)]
    a = np.array([w for t in texts for w in t], "<u4")
    doc = np.repeat(np.arange(40), [len(t) for t in texts])
    p = overlap.profiles(a, doc, 40)
    for i in range(40):
        for j in range(40):
            common = sum((Counter(texts[i]) & Counter(texts[j])).values())
            assert overlap.may_overlap(p[i:i + 1], p[j:j + 1], np.array([common]))[0]
    assert not overlap.may_overlap(p[:1] * 0, p[1:2], np.array([1]))[0]


def across(rows):
    """All near pairs across the splits by the exact check alone."""
    import numpy as np

    names = overlap._Names()
    packed = [(i, np.array([names[w] for w in t.split()], "<u4").tobytes(), s) for i, t, s in rows]
    return {(min(i, j), max(i, j)) for i, a, s in packed for j, b, u in packed
            if s == "test" and u == "train" and overlap.common_words(a, b) * 5 >= 4 * (max(len(a), len(b)) // 4)}


def family(seed, size, words=120, edits=6):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for k in range(size):
        t = list(base)
        for p in rng.sample(range(words), edits):
            t[p] = f"x{k}y{p}"
        rows.append((k, " ".join(t), "train" if k % 2 else "test"))
    return rows


def test_large_family_of_near_copies_is_whole(spark):
    rows = family(3, 200)
    want = across(rows)
    assert len(want) == 100 * 100
    assert found(frame(spark, rows)) == want


def test_longer_names_and_blocks_lose_nothing(spark, monkeypatch):
    rows = corpus(4, n=48, families=4) + [(k + 1000, t, s) for k, t, s in family(5, 30, words=40, edits=3)]
    want = brute(rows)
    monkeypatch.setattr(overlap, "BLOCK", 3)
    assert found(frame(spark, rows), cap=2) == want
    monkeypatch.setattr(overlap, "WORTH", 0)
    monkeypatch.setattr(overlap, "SPREAD", 1000)
    monkeypatch.setattr(overlap, "AGAIN", -1)
    assert found(frame(spark, rows), cap=2) == want


def test_no_long_text_at_the_border_is_lost(spark):
    """Long texts of which exactly four fifths agree, edits every fifth word or at random places."""
    rng = random.Random(11)
    rows = []
    for k in range(400):
        n = (65, 65, 80, 100)[k % 4]
        t = [f"v{rng.randrange(3000)}" for _ in range(n)]
        changed = set(range(2, n, 5)) if k % 8 < 6 else set(rng.sample(range(n), n // 5))
        u = [f"x{k}y{i}" if i in changed else w for i, w in enumerate(t)]
        rows += [(2 * k, " ".join(t), "test"), (2 * k + 1, " ".join(u), "train")]
    assert found(frame(spark, rows)) == {(2 * k, 2 * k + 1) for k in range(400)}


def test_copies_do_not_split_their_near_copies(spark):
    """Copies that hold most of the table, and near copies with an edit in every run of eight words."""
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(base), "train") for i in range(12_000)]
    near = {20_000 + k: " ".join(f"x{k}y{i}" if i % 7 == k % 7 else w for i, w in enumerate(base)) for k in range(28)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        df = frame(spark, rows + [(i, t, "test") for i, t in near.items()]).coalesce(1)
        assert overlap.found(df).groupBy("id_b").count().filter("count = 12000").count() == len(near)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 4, rng.integers(2, 40)).astype("<u4") for _ in range(40)]
    a, doc = np.concatenate(texts), np.repeat(np.arange(40), [len(t) for t in texts])
    at = np.arange(len(a))
    name, next_ = a.astype(np.uint64), overlap.following(a, doc, at)
    order, lcp = overlap.suffix_order(name, next_)
    short = {int(w): int(s) for w, s in zip(a, (a.astype(np.uint64) * overlap._MIX >> np.uint64(48)).astype(np.uint16) | 1, strict=True)}
    suffix = [(int(a[i]), *(short[int(w)] for w in a[i + 1:min(i + 1 + overlap.NEXT, len(a))][doc[i + 1:min(i + 1 + overlap.NEXT, len(a))] == doc[i]])) for i in at]
    padded = [s + (0,) * (overlap.NEXT + 1 - len(s)) for s in suffix]
    assert [padded[i] for i in order] == sorted(padded)
    for k in range(1, len(order)):
        x, y = suffix[order[k - 1]], suffix[order[k]]
        assert lcp[k] == next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))


def test_coverage_is_a_common_subsequence():
    """Never more words than the longest one, and all of a text that is only cut in pieces by insertions."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        x = rng.integers(0, 12, rng.integers(2, 60)).astype("<u4")
        y = np.insert(x, rng.integers(0, len(x), 5), rng.integers(100, 200, 5)).astype("<u4") if rng.random() < 0.5 else rng.permutation(x)
        spans = [(i, j, 1) for i in range(len(x)) for j in range(len(y)) if x[i] == y[j] and rng.random() < 0.5]
        got = overlap.covered_words(x.tobytes(), y.tobytes(), spans)
        assert got <= overlap.common_words(x.tobytes(), y.tobytes()) and (got > 0) == bool(spans)
    x = np.arange(100, dtype="<u4")
    y = np.insert(x, [20, 50, 51, 80], 999).astype("<u4")
    assert overlap.covered_words(x.tobytes(), y.tobytes(), [(i, int(np.flatnonzero(y == i)[0]), 1) for i in (3, 30, 50, 60, 90)]) == 100


def test_long_lists_are_divided_and_lose_nothing():
    """Unlike texts of few words meet in long lists: far fewer pairs are looked at, and every near pair is still among them."""
    rng = random.Random(12)
    texts = []
    for k in range(2500):
        n = rng.choice([5, 400] + [60] * 60)
        texts.append([rng.randrange(40 if n < 30 else 600) for _ in range(n)])
    for t in rng.sample(texts, 300):
        texts.append([rng.randrange(600) if rng.random() < 0.12 else w for w in t])
    names = [np.array(t, "<u4") * np.uint32(2654435761) for t in texts]
    rows = pd.DataFrame({"text_key": range(len(texts)), "side": [rng.choice([1, 2, 3]) for _ in texts], "n": [len(t) for t in texts], "words": [x.tobytes() for x in names]})
    often = np.zeros(1 << overlap.COUNTERS_LOG2, np.int32)
    for part in overlap._sketched([rows]):
        for i, x in zip(part["part"], part["counts"], strict=True):
            often.reshape(16, -1)[i] += np.frombuffer(x, "<i4")
    none = {"name": np.zeros(0, np.uint64), "e": np.zeros(0, np.int64), "t": np.zeros(0, np.int64)}
    listed = pd.concat(overlap._listed(often, [], none)([rows]))

    def near(**o):
        lists = overlap.Lists({c: listed[c].to_numpy() for c in listed.columns}, **o)
        pairs = {(a, b) for x in lists.pairs() for a, b in zip(x["a"], x["b"], strict=True)}
        return lists.looked, {(a, b) for a, b in pairs if overlap.common_words(names[a].tobytes(), names[b].tobytes()) * 5 >= 4 * max(len(names[a]), len(names[b]))}

    every, want = near(worth=1e18)
    assert len(want) > 100
    for names_ in (overlap.NAMES, 500):
        looked, got = near(worth=0.5, names=names_)
        assert got == want and looked * 2 < every, (looked, every, len(got), len(want))
