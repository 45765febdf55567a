import random
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest

from typegram.llm import encoding, leaks, posts, subjects

ENC = encoding.encoder(encoding.TOKENIZERS, encoding.VOCABULARY)


@lru_cache
def brute_tokenizer():
    import tokenizers

    t = tokenizers.Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def brute_bpe(text):
    return brute_tokenizer().encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "Hello  world\n\n it's fine", "<|endoftext|> x", "é日本語 12345 !!??", "z" * 500, " " * 300 + "x", "\n" * 40, "a" * 90 + "'s" + "b" * 90, "-" * 200 + "'ll go", "😀" * 50]


@pytest.mark.parametrize("leaf", [1, 2, 5, 16, 64, 1 << 16])
def test_trees_are_exact(leaf):
    rng = random.Random(leaf)
    signs = ["a", "the ", "!!", "'s", "'", "'r", "e", "v", "l", " ", "  ", "\n", "é", "日", "12", "\t"]
    texts = TEXTS + ["".join(rng.choice([*signs, "zz" * rng.randint(1, 20), "-" * rng.randint(1, 20)]) for _ in range(rng.randint(0, 50))) for _ in range(150)]
    for t in texts:
        assert ENC.concatenated([ENC.tree(t, leaf)], leaf) == ENC.plain.encode_ordinary(t) == brute_bpe(t), t


def test_long_texts_are_exact():
    """Joined hundreds of times at the production leaf: prose, one word of 200,000 letters, blanks, signs, and all of them."""
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice("etaoinshrdlu'é") for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    texts = [prose, "xyz" * 70_000, " " * 50_000 + "x", "-=" * 30_000, "".join(rng.choice("ab") for _ in range(100_000)), "日本" * 20_000]
    for t in [*texts, "".join(texts)]:
        assert ENC.concatenated([ENC.tree(t, encoding.LEAF)], encoding.LEAF) == ENC.plain.encode_ordinary(t)


@pytest.mark.parametrize("piece", [16, 100, 1 << 16])
def test_encoded(spark, piece):
    df = spark.createDataFrame([*((i, t, None) for i, t in enumerate(TEXTS)), (98, None, "x"), (99, "dup", None), (99, "dup", None)], "doc_id long, text string, ids string")
    rows = encoding.encoded(df, leaf=8, piece=piece).collect()
    got = {r.doc_id: r.ids for r in rows}
    assert len(rows) == len(TEXTS) + 3 and got[98] == [] and got[0] == []
    assert all(got[i] == ENC.plain.encode_ordinary(t) for i, t in enumerate(TEXTS))
    assert encoding.encoded(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_clean():
    assert posts.words("I&#39;d <b>go</b> ho​me<br>now [url=http://x.y/z]here[/url]&nbsp;or &amp; not") == ["i", "d", "go", "home", "now", "here", "or", "not"]
    assert posts.words("a < b and c > d") == ["a", "b", "and", "c", "d"] and posts.words("") == []


def test_own():
    t = '[quote="a"][quote=b]deep one[/quote] mid[/quote]\nOn day 3 x.y wrote:\n> quoted\n: prefixed\nMine first. Mine second!\n-- \nname\nsig'
    assert posts.own(t).split() == ["Mine", "first.", "Mine", "second!"]
    assert posts.own("<blockquote><cite>n</cite>q<blockquote>cut</blockquote>own<hr><small>n, sig</small>").strip() == "own"
    assert "".join(posts.own("[quote]never closed")).strip() == "" and posts.own("x[/quote] y").split() == ["x", "y"]
    assert posts.sentences("Again... and on. So? Yes\nnew …") and len(posts.sentences("Again... and on. So? Yes\nnew")) == 4


ITEMS = [(1, "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"), (2, "read this with care and choose the one best answer now: zulu yankee xray"),
         (3, "read this with care and choose the one best answer now: whiskey victor"), (4, None), (5, "too short"), (6, ""), (7, "same words in two items make ten of them here ok"), (8, "same words in two items make ten of them here ok")]


def brute_leaks(docs):
    items = {i: posts.words(t or "") for i, t in ITEMS}
    out = set()
    for d, t in docs:
        w = posts.words(t or "")
        for i, y in items.items():
            for a in range(len(w)):
                for n in range(10, len(w) - a + 1):
                    s = w[a:a + n]
                    inside = lambda z: any(z[k:k + n] == s for k in range(len(z) - n + 1))  # noqa: B023, E731
                    if inside(y) and not any(inside(z) for j, z in items.items() if j != i):
                        out.add((d, i))
    return out


def test_leaks(spark):
    filler = "some forum words about nothing in particular "
    docs = [(1, f"{filler} > alpha <i>bravo</i> charlie delta\n> echo foxtrot golf hotel indi​a juliet {filler}"), (2, "alpha bravo charlie delta echo foxtrot golf hotel india"), (3, None), (4, ""),
            (5, "Read this with care and choose the one best answer now"), (6, "care and choose the one best answer now zulu yankee"), (7, ITEMS[6][1]), (8, filler * 300 + ITEMS[0][1]), (9, "with care and choose the one best answer now whiskey"),
            (9, "with care and choose the one best answer now whiskey"), (10, "bravo charlie delta echo foxtrot golf hotel india juliet kilo lima and choose the one best answer now zulu yankee xray read this with")]
    df = spark.createDataFrame([(*d, "", "") for d in docs], "doc_id long, text string, item string, id string")
    items = spark.createDataFrame([(*i, "b", "test") for i in ITEMS], "item_id long, text string, benchmark string, split string")
    rows = [(r.doc_id, r.item_id) for r in leaks.leaks(df, items).collect()]
    assert set(rows) == brute_leaks(docs) and len(rows) == len(set(rows)) and {(1, 1), (6, 2), (8, 1), (9, 3)} <= set(rows)
    assert leaks.report(df, items).first().leaked_items == 3 and leaks.report(df, items).first().leaked_questions == 0
    assert leaks.leaks(df.limit(0), items).isEmpty() and leaks.leaks(df, items.limit(0)).isEmpty()


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(1, ITEMS[0][1]), (2, ITEMS[1][1]), (3, ITEMS[6][1])], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    once = {tuple(r) for r in leaks.leaks(df, items).collect()}
    monkeypatch.setattr(leaks, "ITEMS", 3)
    assert {tuple(r) for r in leaks.leaks(df, items).collect()} == once == {(1, 1), (2, 2)}


@pytest.mark.parametrize("items", [1, 60, 400])
def test_retrieval_equals_exhaustive_scoring(items):
    rng = random.Random(items)
    vocab = [f"v{i}" for i in range(120)]
    skewed = lambda: vocab[min(119, int(rng.expovariate(0.05)))]
    index = leaks.Index([(i, " ".join(skewed() for _ in range(40))) for i in range(items)])
    passages = [sorted({index.vocabulary[w] for w in rng.sample(vocab, rng.randint(1, 60)) if w in index.vocabulary}) for _ in range(150)]
    want = set()
    for p, terms in enumerate(passages):
        score = {}
        for t, d, v in zip(index.p_term, index.p_item, index.p_impact, strict=True):
            if t in terms:
                score[d] = score.get(d, 0) + v
        want |= {(p, d) for d, s in score.items() if s >= 1}
    got = index.retrieve(np.array([p for p, x in enumerate(passages) for _ in x]), np.array([t for x in passages for t in x]))
    assert set(zip(*map(np.ndarray.tolist, got), strict=True)) == want and (items == 1 or want)


def test_question_words():
    index = leaks.Index([(1, "one two three four five six seven. Which eight nine ten eleven twelve?"), (2, "a b c d e f g h i j k")])
    (m,) = index.matches([words_ := posts.words("x three four five six seven which eight nine ten eleven y")]).itertuples()
    assert (m.item, m.start, m.end, m.question_words) == (1, 1, 11, 5) and len(words_) == 12


SEEDS = [(i, f"The {a} needs a {b}. After the {b} came the {a}. We like {c} and {a}.", s) for i, (a, b, c, s) in enumerate(
    [("oven", "whisk", "dough", "food"), ("dough", "oven", "broth", "food"), ("whisk", "broth", "oven", "food"), ("goal", "pitch", "striker", "sport"), ("striker", "goal", "relay", "sport"), ("relay", "pitch", "goal", "sport")] * 2)]


def test_subjects(spark):
    docs = [(1, "The oven beats the whisk. My dough wants an oven.", "b"), (2, "[quote]The oven beats the whisk. My dough wants an oven.[/quote] nothing here", "b"), (3, "It felt like an oven today. Fine.", "b"),
            (4, "The goal needs a striker. A pitch and a relay. The oven has a whisk. Broth and dough again.", None), (5, None, "b"), (6, "", "b"), (7, "   ", "b"), (8, "Plain words only.", "b"),
            (9, "The ovne beats the whsik. My dough wants an oven.", "b"), (10, "The oven beats the whisk. " * 3000, "b"), (None, "The oven beats the whisk. My dough wants an oven.", "b"), (1, "The oven beats the whisk. My dough wants an oven.", "b")]
    docs += [(100 + i, "The oven beats the whisk, not bread. My dough wants a broth or two." if i % 2 else "Goal and pitch of old. Striker and relay, then goal.", "b") for i in range(30)] + [(200 + i, "Nothing at all to say here. Same again.", "c") for i in range(60)]
    df = spark.createDataFrame([(*d, "") for d in docs], "doc_id long, text string, source string, subject string")
    seeds = spark.createDataFrame(SEEDS, "seed_id long, text string, subject string")
    rows = [(r.doc_id, r.subject) for r in subjects.assigned(df, seeds).collect()]
    got = {k: s for k, s in rows if k < 100}
    assert len(rows) == len(set(rows))
    assert {(1, "food"), (4, "food"), (4, "sport"), (9, "food"), (10, "food")} == {r for r in rows if r[0] < 100}, got
    assert sum(1 for r in rows if 100 <= r[0] < 200) == 30 and not any(r[0] >= 200 for r in rows)
    assert subjects.assigned(df.limit(0), seeds).isEmpty() and subjects.assigned(df, seeds.limit(0)).isEmpty()
    assert subjects.composition(df, seeds).filter("subject = 'sport'").count() >= 1


def test_held_out_seeds_among_the_posts(spark):
    """The whole operator: precision and recall of at least 0.9 on a third of the labelled texts, posted among all others."""
    path = "/root/testdata/sf0.01"
    s = pd.read_parquet(f"{path}/subject_seed.parquet")
    held = s.seed_id.drop_duplicates().sample(frac=1 / 3, random_state=0)
    posts_ = s[s.seed_id.isin(held)].drop_duplicates("seed_id")
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "source").unionByName(
        spark.createDataFrame([(-1 - int(i), t, None) for i, t in zip(posts_.seed_id, posts_.text, strict=True)], "doc_id long, text string, source string"))
    seeds = spark.createDataFrame(s[~s.seed_id.isin(held)][["seed_id", "text", "subject"]])
    found = subjects.assigned(docs, seeds, spark.read.parquet(f"{path}/eval_item.parquet")).filter("doc_id < 0").collect()
    got = {(-1 - r.doc_id, r.subject) for r in found}
    want = {(i, x) for i, x in zip(s.seed_id, s.subject, strict=True) if i in set(held)}
    print(len(got & want) / len(want), len(got & want) / len(got))
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_lexicon_keeps_rare_words_of_a_large_vocabulary(spark):
    """52,500 words beside words of the seeds, the rarest 2,000 of them as sure as the others."""
    names = ["q" + "".join(chr(97 + i // 25**k % 25).replace("s", "z") for k in range(4)) for i in range(52_500)]
    own = [[["oven", "dough", *names[i:i + 25]]] for i in range(0, len(names), 25) for _ in range(4 if i < 2000 else 5)]
    read = spark.createDataFrame([(x,) for x in own], "own array<array<string>>")
    lexicon = subjects.fit_lexicon(read, [(t, frozenset([s])) for _, t, s in SEEDS], frozenset(), rounds=1)
    assert sum(lexicon.get(w) == ("food",) for w in names[:2000]) == 2000
    assert sum(w in lexicon for w in names) == len(names)
