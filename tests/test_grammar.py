import itertools
import random

import pytest
from pyspark.sql import functions as F

from typegram.operators import closure, cnf, counts, cyk, grammar, language, prune

ROWS = lambda p: {(r.lhs, tuple(s["value"] for s in r.rhs)) for r in p.collect()}


def make(spark, rows, nonterminals=()):
    return grammar.from_rows(spark, rows, nonterminals)


def test_pruning_and_start_rules_are_idempotent(spark):
    p = make(spark, [("A", ["a"]), ("B", ["A"]), ("C", ["D"]), ("D", ["C"])])
    kept = prune.generating_only(p)
    assert ROWS(kept) == {("A", ("a",)), ("B", ("A",))}
    once = grammar.with_start(kept)
    assert ROWS(once) == ROWS(kept) | {("START", ("A",)), ("START", ("B",))}
    assert ROWS(grammar.with_start(once)) == ROWS(once)


def test_defined_and_useful(spark):
    p = make(spark, [("START", ["A"]), ("A", ["x"]), ("A", ["U"]), ("B", ["A"]), ("E", ["E"])], ["U"])
    assert ROWS(prune.defined_only(p)) == {("START", ("A",)), ("A", ("x",)), ("B", ("A",)), ("E", ("E",))}
    assert ROWS(prune.useful(p)) == {("START", ("A",)), ("A", ("x",))}


def test_stats_and_text(spark):
    p = make(spark, [("START", ["A"]), ("START", ["B"]), ("A", ["x"]), ("B", ["x"])])
    s = grammar.stats(p).first()
    assert (s.productions, s.nonterminals, s.terminals, s.grammar_symbols) == (4, 3, 1, 8)
    empty = grammar.stats(spark.createDataFrame([], grammar.SCHEMA)).first()
    assert (empty.productions, empty.nonterminals, empty.grammar_symbols) == (0, 1, 0)
    assert {r.line for r in grammar.text_lines(p).collect()} == {"START -> A", "START -> B", "A -> x", "B -> x"}


def test_empty_productions(spark):
    p = make(spark, [("START", []), ("START", ["a"])])
    assert ROWS(cnf.to_cnf(p)) == {("START", ("a",))}
    with pytest.raises(ValueError, match="empty"):
        cnf.to_cnf(p, reject_empty=True)


def test_cnf_shape(spark):
    p = grammar.with_start(make(spark, [("B", ["b"]), ("A", ["B"]), ("Expr", ["f", "A", ")"])]))
    got = cnf.to_cnf(p)
    assert cnf.shape_violations(got).isEmpty()
    assert "START" in {r.lhs for r in got.collect()}


def chain(n):
    return [(f"U{i}", [f"U{i + 1}"]) for i in range(n)] + [(f"U{n}", ["tail"]), ("START", ["U0"])]


def lang(spark, rows):
    p = cnf.to_cnf(make(spark, rows))
    return language.Language([(a, list(b)) for a, b in ROWS(p)])


@pytest.mark.parametrize(("rows", "length", "words"), [
    ([("START", ["A"]), ("START", ["B"]), ("A", ["x"]), ("B", ["x"])], 1, [["x"]]),
    (chain(100), 1, [["tail"]]),
    ([("START", ["A"]), ("START", ["B"]), ("A", ["C"]), ("B", ["C"]), ("C", ["x"])], 1, [["x"]]),
    ([("START", ["A"]), ("A", ["B"]), ("B", ["A"]), ("B", ["cycle"])], 1, [["cycle"]]),
    ([("START", ["C", "C"]), ("C", ["a"]), ("C", ["b"])], 2, [["a", "a"], ["a", "b"], ["b", "a"], ["b", "b"]]),
    ([("START", ["a"]), ("START", ["START", "START"])], 4, [["a"] * 4]),
])
def test_languages(spark, rows, length, words):
    x = lang(spark, rows)
    assert x.size(length) == len(words)
    assert list(x.words(length)) == words
    for i, w in enumerate(words):
        assert x.rank(w) == i and x.unrank(length, i) == w
    with pytest.raises(IndexError):
        x.unrank(length, len(words))


def test_long_unit_chain_closure(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "src int, dst int")
    assert closure.closure(edges).count() == 101 * 102 // 2


def test_infinite_language_and_rank(spark):
    x = lang(spark, [("START", ["C"]), ("START", ["START", "C"]), ("C", ["a"]), ("C", ["b"])])
    w = x.shortlex_unrank(999_999, 25)
    assert len(w) == 19 and x.shortlex_rank(w) == 999_999
    p = cnf.to_cnf(make(spark, [("START", ["C"]), ("START", ["START", "C"]), ("C", ["a"])]))
    assert counts.longest_word(p) is None
    assert counts.longest_word(cnf.to_cnf(make(spark, [("START", ["C", "D"]), ("D", ["C", "C"]), ("C", ["a"])]))) == 3
    assert counts.longest_word(spark.createDataFrame([], grammar.SCHEMA)) == 0


def test_ambiguity_counts_derivations_not_words(spark):
    rows = [("START", ["A", "Z"]), ("START", ["B", "Z"]), ("START", ["C", "Z"]), ("A", ["x"]), ("B", ["x"]), ("C", ["y"]), ("Z", ["z"])]
    p = cnf.to_cnf(make(spark, rows))
    words = spark.createDataFrame([("xz", 0, "x"), ("xz", 1, "z"), ("yz", 0, "y"), ("yz", 1, "z"), ("zz", 0, "z"), ("zz", 1, "z")], "word_id string, pos int, token string")
    got = {r.word_id: int(r.parses) for r in cyk.parse_counts(words, p).collect()}
    assert got == {"xz": 2, "yz": 1, "zz": 0}
    inside = {(r.symbol, r.length): int(r.derivations) for r in counts.inside_counts(p, 2).collect()}
    assert inside["START", 2] == 3 and lang(spark, rows).size(2) == 2


def test_random_grammars_agree_with_brute_force(spark):
    rng = random.Random(20)
    for _ in range(2):
        names = [f"N{i}" for i in range(4)]
        rows = [("START", ["N0"])]
        for n in names:
            rows += [(n, [rng.choice("ab")])] if rng.random() < 0.8 else []
            rows += [(n, [rng.choice(names)])] if rng.random() < 0.3 else []
            rows += [(n, [rng.choice(names), rng.choice(names)]) for _ in range(rng.randint(0, 2))]
        p = make(spark, rows, names)
        normal = cnf.to_cnf(p)
        all_words = ["".join(w) for n in (1, 2, 3) for w in itertools.product("ab", repeat=n)]
        rules = {}
        for a, b in rows:
            rules.setdefault(a, set()).add(tuple(b))

        def derive(symbols, limit, depth=0):
            if len(symbols) > limit or depth > 12:
                return set()
            for i, s in enumerate(symbols):
                if s in rules or s in names:
                    out = set()
                    for r in rules.get(s, ()):
                        out |= derive((*symbols[:i], *r, *symbols[i + 1:]), limit, depth + 1)
                    return out
            return {"".join(symbols)}

        truth = derive(("START",), 3)
        x = language.Language([(a, list(b)) for a, b in ROWS(normal)])
        assert {w for w in all_words if x.contains(list(w))} == {w for w in truth if len(w) <= 3}
        df = spark.createDataFrame([(w, i, c) for w in all_words for i, c in enumerate(w)], "word_id string, pos int, token string")
        assert {r.word_id for r in cyk.recognised(df, normal).filter("recognized").collect()} == {w for w in truth if len(w) <= 3}


def test_components_order_and_downward(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 5)], "src int, dst int")
    assert {(r.node, r.component) for r in closure.components(e).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)}
    assert {(r.node, r.level) for r in closure.longest_paths(closure.condensed(e)).collect()} == {(1, 0), (3, 1)}
    down = closure.downward(e, spark.createDataFrame([(3,)], "node int"))
    assert {(r.src, r.dst) for r in down.collect()} == {(3, 4), (4, 3)}
    assert closure.reachable(e, spark.createDataFrame([], "node int")).isEmpty()


def test_shortest_witness(spark):
    p = cnf.binarised(make(spark, [("START", ["A", "B"]), ("A", ["b"]), ("A", ["a"]), ("B", ["A", "A"]), ("B", ["B"]), ("X", ["X"])]))
    got = {r.symbol: r.word for r in counts.shortest_witness(p).collect()}
    assert got["START"] == ["a", "a", "a"] and got["B"] == ["a", "a"] and "X" not in got


def test_state_limit(spark):
    x = language.Language([("START", ["C", "C"]), ("C", ["a"])], max_states=1)
    with pytest.raises(language.StateLimit):
        x.size(2)


def test_statement_root(spark):
    got = ROWS(grammar.with_statement_root(make(spark, [("A", ["x"])])))
    assert got == {("A", ("x",)), ("STMT", ("A", ";")), ("START", ("STMT",))}
    assert F.col("x") is not None
