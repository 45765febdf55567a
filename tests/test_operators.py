import ast

import pytest
from pyspark.sql import functions as F

from typegram.functions import scalars
from typegram.functions.decoding import decode_python, decode_source, decoded
from typegram.operators import assign, calls, diagnostics, layouts, lengths, metrics, monomorph, ngrams, ordering, pysource, relations, sampling, types
from typegram.operators.grammar import rhs_text


def test_decoding(spark):
    cases = [(b"plain", "plain"), (b"\xef\xbb\xbfmark", "mark"), ("é".encode("utf-16"), "é"), (b"# -*- coding: latin-1 -*-\n\xe9", "# -*- coding: latin-1 -*-\né"),
             (b"\xff bad", None), (b"", ""), (None, None), (b"x = 1\n# coding: latin-1\n\xe9", None), (b"# coding: nonsense\nx", None)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, data binary")
    got = {r.i: r.t for r in df.select("i", decoded(F.col("data")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases] == [decode_source(a) for a, _ in cases]
    assert decode_python("é".encode("utf-16")) is None


def test_statement_lengths_and_single_file_deviation(spark):
    df = spark.createDataFrame([(1, "One two three. Four five six seven!", "en", "a"), (2, None, "en", "a"), (3, "", None, None)], "id int, text string, lang string, repo string")
    rows = lengths.statements(df, "text", "lang", "repo", "id")
    s = lengths.language_summary(rows).collect()
    assert len(s) == 1 and s[0].sd_file_mean_tokens == 0.0 and s[0].mean_file_mean_tokens == 3.5
    assert lengths.file_summary(rows).first().max_tokens == 4


def test_running_and_index_match_plain_order(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k int, v int")
    got = {r.k: (r.s, r["index"]) for r in ordering.indexed(ordering.running(df, ["k"], {"s": F.col("v").cast("long")}), ["k"]).collect()}
    total = 0
    for i, (k, v) in enumerate(sorted((i * 37 % 101, i) for i in range(101))):
        total += v
        assert got[k] == (total, i)


def test_samples(spark):
    df = spark.createDataFrame([(f"m{i}",) for i in range(50)] * 2 + [(None,)], "member string")
    got = [r.member for r in sampling.bottom_k(df, "member", 7, 5).collect()]
    import hashlib

    assert got == sorted({f"m{i}" for i in range(50)}, key=lambda m: hashlib.sha256(f"7\0{m}".encode()).hexdigest())[:5]
    assert sampling.quota(10, 3) == [4, 3, 3] and sampling.quota(2, 2) == [1, 1] and sampling.quota(0, 1) == [0]
    counts = spark.createDataFrame([("sys", 5), ("math", 5), ("__future__", 9), ("re", 1)], "name string, files long")
    assert [r.name for r in sampling.top_with_minimum(counts, "name", "files", 2, 2).orderBy(F.desc("files"), "name").collect()] == ["math", "sys"]
    assert {r.name for r in sampling.top_with_minimum(counts, "name", "files", 1, 2, explicit=["re"]).collect()} == {"math", "re"}
    acc = sampling.until_quota(spark.createDataFrame([(i, i % 2 == 0) for i in range(9)], "i int, ok boolean"), ["i"], F.col("ok"), 2)
    assert sorted(r.i for r in acc.collect()) == [0, 1, 2]


def test_metrics(spark):
    r = spark.createDataFrame([("a", 0, 0, 0, 0, 0)], "g string, recognized long, evaluated long, precision_accepted long, precision_checked long, precision_requested long")
    assert metrics.run_ratios(r, "g").first().recall is None
    assert spark.range(1).select(metrics.percent_text(F.lit(None).cast("double"))).first()[0] == "n/a"
    f = metrics.funnel(spark.range(10), even=F.col("id") % 2 == 0, big=F.col("id") > 5).orderBy("step").collect()
    assert [(x.stage, x.rows) for x in f] == [("all", 10), ("even", 5), ("big", 2)]
    assert metrics.log_edges(4, 4, 1) == pytest.approx([2, 8])
    h = metrics.log_histogram(spark.createDataFrame([(1.0,), (10.0,), (100.0,), (0.0,)], "x double"), "x", 2)
    assert {(x.bin, x.n) for x in h.collect()} == {(0, 1), (1, 2)}
    m = spark.createDataFrame([({"a": 1, "b": 2},), ({"a": 3},), (None,)], "c map<string,long>")
    assert metrics.as_map(metrics.merged_counters(m, "c")).first().counters == {"a": 4, "b": 2}
    t = metrics.rank_with_ties(spark.createDataFrame([(1, 5), (2, 5), (3, 9)], "i int, s int"), [], F.col("s"), F.col("i")).orderBy("i").collect()
    assert [(x.strictly_better, x.tied_before, x.rank1) for x in t] == [(1, 0, 2), (1, 1, 3), (0, 0, 1)]
    assert metrics.medians(spark.createDataFrame([(1,), (2,)], "x int"), [], "x").first() == (1, 1.5)


def test_types():
    assert types.parse("Map<K,List<V>?>") == ("Map", ("K", "List<V>?"), False)
    assert types.depth("Map<K,List<V>>") == 2 and types.depth("int?") == 0
    known = frozenset("KV")
    assert types.variables("Map<K,List<V>>", known) == ["K", "V"]
    assert types.substitute("Map<K,List<V>?>", {"K": "Int", "V": "Str"}, known) == "Map<Int,List<Str>?>"
    assert types.substitute("List<V>", {}, known) is None
    assert types.split_top("a, b<c, d>, 'x,y', (e, f) -> g") == ["a", "b<c, d>", "'x,y'", "(e, f) -> g"]


def test_cpp_types(spark):
    t = types.parse_cpp("const std::vector<unsigned long int> &")
    assert (t["name"], t["args"], t["is_const"], t["reference"]) == ("std::vector", ["unsigned long"], True, "&")
    assert types.parse_cpp("char *const *")["pointers"] == [{"is_const": True, "is_volatile": False}, {"is_const": False, "is_volatile": False}]
    assert types.parse_cpp("  ") is None
    df = spark.createDataFrame([("const T&",), ("T&",), ("T&&",), ("const int",), ("T const &",)], "s string")
    assert [r[0] for r in df.select(types.cpp_slot(F.col("s"))).collect()] == ["T", "T&", "T&&", "int", "T"]
    assert types.cpp_parsed(df, "s").filter("s = 'T&&'").first().parsed.reference == "&&"
    a = spark.createDataFrame([("a", "b"), ("b", "a")], "alias string, target string")
    assert types.resolved_aliases(spark.createDataFrame([("a",), ("z",)], "n string"), "n", a).count() == 2


ASSIGNABLE = [
    ("int", "float", True), ("float", "int", False), ("bool", "complex", True), ("int | str", "object", True), ("int | str", "int", False), ("int", "int | None", True),
    ("list[int]", "Iterable[int]", True), ("list[str]", "Iterable[int]", False), ("list[bool]", "Iterable[float]", True), ("list[bool]", "MutableSequence[int]", False),
    ("dict[str, int]", "Mapping[str, float]", True), ("dict[str, int]", "MutableMapping[str, float]", False), ("str", "Sequence[str]", True), ("range", "Iterable[int]", True),
    ("tuple[int, str]", "Iterable[int]", False), ("Any", "Never", True), ("Never", "int", True), ("list[int]", "Hashable", False), ("int", "_T", True), ("set[int]", "AnyStr", False),
    ("Literal['a']", "AnyStr", True), ("list[int] & Sized", "Sized", True), ("def f(x) -> int", "Callable[[int], int]", True), ("int", "Callable", False), ("bytes", "Buffer", True),
    ("list[int] | str", "Iterable[object]", True), ("list[list[bool]]", "Iterable[Sequence[int]]", True), ("list[list[str]]", "Iterable[Sequence[int]]", False), ("tuple[int, bool]", "Sequence[float]", True),
    ("dict_items[str, int]", "Iterable[tuple[str, int]]", True), ("dict_items[str, int]", "Iterable[tuple[str, str]]", False), ("list[int]", "list[_T]", True), ("list[int]", "list[bool]", False),
    ("list[int]", "list[SupportsRichComparisonT]", True), ("list[set[int]]", "list[SupportsRichComparisonT]", False), ("int", "SupportsRichComparisonT", True), ("set[int]", "Sized & Iterable[int]", True),
    ("range", "Sized & Iterable[str]", False), ("list[int] | Any", "str | Iterable[int]", True), ("defaultdict[str, int]", "dict[str, int]", False), ("Generator[int, None, None]", "Iterable[float]", True),
    ("typing.List[int]", "object", True), ("bytes", "Iterable[int]", True), ("tuple[()]", "Sequence[int]", True), ("type[int]", "type", True), ("dict[str, int]", "Iterable[str]", True), ("frozenset[int]", "MutableSet[int]", False),
]


def test_assignability(spark):
    pairs = spark.createDataFrame([(a, e) for a, e, _ in ASSIGNABLE], "actual string, expected string")
    got = {(r.actual, r.expected): r.assignable for r in assign.judged(pairs).collect()}
    assert {k: ok for *k, ok in ((a, e, got[a, e]) for a, e, _ in ASSIGNABLE) for k in [tuple(k)]} == {(a, e): ok for a, e, ok in ASSIGNABLE}


def test_assign_relations(spark):
    a, e = spark.createDataFrame([("int",), ("str",), (None,)], "a string"), spark.createDataFrame([("float",), ("object",), ("int",)], "e string")
    assert {tuple(r) for r in assign.links(a, e).collect()} == {("float", "int"), ("object", "int"), ("object", "str")}
    assert assign.links(a.limit(0), e).isEmpty() and assign.links(a, e.limit(0)).isEmpty()
    types = spark.createDataFrame([(x,) for x in ("int", "complex", "str", "list[int]", "list[str]", "other")], "type string")
    got = {(r.op, r.left, r.right): r.result for r in assign.binary_results(types).collect()}
    assert got["/", "int", "int"] == "float" and ("%", "complex", "int") not in got and got["*", "str", "int"] == got["*", "int", "str"] == "str"
    assert got["+", "list[int]", "list[str]"] == "list" and got["+", "str", "str"] == "str" and not any("other" in k for k in got)


def brute_layouts(sig, most):
    """All positional prefixes and orders of names that inspect can bind."""
    import inspect
    from itertools import permutations

    kinds = {"posonly": inspect.Parameter.POSITIONAL_ONLY, "poskw": inspect.Parameter.POSITIONAL_OR_KEYWORD, "kwonly": inspect.Parameter.KEYWORD_ONLY}
    s = inspect.Signature([inspect.Parameter(n, kinds[k], default=inspect.Parameter.empty if r else None) for n, _, k, r in sig])
    out = set()
    for i in range(most + 1):
        for j in range(most + 1 - i):
            for names in permutations([p[0] for p in sig], j):
                try:
                    s.bind(*range(i), **dict.fromkeys(names))
                except TypeError:
                    continue
                out.add((tuple(p[1] for p in sig if p[2] != "kwonly")[:i], names))
    return out


def of_layouts(spark, sigs, *limits):
    df = spark.createDataFrame([(f"f{i}", [tuple(p) for p in s]) for i, s in enumerate(sigs)], f"callable string, params {layouts.PARAMETERS}")
    out = [[] for _ in sigs]
    for r in layouts.with_layouts(df, "params", *limits).collect():
        out[int(r.callable[1:])].append((tuple(r.positional), tuple(k.name for k in r.keywords)))
    return out


def test_layouts(spark):
    sigs = [[("a", "A", "posonly", True), ("b", "B", "poskw", False), ("k", "K", "kwonly", True)], [("a", "A", "poskw", True), ("b", "B", "poskw", False), ("c", "C", "kwonly", False)],
            [("x", "X", "posonly", False), ("y", "Y", "poskw", False)], [], [("a", "A", "kwonly", True), ("b", "B", "kwonly", True)]]
    for got, sig in zip(of_layouts(spark, sigs, 3, 64), sigs, strict=True):
        assert len(got) == len(set(got)) and set(got) == brute_layouts(sig, 3)
    more = of_layouts(spark, [[("x", "X", "vararg", False)], [(f"k{i:02}", "K", "kwonly", False) for i in range(12)], [(f"k{i:02}", "K", "kwonly", True) for i in range(13)]], 12, 64)
    assert sorted(more[0]) == [(("X",) * n, ()) for n in range(13)] and more[2] == []
    assert len(more[1]) == 64 and {(), ("k00",), ("k11",), ("k00", "k01"), ("k01", "k00")} <= {k for _, k in more[1]}
    df = spark.createDataFrame([("f", [("a", "A", "posonly", True)])], f"callable string, params {layouts.PARAMETERS}")
    row = layouts.with_layouts(df).select(layouts.call_symbols(F.col("callable")).alias("s")).first()
    assert [s.value for s in row.s] == ["f", "(", "A", ")"]


def text(p):
    return {f"{r.lhs} -> {r.t}" for r in p.select("lhs", rhs_text().alias("t")).collect()}


def test_calls(spark):
    c = spark.createDataFrame([("Box", None, None, "Box", ["String"]), ("Box", "Box", None, "next", ["String", "String"]), ("Box", None, "Box", "create", [])],
                              "result string, receiver string, static_owner string, name string, params array<string>")
    assert text(calls.call_productions(c)) == {"Box -> Box ( String )", "Box -> Box . next ( String , String )", "Box -> Box . create ( )"}
    assert calls.invalid_calls(c).isEmpty()
    assert text(calls.literal_rules(spark, "python", ["None"])) >= {"bool -> True", "None -> null"}
    assert calls.slice_productions(spark.createDataFrame([("list",)], "type string")).count() == 12
    m = spark.createDataFrame([("P", "x", "int")], "owner string, name string, type string")
    assert text(calls.member_productions(m)) == {"int -> P . x"}
    cpp = spark.createDataFrame([("T", "T", "constructor", None, ["int"]), ("T", "f", "static", "int", []), ("T", "()", "invocation", "int", []), (None, "g", "function", "int", [])],
                                "owner string, name string, kind string, result string, params array<string>")
    assert text(calls.cpp_productions(cpp)) == {"T -> T ( int )", "int -> T :: f ( )", "int -> T ( )", "int -> g ( )"}


def test_bounded_generics_and_ambiguity(spark):
    """Instances below the bound only; ambiguous and wide methods are out; a subtype row; 0 to 3 arguments."""
    edges = spark.createDataFrame([("Integer", "Number"), ("IntegerBox", "FluentBox<Integer>")], "src string, dst string")
    ground = spark.createDataFrame([("Integer",), ("Boolean",), ("String",)], "type string")
    bounds = spark.createDataFrame([("FluentBox", "T", "Number"), ("Free", "U", None)], "generic string, variable string, bound string")
    domains = monomorph.admissible(ground, bounds, edges)
    assert {(r.generic, r.type) for r in domains.collect()} == {("FluentBox", "Integer"), ("Free", "Integer"), ("Free", "Boolean"), ("Free", "String")}
    c = spark.createDataFrame([("FluentBox", "FluentBox<T>", "FluentBox<T>", "next", ["T"])], "generic string, result string, receiver string, name string, params array<string>")
    got = monomorph.instantiated(c, monomorph.bindings(domains, 1)).collect()
    assert [(r.result, r.receiver, r.params) for r in got] == [("FluentBox<Integer>", "FluentBox<Integer>", ["Integer"])]
    api = spark.createDataFrame([("FluentBox", "choose", ["A"], "d1"), ("FluentBox", "choose", ["B"], "d2"), ("FluentBox", "next", ["T"], "d3")], "owner string, name string, params array<string>, descriptor string")
    sub = spark.createDataFrame([("IntegerBox", "FluentBox")], "src string, dst string")
    assert [r.name for r in calls.unambiguous(api, sub).collect()] == ["next"]
    full = api.withColumns({"access": F.lit("public"), "is_varargs": F.lit(False), "is_synthetic": F.lit(False), "is_bridge": F.lit(False)})
    wide = full.limit(1).withColumns({"name": F.lit("tooWide"), "params": F.array(*[F.lit("x")] * 4)})
    assert "tooWide" not in {r.name for r in calls.supported(full.unionByName(wide)).collect()}
    types_ = spark.createDataFrame([("IntegerBox",), ("FluentBox<Integer>",)], "type string")
    assert text(monomorph.subtype_rules(types_, edges)) == {"FluentBox<Integer> -> IntegerBox"}


def test_bindings_of_two_variables(spark):
    d = spark.createDataFrame([("M", "K", "a"), ("M", "K", "b"), ("M", "V", "a")], "generic string, variable string, type string")
    assert {tuple(sorted(r.binding.items())) for r in monomorph.bindings(d, 2).collect()} == {(("K", "a"), ("V", "a")), (("K", "b"), ("V", "a"))}


def test_relations(spark):
    s = spark.createDataFrame([("d", 1, 0, 10), ("d", 2, 11, 20)], "k string, id int, begin long, end long")
    o = spark.createDataFrame([("d", 9, 10, 11)], "k string, other_id int, `from` long, `to` long")
    assert {(r.id, r.other_id) for r in relations.overlapping(s, o, "k", 3).collect()} == {(1, 9), (2, 9)}
    n, m = spark.createDataFrame([("a.b.c",), ("x",)], "name string"), spark.createDataFrame([("a",), ("a.b",), ("a.bc",)], "module string")
    assert {(r.name, r.module) for r in relations.prefix_matches(n, m).collect()} == {("a.b.c", "a"), ("a.b.c", "a.b")}
    e = spark.createDataFrame([("m.x", "n.x", 0), ("n.x", "d.x", 0), ("p", "q", 0), ("q", "p", 0)], "symbol string, target string, rank int")
    got = {r.symbol: r.definition for r in relations.resolved_imports(e, spark.createDataFrame([("d.x",)], "symbol string")).collect()}
    assert got == {"m.x": "d.x", "n.x": "d.x", "d.x": "d.x"}
    h = spark.createDataFrame([("a", None), ("a", 2), ("z", 1)], "member string, kind int")
    t = spark.createDataFrame([("a", 1)], "member string, kind int")
    assert {(r.member, r.kind): r.status for r in relations.hinted(t, h, ["member"], ["kind"]).collect()} == {("a", None): "matched", ("a", 2): "stale", ("z", 1): "stale"}


def test_ngrams(spark):
    s = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "k int, tokens array<string>")
    model = ngrams.counts(s, "k", "tokens")
    assert {(tuple(r)[:4], r.n) for r in model.collect()} >= {(("BOS", "NEWLINE", "a", "b"), 1), (("BOS", "NEWLINE", "a", "NEWLINE"), 1)}
    import math

    v = ngrams.vocabulary(model).count()
    got = {r.k: r.score for r in ngrams.scores(s, "k", "tokens", model).collect()}
    assert v == 5 and got[2] == pytest.approx(math.log(2 / (2 + v)) + math.log(2 / (1 + v)))
    truth = spark.createDataFrame([("g", 1), ("g", 5)], "g string, ordinal int")
    c = spark.createDataFrame([("g", 0, 1.0), ("g", 1, 1.0), ("g", 2, 3.0)], "g string, ordinal int, score double")
    r = {x.ordinal: (x.rank1, x.censored_reason) for x in ngrams.truth_ranks(c, truth, ["g"], "ordinal", "score", 3).collect()}
    assert r == {1: (3, None), 5: (None, "beyond_prefix")}


def test_python_facts():
    tree = ast.parse("import numpy as np, os.path\nfrom collections import deque\nfrom . import x\nif True:\n    import re\n")
    assert pysource.import_roots(tree) == ["collections", "numpy", "os", "re"]
    assert dict(pysource.visible_imports(tree, 3)) == {"np": "numpy", "os": "os", "deque": "collections.deque"}
    assert pysource.canonical_tokens("y = f(1, 2.5, 3j, 'a', b'c', y)", "y") == ["@fresh", "=", "f", "(", "0", ",", "0.0", ",", "0j", ",", '""', ",", 'b""', ",", "y", ")"]
    assert pysource.canonical_tokens("x = 'a") is None
    ok = lambda s: pysource.in_surface(ast.parse(s, mode="eval").body)
    assert ok("f(x)[1:2].a + -b ** 2") and not ok("f(*a)") and not ok("x if y else z") and not ok("a._b") and not ok("f(**k)")
    assert pysource.spelling_problems("f(a,)\n'x' 'y'\n") == {"trailing_comma": 1, "adjacent_literal": 1}
    assert pysource.suppressed("x = 1  # type: ignore\n") and not pysource.suppressed("x = '# noqa'\n")
    src = ast.parse("a = 1\ndef f(b):\n    c = a\n    return c\nprint(a)\n")
    assert pysource.bound_before(src, "b", 3) and not pysource.bound_before(src, "c", 3) and pysource.loaded_after(src, "a", 3)
    assert [(k, n) for k, _, _, n in pysource.candidates(ast.parse("x = 1\nf(2)\n'doc'\ny = z = 3\n"))] == [("output-assignment", "x"), ("expression", None)]
    assert pysource.fresh_name({"__typegram_fresh_0"}) == "__typegram_fresh_1"
    assert pysource.hole("é = f(1)\n", 1, 5, 1, 9) == ("é = ", "f(1)", "\n")
    d = pysource.definitions(ast.parse("__all__ = ['f']\ndef f() -> int: ...\nclass C: ...\nfrom a import b as b\n_x: int\n"))
    assert ("f", "function", "int", True) in d and ("C", "class", None, False) in d and ("b", "reexport", None, False) in d


def test_completions(spark):
    df = spark.createDataFrame([("q", 0, "a", "int", False), ("q", 1, "a", "str", False), ("q", 2, "_b", "x", False), ("q", 3, "for", "x", False), ("q", 4, "c", "x", True)],
                               "query string, ordinal int, label string, detail string, has_edit boolean")
    assert [(r.label, r.detail) for r in pysource.simplified_completions(df).collect()] == [("a", "str")]
    pages = spark.createDataFrame([("q", 0, "a", "Any"), ("q", 1, "b", "int"), ("q", 1, "a", "int"), ("q", 3, "z", "int")], "query string, pass int, label string, detail string")
    assert {(r.label, r.detail) for r in pysource.completed_union(pages).collect()} == {("a", "int"), ("b", "int")}


@pytest.mark.parametrize(("kind", "codes", "message", "any_", "reason"), [
    ("expression", ["invalid-syntax"], "", True, "syntax-rendering"), ("expression", ["unresolved-reference"], "", True, "local-name-resolution"),
    ("expression", ["invalid-argument-type"], "Argument to constructor `map.__new__` is", True, "local-callable-contract"),
    ("expression", ["no-matching-overload", "invalid-argument-type"], "", True, "local-overload-generic-correlation"), ("expression", ["unknown-argument"], "", True, "local-call-layout"),
    ("expression", ["invalid-argument-type"], "", True, "local-argument-assignability"), ("expression", ["unsupported-operator"], "", True, "local-operator"),
    ("expression", ["not-subscriptable"], "", True, "local-member-subscript-callability"), ("expression", ["invalid-assignment"], "", True, "local-value-flow"),
    ("expression", ["strange"], "", True, "other-local"), ("output-assignment", [], "", True, "downstream-output-contract"), ("expression", [], "", True, "nonlocal-context-effect"),
    ("expression", [], "", False, "other"),
])
def test_failure_classes(spark, kind, codes, message, any_, reason):
    c = F.array(*map(F.lit, codes)).cast("array<string>")
    assert spark.range(1).select(diagnostics.failure_class(F.lit(kind), c, F.lit(message), F.lit(any_))).first()[0] == reason


def test_classified_by_overlap(spark):
    s = spark.createDataFrame([(1, "expression", 0, 5, 1), (2, "expression", 0, 5, 1)], "sample_id int, kind string, begin int, end int, line int")
    d = spark.createDataFrame([(1, "unsupported-operator", "m", 5, 9, 1, 1), (1, "x", "m", 6, 9, 1, 1)], "sample_id int, code string, message string, d_begin int, d_end int, d_first int, d_last int")
    got = {r.sample_id: (r.reason, r.local_codes, r.downstream_codes) for r in diagnostics.classified(s, d).collect()}
    assert got == {1: ("local-operator", ["unsupported-operator"], ["x"]), 2: ("other", [], [])}


def test_scalars(spark):
    df = spark.createDataFrame([("a  b-c",), ("__",), ("",)], "s string")
    assert [r[0] for r in df.select(scalars.token_name(F.col("s"))).collect()] == ["a_b_c", "TOKEN", "TOKEN"]
    big = spark.createDataFrame([("1" + "0" * 400,), ("1000",), ("0",)], "x string").select(scalars.log10_of(F.col("x")), scalars.compact(F.col("x"))).collect()
    assert big[0][0] == pytest.approx(400) and big[1][0] == pytest.approx(3) and big[2][0] is None and big[0][1] == "1.000e+400"
    assert scalars.nice_step(43) == 10 and len(scalars.base32_name("x")) == 12
    assert scalars.unique_hash_names(df, "s").count() == 3
    b = spark.createDataFrame([(b"a\x00b",), (b"\x10\x01",)], "d binary")
    assert [r[0] for r in b.select(scalars.is_binary(F.col("d"))).collect()] == [True, False]
