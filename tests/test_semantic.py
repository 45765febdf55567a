import pytest
from pyspark.sql import functions as F

from typegram.operators import cnf, cyk, grammar, language, lengths, semantic, shapes
from typegram.operators.grammar import rhs_text


def text(p):
    return {f"{r.lhs} -> {r.t}" for r in p.select("lhs", rhs_text().alias("t")).collect()}


def types(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "type string")


def test_rows_of_a_context(spark):
    names = spark.createDataFrame([("x", "int", False), ("_p", "int", False), ("d", "Any", False), ("len", "def", True)], "name string, type string, is_builtin boolean")
    typed, dynamic = semantic.scope_rules(names, ["abs"])
    assert text(typed) == {"E:int -> x"} and [r.name for r in dynamic.collect()] == ["d"]
    c = spark.createDataFrame([("int", "real", "int"), ("str", "upper", "m")], "receiver string, name string, type string")
    assert text(semantic.member_rules(types(spark, "int"), c)) == {"E:int -> E:int . real"}
    lay = spark.createDataFrame([("f", "str", ["int"], [("k", "bool")]), ("map", "x", [], []), ("sum", "int", ["Iterable[int]", "int"], [])],
                                "callable string, result string, positional array<string>, keywords array<struct<name:string,type:string>>")
    assert text(semantic.call_rules(lay)) == {"E:str -> E:f ( A:int , k = A:bool )", "E:int -> E:sum ( A:__numeric_iterable__ , A:__numeric__ )"}
    assert text(semantic.extremes(types(spark, "int", "object"), 2)) == {"E:int -> min ( E:int , E:int )", "E:int -> max ( E:int , E:int )", "E:int -> min ( A:Iterable[int] )", "E:int -> max ( A:Iterable[int] )"}
    assert "E:int -> ~ E:bool" in text(semantic.unary_rules(types(spark, "bool", "float"))) and "E:float -> ~ E:float" not in text(semantic.unary_rules(types(spark, "float")))
    sub = text(semantic.subscript_rules(types(spark, "list[str]", "dict[int, str]", "int")))
    assert {"E:str -> E:list[str] [ E:int ]", "E:list[str] -> E:list[str] [ : ]", "E:str -> E:dict[int, str] [ A:int ]"} <= sub and len(sub) == 14
    b = text(semantic.binary_rules(types(spark, "int", "str")))
    assert {"E:float -> E:int / E:int", "E:str -> E:str + E:str", "E:str -> E:int * E:str"} <= b and not any("E:str / " in x for x in b)


def test_correlated_and_families(spark):
    c = spark.createDataFrame([("f", "str", ["int"]), ("g", "int", ["int", "int"])], "callable string, result string, params array<string>")
    got = text(semantic.correlated_rules(c, types(spark, "list[int]")))
    assert {"E:map[str] -> map ( E:f , A:Iterable[int] )", "E:list[str] -> list ( E:map[str] )", "E:list[str] -> sorted ( E:list[str] )", "E:tuple[str, ...] -> tuple ( E:map[str] )"} <= got
    assert not any("E:g" in x for x in got)
    fam = semantic.family_rules(spark.createDataFrame([("Any", "p", True), ("Any", "q", False)], "type string, producer string, declared boolean"))
    assert fam.count() == 3 and fam.filter("lhs = 'E:__trusted_family__'").count() == 1
    words = spark.createDataFrame([("d ( )",), ("- d",), ("d ( ) ( )",)], "word string")
    dyn = semantic.composed_dynamic(spark.createDataFrame([("d",)], "name string"), words, 2, 4)
    assert {x.rsplit(" -> ")[1] for x in text(dyn)} == {"d", "d ( )", "- d"}


def test_assembly_recognises(spark):
    parts = [semantic.literals(spark), semantic.binary_rules(types(spark, "int")),
             spark.createDataFrame([("E:str", [("T", "chr"), ("T", "("), ("N", "A:SupportsIndex"), ("T", ")")]), ("E:dead", [("N", "E:none")])], grammar.SCHEMA)]
    p = semantic.finished(parts, types(spark, "str"))
    assert "A:SupportsIndex -> E:int" in text(p) and not any(x.startswith("E:dead") for x in text(p))
    words = spark.createDataFrame([(1, i, t) for i, t in enumerate("chr ( 0 + 0 )".split())] + [(2, i, t) for i, t in enumerate(['chr', '(', '""', ')'])], "word_id int, pos int, token string")
    assert {r.word_id for r in cyk.recognised(words, cnf.to_cnf(p)).filter("recognized").collect()} == {1}
    assert not any(x.startswith("START") for x in text(semantic.refined_roots(p, spark.createDataFrame([("E:str", False)], "symbol string, accepted boolean"))))


def test_fragments_activate_in_turn(spark):
    n = lambda v: ("N", v)
    rows = spark.createDataFrame([("b", "E:b", [n("E:a")]), ("a", "E:a", [n("E:own")]), ("z", "E:z", [n("E:missing")])], "module string, lhs string, rhs array<struct<kind:string,value:string>>")
    own = spark.createDataFrame([("E:own", [("T", "x")])], grammar.SCHEMA)
    assert {r.module for r in semantic.active_fragments(rows, own).collect()} == {"a", "b"}


def test_shapes_and_unification(spark):
    assert shapes.normalised(["Map<K,V>", "V", None], frozenset("KV")) == ["Map<$0,$1>", "$1", None]
    k = frozenset("T")
    assert shapes.unify("List<T>", "List<Int>", k) == {"T": "Int"} and shapes.unify("Pair<T,T>", "Pair<A,B>", k) is None
    t = [("Iterable<T>", "List<T>"), ("List<T>", "ArrayList<T>"), ("A", "B"), ("B", "A")]
    assert shapes.is_subtype("ArrayList<Int>", "Iterable<Int>", t, k) and not shapes.is_subtype("ArrayList<Int>", "Iterable<Str>", t, k)
    assert shapes.is_subtype("A", "B", t, k) and shapes.is_subtype("A", "Top", t, k, top="Top") and shapes.is_subtype("ArrayList<Int>", "List<Int>?", t, k) and not shapes.is_subtype("List<Int>?", "List<Int>", t, k)
    api = spark.createDataFrame([("Box<T>", "get", "T", [], ["T"]), ("IntBox", "get", "Int", [], []), ("Sub<U>", "get", "U", [], ["U"]), ("Sub<U>", "size", "Int", [], ["U"]), ("Top<V>", "size", "Int", [], ["V"])],
                                "owner string, name string, result string, params array<string>, type_vars array<string>")
    edges = spark.createDataFrame([("Sub<U>", "Box<T>"), ("Box<T>", "Top<V>")], "src string, dst string")
    got = {(r.owner, r.shape): r.receiver for r in shapes.receivers(api, edges).collect()}
    assert got["Sub<U>", "get:$0"] == "Box<T>" and got["Sub<U>", "size:Int"] == "Top" and got["IntBox", "get:Int"] == "IntBox"


def test_small_helpers(spark):
    assert text(shapes.supporting_rules(types(spark, "int | list[str]", "tuple[int]"))) >= {"int | list[str] -> int", "list -> list[str]", "list[str] -> [ ]", "tuple[int] -> ( int , )"}
    p = spark.createDataFrame([("numpy", "np"), ("numpy.linalg", "la")], "module string, alias string")
    q = {r.name: r.spoken for r in shapes.qualified(spark.createDataFrame([("numpy.array",), ("numpy.linalg.inv",), ("os.path",)], "name string"), p).collect()}
    assert q == {"numpy.array": "np.array", "numpy.linalg.inv": "la.inv", "os.path": "os.path"}
    assert {r.name for r in shapes.unqualified(spark.createDataFrame([("np.array",), ("x.y",)], "spoken string"), p).collect()} == {"numpy.array", "x.y"}
    a = shapes.admissible_arguments(types(spark, "List<Int>", "Int", "Str", "a b"), {"Str": 0}, 2)
    assert [r.type for r in a.collect()] == ["Str", "Int"]
    g = grammar.from_rows(spark, [("S", ["A", "B"]), ("A", ["x"]), ("B", ["x"])])
    assert len({r.key: r.members for r in grammar.indexed_by(g, "terminal").collect()}["x"]) == 2
    d = language.Derivations([("START", ["A", "Z"]), ("START", ["B", "Z"]), ("A", ["x"]), ("B", ["x"]), ("Z", ["z"])])
    assert d.count("START", 2) == 2 and [d.unrank(2, i) for i in range(2)] == [["x", "z"]] * 2
    with pytest.raises(IndexError):
        d.unrank(2, 2)
    nodes = spark.createDataFrame([("java", "if_statement", "f", 1, 0, 6), ("java", "expression_statement", "f", 2, 4, 6), ("java", "identifier", "f", 3, 0, 1)],
                                  "language string, node_type string, file string, node_id int, begin int, end int")
    s = lengths.statement_nodes(nodes)
    tokens = spark.range(6).select(F.lit("f").alias("file"), F.col("id").cast("int").alias("pos"))
    assert {(r.node_id, r.tokens) for r in lengths.own_tokens(s, tokens).collect()} == {(1, 4), (2, 2)}
