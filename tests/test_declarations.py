import ast
import json

from pyspark.sql import functions as F

from typegram.operators import calls, diagnostics, grammar, monomorph, relations
from typegram.operators.grammar import rhs_text
from typegram.sources import declarations as d

TREE = {"kind": "TranslationUnitDecl", "inner": [
    {"kind": "CXXRecordDecl", "name": "Box", "tagUsed": "class"},
    {"kind": "NamespaceDecl", "name": "n", "inner": [{"kind": "FunctionDecl", "name": "free", "type": {"qualType": "int (const std::string &, ...)"}, "inner": [{"kind": "ParmVarDecl", "type": {"qualType": "const std::string &"}}]}]},
    {"kind": "CXXRecordDecl", "name": "Box", "tagUsed": "class", "completeDefinition": True, "bases": [{"access": "public", "type": {"qualType": "Base"}}], "inner": [
        {"kind": "CXXMethodDecl", "name": "hidden", "type": {"qualType": "void ()"}}, {"kind": "AccessSpecDecl", "access": "public"},
        {"kind": "CXXConstructorDecl", "name": "Box", "type": {"qualType": "void (int)"}, "inner": [{"kind": "ParmVarDecl", "type": {"qualType": "int"}}, {"kind": "CompoundStmt"}]},
        {"kind": "CXXMethodDecl", "name": "get", "type": {"qualType": "unsigned long int () const"}}, {"kind": "CXXMethodDecl", "name": "make", "storageClass": "static", "type": {"qualType": "Box ()"}},
        {"kind": "CXXMethodDecl", "name": "gone", "explicitlyDeleted": True, "type": {"qualType": "void ()"}}]},
    {"kind": "TypedefDecl", "name": "ull", "type": {"qualType": "unsigned long long int"}}]}


def text(p):
    return {f"{r.lhs} -> {r.t}" for r in p.select("lhs", rhs_text().alias("t")).collect()}


def test_cpp_trees(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(TREE) + "\n" + json.dumps(TREE))
    rows = d.read_trees(spark, str(tmp_path / "a.json"))
    t = {r.name: r.complete for r in d.types_of(rows).collect()}
    assert t == {"Box": True}
    c = d.callables_of(rows)
    got = {r.name: (r.kind, r.access, r.result, r.is_const) for r in c.collect()}
    assert got["hidden"][1] == "private" and got["get"] == ("method", "public", "unsigned long", True) and got["make"][0] == "static" and c.count() == 6
    assert text(calls.cpp_productions(calls.cpp_supported(c.withColumn("owner", F.coalesce("owner", F.lit("")))))) == {"Box -> Box ( int )", "unsigned long -> Box . get ( )", "Box -> Box :: make ( )"}
    assert {r.target for r in rows.filter("kind = 'alias'").collect()} == {"unsigned long long"}


STUB = """
from typing import overload, TypeVar, Optional
T = TypeVar('T', int, str)
B = TypeVar('B', bound=float)
U = TypeVar('U')
Text = str
Loop = Loop2
Loop2 = Loop
x: Optional[Text]
class Color(Enum):
    def __init__(self, v: int) -> None: ...
class P(Base):
    size: int
    def __init__(self, a: int, b: Text = ...) -> None: ...
    @property
    def name(self) -> typing.List[Text]: ...
    @staticmethod
    def make(n: int) -> P: ...
    @overload
    def f(self, a: int) -> Self: ...
    @overload
    def f(self, a: str) -> str: ...
    def f(self, a): ...
    def _p(self): ...
class Q: ...
def g(*a: int, k: bool) -> None: ...
"""


def test_stubs(spark, tmp_path):
    tree = ast.parse(STUB)
    assert d.type_variables(tree) == {"T": ["int", "str"], "B": ["float"], "U": ["object"]}
    assert d.resolved("Optional[Text]", d.type_aliases(tree)) == "str | None" and d.resolved("Loop", {"Loop": "Loop2", "Loop2": "Loop"}) == "Loop"
    (tmp_path / "m.pyi").write_text(STUB)
    (tmp_path / "bad.pyi").write_text("def (")
    rows = d.read_stubs(spark.createDataFrame([("m", str(tmp_path / "m.pyi")), ("bad", str(tmp_path / "bad.pyi"))], "module string, path string"))
    got = text(d.stub_productions(rows, 2, 64))
    assert {"P -> P ( int )", "P -> P ( int , str )", "P -> P ( int , b = str )", "P -> P . f ( int )", "str -> P . f ( str )", "P -> P . make ( int )", "List[str] -> P . name", "int -> P . size", "Q -> Q ( )",
            "Base -> P", "str | None -> x", "None -> g ( k = bool )", "None -> g ( int , k = bool )"} <= got
    assert not any(x.startswith("Color -> Color") or "_p" in x for x in got)


def test_remaining_relations(spark):
    e = spark.createDataFrame([("Base", "Sub"), ("Same", "Same")], "super_key string, sub_key string")
    assert text(calls.base_rules(e)) == {"Base -> Sub"}
    p = grammar.from_rows(spark, [("A", ["x"])])
    assert text(calls.grouping_rules(p)) == {"A -> ( A )"}
    t = spark.createDataFrame([("List<Int>",), ("List",), ("Set<Int>",)], "type string")
    assert {r.type for r in monomorph.erased_cover(t).collect()} == {"List", "Set<Int>"}
    n = relations.preferred_names(spark.createDataFrame([("a",), ("b",)], "n string"), "n", spark.createDataFrame([("a", "A")], "canonical string, display string"))
    assert {r.n for r in n.collect()} == {"A", "b"}
    c = spark.createDataFrame([("m", False, "z"), ("m", True, "y")], "name string, exact boolean, path string")
    assert relations.with_precedence(spark.createDataFrame([("m",)], "name string"), c, [F.desc("exact"), F.col("path")]).first().path == "y"
    diag = spark.createDataFrame([("m", "unresolved-reference", "Name `abc` used", 1), ("m", "other", "x", 2), ("m", None, "x", 1)], "member string, code string, message string, severity int")
    assert diagnostics.errors(diag).count() == 1 and [r.name for r in diagnostics.unresolved_names(diag).collect()] == ["abc"]
    s = spark.createDataFrame([(1,), (2,)], "k int")
    r = spark.createDataFrame([(1, True, 5)], "k int, recognized boolean, checked int")
    assert {(x.k, x.recognized, x.checked) for x in diagnostics.with_failures(s, r, "k", ["checked"]).collect()} == {(1, True, 5), (2, False, 0)}
    assert monomorph.depth_budget(spark.createDataFrame([("T", 0), ("T", 2)], "variable string, nesting int"), 3).first().budget == 1
