import pytest

from typegram.llm import cfamily, syntax

JAVA = """package a.b;
import java.util.*;
import static java.lang.Math.max;
@Deprecated public final class A<T extends Comparable<T> & Runnable> extends B<T> implements C, D<int[]> {
    static final long X = 1_000L, Y[] = {1, 2,};
    static { int q = 0; }
    enum E { P, Q(1) { void f() {} }, R; int z; }
    record Pt(int x, int... y) { Pt { if (x < 0) throw new IllegalArgumentException(); } }
    interface I { default int f() { return 1; } int g(); }
    A() { super(); this.x = 3; }
    <U> Map<String, List<U>> f(final int[] a, List<? extends Number> b) throws Exception, RuntimeException {
        for (int i = 0, j = 1; i < 10 && j > 0; i++, --j) { continue; }
        for (var x : a) if (x > 3) break; else x += 1;
        outer: while (true) { do { x >>>= 2; } while (x != 0); break outer; }
        try (var r = open(); s) { r.read(); } catch (IOException | RuntimeException e) { throw e; } finally { }
        switch (x) { case 1: case 2: y(); break; default: z(); }
        int k = switch (x) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> throw new X(); };
        Runnable run = () -> { }; Function<A, B> g = (p) -> p.q(); var h = A::new; var m = int[]::new; g = A::<T>f;
        Object o = (Object) a; int n = (int) -1.5e3f; String t = (String) (o) + 'c' + "s\\"" + 0x1F;
        if (o instanceof String s && s.length() > 1) return new HashMap<>() {{ put("a", 1); }};
        int[][] grid = new int[3][], w = new int[]{1, 2}; grid[0][1]++; a.b.<U>c().d[1] = x ? y : z;
        synchronized (this) { assert x > 1 : "m"; } ; String block = \"\"\"
            text "quoted"
            \"\"\"; return null;
    }
}
"""
CPP = """#include <vector>
#include "own.h"
#define MAX(a, b) \\
    ((a) > (b) ? (a) : (b))
using namespace std; using ll = long long; using std::pair;
namespace a::b { int x = 1; } namespace { }
template <typename T, int N = 3> struct S : public Base<T>, private virtual X { public: S() : Base<T>(1), y{2} {} explicit S(int v) {} ~S() = default; T operator()(const T& a) const { return a; }
  bool operator<(const S& o) const { return y < o.y; } static constexpr int k = 2; friend class F; int y : 3; enum class C { P, Q = 2, }; };
enum Color { RED, GREEN }; typedef unsigned long long ull; struct P { int a, b; } p, *q = &p;
int arr[MAX_N][3] = {{1, 2}, {}}; extern "C" { void f(int, char* = nullptr); } static_assert(sizeof(int) == 4, "m");
template <> int S<int>::g(vector<pair<int, int>> v) { return 1; }
auto h(int (&a)[3], function<int(int)> f) -> decltype(a[0]) { return a[0]; }
int main(int argc, char** argv) {
    ios::sync_with_stdio(false); cin.tie(nullptr); int n, *m = new int[5]{1}; cin >> n >> *m;
    vector<vector<int>> g(n, vector<int>(n, 0)); map<string, vector<int>> d; d["k"].push_back(1LL * n % 7);
    for (int i = 0; i < n; ++i) for (auto& [k, v] : d) cout << k << ' ' << v.size() << "\\n";
    for (const auto& x : {1, 2, 3}) { if (x == 2) continue; } while (n-- > 0) { } do { n++; } while (n < 3);
    auto f = [&, n](int a, auto b) mutable -> int { return a + n; }; sort(v.begin(), v.end(), [](int a, int b) { return a > b; });
    switch (n) { case 1: { break; } case 'a': default: goto end; } int z = n > 3 ? f(1, 2) : static_cast<int>(2.5f); unsigned u = (unsigned) n; double q = double(n) / 2;
    try { throw runtime_error("x"); } catch (const exception& e) { } catch (...) { throw; } a < b; if (auto it = d.find("k"); it != d.end()) { } delete[] m;
    int w[] = {1, 2}; pair<int, int> pr{1, 2}; string s(3, 'a'), t = R"(raw "x")"; x = y = {1, 2}; std::array<int, 3> arr3; n = p->a.b(); return {};
end: return 0;
}
"""


@pytest.mark.parametrize(("text", "java"), [(JAVA, True), (CPP, False), ("", True), ("", False), ("// only\n/* comment */", True)])
def test_valid(text, java):
    assert cfamily.parses(text, java)


@pytest.mark.parametrize("java", [True, False])
def test_every_truncation_and_dropped_sign_is_noticed(java):
    text = "class A { int f(int a) { if (a > 1) { return a + g(2); } return 0; } }" if java else "int f(int a) { if (a > 1) { return a + g(2); } return 0; }"
    assert cfamily.parses(text, java)
    for i in range(1, len(text) - 1):
        assert not cfamily.parses(text[:i], java), text[:i]
    for i, c in enumerate(text):
        if c in "(){};":
            assert not cfamily.parses(text[:i] + text[i + 1:], java), (i, text[:i] + "|" + text[i + 1:])


@pytest.mark.parametrize(("text", "java"), [
    ("class A { <<<<<<< HEAD\n int a;\n=======\n int b;\n>>>>>>> x\n }", True), ("1: class A { }", True), ("class A { void f() { x &lt; 3; } }", True), ("class A { void f() { a + b; } }", True),
    ("class A { String s = “x”; }", True), ("class A { void f() { try { } } }", True), ("int main() { return 0 }", False), ("#include &lt;vector&gt;\nint x;", False), ("int main() { int x = 08a; }", False),
    ("def f():\n    return 1\n", False), ("int a = 'x;", False), ("/* open", True), ("prose of some words.", False), ("int f() { else { } }", False), ("int x\x00;", False),
])
def test_invalid(text, java):
    assert not cfamily.parses(text, java)


def test_json():
    ok = ['{"a": [1, -2.5e3, null, true, "x\\u00e9"]}', " 1 ", '"s"', "[]", "[" * 3000 + "]" * 3000, "9" * 5000]
    bad = ["", " ", "{a: 1}", "[1,]", "NaN", '{"a": 1} x', "'s'", '"a\nb"', "01", "[" * 3000 + "]" * 2999, "[" * 3000 + "1 2" + "]" * 3000]
    assert all(map(syntax.json_parses, ok)) and not any(map(syntax.json_parses, bad))


SCHEMA = "source_id long, data binary, language string, repo string, scan_id long, id string, valid string"


def test_rows(spark):
    rows = [(1, b"x = 1\n", "python"), (2, b"print 'x'\n", "python"), (3, b"", "json"), (4, b"", "java"), (5, None, "python"), (6, b"\xff\xff", "python"), (7, b'{"a": 1}', "java"),
            (8, b"class A { }", " Java "), (9, b"x", None), (10, b"x", "cobol"), (11, b"class A { }", "python"), (11, b"class A { }", "python"), (12, "x = 'é'".encode("utf-16"), "python"),
            (13, b"(" * 5000, "python"), (14, b"x = [\n" + b"1,\n" * 60000 + b"]\n", "python"), (15, b"#include <a>\nint main() { }\n", "python")]
    df = spark.createDataFrame([(i, d, x, "r", 1, "", "") for i, d, x in rows], SCHEMA)
    assert sorted(r.source_id for r in syntax.invalid(df).collect()) == [2, 3, 7, 11, 11, 13, 15]
    v = {r.id: r for r in syntax.verdicts(df).collect()}
    assert (v[7].reason, v[7].parses_as) == ("wrong_extension", "json") and v[2].reason == "corrupt" and v[11].parses_as == "java" and v[15].parses_as == "cpp"
    assert v[5].valid is None and v[9].valid is None and v[9].decoded and not v[6].decoded
    assert v[8].accepted_by == ["java"] and v[1].accepted_by == ["python"] and set(v[4].accepted_by) == {"python", "cpp", "java"} and v[3].parses_as is None
    assert v[13].accepted_by == [] and v[5].accepted_by is None and v[7].accepted_by == ["json", "python"]
    r = {x.language: x for x in syntax.rates(df).collect()}
    assert (r["json"].files, r["json"].invalid_files, r["json"].invalid_rate) == (1, 1, 1.0)
    scans = spark.createDataFrame([(1, 10, 3, 6)], "scan_id long, python_files long, parsed_files long, parse_failures long")
    assert syntax.against_scans(df, scans).first().invalid_files == 5
    assert syntax.invalid(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_ranking():
    assert syntax.ranked(CPP)[0] == "cpp" and syntax.ranked(JAVA)[0] == "java" and syntax.ranked("def f():\n    return None\n")[0] == "python"


def test_python_refuses_by_grammar_only():
    """What the compiler refuses for other reasons is valid syntax."""
    assert all(map(syntax.python_parses, ["return 1", "def f(a, a): pass", "nonlocal x", "break", "def f():\n    x = 1\n    global x\n", "from __future__ import nothing_known"]))
    assert not any(map(syntax.python_parses, ["x = (", "a b", "\x00", "def f(:\n", "  x\n y"]))
