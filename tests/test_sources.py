import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from typegram.operators import grammar, precedence, pysource
from typegram.sources import corpora, fragments, records
from typegram.streaming.metrics import RunningTotals, quarantined


def test_problem_files(spark, tmp_path):
    f = tmp_path / "train.jsonl"
    rows = [{"id": "1", "solutions": json.dumps(["import math\n", "import math, numpy\nfrom . import x\n"]), "difficulty": "easy", "url": "u"}, {"id": "a b", "solutions": "", "difficulty": None, "url": None}]
    f.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    got = corpora.read_problems(spark, str(f), "train").orderBy("member").collect()
    assert [r.member for r in got] == ["APPS/train/1/solution_0000.py", "APPS/train/1/solution_0001.py"]
    df = corpora.read_corpus(spark, "apps", str(f)).withColumn("g", F.lit(1))
    roots = {r.name: r.n for r in pysource.scanned_imports(df, "g").filter("counter = 'root'").collect()}
    assert roots == {"math": 2, "numpy": 1}
    assert corpora.read_corpus(spark, "apps", str(f), shards=2, index=1).count() == 1
    with pytest.raises(ValueError, match="shard"):
        corpora.read_corpus(spark, "apps", str(f), shards=2, index=2)
    (tmp_path / "bad.jsonl").write_text('{"solutions": "[]"}\n{oops\n')
    with pytest.raises(Exception):
        corpora.read_problems(spark, str(tmp_path / "bad.jsonl"), "train").collect()


def test_archive(spark, tmp_path):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for name, data in (("Project_CodeNet/data/p00001/Python/s000000001.py", b"x = 1\n"), ("Project_CodeNet/data/p00001/C/s000000002.c", b"")):
            i = tarfile.TarInfo(name)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))
    (tmp_path / "a.tar.gz").write_bytes(gzip.compress(raw.getvalue()))
    rows = corpora.read_corpus(spark, "codenet", str(tmp_path / "a.tar.gz")).collect()
    assert [(r.problem_id, bytes(r.data), r.split) for r in rows] == [("p00001", b"x = 1\n", None)]


def small(spark):
    n, t = (lambda v: ("N", v)), (lambda v: ("T", v))
    rows = [("A:SupportsFloat", [n("E:float")]), ("E:float", [n("E:<module 'm'>"), t("."), t("sqrt"), t("("), n("A:SupportsFloat"), t(")")]), ("E:<module 'm'>", [t("m")])]
    return spark.createDataFrame(rows, grammar.SCHEMA)


def test_fragment_round_trip(spark, tmp_path):
    p = small(spark)
    fragments.write_fragment(p, str(tmp_path / "m.cfg"), "m", {"note": "a b"})
    meta, got = fragments.read_fragments(spark, str(tmp_path / "m.cfg"))
    key = lambda df: {(r.lhs, tuple((s["kind"], s["value"]) for s in r.rhs)) for r in df.collect()}
    assert key(got) == key(p)
    assert {r.key: r.value for r in meta.collect()}["productions"] == "3"
    assert fragments.within_budget(got, 1).count() == 2


@pytest.mark.parametrize(("line", "reason"), [
    ("N00099 -> m", "undefined alias"), ("N00000 -> [ m", "bracket terminal"), ("START -> m", "START row"), ("broken row", "malformed row"), ("# productions: 77", "count of productions"),
    ("N00000 -> a.b", "composite terminal"), ("# symbol-N00000: E:int", "duplicate alias"), ("# symbol-X: E:int", "invalid alias"),
])
def test_fragment_rejects(spark, tmp_path, line, reason):
    f = tmp_path / "x.cfg"
    f.write_text(f"# some-library-cfg: 2\n# module: m\n# symbol-N00000: E:float\nN00000 -> m\n{line}\n")
    with pytest.raises(fragments.FragmentError, match=reason):
        fragments.read_fragments(spark, str(f))
    f.write_text("# module: m\nN00000 -> m\n")
    with pytest.raises(fragments.FragmentError, match="header"):
        fragments.read_fragments(spark, str(f))


def test_percent_names():
    name = "E:(_T, /) -> int + 1"
    assert fragments.decoded(fragments.encoded(name)) == name and " " not in fragments.encoded(name)


def test_events_and_manifest(spark, tmp_path):
    s = spark.createDataFrame([("apps", "train", "m", 3, 0, 1, "expression", ["x"], True), ("apps", "train", "n", 0, 0, 1, "expression", ["x"], True), ("apps", "test", "o", 1, 0, 1, "e", ["x"], False)],
                              "dataset string, split string, member string, line long, `column` long, candidate_index long, kind string, ground_truth array<string>, recognized boolean")
    records.write_events(s, str(tmp_path / "e"), "statement")
    (tmp_path / "e" / "more.txt").write_text('not json\n{"event": "rank", "member": "p", "line": 1, "column": 2, "dataset": "apps", "split": "train"}\n')
    got = {r.member for r in records.manifest(spark, str(tmp_path / "e"), "apps", "train").collect()}
    assert got == {"m", "p"}
    line = records.to_lines(s.limit(1), "statement").first().value
    assert list(json.loads(line)) == sorted(json.loads(line))


def test_gram_counts(spark, tmp_path):
    (tmp_path / "g").write_text("a b c d ::: 2\na b c d ::: 3\n")
    assert records.read_gram_counts(spark, str(tmp_path / "g")).first().n == 5
    (tmp_path / "h").write_text("a b c ::: 2\n")
    with pytest.raises(ValueError, match="malformed"):
        records.read_gram_counts(spark, str(tmp_path / "h"))
    (tmp_path / "i").write_text("\n")
    with pytest.raises(ValueError, match="no counts"):
        records.read_gram_counts(spark, str(tmp_path / "i"))


def test_stubs(spark, tmp_path):
    for name in ("numpy/__init__.py", "numpy-stubs/__init__.pyi", "os.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("")
    best = {r.module: r.path.rsplit("/", 2)[-2] for r in corpora.best_stubs(corpora.discover_stubs(spark, str(tmp_path))).collect()}
    assert best["numpy"] == "numpy-stubs" and "os" in best


def test_caches(spark):
    f = spark.createDataFrame([("a",), ("b",)], "digest string")
    assert [r.digest for r in records.unparsed(f, f.filter("digest = 'a'")).collect()] == ["b"]
    lines = spark.createDataFrame([("py", "r", "s", "p", 2, "late"), ("py", "r", "s", "p", 1, "early")], "language string, repo string, sha string, path string, line_no int, v string")
    assert [r.v for r in records.first_by_identity(lines).collect()] == ["early"]


def test_precedence_keeps_unary_from_receivers(spark):
    n = lambda v: ("N", v)
    p = spark.createDataFrame([("E:int", [("T", "~"), n("E:int")]), ("E:m", [n("E:int"), ("T", "."), ("T", "member")]), ("E:int", [("T", "0")])], grammar.SCHEMA)
    got = {(r.lhs, tuple(s["value"] for s in r.rhs)) for r in precedence.lowered(p).collect()}
    assert {("F:int", ("~", "F:int")), ("P:m", ("P:int", ".", "member")), ("P:int", ("0",)), ("E:int", ("S:int",)), ("W:int", ("P:int",))} <= got


def test_running_totals_survive_repeats(spark, tmp_path):
    schema = "source string, recognized long, evaluated long, precision_accepted long, precision_checked long, precision_requested long"
    t = RunningTotals(spark, str(tmp_path / "t"), ["source"])
    a, b = (spark.createDataFrame([("s", i, 10, 0, 0, 0)], schema) for i in (1, 2))
    t.update(a, 0)
    t.update(b, 1)
    t.update(b, 1)  # the batch is delivered again after a restart
    assert t.totals().first().recognized == 3
    src = tmp_path / "in"
    a.write.parquet(str(src))
    stream = RunningTotals(spark, str(tmp_path / "u"), ["source"])
    read = lambda: spark.readStream.schema(schema).parquet(str(src))
    stream.start(read(), str(tmp_path / "c")).awaitTermination()
    b.write.mode("append").parquet(str(src))
    stream.start(read(), str(tmp_path / "c")).awaitTermination()  # goes on where it stopped
    assert stream.totals().first().recognized == 3


def test_quarantine(spark):
    df = spark.createDataFrame([(1, "2"), (2, "x")], "k int, v string")
    got = {r.k: (r.n, r.status, r.error) for r in quarantined(df, lambda row: {"n": int(row["v"])}, "n bigint", "k").collect()}
    assert got[1] == (2, "ok", None) and got[2][1] == "failed" and "ValueError" in got[2][2]
