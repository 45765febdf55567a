"""Queries of joins over types, calls and runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from typegram.operators import assign, calls, diagnostics, grammar, layouts, monomorph, precedence, relations, types
from typegram.plans.grammars import _TRADE_CLOSURE, trade
from typegram.plans.registry import query
from typegram.session import table


def _text(p):
    return p.select("lhs", grammar.rhs_text().alias("rhs_text"))


@query("subtype_unit_rows", f"WITH RECURSIVE {_TRADE_CLOSURE} SELECT 'T' || dst AS lhs, 'T' || src AS rhs_text FROM c WHERE src <> dst")
def subtype_unit_rows(spark, sf_dir):
    e = trade(spark, sf_dir).select(*(F.concat(F.lit("T"), F.col(c).cast("string")).alias(c) for c in ("src", "dst")))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("type")).distinct()
    return _text(monomorph.subtype_rules(nodes, e))


#: Brands are generics over a variable bounded by the sizes they come in; sizes are the ground types.
_DOMAINS = """
bounds AS (SELECT DISTINCT p_brand AS generic, 'V' AS variable, 'S' || (p_size % 10) AS bound FROM part WHERE p_type = 'PROMO'),
ground AS (SELECT DISTINCT 'G' || p_size AS type, 'S' || (p_size % 10) AS super FROM part),
met AS (SELECT generic, variable, type FROM bounds JOIN ground ON super = bound),
need AS (SELECT generic, variable, count(*) AS n FROM bounds GROUP BY ALL),
domains AS (SELECT generic, variable, type FROM met JOIN need USING (generic, variable) GROUP BY generic, variable, type, n HAVING count(*) = n)"""


def _bounds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    first = p.filter("p_type = 'PROMO'").groupBy("p_brand").agg(F.min("p_size").alias("s"))
    ground = p.select(F.concat(F.lit("G"), F.col("p_size").cast("string")).alias("type"), F.concat(F.lit("S"), (F.col("p_size") % 10).cast("string")).alias("super")).distinct()
    bounds = first.select(F.col("p_brand").alias("generic"), F.lit("V").alias("variable"), F.concat(F.lit("S"), (F.col("s") % 10).cast("string")).alias("bound"))
    return bounds, ground.select("type"), ground.select(F.col("type").alias("src"), F.col("super").alias("dst"))


_ONE_BOUND = """
bounds AS (SELECT p_brand AS generic, 'V' AS variable, 'S' || (min(p_size) % 10) AS bound FROM part WHERE p_type = 'PROMO' GROUP BY p_brand),
ground AS (SELECT DISTINCT 'G' || p_size AS type, 'S' || (p_size % 10) AS super FROM part),
domains AS (SELECT generic, variable, type FROM bounds JOIN ground ON super = bound)"""


@query("parameterised_domains", f"""
WITH {_ONE_BOUND} SELECT DISTINCT generic || '.V' AS lhs, '@domain:' || generic || '.V' AS rhs_text FROM domains UNION SELECT '@domain:' || generic || '.V', type FROM domains
""")
def parameterised_domains(spark, sf_dir):
    return _text(monomorph.parameterised(None, monomorph.admissible(*(_bounds(spark, sf_dir)[i] for i in (1, 0, 2)))))


@query("monomorphised_calls", f"""
WITH {_ONE_BOUND} SELECT generic, 'Box<' || type || '>' AS result, 'Pair<' || type || ',' || type || '>' AS receiver, 'get' AS name, type || '|Int' AS params FROM domains
""")
def monomorphised_calls(spark, sf_dir):
    bounds, ground, edges = _bounds(spark, sf_dir)
    domains = monomorph.admissible(ground, bounds, edges)
    c = bounds.select("generic", F.lit("Box<V>").alias("result"), F.lit("Pair<V,V>").alias("receiver"), F.lit("get").alias("name"), F.array(F.lit("V"), F.lit("Int")).alias("params"))
    return monomorph.instantiated(c, monomorph.bindings(domains, 1)).withColumn("params", F.array_join("params", "|"))


@query("ground_types", """
WITH b AS (SELECT DISTINCT p_type AS type FROM part), l1 AS (SELECT 'List<' || type || '>' AS type FROM b UNION SELECT 'Map<' || a.type || ',' || c.type || '>' FROM b a, b c),
cut1 AS (SELECT type FROM l1 QUALIFY row_number() OVER (PARTITION BY split_part(type, '<', 1) ORDER BY type) <= 6) SELECT type, 0 AS depth FROM b UNION ALL SELECT type, 1 FROM cut1
""")
def ground_types(spark, sf_dir):
    base = table(spark, sf_dir, "part").select(F.col("p_type").alias("type")).distinct()
    cons = spark.createDataFrame([("List", 1), ("Map", 2)], "name string, arity int")
    return monomorph.ground_types(cons, base, 1, 6)


@query("inherited_methods", f"""
WITH RECURSIVE {_TRADE_CLOSURE}, r AS (SELECT src, dst FROM c UNION SELECT n_nationkey, n_nationkey FROM nation),
m AS (SELECT DISTINCT s_nationkey AS owner, 'f' || (s_suppkey % 17) AS signature FROM supplier) SELECT DISTINCT src AS type, signature FROM r JOIN m ON owner = dst
WHERE src IN (SELECT src FROM trade UNION SELECT dst FROM trade UNION SELECT owner FROM m)
""")
def inherited_methods(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("owner"), F.concat(F.lit("f"), (F.col("s_suppkey") % 17).cast("string")).alias("signature")).distinct()
    return monomorph.inherited_methods(trade(spark, sf_dir), m)


@query("external_types", """
SELECT DISTINCT problem_id AS name, 'KNOWN' AS kind FROM corpus WHERE problem_id IS NOT NULL UNION
SELECT problem_id, 'EXTERNAL' FROM rank_outcome WHERE problem_id IS NOT NULL AND problem_id NOT IN (SELECT problem_id FROM corpus WHERE problem_id IS NOT NULL)
""")
def external_types(spark, sf_dir):
    t = table(spark, sf_dir, "corpus").select(F.col("problem_id").alias("name"), F.lit("KNOWN").alias("kind")).dropna().distinct()
    b = table(spark, sf_dir, "rank_outcome").select(F.col("problem_id").alias("base")).dropna()
    return monomorph.external_types(b, t)


@query("member_fetch", """
SELECT 'fetched' AS status, member, source_id FROM corpus WHERE member IN (SELECT member FROM source_sample) UNION ALL
SELECT DISTINCT 'missing', member, NULL FROM source_sample WHERE member NOT IN (SELECT member FROM corpus WHERE member IS NOT NULL) AND member IS NOT NULL
""")
def member_fetch(spark, sf_dir):
    wanted = table(spark, sf_dir, "source_sample").select("member").dropna().distinct()
    got, missing = relations.fetch_members(table(spark, sf_dir, "corpus").select("member", "source_id"), wanted)
    return got.select(F.lit("fetched").alias("status"), "member", "source_id").unionByName(
        missing.select(F.lit("missing").alias("status"), "member", F.lit(None).cast("long").alias("source_id")))


@query("full_outer_merge", """
WITH a AS (SELECT member, min(language) AS language, min(problem_id) AS problem FROM corpus GROUP BY member), b AS (SELECT member, min(dataset) AS language, min(problem_id) AS problem FROM rank_outcome GROUP BY member)
SELECT coalesce(a.member, b.member) AS member, coalesce(a.language, b.language) AS language, coalesce(a.problem, b.problem) AS problem,
 CASE WHEN a.member IS NOT NULL AND b.member IS NOT NULL THEN 'both' WHEN a.member IS NOT NULL THEN 'left' ELSE 'right' END AS found_in FROM a FULL OUTER JOIN b ON a.member = b.member
""")
def full_outer_merge(spark, sf_dir):
    a = table(spark, sf_dir, "corpus").groupBy("member").agg(F.min("language").alias("language"), F.min("problem_id").alias("problem"))
    b = table(spark, sf_dir, "rank_outcome").groupBy("member").agg(F.min("dataset").alias("language"), F.min("problem_id").alias("problem"))
    return relations.outer_merged(a, b, ["member"], ["language", "problem"])


@query("priority_merge", """
SELECT member, origin, ref FROM (SELECT member, 'corpus' AS origin, source_id AS ref, 0 AS p FROM corpus UNION ALL SELECT member, 'stream', piece_no, 1 FROM source_sample UNION ALL SELECT member, 'ranks', outcome_id, 2 FROM rank_outcome)
WHERE member IS NOT NULL QUALIFY row_number() OVER (PARTITION BY member ORDER BY p, ref) = 1
""")
def priority_merge(spark, sf_dir):
    part = lambda t, name, ref: table(spark, sf_dir, t).select("member", F.lit(name).alias("origin"), F.col(ref).alias("ref")).filter("member IS NOT NULL")
    return relations.merged_by_priority([part("corpus", "corpus", "source_id"), part("source_sample", "stream", "piece_no"), part("rank_outcome", "ranks", "outcome_id")],
                                        ["member"], [F.col("ref")])


@query("name_collisions", """
SELECT DISTINCT repo AS name FROM corpus WHERE repo IN (SELECT repo FROM corpus WHERE language = 'cpp') AND repo NOT IN (SELECT repo FROM corpus WHERE language = 'json' AND repo IS NOT NULL)
""")
def name_collisions(spark, sf_dir):
    c = table(spark, sf_dir, "corpus").select("repo", "language").dropna()
    return relations.colliding_names(c.select(F.col("repo").alias("name")), c.filter("language = 'cpp'").select(F.col("repo").alias("token")),
                                     c.filter("language = 'json'").select(F.col("repo").alias("name")))


@query("compatibility_filter", """
SELECT scan_id::VARCHAR AS module FROM (SELECT DISTINCT scan_id, attempt, dataset, python_files, decode_failures FROM import_scan QUALIFY attempt = max(attempt) OVER (PARTITION BY scan_id))
WHERE dataset = 'apps' AND python_files >= 40 AND decode_failures = 0
""")
def compatibility_filter(spark, sf_dir):
    s = table(spark, sf_dir, "import_scan").groupBy("scan_id").agg(F.max_by(F.struct("dataset", "python_files", "decode_failures"), "attempt").alias("s"))
    long = s.select(F.col("scan_id").cast("string").alias("module"), F.explode(F.create_map(
        F.lit("dataset"), F.col("s.dataset"), F.lit("files"), F.col("s.python_files").cast("string"), F.lit("failures"), F.col("s.decode_failures").cast("string"))).alias("key", "value"))
    return relations.compatible(long, {"dataset": "apps"}, {"files": 40}, ["failures"])


@query("interval_overlap", """
WITH s AS (SELECT source, run_id AS id, (epoch_us(reported_at) // 1000000)::BIGINT AS begin, (epoch_us(reported_at) // 1000000)::BIGINT + workers * 3600 AS "end" FROM (SELECT DISTINCT source, run_id, reported_at, workers FROM aggregate_run)),
o AS (SELECT source, run_id AS other_id, begin AS "from", "end" AS "to" FROM (SELECT source, id AS run_id, begin, "end" FROM s))
SELECT source, id, other_id FROM s JOIN o USING (source) WHERE begin <= "to" AND "end" >= "from" AND id < other_id
""")
def interval_overlap(spark, sf_dir):
    r = table(spark, sf_dir, "aggregate_run").select("source", "run_id", "reported_at", "workers").distinct()
    sec = F.unix_seconds(F.col("reported_at").cast("timestamp"))
    s = r.select("source", F.col("run_id").alias("id"), sec.alias("begin"), (sec + F.col("workers") * 3600).alias("end"))
    o = r.select("source", F.col("run_id").alias("other_id"), sec.alias("from"), (sec + F.col("workers") * 3600).alias("to"))
    return relations.overlapping(s, o, "source", 4 * 3600).filter("id < other_id").select("source", "id", "other_id")


@query("prefix_containment", """
WITH n AS (SELECT DISTINCT replace(replace(member, '/', '.'), '.py', '') AS name FROM corpus), m AS (SELECT DISTINCT array_to_string(string_split(name, '.')[1:3], '.') AS module FROM n)
SELECT n.name, m.module FROM n JOIN m ON n.name = m.module OR starts_with(n.name, m.module || '.')
""")
def prefix_containment(spark, sf_dir):
    n = table(spark, sf_dir, "corpus").select(F.replace(F.replace("member", F.lit("/"), F.lit(".")), F.lit(".py"), F.lit("")).alias("name")).dropna().distinct()
    m = n.select(F.array_join(F.slice(F.split("name", r"\."), 1, 3), ".").alias("module")).distinct()
    return relations.prefix_matches(n, m)


@query("hint_matching", """
WITH t AS (SELECT DISTINCT member, problem_id, tokens FROM rank_outcome WHERE attempt = 1), h AS (SELECT DISTINCT member, problem_id, tokens FROM rank_outcome WHERE attempt = 2)
SELECT h.member, h.problem_id, h.tokens, CASE WHEN count(t.member) FILTER (WHERE (h.problem_id IS NULL OR h.problem_id = t.problem_id) AND (h.tokens IS NULL OR h.tokens = t.tokens)) > 0 THEN 'matched' ELSE 'stale' END AS status
FROM h LEFT JOIN t ON t.member = h.member GROUP BY ALL
""")
def hint_matching(spark, sf_dir):
    r = table(spark, sf_dir, "rank_outcome").select("member", "problem_id", "tokens", "attempt").distinct()
    t, h = (r.filter(F.col("attempt") == i).drop("attempt") for i in (1, 2))
    return relations.hinted(t, h, ["member"], ["problem_id", "tokens"])


@query("call_productions", """
SELECT DISTINCT p_type AS lhs, CASE p_size % 3 WHEN 0 THEN p_brand || ' . create ( ' || p_type || ' )' WHEN 1 THEN p_brand || ' . next ( ' || p_type || ' , ' || p_brand || ' )' ELSE 'make ( )' END AS rhs_text FROM part
""")
def call_productions(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_size") % 3
    c = p.select(F.col("p_type").alias("result"), F.when(k == 1, F.col("p_brand")).alias("receiver"), F.when(k == 0, F.col("p_brand")).alias("static_owner"),
                 F.when(k == 0, "create").when(k == 1, "next").otherwise("make").alias("name"),
                 F.when(k == 0, F.array("p_type")).when(k == 1, F.array("p_type", "p_brand")).otherwise(F.array().cast("array<string>")).alias("params"))
    return _text(calls.call_productions(c))


@query("operator_productions", """
WITH m AS (SELECT DISTINCT p_brand AS owner, ['__add__', '__len__', '__neg__', '__getitem__', '__contains__', '__iadd__', 'plain'][(p_size % 7) + 1] AS name, p_type AS result FROM part)
SELECT DISTINCT CASE name WHEN '__iadd__' THEN 'STMT' ELSE result END AS lhs, CASE name WHEN '__add__' THEN owner || ' + int' WHEN '__len__' THEN 'len ( ' || owner || ' )' WHEN '__neg__' THEN '- ' || owner
 WHEN '__getitem__' THEN owner || ' [ int ]' WHEN '__contains__' THEN 'int in ' || owner WHEN '__iadd__' THEN owner || ' += int' END AS rhs_text FROM m WHERE name <> 'plain'
""")
def operator_productions(spark, sf_dir):
    names = F.array(*map(F.lit, ("__add__", "__len__", "__neg__", "__getitem__", "__contains__", "__iadd__", "plain")))
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.get(names, F.col("p_size") % 7).alias("name"), F.col("p_type").alias("result")).distinct()
    none = F.array().cast("array<string>")
    return _text(calls.operator_productions(p.withColumn("params", F.when(F.col("name").isin("__len__", "__neg__"), none).otherwise(F.array(F.lit("int"))))))


@query("varargs_expansion", """
SELECT DISTINCT p_brand AS owner, CASE WHEN p_type = 'PROMO' THEN array_to_string(['int'] || list_transform(range(0, r), lambda x: 'str'), ',') ELSE 'int,str' END AS params FROM part, unnest(range(0, 4)) AS u(r)
""")
def varargs_expansion(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), (F.col("p_type") == "PROMO").alias("is_varargs")).distinct()
    return calls.expanded_varargs(p.withColumn("params", F.array(F.lit("int"), F.lit("str")))).select("owner", F.array_join("params", ",").alias("params")).distinct()


@query("arity_budgets", """
SELECT tokens, greatest(0, floor((tokens - 1 - 2) / 2))::INT AS budget, count(*) AS n FROM (SELECT DISTINCT outcome_id, tokens FROM rank_outcome) GROUP BY ALL
""")
def arity_budgets(spark, sf_dir):
    r = table(spark, sf_dir, "rank_outcome").select("outcome_id", "tokens").distinct()
    return r.groupBy("tokens", calls.arity_budget(F.col("tokens")).alias("budget")).agg(F.count("*").alias("n"))


@query("failure_classes", """
WITH r AS (SELECT DISTINCT outcome_id, failure, failure_message, attempt FROM rank_outcome),
c AS (SELECT outcome_id, CASE WHEN attempt % 2 = 0 THEN 'output-assignment' ELSE 'expression' END AS kind, CASE failure WHEN 'rank_timeout' THEN ['invalid-argument-type'] WHEN 'dfa_state_cap' THEN ['no-matching-overload', 'invalid-argument-type']
 WHEN 'EvaluationError' THEN ['unresolved-reference'] WHEN 'sample_timeout' THEN ['missing-argument'] WHEN 'grammar_production_cap' THEN ['unsupported-operator'] ELSE [] END AS codes FROM r)
SELECT outcome_id, CASE WHEN len(codes) = 0 AND kind = 'output-assignment' THEN 'downstream-output-contract' WHEN len(codes) = 0 THEN 'other' WHEN list_contains(codes, 'unresolved-reference') THEN 'local-name-resolution'
 WHEN list_contains(codes, 'no-matching-overload') THEN 'local-overload-generic-correlation' WHEN list_contains(codes, 'missing-argument') THEN 'local-call-layout'
 WHEN list_contains(codes, 'invalid-argument-type') THEN 'local-argument-assignability' WHEN list_contains(codes, 'unsupported-operator') THEN 'local-operator' END AS reason FROM c
""")
def failure_classes(spark, sf_dir):
    r = table(spark, sf_dir, "rank_outcome").select("outcome_id", "failure", "failure_message", "attempt").distinct()
    a = lambda *x: F.array(*map(F.lit, x))
    f = F.col("failure")
    codes = (F.when(f == "rank_timeout", a("invalid-argument-type")).when(f == "dfa_state_cap", a("no-matching-overload", "invalid-argument-type")).when(f == "EvaluationError", a("unresolved-reference"))
             .when(f == "sample_timeout", a("missing-argument")).when(f == "grammar_production_cap", a("unsupported-operator")).otherwise(F.array().cast("array<string>")))
    kind = F.when(F.col("attempt") % 2 == 0, "output-assignment").otherwise("expression")
    return r.select("outcome_id", diagnostics.failure_class(kind, codes, F.lit(""), F.lit(False)).alias("reason"))


@query("assignability_links", """
WITH b AS (SELECT DISTINCT replace(p_brand, '#', '_') AS b FROM part),
a AS (SELECT b, 'list[' || b || ']' AS actual, 'list' AS c FROM b UNION SELECT b, 'dict[' || b || ', bool]', 'dict' FROM b UNION SELECT b, 'tuple[' || b || ', str]', 'tuple' FROM b
      UNION SELECT b, 'list[set[' || b || ']] | deque[' || b || ']', 'union' FROM b UNION SELECT b, 'range', 'range' FROM b),
e AS (SELECT b, 'Iterable[' || b || ']' AS expected, 'I' AS p FROM b UNION SELECT b, 'Sequence[' || b || '] | None', 'S' FROM b UNION SELECT b, 'Mapping[' || b || ', float]', 'M' FROM b UNION SELECT b, 'MutableMapping[' || b || ', float]', 'X' FROM b
      UNION SELECT b, 'MutableSequence[' || b || ']', 'Q' FROM b UNION SELECT b, 'Iterable[' || b || ' | str]', 'U' FROM b UNION SELECT b, 'Sequence[Iterable[' || b || '] | ' || b || ']', 'N' FROM b),
k AS (SELECT 'list' AS c, unnest(['I', 'S', 'Q', 'U', 'N']) AS p UNION SELECT 'dict', unnest(['I', 'M', 'U']) UNION SELECT 'tuple', 'U' UNION SELECT 'union', 'N'),
f AS (SELECT unnest(['Sized', 'Hashable', 'Iterable[int]', 'object']) AS expected)
SELECT expected, actual FROM a JOIN k USING (c) JOIN e USING (b, p)
UNION SELECT expected, actual FROM a, f WHERE expected IN ('object', 'Sized') OR expected = 'Hashable' AND c IN ('tuple', 'range') OR expected = 'Iterable[int]' AND c = 'range'
""")
def assignability_links(spark, sf_dir):
    """Containers of brands against protocols of brands, and some of neither."""
    b = table(spark, sf_dir, "part").select(F.regexp_replace("p_brand", "#", "_").alias("b")).distinct()
    spelled = lambda *forms: b.select(F.explode(F.array(*(F.regexp_replace(F.lit(f), "B", F.col("b")) if "B" in f else F.lit(f) for f in forms))).alias("type")).distinct()
    actual = spelled("list[B]", "dict[B, bool]", "tuple[B, str]", "list[set[B]] | deque[B]", "range")
    expected = spelled("Iterable[B]", "Sequence[B] | None", "Mapping[B, float]", "MutableMapping[B, float]", "MutableSequence[B]", "Iterable[B | str]", "Sequence[Iterable[B] | B]", "Sized", "Hashable", "Iterable[int]", "object")
    return assign.links(actual, expected)


@query("argument_layouts", """
WITH s AS (SELECT DISTINCT p_brand AS callable, p_type AS t FROM part),
places AS (SELECT *, 'int' AS second, unnest([1, 2]) AS taken FROM s),
rest AS (SELECT *, unnest(range(0, 5 - taken)) AS repeats FROM places),
names AS (SELECT *, unnest(CASE taken WHEN 1 THEN [[], ['b = int'], ['flag = bool'], ['b = int', 'flag = bool'], ['flag = bool', 'b = int']] ELSE [[], ['flag = bool']] END) AS n FROM rest)
SELECT callable, callable || ' ( ' || array_to_string(list_concat(list_concat([t], CASE taken WHEN 2 THEN [second] ELSE [] END), list_concat(list_transform(range(0, repeats), lambda i: 'str'), n)), ' , ') || ' )' AS call
FROM names WHERE taken + repeats + len(n) <= 4
""")
def argument_layouts(spark, sf_dir):
    """Signatures of brand(type, size=, *rest, flag=) in all their layouts."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("callable"), F.col("p_type").alias("t")).distinct()
    s = F.struct
    q = lambda n, t, k, r: s(F.lit(n).alias("name"), t.alias("type"), F.lit(k).alias("kind"), F.lit(r).alias("required"))
    sig = p.select("callable", F.array(q("a", F.col("t"), "posonly", True), q("b", F.lit("int"), "poskw", False), q("rest", F.lit("str"), "vararg", False), q("flag", F.lit("bool"), "kwonly", False)).alias("params"))
    rows = layouts.with_layouts(sig, max_arity=4, max_layouts=64)
    return rows.select("callable", F.array_join(F.transform(layouts.call_symbols(F.col("callable")), lambda x: x["value"]), " ").alias("call"))


@query("precedence_layers", """
WITH t AS (SELECT DISTINCT p_type AS t FROM part) SELECT 'S:' || t AS lhs, 'S:' || t || ' + M:' || t AS rhs_text FROM t UNION SELECT 'M:' || t, 'M:' || t || ' * F:' || t FROM t UNION SELECT 'W:' || t, 'P:' || t || ' ** F:' || t FROM t
UNION SELECT 'F:' || t, '- F:' || t FROM t UNION SELECT 'P:' || t, 'P:' || t || ' . next' FROM t UNION SELECT 'P:' || t, '( E:' || t || ' )' FROM t
UNION SELECT 'E:' || t, 'S:' || t FROM t UNION SELECT 'S:' || t, 'M:' || t FROM t UNION SELECT 'M:' || t, 'F:' || t FROM t UNION SELECT 'F:' || t, 'W:' || t FROM t UNION SELECT 'W:' || t, 'P:' || t FROM t
""")
def precedence_layers(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.concat(F.lit("E:"), "p_type").alias("e")).distinct()
    n, s = grammar.symbol("N", F.col("e")), lambda x: grammar.symbol("T", x)
    rows = F.explode(F.array(F.array(n, s("+"), n), F.array(n, s("*"), n), F.array(n, s("**"), n), F.array(s("-"), n), F.array(n, s("."), s("next")), F.array(s("("), n, s(")"))))
    return _text(precedence.lowered(t.select(F.col("e").alias("lhs"), rows.alias("rhs"))))


@query("type_nodes", """
WITH t AS (SELECT DISTINCT p_type AS a, p_brand AS b FROM part), k AS (SELECT 'Map<' || b || ',List<' || a || '>>' AS key, 'Map' AS name, 2 AS depth FROM t UNION SELECT 'List<' || a || '>', 'List', 1 FROM t UNION SELECT a, a, 0 FROM t UNION SELECT b, b, 0 FROM t)
SELECT key AS type_key, name, depth FROM k
""")
def type_nodes(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.concat(F.lit("Map<"), "p_brand", F.lit(",List<"), "p_type", F.lit(">>")).alias("t")).distinct()
    return types.nodes(t, "t").select("type_key", "name", "depth")


@query("alias_resolution", """
SELECT l_shipmode, 'END' AS resolved, n FROM (SELECT 'A0' AS l_shipmode, count(*) AS n FROM lineitem WHERE l_linenumber = 1) UNION ALL SELECT 'A' || (l_linenumber - 1), 'END', count(*) FROM lineitem WHERE l_linenumber > 1 GROUP BY 1
""")
def alias_resolution(spark, sf_dir):
    """A0 -> A1 -> ... -> END, eight rounds at most."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("A"), (F.col("l_linenumber") - 1).cast("string")).alias("l_shipmode")).agg(F.count("*").alias("n"))
    aliases = spark.createDataFrame([(f"A{i}", f"A{i + 1}" if i < 7 else "END") for i in range(8)], "alias string, target string")
    return types.resolved_aliases(rows.withColumn("resolved", F.col("l_shipmode")), "resolved", aliases)


@query("slot_positions", """
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)::INT AS place FROM lineitem QUALIFY place <= 2
""")
def slot_positions(spark, sf_dir):
    """Cap of two per group under an explicit order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return li.withColumn("place", F.row_number().over(w)).filter("place <= 2").drop("l_extendedprice")
