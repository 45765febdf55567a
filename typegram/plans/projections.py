"""Queries of projections to productions, name resolution and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from typegram.operators import calls, diagnostics, grammar, monomorph, relations, semantic, types
from typegram.plans.grammars import catalog
from typegram.plans.joins import _text
from typegram.plans.registry import query
from typegram.session import table
from typegram.sources import records


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("member_productions", """
SELECT DISTINCT p_type AS lhs, p_brand || ' . f' || p_size AS rhs_text FROM part UNION SELECT DISTINCT p_brand, p_brand || ' ( ' || p_type || ' , int )' FROM part
""")
def member_productions(spark, sf_dir):
    p = _parts(spark, sf_dir)
    m = calls.member_productions(p.select(F.col("p_brand").alias("owner"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("name"), F.col("p_type").alias("type")))
    c = calls.constructor_productions(p.select(F.col("p_brand").alias("type"), F.array("p_type", F.lit("int")).alias("params")))
    return _text(m.unionByName(c))


@query("cpp_productions", """
SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN p_brand ELSE p_type END AS lhs, CASE p_size % 5 WHEN 0 THEN p_brand || ' ( int )' WHEN 1 THEN p_brand || ' . get ( int )' WHEN 2 THEN p_brand || ' :: get ( int )'
 WHEN 3 THEN p_brand || ' ( int )' ELSE 'get ( int )' END AS rhs_text FROM part
""")
def cpp_productions(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("constructor", "method", "static", "invocation", "function")))
    p = _parts(spark, sf_dir).select(F.col("p_brand").alias("owner"), F.lit("get").alias("name"), F.get(kinds, F.col("p_size") % 5).alias("kind"), F.col("p_type").alias("result"), F.array(F.lit("int")).alias("params"))
    return _text(calls.cpp_productions(p))


@query("supported_calls", """
SELECT p_brand AS owner, 'f' || p_size AS name, p_size % 6 AS arity, count(*) AS n FROM part WHERE p_type <> 'PROMO' AND p_size % 6 <= 3 GROUP BY ALL
""")
def supported_calls(spark, sf_dir):
    """Promotions are not public; calls of more than three arguments are left out."""
    p = _parts(spark, sf_dir).select(
        F.col("p_brand").alias("owner"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("name"), F.array_repeat(F.lit("int"), F.col("p_size") % 6).alias("params"),
        F.when(F.col("p_type") == "PROMO", "private").otherwise("public").alias("access"), F.lit(False).alias("is_varargs"), F.lit(False).alias("is_synthetic"), F.lit(None).cast("boolean").alias("is_bridge"))
    return calls.supported(p).groupBy("owner", "name", F.size("params").alias("arity")).agg(F.count("*").alias("n"))


@query("cpp_slots", """
SELECT DISTINCT p_type || '|' || p_size % 4 AS key, CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type || '&' WHEN 2 THEN p_type || '&&' ELSE p_type END AS slot FROM part
""")
def cpp_slots(spark, sf_dir):
    k = F.col("p_size") % 4
    s = F.when(k == 0, F.concat(F.lit("const "), "p_type", F.lit("&"))).when(k == 1, F.concat("p_type", F.lit("&"))).when(k == 2, F.concat("p_type", F.lit("&&"))).otherwise(F.concat(F.lit("const "), "p_type"))
    return _parts(spark, sf_dir).select(F.concat_ws("|", "p_type", k.cast("string")).alias("key"), types.cpp_slot(s).alias("slot")).distinct()


@query("base_rules", "SELECT DISTINCT p_type AS lhs, p_brand AS rhs_text FROM part")
def base_rules(spark, sf_dir):
    e = _parts(spark, sf_dir).select(F.col("p_type").alias("super_key"), F.col("p_brand").alias("sub_key"))
    return _text(calls.base_rules(e.unionByName(e.select("super_key", F.col("super_key").alias("sub_key")))))


@query("grouping_rules", "SELECT DISTINCT p_type AS lhs, '( ' || p_type || ' )' AS rhs_text FROM part")
def grouping_rules(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return _text(calls.grouping_rules(grammar.productions(p, F.col("p_type"), grammar.symbol("T", F.col("p_brand")))))


@query("erased_cover", """
WITH t AS (SELECT DISTINCT p_type || '<' || p_brand || '>' AS type, p_type AS e FROM part UNION SELECT DISTINCT p_type, p_type FROM part WHERE p_size = 1)
SELECT type FROM t WHERE type = e OR e NOT IN (SELECT type FROM t)
""")
def erased_cover(spark, sf_dir):
    p = _parts(spark, sf_dir)
    t = p.select(F.concat("p_type", F.lit("<"), "p_brand", F.lit(">")).alias("type")).union(p.filter("p_size = 1").select("p_type")).distinct()
    return monomorph.erased_cover(t)


@query("production_index", """
WITH RECURSIVE catalog AS (SELECT DISTINCT 'N:' || n_name AS lhs, 'C:' || c_custkey AS v FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT DISTINCT 'C:' || o_custkey, 'O:' || o_orderkey FROM orders
 UNION SELECT DISTINCT 'START', 'R:' || r_name FROM region UNION SELECT DISTINCT 'R:' || r_name, 'N:' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT 'O:' || o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT lhs AS key, count(*)::INT AS members, min(v) AS first FROM catalog GROUP BY lhs
""")
def production_index(spark, sf_dir):
    i = grammar.indexed_by(catalog(spark, sf_dir), "lhs")
    return i.select("key", F.size("members").alias("members"), F.col("members")[0]["rhs_text"].alias("first"))


@query("name_precedence", """
SELECT member AS name, source_id, language FROM corpus WHERE member IN (SELECT member FROM source_sample) QUALIFY row_number() OVER (PARTITION BY member ORDER BY (url IS NOT NULL) DESC, source_id) = 1
""")
def name_precedence(spark, sf_dir):
    names = table(spark, sf_dir, "source_sample").select(F.col("member").alias("name")).dropna()
    c = table(spark, sf_dir, "corpus").select(F.col("member").alias("name"), "source_id", "language", F.col("url").isNotNull().alias("exact"))
    return relations.with_precedence(names, c, [F.desc("exact"), F.col("source_id")]).drop("exact")


@query("preferred_names", """
SELECT s_suppkey, coalesce('nation ' || n_name, s_nationkey::VARCHAR) AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_name < 'K') ON n_nationkey = s_nationkey
""")
def preferred_names(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation"))
    p = table(spark, sf_dir, "nation").filter("n_name < 'K'").select(F.col("n_nationkey").cast("string").alias("canonical"), F.concat(F.lit("nation "), "n_name").alias("display"))
    return relations.preferred_names(s, "nation", p)


@query("resolved_imports", """
WITH RECURSIVE up(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT up.doc_id, d.parent_id FROM up JOIN documents d ON d.doc_id = up.node JOIN documents p ON p.doc_id = d.parent_id)
SELECT up.doc_id AS symbol, node AS definition FROM up JOIN documents d ON d.doc_id = node WHERE d.parent_id IS NULL
""")
def resolved_imports(spark, sf_dir):
    """Every post follows its parent, as an import follows its re-exports, to the first post that has none; lost parents end nowhere."""
    d = table(spark, sf_dir, "documents").select("doc_id", "parent_id")
    edges = d.filter("parent_id IS NOT NULL").select(F.col("doc_id").alias("symbol"), F.col("parent_id").alias("target"), F.lit(0).alias("rank"))
    return relations.resolved_imports(edges, d.filter("parent_id IS NULL").select(F.col("doc_id").alias("symbol")))


@query("active_fragments", """
WITH RECURSIVE known(node) AS (SELECT 'B:' || p_brand FROM part WHERE p_size = 1 UNION SELECT 'S:' || p_size FROM known JOIN part ON node = 'B:' || p_brand WHERE p_size <> 1)
SELECT DISTINCT substr(node, 3) AS module FROM known WHERE node LIKE 'S:%'
""")
def active_fragments(spark, sf_dir):
    """Sizes are fragments that need a brand; brands with a part of size 1 are there from the start."""
    p = _parts(spark, sf_dir)
    b, s = F.concat(F.lit("B:"), "p_brand"), F.concat(F.lit("S:"), F.col("p_size").cast("string"))
    own = grammar.productions(p.filter("p_size = 1"), b, grammar.symbol("T", F.col("p_brand")))
    rows = p.filter("p_size <> 1").select(F.col("p_size").cast("string").alias("module"), s.alias("lhs"), F.array(grammar.symbol("N", b)).alias("rhs")).distinct()
    return semantic.active_fragments(rows, own)


@query("unresolved_names", """
SELECT DISTINCT member, regexp_extract(failure_message, '(\\w+)', 1) AS name FROM rank_outcome WHERE failure = 'EvaluationError' AND regexp_extract(failure_message, '(\\w+)', 1) <> '' AND member IS NOT NULL
""")
def unresolved_names(spark, sf_dir):
    word = F.regexp_extract("failure_message", r"(\w+)", 1)
    r = table(spark, sf_dir, "rank_outcome").filter("failure IS NOT NULL AND member IS NOT NULL").select(
        "member", F.when(F.col("failure") == "EvaluationError", "unresolved-reference").otherwise("other").alias("code"), F.format_string("Name `%s` used", word).alias("message"))
    return diagnostics.unresolved_names(r)


@query("failure_records", """
WITH s AS (SELECT DISTINCT outcome_id, member FROM rank_outcome), r AS (SELECT DISTINCT outcome_id, tokens FROM rank_outcome WHERE failure IS NULL)
SELECT s.outcome_id, member, coalesce(tokens, 0) AS tokens, r.outcome_id IS NOT NULL AS recognized FROM s LEFT JOIN r USING (outcome_id)
""")
def failure_records(spark, sf_dir):
    r = table(spark, sf_dir, "rank_outcome")
    done = r.filter("failure IS NULL").select("outcome_id", "tokens", F.lit(True).alias("recognized")).distinct()
    return diagnostics.with_failures(r.select("outcome_id", "member").distinct(), done, "outcome_id", ["tokens"])


@query("event_lines", """
SELECT event_id, json_object('event', 'start', 'event_id', event_id, 'kind', event_type, 'user', user_id)::VARCHAR AS value FROM events
""")
def event_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("user"))
    lines = records.to_lines(e, "start")
    return lines.select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), "value")
