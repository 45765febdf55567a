"""Queries of grammar relations, fixpoints, normal forms, recognition and counting."""

from __future__ import annotations

from pyspark.sql import functions as F

from typegram.operators import closure, cnf, counts, cyk, grammar, language, prune
from typegram.operators.ordering import take_per
from typegram.plans.registry import query
from typegram.session import table

_CATALOG = """
catalog AS (
  SELECT 'START' AS lhs, 'N' AS kind, 'R:' || r_name AS value FROM region
  UNION SELECT 'R:' || r_name, 'N', 'N:' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT 'N:' || n_name, 'N', 'C:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'C:' || o_custkey, 'N', 'O:' || o_orderkey FROM orders
  UNION SELECT 'O:' || o_orderkey, 'T', o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'
)"""


def catalog(spark, sf_dir):
    """START -> region -> nation -> customer -> order as unit productions; urgent orders alone have a terminal."""
    t = lambda n: table(spark, sf_dir, n)
    p, s = grammar.productions, grammar.symbol
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    rn = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nc = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = t("orders")
    parts = [p(t("region"), F.lit("START"), s("N", name("R:", "r_name"))), p(rn, name("R:", "r_name"), s("N", name("N:", "n_name"))),
             p(nc, name("N:", "n_name"), s("N", name("C:", "c_custkey"))), p(o, name("C:", "o_custkey"), s("N", name("O:", "o_orderkey"))),
             p(o.filter("o_orderpriority = '1-URGENT'"), name("O:", "o_orderkey"), s("T", F.col("o_orderpriority")))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()


def _one(p):
    """lhs, value of productions with a single symbol."""
    return p.select("lhs", F.col("rhs")[0]["kind"].alias("kind"), F.col("rhs")[0]["value"].alias("value"))


@query("grammar_stats", f"""
WITH {_CATALOG} SELECT count(*) AS productions, (SELECT count(*) FROM (SELECT lhs FROM catalog UNION SELECT value FROM catalog WHERE kind = 'N')) AS nonterminals,
 (SELECT count(DISTINCT value) FROM catalog WHERE kind = 'T') AS terminals, 2 * count(*) AS grammar_symbols FROM catalog
""")
def grammar_stats(spark, sf_dir):
    return grammar.stats(catalog(spark, sf_dir))


@query("start_rules", f"""
WITH {_CATALOG} SELECT * FROM catalog UNION SELECT 'START', 'N', lhs FROM catalog WHERE lhs <> 'START'
""")
def start_rules(spark, sf_dir):
    return _one(grammar.with_start(catalog(spark, sf_dir)))


@query("statement_root", f"""
WITH {_CATALOG}, l AS (SELECT DISTINCT lhs FROM catalog WHERE lhs NOT IN ('START', 'STMT')) SELECT lhs, value AS rhs_text FROM catalog UNION SELECT 'STMT', lhs || ' ;' FROM l UNION SELECT 'START', 'STMT'
""")
def statement_root(spark, sf_dir):
    return grammar.with_statement_root(catalog(spark, sf_dir)).select("lhs", grammar.rhs_text().alias("rhs_text"))


@query("grammar_text", f"""
WITH {_CATALOG} SELECT lhs, value AS rhs_text, lhs || ' -> ' || value AS line FROM catalog
""")
def grammar_text(spark, sf_dir):
    return grammar.text_lines(catalog(spark, sf_dir))


@query("grammar_set_ops", f"""
WITH {_CATALOG}, a AS (SELECT * FROM catalog WHERE lhs NOT LIKE 'O:%'), b AS (SELECT * FROM catalog WHERE lhs LIKE 'C:%' OR lhs LIKE 'O:%')
SELECT 'union' AS op, lhs, value FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'difference', lhs, value FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'intersection', lhs, value FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
""")
def grammar_set_ops(spark, sf_dir):
    c = catalog(spark, sf_dir)
    a, b = c.filter("lhs NOT LIKE 'O:%'"), c.filter("lhs LIKE 'C:%' OR lhs LIKE 'O:%'")
    parts = [_one(f(a, b)).select(F.lit(n).alias("op"), "lhs", "value") for n, f in
             (("union", grammar.union), ("difference", grammar.difference), ("intersection", grammar.intersection))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("reachable_symbols", f"""
WITH RECURSIVE {_CATALOG}, r(node) AS (SELECT 'START' UNION SELECT value FROM r JOIN catalog ON lhs = node WHERE kind = 'N') SELECT node FROM r
""")
def reachable_symbols(spark, sf_dir):
    return prune.reachable_symbols(catalog(spark, sf_dir))


_GENERATING = f"""{_CATALOG}, gen(node) AS (SELECT lhs FROM catalog WHERE kind = 'T' UNION SELECT lhs FROM gen JOIN catalog ON value = node WHERE kind = 'N')"""


@query("generating_symbols", f"WITH RECURSIVE {_GENERATING} SELECT node FROM gen")
def generating_symbols(spark, sf_dir):
    return prune.generating(catalog(spark, sf_dir))


@query("generating_productions", f"""
WITH RECURSIVE {_GENERATING} SELECT lhs, kind, value FROM catalog WHERE kind = 'T' OR value IN (SELECT node FROM gen)
""")
def generating_productions(spark, sf_dir):
    return _one(prune.generating_only(catalog(spark, sf_dir)))


@query("useful_productions", f"""
WITH RECURSIVE {_GENERATING}, kept AS (SELECT lhs, kind, value FROM catalog WHERE kind = 'T' OR value IN (SELECT node FROM gen)),
r(node) AS (SELECT 'START' UNION SELECT value FROM r JOIN kept ON lhs = node WHERE kind = 'N') SELECT lhs, kind, value FROM kept WHERE lhs IN (SELECT node FROM r)
""")
def useful_productions(spark, sf_dir):
    return _one(prune.useful(catalog(spark, sf_dir)))


@query("undefined_pruned", f"""
WITH {_CATALOG}, p4 AS (SELECT * FROM catalog WHERE kind = 'T' OR value IN (SELECT lhs FROM catalog)), p3 AS (SELECT * FROM p4 WHERE kind = 'T' OR value IN (SELECT lhs FROM p4)),
p2 AS (SELECT * FROM p3 WHERE kind = 'T' OR value IN (SELECT lhs FROM p3)), p1 AS (SELECT * FROM p2 WHERE kind = 'T' OR value IN (SELECT lhs FROM p2)),
p0 AS (SELECT * FROM p1 WHERE kind = 'T' OR value IN (SELECT lhs FROM p1)) SELECT lhs, kind, value FROM p0
""")
def undefined_pruned(spark, sf_dir):
    return _one(prune.defined_only(catalog(spark, sf_dir)))


@query("unit_closure", f"""
WITH RECURSIVE {_CATALOG}, n AS (SELECT lhs AS node FROM catalog UNION SELECT value FROM catalog WHERE kind = 'N'),
c(src, dst) AS (SELECT node, node FROM n UNION SELECT src, value FROM c JOIN catalog ON lhs = dst WHERE kind = 'N') SELECT src, dst FROM c
""")
def unit_closure(spark, sf_dir):
    return closure.closure(grammar.unit_edges(catalog(spark, sf_dir)))


@query("cnf_productions", f"""
WITH RECURSIVE {_GENERATING} SELECT 'START' AS lhs, '1-URGENT' AS rhs_text WHERE 'START' IN (SELECT node FROM gen)
""")
def cnf_productions(spark, sf_dir):
    return cnf.to_cnf(catalog(spark, sf_dir)).select("lhs", grammar.rhs_text().alias("rhs_text"))


#: Calls brand -> brand . type ( size ), four symbols and more on the right.
_CALLS = "calls AS (SELECT DISTINCT 'B:' || p_brand AS lhs, p_type AS name, 'S:' || p_size AS arg FROM part)"


def calls(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    b, s = F.concat(F.lit("B:"), "p_brand"), F.concat(F.lit("S:"), F.col("p_size").cast("string"))
    t = grammar.symbol
    return grammar.productions(p, b, t("N", b), t("T", "."), t("T", F.col("p_type")), t("T", "("), t("N", s), t("T", ")"))


@query("binarised_calls", f"""
WITH {_CALLS}, m AS (SELECT lhs, '@token:.' AS a, '@rest:@token:' || name || ' @token:( ' || arg || ' @token:)' AS r2, '@token:' || name AS n, '@rest:@token:( ' || arg || ' @token:)' AS r3, arg FROM calls)
SELECT lhs, lhs || ' @rest:@token:. ' || substr(r2, 7) AS rhs_text FROM m UNION SELECT '@rest:@token:. ' || substr(r2, 7), '@token:. ' || r2 FROM m UNION SELECT r2, n || ' ' || r3 FROM m
UNION SELECT r3, '@token:( @rest:' || arg || ' @token:)' FROM m UNION SELECT '@rest:' || arg || ' @token:)', arg || ' @token:)' FROM m
UNION SELECT '@token:' || x, x FROM (SELECT name AS x FROM calls UNION SELECT '.' UNION SELECT '(' UNION SELECT ')')
""")
def binarised_calls(spark, sf_dir):
    return cnf.binarised(calls(spark, sf_dir)).select("lhs", grammar.rhs_text().alias("rhs_text"))


#: Every nation with the three it buys most from: a directed graph over the whole trade.
_TRADE = """
flow AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
trade AS (SELECT src, dst FROM flow QUALIFY row_number() OVER (PARTITION BY src ORDER BY q DESC, dst) <= 3)"""


def trade(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    buyers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("src"))
    lines = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_quantity", F.col("s_nationkey").alias("dst"))
    flow = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src", "dst").agg(F.sum("l_quantity").alias("q"))
    return take_per(flow, ["src"], [F.desc("q"), F.col("dst")], 3).select("src", "dst")


_TRADE_CLOSURE = f"""{_TRADE}, c(src, dst) AS (SELECT src, dst FROM trade UNION SELECT c.src, t.dst FROM c JOIN trade t ON t.src = c.dst)"""
_COMPONENTS = f"""{_TRADE_CLOSURE}, nodes AS (SELECT src AS node FROM trade UNION SELECT dst FROM trade),
comp AS (SELECT n.node, least(n.node, coalesce(min(a.dst), n.node)) AS component FROM nodes n LEFT JOIN (SELECT a.src, a.dst FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src) a ON a.src = n.node GROUP BY n.node)"""


@query("supertypes", f"WITH RECURSIVE {_TRADE_CLOSURE} SELECT src AS type, dst AS super FROM c WHERE src <> dst")
def supertypes(spark, sf_dir):
    return closure.supertypes(trade(spark, sf_dir))


@query("scc_condensation", f"WITH RECURSIVE {_COMPONENTS} SELECT node, component FROM comp")
def scc_condensation(spark, sf_dir):
    return closure.components(trade(spark, sf_dir))


@query("scc_levels", f"""
WITH RECURSIVE {_COMPONENTS}, e AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM trade JOIN comp a ON a.node = src JOIN comp b ON b.node = dst WHERE a.component <> b.component),
walk(node, level) AS (SELECT src, 0 FROM (SELECT src FROM e UNION SELECT dst FROM e) UNION SELECT dst, level + 1 FROM walk JOIN e ON src = node)
SELECT node, max(level)::INT AS level FROM walk GROUP BY node
""")
def scc_levels(spark, sf_dir):
    return closure.longest_paths(closure.condensed(trade(spark, sf_dir)))


@query("downward_closure", f"""
WITH RECURSIVE {_TRADE}, r(node) AS (SELECT 0 UNION SELECT dst FROM r JOIN trade ON src = node) SELECT src, dst FROM trade WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r)
""")
def downward_closure(spark, sf_dir):
    return closure.downward(trade(spark, sf_dir), spark.createDataFrame([(0,)], "node int"))


_WORDS = """words AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS word_id, event_type AS token,
 row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)::INT AS pos FROM events)"""


def words(spark, sf_dir):
    """A word is what a user did on one day, in order."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("word_id"), F.col("event_type").alias("token"),
                    F.row_number().over(Window.partitionBy("user_id", day).orderBy("ts", "event_id")).alias("pos"))


TOKENS = ("click", "error", "purchase", "signup", "view")


def session_grammar(spark):
    """Sessions of two events or more that end with a purchase."""
    rows = [("START", ["A", "START"]), ("START", ["A", "B"]), ("B", ["purchase"]), *(("A", [t]) for t in TOKENS)]
    return grammar.from_rows(spark, rows)


@query("cyk_recognised_words", f"""
WITH {_WORDS} SELECT word_id, count(*) >= 2 AND arg_max(token, pos) = 'purchase' AS recognized FROM words GROUP BY word_id
""")
def cyk_recognised_words(spark, sf_dir):
    return cyk.recognised(words(spark, sf_dir), session_grammar(spark))


@query("parse_counts", f"""
WITH RECURSIVE {_WORDS}, catalan(n, c) AS (SELECT 1, 1::HUGEINT UNION ALL SELECT n + 1, c * 2 * (2 * n - 1) // (n + 1) FROM catalan WHERE n < 20)
SELECT word_id, c::BIGINT AS parses FROM (SELECT word_id, count(*) AS n FROM words GROUP BY word_id) JOIN catalan USING (n)
""")
def parse_counts(spark, sf_dir):
    rows = [("START", ["START", "START"]), *(("START", [t]) for t in TOKENS)]
    return cyk.parse_counts(words(spark, sf_dir), grammar.from_rows(spark, rows)).withColumn("parses", F.col("parses").cast("long"))


@query("inside_counts", """
WITH RECURSIVE catalan(n, c) AS (SELECT 1, 1::HUGEINT UNION ALL SELECT n + 1, c * 2 * (2 * n - 1) // (n + 1) FROM catalan WHERE n < 12),
p AS (SELECT count(*) AS priorities FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT 'START' AS symbol, n::INT AS length, (c * pow(priorities, n)::HUGEINT)::VARCHAR AS derivations FROM catalan, p
""")
def inside_counts(spark, sf_dir):
    """START -> START START, START -> each order priority."""
    t = grammar.productions(table(spark, sf_dir, "orders"), F.lit("START"), grammar.symbol("T", F.col("o_orderpriority")))
    p = t.unionByName(grammar.from_rows(spark, [("START", ["START", "START"])]))
    return counts.inside_counts(p, 12).withColumn("derivations", F.col("derivations").cast("string"))


@query("shortest_witness", f"""
WITH RECURSIVE {_GENERATING} SELECT node AS symbol, 1 AS length, '1-URGENT' AS word FROM gen
""")
def shortest_witness(spark, sf_dir):
    return counts.shortest_witness(catalog(spark, sf_dir)).withColumn("word", F.array_join("word", " "))


def mode_rules(spark, sf_dir):
    """One small grammar per return flag: STATUS pairs, with an ambiguous third symbol."""
    flags = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sort_array(F.collect_set("l_linestatus")).alias("s"))
    t = flags.select(F.col("l_returnflag").alias("grammar"), F.explode("s").alias("x")).select("grammar", F.lit("C").alias("lhs"), F.array("x").alias("rhs"))
    more = [("START", ["C", "C"]), ("START", ["C", "D"]), ("D", ["C", "C"]), ("D", ["START", "C"])]
    rules = F.explode(F.array(*(F.struct(F.lit(a).alias("lhs"), F.array(*map(F.lit, b)).alias("rhs")) for a, b in more))).alias("r")
    return t.unionByName(flags.select(F.col("l_returnflag").alias("grammar"), rules).select("grammar", "r.*"))


@query("language_size_by_length", """
WITH s AS (SELECT l_returnflag AS grammar, count(DISTINCT l_linestatus) AS k FROM lineitem GROUP BY 1)
SELECT grammar, n::INT AS length, CASE WHEN n < 2 THEN '0' ELSE (pow(k, n)::BIGINT)::VARCHAR END AS size FROM s, unnest([1, 2, 3, 4, 5, 6]) AS u(n)
""")
def language_size_by_length(spark, sf_dir):
    return language.sizes(mode_rules(spark, sf_dir), "grammar", 6).drop("log10")


@query("shortlex_ranks", """
WITH RECURSIVE s AS (SELECT DISTINCT l_returnflag AS grammar, l_linestatus AS t FROM lineitem),
w(grammar, n, word) AS (SELECT grammar, 1, t FROM s UNION ALL SELECT w.grammar, n + 1, word || ' ' || t FROM w JOIN s ON s.grammar = w.grammar WHERE n < 5)
SELECT grammar, word, row_number() OVER (PARTITION BY grammar ORDER BY n, word) - 1 AS rank0 FROM w WHERE n >= 2
""")
def shortlex_ranks(spark, sf_dir):
    import pandas as pd

    def f(key, lang):
        rows = [(key, " ".join(w), lang.shortlex_rank(w)) for n in range(1, 6) for w in lang.words(n)]
        return pd.DataFrame(rows, columns=["grammar", "word", "rank0"])

    return language.per_grammar(mode_rules(spark, sf_dir), "grammar", f, "grammar string, word string, rank0 bigint")


@query("unrank_sample", """
WITH RECURSIVE s AS (SELECT DISTINCT l_returnflag AS grammar, l_linestatus AS t FROM lineitem),
w(grammar, n, word) AS (SELECT grammar, 1, t FROM s UNION ALL SELECT w.grammar, n + 1, word || ' ' || t FROM w JOIN s ON s.grammar = w.grammar WHERE n < 5),
r AS (SELECT grammar, word, row_number() OVER (PARTITION BY grammar ORDER BY n, word) - 1 AS rank0 FROM w WHERE n >= 2)
SELECT grammar, rank0, word FROM r WHERE rank0 IN (0, 1, 2, 3)
""")
def unrank_sample(spark, sf_dir):
    import pandas as pd

    def f(key, lang):
        total = sum(lang.size(n) for n in range(1, 6))
        rows = [(key, r, " ".join(lang.shortlex_unrank(r, 5))) for r in range(min(4, total))]
        return pd.DataFrame(rows, columns=["grammar", "rank0", "word"])

    return language.per_grammar(mode_rules(spark, sf_dir), "grammar", f, "grammar string, rank0 bigint, word string")


@query("dafsa_edges")
def dafsa_edges(spark, sf_dir):
    import pandas as pd

    def f(key, lang):
        return pd.DataFrame([(key, *e) for e in lang.edges(4)], columns=["grammar", "state", "token", "child"])

    return language.per_grammar(mode_rules(spark, sf_dir), "grammar", f, "grammar string, state int, token string, child int")
