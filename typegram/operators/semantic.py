"""Grammar rows of a typing context: scope names, members, calls, operators, subscripts, families, assembly.

Types are nonterminals E:<type>, argument slots A:<type>. Input relations come from a type checker: scope_name(name, type),
completion(receiver, name, type), signature(callable, result, params), checked words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typegram.operators import grammar as g
from typegram.operators.assign import binary_results, elements, generic, links
from typegram.operators.calls import LITERALS, SLICES
from typegram.operators.prune import generating, useful
from typegram.session import cut

DYNAMIC = ("Any", "Unknown")
UNARY = ("+", "-", "~")
NUMERIC = ("bool", "int", "float", "complex")
#: Types whose values compare with themselves (fixed values).
COMPARABLE = ("bool", "int", "float", "str", "bytes")


def e(c: Column | str) -> Column:
    return F.concat(F.lit("E:"), F.lit(c) if isinstance(c, str) else c)


def a(c: Column | str) -> Column:
    return F.concat(F.lit("A:"), F.lit(c) if isinstance(c, str) else c)


def _rows(spark: SparkSession, rows: Sequence[tuple[str, Sequence[tuple[str, str]]]]) -> DataFrame:
    return spark.createDataFrame([(x, list(y)) for x, y in rows], g.SCHEMA)


def literals(spark: SparkSession) -> DataFrame:
    return _rows(spark, [(f"E:{t}", [("T", x)]) for t, xs in LITERALS["python"].items() for x in xs])


def scope_rules(names: DataFrame, builtins: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of typed names, and names of dynamic type apart. Built-in names count when they are listed; private ones never."""
    n = names.filter(~F.col("name").startswith("_"))
    if builtins:
        n = n.filter(~F.coalesce("is_builtin", F.lit(False)) | F.col("name").isin(*builtins))
    typed = n.filter(~F.col("type").isin(*DYNAMIC))
    return g.productions(typed, e(F.col("type")), g.symbol("T", F.col("name"))), n.filter(F.col("type").isin(*DYNAMIC)).select("name")


def member_rules(types: DataFrame, completions: DataFrame) -> DataFrame:
    c = completions.join(types.select(F.col("type").alias("receiver")), "receiver", "left_semi")
    return g.productions(c, e(F.col("type")), g.symbol("N", e(F.col("receiver"))), g.symbol("T", "."), g.symbol("T", F.col("name")))


def call_rules(layouts: DataFrame) -> DataFrame:
    """E:result -> E:callable ( A:type , name = A:type ) of layouts(callable, result, positional, keywords).

    map is built apart (correlated_rules); a dynamic result gets a family of its own (family_rules).
    """
    n = lambda v: F.struct(F.lit("N").alias("kind"), v.alias("value"))
    t = lambda v: F.struct(F.lit("T").alias("kind"), (F.lit(v) if isinstance(v, str) else v).alias("value"))
    slot = lambda c, x: (F.when((c == "dict") & (x == "object"), F.lit("A:__dict_source__")).when((c == "sum") & x.startswith("Iterable"), F.lit("A:__numeric_iterable__"))
                         .when(c == "sum", F.lit("A:__numeric__")).otherwise(F.concat(F.lit("A:"), x)))
    c = F.col("callable")
    args = F.concat(F.transform("positional", lambda x: F.array(n(slot(c, x)))), F.transform("keywords", lambda k: F.array(t(k["name"]), t("="), n(F.concat(F.lit("A:"), k["type"])))))
    flat = F.flatten(F.transform(args, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.array(t(",")), x))))
    return layouts.filter(c != "map").select(e(F.col("result")).alias("lhs"), F.concat(F.array(n(e(c)), t("(")), flat, F.array(t(")"))).alias("rhs")).distinct()


def extremes(types: DataFrame, max_arity: int) -> DataFrame:
    """min and max: one shared comparable type for all of 2 to max_arity arguments, and one iterable of it."""
    n = lambda v: F.struct(F.lit("N").alias("kind"), v.alias("value"))
    t = lambda v: F.struct(F.lit("T").alias("kind"), F.lit(v).alias("value"))
    own = types.filter(F.col("type").isin(*COMPARABLE)).select("type", F.explode(F.array(F.lit("min"), F.lit("max"))).alias("f"))
    many = own.withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(max_arity))))
    head = F.array(F.struct(F.lit("T").alias("kind"), F.col("f").alias("value")), t("("))
    args = F.flatten(F.transform(F.array_repeat(F.col("type"), F.col("k")), lambda x, i: F.when(i == 0, F.array(n(e(x)))).otherwise(F.array(t(","), n(e(x))))))
    one = F.concat(head, F.array(n(F.concat(F.lit("A:Iterable["), "type", F.lit("]"))), t(")")))
    return many.select(e(F.col("type")).alias("lhs"), F.concat(head, args, F.array(t(")"))).alias("rhs")).unionByName(
        own.select(e(F.col("type")).alias("lhs"), one.alias("rhs"))).distinct()


def unary_rules(types: DataFrame) -> DataFrame:
    ops = F.explode(F.array(*map(F.lit, UNARY)))
    t = types.filter(F.col("type").isin(*NUMERIC)).select("type", ops.alias("op")).filter("op <> '~' OR type IN ('bool', 'int')")
    return g.productions(t, e(F.when(F.col("type") == "bool", "int").otherwise(F.col("type"))), g.symbol("T", F.col("op")), g.symbol("N", e(F.col("type"))))


def subscript_rules(types: DataFrame) -> DataFrame:
    """Indexing and the twelve slices of sequences, items of mappings."""
    import pandas as pd

    sequences = ("str", "bytes", "list", "tuple", "range")

    def run(batches):
        for pdf in batches:
            rows = []
            for x in pdf["type"]:
                base, args = generic(x)
                n, i = ("N", f"E:{x}"), ("N", "E:int")
                if base in sequences:
                    inner = elements(base, args)
                    for item in dict.fromkeys(inner if inner is not None else ("Unknown",)):
                        rows.append((f"E:{item}", [n, ("T", "["), i, ("T", "]")]))
                    rows += [(f"E:{x}", [n, ("T", "["), *(i if c == "i" else ("T", c) for c in s), ("T", "]")]) for s in SLICES]
                elif base in ("dict", "defaultdict") and len(args) == 2:
                    rows.append((f"E:{args[1]}", [n, ("T", "["), ("N", f"A:{args[0]}"), ("T", "]")]))
            yield pd.DataFrame(rows, columns=["lhs", "rhs"])

    return types.select("type").distinct().mapInPandas(run, g.SCHEMA).distinct()


def binary_rules(types: DataFrame) -> DataFrame:
    """E:result -> E:left op E:right of all defined pairs of built-in types."""
    n = lambda c: g.symbol("N", e(F.col(c)))
    return g.productions(binary_results(types), e(F.col("result")), n("left"), g.symbol("T", F.col("op")), n("right")).distinct()


def correlated_rules(callables: DataFrame, types: DataFrame) -> DataFrame:
    """map(f, it): the callback's parameter and the iterable's element are one type; then list, tuple, sorted of iterables,
    each step over the types the steps before made; sorted also with reverse=, and reversed and heappop of lists."""
    import pandas as pd

    m = callables.filter(F.size("params") == 1).select("callable", "result", F.get("params", F.lit(0)).alias("p"))
    t, n = (lambda v: g.symbol("T", v)), (lambda c: g.symbol("N", c))
    mapped = F.concat(F.lit("map["), "result", F.lit("]"))
    rows = g.productions(m, e(mapped), t("map"), t("("), n(e(F.col("callable"))), t(","), n(F.concat(F.lit("A:Iterable["), "p", F.lit("]"))), t(")"))
    pool = types.select("type").unionByName(m.select(mapped.alias("type"))).distinct()

    def wrap(name: str, keep_list: bool):
        def run(batches):
            for pdf in batches:
                out = []
                for x in pdf["type"]:
                    base, args = generic(x)
                    inner = elements(base, args)
                    if inner and base not in ("ValuesView", "ItemsView"):
                        for item in dict.fromkeys(inner):
                            to = f"list[{item}]" if keep_list else f"tuple[{item}, ...]"
                            out.append((f"E:{to}", [("T", name), ("T", "("), ("N", f"E:{x}"), ("T", ")")], to))
                yield pd.DataFrame(out, columns=["lhs", "rhs", "type"])

        return run

    reverse = lambda p: p.filter("exists(rhs, s -> s.value = 'sorted')").select(
        "lhs", F.concat(F.slice("rhs", F.lit(1), F.size("rhs") - 1), F.array(*(g.symbol("T", x) for x in (",", "reverse", "="))), F.array(g.symbol("N", "A:bool"), g.symbol("T", ")"))).alias("rhs"))
    for name, as_list in (("tuple", False), ("list", True), ("sorted", True)):
        made = cut(pool.mapInPandas(wrap(name, as_list), f"{g.SCHEMA}, type string").distinct())
        rows = rows.unionByName(made.select("lhs", "rhs"))
        pool = cut(pool.unionByName(made.select("type")).distinct())
    item = F.regexp_extract("type", r"\Alist\[(.*)\]\z", 1)
    lists = pool.filter(F.col("type").rlike(r"\Alist\[.*\]\z")).select("type", item.alias("item"))
    back = g.productions(lists, e(F.concat(F.lit("reversed["), "item", F.lit("]"))), t("reversed"), t("("), n(e(F.col("type"))), t(")"))
    least = g.productions(lists, e(F.col("item")), t("heappop"), t("("), n(e(F.col("type"))), t(")"))
    return rows.unionByName(reverse(rows)).unionByName(back).unionByName(least).distinct()


def family_rules(producers: DataFrame) -> DataFrame:
    """One nonterminal per (dynamic type, producer), named by digest, as a unit row of the displayed type.

    producers(type, producer, declared): only callables declared in the source are trusted to be composed further.
    """
    digest = F.concat(F.lit("E:__family_"), F.substring(F.sha2(F.concat_ws("\0", "type", "producer"), 256), 1, 16))
    rows = producers.withColumn("family", digest)
    shown = g.productions(rows, e(F.col("type")), g.symbol("N", F.col("family")))
    trusted = g.productions(rows.filter("declared"), F.lit("E:__trusted_family__"), g.symbol("N", F.col("family")))
    return shown.unionByName(trusted).distinct()


def composed_dynamic(names: DataFrame, accepted: DataFrame, depth: int, budget: int) -> DataFrame:
    """Dynamic words from exact names by zero-argument calls and unary signs, kept when accepted(word) has them.

    The depth and token bounds are part of the language, which is finite; each round extends the last round only.
    """
    base = names.select(F.col("name").alias("word"), F.lit(1).alias("tokens"))
    out = frontier = cut(base)
    for _ in range(depth):
        grown = frontier.select(F.explode(F.array(
            F.struct(F.concat("word", F.lit(" ( )")).alias("word"), (F.col("tokens") + 2).alias("tokens")),
            *(F.struct(F.concat(F.lit(op + " "), "word").alias("word"), (F.col("tokens") + 1).alias("tokens")) for op in UNARY))).alias("x")).select("x.*")
        frontier = cut(grown.filter(F.col("tokens") <= budget).join(accepted, "word", "left_semi").join(out.select("word"), "word", "left_anti").distinct())
        out = cut(out.unionByName(frontier))
    return out.select(F.lit("E:__dynamic__").alias("lhs"), F.transform(F.split("word", " "), lambda x: F.struct(F.lit("T").alias("kind"), x.alias("value"))).alias("rhs"))


def active_fragments(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Modules of rows(module, lhs, rhs) that become productive beside own rows, until none is added."""
    active = cut(rows.select("module").distinct().limit(0))
    for _ in range(1000):
        base = own.unionByName(rows.join(active, "module", "left_semi").select("lhs", "rhs"))
        known = cut(generating(base).withColumnRenamed("node", "need"))
        needs = rows.join(active, "module", "left_anti").select("module", F.explode(F.filter("rhs", lambda s: s["kind"] == "N")).alias("s")).select("module", F.col("s.value").alias("need")).distinct()
        inside = rows.select("module", F.col("lhs").alias("need")).distinct()
        outside = needs.join(inside, ["module", "need"], "left_anti")
        ready = cut(outside.join(known, "need", "left_semi").select("module").distinct())
        if ready.isEmpty():
            return active
        active = cut(active.unionByName(ready))
    raise RuntimeError("fragments never settle")


def finished(parts: Sequence[DataFrame], expected: DataFrame, root: str = g.START) -> DataFrame:
    """Union of the parts with assignability links for their slots, roots for the expected types, and only useful rows."""
    p = parts[0]
    for x in parts[1:]:
        p = p.unionByName(x)
    p = cut(p.distinct())
    symbols = p.select(F.explode(F.concat(F.array("lhs"), F.transform("rhs", lambda s: s["value"]))).alias("s"), F.col("rhs"))
    types = symbols.filter(F.col("s").startswith("E:")).select(F.expr("substring(s, 3)").alias("type")).distinct()
    slots = p.select(F.explode(F.filter("rhs", lambda s: (s["kind"] == "N") & s["value"].startswith("A:"))).alias("x")).select(F.expr("substring(x.value, 3)").alias("slot")).distinct()
    exact = slots.join(types.withColumnRenamed("type", "slot"), "slot", "left_semi").select(F.col("slot").alias("expected"), F.col("slot").alias("actual"))
    linked = g.productions(links(types, slots).unionByName(exact), a(F.col("expected")), g.symbol("N", e(F.col("actual"))))
    roots = g.productions(expected, F.lit(root), g.symbol("N", e(F.col("type"))))
    return useful(cut(p.unionByName(linked).unionByName(roots).distinct()), root)


def refined_roots(p: DataFrame, verdicts: DataFrame, root: str = g.START) -> DataFrame:
    """Without the roots whose witness was rejected: verdicts(symbol, accepted)."""
    bad = verdicts.filter("NOT accepted").select("symbol")
    is_root = (F.col("lhs") == root) & (F.size("rhs") == 1)
    tagged = p.withColumn("symbol", F.when(is_root, F.col("rhs")[0]["value"]))
    return tagged.join(bad, "symbol", "left_anti").select("lhs", "rhs")
