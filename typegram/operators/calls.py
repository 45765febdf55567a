"""Projections from API relations to productions: calls, members, operators, literals, varargs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typegram.operators.grammar import SCHEMA

#: Binary, in-place and unary operator methods with their signs (fixed values).
BINARY = {
    "__add__": "+", "__sub__": "-", "__mul__": "*", "__matmul__": "@", "__truediv__": "/", "__floordiv__": "//", "__mod__": "%", "__pow__": "**",
    "__lshift__": "<<", "__rshift__": ">>", "__and__": "&", "__or__": "|", "__xor__": "^",
    "__eq__": "==", "__ne__": "!=", "__lt__": "<", "__le__": "<=", "__gt__": ">", "__ge__": ">=",
}
IN_PLACE = {"__i" + k[2:]: v + "=" for k, v in BINARY.items() if v not in ("==", "!=", "<", "<=", ">", ">=")}
UNARY = {"__neg__": "-", "__pos__": "+", "__invert__": "~"}
FUNCTIONS = {"__len__": "len", "__abs__": "abs", "__iter__": "iter", "__reversed__": "reversed", "__str__": "str", "__repr__": "repr", "__bool__": "bool", "__hash__": "hash"}


def _n(v: Column) -> Column:
    return F.struct(F.lit("N").alias("kind"), v.alias("value"))


def _t(v: Column | str) -> Column:
    return F.struct(F.lit("T").alias("kind"), (F.lit(v) if isinstance(v, str) else v).alias("value"))


def _list(params: str) -> Column:
    """( a , b )"""
    sep = F.flatten(F.transform(params, lambda x, i: F.when(i == 0, F.array(_n(x))).otherwise(F.array(_t(","), _n(x)))))
    return F.concat(F.array(_t("(")), sep, F.array(_t(")")))


def invalid_calls(calls: DataFrame) -> DataFrame:
    """Calls with both a receiver and a static owner."""
    return calls.filter(F.col("receiver").isNotNull() & F.col("static_owner").isNotNull())


def call_productions(calls: DataFrame) -> DataFrame:
    """result -> receiver . name ( params ), owner . name ( params ) with the owner as token, or name ( params )."""
    head = (F.when(F.col("static_owner").isNotNull(), F.array(_t(F.col("static_owner")), _t("."), _t(F.col("name"))))
            .when(F.col("receiver").isNotNull(), F.array(_n(F.col("receiver")), _t("."), _t(F.col("name")))).otherwise(F.array(_t(F.col("name")))))
    return calls.select(F.col("result").alias("lhs"), F.concat(head, _list("params")).alias("rhs")).distinct()


def operator_productions(methods: DataFrame) -> DataFrame:
    """Productions in operator syntax of methods(owner, name, params, result) that have one."""
    spark = methods.sparkSession
    rows = [*((k, "binary", v) for k, v in BINARY.items()), *((k, "statement", v) for k, v in IN_PLACE.items()), *((k, "unary", v) for k, v in UNARY.items()),
            *((k, "function", v) for k, v in FUNCTIONS.items()), ("__getitem__", "index", "["), ("__contains__", "contains", "in")]
    signs = spark.createDataFrame(rows, "name string, form string, sign string")
    m = methods.join(F.broadcast(signs), "name")
    own, arg = _n(F.col("owner")), _n(F.get("params", F.lit(0)))
    rhs = (F.when(F.col("form").isin("binary", "statement"), F.array(own, _t(F.col("sign")), arg)).when(F.col("form") == "unary", F.array(_t(F.col("sign")), own))
           .when(F.col("form") == "function", F.array(_t(F.col("sign")), _t("("), own, _t(")"))).when(F.col("form") == "index", F.array(own, _t("["), arg, _t("]")))
           .otherwise(F.array(arg, _t("in"), own)))
    lhs = F.when(F.col("form") == "statement", F.lit("STMT")).otherwise(F.col("result"))
    needs = F.when(F.col("form").isin("unary", "function"), 0).otherwise(1)
    return m.filter(F.size("params") == needs).select(lhs.alias("lhs"), rhs.alias("rhs")).distinct()


def member_productions(members: DataFrame) -> DataFrame:
    """type -> owner . name of members(owner, name, type)."""
    return members.select(F.col("type").alias("lhs"), F.array(_n(F.col("owner")), _t("."), _t(F.col("name"))).alias("rhs")).distinct()


def constructor_productions(constructors: DataFrame) -> DataFrame:
    """type -> type ( params ) with the type's name as token."""
    return constructors.select(F.col("type").alias("lhs"), F.concat(F.array(_t(F.col("type"))), _list("params")).alias("rhs")).distinct()


def cpp_productions(callables: DataFrame) -> DataFrame:
    """C++ forms by kind: constructor T(..), method o . f (..), static O :: f (..), invocation o (..), function f (..)."""
    own, name = F.col("owner"), F.col("name")
    head = (F.when(F.col("kind") == "constructor", F.array(_t(own))).when(F.col("kind") == "method", F.array(_n(own), _t("."), _t(name)))
            .when(F.col("kind") == "static", F.array(_t(own), _t("::"), _t(name))).when(F.col("kind") == "invocation", F.array(_n(own))).otherwise(F.array(_t(name))))
    return callables.select(F.when(F.col("kind") == "constructor", own).otherwise(F.col("result")).alias("lhs"), F.concat(head, _list("params")).alias("rhs")).distinct()


def supported(callables: DataFrame, max_arity: int = 3) -> DataFrame:
    """Public, neither synthetic, bridge nor variadic, few parameters, a legal name."""
    return callables.filter((F.col("access") == "public") & ~F.coalesce("is_synthetic", F.lit(False)) & ~F.coalesce("is_bridge", F.lit(False))
                            & ~F.coalesce("is_varargs", F.lit(False)) & (F.size("params") <= max_arity) & F.col("name").rlike(r"\A[A-Za-z_$][\w$]*\z"))


def cpp_supported(callables: DataFrame, max_arity: int = 3) -> DataFrame:
    """Public, not deleted, not variadic, no dependent, deduced or reserved spelling."""
    reserved = r"(\bauto\b|\bdecltype\b|typename\s|\b__|\b_[A-Z]|\.\.\.|type-parameter)"
    spelled = F.concat_ws(" ", "result", "name", "owner", F.array_join("params", " "))
    return callables.filter((F.col("access") == "public") & ~F.col("is_deleted") & ~F.col("is_variadic") & (F.size("params") <= max_arity) & ~spelled.rlike(reserved))


def unambiguous(callables: DataFrame, edges: DataFrame) -> DataFrame:
    """Callables whose (owner, name, arity) has one descriptor over the owner and its subtypes (edges sub -> super)."""
    from typegram.operators.closure import transitive

    below = transitive(edges).select(F.col("dst").alias("owner"), F.col("src").alias("at")).unionByName(
        callables.select("owner", F.col("owner").alias("at"))).distinct()
    own = callables.select(F.col("owner").alias("at"), "name", F.size("params").alias("arity"), "descriptor")
    bad = below.join(own, "at").groupBy("owner", "name", "arity").agg(F.count_distinct("descriptor").alias("n")).filter("n > 1")
    return callables.withColumn("arity", F.size("params")).join(bad, ["owner", "name", "arity"], "left_anti").drop("arity")


def expanded_varargs(callables: DataFrame, max_repeat: int = 3) -> DataFrame:
    """One row per arity for callables with is_varargs: their last parameter repeats 0 to max_repeat times."""
    fixed = F.slice("params", F.lit(1), F.greatest(F.size("params") - 1, F.lit(0)))
    last = F.element_at("params", -1)
    repeats = F.when(F.col("is_varargs") & (F.size("params") > 0), F.sequence(F.lit(0), F.lit(max_repeat))).otherwise(F.array(F.lit(-1)))
    rows = callables.withColumn("_r", F.explode(repeats))
    return rows.withColumn("params", F.when(F.col("_r") < 0, F.col("params")).otherwise(F.concat(fixed, F.array_repeat(last, F.greatest(F.col("_r"), F.lit(0)))))).drop("_r")


#: Literals per language and type (fixed values).
LITERALS = {
    "java": {"boolean": ("true", "false"), "int": ("0",), "long": ("0L",), "double": ("0.0",), "float": ("0.0f",), "char": ("'a'",), "String": ('""',)},
    "kotlin": {"Boolean": ("true", "false"), "Int": ("0",), "Long": ("0L",), "Double": ("0.0",), "Float": ("0.0f",), "Char": ("'a'",), "String": ('""',)},
    "cpp": {"bool": ("true", "false"), "int": ("0",), "long": ("0L",), "double": ("0.0",), "char": ("'a'",)},
    "python": {"bool": ("True", "False"), "int": ("0",), "float": ("0.0",), "complex": ("0j",), "str": ('""',), "bytes": ('b""',), "None": ("None",)},
}


def literal_rules(spark: SparkSession, language: str, nullable: Sequence[str] = ()) -> DataFrame:
    """type -> literal; nullable types also have null."""
    rows = [(t, [("T", x)]) for t, xs in LITERALS[language].items() for x in xs] + [(t, [("T", "null")]) for t in nullable]
    return spark.createDataFrame(rows, SCHEMA)


def base_rules(edges: DataFrame) -> DataFrame:
    """base -> sub for direct bases, without loops of one."""
    return edges.filter("super_key <> sub_key").select(F.col("super_key").alias("lhs"), F.array(_n(F.col("sub_key"))).alias("rhs")).distinct()


def grouping_rules(p: DataFrame) -> DataFrame:
    """T -> ( T ) for every left side."""
    lhs = p.select("lhs").distinct()
    return lhs.select("lhs", F.array(_t("("), _n(F.col("lhs")), _t(")")).alias("rhs"))


def arity_budget(tokens: Column, root: Column | int = 1) -> Column:
    """Arguments that a call of so many tokens can have."""
    r = F.lit(root) if isinstance(root, int) else root
    return F.greatest(F.lit(0), F.floor((tokens - r - 2) / 2)).cast("int")


#: Slices of a sequence: every choice of bounds, then of a step (fixed values).
SLICES = tuple(f"{a}:{b}{c}" for a in ("", "i") for b in ("", "i") for c in ("", ":", ":i"))


def slice_productions(sequences: DataFrame, index: str = "int") -> DataFrame:
    """type -> type [ i : i : i ] in its twelve forms, for sequences(type)."""
    forms = F.explode(F.array(*(F.array(*(_n(F.lit(index)) if c == "i" else _t(c) for c in s)) for s in SLICES)))
    return sequences.select("type", forms.alias("f")).select(F.col("type").alias("lhs"), F.concat(F.array(_n(F.col("type")), _t("[")), "f", F.array(_t("]"))).alias("rhs"))
