"""Grammars as relations: production(lhs, rhs) with rhs an array of (kind, value), kind N or T; sets, never bags."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "lhs string, rhs array<struct<kind:string,value:string>>"
START = "START"


def from_rows(spark: SparkSession, rows: Iterable[tuple[str, Sequence[str]]], nonterminals: Iterable[str] | None = None) -> DataFrame:
    """Rows (lhs, symbols); symbols are nonterminals when they are a left side or listed."""
    rows = [(a, list(b)) for a, b in rows]
    known = {a for a, _ in rows} | set(nonterminals or ())
    return spark.createDataFrame([(a, [("N" if x in known else "T", x) for x in b]) for a, b in rows], SCHEMA).distinct()


def symbol(kind: str, value: Column | str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(value) if isinstance(value, str) else value.cast("string")).alias("value"))


def productions(df: DataFrame, lhs: Column, *symbols: Column) -> DataFrame:
    return df.select(lhs.cast("string").alias("lhs"), F.array(*symbols).alias("rhs")).distinct()


def with_ids(p: DataFrame) -> DataFrame:
    return p.withColumn("prod_id", F.sha2(F.to_json(F.struct("lhs", "rhs")), 256))


def long_form(p: DataFrame) -> DataFrame:
    """prod_id, lhs, pos, kind, value: one row per right-hand symbol (none for an empty right side)."""
    return with_ids(p).select("prod_id", "lhs", F.posexplode("rhs").alias("pos", "s")).select("prod_id", "lhs", "pos", "s.kind", "s.value")


def rhs_text(rhs: str = "rhs") -> Column:
    return F.array_join(F.transform(rhs, lambda s: s["value"]), " ")


def stats(p: DataFrame, start: str = START) -> DataFrame:
    """Productions, nonterminals (with the start symbol), terminals and the sum of 1 + length."""
    symbols = p.select("lhs", F.explode_outer("rhs").alias("s")).select("lhs", "s.kind", "s.value")
    names = symbols.select(F.explode(F.array(F.struct(F.lit("N").alias("kind"), F.col("lhs").alias("value")), F.struct("kind", "value"))).alias("x")).select("x.*").filter(
        "kind IS NOT NULL").union(p.sparkSession.createDataFrame([("N", start)], "kind string, value string")).distinct()
    counts = names.agg(F.count_if(F.col("kind") == "N").alias("nonterminals"), F.count_if(F.col("kind") == "T").alias("terminals")).first()
    return p.agg(F.count("*").alias("productions"), F.lit(counts.nonterminals).cast("long").alias("nonterminals"), F.lit(counts.terminals).cast("long").alias("terminals"),
                 F.coalesce(F.sum(F.size("rhs") + 1), F.lit(0)).alias("grammar_symbols"))


def with_start(p: DataFrame, start: str = START) -> DataFrame:
    """p with START -> T for every left side T; applying it twice changes nothing."""
    roots = p.select("lhs").filter(F.col("lhs") != start).distinct()
    return p.unionByName(productions(roots, F.lit(start), symbol("N", F.col("lhs")))).distinct()


def with_statement_root(p: DataFrame, start: str = START, statement: str = "STMT") -> DataFrame:
    """p with STMT -> T ';' for every left side and START -> STMT."""
    roots = p.select("lhs").filter(~F.col("lhs").isin(start, statement)).distinct()
    root = p.sparkSession.createDataFrame([(start, [("N", statement)])], SCHEMA)
    return p.unionByName(productions(roots, F.lit(statement), symbol("N", F.col("lhs")), symbol("T", ";"))).unionByName(root).distinct()


def text_lines(p: DataFrame) -> DataFrame:
    """Distinct lines "lhs -> rhs"; order them by (lhs, rhs_text) on output."""
    return p.select("lhs", rhs_text().alias("rhs_text")).distinct().withColumn("line", F.concat_ws(" -> ", "lhs", "rhs_text"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def unit_edges(p: DataFrame) -> DataFrame:
    """src, dst of productions with a single nonterminal."""
    return p.filter((F.size("rhs") == 1) & (F.col("rhs")[0]["kind"] == "N")).select(F.col("lhs").alias("src"), F.col("rhs")[0]["value"].alias("dst"))


def is_unit() -> Column:
    return (F.size("rhs") == 1) & (F.col("rhs")[0]["kind"] == "N")


def indexed_by(p: DataFrame, key: str) -> DataFrame:
    """key, members: the distinct productions of each left side, first terminal or pair of symbols."""
    keys = {"lhs": F.col("lhs"), "terminal": F.when((F.size("rhs") == 1) & (F.col("rhs")[0]["kind"] == "T"), F.col("rhs")[0]["value"]),
            "pair": F.when(F.size("rhs") == 2, F.concat_ws(" ", F.col("rhs")[0]["value"], F.col("rhs")[1]["value"]))}
    rows = p.select(keys[key].alias("key"), F.struct("lhs", rhs_text().alias("rhs_text")).alias("m")).filter("key IS NOT NULL")
    return rows.groupBy("key").agg(F.sort_array(F.collect_set("m")).alias("members"))
