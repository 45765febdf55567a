"""Recognition and counting by spans: charts of many words at once, one join per span length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typegram.operators import grammar as g
from typegram.session import cut


def _rules(cnf: DataFrame) -> tuple[DataFrame, DataFrame]:
    terminal = cnf.filter(F.size("rhs") == 1).select("lhs", F.col("rhs")[0]["value"].alias("token"))
    binary = cnf.filter(F.size("rhs") == 2).select("lhs", F.col("rhs")[0]["value"].alias("left"), F.col("rhs")[1]["value"].alias("right"))
    return cut(terminal), cut(binary)


def chart(words: DataFrame, cnf: DataFrame, counts: bool = False, max_length: int | None = None) -> DataFrame:
    """word_id, start, length, symbol (and parses): all spans of words(word_id, pos, token) that a symbol derives."""
    terminal, binary = _rules(cnf)
    words = cut(words.select("word_id", "pos", "token"))
    longest = words.groupBy("word_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    longest = min(longest, max_length or longest)
    one = F.lit(1).cast("decimal(38,0)")
    spans = cut(words.join(terminal, "token").groupBy("word_id", F.col("pos").alias("start"), F.lit(1).alias("length"), F.col("lhs").alias("symbol")).agg(F.sum(one).alias("parses")))
    for n in range(2, longest + 1):
        # every split of a span of n: both parts are shorter, so the whole chart so far takes part
        a = spans.select("word_id", "start", F.col("length").alias("la"), F.col("symbol").alias("left"), F.col("parses").alias("pa"),
                         (F.col("start") + F.col("length")).alias("mid"))
        b = spans.select("word_id", F.col("start").alias("mid"), F.col("length").alias("lb"), F.col("symbol").alias("right"), F.col("parses").alias("pb"))
        pairs = a.filter(F.col("la") < n).join(b.filter(F.col("lb") < n), ["word_id", "mid"]).filter(F.col("la") + F.col("lb") == n)
        product = (F.col("pa") * F.col("pb")).cast("decimal(38,0)") if counts else one
        new = pairs.join(binary, ["left", "right"]).groupBy("word_id", "start", F.lit(n).alias("length"), F.col("lhs").alias("symbol")).agg(
            F.sum(product).cast("decimal(38,0)").alias("parses"))
        spans = cut(spans.unionByName(new))
    return spans


def recognised(words: DataFrame, cnf: DataFrame, start: str = g.START) -> DataFrame:
    """word_id, recognized of all words; the empty word never is."""
    lengths = words.groupBy("word_id").agg(F.count("*").cast("int").alias("length"), F.min("pos").alias("start"))
    whole = chart(words, cnf).filter(F.col("symbol") == start).select("word_id", "start", "length").withColumn("hit", F.lit(True))
    return lengths.join(whole, ["word_id", "start", "length"], "left").select("word_id", F.coalesce("hit", F.lit(False)).alias("recognized"))


def parse_counts(words: DataFrame, cnf: DataFrame, start: str = g.START) -> DataFrame:
    """word_id, parses: derivations of each word."""
    lengths = words.groupBy("word_id").agg(F.count("*").cast("int").alias("length"), F.min("pos").alias("start"))
    whole = chart(words, cnf, counts=True).filter(F.col("symbol") == start)
    return lengths.join(whole, ["word_id", "start", "length"], "left").select("word_id", F.coalesce("parses", F.lit(0)).cast("decimal(38,0)").alias("parses"))
