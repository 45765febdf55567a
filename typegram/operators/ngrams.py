"""Add-one 4-gram models over token sequences, scores and reranking of prefixes."""

from __future__ import annotations

import keyword

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOS, EOS, NEWLINE, UNKNOWN = "BOS", "EOS", "NEWLINE", "UNK"
FRESH = "@fresh"


def lexical(token: Column) -> Column:
    """Alphabet of the count files: names, numbers and strings by class, other tokens as they are."""
    return (F.when(token == FRESH, "NAME").when(token.isin("0", "0.0", "0j"), "NUMBER").when(token.isin('""', 'b""'), "STRING")
            .when(token.rlike(r"\A[\p{L}_][\p{L}\p{N}_]*\z") & ~token.isin(*keyword.kwlist), "NAME").otherwise(token))


def known(df: DataFrame, token: str, vocabulary: DataFrame) -> DataFrame:
    """df with tokens that the vocabulary(word) lacks as UNK."""
    v = vocabulary.select(F.col("word").alias(token)).distinct().withColumn("_known", F.lit(True))
    return df.join(v, token, "left").withColumn(token, F.when(F.col("_known"), F.col(token)).otherwise(UNKNOWN)).drop("_known")


def framed(sequences: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, i, token of BOS NEWLINE tokens NEWLINE EOS."""
    whole = F.concat(F.array(F.lit(BOS), F.lit(NEWLINE)), F.col(tokens), F.array(F.lit(NEWLINE), F.lit(EOS)))
    return sequences.select(key, F.posexplode(whole).alias("i", "token"))


def grams(sequences: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, w1..w4 of every position that has three predecessors."""
    whole = F.concat(F.array(F.lit(BOS), F.lit(NEWLINE)), F.col(tokens), F.array(F.lit(NEWLINE), F.lit(EOS)))
    at = F.explode(F.sequence(F.lit(0), F.size("_w") - 4)).alias("_i")
    rows = sequences.select(key, whole.alias("_w")).filter(F.size("_w") >= 4).select(key, "_w", at)
    return rows.select(key, *(F.get("_w", F.col("_i") + j).alias(f"w{j + 1}") for j in range(4)))


def counts(sequences: DataFrame, key: str, tokens: str) -> DataFrame:
    return grams(sequences, key, tokens).groupBy("w1", "w2", "w3", "w4").agg(F.count("*").alias("n"))


def contexts(model: DataFrame) -> DataFrame:
    return model.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("total"))


def vocabulary(model: DataFrame) -> DataFrame:
    """Symbols of the counts without BOS, with UNK."""
    words = model.select(F.explode(F.array("w1", "w2", "w3", "w4")).alias("word")).union(model.sparkSession.createDataFrame([(UNKNOWN,)], "word string"))
    return words.filter(F.col("word") != BOS).distinct()


def scores(sequences: DataFrame, key: str, tokens: str, model: DataFrame) -> DataFrame:
    """key, score: sum of ln((c + 1) / (C + V)); equal grams are counted per sequence before they meet the model."""
    v = vocabulary(model).count()
    own = grams(sequences, key, tokens).groupBy(key, "w1", "w2", "w3", "w4").agg(F.count("*").alias("m"))
    rows = own.join(model, ["w1", "w2", "w3", "w4"], "left").join(contexts(model), ["w1", "w2", "w3"], "left")
    term = F.col("m") * F.log((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + v))
    return rows.groupBy(key).agg(F.sum(term).alias("score"))


def reranked(candidates: DataFrame, groups: list[str], ordinal: str, score: str, limit: int) -> DataFrame:
    """Candidates of the first `limit` ordinals per group in order of score, ties in shortlex order: rank1, strictly_better, tied_total."""
    rows = candidates.filter(F.col(ordinal) < limit)
    by = Window.partitionBy(*groups).orderBy(F.desc(score))
    full = Window.partitionBy(*groups).orderBy(F.desc(score), ordinal)
    return rows.withColumns({"rank1": F.row_number().over(full), "strictly_better": F.rank().over(by) - 1,
                             "tied_total": F.count("*").over(Window.partitionBy(*groups, score))})


def truth_ranks(candidates: DataFrame, truth: DataFrame, groups: list[str], ordinal: str, score: str, limit: int) -> DataFrame:
    """Rank of each group's truth(groups, ordinal) after reranking; NULL with a reason where it lies beyond the prefix."""
    ranked = reranked(candidates, groups, ordinal, score, limit)
    return truth.join(ranked, [*groups, ordinal], "left").select(
        *groups, ordinal, "rank1", "strictly_better", "tied_total", F.when(F.col("rank1").isNull(), "beyond_prefix").alias("censored_reason"))
