"""Event records, manifests, count files and caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typegram.operators.ordering import first_per

STATEMENT = ("event string, dataset string, split string, member string, file_index bigint, statement_index bigint, candidate_index bigint, line bigint, `column` bigint, "
             "kind string, ground_truth array<string>, recognized boolean, sample_accepted bigint, sample_checked bigint, sample_requested bigint, sampled_ranks array<bigint>, "
             "sampled_words array<string>, productions bigint, dfa_states bigint, cfg_intersection_seconds double, seconds double")
RANK = ("event string, index bigint, dataset string, split string, member string, line bigint, `column` bigint, candidate_index bigint, kind string, ground_truth array<string>, tokens bigint, "
        "rank1_exact string, rank1_log2 double, cfg_seconds double, dfa_seconds double, rank_seconds double, fourgram_rank1 bigint, fourgram_censored_reason string")
FAILURE = "event string, attempt bigint, member string, reason string, message string, elapsed_seconds double, censored_rank_seconds double"
SCHEMAS = {"statement": STATEMENT, "rank": RANK, "failure": FAILURE}


def to_lines(df: DataFrame, event: str) -> DataFrame:
    """value: one JSON object per row with its fields in sorted order."""
    return df.select(F.to_json(F.struct(*(F.col(c) if c != "event" else F.lit(event).alias("event") for c in sorted({*df.columns, "event"})))).alias("value"))


def write_events(df: DataFrame, path: str, event: str) -> None:
    to_lines(df, event).write.mode("append").text(path)


def read_events(spark: SparkSession, path: str, event: str) -> DataFrame:
    """Records of one kind; lines that are no JSON objects, or of another kind, are skipped."""
    lines = spark.read.text(path)
    return lines.filter(F.get_json_object("value", "$.event") == event).select(
        F.from_json("value", T._parse_datatype_string(SCHEMAS[event]), {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def manifest(spark: SparkSession, path: str, dataset: str, split: str | None, recognised_only: bool = True) -> DataFrame:
    """member, line, column, candidate_index, kind, ground_truth of statement or rank events of a dataset and split."""
    names = ["member", "line", "column", "candidate_index", "kind", "ground_truth"]
    s = read_events(spark, path, "statement")
    if recognised_only:
        s = s.filter("recognized")
    both = s.select("dataset", "split", *names).unionByName(read_events(spark, path, "rank").select("dataset", "split", *names))
    same = F.col("split").eqNullSafe(F.lit(split)) if split is not None else F.lit(True)
    return both.filter((F.col("dataset") == dataset) & same & F.col("member").isNotNull() & (F.col("line") > 0) & (F.col("column") >= 0)).select(*names)


def read_gram_counts(spark: SparkSession, path: str) -> DataFrame:
    """w1..w4, n of lines "w1 w2 w3 w4 ::: n"; equal grams are summed; malformed lines and empty files raise."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    m = r"^\s*(\S+) (\S+) (\S+) (\S+) ::: (\d+)\s*$"
    bad = lines.filter(~F.col("value").rlike(m)).first()
    if bad:
        raise ValueError(f"malformed count line: {bad.value!r}")
    out = lines.select(*(F.regexp_extract("value", m, i).alias(f"w{i}") for i in range(1, 5)), F.regexp_extract("value", m, 5).cast("long").alias("n")).groupBy(
        "w1", "w2", "w3", "w4").agg(F.sum("n").alias("n"))
    if lines.isEmpty():
        raise ValueError("no counts")
    return out


def first_by_identity(lines: DataFrame, keys: Sequence[str] = ("language", "repo", "sha", "path"), order: str = "line_no") -> DataFrame:
    return first_per(lines, list(keys), [F.col(order)])


def unparsed(files: DataFrame, cache: DataFrame, key: str = "digest") -> DataFrame:
    """Files whose content no cached result has."""
    return files.join(cache.select(key).distinct(), key, "left_anti")


def accepted_first(df: DataFrame, accepted: str, order: Sequence[str], n: int) -> DataFrame:
    """The first n accepted rows in order."""
    return df.filter(accepted).orderBy(*order).limit(n)
