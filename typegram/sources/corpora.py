"""Corpus readers: problem files in JSON lines, gzip tars, shards; provenance and stub discovery."""

from __future__ import annotations

import io
import os
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typegram.operators.ordering import first_per
from typegram.operators.sampling import shard

PROBLEM = "id string, solutions string, difficulty string, url string"
SOURCE = "member string, data binary, dataset string, split string, problem_id string, solution_index int, difficulty string, url string"
#: Members of the submission archive (fixed pattern).
SUBMISSION = r"\AProject_CodeNet/data/(p\d{5})/Python/(s\d{9})\.py\Z"


def solutions(column: str) -> Column:
    """A JSON list of texts, given as text; blank text is the empty list; anything else raises."""
    blank = F.trim(F.col(column)) == ""
    parsed = F.from_json(column, "array<string>", {"mode": "FAILFAST"})
    return F.when(F.col(column).isNull() | blank, F.array().cast("array<string>")).otherwise(parsed)


def member_name(split: Column, problem: Column, index: Column) -> Column:
    return F.concat(F.lit("APPS/"), split, F.lit("/"), F.replace(F.url_encode(problem), F.lit("+"), F.lit("%20")), F.lit("/solution_"),
                    F.lpad(index.cast("string"), 4, "0"), F.lit(".py"))


def read_problems(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One row per solution of a JSON-lines file; blank lines are skipped, malformed rows and rows without id raise."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    row = F.from_json("value", T._parse_datatype_string(PROBLEM), {"mode": "FAILFAST"})
    p = lines.select(row.alias("r")).select("r.*").withColumn("id", F.when(F.col("id").isNotNull(), F.col("id")).otherwise(F.raise_error(F.lit("row without id"))))
    s = p.select("*", F.posexplode(solutions("solutions")).alias("solution_index", "code"))
    return s.select(member_name(F.lit(split), F.col("id"), F.col("solution_index")).alias("member"), F.encode("code", "UTF-8").alias("data"), F.lit("apps").alias("dataset"),
                    F.lit(split).alias("split"), F.col("id").alias("problem_id"), "solution_index", "difficulty", "url")


def read_archive(spark: SparkSession, path: str, pattern: str = SUBMISSION, dataset: str = "codenet") -> DataFrame:
    """Members of gzip tars whose names match. A tar can't be split: one task reads one archive; spread the rows after."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows: list[tuple] = []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for m in tar:
                        hit = re.match(pattern, m.name)
                        if not hit or not m.isfile():
                            continue
                        rows.append((m.name, tar.extractfile(m).read(), dataset, None, hit.group(1) if hit.groups() else None, None, None, None))
                        if len(rows) >= 1000:
                            yield pd.DataFrame(rows, columns=[f.strip().split()[0] for f in SOURCE.split(",")])
                            rows = []
                yield pd.DataFrame(rows, columns=[f.strip().split()[0] for f in SOURCE.split(",")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SOURCE)


def read_corpus(spark: SparkSession, dataset: str, path: str, split: str = "train", shards: int = 1, index: int = 0) -> DataFrame:
    """Reader by dataset; with shards only rows of position % shards = index in member order."""
    if shards < 1 or not 0 <= index < shards:
        raise ValueError("shard index out of range")
    if dataset == "apps":
        rows = read_problems(spark, path, split)
    elif dataset == "codenet":
        rows = read_archive(spark, path)
    else:
        raise ValueError(f"unknown dataset {dataset!r}")
    return rows if shards == 1 else shard(rows, ["member"], shards, index).drop("source_index", "shard")


def with_provenance(df: DataFrame, data: str = "data") -> DataFrame:
    return df.withColumns({"sha256": F.sha2(data, 256), "bytes": F.octet_length(data)})


def best_stubs(files: DataFrame) -> DataFrame:
    """One file per module of files(module, path, is_stub, in_stub_distribution): stubs, then stub distributions, then path."""
    return first_per(files, ["module"], [F.desc("is_stub"), F.desc("in_stub_distribution"), F.col("path")])


def discover_stubs(spark: SparkSession, root: str) -> DataFrame:
    """module, path, is_stub, in_stub_distribution of .py and .pyi files below a folder all executors see.

    Spark's own listing hides names that begin with _, such as __init__.py; so each top-level entry is walked in a task.
    """
    top = [(os.path.join(root, e),) for e in sorted(os.listdir(root))]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for entry in pdf["entry"]:
                files = [entry] if os.path.isfile(entry) else [os.path.join(d, f) for d, _, fs in os.walk(entry) for f in fs]
                for path in files:
                    if not path.endswith((".py", ".pyi")):
                        continue
                    parts = os.path.relpath(path, root).rpartition(".")[0].split(os.sep)
                    in_stubs = parts[0].endswith("-stubs")
                    parts[0] = parts[0].removesuffix("-stubs")
                    rows.append((".".join(parts[:-1] if parts[-1] == "__init__" else parts), path, path.endswith(".pyi"), in_stubs))
            yield pd.DataFrame(rows, columns=["module", "path", "is_stub", "in_stub_distribution"])

    return spark.createDataFrame(top, "entry string").mapInPandas(walk, "module string, path string, is_stub boolean, in_stub_distribution boolean")


#: Folder names and file endings of code that is vendored, generated or test code (fixed values).
VENDORED = ("vendor", "third_party", "node_modules", "external", "dist", "build", "generated", "test", "tests", "testdata", "examples")


def looks_like_source(path: Column, extensions: list[str]) -> Column:
    parts = F.split(F.lower(path), "/")
    ending = "|".join(re.escape(e) for e in extensions)
    return path.rlike(rf"(?i)\.({ending})$") & ~F.arrays_overlap(parts, F.array(*map(F.lit, VENDORED))) & ~path.rlike(r"(?i)(\.min\.|_pb2\.|\.pb\.|\.generated\.)")
