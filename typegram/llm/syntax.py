"""Source files that do not parse in their language.

Every decoded file is parsed by all supported grammars, in the order in which its tokens speak for their languages. A
file that its own grammar rejects is invalid: the first other grammar that accepts it shows a wrong extension, none
corruption. A file that its own grammar accepts is valid, and which others accept it too is told beside.

Defined cases: NULL and undecodable data are never flagged and count as not decoded; an empty file is valid, except in
JSON; a NULL or unsupported language has no verdict (NULL) and is not flagged; repeated rows are judged one by one; an
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import ast
import json
import re
import symtable
import sys
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typegram.functions.decoding import decode_source
from typegram.llm import cfamily

#: Tokens that speak for a language, each occurrence once.
EVIDENCE = {
    "python": ("def ", "import ", "self", "elif ", "except", "None", "True", "False", "not in", "print(", "lambda", ":\n"),
    "cpp": ("#include", "#define", "std::", "cout", "cin", "using namespace", "template", "const ", "int main", ";\n"),
    "java": ("public ", "private ", "static ", "final ", "String", "System.out", "extends ", "implements ", "boolean", "import java", ";\n"),
    "json": ('":', "{\"", "[\"", "null", "true", "false", "},", "],"),
}


_REJECTED = (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError)


def python_parses(text: str) -> bool:
    try:  # parses without building a tree of Python objects, but refuses more than the grammar does
        symtable.symtable(text, "<source>", "exec")
        return True
    except _REJECTED:
        pass
    try:
        compile(text, "<source>", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except _REJECTED:
        return False
    return True


def _no_constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_int=len, parse_float=len)
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|\b(?:true|false|null)\b", re.A)
_INNER = re.compile(r"\[(?:v(?:,v)*)?\]|\{(?:s:[vs](?:,s:[vs])*)?\}|\[[vs](?:,[vs])*\]")


def json_parses(text: str) -> bool:
    try:
        _DECODER.decode(text)
    except RecursionError:  # deeper than the decoder goes: reduce from the inside
        text = re.sub(r"[ \t\r\n]+(?=[\]\[{},:])|(?<=[\]\[{},:])[ \t\r\n]+", "", _SCALAR.sub("v", _STRING.sub("s", text))).strip(" \t\r\n")
        n = 1
        while n:
            text, n = _INNER.subn("v", text)
        return text in ("v", "s")
    except ValueError:
        return False
    return True


PARSERS = {
    "python": python_parses,
    "cpp": lambda t: cfamily.parses(t, java=False),
    "java": lambda t: cfamily.parses(t, java=True),
    "json": json_parses,
}


def ranked(text: str) -> list[str]:
    score = {name: sum(map(text.count, tokens)) for name, tokens in EVIDENCE.items()}
    return sorted(score, key=lambda name: (-score[name], name))


def judge(data: bytes | None, language: str | None) -> tuple[bool, bool | None, list[str] | None, str | None]:
    """decoded, valid, all languages whose grammar accepts the file, the one its tokens speak for most first, and the first of
    them that is not its own; a blank file, which only JSON rejects, speaks for none."""
    text = decode_source(data)
    if text is None:
        return False, None, None, None
    accepted = [x for x in ranked(text) if PARSERS[x](text)]
    other = next((x for x in accepted if x != language), None) if text.strip() else None
    return True, language in accepted if language in PARSERS else None, accepted, other


def _judge_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    warnings.simplefilter("ignore")
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3000))
    for pdf in batches:
        rows = [judge(d, x) for d, x in zip(pdf.pop("data"), pdf["language"], strict=True)]
        pdf["decoded"], pdf["valid"], pdf["accepted_by"], pdf["parses_as"] = ([r[i] for r in rows] for i in range(4))
        pdf["valid"] = pdf["valid"].astype("boolean")
        yield pdf


def verdicts(df: DataFrame, id_col: str = "source_id", data: str = "data", language: str = "language", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, language, kept columns, decoded, valid, accepted_by, parses_as (first other language that accepts the file, NULL
    for blank ones), reason (wrong_extension, corrupt; NULL where valid) of every row."""
    rows = df.select(F.col(id_col).alias("id"), F.lower(F.trim(language)).alias("language"), *keep, F.col(data).alias("data"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "data")
    judged = rows.mapInPandas(_judge_batches, f"{schema}, decoded boolean, valid boolean, accepted_by array<string>, parses_as string")
    return judged.withColumn("reason", F.when(~F.col("valid"), F.when(F.col("parses_as").isNotNull(), "wrong_extension").otherwise("corrupt")))


def invalid(df: DataFrame, id_col: str = "source_id", **columns) -> DataFrame:
    return verdicts(df, id_col, **columns).filter("NOT valid").select(F.col("id").alias(id_col))


def rates(df: DataFrame, repo: str = "repo") -> DataFrame:
    """Files, decoded files, invalid files by reason and their rate among decoded files, per repository and language."""
    v = verdicts(df, keep=(repo,))
    return v.groupBy(F.col(repo).alias("repo"), "language").agg(
        F.count("*").alias("files"), F.count_if("decoded").alias("decoded_files"), F.count_if(~F.col("valid")).alias("invalid_files"),
        F.count_if(F.col("reason") == "wrong_extension").alias("wrong_extension"), F.count_if(F.col("reason") == "corrupt").alias("corrupt"),
    ).withColumn("invalid_rate", F.round(F.try_divide("invalid_files", "decoded_files"), 6))


def against_scans(df: DataFrame, scans: DataFrame) -> DataFrame:
    """Own counts of python rows per scan beside the counters of the scan's final attempt (scans: one row per scan_id)."""
    v = verdicts(df, keep=("scan_id",)).filter("language = 'python' AND scan_id IS NOT NULL")
    own = v.groupBy("scan_id").agg(F.count("*").alias("files"), F.count_if("valid").alias("valid_files"), F.count_if(~F.col("valid")).alias("invalid_files"))
    return scans.select("scan_id", "python_files", "parsed_files", "parse_failures").join(own, "scan_id", "full_outer").select(
        "scan_id", "python_files", "parsed_files", "parse_failures", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "valid_files", "invalid_files")))
