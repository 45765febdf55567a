"""Outcomes of checks: spans, filters, failure classes, records that keep failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Diagnostic codes by what went wrong, in order of precedence (fixed values).
NAMES = ("unresolved-reference", "possibly-unbound-reference")
CALL_LAYOUT = ("missing-argument", "unknown-argument", "duplicate-argument", "too-many-positional-arguments")
MEMBERS = ("unresolved-attribute", "not-subscriptable", "call-non-callable", "invalid-subscript-assignment")
VALUE_FLOW = ("invalid-assignment", "invalid-return-type")
MAP_CONSTRUCTOR = "argument to constructor `map.__new__`"


def failure_class(kind: Column, local_codes: Column, messages: Column, any_diagnostic: Column) -> Column:
    """One of eleven outcomes of a rejected sample, from the codes and the text of its local diagnostics."""
    has = lambda *codes: F.arrays_overlap(local_codes, F.array(*map(F.lit, codes)))
    text = F.lower(messages)
    return (F.when(F.size(local_codes) == 0, F.when(kind == "output-assignment", "downstream-output-contract").when(any_diagnostic, "nonlocal-context-effect").otherwise("other"))
            .when(F.exists(local_codes, lambda c: c.contains("syntax")) | text.contains("syntax error"), "syntax-rendering")
            .when(has(*NAMES), "local-name-resolution").when(has("invalid-argument-type") & text.contains(MAP_CONSTRUCTOR), "local-callable-contract")
            .when(has("no-matching-overload"), "local-overload-generic-correlation").when(has(*CALL_LAYOUT), "local-call-layout")
            .when(has("invalid-argument-type"), "local-argument-assignability").when(has("unsupported-operator"), "local-operator")
            .when(has(*MEMBERS), "local-member-subscript-callability").when(has(*VALUE_FLOW), "local-value-flow").otherwise("other-local"))


def overlaps(begin: Column, end: Column, line: Column, diag_begin: Column, diag_end: Column, diag_first: Column, diag_last: Column) -> Column:
    """Both ends included, and the statement's line lies in the diagnostic's lines."""
    return (line >= diag_first) & (line <= diag_last) & (begin <= diag_end) & (end >= diag_begin)


def errors(diagnostics: DataFrame, severity: int = 1) -> DataFrame:
    return diagnostics.filter((F.coalesce("severity", F.lit(1)) <= severity) & F.col("code").isNotNull())


def unresolved_names(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.filter(F.col("code").isin(*NAMES)).select("member", F.regexp_extract("message", r"[`'\"]([^\W\d]\w*)[`'\"]", 1).alias("name")).filter("name <> ''").distinct()


def classified(samples: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """sample_id, reason, local_codes, downstream_codes of samples(sample_id, kind, begin, end, line) and their
    diagnostics(sample_id, code, message, d_begin, d_end, d_first, d_last)."""
    d = samples.join(diagnostics, "sample_id", "left")
    local = overlaps(*(F.col(c) for c in ("begin", "end", "line", "d_begin", "d_end", "d_first", "d_last")))
    code = F.when(F.col("d_begin").isNotNull(), F.coalesce("code", F.lit("unknown")))
    rows = d.groupBy("sample_id", "kind").agg(
        F.sort_array(F.collect_set(F.when(local, code))).alias("local_codes"), F.sort_array(F.collect_set(F.when(~local, code))).alias("downstream_codes"),
        F.array_join(F.sort_array(F.collect_set(F.when(local, F.col("message")))), "\n").alias("messages"), (F.count("d_begin") > 0).alias("any"))
    return rows.select("sample_id", failure_class(F.col("kind"), F.col("local_codes"), F.col("messages"), F.col("any")).alias("reason"), "local_codes", "downstream_codes")


def with_failures(statements: DataFrame, results: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Every statement with its result; where there is none, counters are 0 and recognized is false."""
    joined = statements.join(results, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counters} | {"recognized": F.coalesce("recognized", F.lit(False))})
