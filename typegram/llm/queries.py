"""Queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from typegram.llm import copies, encoding, leaks, overlap, quantiles, reservoir, subjects, syntax, terms
from typegram.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("p1_found")
def p1_found(spark, sf_dir):
    return copies.copies(table(spark, sf_dir, "corpus"))


@query("p1_records")
def p1_records(spark, sf_dir):
    return copies.records(table(spark, sf_dir, "corpus"))


_ROOTS = """
WITH last AS (SELECT DISTINCT scan_id, attempt, frequencies FROM import_scan
              QUALIFY attempt = max(attempt) OVER (PARTITION BY scan_id)),
roots AS (SELECT scan_id, e.key AS root, e.value AS n FROM last, unnest(map_entries(frequencies)) AS u(e)),
total AS (SELECT sum(archive_python_files) AS n FROM (SELECT DISTINCT archive, archive_python_files, snapshot_at
          FROM import_frequencies QUALIFY snapshot_at = max(snapshot_at) OVER (PARTITION BY archive))),
freq AS (SELECT root, sum(n)::BIGINT AS files, count(DISTINCT scan_id) AS scans FROM roots GROUP BY root),
marked AS (SELECT root, files, scans, CASE WHEN files < 3 THEN 'rare' WHEN files * 10 >= (SELECT n FROM total) THEN 'common' END AS mark FROM freq)
"""


@query("p2_found", _ROOTS + "SELECT root, mark FROM marked WHERE mark IS NOT NULL")
def p2_found(spark, sf_dir):
    rows = terms.marked_roots(table(spark, sf_dir, "import_scan"), table(spark, sf_dir, "import_frequencies"))
    return rows.filter("mark IS NOT NULL").select("root", "mark")


@query("p2_roots", _ROOTS + "SELECT root, files, scans, mark FROM marked")
def p2_roots(spark, sf_dir):
    return terms.marked_roots(table(spark, sf_dir, "import_scan"), table(spark, sf_dir, "import_frequencies"))


@query("p2_word_ngrams", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM w),
g AS (SELECT doc_id, n, array_to_string(t[i:i + n - 1], chr(31)) AS term FROM p, unnest([1, 2, 3]) AS u(n) WHERE i + n - 1 <= len(t))
SELECT term, n::INT AS n, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM g GROUP BY term, n
""")
def p2_word_ngrams(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return terms.frequencies(docs.select(words.alias("words")), "words", max_n=3)


@query("p3_found")
def p3_found(spark, sf_dir):
    return overlap.found(table(spark, sf_dir, "corpus"))


@query("p3_report")
def p3_report(spark, sf_dir):
    return overlap.report(table(spark, sf_dir, "corpus"))


def _measures(spark, sf_dir):
    """Every distinct outcome and run once, per dimension."""
    split = F.lower(F.trim("split"))
    ranks = quantiles.by_dimension(
        table(spark, sf_dir, "rank_outcome"), "outcome_id", "elapsed_seconds", "rank_outcome",
        dataset=F.col("dataset"), split=split, failure=F.col("failure"), day=F.to_date("finished_at"))
    runs = quantiles.by_dimension(
        table(spark, sf_dir, "aggregate_run"), "run_id", "total_cfg_intersection_seconds", "aggregate_run",
        dataset=F.col("dataset"), split=split, source=F.col("source"), day=F.to_date("reported_at"))
    # one key column instead of three: every value is shuffled with it
    return ranks.unionByName(runs).select(F.concat_ws("\x1f", "measure", "dim", "val").alias("key"), "x")


def _key_part(i):
    return F.get(F.split("key", "\x1f"), F.lit(i))


@query("p4_percentiles")
def p4_percentiles(spark, sf_dir):
    got = quantiles.percentiles(quantiles.sketch(_measures(spark, sf_dir), "x", ["key"]), ["key"])
    return got.select(_key_part(0).alias("measure"), _key_part(1).alias("dim"), _key_part(2).alias("val"), *got.columns[1:])


@query("p4_merged_days")
def p4_merged_days(spark, sf_dir):
    """Months from the sketches of their days."""
    days = quantiles.sketch(_measures(spark, sf_dir).filter(_key_part(1) == "day"), "x", ["key"])
    months = days.select(_key_part(0).alias("measure"), F.substring(_key_part(2), 1, 7).alias("month"), "codes", "weights", "cells")
    return quantiles.percentiles(quantiles.merged(months, ("measure", "month")), ("measure", "month"))


@query("p6_sample")
def p6_sample(spark, sf_dir):
    return reservoir.sample(table(spark, sf_dir, "source_sample"), k=256, every=4 * 86_400)


@query("p5_found")
def p5_found(spark, sf_dir):
    return syntax.invalid(table(spark, sf_dir, "corpus"))


@query("p5_rates")
def p5_rates(spark, sf_dir):
    return syntax.rates(table(spark, sf_dir, "corpus"))


@query("p5_scans")
def p5_scans(spark, sf_dir):
    return syntax.against_scans(table(spark, sf_dir, "corpus"), terms.final_scans(table(spark, sf_dir, "import_scan")))


@query("p7_ids")
def p7_ids(spark, sf_dir):
    return encoding.encoded(table(spark, sf_dir, "documents"))


@query("p8_found")
def p8_found(spark, sf_dir):
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


@query("p8_report")
def p8_report(spark, sf_dir):
    return leaks.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


@query("p9_found")
def p9_found(spark, sf_dir):
    return subjects.assigned(*(table(spark, sf_dir, x) for x in ("documents", "subject_seed", "eval_item")))


@query("p9_composition")
def p9_composition(spark, sf_dir):
    return subjects.composition(*(table(spark, sf_dir, x) for x in ("documents", "subject_seed", "eval_item")))
