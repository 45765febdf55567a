"""Queries of Python sources, scans and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from typegram.functions import scalars
from typegram.operators import pysource
from typegram.plans.registry import query
from typegram.session import table
from typegram.sources import corpora

_LAST = """last AS (SELECT DISTINCT scan_id, attempt, python_files, decoded_files, parsed_files, decode_failures, parse_failures, frequencies FROM import_scan
 QUALIFY attempt = max(attempt) OVER (PARTITION BY scan_id))"""


def _python(spark, sf_dir):
    return table(spark, sf_dir, "corpus").filter("language = 'python' AND scan_id IS NOT NULL")


@query("import_scan_roots", f"""
WITH {_LAST} SELECT scan_id, e.key AS root, e.value AS files FROM last, unnest(map_entries(frequencies)) AS u(e)
""")
def import_scan_roots(spark, sf_dir):
    """The scans' frequencies, counted anew from the sources."""
    rows = pysource.scanned_imports(_python(spark, sf_dir).select("scan_id", "data"), "scan_id")
    return rows.filter("counter = 'root'").select("scan_id", F.col("name").alias("root"), F.col("n").alias("files"))


@query("import_scan_counters", f"""
WITH {_LAST} SELECT scan_id, python_files, decoded_files, parse_failures FROM last
""")
def import_scan_counters(spark, sf_dir):
    rows = pysource.scanned_imports(_python(spark, sf_dir).select("scan_id", "data"), "scan_id").filter("counter <> 'root'")
    wide = rows.groupBy("scan_id").pivot("counter", ["python_files", "decoded_files", "parse_failures"]).agg(F.sum("n"))
    return wide.select("scan_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("python_files", "decoded_files", "parse_failures")))


@query("candidate_statements")
def candidate_statements(spark, sf_dir):
    rows = pysource.statements(table(spark, sf_dir, "corpus").filter("language = 'python'"), "source_id")
    return rows.groupBy("kind").agg(F.count("*").alias("statements"), F.count_distinct("source_id").alias("sources"), F.round(F.avg(F.size("tokens")), 6).alias("mean_tokens"))


@query("visible_import_bindings")
def visible_import_bindings(spark, sf_dir):
    """Names bound by the imports above the last line of each source."""
    rows = pysource.per_source(table(spark, sf_dir, "corpus").filter("language = 'python'"), "source_id", "data",
                               lambda text, tree: pysource.visible_imports(tree, text.count("\n") + 2), "bound string, target string", ["bound", "target"])
    return rows.groupBy("bound", "target").agg(F.count("*").alias("sources"))


@query("module_definitions")
def module_definitions(spark, sf_dir):
    rows = pysource.per_source(table(spark, sf_dir, "corpus").filter("language = 'python'"), "source_id", "data", lambda text, tree: pysource.definitions(tree),
                               "name string, kind string, annotation string, public boolean", ["name", "kind", "annotation", "public"])
    return rows.groupBy("kind", "public").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


@query("source_provenance", "SELECT source_id, sha256(data) AS sha256, octet_length(data)::INT AS bytes FROM corpus")
def source_provenance(spark, sf_dir):
    return corpora.with_provenance(table(spark, sf_dir, "corpus")).select("source_id", "sha256", "bytes")


@query("source_path_filter", """
SELECT member, count(*) AS n FROM corpus WHERE regexp_matches(member, '(?i)\\.(py|cpp|java)$') AND len(list_intersect(string_split(lower(member), '/'), ['vendor','third_party','node_modules','external','dist','build','generated','test','tests','testdata','examples'])) = 0 GROUP BY member
""")
def source_path_filter(spark, sf_dir):
    c = table(spark, sf_dir, "corpus").filter(corpora.looks_like_source(F.col("member"), ["py", "cpp", "java"]))
    return c.groupBy("member").agg(F.count("*").alias("n"))


@query("member_names", """
SELECT DISTINCT problem_id, solution_index, 'APPS/test/' || problem_id || '/solution_' || lpad(solution_index::VARCHAR, 4, '0') || '.py' AS member FROM corpus WHERE problem_id IS NOT NULL AND solution_index IS NOT NULL
""")
def member_names(spark, sf_dir):
    c = table(spark, sf_dir, "corpus").filter("problem_id IS NOT NULL AND solution_index IS NOT NULL").select("problem_id", "solution_index").distinct()
    return c.withColumn("member", corpora.member_name(F.lit("test"), F.col("problem_id"), F.col("solution_index")))


@query("token_names", """
SELECT DISTINCT repo, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(repo, '\\s+', '_', 'g'), '[^A-Za-z0-9_]', '_', 'g'), '_'), 1, 32), ''), 'TOKEN') AS name FROM corpus WHERE repo IS NOT NULL
""")
def token_names(spark, sf_dir):
    return table(spark, sf_dir, "corpus").select("repo").dropna().distinct().withColumn("name", scalars.token_name(F.col("repo")))


@query("exact_rank_logs", """
WITH r AS (SELECT DISTINCT outcome_id, rank1_exact, ltrim(rank1_exact, '0') AS d FROM rank_outcome WHERE regexp_matches(rank1_exact, '[1-9]'))
SELECT outcome_id, rank1_exact, round(log10(left(d, 15)::DOUBLE) + greatest(length(d) - 15, 0), 6) AS log10 FROM r
""")
def exact_rank_logs(spark, sf_dir):
    """Logarithms of integers of any size, by their leading digits and their number."""
    r = table(spark, sf_dir, "rank_outcome").select("outcome_id", "rank1_exact").distinct().filter(F.col("rank1_exact").rlike("[1-9]"))
    return r.withColumn("log10", F.round(scalars.log10_of(F.col("rank1_exact")), 6))
