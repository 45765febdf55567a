"""Statement lengths: lexical statements, per-file and per-language summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def statements(df: DataFrame, text: str, language: str, repo: str, file: str, min_tokens: int = 2) -> DataFrame:
    """One row per statement with more than min_tokens blank-separated tokens; NULL texts give none."""
    parts = df.select(
        F.col(language).alias("language"), F.col(repo).alias("repo"), F.col(file).alias("file"),
        F.posexplode(F.split(F.col(text), r"[.!?\n]+")).alias("statement_index", "part"),
    )
    tokens = F.size(F.filter(F.split("part", r"[ \t\r]+"), lambda t: t != ""))
    return parts.select("language", "repo", "file", "statement_index", tokens.alias("tokens")).filter(F.col("tokens") > min_tokens)


def file_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("language", "repo", "file").agg(
        F.count("*").alias("n_statements"), F.avg("tokens").alias("mean_tokens"), F.percentile("tokens", 0.5).alias("median_tokens"),
        F.percentile("tokens", 0.25).alias("p25_tokens"), F.percentile("tokens", 0.75).alias("p75_tokens"), F.max("tokens").alias("max_tokens"),
    )


def language_summary(rows: DataFrame) -> DataFrame:
    """Mean of file means with its 95 % interval (sd is 0 for one file) and pooled percentiles.

    The token histogram per file carries both levels, so statements are shuffled once, already counted.
    """
    hist = rows.groupBy("language", "file", "tokens").agg(F.count("*").alias("n"))
    per_file = hist.groupBy("language", "file").agg(F.sum("n").alias("n"), (F.sum(F.col("tokens") * F.col("n")) / F.sum("n")).alias("m"))
    sd = F.coalesce(F.stddev_samp("m"), F.lit(0.0))
    by_file = per_file.groupBy("language").agg(
        F.count("*").alias("n_files"), F.sum("n").alias("n_statements"), F.avg("m").alias("mean"), sd.alias("sd"))
    pooled = hist.groupBy("language", "tokens").agg(F.sum("n").alias("n")).groupBy("language").agg(
        *(F.percentile("tokens", q, F.col("n")).alias(c) for q, c in ((0.5, "med"), (0.25, "p25"), (0.75, "p75"))))
    b, p = by_file.alias("b"), pooled.alias("p")
    sem = F.col("sd") / F.sqrt("n_files")
    return b.join(p, F.col("b.language").eqNullSafe(F.col("p.language"))).select(
        "b.language", "n_files", "n_statements", F.round("mean", 6).alias("mean_file_mean_tokens"), F.round("sd", 6).alias("sd_file_mean_tokens"),
        F.round(sem, 6).alias("sem_file_mean_tokens"), F.round(1.96 * sem, 6).alias("ci95_file_mean_tokens"),
        F.col("med").alias("median_statement_tokens"), F.col("p25").alias("p25_statement_tokens"), F.col("p75").alias("p75_statement_tokens"))


#: Statement nodes of parse trees per language (fixed values, by the grammars' node names).
STATEMENT_NODES = {
    "python": ("expression_statement", "assert_statement", "return_statement", "raise_statement", "pass_statement", "break_statement", "continue_statement", "delete_statement",
               "global_statement", "nonlocal_statement", "import_statement", "import_from_statement", "if_statement", "for_statement", "while_statement", "try_statement", "with_statement"),
    "java": ("expression_statement", "local_variable_declaration", "return_statement", "throw_statement", "break_statement", "continue_statement", "assert_statement", "yield_statement",
             "if_statement", "for_statement", "enhanced_for_statement", "while_statement", "do_statement", "try_statement", "switch_expression", "synchronized_statement", "labeled_statement"),
    "c": ("expression_statement", "declaration", "return_statement", "break_statement", "continue_statement", "goto_statement", "if_statement", "for_statement", "while_statement",
          "do_statement", "switch_statement", "labeled_statement"),
    "go": ("expression_statement", "short_var_declaration", "assignment_statement", "var_declaration", "const_declaration", "return_statement", "go_statement", "defer_statement",
           "if_statement", "for_statement", "expression_switch_statement", "select_statement", "inc_statement", "dec_statement", "send_statement"),
    "rust": ("expression_statement", "let_declaration"),
}


def statement_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes(language, node_type, ...) that are statements of their language."""
    table = nodes.sparkSession.createDataFrame([(x, n) for x, ns in STATEMENT_NODES.items() for n in ns], "language string, node_type string")
    return nodes.join(F.broadcast(table), ["language", "node_type"], "left_semi")


def own_tokens(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """node_id, tokens of statements(file, node_id, begin, end) without those of statements nested in them; positions are token numbers.

    tokens(file, pos): every token counts for the innermost statement around it.
    """
    hit = tokens.join(nodes, "file").filter((F.col("pos") >= F.col("begin")) & (F.col("pos") < F.col("end")))
    inner = hit.groupBy("file", "pos").agg(F.min_by("node_id", F.struct(F.col("end") - F.col("begin"), "node_id")).alias("node_id"))
    return inner.groupBy("file", "node_id").agg(F.count("*").alias("tokens"))
