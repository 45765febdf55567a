"""Corpus statistics: statement lengths, document frequency, samples, funnels."""

from __future__ import annotations

from pyspark.sql import functions as F

from typegram.operators import lengths
from typegram.plans.registry import query
from typegram.session import table

_STATEMENTS = """
statements AS (
  SELECT d.lang AS language, d.source AS repo, d.doc_id AS file,
         len(list_filter(regexp_split_to_array(s.part, '[ \\t\\r]+'), lambda x: x <> '')) AS tokens
  FROM documents d, unnest(regexp_split_to_array(d.text, '[.!?\\n]+')) AS s(part)
),
kept AS (SELECT * FROM statements WHERE tokens > 2)
"""


@query("stmt_length_by_lang", f"""
WITH {_STATEMENTS},
per_file AS (SELECT language, file, count(*) AS n, avg(tokens) AS m FROM kept GROUP BY ALL),
by_file AS (SELECT language, count(*) AS n_files, sum(n)::BIGINT AS n_statements, avg(m) AS mean,
                   coalesce(stddev_samp(m), 0) AS sd FROM per_file GROUP BY language),
pooled AS (SELECT language, quantile_cont(tokens, 0.5) AS med, quantile_cont(tokens, 0.25) AS p25,
                  quantile_cont(tokens, 0.75) AS p75 FROM kept GROUP BY language)
SELECT b.language, n_files, n_statements, round(mean, 6) AS mean_file_mean_tokens, round(sd, 6) AS sd_file_mean_tokens,
       round(sd / sqrt(n_files), 6) AS sem_file_mean_tokens, round(1.96 * sd / sqrt(n_files), 6) AS ci95_file_mean_tokens,
       med AS median_statement_tokens, p25 AS p25_statement_tokens, p75 AS p75_statement_tokens
FROM by_file b JOIN pooled p ON b.language IS NOT DISTINCT FROM p.language
""")
def stmt_length_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = lengths.statements(docs, text="text", language="lang", repo="source", file="doc_id")
    return lengths.language_summary(rows)
