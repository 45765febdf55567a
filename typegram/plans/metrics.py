"""Queries of evaluation metrics, windows, orders and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from typegram.operators import metrics as m
from typegram.operators import ordering, sampling
from typegram.plans.registry import query
from typegram.session import table

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
_RUNS = "runs AS (SELECT DISTINCT * FROM aggregate_run)"
_RANKS = "ranks AS (SELECT DISTINCT * FROM rank_outcome)"


def _distinct(spark, sf_dir, name):
    return table(spark, sf_dir, name).distinct()


@query("doc_frequency_topk", f"""
WITH w AS (SELECT DISTINCT doc_id, unnest({_WORDS}) AS word FROM documents)
SELECT word, count(*) AS files FROM w GROUP BY word HAVING count(*) >= 5 AND word <> '__future__' ORDER BY files DESC, word LIMIT 50
""")
def doc_frequency_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "").alias("words"))
    return sampling.top_with_minimum(m.document_frequency(docs, "words", "word"), "word", "files", top=50, least=5)


@query("bottomk_hash_sample", """
SELECT member, sha256('7' || chr(0) || member) AS h FROM (SELECT DISTINCT member FROM corpus WHERE member IS NOT NULL) ORDER BY h, member LIMIT 100
""")
def bottomk_hash_sample(spark, sf_dir):
    return sampling.bottom_k(table(spark, sf_dir, "corpus"), "member", seed=7, k=100)


@query("argmin_per_problem", """
SELECT problem_id, arg_min(source_id, sha256('7' || chr(0) || source_id::VARCHAR)) AS source_id FROM corpus GROUP BY problem_id
""")
def argmin_per_problem(spark, sf_dir):
    return sampling.least_hash_per(table(spark, sf_dir, "corpus"), "problem_id", 7, ["source_id"], ["source_id"])


@query("modulo_shard_counts", """
SELECT (row_number() OVER (ORDER BY source_id) - 1) % 7 AS shard, source_id FROM corpus
""")
def modulo_shard_counts(spark, sf_dir):
    return sampling.shard(table(spark, sf_dir, "corpus").select("source_id"), ["source_id"], 7).select("shard", "source_id")


@query("target_order", """
SELECT member, outcome_id, row_number() OVER (PARTITION BY member ORDER BY sha256('3' || chr(0) || member || chr(0) || outcome_id::VARCHAR), outcome_id)::INT AS position
FROM (SELECT DISTINCT member, outcome_id FROM rank_outcome) QUALIFY position <= 3
""")
def target_order(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "rank_outcome").select("member", "outcome_id").distinct()
    order = Window.partitionBy("member").orderBy(sampling.seeded_hash(3, F.col("member"), F.col("outcome_id")), "outcome_id")
    return rows.withColumn("position", F.row_number().over(order)).filter("position <= 3")


@query("worker_quotas", """
SELECT run_id, w::INT AS worker, (files_requested // workers + CASE WHEN w < files_requested % workers THEN 1 ELSE 0 END)::BIGINT AS quota
FROM (SELECT DISTINCT run_id, files_requested, workers FROM aggregate_run), unnest(range(0, workers)) AS u(w)
""")
def worker_quotas(spark, sf_dir):
    runs = table(spark, sf_dir, "aggregate_run").select("run_id", "files_requested", "workers").distinct()
    return sampling.quotas(runs, "files_requested", "workers").select("run_id", "worker", F.col("quota").cast("long").alias("quota"))


@query("rank_draws", """
SELECT outcome_id, draw, ('0x' || substr(sha256('11' || chr(0) || outcome_id::VARCHAR || chr(0) || draw::VARCHAR), 1, 15))::BIGINT % 1000000 AS rank0
FROM (SELECT DISTINCT outcome_id FROM rank_outcome), unnest(range(0, 3)) AS u(draw)
""")
def rank_draws(spark, sf_dir):
    rows = table(spark, sf_dir, "rank_outcome").select("outcome_id").distinct().withColumn("draw", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))))
    return rows.select("outcome_id", "draw", sampling.rank_draw(11, 1_000_000, F.col("outcome_id"), F.col("draw")).alias("rank0"))


@query("stratified_sample", """
SELECT language, repo, source_id FROM corpus QUALIFY row_number() OVER (PARTITION BY language, repo ORDER BY sha256('5' || chr(0) || source_id::VARCHAR), source_id) <= 2
""")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "corpus").select("language", "repo", "source_id"), ["language", "repo"], 5, "source_id", 2)


@query("deficit_fill", """
WITH have AS (SELECT source_id, repo FROM corpus WHERE dataset = 'codenet'), pool AS (SELECT source_id, repo FROM corpus WHERE dataset = 'apps'),
n AS (SELECT repo, count(*) AS n FROM have GROUP BY repo),
r AS (SELECT repo, source_id, row_number() OVER (PARTITION BY repo ORDER BY sha256('9' || chr(0) || source_id::VARCHAR), source_id) AS rn FROM pool)
SELECT r.repo, r.source_id FROM r LEFT JOIN n ON r.repo = n.repo WHERE rn <= 12 - coalesce(n, 0)
""")
def deficit_fill(spark, sf_dir):
    c = table(spark, sf_dir, "corpus").select("repo", "source_id", "dataset")
    have, pool = (c.filter(F.col("dataset") == d).select("repo", "source_id") for d in ("codenet", "apps"))
    return sampling.fill_deficit(have, pool, "repo", "source_id", 12, 9)


@query("quota_cutoff", """
WITH r AS (SELECT DISTINCT run_id, recognized, evaluated FROM aggregate_run),
c AS (SELECT *, sum((recognized * 10 >= evaluated * 8)::INT) OVER (ORDER BY run_id) AS k FROM r)
SELECT run_id, recognized, evaluated, k::BIGINT AS accepted_so_far FROM c WHERE k < 50 OR (k = 50 AND recognized * 10 >= evaluated * 8)
""")
def quota_cutoff(spark, sf_dir):
    r = table(spark, sf_dir, "aggregate_run").select("run_id", "recognized", "evaluated").distinct()
    return sampling.until_quota(r, ["run_id"], F.col("recognized") * 10 >= F.col("evaluated") * 8, 50)


@query("funnel_counts", f"""
WITH {_RANKS}, c AS (SELECT count(*) AS n0, count(*) FILTER (WHERE split IS NOT NULL) AS n1,
  count(*) FILTER (WHERE split IS NOT NULL AND problem_id IS NOT NULL) AS n2,
  count(*) FILTER (WHERE split IS NOT NULL AND problem_id IS NOT NULL AND tokens > 2) AS n3,
  count(*) FILTER (WHERE split IS NOT NULL AND problem_id IS NOT NULL AND tokens > 2 AND failure IS NULL) AS n4 FROM ranks)
SELECT 0 AS step, 'all' AS stage, n0 AS rows FROM c UNION ALL SELECT 1, 'has_split', n1 FROM c UNION ALL SELECT 2, 'has_problem', n2 FROM c
UNION ALL SELECT 3, 'long_enough', n3 FROM c UNION ALL SELECT 4, 'ranked', n4 FROM c
""")
def funnel_counts(spark, sf_dir):
    return m.funnel(_distinct(spark, sf_dir, "rank_outcome"), has_split=F.col("split").isNotNull(), has_problem=F.col("problem_id").isNotNull(),
                    long_enough=F.col("tokens") > 2, ranked=F.col("failure").isNull())


@query("ratio_summary", f"""
WITH {_RUNS} SELECT dataset, source, sum(recognized)::BIGINT AS recognized, sum(evaluated)::BIGINT AS evaluated, sum(precision_accepted)::BIGINT AS precision_accepted,
 sum(precision_checked)::BIGINT AS precision_checked, sum(precision_requested)::BIGINT AS precision_requested,
 round(sum(recognized)::DOUBLE / nullif(sum(evaluated), 0), 6) AS recall, round(sum(precision_accepted)::DOUBLE / nullif(sum(precision_checked), 0), 6) AS precision,
 round(sum(precision_checked)::DOUBLE / nullif(sum(precision_requested), 0), 6) AS coverage
FROM runs GROUP BY dataset, source
""")
def ratio_summary(spark, sf_dir):
    return m.run_ratios(_distinct(spark, sf_dir, "aggregate_run"), "dataset", "source")


@query("partial_final_merge", """
WITH last AS (SELECT DISTINCT scan_id, attempt, frequencies FROM import_scan QUALIFY attempt = max(attempt) OVER (PARTITION BY scan_id))
SELECT e.key AS key, sum(e.value)::BIGINT AS value FROM last, unnest(map_entries(frequencies)) AS u(e) GROUP BY e.key
""")
def partial_final_merge(spark, sf_dir):
    scans = table(spark, sf_dir, "import_scan")
    last = scans.groupBy("scan_id").agg(F.max_by("frequencies", F.struct("attempt", F.col("frequencies").isNotNull())).alias("frequencies"))
    return m.merged_counters(last, "frequencies")


@query("problem_counts", """
SELECT lower(trim(split)) AS split, count(DISTINCT (dataset, problem_id)) FILTER (WHERE problem_id IS NOT NULL) AS problems, count(*) AS sources FROM corpus GROUP BY 1
""")
def problem_counts(spark, sf_dir):
    key = F.when(F.col("problem_id").isNotNull(), F.struct("dataset", "problem_id"))
    return table(spark, sf_dir, "corpus").groupBy(F.lower(F.trim("split")).alias("split")).agg(F.count_distinct(key).alias("problems"), F.count("*").alias("sources"))


@query("file_stmt_summary", """
WITH s AS (SELECT d.lang AS language, d.source AS repo, d.doc_id AS file, len(list_filter(regexp_split_to_array(x.part, '[ \\t\\r]+'), lambda x: x <> '')) AS tokens
 FROM documents d, unnest(regexp_split_to_array(d.text, '[.!?\\n]+')) AS x(part))
SELECT language, repo, file, count(*) AS n_statements, round(avg(tokens), 6) AS mean_tokens, quantile_cont(tokens, 0.5) AS median_tokens,
 quantile_cont(tokens, 0.25) AS p25_tokens, quantile_cont(tokens, 0.75) AS p75_tokens, max(tokens)::INT AS max_tokens FROM s WHERE tokens > 2 GROUP BY ALL
""")
def file_stmt_summary(spark, sf_dir):
    from typegram.operators import lengths

    rows = lengths.file_summary(lengths.statements(table(spark, sf_dir, "documents"), "text", "lang", "source", "doc_id"))
    return rows.withColumn("mean_tokens", F.round("mean_tokens", 6))


@query("running_recall_precision", f"""
WITH {_RUNS}, w AS (SELECT *, sum(recognized) OVER o AS a, sum(evaluated) OVER o AS b, sum(precision_accepted) OVER o AS c, sum(precision_checked) OVER o AS d, sum(precision_requested) OVER o AS e
 FROM (SELECT DISTINCT run_id, reported_at, recognized, evaluated, precision_accepted, precision_checked, precision_requested FROM runs) WINDOW o AS (ORDER BY reported_at, run_id))
SELECT run_id, a::BIGINT AS run_recognized, b::BIGINT AS run_evaluated, round(a::DOUBLE / nullif(b, 0), 6) AS recall, round(c::DOUBLE / nullif(d, 0), 6) AS precision,
 round(d::DOUBLE / nullif(e, 0), 6) AS coverage FROM w
""")
def running_recall_precision(spark, sf_dir):
    names = ("run_id", "reported_at", "recognized", "evaluated", "precision_accepted", "precision_checked", "precision_requested")
    rows = m.running_run_metrics(table(spark, sf_dir, "aggregate_run").select(*names).distinct(), ["reported_at", "run_id"])
    return rows.select("run_id", "run_recognized", "run_evaluated", "recall", "precision", "coverage")


@query("rank_with_ties", f"""
WITH {_RANKS}, r AS (SELECT problem_id, outcome_id, tokens FROM ranks)
SELECT problem_id, outcome_id, tokens, rank() OVER (PARTITION BY problem_id ORDER BY tokens DESC)::INT - 1 AS strictly_better,
 row_number() OVER (PARTITION BY problem_id ORDER BY tokens DESC, outcome_id)::INT AS rank1, count(*) OVER (PARTITION BY problem_id, tokens) AS tied_total,
 (row_number() OVER (PARTITION BY problem_id ORDER BY tokens DESC, outcome_id) - rank() OVER (PARTITION BY problem_id ORDER BY tokens DESC))::INT AS tied_before FROM r
""")
def rank_with_ties(spark, sf_dir):
    r = _distinct(spark, sf_dir, "rank_outcome").select("problem_id", "outcome_id", "tokens")
    return m.rank_with_ties(r, ["problem_id"], F.col("tokens"), F.col("outcome_id"))


@query("slice_ends", f"""
WITH {_RANKS}, s AS (SELECT dataset, tokens AS length, count(*) AS size FROM ranks GROUP BY ALL)
SELECT dataset, length, size, (sum(size) OVER (PARTITION BY dataset ORDER BY length))::BIGINT AS slice_end FROM s
""")
def slice_ends(spark, sf_dir):
    s = _distinct(spark, sf_dir, "rank_outcome").groupBy("dataset", F.col("tokens").alias("length")).agg(F.count("*").alias("size"))
    return m.slice_ends(s, "length", "size", ["dataset"])


@query("token_history", """
SELECT user_id, event_id, event_type, lag(event_type, 1) OVER w AS prev1, lag(event_type, 2) OVER w AS prev2, lag(event_type, 3) OVER w AS prev3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def token_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return m.history(e, ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@query("stream_positions", """
SELECT outcome_id, row_number() OVER (ORDER BY finished_at, outcome_id) - 1 AS index, dense_rank() OVER (ORDER BY member)::INT AS file_index,
 row_number() OVER (PARTITION BY member ORDER BY finished_at, outcome_id)::INT AS statement_index FROM (SELECT DISTINCT outcome_id, member, finished_at FROM rank_outcome)
""")
def stream_positions(spark, sf_dir):
    from pyspark.sql import Window

    r = table(spark, sf_dir, "rank_outcome").select("outcome_id", "member", "finished_at").distinct()
    files = ordering.indexed(r.select("member").distinct(), ["member"], "file_index").withColumn("file_index", (F.col("file_index") + 1).cast("int"))
    r = ordering.indexed(r, ["finished_at", "outcome_id"], "index").join(files, "member")
    return r.withColumn("statement_index", F.row_number().over(Window.partitionBy("member").orderBy("finished_at", "outcome_id"))).select(
        "outcome_id", "index", "file_index", "statement_index")


@query("first_wins_dedupe", """
SELECT member, source_id, url FROM corpus QUALIFY row_number() OVER (PARTITION BY member ORDER BY ingested_at, source_id) = 1
""")
def first_wins_dedupe(spark, sf_dir):
    c = table(spark, sf_dir, "corpus").select("member", "source_id", "url", "ingested_at")
    return ordering.first_per(c, ["member"], [F.col("ingested_at").asc_nulls_last(), F.col("source_id")]).drop("ingested_at")


@query("last_wins_dedupe", """
SELECT archive, archive_python_files, importing_files_parsed FROM import_frequencies
QUALIFY row_number() OVER (PARTITION BY archive ORDER BY snapshot_at DESC, archive_python_files DESC, importing_files_parsed DESC) = 1
""")
def last_wins_dedupe(spark, sf_dir):
    f = table(spark, sf_dir, "import_frequencies").select("archive", "archive_python_files", "importing_files_parsed", "snapshot_at")
    return ordering.first_per(f, ["archive"], [F.desc("snapshot_at"), F.desc("archive_python_files"), F.desc("importing_files_parsed")]).drop("snapshot_at")


@query("group_medians", f"""
WITH {_RANKS} SELECT dataset, failure, quantile_disc(tokens, 0.5) AS lower_median, median(tokens) AS median FROM ranks GROUP BY dataset, failure
""")
def group_medians(spark, sf_dir):
    return m.medians(_distinct(spark, sf_dir, "rank_outcome"), ["dataset", "failure"], "tokens").withColumn("lower_median", F.col("lower_median").cast("long"))


@query("censored_summary", f"""
WITH {_RANKS}, r AS (SELECT dataset, failure IS NULL AS ok, CASE WHEN isnan(elapsed_seconds) THEN NULL ELSE round(elapsed_seconds, 3) END AS v,
  CASE WHEN isnan(censored_rank_seconds) THEN NULL ELSE round(censored_rank_seconds, 3) END AS b FROM ranks)
SELECT dataset, count(v) FILTER (WHERE ok) AS measured, min(v) FILTER (WHERE ok) AS measured_min, max(v) FILTER (WHERE ok) AS measured_max,
 round((sum(v::DECIMAL(30, 3)) FILTER (WHERE ok))::DOUBLE / nullif(count(v) FILTER (WHERE ok), 0), 2) AS measured_mean, count(b) FILTER (WHERE NOT ok) AS censored, min(b) FILTER (WHERE NOT ok) AS censored_min,
 max(b) FILTER (WHERE NOT ok) AS censored_max, round((sum(b::DECIMAL(30, 3)) FILTER (WHERE NOT ok))::DOUBLE / nullif(count(b) FILTER (WHERE NOT ok), 0), 2) AS censored_mean FROM r GROUP BY dataset
""")
def censored_summary(spark, sf_dir):
    r = _distinct(spark, sf_dir, "rank_outcome")
    v, b = (F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), 3) for c in ("elapsed_seconds", "censored_rank_seconds"))
    rows = m.censored_summary(r, ["dataset"], F.col("failure").isNull(), v, b)
    return rows.withColumns({c: F.round(c, 2) for c in ("measured_mean", "censored_mean")})


@query("log_histogram", """
WITH x AS (SELECT l_returnflag, log10(l_extendedprice) AS x FROM lineitem WHERE l_extendedprice > 0),
e AS (SELECT l_returnflag, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1)
SELECT x.l_returnflag, least(floor((x - lo) / (hi - lo) * 20), 19)::INT AS bin, count(*) AS n FROM x JOIN e USING (l_returnflag) GROUP BY 1, 2
""")
def log_histogram(spark, sf_dir):
    return m.log_histogram(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", 20, ["l_returnflag"])


@query("paired_improvement", """
WITH a AS (SELECT DISTINCT member, attempt, tokens FROM rank_outcome), f AS (SELECT member, min(tokens) AS t1 FROM a WHERE attempt = 1 GROUP BY 1), s AS (SELECT member, min(tokens) AS t2 FROM a WHERE attempt = 2 GROUP BY 1)
SELECT count(*) FILTER (WHERE t2 < t1) AS improved, count(*) FILTER (WHERE t2 = t1) AS equal, count(*) FILTER (WHERE t2 > t1) AS worse, count(*) FILTER (WHERE t1 IS NULL OR t2 IS NULL) AS unpaired
FROM f FULL OUTER JOIN s USING (member)
""")
def paired_improvement(spark, sf_dir):
    a = table(spark, sf_dir, "rank_outcome").select("member", "attempt", "tokens")
    f, s = (a.filter(F.col("attempt") == i).groupBy("member").agg(F.min("tokens").alias(f"t{i}")) for i in (1, 2))
    return m.paired_improvement(f.join(s, "member", "full_outer"), "t1", "t2")


@query("ambiguous_overloads", """
SELECT p_brand, p_type, p_size AS arity, count(DISTINCT floor(p_retailprice)::BIGINT % 5) AS descriptors FROM part GROUP BY ALL HAVING count(DISTINCT floor(p_retailprice)::BIGINT % 5) > 1
""")
def ambiguous_overloads(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_size").alias("arity"), (F.floor("p_retailprice") % 5).alias("d"))
    return m.ambiguous(p, ["p_brand", "p_type", "arity"], "d")
