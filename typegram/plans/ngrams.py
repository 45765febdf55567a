"""Queries of 4-gram models over the days of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from typegram.operators import ngrams
from typegram.plans.grammars import _WORDS, words
from typegram.plans.registry import query

_GRAMS = f"""{_WORDS}, framed AS (
 SELECT word_id, 0 AS i, 'BOS' AS token FROM (SELECT DISTINCT word_id FROM words) UNION ALL SELECT word_id, 1, 'NEWLINE' FROM (SELECT DISTINCT word_id FROM words)
 UNION ALL SELECT word_id, pos + 1, token FROM words UNION ALL SELECT word_id, 2 + count(*), 'NEWLINE' FROM words GROUP BY word_id UNION ALL SELECT word_id, 3 + count(*), 'EOS' FROM words GROUP BY word_id),
g AS (SELECT * FROM (SELECT word_id, lag(token, 3) OVER w AS w1, lag(token, 2) OVER w AS w2, lag(token, 1) OVER w AS w3, token AS w4 FROM framed WINDOW w AS (PARTITION BY word_id ORDER BY i)) WHERE w1 IS NOT NULL),
model AS (SELECT w1, w2, w3, w4, count(*) AS n FROM g GROUP BY ALL)"""
_SCORES = f"""{_GRAMS}, ctx AS (SELECT w1, w2, w3, sum(n) AS total FROM model GROUP BY ALL),
v AS (SELECT count(*) AS v FROM (SELECT w1 AS w FROM model UNION SELECT w2 FROM model UNION SELECT w3 FROM model UNION SELECT w4 FROM model UNION SELECT 'UNK') WHERE w <> 'BOS'),
scored AS (SELECT word_id, sum(ln((n + 1) / (total + v))) AS score FROM g JOIN model USING (w1, w2, w3, w4) JOIN ctx USING (w1, w2, w3), v GROUP BY word_id)"""


def sequences(spark, sf_dir):
    w = words(spark, sf_dir)
    return w.groupBy("word_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))


@query("fourgram_counts", f"WITH {_GRAMS} SELECT * FROM model")
def fourgram_counts(spark, sf_dir):
    return ngrams.counts(sequences(spark, sf_dir), "word_id", "tokens")


@query("fourgram_scores", f"WITH {_SCORES} SELECT word_id, round(score, 6) AS score FROM scored")
def fourgram_scores(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return ngrams.scores(s, "word_id", "tokens", ngrams.counts(s, "word_id", "tokens")).withColumn("score", F.round("score", 6))


@query("prefix_rerank", f"""
WITH {_SCORES}, c AS (SELECT split_part(word_id, '/', 1)::BIGINT AS user_id, split_part(word_id, '/', 2) AS day, round(score, 6) AS score FROM scored),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS ordinal FROM c)
SELECT user_id, day, score, ordinal, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ordinal)::INT AS rank1,
 rank() OVER (PARTITION BY user_id ORDER BY score DESC)::INT - 1 AS strictly_better, count(*) OVER (PARTITION BY user_id, score) AS tied_total FROM o WHERE ordinal < 20
""")
def prefix_rerank(spark, sf_dir):
    """The first 20 days of every user, as candidates in order, by score."""
    from pyspark.sql import Window

    s = fourgram_scores(spark, sf_dir)
    c = s.select(F.split("word_id", "/")[0].cast("long").alias("user_id"), F.split("word_id", "/")[1].alias("day"), "score")
    c = c.withColumn("ordinal", (F.row_number().over(Window.partitionBy("user_id").orderBy("day")) - 1).cast("long"))
    return ngrams.reranked(c, ["user_id"], "ordinal", "score", 20)


@query("lexical_classes", """
SELECT k AS token, CASE WHEN k IN ('0', '0.0', '0j') THEN 'NUMBER' WHEN regexp_full_match(k, '[a-zA-Z_][a-zA-Z_0-9]*') AND k NOT IN ('and','as','assert','async','await','break','class','continue','def','del','elif','else','except','finally','for','from','global','if','import','in','is','lambda','nonlocal','not','or','pass','raise','return','try','while','with','yield','True','False','None') THEN 'NAME' ELSE k END AS lexical
FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[^a-zA-Z0-9_]+'), lambda x: x <> '')) AS k FROM documents)
""")
def lexical_classes(spark, sf_dir):
    from typegram.session import table

    t = table(spark, sf_dir, "documents").select(F.explode(F.filter(F.split("text", "[^a-zA-Z0-9_]+"), lambda x: x != "")).alias("token")).distinct()
    return t.select("token", ngrams.lexical(F.col("token")).alias("lexical"))
