"""Evaluation texts that occur in training texts, by block-max WAND over a BM25 index of the evaluation items.

Every text is queried in passages of PASSAGE words that overlap by RUN - 1 words, so each run of RUN words lies in one.
An item's threshold is the least score that a passage holding any RUN consecutive words of it can have, so retrieval
loses no run. Impacts are scaled so that every threshold is 1. Retrieval works on many passages at once: an item that
reaches its threshold stands in one of the passage's pivot lists, those left when lists of least maxima are set aside as
long as these cannot reach it alone; blocks of items are looked at only where the pivot lists name them, are skipped where
the block maxima of all lists stay below the threshold, and only the postings of the blocks left are read and scored.

Retrieved items are verified word by word along the diagonals of passage and item, which gives the maximal common runs
and how many of their words belong to the item's question (its last sentence, where that ends in a question mark) and to
what goes before it, which holds the answer. A run counts when no other item holds the same words in that sequence, which
is when no other item's run covers it in the text.

Defined cases: NULL and empty texts and items give no rows; items of fewer than RUN words cannot be found; equal items
hide each other, as neither run is its own; repeated rows and several runs of one item give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typegram.llm.posts import words

RUN, PASSAGE, BLOCK = 10, 24, 16
K1, B = 1.2, 0.75
#: Items of one index, which is broadcast. More items are indexed in parts of about this size, one pass over the words each.
ITEMS = 20_000
#: Words that are queried at once.
WORDS = 400_000
_QUESTION = re.compile(r"(?:(?<=[.!?:])\s|^)[^.!?]*\?\s*$")


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the counts, and the how manieth of it."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - (np.cumsum(counts) - counts)[of]


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, of = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(of, values, len(distinct))


class Index:
    """Inverted index of items: postings by word and item with impacts, and their maxima by word and block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in items], object)
        texts = [words(t or "") for _, t in items]
        self.vocabulary: dict[str, int] = {}
        ids = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in x], np.int64) if len(x) >= RUN else np.empty(0, np.int64) for x in texts]
        n, v = len(items), max(1, len(self.vocabulary))
        self.n, self.v, self.blocks = max(1, n), v, n // BLOCK + 1
        size = np.array([len(x) for x in texts], np.int64)
        # where the question begins, in words
        asks = [m.start() if (m := _QUESTION.search(t or "")) else None for _, t in items]
        self.question = np.array([len(x) if a is None else len(words((t or "")[:a])) for x, a, (_, t) in zip(texts, asks, items, strict=True)], np.int64)
        term, item = np.concatenate(ids or [np.empty(0, np.int64)]), np.repeat(np.arange(n), [len(x) for x in ids])
        place = np.concatenate([np.arange(len(x)) for x in ids] or [np.empty(0, np.int64)]).astype(np.int64)
        order = np.lexsort((place, term, item))
        # places of every word of every item, for the verification
        self.at_key, self.at_place = (item * v + term)[order], place[order]
        df = np.bincount(np.unique(term * self.n + item) // self.n, minlength=v)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        key, tf = np.unique(term * self.n + item, return_counts=True)
        p_term, p_item = key // self.n, key % self.n
        impact = idf[p_term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[p_item] / (size.mean() or 1.0 if n else 1.0)))
        of = dict(zip(key.tolist(), impact.tolist(), strict=True))
        least = np.ones(self.n)
        for d, x in enumerate(ids):  # distinct words, as a passage is a set of words
            if len(x):
                least[d] = min(sum(of[t * self.n + d] for t in set(x[i:i + RUN].tolist())) for i in range(len(x) - RUN + 1))
        self.p_term, self.p_item, self.p_impact = p_term, p_item, impact / (least[p_item] * (1 - 1e-9))
        b_key, self.b_start = np.unique(p_term * self.blocks + p_item // BLOCK, return_index=True)
        self.b_key, self.b_end = b_key, np.append(self.b_start[1:], len(key))
        self.b_max = np.maximum.reduceat(self.p_impact, self.b_start) if len(key) else np.empty(0)
        self.t_first = np.searchsorted(b_key, np.arange(v) * self.blocks)
        self.t_blocks = np.bincount(b_key // self.blocks, minlength=v)
        self.t_max = np.zeros(v)
        np.maximum.at(self.t_max, b_key // self.blocks, self.b_max)

    def _entries(self, term: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Place of (word, block) among the blocks, or -1."""
        key = term * self.blocks + block
        at = np.minimum(np.searchsorted(self.b_key, key), len(self.b_key) - 1)
        return np.where(self.b_key[at] == key, at, -1)

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) of all items that score 1 or more, of distinct (passage, word)."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(self.b_key) or not len(passage):
            return none
        reach = np.bincount(passage, self.t_max[term])
        keep = reach[passage] >= 1
        passage, term = passage[keep], term[keep]
        if not len(passage):
            return none
        order = np.lexsort((self.t_max[term], passage))
        passage, term = passage[order], term[order]
        count = np.bincount(passage)
        first = np.cumsum(count) - count
        running = np.cumsum(self.t_max[term])
        aside = running - (running - self.t_max[term])[first[passage]] < 1 - 1e-6  # sums of the least maxima that cannot reach 1
        rest = np.bincount(passage[aside], self.t_max[term[aside]], len(count))
        p, t = passage[~aside], term[~aside]
        of, nth = _ranges(self.t_blocks[t])
        at = self.t_first[t[of]] + nth
        pair, bound = _sums(p[of] * self.blocks + self.b_key[at] % self.blocks, self.b_max[at])
        live = bound + rest[pair // self.blocks] >= 1 - 1e-6
        pair, bound = pair[live], bound[live]
        # the same with the block maxima of the lists set aside
        apart = np.flatnonzero(aside)
        a_count = np.bincount(passage[apart], minlength=len(count))
        a_first = np.cumsum(a_count) - a_count
        of, nth = _ranges(a_count[pair // self.blocks])
        at = self._entries(term[apart[a_first[pair[of] // self.blocks] + nth]], pair[of] % self.blocks)
        bound += np.bincount(of, np.where(at >= 0, self.b_max[at], 0), len(pair))
        pair = pair[bound >= 1 - 1e-6]
        # postings of the blocks that are left
        of, nth = _ranges(count[pair // self.blocks])
        at = self._entries(term[first[pair[of] // self.blocks] + nth], pair[of] % self.blocks)
        of, at = of[at >= 0], at[at >= 0]
        more, nth = _ranges(self.b_end[at] - self.b_start[at])
        posting = self.b_start[at[more]] + nth
        hit, score = _sums(pair[of[more]] // self.blocks * self.n + self.p_item[posting], self.p_impact[posting])
        hit = hit[score >= 1]
        return hit // self.n, hit % self.n

    def matches(self, texts: list[list[str]]) -> pd.DataFrame:
        """text, item, start, end, question_words of maximal common runs of the texts' words with the retrieved items."""
        get = self.vocabulary.get
        a = np.array([get(w, -1) for x in texts for w in x], np.int64)
        lens = np.array([len(x) for x in texts], np.int64)
        begin = np.cumsum(lens) - lens
        of, nth = _ranges(np.where(lens >= RUN, (lens - RUN) // (PASSAGE - RUN + 1) + 1, 0))  # passages: their texts
        start = nth * (PASSAGE - RUN + 1)
        p, i = _ranges(np.minimum(PASSAGE, lens[of] - start))
        i += start[p]
        word = a[begin[of[p]] + i]
        # a run of an item is one of known words: others, and known ones in shorter rows, are no part of the query
        known = np.concatenate([[False], word >= 0, [False]])
        edge = np.flatnonzero((known[1:] != known[:-1]) | np.append(True, np.append(p[1:] != p[:-1], True)))
        row = np.diff(edge)
        known = np.repeat(known[1:][edge[:-1]] & (row >= RUN), row)
        p, i, word = p[known], i[known], word[known]
        pair = np.unique(p * self.v + word)
        hit_p, hit_item = self.retrieve(pair // self.v, pair % self.v)
        # places of the passages' words in the items retrieved, by diagonal
        count = np.bincount(p, minlength=len(of) + 1)
        h, nth = _ranges(count[hit_p])
        at = (np.cumsum(count) - count)[hit_p[h]] + nth
        key = hit_item[h] * self.v + word[at]
        low = np.searchsorted(self.at_key, key, "left")
        m, nth = _ranges(np.searchsorted(self.at_key, key, "right") - low)
        place = self.at_place[low[m] + nth]
        text, item, i = of[hit_p[h[m]]], hit_item[h[m]], i[at[m]]
        order = np.lexsort((i, i - place, item, text))
        text, item, i, place = text[order], item[order], i[order], place[order]
        same = np.zeros(len(i), bool)
        same[1:] = (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & ((i - place)[1:] == (i - place)[:-1]) & (i[1:] - i[:-1] <= 1)
        first = np.flatnonzero(~same)
        last = np.append(first[1:], len(i)) - 1
        good = i[last] - i[first] + 1 >= RUN if len(first) else np.empty(0, bool)
        first, last = first[good], last[good]
        asked = np.maximum(0, place[last] + 1 - np.maximum(self.question[item[first]], place[first]))
        return pd.DataFrame({"text": text[first], "item": self.ids[item[first]], "start": i[first], "end": i[last] + 1, "question_words": asked})


def _match(broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = broadcast.value
        for pdf in batches:
            texts = [words(t) for t in pdf["text"]]
            size = np.cumsum([len(x) for x in texts])
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size // WORDS)) + 1):
                found = index.matches([texts[k] for k in part])
                found.insert(0, "id", pdf["id"].to_numpy()[part[found.pop("text").to_numpy()]])
                yield found

    return run


def runs(texts: DataFrame, items: DataFrame, id_col: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """id, item, start, end, question_words: maximal runs of at least RUN words that a text shares with an item, and how many
    of them are its question's."""
    sc = texts.sparkSession.sparkContext
    rows = texts.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    chosen = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct()
    parts = max(1, -(-chosen.count() // ITEMS))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item {chosen.schema['i'].dataType.simpleString()}, start int, end int, question_words int"
    out = None
    for b in range(parts):
        own = chosen if parts == 1 else chosen.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == b)
        index = Index([(r.i, r.t) for r in own.orderBy("i", "t").collect()])  # ITEMS rows at most, give or take
        part = rows.mapInPandas(_match(sc.broadcast(index)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def own_runs(found: DataFrame) -> DataFrame:
    """Runs that no other item's run covers. Of one text's spans by begin, then longest first, a span is covered by an earlier
    one that ends no sooner; where that is the same item's, the item is told by the longer span."""
    spans = found.groupBy("id", "start", "end").agg(F.min("item").alias("item"), F.count_distinct("item").alias("items"), F.max("question_words").alias("question_words"))
    before = Window.partitionBy("id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max("end").over(before)).filter("items = 1 AND (reach IS NULL OR reach < end)").drop("reach", "items")


def leaks(texts: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item: texts that hold a run of an item which no other item holds."""
    found = own_runs(runs(texts, items, id_col, text, item_id, item_text))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_id)).distinct()


def report(texts: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per benchmark and split: items, items that leaked, those of which words of the question and of what goes before it did,
    texts that hold one."""
    found = own_runs(runs(texts, items, id_col, text, item_id, item_text)).select(F.col("item").alias(item_id), "id", "start", "end", "question_words")
    rows = items.select(item_id, "benchmark", "split").join(found, item_id, "left")
    leaked = lambda c: F.count_distinct(F.when(c, F.col(item_id)))
    return rows.groupBy("benchmark", "split").agg(
        F.count_distinct(item_id).alias("items"), leaked(F.col("id").isNotNull()).alias("leaked_items"), leaked(F.col("question_words") > 0).alias("leaked_questions"),
        leaked(F.col("question_words") < F.col("end") - F.col("start")).alias("leaked_answers"), F.count_distinct("id").alias("texts"))
