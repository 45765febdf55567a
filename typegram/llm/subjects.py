"""Subject areas of posts from labelling functions and a latent model of their accuracy.

Labelling functions per post and area: the lexicon's evidence in the post's own sentences, lexicon words in addresses,
the section quoted, and the board the post stands on. The lexicon starts from labelled seed texts and is refined by how
often words occur beside known words in the sentences of all posts. A latent model (one true label per post and area,
functions independent given it) is fitted by expectation maximisation to the counts of all vote patterns, started and
anchored by the labelled seeds; a post gets the areas whose posterior exceeds one half.

Evidence of an area in a post: a sentence with two words of the area or more gives 2, one with a single word gives 1;
so two treating sentences give 4, and a passing mention 1. Words of several areas count where the rest points.

Defined cases: NULL, empty and blank posts have no area; NULL ids are left out; a NULL board gives no vote; repeated rows
give equal rows once; without seeds nothing has an area; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typegram.llm import posts
from typegram.session import written

#: Bound of the seeds that are fitted on.
SEEDS = 100_000
SHARE, LIFT = 0.25, 2.0
ROUNDS, EM_ROUNDS = 2, 30
LEVELS = 6  # evidence 0 to 5 or more
TREATED, CERTAIN = 2, 4  # evidence of two own sentences with a word each, and with two words each
_URL = re.compile(r"https?://[^\s\[\]<>\"']+", re.I)


def stem(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") else word


def own_sentences(text: str) -> list[list[str]]:
    """Distinct stems per own sentence; sentences with an address are advertising or references, not treatment."""
    out = []
    for s in posts.sentences(posts.own(text)):
        if "http" in s.lower() and _URL.search(s):
            continue
        w = list(dict.fromkeys(stem(x.lower()) for x in posts.WORD.findall(s) if len(x) > 2 and not x[0].isdigit()))
        if w:
            out.append(w)
    return out


class Lexicon:
    """word -> areas; knows words with two neighbouring letters swapped."""

    def __init__(self, areas: dict[str, tuple[str, ...]]):
        self.areas = areas
        self.swapped: dict[str, str] = {}
        for w in areas:
            for i in range(len(w) - 1) if len(w) > 3 else ():
                v = stem(w[:i] + w[i + 1] + w[i] + w[i + 2:])
                if v not in areas:
                    self.swapped[v] = w

    def of(self, word: str) -> tuple[str, ...]:
        a = self.areas.get(word)
        if a is None:
            w = self.swapped.get(word)
            return self.areas[w] if w else ()
        return a

    def evidence(self, sentences: list[list[str]]) -> Counter:
        hits = [[a for w in s if (a := self.of(w))] for s in sentences]
        certain = Counter(a[0] for s in hits for a in s if len(a) == 1)
        out: Counter = Counter()
        for s in hits:
            if not s:
                continue
            votes = Counter(x for a in s for x in a)
            best = max(votes, key=lambda x: (votes[x], certain[x], x))
            out[best] += min(2, votes[best])
            for a in s:
                if best not in a:
                    out[max(a, key=lambda x: (certain[x], x))] += 1
        return out


def lifts(overall: Counter) -> dict[str, float]:
    whole = sum(overall.values()) or 1
    return {a: min(0.9, LIFT * n / whole) for a, n in overall.items()}  # more than what is spoken of everywhere


def from_counts(counts: dict[str, Counter], total: dict[str, float], least: float, overall: Counter | None = None) -> dict[str, tuple[str, ...]]:
    """Areas that hold at least SHARE of a word's weight, for words that lean to one or two areas. overall: where counts are
    those of some words only, the sums of all."""
    if overall is None:
        overall = Counter()
        for c in counts.values():
            overall.update(c)
    lifted = lifts(overall)
    out = {}
    for w, c in counts.items():
        n = total[w]
        if n < least or not c:
            continue
        held = sorted((a for a, v in c.items() if v / n >= max(SHARE, lifted[a])), key=lambda a: (-c[a], a))
        if held and c[held[0]] / n >= 0.4 and sum(c[a] for a in held[:2]) / n >= 0.7:
            out[w] = tuple(held[:2])
    return out


def seed_counts(seeds: list[tuple[str, frozenset[str]]]) -> tuple[dict[str, Counter], Counter]:
    counts: dict[str, Counter] = defaultdict(Counter)
    total: Counter = Counter()
    for text, areas in seeds:
        for w in {w for s in own_sentences(text) for w in s}:
            total[w] += 1
            for a in areas:
                counts[w][a] += 1 / len(areas)
    return counts, total


def neighbours(lexicon: Lexicon, sentences: list[list[str]], into: dict[str, Counter]) -> None:
    """Adds, for every word, the area of the known words beside it in its sentences as (area, ''), and of all words beside it
    in which of 64 classes they fall as ('', class)."""
    certain = Counter(a[0] for s in sentences for w in s if len(a := lexicon.of(w)) == 1)
    for s in sentences:
        known = [(w, a[0]) for w in s if len(a := lexicon.of(w)) == 1]
        for w in s:
            votes = Counter(a for x, a in known if x != w)
            if votes:
                best = max(votes, key=lambda x: (votes[x], certain[x], x))
                into[w][best, ""] += 1
                for x in s:
                    if x != w:
                        into[w]["", str(zlib.crc32(x.encode()) % 64)] = 1


def refined(counts: dict[str, Counter], seed: dict[str, tuple[str, ...]], barred: frozenset[str] = frozenset(), overall: Counter | None = None) -> Lexicon:
    """Words whose sentences point to one or two areas far above those areas' shares; never barred words."""
    known = {w: Counter({a: n for (a, _), n in c.items() if a}) for w, c in counts.items()}
    totals = {w: sum(c.values()) for w, c in known.items()}
    # set phrases keep to themselves: a word of an area stands beside many others
    phrases = {w for w, c in counts.items() if totals[w] >= 6 and sum(1 for _, x in c if x) < 5}
    barred = barred | phrases
    out = from_counts(known, totals, least=4, overall=overall)
    out = {w: a for w, a in out.items() if w not in barred}
    for w, a in seed.items():  # what the seeds say stays, unless the posts' sentences say nothing of the kind
        n = totals.get(w, 0)
        if w in barred or n >= 20 and known[w][a[0]] / n < 0.15:
            out.pop(w, None)
        elif n < 4:
            out[w] = a
        else:
            out[w] = (*a, *(x for x in out.get(w, ()) if x not in a))[:2]
    return Lexicon(out)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, board, text in zip(pdf["id"], pdf["board"], pdf["text"], strict=True):
            own = own_sentences(text)
            urls = [stem(w.lower()) for u in _URL.findall(text) for w in posts.WORD.findall(u)]
            rest = [w for s in quoted_sentences(text, own) for w in s]
            rows.append((i, board, own, urls, rest))
        yield pd.DataFrame(rows, columns=["id", "board", "own", "urls", "quoted"])


def quoted_sentences(text: str, own: list[list[str]]) -> list[list[str]]:
    """Stems of what is quoted: every sentence but the own ones."""
    if ">" not in text and "uote" not in text.lower() and ":" not in text:
        return []
    left = Counter(map(tuple, own))
    out = []
    for s in posts.sentences(posts.clean(text)):
        w = tuple(dict.fromkeys(stem(x.lower()) for x in posts.WORD.findall(s) if len(x) > 2 and not x[0].isdigit()))
        if left[w]:
            left[w] -= 1
        elif w:
            out.append(list(w))
    return out


def _neighbour_counts(areas: dict[str, tuple[str, ...]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, into = Lexicon(areas), defaultdict(Counter)
        for pdf in batches:
            for own in pdf["own"]:
                neighbours(lexicon, [list(s) for s in own], into)
            if len(into) > 500_000:
                yield _long(into)
                into.clear()
        yield _long(into)

    return run


def _long(into: dict[str, Counter]) -> pd.DataFrame:
    return pd.DataFrame([(w, a, x, n) for w, c in into.items() for (a, x), n in c.items()], columns=["word", "area", "beside", "n"])


def _votes(areas: dict[str, tuple[str, ...]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(areas)
        for pdf in batches:
            rows = []
            for i, board, own, urls, quoted in zip(*(pdf[c] for c in ("id", "board", "own", "urls", "quoted")), strict=True):
                e = lexicon.evidence([list(s) for s in own])
                u = Counter(a for w in urls for a in lexicon.of(w))
                q = Counter(a for w in quoted for a in lexicon.of(w) if len(lexicon.of(w)) == 1)
                for a in {*e, *u, *(x for x in q if q[x] >= 4)}:
                    rows.append((i, board, a, min(e[a], LEVELS - 1), int(u[a] > 0), int(q[a] >= 4)))
            yield pd.DataFrame(rows, columns=["id", "board", "area", "evidence", "address", "section"])

    return run


def given_area(words: DataFrame, overall: Counter) -> DataFrame:
    """Of word, c (counts by area), others, n: the words that from_counts and refined may give an area; they decide in the end."""
    least = {a: max(SHARE, x) - 1e-9 for a, x in lifts(overall).items()}
    floor = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i in least.items() for x in i)), F.col("x.area")), F.lit(SHARE)) if least else F.lit(SHARE)
    held = words.select("word", "n", F.explode("c").alias("x")).filter(F.col("x.n") / F.col("n") >= floor).groupBy("word", "n").agg(
        F.sort_array(F.collect_list("x.n"), asc=False).alias("h"))
    top = held.filter("h[0] / n >= 0.4 - 1e-9 AND (h[0] + coalesce(get(h, 1), 0)) / n >= 0.7 - 1e-9").select("word")
    return words.filter("n < 6 OR others >= 5").join(top, "word", "left_semi")


def fit_lexicon(read: DataFrame, seeds: list[tuple[str, frozenset[str]]], barred: frozenset[str], rounds: int = ROUNDS) -> dict[str, tuple[str, ...]]:
    first = from_counts(*seed_counts(seeds), least=2)
    lexicon = Lexicon(first)
    spoken = {w for text, _ in seeds for s in own_sentences(text) for w in s}
    in_seeds = read.sparkSession.createDataFrame([(w,) for w in sorted(spoken | set(first))], "word string")
    for _ in range(rounds):
        counts = read.select("own").mapInPandas(_neighbour_counts(lexicon.areas), "word string, area string, beside string, n bigint")
        summed = counts.groupBy("word", "area", "beside").agg(F.sum("n").alias("n"))
        # per word: its counts by area, and how many classes of words stand beside it
        words = written(summed.groupBy("word").agg(
            F.collect_list(F.when(F.col("area") != "", F.struct("area", "n"))).alias("c"), F.count_if(F.col("beside") != "").alias("others"), F.sum(F.when(F.col("area") != "", F.col("n")).otherwise(0)).alias("n")).filter("n >= 4"))
        overall = Counter({r.area: r.n for r in words.select(F.inline("c")).groupBy("area").agg(F.sum("n").alias("n")).collect()})
        own: dict[str, Counter] = defaultdict(Counter)
        for text, _areas in seeds:
            neighbours(lexicon, own_sentences(text), own)
        for c in own.values():
            overall.update({a: n for (a, _), n in c.items() if a})
        # words of the seeds and those that are given an area
        kept = words.join(F.broadcast(in_seeds), "word", "left_semi").unionByName(
            given_area(words, overall).join(F.broadcast(in_seeds), "word", "left_anti"))
        into = {r.word: Counter({(x.area, ""): x.n for x in r.c} | {("", str(i)): 1 for i in range(r.others)}) for r in kept.collect()}
        for text, _areas in seeds:
            neighbours(lexicon, own_sentences(text), _Adding(into))
        lexicon = refined(into, first, barred, overall)
    return lexicon.areas


def _stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"word": sorted({stem(w) for t in pdf["text"] for w in posts.words(t or "")})})


class _Adding(dict):
    """Counters of a plain dict, made when first needed."""

    def __init__(self, into: dict[str, Counter]):
        self.into = into

    def __getitem__(self, word: str) -> Counter:
        return self.into.setdefault(word, Counter())


Pattern = tuple[int, int, int, int]  # evidence, address, section, board


def latent_model(patterns: dict[Pattern, float], labelled: dict[tuple[int, bool], float], rounds: int = EM_ROUNDS) -> dict[Pattern, float]:
    """Posterior of each vote pattern. labelled: counts of (evidence, label) of the seeds, whose labels stay as they are.

    The distributions of all functions, evidence too, are learned. What anchors the labels is the definition: an area is treated
    in two own sentences or more, so evidence below TREATED and from CERTAIN on leaves no doubt; the posts between are judged
    by all functions. Without such anchors the labels of few posts drift.
    """
    sizes = (LEVELS, 2, 2, 2)

    def distributions(weights: dict[Pattern, tuple[float, float]]) -> list[list[list[float]]]:
        out = []
        for label in (0, 1):
            per = []
            for f in range(4):
                c = [0.5] * sizes[f]
                if f == 0:
                    c = [x + labelled.get((e, bool(label)), 0) for e, x in enumerate(c)]
                for p, w in weights.items():
                    c[p[f]] += w[label]
                per.append([x / sum(c) for x in c])
            out.append(per)
        return out

    theta = distributions({})
    of_seeds = [theta[1][0][e] / (theta[1][0][e] + theta[0][0][e]) for e in range(LEVELS)]
    posterior = {p: 0.0 if p[0] < TREATED else of_seeds[p[0]] if p[0] < CERTAIN else 1.0 for p in patterns}  # the start
    total = sum(patterns.values()) or 1
    for _ in range(rounds):
        weights = {p: (n * (1 - posterior[p]), n * posterior[p]) for p, n in patterns.items()}
        theta = distributions(weights)
        prior = min(max(sum(w[1] for w in weights.values()) / total, 1e-6), 1 - 1e-6)
        for p in patterns:
            no, yes = 1 - prior, prior
            for f in range(4):
                no, yes = no * theta[0][f][p[f]], yes * theta[1][f][p[f]]
            if TREATED <= p[0] < CERTAIN:
                posterior[p] = yes / (yes + no) if yes + no else 0.0
    return posterior


def posteriors(docs: DataFrame, seeds: DataFrame, foreign: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", board: str = "source",
               seed_id: str = "seed_id", seed_text: str = "text", subject: str = "subject") -> DataFrame:
    """id, area, posterior of all posts and areas with any vote. foreign(text): few texts whose words speak for no area."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(board).cast("string").alias("board"), F.col(text).alias("text")).filter(
        "id IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''")
    kind = rows.schema["id"].dataType.simpleString()
    read = written(rows.mapInPandas(_read, f"id {kind}, board string, own array<array<string>>, urls array<string>, quoted array<string>"))
    labelled = seeds.filter(F.col(seed_text).isNotNull() & F.col(subject).isNotNull()).groupBy(seed_id).agg(
        F.min(seed_text).alias("t"), F.collect_set(subject).alias("a")).orderBy(seed_id).limit(SEEDS).collect()
    examples = [(r.t, frozenset(r.a)) for r in labelled]
    areas = sorted({a for _, x in examples for a in x})
    if not areas:
        return docs.select(F.col(id_col), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("double").alias("posterior")).limit(0)
    barred = frozenset(r.word for r in (foreign.select("text").mapInPandas(_stems, "word string").distinct().collect() if foreign is not None else ()))
    lexicon = fit_lexicon(read, examples, barred - frozenset(from_counts(*seed_counts(examples), least=3)))
    votes = written(read.mapInPandas(_votes(lexicon), f"id {kind}, board string, area string, evidence int, address int, section int"))
    # boards: the share of an area among the treated areas of a board, against its share everywhere
    treated = votes.filter("evidence >= 4").groupBy("board", "area").agg(F.count("*").alias("n"))
    overall = {r.area: r.n for r in treated.groupBy("area").agg(F.sum("n").alias("n")).collect()}
    whole = sum(overall.values()) or 1
    share = F.create_map(*(x for a in areas for x in (F.lit(a), F.lit(overall.get(a, 0) / whole))))
    per_board = treated.groupBy("board").agg(F.sum("n").alias("m"))
    leaning = treated.join(per_board, "board").filter(F.col("n") > LIFT * F.col("m") * share[F.col("area")]).select("board", "area", F.lit(1).alias("leans"))
    votes = votes.join(leaning, ["board", "area"], "left").select("id", "area", "evidence", "address", "section", F.coalesce("leans", F.lit(0)).alias("board"))
    counted = votes.groupBy("evidence", "address", "section", "board").count().collect()  # at most 48 patterns
    patterns = {(r.evidence, r.address, r.section, r.board): float(r["count"]) for r in counted}
    none = read.count() * len(areas) - sum(patterns.values())
    patterns[(0, 0, 0, 0)] = patterns.get((0, 0, 0, 0), 0.0) + max(0.0, none)
    of_seed: Counter = Counter()
    known = Lexicon(lexicon)
    for t, a in examples:
        e = known.evidence(own_sentences(t))
        for x in areas:
            of_seed[min(e[x], LEVELS - 1), x in a] += 1
    posterior = latent_model(patterns, of_seed)
    table = docs.sparkSession.createDataFrame([(*p, v) for p, v in posterior.items()], "evidence int, address int, section int, board int, posterior double")
    return votes.join(F.broadcast(table), ["evidence", "address", "section", "board"]).select(F.col("id").alias(id_col), F.col("area").alias("subject"), "posterior")


def assigned(docs: DataFrame, seeds: DataFrame, foreign: DataFrame | None = None, threshold: float = 0.5, **columns) -> DataFrame:
    found = posteriors(docs, seeds, foreign, **columns)
    return found.filter(F.col("posterior") > threshold).drop("posterior").distinct()


def composition(docs: DataFrame, seeds: DataFrame, foreign: DataFrame | None = None, source: str = "source", id_col: str = "doc_id", **columns) -> DataFrame:
    """Posts per board and subject (NULL for posts of none)."""
    found = assigned(docs, seeds, foreign, id_col=id_col, **columns)
    return docs.select(F.col(id_col), F.col(source).alias("source")).join(found, id_col, "left").groupBy("source", "subject").agg(F.count_distinct(id_col).alias("posts"))
