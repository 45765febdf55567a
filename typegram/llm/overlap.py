"""Same or near-same records across splits, from a partitioned sparse suffix array of the texts.

Each text is taken once (one row per text_key, with all its sides). Suffixes start at its rarest words, as a sketch of the
words' document frequencies says (any order is right, a good one is fast). A near pair has four fifths of the longer text in
common; so the first word they share in that order, repeats numbered, stands among the first n - ceil(0.8 n) + 1 of either,
and suffixes from these places alone meet every partner: a full suffix array would find no pair more. Suffixes are
partitioned by their first word and sorted, cut to NEXT further words; common prefixes of neighbours give the intervals of
suffixes that share one, and a pair of one interval across the splits has a shared span there. Suffixes carry the names of the
words that may be shared next, whose places are bounded likewise; by these the task that holds a long interval divides it again
and again, where that costs less than its pairs. Intervals too large for a task are named by more shared words when they are
listed, or joined in blocks by several tasks. None is cut, and no pair depends on its size.
Length, place and a word profile bound the overlap of a pair from above, so no pair is lost by them.

The spans of a pair are extended to maximal ones and merged into its coverage, the words of either that spans in the same
order hold. A pair covered to four fifths is near; of the others, whose common words lie too scattered for that, the longest
common subsequence of words decides. (Long common prefixes alone would lose these: a fifth of the words changed leaves no
span longer than four.)

Defined cases: rows with NULL or undecodable data, without letter or digit, with another split or a NULL id belong to no
pair; texts repeated under several ids are compared once and all their ids are paired; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import re
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typegram.functions.decoding import decode_source
from typegram.llm.copies import canonical_json, linked_keys
from typegram.session import written

WORD = re.compile(r"[^\W_]+")
#: Of lists with more pairs than BLOCK * BLOCK, blocks of BLOCK by BLOCK texts are one piece of work; lists of CAP texts have fewer.
BLOCK = 16_384
CAP = 2 * BLOCK
#: Shared words a list may be named by, how many longer names a text may get for one on average, pairs worth one of them, and
#: pairs worth looking at a listing once more.
LEVELS, SPREAD, WORTH, AGAIN = 4, 8, 60, 4
#: Counters of the sketch, most long lists per level, and words taken at once.
COUNTERS_LOG2, LONG_LISTS, PIECE = 20, 500_000, 200_000
#: Words of a suffix after its first one.
NEXT = 4
#: Shared words by which a list is divided further within its task, pairs that cost as much as one such name, names taken at once,
#: and words that a suffix carries for it at most; suffixes that would need more are compared undivided.
STEPS, WORTH_NAME, NAMES, CARRIED = 4, 4, 2_000_000, 64
SIMILAR = 0.8
TRAIN, EVAL = 1, 2

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Names(dict):
    """32-bit names of words, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        name = self[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        return name


def words_of(text: str) -> list[str]:
    return "\0".join(WORD.findall(text)).lower().split("\0")


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = _Names()
    for pdf in batches:
        out = []
        for i, side, data in zip(pdf["id"], pdf["side"], pdf["data"], strict=True):
            text = decode_source(data)
            if not text:
                continue
            words = words_of(text)
            joined = "".join(words)
            if not joined:
                continue
            c = canonical_json(text) if text.lstrip()[:1] in ("{", "[") else None
            row = np.fromiter(map(names.__getitem__, words), dtype="<u4", count=len(words)).tobytes()
            md5 = lambda s: hashlib.md5(s.encode("utf-8", "surrogatepass")).digest()
            out.append((i, side, md5(joined), None if c is None else md5(c), xxhash.xxh64_intdigest(row) - (1 << 63), len(words), row))
        yield pd.DataFrame(out, columns=["id", "side", "p", "c", "text_key", "n", "words"])


def tokens(df: DataFrame, id_col: str, data: str, side: Column) -> DataFrame:
    """One row per record; the first one of a text has its words and all its sides."""
    rows = df.select(F.col(id_col).alias("id"), side.cast("int").alias("side"), F.col(data).alias("data")).filter(
        "id IS NOT NULL AND side IS NOT NULL AND data IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    tok = rows.mapInPandas(_tokens, f"id {kind}, side int, p binary, c binary, text_key bigint, n int, words binary")
    same = Window.partitionBy("text_key")
    first = F.row_number().over(same.orderBy("id")) == 1
    return written(tok.select(*tok.columns[:-1], F.when(first, F.bit_or("side").over(same)).alias("sides"), F.when(first, F.col("words")).alias("words")))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def least_common(n: np.ndarray) -> np.ndarray:
    """Words that a text of n words must share with a near copy of at most n words: four fifths, rounded up."""
    return (4 * n + 4) // 5


def profiles(a: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """32 bytes per text: how many of its words fall in each of 64 classes, 15 standing for 15 and more."""
    of = (a.astype(np.uint64) * _MIX) >> np.uint64(58)
    counts = np.bincount(doc * 64 + of.astype(np.int64), minlength=64 * texts).reshape(-1, 64)
    c = np.minimum(counts, 15).astype(np.uint8)
    return c[:, ::2] << 4 | c[:, 1::2]


def may_overlap(x: np.ndarray, y: np.ndarray, least: np.ndarray, nx: np.ndarray | None = None, ny: np.ndarray | None = None) -> np.ndarray:
    """Whether texts of these profiles can have `least` words in common: the classes' lesser counts bound it from above, and
    given the texts' lengths, so do the words of either that the other has no room for."""
    total, open_end = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    over, under = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a, b in ((x >> 4, y >> 4), (x & 15, y & 15)):
        low = np.minimum(a, b)
        total += low.sum(axis=1, dtype=np.int64)
        open_end |= (low == 15).any(axis=1)
        if nx is not None:
            over += np.where(b < 15, a - low, 0).sum(axis=1, dtype=np.int64)
            under += np.where(a < 15, b - low, 0).sum(axis=1, dtype=np.int64)
    fits = open_end | (total >= least)
    return fits if nx is None else fits & (nx - over >= least) & (ny - under >= least)


def numbered_words(a: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of (word, which of its occurrences in the text), by text, and where in a they stand."""
    at = np.lexsort((a, doc))
    a = a[at].astype(np.uint64)
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    nth = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return _mixed((a + np.uint64(1)) * _MIX + nth.astype(np.uint64) * _BASE), at


def following(a: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16-bit names of the NEXT words after each place, 0 beyond the end of its text."""
    short = ((a.astype(np.uint64) * _MIX) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    to = at[:, None] + np.arange(1, NEXT + 1)
    inside = np.minimum(to, len(a) - 1)
    return np.where((to < len(a)) & (doc[inside] == doc[at][:, None]), short[inside], np.uint16(0))


def suffix_order(name: np.ndarray, following_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the words that each suffix has in common with the one before it."""
    order = np.lexsort((*following_.T[::-1], name))
    same = (following_[order][1:] == following_[order][:-1]) & (following_[order][1:] > 0)
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = np.where(name[order][1:] == name[order][:-1], 1 + np.cumprod(same, axis=1).sum(axis=1), 0)
    return order, lcp


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Some texts at a time: rows, their lengths, all their words and the text of each word."""
    for pdf in batches:
        piece = np.cumsum(pdf["n"].to_numpy(np.int64)) // PIECE
        for _, rows in pdf.groupby(piece, sort=False):
            lens = rows["n"].to_numpy(np.int64)
            yield rows, lens, np.frombuffer(b"".join(rows["words"]), dtype="<u4"), np.repeat(np.arange(len(lens)), lens)


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64)


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(1 << COUNTERS_LOG2, np.int64)
    for _, _, a, doc in _pieces(batches):
        counts += np.bincount(_counter(numbered_words(a, doc)[0]), minlength=len(counts))
    for i, part in enumerate(counts.reshape(16, -1)):
        if part.any():
            yield pd.DataFrame({"part": [i], "counts": [part.astype("<i4").tobytes()]})


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<i4").astype(np.int64) for x in pdf["counts"])
    return pd.DataFrame({"part": pdf["part"][:1], "counts": [np.minimum(total, 2**31 - 1).astype("<i4").tobytes()]})


def frequencies(texts: DataFrame) -> np.ndarray:
    """Upper bounds of the texts that hold a word, by the first bits of its name."""
    parts = texts.select("n", "words").mapInPandas(_sketched, "part int, counts binary").groupBy("part").applyInPandas(_added, "part int, counts binary")
    out = np.zeros((16, (1 << COUNTERS_LOG2) // 16), np.int32)
    for r in parts.collect():
        out[r.part] = np.frombuffer(r.counts, "<i4")
    return out.reshape(-1)


def _places(x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x stand in a sorted array, and where."""
    if not len(among):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return among[at] == x, at


def by_frequency(a: np.ndarray, doc: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """numbered_words of each text, rarest first."""
    h, where = numbered_words(a, doc)
    order = np.lexsort((h, doc << 32 | often[_counter(h)]))
    return h[order], where[order]


def listings(lens: np.ndarray, h: np.ndarray, where: np.ndarray, doc: np.ndarray, often: np.ndarray, longer: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """The suffixes of each text, by the number of shared words that name them: name, text, words after the last one in the
    order by frequency, words that a longer name could add, frequency of the first word, its place in the text's words, and the
    last one's in h. longer: per level the intervals that are named by one word more. Words of one text alone name none."""
    place = np.arange(len(h)) - (np.cumsum(lens) - lens)[doc]
    spare = lens - least_common(lens)
    at = np.flatnonzero((place <= spare[doc]) & (often[_counter(h)] > 1))
    name, first, begin = h[at], often[_counter(h[at])], where[at]
    for level in range(1, len(longer) + 2):
        d = doc[at]
        more = np.minimum(spare[d] + level, lens[d] - 1) - place[at]  # the next shared word is one of so many
        split = _places(name, longer[level - 1])[0] if level <= len(longer) else np.zeros(len(at), bool)
        keep = ~split
        yield name[keep], d[keep], lens[d[keep]] - 1 - place[at[keep]], more[keep], first[keep], begin[keep], at[keep]
        at, name, first, more, begin = at[split], name[split], first[split], more[split], begin[split]
        of = np.repeat(np.arange(len(at)), more)
        at = at[of] + 1 + np.arange(len(of)) - (np.cumsum(more) - more)[of]
        name, first, begin = _mixed(name[of] * _BASE + h[at]), first[of], begin[of]


def _list_sizes(often: np.ndarray, longer: list[np.ndarray], cap: int):
    """Sizes of the lists named by len(longer) + 1 words, those left out that cannot be long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, lens, a, doc in _pieces(batches):
            *_, (name, d, _, more, first, _, _) = listings(lens, *by_frequency(a, doc, often), doc, often, longer)
            may = first > cap
            side = rows["side"].to_numpy(np.int64)[d[may]]
            if len(side):
                x = pd.DataFrame({"name": name[may].view(np.int64), "e": (side & EVAL > 0).astype(np.int64), "t": (side & TRAIN > 0).astype(np.int64),
                                  "texts": 1, "more": more[may]})
                yield x.groupby("name", as_index=False, sort=False).sum()

    return run


def choices(n: np.ndarray, after: np.ndarray, level: np.ndarray | int, step: int) -> np.ndarray:
    """Of the words after the last one of a name of `level` words, how many can be the shared word `step` words beyond the next one."""
    return np.minimum(after, after + 1 + level - least_common(n) + step)


def _carried(short: np.ndarray, last: np.ndarray, count: np.ndarray) -> list[bytes]:
    """The names of the `count` words after each of these places, none where they are too many."""
    count = np.where(count <= CARRIED, count, 0)
    ends = np.cumsum(count)
    all_ = short[np.repeat(last + 1 - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    return [all_[2 * i:2 * j] for i, j in zip((ends - count).tolist(), ends.tolist(), strict=True)]


def _listed(often: np.ndarray, longer: list[np.ndarray], wide: dict[str, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, lens, a, doc in _pieces(batches):
            key, side = rows["text_key"].to_numpy(np.int64), rows["side"].to_numpy(np.int8)
            profile = np.array([x.tobytes() for x in profiles(a, doc, len(lens))] + [None], dtype=object)
            start = np.cumsum(lens) - lens
            h, where = by_frequency(a, doc, often)
            short = h.astype(np.uint16)
            for level, (name, d, after, _, _, begin, last) in enumerate(listings(lens, h, where, doc, often, longer), 1):
                is_wide, at = _places(name, wide["name"])
                i = np.flatnonzero(~is_wide)
                parts = [(name[i], i, side[d[i]])]
                if is_wide.any():  # own block of the own side, all blocks of the other
                    for bit, own, other in ((EVAL, "e", "t"), (TRAIN, "t", "e")):
                        i = np.flatnonzero(is_wide & (side[d] & bit > 0))
                        mine = (_mixed(key[d[i]].view(np.uint64)) % wide[own][at[i]].astype(np.uint64)).astype(np.int64)
                        count = wide[other][at[i]]
                        of = np.repeat(np.arange(len(i)), count)
                        others = np.arange(len(of)) - (np.cumsum(count) - count)[of]
                        e, t = (mine[of], others) if bit == EVAL else (others, mine[of])
                        block = _mixed(name[i[of]] + (e.astype(np.uint64) << np.uint64(32)) * _MIX + t.astype(np.uint64) * _BASE)
                        parts.append((block, i[of], np.full(len(of), bit, np.int8)))
                for name_, i, side_ in parts:
                    if len(i):
                        next_ = following(a, doc, begin[i])
                        carried = _carried(short, last[i], choices(lens[d[i]], after[i], level, STEPS - 1))
                        yield pd.DataFrame({"name": name_.view(np.int64), "text_key": key[d[i]], "side": side_, "level": np.int8(level), "n": lens[d[i]].astype(np.int32),
                                            "after": after[i].astype(np.int32), "place": (begin[i] - start[d[i]]).astype(np.int32),
                                            "next": [x.tobytes() + y for x, y in zip(next_, carried, strict=True)], "profile": profile[d[i]]})

    return run


def _list_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [x for x in batches if len(x)]
    if frames:
        f = {c: np.concatenate([x[c].to_numpy() for x in frames]) for c in frames[0].columns}
        del frames
        yield from Lists(f).pairs()


class Lists:
    """Pairs of an evaluation and a training text with suffixes in one interval that leave room for four fifths, and the span
    that these share. An entry is a suffix (its row), the list it stands in and how many of its carried words the list's name used."""

    def __init__(self, f: dict[str, np.ndarray], worth: float = WORTH_NAME, names: int = NAMES):
        self.worth, self.names, self.out, self.held, self.looked = worth, names, [], 0, 0
        next_ = f.pop("next")
        size = np.fromiter(map(len, next_), np.int64, len(next_)) // 2
        words, start = np.frombuffer(b"".join(next_), np.uint16), np.cumsum(size) - size
        next_ = words[start[:, None] + np.arange(NEXT)]
        order, lcp = suffix_order(f["name"], next_)
        f = {c: x[order] for c, x in f.items()}
        self.next, self.words, self.start, self.carried = next_[order], words, start[order] + NEXT, size[order] - NEXT
        self.profile = np.frombuffer(b"".join(f.pop("profile")), np.uint8).reshape(-1, 32)
        self.key, self.place, self.side = f["text_key"], f["place"], f["side"]
        self.n, self.after, self.level = (f[c].astype(np.int64) for c in ("n", "after", "level"))
        self.whole = self.carried == choices(self.n, self.after, self.level, STEPS - 1)
        self.of = np.cumsum(lcp == 0) - 1  # intervals of suffixes with a common prefix

    def pairs(self) -> Iterator[pd.DataFrame]:
        yield from self.divided(np.arange(len(self.of)), self.of, np.zeros(len(self.of), np.int64), 0)
        if self.held:
            yield self.flush()

    def flush(self) -> pd.DataFrame:
        a, b, pa, pb, words = (np.concatenate(x) for x in zip(*self.out, strict=True))
        self.out, self.held = [], 0
        return pd.DataFrame({"a": a, "b": b, "pa": pa, "pb": pb, "words": words}).drop_duplicates()

    def windows(self, row: np.ndarray, of: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of entries x and y, evaluation and training texts of one list whose lengths are near enough: e, t, and for each of e
        where its partners among t begin and how many they are."""
        e, t = x[self.side[row[x]] & EVAL > 0], y[self.side[row[y]] & TRAIN > 0]
        by = of[t] << 32 | self.n[row[t]]
        order = np.argsort(by, kind="stable")
        t, by = t[order], by[order]
        n, list_ = self.n[row[e]], of[e] << 32
        low, high = np.searchsorted(by, list_ | least_common(n), "left"), np.searchsorted(by, list_ | 5 * n // 4, "right")
        any_ = high > low
        return e[any_], t, low[any_], (high - low)[any_]

    def divided(self, row: np.ndarray, of: np.ndarray, used: np.ndarray, step: int, window: tuple[np.ndarray, ...] | None = None) -> Iterator[pd.DataFrame]:
        e, t, low, count = window or self.windows(row, of, np.arange(len(row)), np.arange(len(row)))
        if not len(e):
            return
        can = self.whole[row] & (least_common(self.n[row]) > self.level[row] + step)  # a near copy must share a further word
        more = np.where(can, choices(self.n[row], self.after[row], self.level[row], step) - used, 0)
        pairs = np.bincount(of[e], count, of.max() + 1)
        deep = (pairs > self.worth * np.bincount(of, more, len(pairs))) & (step < STEPS)
        if not deep.any():
            yield from self.looked_at(row, used, step, e, t, low, count)
            return
        can &= deep[of]
        i = ~can[e]
        yield from self.looked_at(row, used, step, e[i], t, low[i], count[i])
        odd = np.flatnonzero(deep[of] & ~can)
        if len(odd):
            yield from self.looked_at(row, used, step, *self.windows(row, of, np.flatnonzero(can), odd))
        at = np.flatnonzero(can)
        at = at[np.argsort(of[at], kind="stable")]
        ends = np.cumsum(more[at])
        last = np.append(of[at][1:] != of[at][:-1], True)  # lists stay whole
        cuts, done = np.flatnonzero(last) + 1, 0
        while done < len(at):
            upto = ends[done] - more[at[done]] + self.names
            to = max(cuts[np.searchsorted(cuts, done, "right")], cuts[max(0, np.searchsorted(ends[cuts - 1], upto, "right") - 1)])
            yield from self.named(row, of, used, step, at[done:to], more)
            done = to

    def named(self, row: np.ndarray, of: np.ndarray, used: np.ndarray, step: int, at: np.ndarray, more: np.ndarray) -> Iterator[pd.DataFrame]:
        """The lists of these entries divided by one shared word more, those left as they are that it would not halve."""
        count = more[at]
        from_ = np.repeat(at, count)
        nth = np.arange(len(from_)) - np.repeat(np.cumsum(count) - count, count) + used[from_]
        name = of[from_] << 16 | self.words[self.start[row[from_]] + nth]
        order = np.argsort(name)
        name, from_, nth = name[order], from_[order], nth[order]
        new = np.append(True, name[1:] != name[:-1])
        begin, list_, side = np.flatnonzero(new), np.cumsum(new) - 1, self.side[row[from_]]
        both = (np.bitwise_or.reduceat(side, begin) == EVAL | TRAIN)[list_] & (np.diff(np.append(begin, len(name))) > 1)[list_] if len(name) else np.zeros(0, bool)
        list_, from_, nth = list_[both], from_[both], nth[both]
        row_, used_, all_ = row[from_], nth + 1, np.arange(len(list_))
        window = self.windows(row_, list_, all_, all_)
        whole = self.windows(row, of, at, at)
        base = of[at].min()
        before = np.bincount(of[whole[0]] - base, whole[3], of[at].max() - base + 1)
        after = np.bincount(of[from_[window[0]]] - base, window[3], len(before))
        poor = 2 * after > before
        if poor.any():
            i = poor[of[whole[0]] - base]
            yield from self.looked_at(row, used, step, whole[0][i], whole[1], whole[2][i], whole[3][i])
            keep = ~poor[of[from_] - base]
            row_, list_, used_, window = row_[keep], list_[keep], used_[keep], None
        if len(row_):
            yield from self.divided(row_, list_, used_, step + 1, window)

    def looked_at(self, row: np.ndarray, used: np.ndarray, step: int, e: np.ndarray, t: np.ndarray, low: np.ndarray, count: np.ndarray) -> Iterator[pd.DataFrame]:
        ends, done = np.cumsum(count), 0
        while done < len(e):
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + 500_000, "right")))
            c = count[done:to]
            i = np.repeat(e[done:to], c)
            j = t[np.repeat(low[done:to] - (np.cumsum(c) - c), c) + np.arange(len(i))]
            done = to
            self.looked += len(i)
            x, y = row[i], row[j]
            least = least_common(np.maximum(self.n[x], self.n[y]))
            shared = np.minimum(self.level[x] + self.after[x] - used[i], self.level[y] + self.after[y] - used[j]) + step
            good = (self.key[x] != self.key[y]) & (shared >= least)
            x, y, least = x[good], y[good], least[good]
            fits = may_overlap(self.profile[x], self.profile[y], least, self.n[x], self.n[y])
            x, y = x[fits], y[fits]
            words = 1 + np.cumprod((self.next[x] == self.next[y]) & (self.next[x] > 0), axis=1).sum(axis=1)
            self.out.append((self.key[x], self.key[y], self.place[x], self.place[y], words.astype(np.int32)))
            self.held += len(x)
            if self.held > 1_000_000:
                yield self.flush()


def candidates(texts: DataFrame, cap: int = CAP) -> DataFrame:
    """a, b, spans: keys of an evaluation text and a training text with suffixes in one interval that may share four fifths, and
    where their spans begin in either, with as many words as the suffix array shows of them."""
    spark = texts.sparkSession
    texts = texts.filter("n > 1")  # one word: near copies are equal
    often = frequencies(texts)
    rows = texts.select(F.sum(F.expr("n - (4 * n + 4) div 5 + 1"))).first()[0] or 0
    longer: list[np.ndarray] = []
    wide = pd.DataFrame({"name": [], "e": [], "t": []}, dtype=np.int64)
    level_rows = rows
    for level in range(1, LEVELS + 1):
        least = max(cap, level_rows // LONG_LISTS)
        if often.max() <= least:
            break
        sizes = texts.select("side", "n", "words").mapInPandas(_list_sizes(often, longer, least), "name bigint, e bigint, t bigint, texts bigint, more bigint")
        long = sizes.groupBy("name").agg(*(F.sum(c).alias(c) for c in ("e", "t", "texts", "more"))).filter(
            f"texts > {least} AND e > 0 AND t > 0").toPandas().astype(np.int64)
        split = (long["e"] * long["t"] > (WORTH * long["more"]).clip(lower=BLOCK * BLOCK)) & (long["more"] <= SPREAD * long["texts"]) & (level < LEVELS)
        split &= bool((long["e"] * long["t"])[split].sum() > AGAIN * rows)
        whole = long[~split & (long["e"] * long["t"] > BLOCK * BLOCK)]
        wide = pd.concat([wide, whole[["name", "e", "t"]]])
        rows += int((whole["texts"] * (-(-whole["e"] // BLOCK) + -(-whole["t"] // BLOCK))).sum())
        if not split.any():
            break
        level_rows = int(long["more"][split].sum())
        rows += level_rows
        longer.append(np.sort(long["name"][split].to_numpy().view(np.uint64)))
    wide["name"] = wide["name"].to_numpy().view(np.uint64)
    wide = wide.sort_values("name")
    blocks = {"name": wide["name"].to_numpy(), **{c: -(-wide[c].to_numpy() // BLOCK) for c in "et"}}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 500_000 + 1)
    lists = texts.mapInPandas(_listed(often, longer, blocks), "name bigint, text_key bigint, side tinyint, level tinyint, n int, after int, place int, next binary, profile binary")
    found = lists.repartition(parts, "name").mapInPandas(_list_pairs, "a bigint, b bigint, pa int, pb int, words int")
    return found.groupBy("a", "b").agg(F.collect_set(F.struct("pa", "pb", "words")).alias("spans"))  # no more than a text's suffixes


def common_words(x: bytes, y: bytes) -> int:
    """Length of the longest common subsequence of two rows of 32-bit word names, by bit-parallel columns."""
    a, b = np.frombuffer(x, "<u4").tolist(), np.frombuffer(y, "<u4").tolist()
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if m := where.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return head + tail + len(a) - v.bit_count()


def covered_words(x: bytes, y: bytes, spans: Iterable[tuple[int, int, int]]) -> int:
    """Words of either text in shared spans that stand in the same order in both: spans from these places on, extended to
    maximal ones, longest first, each cut to what the ones before it leave free."""
    a, b = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
    maximal: dict[int, list[tuple[int, int]]] = {}
    for i, j, words in sorted(spans):
        known = maximal.setdefault(i - j, [])
        if known and known[-1][1] >= i + words:
            continue
        if a[i] != b[j]:
            continue  # the name was of other words
        m = min(len(a) - i, len(b) - j)
        differ = a[i:i + m] != b[j:j + m]
        right = int(differ.argmax()) if differ.any() else m
        m = min(i, j)
        differ = (a[i - m:i] != b[j - m:j])[::-1]
        left = int(differ.argmax()) if differ.any() else m
        known.append((i - left, i + right))
    taken: list[tuple[int, int, int, int]] = []
    for size, d, start, end in sorted(((end - start, d, start, end) for d, known in maximal.items() for start, end in known), reverse=True):
        for p, q, r, s in taken:
            # before or after the span taken in both texts, cut where it overlaps
            if start < p and start - d < r:
                end = min(end, p, r + d)
            else:
                start = max(start, q, s + d)
        if end > start:
            taken.append((start, end, start - d, end - d))
    return sum(q - p for p, q, _, _ in taken)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        covered = [covered_words(x, y, [(s["pa"], s["pb"], s["words"]) for s in z]) for x, y, z in zip(pdf["wa"], pdf["wb"], pdf["spans"], strict=True)]
        near = [c * 20 >= 4 * max(len(x), len(y)) or common_words(x, y) * 5 >= 4 * (max(len(x), len(y)) // 4) for c, x, y in zip(covered, pdf["wa"], pdf["wb"], strict=True)]
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "coverage": [4.0 * c / len(x) for c, x in zip(covered, pdf["wa"], strict=True)]})[near]


def near_texts(tok: DataFrame, cap: int = CAP) -> DataFrame:
    """a, b, coverage: keys of evaluation and training texts of which at least four fifths of either's words stand in the other
    in order, and the share of the evaluation text that shared spans cover."""
    texts = tok.filter("sides IS NOT NULL").select("text_key", F.col("sides").alias("side"), "n", "words")
    pairs = written(candidates(texts, cap))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("text_key")).distinct()
    texts = written(texts.select("text_key", "words").join(needed, "text_key", "left_semi"))
    wa, wb = (texts.select(F.col("text_key").alias(k), F.col("words").alias("w" + k)) for k in "ab")
    return written(pairs.join(wa, "a").join(wb, "b").select("a", "b", "spans", "wa", "wb").mapInPandas(_verify, "a bigint, b bigint, coverage double"))


def split_side(split: Column) -> Column:
    name = F.lower(F.trim(split))
    return F.when(name == "train", TRAIN).when(name.isin("test", "valid"), EVAL)


def pairs(df: DataFrame, id_col: str = "source_id", data: str = "data", split: str = "split", cap: int = CAP) -> DataFrame:
    """eval_id, train_id, coverage of all pairs of copies (covered in full) and near-copies across the splits."""
    tok = tokens(df, id_col, data, split_side(F.col(split)))
    near = near_texts(tok, cap)
    ids = tok.select("id", "side", "text_key")
    e = ids.filter(f"side = {EVAL}").select(F.col("id").alias("eval_id"), F.col("text_key").alias("a"))
    t = ids.filter(f"side = {TRAIN}").select(F.col("id").alias("train_id"), F.col("text_key").alias("b"))
    of_near = near.join(e, "a").join(t, "b").select("eval_id", "train_id", "coverage")
    keyed = linked_keys(tok.select("id", "p", "c", "side"))
    ke = keyed.filter(f"side = {EVAL}").select(F.col("id").alias("eval_id"), "data_key")
    kt = keyed.filter(f"side = {TRAIN}").select(F.col("id").alias("train_id"), "data_key")
    of_key = ke.join(kt, "data_key").select("eval_id", "train_id", F.lit(1.0).alias("coverage"))
    return of_near.unionByName(of_key).groupBy("eval_id", "train_id").agg(F.max("coverage").alias("coverage"))


def found(df: DataFrame, **options) -> DataFrame:
    both = pairs(df, **options)
    return both.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b"))


def report(df: DataFrame, id_col: str = "source_id", split: str = "split", source: str = "dataset", **options) -> DataFrame:
    """Per evaluation split and source: its rows, those that occur in training, the pairs, and how much of a row that occurs
    the shared spans with its best partner cover on average."""
    both = pairs(df, id_col=id_col, split=split, **options)
    per_row = both.groupBy(F.col("eval_id").alias("id")).agg(F.count("*").alias("pairs"), F.max("coverage").alias("coverage"))
    rows = df.select(F.col(id_col).alias("id"), F.lower(F.trim(split)).alias("split"), F.col(source).alias("source")).filter("split IN ('test', 'valid')")
    return rows.join(per_row, "id", "left").groupBy("split", "source").agg(
        F.count("*").alias("rows"), F.count("pairs").alias("leaked_rows"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))
