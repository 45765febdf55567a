"""Encoding of texts with a byte-level BPE vocabulary, by tree concatenation.

A text is cut in halves, and these again, down to leaves of `leaf` characters. A leaf is split into pre-tokens and encoded.
Two neighbours are then joined: a window of the last words of the left part and the first of the right one is split and
encoded anew and grows until both of its sides agree exactly with the parts, the left one in a whole word and the right
one in a whole word that starts at the same place; what lies beyond either is then right as it stands, as a pre-token
depends on nothing before it and on no more than the next word after it. A pre-token longer than a leaf that runs across
the join is joined as bytes in the same way: the tokens about the join are encoded anew in a growing window until the
pairs of tokens at its edges encode to themselves, which for BPE makes the whole sequence the encoding of the bytes.
Every text goes this way. Texts of more than `piece` characters are spread over tasks, whose parts are joined alike.

Defined cases: NULL and empty text have the empty list; texts that look like special tokens are ordinary text; repeated
rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every function here.
TOKENIZERS = os.environ.get("TYPEGRAM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: The published pre-tokenisation of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf, and of the part of a text that one task encodes.
LEAF, PIECE = 256, 1 << 16
_PRE = regex.compile(PATTERN)
_ENCODERS: dict[str, Bpe] = {}


class Bpe:
    """Words of a text with their token ids; a part of a text is a pair of lists, its words and the ids of each."""

    def __init__(self, name: str, ranks: dict[bytes, int]):
        import tiktoken

        self.plain = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single = self.plain._encode_single_piece
        self.token = self.plain.decode_single_token_bytes
        self.word = lru_cache(maxsize=200_000)(lambda w: self.single(w.encode("utf-8", "replace")))

    def leaf(self, text: str) -> tuple[list[str], list[list[int]]]:
        words = _PRE.findall(text)
        return words, [self.word(w) for w in words]

    def agrees(self, a: int, b: int) -> bool:
        return self.single(self.token(a) + self.token(b)) == [a, b]

    def joined_tokens(self, left: list[int], right: list[int], window: int = 8) -> list[int]:
        """Encoding of the concatenation of two encoded parts of one pre-token."""
        if not left or not right or self.agrees(left[-1], right[0]):
            return left + right
        while True:
            i, j = max(0, len(left) - window), min(len(right), window)
            mid = self.single(b"".join(map(self.token, left[i:])) + b"".join(map(self.token, right[:j])))
            if (i == 0 or self.agrees(left[i - 1], mid[0])) and (j == len(right) or self.agrees(mid[-1], right[j])):
                return left[:i] + mid + right[j:]
            window *= 2

    def joined(self, left: tuple, right: tuple, leaf: int, window: int = 3) -> tuple:
        """Encoding of the concatenation of two encoded parts of a text."""
        (lw, li), (rw, ri) = left, right
        if not lw or not rw:
            return left if lw else right
        while True:
            i, j = max(0, len(lw) - window), min(len(rw), window)
            head, tail = "".join(lw[i:]), "".join(rw[:j])
            words = _PRE.findall(head + tail)
            # the left side agrees where the window's first word is the part's, isn't blank and ends before its part does
            ok = i == 0 or words[0] == lw[i] and len(words[0]) < len(head) and not words[0].isspace()
            size, cut, keep = len(head) + len(tail), len(words), j
            if ok and j < len(rw):  # the right side agrees in the last whole word but one that starts and ends at the same places
                starts, at = {}, len(head)
                for k in range(j - 1):
                    starts[at] = k
                    at += len(rw[k])
                at, ok = 0, False
                for n, w in enumerate(words):
                    k = starts.get(at)
                    if k is not None and rw[k] == w and not w.isspace() and at + len(w) < size:
                        cut, keep, ok = n, k, True
                        break
                    at += len(w)
            if ok:
                mid, ids, at, whole = words[:cut], [], 0, len(head)
                for w in mid:
                    end = at + len(w)
                    ids.append(self._ids(w, whole - at if at < whole < end else 0, i, left, right, leaf))
                    at = end
                return lw[:i] + mid + rw[keep:], li[:i] + ids + ri[keep:]
            window *= 2

    def _ids(self, w: str, inside: int, i: int, left: tuple, right: tuple, leaf: int) -> list[int]:
        """Ids of a word of the window, of which the first `inside` characters end the left part where that is not 0."""
        if len(w) <= leaf:
            return self.word(w)
        (lw, li), (rw, ri) = left, right
        if inside:
            a, b = w[:inside], w[inside:]
            return self.joined_tokens(li[-1] if lw[-1] == a else self.cut_word(a, leaf), ri[0] if rw[0] == b else self.cut_word(b, leaf))
        for words, ids in ((lw[i:], li[i:]), right):
            if w in words:
                return ids[words.index(w)]
        return self.cut_word(w, leaf)

    def cut_word(self, w: str, leaf: int) -> list[int]:
        if len(w) <= leaf:
            return self.single(w.encode("utf-8", "replace"))
        return self.joined_tokens(self.cut_word(w[:len(w) // 2], leaf), self.cut_word(w[len(w) // 2:], leaf))

    def tree(self, text: str, leaf: int) -> tuple:
        if len(text) <= leaf:
            return self.leaf(text)
        half = len(text) // 2
        return self.joined(self.tree(text[:half], leaf), self.tree(text[half:], leaf), leaf)

    def concatenated(self, parts: list[tuple], leaf: int) -> list[int]:
        """The parts' tree, from the bottom up."""
        while len(parts) > 1:
            parts = [self.joined(*parts[i:i + 2], leaf) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return [t for ids in parts[0][1] for t in ids] if parts else []


def encoder(folder: str, vocabulary: str) -> Bpe:
    path = os.path.join(folder, f"{vocabulary}.tiktoken")
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = Bpe(vocabulary, ranks)
    return _ENCODERS[path]


def _encode_texts(folder: str, vocabulary: str, leaf: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, vocabulary)
        for pdf in batches:
            pdf["ids"] = [enc.concatenated([enc.tree(t, leaf)], leaf) if t else [] for t in pdf.pop("text")]
            yield pdf

    return run


def _encode_pieces(folder: str, vocabulary: str, leaf: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, vocabulary)
        for pdf in batches:
            got = [enc.tree(t, leaf) for t in pdf.pop("text")]
            yield pdf.assign(words=[x[0] for x in got], ids=[x[1] for x in got])

    return run


def encoded(df: DataFrame, id_col: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY,
            leaf: int = LEAF, piece: int = PIECE) -> DataFrame:
    """id, ids of every row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ids = rows.filter(f"text IS NULL OR length(text) <= {piece}").mapInPandas(_encode_texts(folder, vocabulary, leaf), f"id {kind}, ids array<int>")
    long = rows.filter(f"length(text) > {piece}").withColumn("row", F.monotonically_increasing_id())
    cut = long.withColumn("no", F.explode(F.expr(f"sequence(0, (length(text) - 1) div {piece})"))).withColumn(
        "text", F.expr(f"substring(text, cast(no * {piece} + 1 AS INT), {piece})"))
    parts = cut.repartition("row", "no").mapInPandas(_encode_pieces(folder, vocabulary, leaf), f"id {kind}, row bigint, no bigint, words array<string>, ids array<array<int>>")

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        parts = [(list(w), [[int(t) for t in x] for x in i]) for w, i in zip(pdf["words"], pdf["ids"], strict=True)]
        return pd.DataFrame([[pdf["id"].iloc[0], encoder(folder, vocabulary).concatenated(parts, leaf)]], columns=["id", "ids"])

    return ids.unionByName(parts.groupBy("row").applyInPandas(whole, f"id {kind}, ids array<int>")).select(F.col("id").alias(id_col), "ids")
