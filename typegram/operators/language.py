"""Languages of grammars as deterministic acyclic automata per word length: sizes, ranks, words; one grammar per task.

A state is a set of sequences of (symbol, length) still to be derived; following a token rewrites their first symbols.
Equal sets are one state, so counts are of distinct words, however ambiguous the grammar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

State = frozenset[tuple[tuple[str, int], ...]]


class StateLimit(RuntimeError):
    """The automaton needs more states than allowed."""


class Language:
    """Words of a grammar in normal form, by length and lexicographic order of their tokens."""

    def __init__(self, rules: list[tuple[str, list[str]]], start: str = "START", max_states: int = 500_000):
        self.start, self.max_states = start, max_states
        self.terminal: dict[str, list[str]] = {}
        self.binary: dict[str, list[tuple[str, str]]] = {}
        for lhs, rhs in rules:
            if len(rhs) == 1:
                self.terminal.setdefault(lhs, []).append(rhs[0])
            else:
                self.binary.setdefault(lhs, []).append((rhs[0], rhs[1]))
        self.moves: dict[State, list[tuple[str, State]]] = {}
        self.counts: dict[State, int] = {}
        self._derives: dict[tuple[str, int], bool] = {}

    def derives(self, symbol: str, n: int) -> bool:
        """Whether symbol has a word of n tokens."""
        key = symbol, n
        if key not in self._derives:
            for m in range(1, n + 1):  # shorter lengths first, so recursion stays shallow
                for s in {*self.terminal, *self.binary}:
                    if (s, m) not in self._derives:
                        self._derives[s, m] = (m == 1 and s in self.terminal) or any(
                            self._derives.get((a, k), False) and self._derives.get((b, m - k), False) for a, b in self.binary.get(s, ()) for k in range(1, m))
            self._derives.setdefault(key, False)
        return self._derives[key]

    def first(self, length: int) -> State:
        return frozenset({((self.start, length),)}) if length > 0 and self.derives(self.start, length) else frozenset()

    def step(self, state: State) -> list[tuple[str, State]]:
        known = self.moves.get(state)
        if known is not None:
            return known
        if len(self.moves) >= self.max_states:
            raise StateLimit(f"more than {self.max_states} states")
        out: dict[str, set] = {}
        todo, seen = list(state), set(state)
        while todo:
            item = todo.pop()
            if not item:
                continue
            (symbol, n), rest = item[0], item[1:]
            if n == 1:
                for token in self.terminal.get(symbol, ()):
                    out.setdefault(token, set()).add(rest)
            for a, b in self.binary.get(symbol, ()):
                for k in range(1, n):
                    if self.derives(a, k) and self.derives(b, n - k):
                        new = ((a, k), (b, n - k), *rest)
                        if new not in seen:
                            seen.add(new)
                            todo.append(new)
        result = self.moves[state] = sorted((t, frozenset(s)) for t, s in out.items())
        return result

    def size_of(self, state: State) -> int:
        if state in self.counts:
            return self.counts[state]
        stack = [state]
        while stack:
            s = stack[-1]
            if s in self.counts:
                stack.pop()
                continue
            missing = [c for _, c in self.step(s) if c not in self.counts]
            if missing:
                stack += missing
            else:
                self.counts[s] = (1 if () in s else 0) + sum(self.counts[c] for _, c in self.step(s))
                stack.pop()
        return self.counts[state]

    def size(self, length: int) -> int:
        return self.size_of(self.first(length)) if length > 0 else 0

    def contains(self, word: list[str]) -> bool:
        return bool(word) and self.rank(word) is not None

    def rank(self, word: list[str]) -> int | None:
        """Position among the words of its length; None for no word."""
        state, r = self.first(len(word)), 0
        for token in word:
            after = None
            for t, child in self.step(state) if state else ():
                if t == token:
                    after = child
                    break
                if t > token:
                    break
                r += self.size_of(child)
            if after is None:
                return None
            state = after
        return r

    def unrank(self, length: int, rank: int) -> list[str]:
        if not 0 <= rank < self.size(length):
            raise IndexError(rank)
        state, out = self.first(length), []
        for _ in range(length):
            for token, child in self.step(state):
                n = self.size_of(child)
                if rank < n:
                    out.append(token)
                    state = child
                    break
                rank -= n
        return out

    def shortlex_rank(self, word: list[str]) -> int | None:
        r = self.rank(word)
        return None if r is None else r + sum(self.size(n) for n in range(1, len(word)))

    def shortlex_unrank(self, rank: int, max_length: int) -> list[str]:
        """The word at a rank over all lengths; slices are built only as far as they are needed."""
        for n in range(1, max_length + 1):
            size = self.size(n)
            if rank < size:
                return self.unrank(n, rank)
            rank -= size
        raise IndexError(rank)

    def words(self, length: int) -> Iterator[list[str]]:
        for r in range(self.size(length)):
            yield self.unrank(length, r)

    def edges(self, length: int) -> list[tuple[int, str, int]]:
        """(state, token, child) of the minimal numbering from the first state."""
        ids: dict[State, int] = {self.first(length): 0}
        out, todo = [], [self.first(length)]
        while todo:
            s = todo.pop(0)
            for token, child in self.step(s):
                if child not in ids:
                    ids[child] = len(ids)
                    todo.append(child)
                out.append((ids[s], token, ids[child]))
        return out


def per_grammar(rules: DataFrame, key: str, f: Callable[[str, Language], pd.DataFrame], schema: str, start: str = "START", max_states: int = 500_000) -> DataFrame:
    """f(key, language) for every group of rules(key, lhs, rhs array<string>) in normal form."""

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        language = Language([(a, list(b)) for a, b in zip(pdf["lhs"], pdf["rhs"], strict=True)], start, max_states)
        return f(k[0], language)

    return rules.groupBy(key).applyInPandas(run, schema)


def sizes(rules: DataFrame, key: str, max_length: int, **options) -> DataFrame:
    """key, length, size (exact, as text) and log10."""
    import math

    def f(k, language):
        got = [(n, language.size(n)) for n in range(1, max_length + 1)]
        return pd.DataFrame([(k, n, str(s), math.log10(s) if s else None) for n, s in got], columns=[key, "length", "size", "log10"])

    return per_grammar(rules, key, f, f"{key} string, length int, size string, log10 double", **options)


class Derivations:
    """Derivations of a grammar in normal form by length, ambiguity kept: totals and the derivation at a rank."""

    def __init__(self, rules: list[tuple[str, list[str]]], start: str = "START"):
        self.start = start
        self.rules: dict[str, list[list[str]]] = {}
        for lhs, rhs in sorted(rules):
            self.rules.setdefault(lhs, []).append(rhs)
        self._count: dict[tuple[str, int], int] = {}

    def count(self, symbol: str, n: int) -> int:
        """Derivations of n tokens from symbol."""
        for m in range(1, n + 1):
            for s in self.rules:
                if (s, m) not in self._count:
                    self._count[s, m] = sum(
                        int(m == 1) if len(r) == 1 else sum(self._count.get((r[0], k), 0) * self._count.get((r[1], m - k), 0) for k in range(1, m)) for r in self.rules[s])
        return self._count.get((symbol, n), 0)

    def unrank(self, n: int, rank: int, symbol: str | None = None) -> list[str]:
        """Tokens of the derivation at a rank in order of rules, then splits, then the parts' ranks."""
        symbol = symbol or self.start
        if not 0 <= rank < self.count(symbol, n):
            raise IndexError(rank)
        for r in self.rules[symbol]:
            if len(r) == 1:
                if n == 1:
                    if rank == 0:
                        return [r[0]]
                    rank -= 1
                continue
            for k in range(1, n):
                a, b = self.count(r[0], k), self.count(r[1], n - k)
                if rank < a * b:
                    return self.unrank(k, rank // b, r[0]) + self.unrank(n - k, rank % b, r[1])
                rank -= a * b
        raise IndexError(rank)
