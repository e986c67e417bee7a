"""Exact BPE encodings of every prefix of a symbol sequence, without running merges over the whole of it.

A greedy (rank-ordered) BPE encoding has two properties used here:

* cutting an encoding after one of its tokens leaves the encoding of the shorter sequence;
* a token sequence is the encoding of its concatenation exactly if each token, and each neighbouring pair of
  tokens, encodes to itself.

So the last token of the encoding of a prefix ending at ``i`` is the one token ``t`` that ends there and is
compatible with the last token of the prefix ending where ``t`` begins. One such back-pointer per prefix gives the
token count (and, by walking back, the ids) of each prefix.

Merges are only ever run on single tokens. They give a token's spines: the nodes of its merge tree that hold its first
(last) letter, each with the rank of the merge that ends it. Two tokens are compatible if at no time two nodes that meet
at their border would merge before either is merged into its own token; such decisions are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable


def spines(symbols: list[str], rank: Callable[[str, str], int | None]):
    """Left and right spine of a token made by merging ``symbols``: (node, rank of the merge that ends it), innermost first.

    None if the symbols do not merge into one.
    """
    symbols, left, right = list(symbols), [], []
    while len(symbols) > 1:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            r = rank(symbols[i], symbols[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return None
        if at == 0:
            left.append((symbols[0], best))
        if at + 2 == len(symbols):
            right.append((symbols[-1], best))
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return [*left, (symbols[0], math.inf)], [*right, (symbols[0], math.inf)]


def apart(right: list, left: list, rank: Callable[[str, str], int | None]) -> bool:
    """Whether a token with this ``right`` spine stays apart from a next token with this ``left`` spine.

    Of merges with one rank the leftmost comes first: at the border after those of the token before, ahead of the next's.
    """
    i = j = 0
    while True:
        (a, a_ends), (b, b_ends) = right[i], left[j]
        r = rank(a, b)
        if r is not None and r < a_ends and r <= b_ends:
            return False
        if a_ends == b_ends == math.inf:
            return True
        if a_ends <= b_ends:
            i += 1
        else:
            j += 1


class Sizes(dict):
    """``sizes[end]``: lengths of the tokens that may end where a text ends with the letters ``end`` (three, if it has as
    many). One token at most is compatible, so the order is free: lengths that were right move forward."""

    def __init__(self, tokens):
        super().__init__()
        found: dict[str, set[int]] = {}
        for t in tokens:
            if len(t) > 1:
                found.setdefault(t[-3:], set()).add(len(t))
        self.two = {end for end in found if len(end) == 2}
        for end, sizes in found.items():
            self[end] = (*sorted(sizes | {2} if end[-2:] in self.two else sizes, reverse=True), 1)

    def __missing__(self, end: str) -> tuple[int, ...]:
        found = (2, 1) if end[-2:] in self.two else (1,)
        if len(self) < 200_000:
            self[end] = found
        return found


def spines(symbols: list[str], rank: Callable[[str, str], int | None]):
    """Left and right spine of a token made by merging ``symbols``: (node, rank of the merge that ends it), innermost first.

    None if the symbols do not merge into one.
    """
    symbols, left, right = list(symbols), [], []
    while len(symbols) > 1:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            r = rank(symbols[i], symbols[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return None
        if at == 0:
            left.append((symbols[0], best))
        if at + 2 == len(symbols):
            right.append((symbols[-1], best))
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return [*left, (symbols[0], math.inf)], [*right, (symbols[0], math.inf)]


def apart(right: list, left: list, rank: Callable[[str, str], int | None]) -> bool:
    """Whether a token with this ``right`` spine stays apart from a next token with this ``left`` spine.

    Of merges with one rank the leftmost comes first: at the border after those of the token before, ahead of the next's.
    """
    i = j = 0
    while True:
        (a, a_ends), (b, b_ends) = right[i], left[j]
        r = rank(a, b)
        if r is not None and r < a_ends and r <= b_ends:
            return False
        if a_ends == b_ends == math.inf:
            return True
        if a_ends <= b_ends:
            i += 1
        else:
            j += 1


def sizes_by_end(tokens) -> dict[str, tuple[int, ...]]:
    """Lengths of the tokens (of two letters or more) that end with each pair of letters, longest first, then 1."""
    found: dict[str, set[int]] = {}
    for t in tokens:
        if len(t) > 1:
            found.setdefault(t[-2:], set()).add(len(t))
    return {end: (*sorted(sizes, reverse=True), 1) for end, sizes in found.items()}


class PrefixTable:
    """Back-pointers ``prefix -> (last token, sum of units so far)`` of words, kept across words that share prefixes.

    The unit of a token is 1 for counts; anything that adds up will do (packed ids, for an encoder).

    ``tokens``: token strings that may stand inside or at the end of a word. ``final``: tokens that carry a word-end
    mark, without the mark, or None if the vocabulary has no such mark. The table is emptied when it passes ``limit``
    entries, so its memory is bounded whatever the corpus holds; words longer than ``long_word`` use a window over the
    back-pointers instead of the table.
    """

    def __init__(self, tokens, rank, final=None, end_mark="", limit=300_000, long_word=48, unit=None):
        self.tokens, self.rank, self.final, self.mark = tokens, rank, final, end_mark
        self.limit, self.long_word = limit, long_word
        self.unit = unit or (lambda token: 1)
        self.longest = max(map(len, tokens), default=1)
        self.longest_final = max(map(len, final), default=1) if final is not None else 0
        self.sizes = Sizes(tokens)
        self.final_sizes = Sizes(final or ())
        self.table: dict[str, tuple[str, int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.ends: dict[tuple[str, str], bool] = {}
        self.trees: dict[tuple[str, bool], tuple | None] = {}
        self.closed: dict[str, tuple[str, int]] = {}

    def forget(self) -> None:
        self.table.clear()
        self.pairs.clear()
        self.ends.clear()
        self.trees.clear()
        self.closed.clear()

    def tree(self, token: str, final: bool = False) -> tuple | None:
        """Spines of a token; None if it does not encode to itself."""
        key = (token, final)
        if key not in self.trees:
            if len(self.trees) > self.limit:
                self.trees.clear()
            self.trees[key] = spines(self._symbols(token, final), self.rank)
        return self.trees[key]

    def _symbols(self, token: str, final: bool) -> list[str]:
        return [*token[:-1], token[-1] + self.mark] if final else list(token)

    def fits(self, before: str, token: str, final: bool = False) -> bool:
        """True if ``before`` + ``token`` encodes to just these two (``before`` empty: ``token`` to itself)."""
        known = self.ends if final else self.pairs
        key = (before, token)
        found = known.get(key)
        if found is None:
            if len(known) > self.limit:
                known.clear()
            own = self.tree(token, final)
            found = known[key] = own is not None and (not before or apart(self.tree(before)[1], own[0], self.rank))
        return found

    def last(self, prefix: str) -> tuple[str, int]:
        """Last token and sum of units of the encoding of ``prefix`` read as the inside of a word."""
        found = self.table.get(prefix)
        if found is not None:
            return found
        n, tokens, pairs = len(prefix), self.tokens, self.pairs
        for size in self.sizes[prefix[-3:]]:
            if size > n:
                continue
            token = prefix[n - size :]
            if size > 1 and token not in tokens:
                continue
            if size == n:
                if self.fits("", token):
                    found = (token, self.unit(token))
                    break
                continue
            before = self.table.get(prefix[: n - size]) or self.last(prefix[: n - size])
            ok = pairs.get((before[0], token))
            if ok is None:
                ok = self.fits(before[0], token)
            if ok:
                found = (token, before[1] + self.unit(token))
                break
        if len(self.table) > self.limit:
            self.table.clear()
        self.table[prefix] = found
        return found

    def close(self, prefix: str) -> tuple[str, int]:
        """Last token and sum of units of ``prefix`` read as a whole word."""
        if self.final is None:
            return self.last(prefix)
        found = self.closed.get(prefix)
        if found is None:
            if len(self.closed) > self.limit:
                self.closed.clear()
            found = self.closed[prefix] = self._close(prefix)
        return found

    def _close(self, prefix: str) -> tuple[str, int]:
        n = len(prefix)
        for size in self.final_sizes[prefix[-3:]]:
            if size > n:
                continue
            token = prefix[n - size :]
            if size > 1 and token not in self.final:
                continue
            if size == n:
                if self.fits("", token, True):
                    return token, self.unit(token)
                continue
            before = self.last(prefix[: n - size])
            if self.fits(before[0], token, True):
                return token, before[1] + self.unit(token)
        raise ValueError("no encoding")

    def counts(self, word: str) -> list[int]:
        """Token count of each prefix of ``word``, each read as a whole word."""
        if len(word) <= self.long_word:
            return [self.close(word[:i])[1] for i in range(1, len(word) + 1)]
        return [c for _, c in self._walk(word, True)]

    def count(self, word: str) -> int:
        """Token count of the whole ``word``."""
        if len(word) <= self.long_word:
            return self.close(word)[1]
        for last in self._walk(word, False):
            pass
        return last[1]

    def _walk(self, word: str, every: bool):
        """Yields (prefix length, count as a whole word); holds as many back-pointers as the longest token is long."""
        window: list[tuple[str, int]] = []
        keep, n = max(self.longest, self.longest_final), len(word)
        for i in range(1, n + 1):
            if every or i == n:
                yield i, self._step(word, i, window, True)[1]
            window.append(self._step(word, i, window, False))
            if len(window) > keep:
                del window[0]

    def _step(self, word: str, i: int, window: list, closing: bool) -> tuple[str, int]:
        closing = closing and self.final is not None
        tokens = self.final if closing else self.tokens
        for size in range(1, min(self.longest_final if closing else self.longest, i) + 1):
            token = word[i - size : i]
            if size > 1 and token not in tokens:
                continue
            if size == i:
                if self.fits("", token, closing):
                    return token, self.unit(token)
                continue
            before = window[-size]
            if self.fits(before[0], token, closing):
                return token, before[1] + self.unit(token)
        raise ValueError("no encoding")
