"""Subword encoding with a given vocabulary (Z3): merges, longest match, best path. Vocabularies are parameters; nothing is trained."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges of neighbouring symbols, least rank first, leftmost of equals; a heap of pairs, old ones skipped."""
    symbols: list[str | None] = list(word)
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(ranks[p], i, p) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, (a, b) = heapq.heappop(heap)
        j = after[i] if symbols[i] is not None else len(word)
        if symbols[i] != a or j >= len(word) or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, None
        after[i] = after[j]
        if after[i] < len(word):
            before[after[i]] = i
        for at in (before[i], i):
            if at >= 0 and after[at] < len(word):
                p = (symbols[at], symbols[after[at]])
                if p in ranks:
                    heapq.heappush(heap, (ranks[p], at, p))
    return [s for s in symbols if s is not None]


def longest_match(word: str, vocabulary: set[str], inner: str = "##", unknown: str = "[UNK]") -> list[str]:
    """The longest known piece from the left, again and again; a word that can't be covered is one unknown."""
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = (inner if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(piece)
                at = end
                break
        else:
            return [unknown]
    return out


def best_path(text: str, scores: dict[str, float], unknown: float = -20.0) -> list[str]:
    """The split whose pieces' scores add up to the most; single characters that aren't known cost `unknown`. Ties go to the shorter last piece."""
    longest = max(map(len, scores), default=1)
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = [(best[end - 1][0] + scores.get(text[end - 1], unknown), end - 1)]
        for start in range(max(0, end - longest), end - 1):
            s = scores.get(text[start:end])
            if s is not None:
                options.append((best[start][0] + s, start))
        best.append(max(options))
    out, end = [], len(text)
    while end:
        start = best[end][1]
        out.append(text[start:end])
        end = start
    return out[::-1]


def encode(c, how: str, vocabulary) -> Column:
    """Words of a text (split at blanks) as pieces: how is merges, longest or path; vocabulary is what that function takes."""
    use = {"merges": merged, "longest": longest_match, "path": best_path}[how]

    @F.pandas_udf("array<string>")
    def go(s: pd.Series) -> pd.Series:
        seen: dict[str, list[str]] = {}

        def one(word):
            if word not in seen:
                seen[word] = use(word, vocabulary)
            return seen[word]

        return s.map(lambda x: None if x is None else [p for w in x.split() for p in one(w)])

    return go(c)
