"""How much of a text a rewritten one keeps: matching blocks as difflib finds them, each search in linear time.

difflib compares every pair of equal characters, which is square in the length of a text.  Here the longest common block
of two stretches is found by a suffix automaton of one, and what lies before and behind it is compared in the same way.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters of both texts that are compared.
COMPARED = 60_000


def _automaton(text: str) -> tuple[list[dict[str, int]], list[int], list[int], list[int]]:
    """Transitions, suffix links, longest lengths and first ends of the states of a text's suffix automaton."""
    moves: list[dict[str, int]] = [{}]
    link, longest, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(text):
        new = len(moves)
        moves.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        first.append(i)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if longest[to] != longest[at] + 1:
                copy = len(moves)
                moves.append(dict(moves[to]))
                link.append(link[to])
                longest.append(longest[at] + 1)
                first.append(first[to])
                link[to] = copy
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = copy
                    at = link[at]
                to = copy
            link[new] = to
        last = new
    return moves, link, longest, first


def longest_common(a: str, b: str) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common block: the first in a, and of these the first in b."""
    moves, link, longest, first = _automaton(b)
    state = length = 0
    best = (0, 0, 0)
    for i, c in enumerate(a):
        while state and c not in moves[state]:
            state = link[state]
            length = longest[state]
        if c in moves[state]:
            state = moves[state][c]
            length += 1
            if length > best[2]:
                best = (i - length + 1, first[state] - length + 1, length)
    return best


def matching(a: str, b: str) -> int:
    """Characters in the matching blocks of two texts, as difflib has them without its junk rules."""
    total, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        if not x or not y:
            continue
        if x == y:
            total += len(x)
            continue
        i, j, n = longest_common(x, y)
        if n:
            total += n
            todo += [(x[:i], y[:j]), (x[i + n :], y[j + n :])]
    return total


def likeness(a: str | None, b: str | None, compared: int | None = COMPARED) -> float:
    """2 * matching / both lengths, of the first `compared` characters; 1 if both are empty or null."""
    a, b = (a or "")[:compared], (b or "")[:compared]
    return 2.0 * matching(a, b) / (len(a) + len(b)) if a or b else 1.0


def fidelity(original: Column, rewritten: Column, compared: int | None = COMPARED) -> Column:
    """likeness() of two text columns, to four decimals."""

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y, compared) for x, y in zip(a, b, strict=True)], dtype=float)

    return F.round(of(original, rewritten), 4)
