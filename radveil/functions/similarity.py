"""Jaro-Winkler with fractional half transpositions and no boost threshold."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=200_000)
def jaro_winkler(a: str, b: str) -> float:
    """1 for equal strings, 0 if one is empty or nothing matches."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = list(range(len(b)))
    taken: list[int] = []
    left: list[str] = []
    for i, ch in enumerate(a):
        at = next((j for j in free if abs(i - j) <= reach and b[j] == ch), None)
        if at is not None:
            free.remove(at)
            taken.append(at)
            left.append(ch)
    m = len(left)
    if not m:
        return 0.0
    crossed = sum(x != b[j] for x, j in zip(left, sorted(taken)))
    jaro = (m / len(a) + m / len(b) + (m - crossed / 2) / m) / 3
    shared = 0
    while shared < min(4, len(a), len(b)) and a[shared] == b[shared]:
        shared += 1
    return jaro + shared * 0.1 * (1 - jaro)


@lru_cache(maxsize=200_000)
def _letters(text: str) -> tuple[tuple[str, int], ...]:
    return tuple(sorted(Counter(text).items()))


def may_reach(a: str, b: str, least: float) -> bool:
    """False only if the score can't be ``least``: no more letters match than both have in common."""
    if not a or not b:
        return a == b
    other = dict(_letters(b))
    common = sum(min(n, other.get(c, 0)) for c, n in _letters(a))
    jaro = (common / len(a) + common / len(b) + 1) / 3 if common else 0.0
    shared = sum(1 for _ in takewhile(lambda xy: xy[0] == xy[1], zip(a[:4], b[:4])))
    return jaro + shared * 0.1 * (1 - jaro) >= least - 1e-9


def jaro_winkler_from(least: float):
    """Column function of two texts: their score where it is ``least`` or more, else null; null for a null text."""

    @F.pandas_udf(T.DoubleType())
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        scores = (jaro_winkler(x, y) if x is not None and y is not None and may_reach(x, y, least) else None for x, y in zip(a, b))
        return pd.Series([v if v is not None and v >= least else None for v in scores], dtype="float64")

    return f


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


#: Names up to this many letters are scored in columns, a bit a letter; longer ones one pair at a time.
SHORT = 64
#: Distinct letters of a cell up to which positions are kept by letter, and pairs that are compared or scored at a time.
LETTERS, TILE, BATCH = 1000, 1 << 18, 1 << 16


class Names:
    """Names as columns: lengths, letters, and the sets of their letters in two words of bits.

    The k-th use of a letter is one element of a set. Elements may share a bit, so bits of one set that the other lacks never
    count more letters than really lack.
    """

    def __init__(self, names: list[str]):
        self.names, n = names, len(names)
        self.length = np.array([len(x) for x in names], dtype=np.int64)
        wide = min(SHORT, int(self.length.max(initial=0)))
        text = np.array([x[:SHORT] for x in names], dtype=f"U{max(wide, 1)}") if n else np.zeros(0, "U1")
        self.codes = text.view(np.uint32).reshape(n, -1)
        self.bits = np.zeros((2, n), dtype=np.uint64)
        for i in range(wide):
            at = self.codes[:, i]
            nth = (self.codes[:, :i] == at[:, None]).sum(axis=1)
            word, bit = self._place(at.astype(np.int64), nth)
            set_ = np.where(i < self.length, np.uint64(1) << bit.astype(np.uint64), np.uint64(0))
            for w in (0, 1):
                self.bits[w] |= np.where(word == w, set_, np.uint64(0))
        for r in np.flatnonzero(self.length > SHORT):
            self.bits[:, r] = 0
            for c, k in Counter(names[r]).items():
                word, bit = self._place(np.full(k, ord(c)), np.arange(k))
                for w in (0, 1):
                    self.bits[w, r] |= np.bitwise_or.reduce(np.uint64(1) << bit[word == w].astype(np.uint64))

    @staticmethod
    def _place(code: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and bit of the nth use of a letter: the first two uses lie in word 0, others in word 1."""
        return (nth >= 2).astype(np.int64), 32 * (nth % 2) + (code + 7 * np.maximum(nth // 2 - 1, 0)) % 32


def _bound(common, na, nb, shared):
    """The most a pair with so many common letters and so long a common start can score."""
    jaro = np.where(common > 0, (common / na + common / nb + 1) / 3, 0.0)
    return jaro + shared * 0.1 * (1 - jaro)


def _sharing(names: Names, rows: np.ndarray, others: np.ndarray, least: float):
    """Pairs (i of rows, j of others) that the letters they lack allow to reach ``least``, in parts."""
    by = lambda which: [(int(n), which[names.length[which] == n]) for n in np.unique(names.length[which])]
    same = rows is others
    for na, ia in by(rows):
        for nb, ib in by(others):
            if same and nb < na:
                continue
            start = min(4, na, nb)
            enough = np.flatnonzero(_bound(np.arange(min(na, nb) + 1), na, nb, start) >= least - 1e-9)
            if not len(enough):
                continue
            there, lacking = names.bits[0, ia], ~names.bits[0, ib]
            step = max(1, TILE // len(ib))
            for k in range(0, len(ia), step):
                lack = np.bitwise_count(there[k : k + step, None] & lacking[None, :])
                x, y = np.divmod(np.flatnonzero(lack <= na - enough[0]), len(ib))
                i, j = ia[k + x], ib[y]
                if same and na == nb:
                    i, j = i[i < j], j[i < j]
                a, b = names.bits[:, i], names.bits[:, j]
                common = np.minimum(na - np.bitwise_count(a & ~b).sum(axis=0, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(axis=0, dtype=np.int64))
                equal = names.codes[i, :start] == names.codes[j, :start]
                shared = np.logical_and.accumulate(equal, axis=1).sum(axis=1)
                kept = _bound(common, na, nb, shared) >= least - 1e-9
                yield i[kept], j[kept]


def _scores(names: Names, letters: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """jaro_winkler of short names for each pair of rows; NaN where it can't be ``least``. at: bits of each letter's places by name."""
    one = np.uint64(1)
    na, nb = names.length[a], names.length[b]
    free = ~np.uint64(0) >> (64 - nb).astype(np.uint64)
    left, taken = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
    reach = np.maximum(na, nb) // 2 - 1
    span = np.arange(SHORT)
    for i in range(int(na.max(initial=0))):
        # a bit for each place of b that lies within reach of i
        near = [np.bitwise_or.reduce(one << span[abs(span - i) <= r].astype(np.uint64)) for r in range(-1, SHORT // 2)]
        met = at[b, letters[a, i]] & free & np.array(near, dtype=np.uint64)[reach + 1]
        met = np.where(i < na, met & (~met + one), np.uint64(0))
        free ^= met
        taken |= met
        left |= (met != 0).astype(np.uint64) << np.uint64(i)
    m = np.bitwise_count(left).astype(np.int64)
    equal = letters[a, :4] == letters[b, :4]
    shared = (np.logical_and.accumulate(equal, axis=1) & (np.arange(equal.shape[1]) < np.minimum(na, nb)[:, None])).sum(axis=1)
    out = np.full(len(a), np.nan)
    may = np.flatnonzero((m > 0) & (_bound(m, na, nb, shared) >= least - 1e-9))
    a, b, left, taken, m, na, nb, shared = a[may], b[may], left[may], taken[may], m[may], na[may], nb[may], shared[may]
    crossed = np.zeros(len(may), np.int64)
    for k in range(int(m.max(initial=0))):
        more = k < m
        x, y = left & (~left + one), taken & (~taken + one)
        left, taken = left ^ x, taken ^ y
        place = lambda bit: np.where(more, np.bitwise_count(bit - one), 0).astype(np.int64)
        crossed += more & (letters[a, place(x)] != letters[b, place(y)])
    jaro = (m / na + m / nb + (m - crossed / 2) / m) / 3
    out[may] = jaro + shared * 0.1 * (1 - jaro)
    return out


def similar_in(texts: list[str], rows: np.ndarray, others: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of all pairs of one of ``rows`` and one of ``others`` with jaro_winkler(texts[i], texts[j]) at or over ``least``.

    i < j in each pair, and each comes once where rows and others are the same or have none in common. Nothing is left out: a pair is dropped
    only where its letters can't reach ``least``.
    """
    names = Names(texts)
    first: dict[str, int] = {}
    text = np.array([first.setdefault(x, k) for k, x in enumerate(texts)], dtype=np.int64)
    used, letters = np.unique(names.codes, return_inverse=True)
    letters = letters.reshape(names.codes.shape)
    at = None
    if len(used) <= LETTERS:
        at = np.zeros((len(texts), len(used)), dtype=np.uint64)
        for i in range(names.codes.shape[1]):
            here = np.flatnonzero(i < names.length)
            at[here, letters[here, i]] |= np.uint64(1) << np.uint64(i)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def score() -> None:
        i, j = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        for k in range(0, len(i), BATCH):
            a, b = i[k : k + BATCH], j[k : k + BATCH]
            scores = np.full(len(a), np.nan)
            short = (np.maximum(names.length[a], names.length[b]) <= SHORT) & (at is not None)
            if short.any():
                scores[short] = _scores(names, letters, at, a[short], b[short], least)
            for r in np.flatnonzero(~short):
                if may_reach(x := texts[a[r]], y := texts[b[r]], least):
                    scores[r] = jaro_winkler(x, y)
            scores[text[a] == text[b]] = 1.0
            kept = scores >= least
            found.append((a[kept], b[kept], scores[kept]))

    for i, j in _sharing(names, rows, others, least):
        if len(i):
            waiting.append((np.minimum(i, j), np.maximum(i, j)))
            if sum(len(x) for x, _ in waiting) >= BATCH:
                score()
    if waiting:
        score()
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return tuple(np.concatenate(x) for x in zip(none, *found))
