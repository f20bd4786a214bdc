"""Pair similarity (F12) and its lossless native pre-filters.

``sequence_ratio`` is the Ratcliff-Obershelp ratio of the Python standard
library, computed on Arrow batches of candidate pairs: all pairs of a batch look
for their longest common blocks together (candidate generation and ranking stay
in Spark).  ``edit_ratio`` is a different, native measure (1 - Levenshtein / max
length) offered under its own name.
"""
from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Pairs times characters of both strings that are compared at once.
CELLS = 1 << 22
#: Words from this length on have popular characters that start no block, a rule of
#: the standard library; such words go to it.
POPULAR = 200


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, one text a row; lengths)."""
    size = np.array([len(t) for t in texts])
    wide = np.array(texts, dtype=f"U{max(1, size.max())}")
    return wide.view(np.uint32).reshape(len(texts), -1).astype(np.int64), size


def matching_characters(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Characters in the matching blocks of every pair (row): the longest common
    block (of equal ones the first in a, then in b), then those left and right of it."""
    total = np.zeros(len(a), np.int64)
    pair, alo, ahi, blo, bhi = np.arange(len(a)), np.zeros(len(a), np.int64), la.astype(np.int64), np.zeros(len(a), np.int64), lb.astype(np.int64)
    while len(pair):
        wide, high = int((ahi - alo).max(initial=0)), int((bhi - blo).max(initial=0))
        col = np.arange(high)
        inside = col < (bhi - blo)[:, None]
        sb = np.where(inside, b[pair[:, None], np.minimum(blo[:, None] + col, b.shape[1] - 1)], -2)
        run = np.zeros((len(pair), high + 1), np.int64)
        size, end_a, end_b = (np.zeros(len(pair), np.int64) for _ in range(3))
        for i in range(wide):
            sa = np.where(i < ahi - alo, a[pair, np.minimum(alo + i, a.shape[1] - 1)], -1)
            run[:, 1:] = np.where(sa[:, None] == sb, run[:, :-1] + 1, 0)
            best = run[:, 1:].max(axis=1, initial=0)
            better = np.flatnonzero(best > size)
            size[better] = best[better]
            end_a[better], end_b[better] = i + 1, run[better, 1:].argmax(axis=1) + 1
        np.add.at(total, pair, size)
        from_a, from_b = alo + end_a - size, blo + end_b - size
        parts = [(alo, from_a, blo, from_b), (alo + end_a, ahi, blo + end_b, bhi)]
        keep = [np.flatnonzero((size > 0) & (p[0] < p[1]) & (p[2] < p[3])) for p in parts]
        pair, alo, ahi, blo, bhi = (np.concatenate(x) for x in zip(*[(pair[k], *[v[k] for v in p]) for k, p in zip(keep, parts)]))
    return total


def ratios(words: list[str], candidates: list[str]) -> np.ndarray:
    """``SequenceMatcher(a=candidate, b=word).ratio()`` of every pair."""
    out = np.ones(len(words))
    size = np.array([len(w) + len(c) for w, c in zip(words, candidates)], np.int64)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    start = 0
    while start < len(order):
        # pairs of like lengths together; the longest of a part sets its width
        end = len(order)
        while end > start + 1 and (end - start) * int(size[order[end - 1]]) > CELLS // 64:
            end = start + (end - start + 1) // 2
        part = order[start:end]
        a, la = _matrix([candidates[i] for i in part])
        b, lb = _matrix([words[i] for i in part])
        out[part] = 2.0 * matching_characters(a, la, b, lb) / size[part]
        start = end
    for i, w in enumerate(words):
        if len(w) >= POPULAR:
            out[i] = SequenceMatcher(None, candidates[i], w).ratio()
    return out


@pandas_udf(T.DoubleType())
def _ratio_udf(word: pd.Series, candidate: pd.Series) -> pd.Series:
    known = (word.notna() & candidate.notna()).to_numpy()
    out = np.full(len(word), np.nan)
    if known.any():
        out[known] = ratios(word[known].tolist(), candidate[known].tolist())
    return pd.Series(out).astype("Float64").where(known, pd.NA)


# Marked non-deterministic only so Catalyst never duplicates the call (a
# filter on the score would otherwise be pushed below the projection and
# evaluate the UDF twice); the function itself is pure.
_ratio_once = _ratio_udf.asNondeterministic()


def sequence_ratio(word: Column, candidate: Column) -> Column:
    """difflib ratio of ``candidate`` against ``word``; null for a null."""
    return _ratio_once(word, candidate)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the character-multiset intersection of two strings (native
    higher-order functions); 2*overlap/(la+lb) bounds the ratio from above."""
    ca, cb = F.split(a, ""), F.split(b, "")
    return F.aggregate(
        F.array_distinct(ca),
        F.lit(0),
        lambda acc, ch: acc + F.least(F.size(F.filter(ca, lambda x: x == ch)), F.size(F.filter(cb, lambda x: x == ch))),
    )


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein(a, b) / max(len) (1.0 for two empty strings)."""
    m = F.greatest(F.length(a), F.length(b))
    return F.when(m == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / m)
