"""String similarity as Arrow UDFs, applied only to pairs that an equi-join has already filtered.

``token_set_ratio`` and ``indel_ratio`` follow the public definitions of the set ratio and of the
normalised insert/delete distance; the ratio of matching blocks is the standard library's, asked for the few pairs
whose longest common subsequence can reach it.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 512  # pairs whose tokens a task holds at once


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel over the shorter string."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_lengths(short: list[str], long: list[str]) -> np.ndarray:
    """LCS of many pairs at once: one machine word per pair, stepping over the text position."""
    out = np.zeros(len(short), dtype=np.int64)
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(short, long)]
    narrow = [i for i, (a, _) in enumerate(pairs) if 0 < len(a) <= 63]
    for i, (a, b) in enumerate(pairs):
        if len(a) > 63:
            out[i] = lcs_length(a, b)
    if len(narrow) < 64:
        for i in narrow:
            out[i] = lcs_length(*pairs[i])
        return out
    narrow.sort(key=lambda i: -len(pairs[i][1]))
    size = len(narrow)
    width = np.array([len(pairs[i][1]) for i in narrow])
    masks = np.zeros((size, 64), dtype=np.uint64)
    text = np.zeros((size, int(width[0])), dtype=np.int64)
    for r, i in enumerate(narrow):
        a, b = pairs[i]
        codes: dict[str, int] = {}
        bits: dict[str, int] = {}
        for p, ch in enumerate(a):
            codes.setdefault(ch, len(codes) + 1)
            bits[ch] = bits.get(ch, 0) | (1 << p)
        for ch, k in codes.items():
            masks[r, k] = bits[ch]
        text[r, : len(b)] = [codes.get(ch, 0) for ch in b]
    full = np.array([(1 << len(pairs[i][0])) - 1 for i in narrow], dtype=np.uint64)
    rows = full.copy()
    active = size
    index = np.arange(size)
    for j in range(text.shape[1]):
        while active and width[active - 1] <= j:
            active -= 1
        state = rows[:active]
        hit = state & masks[index[:active], text[:active, j]]
        rows[:active] = ((state + hit) | (state - hit)) & full[:active]
    out[narrow] = np.array([len(pairs[i][0]) for i in narrow]) - np.bitwise_count(rows).astype(np.int64)
    return out


def indel_ratio_values(left: list[str], right: list[str]) -> np.ndarray:
    total = np.array([len(a) + len(b) for a, b in zip(left, right)], dtype=np.float64)
    common = lcs_lengths(left, right)
    return np.where(total > 0, 100.0 * 2.0 * common / np.maximum(total, 1.0), 100.0)


def token_set_ratio_values(left: list[str], right: list[str], needed: np.ndarray | float = 0.0) -> np.ndarray:
    """Set ratio per pair. Values that cannot reach ``needed`` may be reported as a lower bound.

    Token sets and matching tables are held for ``SLICE`` pairs at a time, however many rows a batch has.
    """
    needed = np.broadcast_to(np.asarray(needed, dtype=np.float64), (len(left),))
    parts = [slice(i, i + SLICE) for i in range(0, len(left), SLICE)]
    return np.concatenate([np.zeros(0), *[_set_ratios(left[p], right[p], needed[p]) for p in parts]])


def _set_ratios(left: list[str], right: list[str], needed: np.ndarray) -> np.ndarray:
    size = len(left)
    score = np.zeros(size)
    cache: dict[str, frozenset[str]] = {}

    def token_set(s: str) -> frozenset[str]:
        if s not in cache:
            cache[s] = frozenset(s.split())
        return cache[s]

    open_rows: list[int] = []
    open_left: list[str] = []
    open_right: list[str] = []
    open_total: list[int] = []
    for i, (a, b) in enumerate(zip(left, right)):
        set_a, set_b = token_set(a or ""), token_set(b or "")
        if not set_a or not set_b:
            continue
        both = set_a & set_b
        only_a, only_b = set_a - both, set_b - both
        if both and (not only_a or not only_b):
            score[i] = 100.0
            continue
        len_s = sum(map(len, both)) + len(both) - 1 if both else 0
        len_a = sum(map(len, only_a)) + len(only_a) - 1
        len_b = sum(map(len, only_b)) + len(only_b) - 1
        gap = 1 if both else 0
        total = 2 * (len_s + gap) + len_a + len_b
        if both:
            by_a = 100.0 * (1 - (gap + len_a) / (2 * len_s + gap + len_a))
            by_b = 100.0 * (1 - (gap + len_b) / (2 * len_s + gap + len_b))
            score[i] = max(by_a, by_b)
        bound = 100.0 * (1 - abs(len_a - len_b) / total)
        if bound > score[i] and bound >= needed[i]:
            open_rows.append(i)
            open_left.append(" ".join(sorted(only_a)))
            open_right.append(" ".join(sorted(only_b)))
            open_total.append(total)
    if open_rows:
        common = lcs_lengths(open_left, open_right)
        lengths = np.array([len(a) + len(b) for a, b in zip(open_left, open_right)])
        by_text = 100.0 * (1 - (lengths - 2 * common) / np.array(open_total, dtype=np.float64))
        score[open_rows] = np.maximum(score[open_rows], by_text)
    return score


@F.pandas_udf(T.DoubleType())
def token_set_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(token_set_ratio_values(left.fillna("").tolist(), right.fillna("").tolist()))


@F.pandas_udf(T.DoubleType())
def indel_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(indel_ratio_values(left.fillna("").tolist(), right.fillna("").tolist()))


def bounded_indel_ratio(left: list[str], right: list[str], threshold: float) -> np.ndarray:
    """Insert/delete ratio, 0 to 1."""
    return indel_ratio_values(left, right) / 100.0


def bounded_block_ratio(left: list[str], right: list[str], threshold: float) -> np.ndarray:
    """Ratio of matching blocks, 0 to 1, where it can reach ``threshold``: blocks are a common subsequence, whose
    longest length bounds them."""
    bound = indel_ratio_values(left, right) / 100.0
    out = np.zeros(len(left))
    for i in np.flatnonzero(bound >= threshold - 1e-9).tolist():
        out[i] = SequenceMatcher(None, left[i], right[i]).ratio()
    return out


def bounded_set_ratio(left: list[str], right: list[str], threshold: float) -> np.ndarray:
    """Set ratio, 0 to 1; it takes the common words of both titles first, wherever they stand."""
    return token_set_ratio_values(left, right, 100.0 * threshold) / 100.0


@F.pandas_udf(T.DoubleType())
def best_set_ratio(text: pd.Series, queries: pd.Series) -> pd.Series:
    """Highest set ratio of one text over a list of queries; each text is tokenised once."""
    best = np.zeros(len(text))
    texts = text.fillna("").tolist()
    lists = [list(q) if q is not None else [] for q in queries]
    depth = max((len(q) for q in lists), default=0)
    for k in range(depth):
        column = [q[k] if k < len(q) else "" for q in lists]
        best = np.maximum(best, token_set_ratio_values(texts, column, needed=best))
    return pd.Series(best)
