"""String similarity as Arrow UDFs, computed with numpy over a whole batch at once."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

CHUNK = 2048  # pairs per numpy block, so that memory stays flat for long texts


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a padded matrix, and the lengths."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    width = max(int(lengths.max(initial=0)), 1)
    out = np.zeros((len(texts), width), dtype=np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out[np.arange(width) < lengths[:, None]] = flat
    return out, lengths


def jaro_block(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro similarity of each pair."""
    ca, la = _codes(a)
    cb, lb = _codes(b)
    n, wa = ca.shape
    wb = cb.shape[1]
    cols = np.arange(wb)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used_a = np.zeros((n, wa), dtype=bool)
    used_b = np.zeros((n, wb), dtype=bool)
    rows = np.arange(n)
    inside_b = cols < lb[:, None]
    for i in range(wa):
        near = np.abs(cols - i) <= reach[:, None]
        open_b = (cb == ca[:, i : i + 1]) & near & inside_b & ~used_b & (i < la)[:, None]
        hit = open_b.any(axis=1)
        used_b[rows[hit], open_b[hit].argmax(axis=1)] = True
        used_a[hit, i] = True
    m = used_a.sum(axis=1)
    # Matched characters of both sides, moved to the front in their own order.
    seq_a = np.take_along_axis(ca, np.argsort(~used_a, axis=1, kind="stable"), axis=1)
    seq_b = np.take_along_axis(cb, np.argsort(~used_b, axis=1, kind="stable"), axis=1)
    w = min(wa, wb)
    differ = (seq_a[:, :w] != seq_b[:, :w]) & (np.arange(w) < m[:, None])
    t = differ.sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = (m / la + m / lb + (m - t) / m) / 3.0
    sim = np.where(m == 0, 0.0, sim)
    return np.where((la == 0) & (lb == 0), 1.0, sim)


def indel_block(a: list[str], b: list[str]) -> np.ndarray:
    """Indel ratio 0..100 of each pair: twice the longest common subsequence over the total length."""
    ca, la = _codes(a)
    cb, lb = _codes(b)
    n, wa = ca.shape
    wb = cb.shape[1]
    inside_b = np.arange(wb) < lb[:, None]
    best = np.zeros((n, wb + 1), dtype=np.int32)
    for i in range(wa):
        same = (cb == ca[:, i : i + 1]) & inside_b & (i < la)[:, None]
        step = np.where(same, best[:, :-1] + 1, 0)
        best[:, 1:] = np.maximum.accumulate(np.maximum(best[:, 1:], step), axis=1)
    total = la + lb
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 200.0 * best[:, -1] / total
    return np.where(total == 0, 100.0, ratio)


def _pairwise(a: pd.Series, b: pd.Series, block: Callable[[list[str], list[str]], np.ndarray]) -> pd.Series:
    """Apply ``block`` to the distinct pairs of a batch; a null on either side gives null."""
    out = np.full(len(a), np.nan)
    known = (a.notna() & b.notna()).to_numpy()
    slots: dict[tuple[str, str], int] = {}
    codes = [slots.setdefault(pair, len(slots)) for pair in zip(a[known], b[known], strict=True)]
    left = [p[0] for p in slots]
    right = [p[1] for p in slots]
    # Similar lengths together keep the padded blocks small.
    order = sorted(range(len(left)), key=lambda i: (len(left[i]), len(right[i])))
    values = np.empty(len(left))
    for s in range(0, len(order), CHUNK):
        idx = order[s : s + CHUNK]
        values[idx] = block([left[i] for i in idx], [right[i] for i in idx])
    out[known] = values[codes] if len(left) else []
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


@F.pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro similarity in [0, 1]."""
    return _pairwise(a, b, jaro_block)


@F.pandas_udf(DoubleType())
def _jaro_once(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairwise(a, b, jaro_block)


# Declared non-deterministic so that a filter on the result does not make Spark compute it twice.
jaro_once = _jaro_once.asNondeterministic()


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel similarity in [0, 100]."""
    return _pairwise(a, b, indel_block)


@F.pandas_udf(DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio in [0, 1]; a missing side gives 0."""
    cache: dict[tuple[str, str], float] = {}

    def one(x, y):
        if x is None or y is None:
            return 0.0
        if (x, y) not in cache:
            cache[x, y] = SequenceMatcher(None, x, y).ratio()
        return cache[x, y]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def jaro_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - jaro(a, b)


def close_enough(a: Column, b: Column, threshold: float = 85.0) -> Column:
    """Fuzzy equality: two nulls match, one null does not, else the indel ratio decides (case ignored)."""
    same = a.eqNullSafe(b)
    longest = F.greatest(F.length(a), F.length(b))
    shortest = F.least(F.length(a), F.length(b))
    # The ratio cannot exceed 2*min/(min+max): hopeless and equal pairs are not sent to Python.
    hopeful = 200.0 * shortest >= threshold * (shortest + longest)
    ask = a.isNotNull() & b.isNotNull() & ~same & hopeful
    ratio = indel_ratio(F.when(ask, F.lower(a)), F.when(ask, F.lower(b)))
    return same | (F.coalesce(ratio, F.lit(-1.0)) >= threshold)


def closest_label(labels: list[str], threshold: float = 0.5):
    """Arrow UDF: the label most like a text by Ratcliff-Obershelp ratio, null below ``threshold``.

    The first label wins a tie. Each distinct text of a batch is compared once.
    """
    lowered = [label.lower() for label in labels]

    def best(text: str):
        text = text.strip().lower()
        scores = [SequenceMatcher(None, text, label).ratio() for label in lowered]
        top = max(scores, default=0.0)
        return labels[scores.index(top)] if top > 0 and top >= threshold else None

    @F.pandas_udf(StringType())
    def pick(texts: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(texts)
        found = [best(t) for t in distinct]
        return pd.Series([found[c] if c >= 0 else None for c in codes], dtype=object)

    return pick
