"""Fill-in-middle transformation, its cuts found through a piecewise-linear learned index of token boundaries.

The boundaries of a text are the code points at which its tokens end: ``bounds[k]`` after ``k`` tokens. The index of a
text is fitted to all of them: segments, each a line that misses none of its boundaries by more than ``ERROR``, and the
residual of every boundary in one byte. A cut is predicted from the segment that holds its rank and put right by the
stored residual, so it is exact. The index can be stored (``index_rows``) and cut again from the table.

A text is cut at two ranks drawn from a digest of its id, and given out as it is (plain), as prefix, suffix, middle
(psm) or as suffix, prefix, middle (spm) behind the marks ``<P>``, ``<S>`` and ``<M>``. ``restored`` rebuilds it.

Defined results: null is the empty text; empty texts and those that hold a mark are plain, with null lengths; blanks
behind the last word are a token of their own; a null id is digested as the empty text behind ``42:``; rows that repeat an
id are cut by the same digits. Other columns are not read by ``transform`` and not kept.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import row_map

#: The most by which a line may miss a boundary, in code points; residuals then fit one byte.
ERROR = 100
#: Boundaries tried at once when a segment is lengthened; doubled while they fit.
BLOCK = 64
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 texts so many are given in another order, and of 100 of these so many as suffix, prefix, middle.
FIM_RATE, SPM_RATE = 50, 80

_BLANK = np.zeros(34, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def boundaries(text: str) -> np.ndarray:
    """0 and the end of each token ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, in code points."""
    if not text:
        return np.zeros(1, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = ~_BLANK[np.minimum(points, 33)]
    ends = np.flatnonzero(solid & np.append(~solid[1:], True)) + 1
    last = [] if solid[-1] else [len(points)]
    return np.concatenate(([0], ends, last)).astype(np.int64)


class RankIndex(NamedTuple):
    """Segments by their first rank, the boundary there and the slope, and one residual a rank."""

    firsts: np.ndarray
    bases: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.firsts, ranks, "right") - 1
        return self.bases[at] + np.floor(self.slopes[at] * (ranks - self.firsts[at]) + 0.5).astype(np.int64)

    def cuts(self, ranks: list[int]) -> list[int]:
        """The exact boundaries of some ranks."""
        asked = np.asarray(ranks, np.int64)
        return (self.predicted(asked) + self.residuals[asked]).tolist()


def fit(bounds: np.ndarray, error: int = ERROR) -> RankIndex:
    """Fit lines from left to right, each as far as one line through its first boundary misses none by over ``error``."""
    firsts, slopes = [], []
    start, size = 0, len(bounds)
    while start < size:
        low, high, end, block = -np.inf, np.inf, start + 1, BLOCK
        while end < size:
            part = bounds[end:end + block]
            run = np.arange(end - start, end - start + len(part))
            rise = part - bounds[start]
            lows = np.maximum(low, np.maximum.accumulate((rise - error) / run))
            highs = np.minimum(high, np.minimum.accumulate((rise + error) / run))
            apart = lows > highs
            fits = int(apart.argmax()) if apart.any() else len(part)
            if fits:
                low, high = lows[fits - 1], highs[fits - 1]
                end += fits
            if fits < len(part):
                break
            block *= 2
        firsts.append(start)
        slopes.append((low + high) / 2 if end > start + 1 else 0.0)
        start = end
    at = np.array(firsts, np.int64)
    index = RankIndex(at, bounds[at], np.array(slopes), np.zeros(0, np.int8))
    return index._replace(residuals=(bounds - index.predicted(np.arange(size))).astype(np.int8))


def draws(doc_id: object, seed: int = SEED) -> list[int]:
    """The four numbers of a document: groups of eight hex digits of a digest of its id."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode("utf-8", "surrogatepass")).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def form_of(text: str, h3: int, h4: int) -> str:
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= FIM_RATE:
        return "plain"
    return "spm" if h4 % 100 < SPM_RATE else "psm"


def arranged(text: str, form: str, cuts: list[int]) -> str:
    prefix, middle, suffix = text[:cuts[0]], text[cuts[0]:cuts[1]], text[cuts[1]:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Per row: id, n (tokens), form, prefix_chars, middle_chars and output."""

    def one(i, text):
        text = text or ""
        index = fit(boundaries(text))
        n = len(index.residuals) - 1
        h1, h2, h3, h4 = draws(i, seed)
        form = form_of(text, h3, h4)
        if form == "plain":
            return i, n, form, None, None, text
        first, second = index.cuts(sorted((h1 % (n + 1), h2 % (n + 1))))
        return i, n, form, first, second - first, arranged(text, form, [first, second])

    kind = dict(docs.dtypes)[id_col]
    return row_map(docs, one, f"{id_col} {kind}, n long, form string, prefix_chars long, middle_chars long, output string",
                   [id_col, text_col], rows=200)


def restored(output: Column, form: Column) -> Column:
    """The text behind an output. The parts hold no mark, and no part makes one with the mark beside it."""
    parts = F.split(output, "<[PSM]>")
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


SEGMENTS = "array<struct<first:long,base:long,slope:double>>"


def index_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the stored index: id, n, segments and residuals (one signed byte a rank, from 0 to n)."""

    def one(i, text):
        index = fit(boundaries(text or ""))
        segments = [{"first": f, "base": b, "slope": s} for f, b, s in
                    zip(index.firsts.tolist(), index.bases.tolist(), index.slopes.tolist())]
        return i, len(index.residuals) - 1, segments, index.residuals.tobytes()

    kind = dict(docs.dtypes)[id_col]
    return row_map(docs, one, f"{id_col} {kind}, n long, segments {SEGMENTS}, residuals binary", [id_col, text_col], rows=200)


def cut_at(segments: Column, residuals: Column, rank: Column) -> Column:
    """The exact boundary of a rank from a stored index."""
    line = F.element_at(F.filter(segments, lambda s: s["first"] <= rank), -1)
    guess = line["base"] + F.floor(line["slope"] * (rank - line["first"]) + 0.5)
    byte = F.conv(F.hex(F.substring(residuals, rank.cast("int") + 1, 1)), 16, 10).cast("long")
    return guess + F.when(byte > 127, byte - 256).otherwise(byte)
