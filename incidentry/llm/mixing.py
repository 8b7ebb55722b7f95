"""Mixing to target weights with soft membership: documents get rates so that expected domain tokens match targets.

A classifier fitted on labelled documents gives each document a posterior over domains. With ``n`` tokens and
posterior ``p`` a document adds ``rate * n * p`` to the domain totals. Nonnegative rates near 1 are found by projected
gradient steps on the squared distance of totals to targets, measured by the inverse Gram matrix of ``n * p``, for
which the step length is 1. A step only needs the few domain totals: a document's rate follows from the list of past
residuals, so each step is one aggregate over the table of posteriors and nothing is joined or shuffled but totals.

Defined results: null or empty text has no tokens, keeps the prior as posterior and rate 1. Labels that are null or
whose document is missing are passed over; without labels all domains are alike. A domain without mass is left out
of the fit. Repeated rows and ids give one row each. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import PLAIN_WORDS, row_map, written
from incidentry.llm.ngram_join import word_hashes

DOMAINS = ("clean", "low", "toxic")
#: Labelled documents the classifier is fitted on at most, those of the least hash of their id.
MAX_LABELLED = 6000
BITS = 15
#: Chi-square of a feature against the domains, and labelled rows that hold it, at least.
LEAST_SCORE, LEAST_HELD = 20.0, 5
STEPS = 30
TOLERANCE = 1e-6
#: Names and levels of the features that describe a whole text.
SHAPES = ("symbols", "upper", "distinct", "length")
LEVELS = 11


def features(text: str | None) -> tuple[int, np.ndarray]:
    """Number of words, and the numbers of the features that hold: hashed words and levels of a few shares."""
    words = word_hashes(text, PLAIN_WORDS)
    n = len(words)
    if not n:
        return 0, np.zeros(0, np.uint16)
    seen = np.unique((words >> np.uint64(64 - BITS)).astype(np.uint16))
    raw = text.encode("utf-8", "surrogatepass")
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    shares = (symbols / n, upper / n, len(np.unique(words)) / n, math.log2(n) / 16)
    levels = [2 ** BITS + k * LEVELS + min(LEVELS - 1, int(10 * s)) for k, s in enumerate(shares)]
    return n, np.concatenate((seen, np.array(levels, np.uint16)))


SIZE = 2 ** BITS + len(SHAPES) * LEVELS


class Classifier:
    """Multinomial logistic regression on the features that tell domains apart, fitted by full-batch Adam."""

    def __init__(self, k: int):
        self.weights = np.zeros((SIZE, k), np.float32)
        self.bias = np.zeros(k)

    def logits(self, found: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[found].sum(0)

    def posterior(self, found: np.ndarray) -> np.ndarray:
        z = self.logits(found)
        e = np.exp(z - z.max())
        return e / e.sum()

    def fit(self, rows: list[np.ndarray], labels: Sequence[int], rounds: int = 150, rate: float = 0.1,
            ridge: float = 1e-4) -> "Classifier":
        k, labels = len(self.bias), np.asarray(labels, np.int64)
        some = [len(r) > 0 for r in rows]
        rows, labels = [r for r, s in zip(rows, some) if s], labels[np.array(some, bool)]
        if not rows:
            return self
        y = np.eye(k)[labels]
        self.bias = np.log((y.sum(0) + 1) / (len(y) + k))
        ids, sizes = np.concatenate(rows).astype(np.int64), np.array(list(map(len, rows)))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        held = np.stack([np.bincount(ids, labels[owner] == j, SIZE) for j in range(k)], 1)
        want = held.sum(1, keepdims=True) * y.mean(0)
        score = ((held - want) ** 2 / np.maximum(want, 1e-9)).sum(1)
        telling = (score >= LEAST_SCORE) & (held.sum(1) >= LEAST_HELD)
        ids, owner = ids[telling[ids]], owner[telling[ids]]
        used, ids = np.unique(ids, return_inverse=True)
        w, b = np.zeros((len(used), k)), self.bias.copy()
        moments = [np.zeros_like(x) for x in (w, w, b, b)]
        for t in range(1, rounds + 1):
            z = b + np.stack([np.bincount(owner, w[ids, j], len(y)) for j in range(k)], 1)
            e = np.exp(z - z.max(1, keepdims=True))
            off = (e / e.sum(1, keepdims=True) - y) / len(y)
            spread = off[owner]
            slope = np.stack([np.bincount(ids, spread[:, j], len(used)) for j in range(k)], 1) + ridge * w
            for x, g, m, v in ((w, slope, *moments[:2]), (b, off.sum(0), *moments[2:])):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * m / (1 - 0.9 ** t) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        self.weights[used] = w
        self.bias = b
        return self


def domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The number of a labelled row's domain in ``DOMAINS``; null where a label is missing."""
    return F.when(F.col(toxic) == 1, 2).when(F.col(quality) == 0, 1).when(
        F.col(quality).isNotNull() & F.col(toxic).isNotNull(), 0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_labelled: int = MAX_LABELLED) -> Classifier:
    """A classifier of domains from at most ``max_labelled`` labelled rows."""
    known = labels.select(F.col(id_col).alias("id"), domain().alias("y")).where("id is not null and y is not null")
    chosen = known.orderBy(F.xxhash64("id"), "id", "y").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = row_map(texts, lambda i, text, y: (i, y, features(text)[1].tobytes()),
                   f"id {dict(docs.dtypes)[id_col]}, y int, found binary", ["id", "text", "y"])
    # Repeated documents could exceed the bound; it holds again here.
    got = rows.orderBy(F.xxhash64("id"), "id", "y", "found").limit(max_labelled).collect()
    return Classifier(len(DOMAINS)).fit([np.frombuffer(r.found, np.uint16) for r in got], [r.y for r in got])


def memberships(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens and ``p``, its posterior over ``DOMAINS``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def one(i, text):
        n, found = features(text)
        return i, n, sent.value.posterior(found).tolist()

    return row_map(docs, one, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, p array<double>",
                   [id_col, text_col])


def rate_of(history: list[list[float]]) -> Column:
    """The rate after the steps whose directions are ``history``, over columns n_tokens and p."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in h]) for h in history])
    along = [F.col("p")[k] * F.col("n_tokens") for k in range(len(history[0]))]

    def step(rate: Column, h: Column) -> Column:
        move = along[0] * h[0]
        for k in range(1, len(along)):
            move = move + along[k] * h[k]
        return F.greatest(F.lit(0.0), rate - move)

    return F.aggregate(steps, F.lit(1.0), step)


def _totals(rows: DataFrame, weight: Column) -> np.ndarray:
    k = len(DOMAINS)
    got = rows.agg(*[F.sum(weight * F.col("n_tokens") * F.col("p")[i]) for i in range(k)]).first()
    return np.array([x or 0.0 for x in got])


def fit_rates(rows: DataFrame, targets: Sequence[float], steps: int = STEPS,
              tolerance: float = TOLERANCE) -> list[list[float]]:
    """Step directions whose rates bring the domain totals of ``rows`` (n_tokens, p) to ``targets``."""
    k = len(DOMAINS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    n2 = F.col("n_tokens") * F.col("n_tokens").cast("double")
    got = rows.agg(*[F.sum(n2 * F.col("p")[i] * F.col("p")[j]) for i, j in pairs]).first()
    gram = np.zeros((k, k))
    for (i, j), x in zip(pairs, got):
        gram[i, j] = gram[j, i] = x or 0.0
    inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    targets, history = np.asarray(targets, float), []
    size = max(float(np.abs(targets).max(initial=0)), 1e-9)
    for _ in range(steps):
        off = _totals(rows, rate_of(history)) - targets
        if float(np.abs(off).max()) <= tolerance * size:
            break
        history.append((inverse @ off).tolist())
    return history


def mixed_rates(docs: DataFrame, labels: DataFrame, shares: Sequence[float] | None = None,
                factors: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, p and ``rate``.

    The targets are ``shares`` of all tokens, or ``factors`` of the present expected total of each domain.
    """
    model = fit(docs, labels, id_col, text_col)
    rows = written(memberships(docs, model, id_col, text_col), "memberships")
    now = _totals(rows, F.lit(1.0))
    targets = np.asarray(shares) * now.sum() if shares is not None else np.asarray(factors) * now
    return rows.withColumn("rate", rate_of(fit_rates(rows, targets)))


def copies(rate: Column, *keys: Column) -> Column:
    """How often a row with ``rate`` is taken: its whole part, and once more with the chance of the rest by a hash."""
    chance = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def remix(docs: DataFrame, labels: DataFrame, factors: Sequence[float], id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, each as often as its rate says.

    The rate is computed beside each row from the fitted steps, so texts are neither shuffled nor joined.
    """
    model = fit(docs, labels, id_col, text_col)
    rows = written(memberships(docs, model, id_col, text_col), "memberships")
    history = fit_rates(rows, np.asarray(factors) * _totals(rows, F.lit(1.0)))
    sent = docs.sparkSession.sparkContext.broadcast((model, history))

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        model, history = sent.value
        out = []
        for text in texts:
            n, found = features(text)
            along, r = n * model.posterior(found), 1.0
            for h in history:
                r = max(0.0, r - float(along @ np.asarray(h)))
            out.append(r)
        return pd.Series(out, dtype=float)

    taken = "__taken"
    times = copies(rate(F.col(text_col)), F.col(id_col), F.col(text_col))
    repeated = docs.withColumn(taken, times).withColumn(taken, F.explode(F.array_repeat(F.lit(0), F.col(taken))))
    return repeated.drop(taken)
