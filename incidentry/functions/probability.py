"""Logits, temperatures and prior fusion on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentry.functions.text import let


def sigmoid(x: Column, temperature=1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x / temperature))


def array_sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def scaled(xs: Column) -> Column:
    """Array divided by its sum."""
    return let(F.greatest(array_sum(xs), F.lit(1e-12)), lambda total: F.transform(xs, lambda x: x / total))


def softmax(logits: Column, temperature=1.0) -> Column:
    """Softmax of an array of logits scaled by 1/temperature."""
    exps = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp((x - top) / temperature)))
    return let(exps, scaled)


def softmax_nll(logits: Column, label: Column, temperature: float) -> Column:
    """Negative log-likelihood of a 0-based class index at one temperature."""
    top = F.array_max(logits)
    total = array_sum(F.transform(logits, lambda x: F.exp((x - top) / temperature)))
    own = F.element_at(logits, label.cast("int") + 1)
    return F.log(total) - (own - top) / temperature


def binary_nll(logit: Column, truth: Column, temperature: float) -> Column:
    """Binary cross-entropy from a logit, in the form that cannot overflow."""
    z = logit / temperature
    return F.greatest(z, F.lit(0.0)) - z * truth + F.log1p(F.exp(-F.abs(z)))


def fuse(p_model: Column, prior: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """Renormalised product of two distributions; the model's own where the prior is null."""
    raw = F.zip_with(p_model, let(prior, scaled), lambda p, q: F.pow(p, alpha) * F.pow(q, beta))
    return F.when(prior.isNull(), p_model).otherwise(let(raw, scaled))


def confident_label(probs: Column, labels: list[str], floor: float = 0.5) -> Column:
    """Label of the first maximum when it reaches ``floor``, else null."""
    top = F.array_max(probs)
    pos = F.array_position(probs, top).cast("int")
    return F.when(top >= floor, F.try_element_at(F.array(*[F.lit(x) for x in labels]), pos))


def cosine(a: Column, b: Column) -> Column:
    dot = array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm_a = F.sqrt(array_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))
    norm_b = F.sqrt(array_sum(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return dot / ((norm_a + 1e-12) * (norm_b + 1e-12))
