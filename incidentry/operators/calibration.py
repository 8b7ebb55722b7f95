"""Temperature scaling, and calibrate-then-threshold."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.functions.probability import array_sum, sigmoid
from incidentry.functions.text import let
from incidentry.operators import curves, metrics
from incidentry.session import durable, maybe_broadcast


#: Newton steps at most; the loss is convex in the inverse temperature and a few do.
STEPS = 60


def _fitted(rows: DataFrame, slope: Callable[[Column], Column], curvature: Callable[[Column], Column],
            bounds: tuple[float, float] | None) -> float:
    """Temperature within ``bounds`` with the least loss over ``rows`` (n times each), 1 where there are none.

    Newton steps on the inverse temperature, each one aggregate of slope and curvature. The root stays between two
    known sides of it, and a step that would leave these halves them instead. Without bounds the inverse temperature
    may be any number, also one below zero where the logits point away from the labels.
    """
    (a, b), at = (-math.inf, math.inf) if bounds is None else (1 / bounds[1], 1 / bounds[0]), 1.0
    for _ in range(STEPS):
        beta, n = F.lit(at), F.col("n")
        row = rows.agg(F.sum(n * slope(beta)).alias("s"), F.sum(n * curvature(beta)).alias("c")).first()
        if row.s is None or row.s == 0:
            break
        a, b = (a, at) if row.s > 0 else (at, b)
        new = at - row.s / row.c if row.c else math.inf
        if not a < new < b:
            new = (a + b) / 2
        if not math.isfinite(new) or abs(new - at) <= 1e-13 * abs(at):
            break
        at = new
    return 1 / at


def fit_softmax_temperature(df: DataFrame, logits: str, label: str,
                            bounds: tuple[float, float] | None = (1e-3, 1e3)) -> float:
    """Temperature within ``bounds`` for class logits (array) and 0-based labels. Rows with a null are left out.

    The rows are read once, as the distances of a row's logits from that of its label.
    """
    away = F.transform(logits, lambda x: (x - F.element_at(F.col(logits), F.col(label).cast("int") + 1)).cast("double"))
    known = df.filter(F.col(logits).isNotNull() & F.col(label).isNotNull())
    rows = durable(known.groupBy(F.array_sort(away).alias("d")).agg(F.count("*").alias("n")))

    def moments(beta: Column) -> Column:
        top = F.array_max("d")
        return let(F.transform("d", lambda x: F.exp(beta * (x - top))), lambda p: F.struct(
            array_sum(p).alias("w"), array_sum(F.zip_with(p, F.col("d"), lambda q, x: q * x)).alias("x"),
            array_sum(F.zip_with(p, F.col("d"), lambda q, x: q * x * x)).alias("xx")))

    def mean(beta: Column) -> Column:
        return let(moments(beta), lambda m: m["x"] / m["w"])

    def spread(beta: Column) -> Column:
        return let(moments(beta), lambda m: m["xx"] / m["w"] - F.pow(m["x"] / m["w"], 2))

    return _fitted(rows, mean, spread, bounds)


def fit_sigmoid_temperature(long: DataFrame, logit: str = "logit", truth: str = "truth",
                            bounds: tuple[float, float] | None = (0.1, 10.0)) -> float:
    """Temperature within ``bounds`` for independent label logits. Rows with a null are left out; the rest is read once."""
    known = long.select(F.col(logit).cast("double").alias("z"), F.col(truth).cast("double").alias("y")).dropna()
    rows = durable(known.groupBy("z", "y").agg(F.count("*").alias("n")))
    z, y = F.col("z"), F.col("y")

    def p(beta: Column) -> Column:
        return F.lit(1.0) / (1.0 + F.exp(-beta * z))

    return _fitted(rows, lambda beta: z * (p(beta) - y), lambda beta: z * z * p(beta) * (1.0 - p(beta)), bounds)


def temperature_table(df: DataFrame, loss, temperatures: list[float]) -> DataFrame:
    """(temperature, nll) for given temperatures, one pass over the rows."""
    row = df.agg(*[F.avg(loss(t)).alias(f"t{i}") for i, t in enumerate(temperatures)])
    cells = F.array(*[F.struct(F.lit(t).alias("temperature"), F.col(f"t{i}").alias("nll"))
                      for i, t in enumerate(temperatures)])
    return row.select(F.inline(cells))


def calibrate_and_tune(val: DataFrame, test: DataFrame, objective: str = "micro",
                       temperature: float | None = None) -> DataFrame:
    """Test rows (row_id, label, truth, logit) with calibrated prob, threshold and pred.

    The temperature and the thresholds come from the validation rows: one global
    threshold for micro F1, else one per label. A given temperature is not fitted again.
    """
    t = fit_sigmoid_temperature(val) if temperature is None else temperature

    def with_prob(df: DataFrame) -> DataFrame:
        return df.withColumns({"prob": sigmoid(F.col("logit"), t), "prob_uncalibrated": sigmoid(F.col("logit"))})

    val_p, out = with_prob(val), with_prob(test)
    if objective == "micro":
        best = curves.best_global_threshold(val_p, []).select("threshold").scalar()
        out = out.withColumn("threshold", best)
    else:
        tuned = curves.best_thresholds(val_p, ["label"]).select("label", "threshold")
        out = out.join(maybe_broadcast(tuned), "label")
    return out.withColumns({
        "pred": (F.col("prob") >= F.col("threshold")).cast("int"),
        "pred_uncalibrated": (F.col("prob_uncalibrated") > 0.5).cast("int"), "temperature": F.lit(t)})


def calibrated_report(tuned: DataFrame) -> DataFrame:
    """Classification report of calibrated and uncalibrated predictions, tagged by ``variant``."""
    def one(name: str, pred: Column) -> DataFrame:
        return metrics.multilabel_report(tuned.withColumn("pred", pred), []).withColumn("variant", F.lit(name))

    return one("calibrated", F.col("pred")).unionByName(one("uncalibrated", F.col("pred_uncalibrated")))
