"""ROC and precision-recall curves, threshold tuning."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from incidentry.operators.metrics import f_score, ratio
from incidentry.operators.ranks import null_safe, running_totals
from incidentry.session import durable


def score_steps(long: DataFrame, by: list[str], truth: str = "truth", score: str = "prob") -> DataFrame:
    """One row per group and distinct score, from high to low: cumulative tp and fp, and group totals.

    Ties are merged first, and the running sums are made range by range, so
    neither a hot group nor many distinct scores end up in one task.
    """
    steps = long.groupBy(*by, score).agg(
        F.count_if(F.col(truth) == 1).alias("_pos"), F.count_if(F.col(truth) == 0).alias("_neg"))
    cum = running_totals(steps, by, [F.col(score).desc()], {"_pos": "tp", "_neg": "fp"})
    totals = cum.groupBy(*by).agg(F.max("tp").alias("positives"), F.max("fp").alias("negatives"))
    if by:
        return null_safe(cum, totals, by)
    return cum.withColumn("_t", totals.select(F.struct("positives", "negatives")).scalar()).select("*", "_t.*").drop("_t")


def roc_points(long: DataFrame, by: list[str], truth: str = "truth", score: str = "prob") -> DataFrame:
    """(by, score, sensitivity, specificity) per distinct score."""
    s = score_steps(long, by, truth, score)
    return s.select(
        *by, score, ratio(F.col("tp"), F.col("positives")).alias("sensitivity"),
        (1 - ratio(F.col("fp"), F.col("negatives"))).alias("specificity"))


def roc_auc(long: DataFrame, by: list[str], truth: str = "truth", score: str = "prob") -> DataFrame:
    """Area under the ROC curve by trapezoids; each step needs its own counts only."""
    s = score_steps(long, by, truth, score)
    area = F.sum(F.col("_neg") * (F.col("tp") - F.col("_pos") / 2))
    return s.groupBy(*by).agg(
        ratio(area, F.max("positives") * F.max("negatives")).alias("auc"),
        F.max("positives").alias("positives"), F.max("negatives").alias("negatives"))


def average_precision(long: DataFrame, by: list[str], truth: str = "truth", score: str = "prob") -> DataFrame:
    """Average precision: precision at each distinct score weighted by the recall gained there."""
    s = score_steps(long, by, truth, score)
    gain = F.col("_pos") / F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return s.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("positives") > 0, gain)), F.lit(0.0)).alias("average_precision"))


def pr_auc(long: DataFrame, by: list[str], truth: str = "truth", score: str = "prob") -> DataFrame:
    """Area under the precision-recall curve, integrated between neighbouring scores; null without positives.

    Along a step true and false positives grow in proportion, so precision is ``x / (a x + b)`` of the true positives ``x``
    and has a closed integral. Each step needs its own counts only.
    """
    s = score_steps(long, by, truth, score)
    gained, before_tp, before_fp = F.col("_pos"), F.col("tp") - F.col("_pos"), F.col("fp") - F.col("_neg")
    slope = F.col("_neg") / gained
    a, b = 1 + slope, before_fp - slope * before_tp
    curved = gained / a - b / (a * a) * F.log((F.col("tp") + F.col("fp")) / (before_tp + before_fp))
    area = F.when(gained > 0, F.when(b == 0, gained / a).otherwise(curved)).otherwise(0.0)
    positives = F.max("positives")
    return s.groupBy(*by).agg(F.when(positives > 0, F.sum(area) / positives).alias("pr_auc"))


def pr_auc_summary(long: DataFrame, by: list[str], truth: str = "truth", score: str = "prob") -> DataFrame:
    """Micro (labels pooled) and macro (mean over labels) area under the precision-recall curve per group."""
    micro = pr_auc(long, by, truth, score).withColumnRenamed("pr_auc", "micro")
    macro = pr_auc(long, [*by, "label"], truth, score).groupBy(*by).agg(F.avg("pr_auc").alias("macro"))
    if by:
        return null_safe(micro, macro, by)
    return micro.withColumn("macro", macro.scalar())


def average_precision_summary(long: DataFrame, by: list[str], truth: str = "truth", score: str = "prob") -> DataFrame:
    """Micro (labels pooled) and macro (mean over labels) average precision per group."""
    micro = average_precision(long, by, truth, score).withColumnRenamed("average_precision", "micro")
    macro = average_precision(long, [*by, "label"], truth, score).groupBy(*by).agg(
        F.avg("average_precision").alias("macro"))
    if by:
        return null_safe(micro, macro, by)
    return micro.withColumn("macro", macro.scalar())


def pr_points(long: DataFrame, by: list[str], truth: str = "truth", score: str = "prob") -> DataFrame:
    s = score_steps(long, by, truth, score)
    return s.select(
        *by, score, ratio(F.col("tp"), F.col("positives")).alias("recall"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


# ---- thresholds --------------------------------------------------------------------------


def threshold_counts(long: DataFrame, by: list[str], grid: list[float], truth: str = "truth",
                     score: str = "prob") -> DataFrame:
    """tp, fp, fn of ``score >= threshold`` for every grid value, from one histogram.

    A score falls on the last grid point it reaches; the counts at a threshold are
    the sums of the points from there up. The window sees one row per grid point.
    """
    points = sorted(grid)
    at = F.lit(0)
    for t in points:
        at = at + F.when(F.col(score) >= F.lit(t), 1).otherwise(0)
    hist = long.groupBy(*by, at.alias("_at")).agg(
        F.count_if(F.col(truth) == 1).alias("_pos"), F.count_if(F.col(truth) == 0).alias("_neg"))
    totals = hist.groupBy(*by).agg(
        F.sum("_pos").alias("_p"),
        F.map_from_entries(F.collect_list(F.struct("_at", F.struct("_pos", "_neg")))).alias("_h"))
    cells = F.array(*[F.struct(F.lit(i).alias("_at"), F.lit(t).alias("threshold")) for i, t in enumerate(points, 1)])
    wide = totals.select(*by, "_p", "_h", F.inline(cells))
    at_point = F.try_element_at("_h", F.col("_at"))
    up = W.partitionBy(*by, "_p").orderBy(F.col("_at").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = wide.withColumns({
        "tp": F.sum(F.coalesce(at_point["_pos"], F.lit(0))).over(up),
        "fp": F.sum(F.coalesce(at_point["_neg"], F.lit(0))).over(up)})
    return out.withColumn("fn", F.col("_p") - F.col("tp")).select(*by, "threshold", "tp", "fp", "fn")


def even_grid(low: float, high: float, points: int) -> list[float]:
    """Evenly spaced numbers, made as low + i * step like the reference grids are."""
    step = (high - low) / (points - 1)
    return [low + i * step for i in range(points - 1)] + [high]


def best_thresholds(long: DataFrame, by: list[str], grid: list[float] | None = None, beta: float = 1.0) -> DataFrame:
    """Per group (a label, say) the first threshold with the largest F-beta."""
    counts = threshold_counts(long, by, grid or even_grid(0.0, 1.0, 101))
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    scored = counts.withColumn("score", f_score(p, r, beta))
    order = F.struct((-F.col("score")).alias("s"), "threshold")
    return scored.groupBy(*by).agg(
        F.min_by("threshold", order).alias("threshold"), F.max("score").alias("f_beta"))


def best_global_threshold(long: DataFrame, by: list[str], grid: list[float] | None = None) -> DataFrame:
    """One threshold per group for micro F1 pooled over labels; 0.5 unless another scores above 0."""
    counts = threshold_counts(long, by, grid or even_grid(0.05, 0.95, 19))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    scored = counts.withColumn("_f1", f1)
    order = F.struct((-F.col("_f1")).alias("s"), "threshold")
    best = scored.groupBy(*by).agg(F.min_by("threshold", order).alias("_t"), F.max("_f1").alias("micro_f1"))
    return best.select(*by, F.when(F.col("micro_f1") > 0, F.col("_t")).otherwise(F.lit(0.5)).alias("threshold"), "micro_f1")


def coordinate_thresholds(long: DataFrame, objective: str = "macro", grid: list[float] | None = None,
                          max_passes: int = 3) -> dict[str, float]:
    """Per-label thresholds by coordinate ascent on macro or micro F1, starting at 0.5.

    Spark counts every (label, threshold) once. Macro F1 is a mean over labels, so each label is settled alone, in
    Spark. Micro F1 ties the labels together: the ascent walks the counts, labels x grid points, keeping running totals.
    That walk goes label by label, so it is for label sets that the driver can hold; :func:`micro_thresholds` needs
    none there and finds the best choice of all.
    """
    points = grid or even_grid(0.05, 0.95, 19)
    table = threshold_counts(long, ["label"], sorted({*points, 0.5}))
    if objective == "macro":
        f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
        scored = table.withColumn("f1", F.coalesce(f1, F.lit(0.0)))
        tried = F.col("threshold").isin(points)
        order = F.struct((-F.col("f1")).alias("s"), "threshold")
        best = scored.groupBy("label").agg(
            F.max(F.when(F.col("threshold") == 0.5, F.col("f1"))).alias("start"),
            F.max(F.when(tried, F.col("f1"))).alias("top"), F.min_by("threshold", F.when(tried, order)).alias("at"))
        chosen = best.select("label", F.when(F.col("top") > F.col("start"), F.col("at")).otherwise(0.5).alias("t"))
        return {r["label"]: r["t"] for r in chosen.orderBy("label").collect()}

    cell = {(r["label"], r["threshold"]): (r["tp"], r["fp"], r["fn"]) for r in table.collect()}
    chosen = {label: 0.5 for label in sorted({label for label, _ in cell})}

    def f1(tp: int, fp: int, fn: int) -> float:
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0

    total = [sum(cell[label, 0.5][k] for label in chosen) for k in range(3)]
    best = f1(*total)
    for _ in range(max_passes):
        moved = False
        for label, now in chosen.items():
            rest = [t - c for t, c in zip(total, cell[label, now])]
            options = [(f1(*(r + c for r, c in zip(rest, cell[label, t]))), t) for t in points]
            top = max(s for s, _ in options)
            if top > best:
                at = next(t for s, t in options if s == top)
                chosen[label], best, moved = at, top, True
                total = [r + c for r, c in zip(rest, cell[label, at])]
        if not moved:
            break
    return chosen


def micro_thresholds(long: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """(label, threshold, micro_f1): the choice of grid points, one a label, with the largest micro F1 of all choices.

    Micro F1 is a quotient of two sums over labels. Some choice exceeds the value f just if its sum of
    ``2 tp - f (2 tp + fp + fn)`` is above 0, and that sum is largest where each label's own part is. So f is raised
    to the value of the choice that is best for f until it stays: a few passes over labels x grid points, each ending in one
    row of sums. Sums are whole numbers and compared exactly. The lowest threshold wins a tie; where no true
    label is ever reached all thresholds are 0.5 and micro_f1 is 0. Without rows the result is empty.
    """
    cells = threshold_counts(long, ["label"], grid or even_grid(0.05, 0.95, 19))
    whole = "decimal(19,0)"
    cells = durable(cells.select(
        "label", "threshold", (2 * F.col("tp")).cast(whole).alias("_top"),
        (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast(whole).alias("_size")))
    top, size = 0, 1
    while True:
        loss = F.col("_size") * F.lit(Decimal(top)).cast(whole) - F.col("_top") * F.lit(Decimal(size)).cast(whole)
        best = cells.groupBy("label").agg(F.min_by(
            F.struct("threshold", "_top", "_size"), F.struct(loss.alias("_loss"), "threshold")).alias("_b"))
        now = best.agg(F.sum("_b._top").alias("top"), F.sum("_b._size").alias("size")).first()
        if not now.size or now.top * size <= top * now.size:
            break
        top, size = int(now.top), int(now.size)
    return best.select(
        "label", F.col("_b.threshold").alias("threshold") if top else F.lit(0.5).alias("threshold"),
        F.lit(top / size).alias("micro_f1"))
