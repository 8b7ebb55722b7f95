"""Bootstrap intervals and paired significance tests.

Draws are reproducible from a seed. Scores depend on a few whole numbers of a row (truth, predictions, matches), so rows
of equal numbers are one cell, and by default replicates draw for cells, not for rows: how often a Poisson bootstrap draws
the rows of a cell together is a Poisson number of the cell's size, and how many of them it leaves out is a binomial
number. The cost is replicates x cells, whatever the number of rows. In exact mode draw d of replicate r takes the row
whose number is the first fifteen hex digits of md5('seed:r:d') modulo n, and in Poisson mode every row draws its own
weight per replicate from a hash; both cost replicates x rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.functions.places import LEVELS
from incidentry.operators.metrics import class_counts, location_indicators, ratio
from incidentry.operators.ranks import global_rank, null_safe
from incidentry.operators.splits import poisson_count, uniform

#: Draws for cells of so many rows come by inversion; for larger ones from a normal number, put right for skewness.
INVERTED = 30
#: Terms of the inversion; a number of 52 bits lies beyond none of those of ``INVERTED``.
CELL_TERMS = 120
#: The share of rows that a replicate leaves out.
LEFT_OUT = math.exp(-1)


def numbered(df: DataFrame, id_col: str) -> DataFrame:
    """Rows numbered from 0 in id order as ``row_no``."""
    return global_rank(df, [F.col(id_col).asc()], "_r").withColumn("row_no", F.col("_r") - 1).drop("_r")


def draw_weights(spark, n: int, reps: int, seed: int = 42) -> DataFrame:
    """(rep, row_no, weight): how often each row is drawn in each replicate of size n."""
    draws = spark.range(reps * n).select(
        F.expr(f"id div {n}").cast("int").alias("rep"), (F.col("id") % n).alias("d"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("d").cast("string")))
    row_no = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % n
    return draws.groupBy("rep", row_no.alias("row_no")).agg(F.count("*").alias("weight"))


def resample(df: DataFrame, id_col: str, reps: int, seed: int = 42, mode: str = "exact") -> DataFrame:
    """Rows of ``df`` with rep and weight; rows a replicate does not draw are left out."""
    if mode == "exact":
        rows = numbered(df, id_col)
        return rows.join(draw_weights(df.sparkSession, rows.count(), reps, seed), "row_no").drop("row_no")
    if mode == "poisson":
        each = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("rep"), F.col(id_col)), 11)
        # The number is its own column so that it is computed once, not once per term.
        each = each.withColumn("_u", (bits.cast("double") + 0.5) / F.lit(float(2**53)))
        return each.withColumn("weight", poisson_count(F.col("_u"), 1.0).cast("bigint")).filter("weight > 0").drop("_u")
    raise ValueError(f"mode is exact or poisson, not {mode}")


def _normal(digest: Column) -> Column:
    """A normal number from the two halves of a digest (Box and Muller)."""
    u, v = uniform(digest), uniform(F.substring(digest, 14, 13))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def poisson_of_size(digest: Column, size: Column) -> Column:
    """Poisson number of a whole-numbered rate."""
    z, rate = _normal(digest), size.cast("double")
    near = F.floor(rate + z * F.sqrt(rate) + (z * z - 1) / 6 + 0.5)
    return F.when(size <= INVERTED, poisson_count(uniform(digest), rate, CELL_TERMS)).otherwise(
        F.greatest(F.lit(0), near)).cast("bigint")


def binomial_of_size(digest: Column, size: Column, share: float) -> Column:
    """Binomial number of ``size`` trials."""
    z, n, odds = _normal(digest), size.cast("double"), share / (1 - share)
    near = F.floor(n * share + z * F.sqrt(n * share * (1 - share)) + (1 - 2 * share) * (z * z - 1) / 6 + 0.5)
    u = uniform(digest)
    first = F.pow(F.lit(1 - share), n)

    def step(acc: Column, k: Column) -> Column:
        term = acc.term * (n - k + 1) / k * odds
        return F.struct(term.alias("term"), (acc.total + term).alias("total"),
                        (acc["n"] + F.when(u > acc.total + term, 1).otherwise(0)).alias("n"))

    start = F.struct(first.alias("term"), first.alias("total"), F.when(u > first, 1).otherwise(0).alias("n"))
    terms = F.when(size > 1, F.sequence(F.lit(1), (size - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    small = F.aggregate(terms, start, step, lambda acc: acc["n"])
    return F.when(size <= INVERTED, small).otherwise(F.least(size, F.greatest(F.lit(0), near))).cast("bigint")


def resample_cells(df: DataFrame, columns: list[str], reps: int, seed: int = 42, out_of_bag: bool = False) -> DataFrame:
    """Cells of equal ``columns`` with rep and weight: how often their rows are drawn, or how many are left out.

    The numbers of a cell follow from ``seed:rep:`` and its columns as text, null as nothing.
    """
    cells = df.groupBy(*columns).agg(F.count("*").alias("_size"))
    each = cells.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    name = F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"),
                       *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    # The digest is its own column so that it is made once.
    each = each.select("*", F.inline(F.array(F.struct(F.md5(name).alias("_digest")))))
    digest, size = F.col("_digest"), F.col("_size")
    weight = binomial_of_size(digest, size, LEFT_OUT) if out_of_bag else poisson_of_size(digest, size)
    return each.withColumn("weight", weight).filter("weight > 0").drop("_digest", "_size")


def left_out(df: DataFrame, id_col: str, reps: int, seed: int = 42) -> DataFrame:
    """The out-of-bag rows of each exact replicate, with rep and weight 1."""
    rows = numbered(df, id_col)
    n = rows.count()
    each = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    out = each.join(draw_weights(df.sparkSession, n, reps, seed), ["rep", "row_no"], "left_anti")
    return out.drop("row_no").withColumn("weight", F.lit(1).cast("bigint"))


def wavg(x: Column, w: Column) -> Column:
    """Weighted mean; nulls carry no weight."""
    return F.sum(x * w) / F.sum(F.when(x.isNotNull(), w))


def count_scores(truth: str, pred: str, w: str = "weight") -> dict[str, Column]:
    err = F.abs(F.col(pred) - F.col(truth))
    weight = F.col(w)
    return {
        "mae": wavg(err, weight), "rmse": F.sqrt(wavg(err * err, weight)),
        "within_1": wavg((err <= 1).cast("int"), weight), "within_2": wavg((err <= 2).cast("int"), weight),
        "nonzero_mae": F.coalesce(wavg(F.when(F.col(truth) > 0, err), weight), F.lit(0.0)),
    }


def interval(reps: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Mean and percentile bounds over replicates (one number per replicate and group)."""
    tail = (1 - level) / 2
    return reps.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.percentile(value, F.lit(tail)).alias("lower"),
        F.percentile(value, F.lit(1 - tail)).alias("upper"), F.count(value).alias("replicates"))


def _sampled(df: DataFrame, id_col: str, columns: list[str] | None, reps: int, seed: int, mode: str) -> DataFrame:
    if mode != "cells":
        return resample(df, id_col, reps, seed, mode)
    return resample_cells(df, columns or [c for c in df.columns if c != id_col], reps, seed)


def _left_out(df: DataFrame, id_col: str, columns: list[str], reps: int, seed: int, mode: str) -> DataFrame:
    return resample_cells(df, columns, reps, seed, True) if mode == "cells" else left_out(df, id_col, reps, seed)


def bootstrap_interval(df: DataFrame, id_col: str, by: list[str], score: Column, reps: int = 5000, seed: int = 42,
                       mode: str = "cells", columns: list[str] | None = None) -> DataFrame:
    """Interval of a weighted score (an aggregate over ``weight``) per group.

    The replicates of all groups come from the same draws of the table's row ids, or of its cells: ``columns`` are
    those that groups and score read, all but the id if they are not given.
    """
    sampled = _sampled(df, id_col, columns, reps, seed, mode)
    return interval(sampled.groupBy(*by, "rep").agg(score.alias("score")), by, "score")


def out_of_bag_micro_f1(long: DataFrame, id_col: str, by: list[str], reps: int = 1000, seed: int = 42,
                        mode: str = "cells") -> DataFrame:
    """Micro F1 of the rows each replicate leaves out, and its interval."""
    sampled = _left_out(long, id_col, [*by, "truth", "pred"], reps, seed, mode)
    t, p, w = F.col("truth") == 1, F.col("pred") == 1, F.col("weight")
    per = sampled.groupBy(*by, "rep").agg(
        F.sum(F.when(t & p, w).otherwise(0)).alias("tp"), F.sum(F.when(t != p, w).otherwise(0)).alias("wrong"))
    f1 = F.when(2 * F.col("tp") + F.col("wrong") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("wrong")))
    return interval(per.withColumn("f1", f1), by, "f1")


def out_of_bag_class_f1(df: DataFrame, id_col: str, by: list[str], truth: str, pred: str, average: str = "weighted",
                        reps: int = 1000, seed: int = 42, mode: str = "cells") -> DataFrame:
    """Macro or weighted F1 of the rows each replicate leaves out, over the labels seen there."""
    sampled = _left_out(df, id_col, [*by, truth, pred], reps, seed, mode)
    keys = [*by, "rep"]
    per = class_counts(sampled, keys, truth, pred, weight="weight")
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    scored = per.withColumn("f1", f1)
    if average == "macro":
        score = F.avg("f1")
    else:
        score = ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support"))
    return interval(scored.groupBy(*keys).agg(score.alias("score")), by, "score")


def p_value(diff: Column) -> Column:
    """Two-sided p of replicate differences: twice the smaller tail at zero, at most 1."""
    known = diff.isNotNull()
    low = F.avg(F.when(known, (diff <= 0).cast("int")))
    high = F.avg(F.when(known, (diff >= 0).cast("int")))
    return F.least(F.lit(1.0), 2 * F.least(low, high))


# Scores where less is better.
LESS_IS_BETTER = ("mae", "rmse", "nonzero_mae")


def paired_replicates(pairs: DataFrame, id_col: str, by: list[str], scores: dict[str, tuple[Column, Column]],
                      reps: int = 5000, seed: int = 42, mode: str = "cells",
                      columns: list[str] | None = None) -> DataFrame:
    """Per group and replicate, baseline and model scores on the same draws, as long rows (metric, baseline, model)."""
    sampled = _sampled(pairs, id_col, columns, reps, seed, mode)
    aggs = []
    for name, (base, model) in scores.items():
        aggs += [base.alias(f"b_{name}"), model.alias(f"m_{name}")]
    wide = sampled.groupBy(*by, "rep").agg(*aggs)
    return wide.select(*by, "rep", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("baseline"), F.col(f"m_{m}").alias("model_score"))
        for m in scores])))


def significance_table(replicates: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Means, difference, p, significance and direction per group and metric."""
    diff = F.col("model_score") - F.col("baseline")
    out = replicates.groupBy(*by, "metric").agg(
        F.avg("baseline").alias("baseline_mean"), F.avg("model_score").alias("model_mean"), p_value(diff).alias("p"))
    less = F.col("metric").isin(*LESS_IS_BETTER)
    return out.withColumns({
        "diff": F.col("model_mean") - F.col("baseline_mean"),
        "significant": F.col("p") < alpha,
        "better": F.when(less, F.col("model_mean") < F.col("baseline_mean")).otherwise(
            F.col("model_mean") > F.col("baseline_mean")),
    })


def paired_count_test(pairs: DataFrame, id_col: str, by: list[str], reps: int = 5000, seed: int = 42,
                      mode: str = "cells", alpha: float = 0.05) -> DataFrame:
    """Paired test of count predictions (true_label, prediction_baseline, prediction_model)."""
    base = count_scores("true_label", "prediction_baseline")
    model = count_scores("true_label", "prediction_model")
    both = {m: (base[m], model[m]) for m in base}
    columns = [*by, "true_label", "prediction_baseline", "prediction_model"]
    return significance_table(paired_replicates(pairs, id_col, by, both, reps, seed, mode, columns), by, alpha)


#: Whole numbers of a row from which the location scores of a replicate follow.
LOCATION_STATS = ("levels", "exact_match", "exact_core_match")


def location_stats(df: DataFrame, truth: str, pred: str, prefix: str) -> DataFrame:
    """Adds how many of the four levels match, whether all do, and whether the three core levels do."""
    m = location_indicators(df, truth, pred)
    flags = [F.col(f"{x}_match").cast("int") for x in LEVELS]
    return m.withColumns({
        f"{prefix}levels": reduce(lambda a, b: a + b, flags), f"{prefix}exact_match": F.col("exact_match").cast("int"),
        f"{prefix}exact_core_match": F.col("exact_core_match").cast("int"),
    }).drop(*[f"{x}_match" for x in LEVELS], "exact_match", "exact_core_match")


def location_scores(prefix: str, w: str = "weight") -> dict[str, Column]:
    """Scores in percent as weighted sums of the numbers of ``location_stats``."""
    weight = F.col(w)
    return {
        "micro_f1": wavg(F.col(f"{prefix}levels"), weight) * 25, "exact_match": wavg(F.col(f"{prefix}exact_match"), weight) * 100,
        "exact_core_match": wavg(F.col(f"{prefix}exact_core_match"), weight) * 100,
    }


def paired_location_test(pairs: DataFrame, by: list[str], truth: str, baseline: str, model: str, reps: int = 5000,
                         seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Paired test of structured locations on the same draws for baseline and model."""
    stats = location_stats(location_stats(pairs, truth, baseline, "b_"), truth, model, "m_")
    columns = [*by, *[f"{p}{x}" for p in ("b_", "m_") for x in LOCATION_STATS]]
    b, m = location_scores("b_"), location_scores("m_")
    replicates = paired_replicates(stats, "", by, {x: (b[x], m[x]) for x in b}, reps, seed, "cells", columns)
    return significance_table(replicates, by, alpha)


def location_interval(df: DataFrame, by: list[str], truth: str, pred: str, score: str = "exact_core_match",
                      reps: int = 5000, seed: int = 42) -> DataFrame:
    """Interval of one location score per group."""
    columns = [*by, *[f"p_{x}" for x in LOCATION_STATS]]
    return bootstrap_interval(location_stats(df, truth, pred, "p_"), "", by, location_scores("p_")[score], reps, seed,
                              columns=columns)


def validate(recomputed: DataFrame, stored: DataFrame, keys: list[str], metrics: dict[str, float]) -> DataFrame:
    """Recomputed against stored metrics: absolute difference and whether it is within the metric's tolerance."""
    s = stored.select(*keys, *[F.col(m).alias(f"_s_{m}") for m in metrics])
    both = null_safe(recomputed.select(*keys, *metrics), s, keys)
    return both.select(*keys, F.inline(F.array(*[
        F.struct(
            F.lit(m).alias("metric"), F.abs(F.col(m) - F.col(f"_s_{m}")).alias("difference"),
            (F.abs(F.col(m) - F.col(f"_s_{m}")) <= tol).alias("within_tolerance"))
        for m, tol in metrics.items()])))
