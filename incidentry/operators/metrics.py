"""Evaluation metrics as grouped aggregates over prediction tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.functions import places
from incidentry.functions.similarity import close_enough
from incidentry.operators.ranks import null_safe, quantiles
from incidentry.session import durable


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """Quotient with 0 for an empty denominator."""
    return F.when(den > 0, scale * num / den).otherwise(F.lit(0.0))


def f_score(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    return F.when(
        precision + recall > 0, (1 + b2) * precision * recall / (b2 * precision + recall)).otherwise(F.lit(0.0))


def with_prf(df: DataFrame, scale: float = 1.0, tp="tp", fp="fp", fn="fn", prefix: str = "") -> DataFrame:
    """Adds precision, recall, f1 from count columns, a zero denominator giving 0."""
    p, r, f = (f"{prefix}{m}" for m in ("precision", "recall", "f1"))
    t = F.col(tp)
    return df.withColumns({p: ratio(t, t + F.col(fp), scale), r: ratio(t, t + F.col(fn), scale)}).withColumn(
        f, F.when(F.col(p) + F.col(r) > 0, 2 * F.col(p) * F.col(r) / (F.col(p) + F.col(r))).otherwise(F.lit(0.0)))


def drop_or_miss(df: DataFrame, pred: str, on_null: str, miss) -> DataFrame:
    """Null predictions are dropped, or replaced so that they count as misses."""
    if on_null == "drop":
        return df.filter(F.col(pred).isNotNull())
    if on_null == "miss":
        return df.withColumn(pred, F.coalesce(F.col(pred), F.lit(miss)))
    raise ValueError(f"on_null is drop or miss, not {on_null}")


# ---- counts ------------------------------------------------------------------------------


def count_cells(df: DataFrame, by: list[str], truth: str, pred: str, extracted: str | None = None) -> DataFrame:
    """(by, truth, pred[, extracted], _n): rows of equal numbers as one, from one read of the table.

    Cells of parts of a table add up, and every count metric follows from them, so they are what to keep and merge.
    """
    keys = [*by, truth, pred, *([extracted] if extracted else [])]
    return df.groupBy(*keys).agg(F.count("*").alias("_n"))


def _cell_mean(value: Column) -> Column:
    """Mean over the rows of cells; nulls carry no weight."""
    return F.sum(value * F.col("_n")) / F.sum(F.when(value.isNotNull(), F.col("_n")))


def _count_aggs(truth: str, pred: str) -> dict[str, Column]:
    err = F.abs(F.col(pred) - F.col(truth))
    return {
        "mae": _cell_mean(err), "rmse": F.sqrt(_cell_mean(err * err)),
        "exact_match": _cell_mean((err == 0).cast("int")),
        "within_1": _cell_mean((err <= 1).cast("int")), "within_2": _cell_mean((err <= 2).cast("int")),
    }


def count_metrics(
    df: DataFrame, by: list[str], truth: str = "true_label", pred: str = "prediction",
    extracted: str | None = None, on_null: str = "drop",
) -> DataFrame:
    """Count-error metrics per group: mae, rmse, mdae, exact, within 1 and 2, nonzero mae, extraction rate, n.

    The table is read once, into cells of equal counts; the median comes from the cells' cumulated sizes.
    """
    cells = durable(count_cells(drop_or_miss(df, pred, on_null, 0), by, truth, pred, extracted))
    err = F.abs(F.col(pred) - F.col(truth))
    rate = _cell_mean(F.col(extracted).cast("int")) if extracted else F.lit(1.0)
    main = cells.groupBy(*by).agg(
        *[c.alias(n) for n, c in _count_aggs(truth, pred).items()],
        F.coalesce(_cell_mean(F.when(F.col(truth) > 0, err)), F.lit(0.0)).alias("nonzero_mae"),
        rate.alias("extraction_rate"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
    )
    median = quantiles(cells.withColumn("_err", err).withColumnRenamed("_n", "_size_of_cell"), by, "_err", {"mdae": 0.5},
                       weight="_size_of_cell")
    return null_safe(main, median, by) if by else main.withColumn("mdae", median.scalar())


# Lower bounds of the true-count bins and their names.
COUNT_BINS = ((0, "0"), (1, "1"), (2, "2"), (3, "3-5"), (6, "6+"))


def count_bin(truth: Column, bins: Sequence[tuple[float, str]] = COUNT_BINS) -> Column:
    """Bin of a true count, closed on the left; null below the first."""
    out = F.when(truth >= bins[-1][0], bins[-1][1])
    for low, name in reversed(bins[:-1]):
        out = out.when(truth >= low, name)
    return out


def count_metrics_by_bin(
    df: DataFrame, by: list[str], truth: str = "true_label", pred: str = "prediction", on_null: str = "drop",
    bins: Sequence[tuple[float, str]] = COUNT_BINS,
) -> DataFrame:
    """Count-error metrics per group and true-count bin (lower bound, name); bins without rows appear with zeros."""
    cells = durable(count_cells(drop_or_miss(df, pred, on_null, 0), by, truth, pred)).withColumn(
        "bin", count_bin(F.col(truth), bins))
    got = cells.filter("bin is not null").groupBy(*by, "bin").agg(
        *[c.alias(n) for n, c in _count_aggs(truth, pred).items()], F.sum("_n").alias("n"))
    groups = cells.select(*by).distinct() if by else df.sparkSession.range(1).drop("id")
    grid = groups.withColumn("bin", F.explode(F.array(*[F.lit(name) for _, name in bins])))
    return null_safe(grid, got, [*by, "bin"], "left").na.fill(0)


def all_counts_right(df: DataFrame, pairs: list[tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """Share of rows with every count right, and per column."""
    same = {t: F.col(t).eqNullSafe(F.col(p)) for t, p in pairs}
    return df.groupBy(*(by or [])).agg(
        F.avg(reduce(lambda a, b: a & b, same.values()).cast("int")).alias("all_correct"),
        *[F.avg(c.cast("int")).alias(f"accuracy_{t}") for t, c in same.items()],
        F.count("*").alias("n"),
    )


def zero_split_accuracy(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """Accuracy in percent for zero and non-zero truths."""
    hit = F.col(truth).eqNullSafe(F.col(pred)).cast("int")
    return df.groupBy(*by).agg(
        (F.avg(F.when(F.col(truth) == 0, hit)) * 100).alias("zero_true_accuracy"),
        (F.avg(F.when(F.col(truth) != 0, hit)) * 100).alias("nonzero_true_accuracy"),
    )


# ---- one label per row -------------------------------------------------------------------


def confusion(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """Confusion cells with counts and shares of the true class."""
    cells = df.groupBy(*by, truth, pred).agg(F.count("*").alias("n"))
    rows = cells.groupBy(*by, truth).agg(F.sum("n").alias("_row"))
    return null_safe(cells, rows, [*by, truth]).withColumn("proportion", F.col("n") / F.col("_row")).drop("_row")


def class_counts(df: DataFrame, by: list[str], truth: str, pred: str, labels: list[str] | None = None,
                 weight: str | None = None) -> DataFrame:
    """tp, fp, fn, support per class; a fixed label list adds classes without rows and leaves others out.

    With ``weight``, a column of whole numbers, each row counts as often as it says.
    """
    cells = df.groupBy(*by, truth, pred).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    same = F.col(truth).eqNullSafe(F.col(pred))
    sides = F.array(
        F.struct(F.col(truth).alias("label"), F.when(same, F.col("_n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"),
                 F.when(same, 0).otherwise(F.col("_n")).alias("fn")),
        F.struct(F.col(pred).alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(same, 0).otherwise(F.col("_n")).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("fn")),
    )
    long = cells.select(*by, F.inline(sides))
    out = long.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    if labels is not None:
        groups = df.select(*by).distinct() if by else df.sparkSession.range(1).drop("id")
        grid = groups.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
        out = null_safe(grid, out, [*by, "label"], "left").na.fill(0, ["tp", "fp", "fn"])
    else:
        out = out.filter("label is not null")
    return out.withColumn("support", F.col("tp") + F.col("fn"))


def averages(per_label: DataFrame, by: list[str]) -> DataFrame:
    """micro, macro and weighted rows from a per-label table (one row per group and label)."""
    w = F.col("support")
    agg = per_label.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")],
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[ratio(F.sum(F.col(m) * w), F.sum(w)).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
    )
    agg = with_prf(agg, prefix="micro_")
    rows = F.array(*[
        F.struct(F.lit(kind).alias("label"), *[F.col(f"{kind}_{m}").alias(m) for m in ("precision", "recall", "f1")])
        for kind in ("micro", "macro", "weighted")
    ])
    return agg.select(*by, "support", F.inline(rows))


def report(per_label_counts: DataFrame, by: list[str]) -> DataFrame:
    """Classification report: one row per label plus micro, macro and weighted averages."""
    per_label = with_prf(per_label_counts)
    cols = [*by, "label", "precision", "recall", "f1", "support"]
    avg = averages(per_label, by).withColumn("label", F.concat(F.col("label"), F.lit(" avg")))
    return per_label.select(*cols).unionByName(avg.select(*cols))


def multiclass_report(
    df: DataFrame, by: list[str], truth: str, pred: str, labels: list[str] | None = None,
) -> DataFrame:
    """Per-class and averaged precision, recall, f1, support, plus an accuracy row."""
    counts = class_counts(df, by, truth, pred, labels)
    acc = df.groupBy(*by).agg(
        F.avg(F.col(truth).eqNullSafe(F.col(pred)).cast("int")).alias("f1"), F.count("*").alias("support"))
    acc = acc.select(*by, F.lit("accuracy").alias("label"), F.col("f1").alias("precision"),
                     F.col("f1").alias("recall"), "f1", "support")
    return report(counts, by).unionByName(acc)


def f1_scores(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """micro, macro and weighted F1 over the labels seen on either side; weights over all rows."""
    per = with_prf(class_counts(df, by, truth, pred))
    return per.groupBy(*by).agg(
        ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro_f1"),
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


# ---- several labels per row --------------------------------------------------------------


def to_long(df: DataFrame, keys: list[str], labels: list[str], probs: bool = True) -> DataFrame:
    """Wide true_/pred_/prob_ columns to one row per label."""
    def item(x: str) -> Column:
        cols = [F.lit(x).alias("label"), F.col(f"true_{x}").cast("int").alias("truth"),
                F.col(f"pred_{x}").cast("int").alias("pred")]
        if probs:
            cols.append(F.col(f"prob_{x}").cast("double").alias("prob"))
        return F.struct(*cols)

    return df.select(*keys, F.inline(F.array(*[item(x) for x in labels])))


def label_counts(long: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, support, n per group and label of a long prediction table."""
    t, p = F.col("truth") == 1, F.col("pred") == 1
    return long.groupBy(*by, "label").agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.count_if(t).alias("support"), F.count("*").alias("n"),
    )


def multilabel_report(
    long: DataFrame, by: list[str], mask_zero: bool = False, mask_below: float | None = None,
) -> DataFrame:
    """Per-label and averaged scores; labels without positives or below a prevalence can be left out."""
    counts = label_counts(long, by)
    if mask_zero:
        counts = counts.filter("support > 0")
    if mask_below is not None:
        counts = counts.filter(F.col("support") / F.col("n") >= mask_below)
    return report(counts, by)


def hamming_and_subset(df: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """Hamming loss and subset accuracy of a wide table."""
    wrong = [(F.col(f"true_{x}") != F.col(f"pred_{x}")).cast("int") for x in labels]
    total = reduce(lambda a, b: a + b, wrong)
    return df.groupBy(*by).agg(
        (F.sum(total) / (F.count("*") * len(labels))).alias("hamming_loss"),
        F.avg((total == 0).cast("int")).alias("subset_accuracy"), F.count("*").alias("n"),
    )


def truthy(c: Column) -> Column:
    """Text or number to 0/1: 'true', 't', 'yes', '1' and numbers above 0 count as 1."""
    text = F.lower(F.trim(c.cast("string")))
    return (text.isin("true", "t", "yes", "y") | F.coalesce(text.try_cast("double") > 0, F.lit(False))).cast("int")


def strategy_scores(long: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Precision, recall, f1 per strategy and label."""
    return with_prf(label_counts(long, [strategy])).select(strategy, "label", "precision", "recall", "f1", "support")


def strategy_summary(scores: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Mean, sample deviation and number of F1 scores per strategy."""
    return scores.groupBy(strategy).agg(
        F.avg("f1").alias("f1_mean"), F.stddev_samp("f1").alias("f1_std"), F.count("f1").alias("f1_count"))


def error_patterns(
    long: DataFrame, by: list[str], id_col: str, text: str, threshold: float = 0.3, examples: int = 10,
) -> DataFrame:
    """Labels with both kinds of error; weak ones get a suggestion and their first positive texts.

    The examples are the feature's own top-k: Spark limits each task to k rows per label before the shuffle.
    """
    from pyspark.sql import Window as W

    per = with_prf(label_counts(long, by)).filter("fp > 0 and fn > 0").select(
        *by, "label", F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"), "precision", "recall",
        ((F.col("precision") < threshold) | (F.col("recall") < threshold)).alias("refine"),
    )
    order = W.partitionBy(*by, "label").orderBy(id_col)
    top = (
        long.filter("truth = 1").withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= examples)
        .groupBy(*by, "label").agg(F.array_sort(F.collect_list(F.struct("_rn", text))).alias("_ex"))
        .select(*by, "label", F.col(f"_ex.{text}").alias("examples"))
    )
    return per.join(top, [*by, "label"], "left").withColumns({
        "examples": F.when(F.col("refine"), F.col("examples")),
        "suggestion": F.when(F.col("refine"), F.concat(
            F.lit("Consider refining definition or adding examples for "), F.col("label"))),
    })


# ---- structured locations ----------------------------------------------------------------


def settled(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once.

    Struct columns made by a plain projection are folded into each of their uses and
    computed there again; the one-row ``inline`` keeps them apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def location_matches(
    df: DataFrame, truth: str, pred: str, fuzzy: float | None = 85.0, normalise: bool = True,
) -> DataFrame:
    """Adds parsed structs ``_t`` and ``_p``, and whole-record match flags.

    Whole-record equality minds case; fuzzy equality does not.
    """
    out = settled(df, {
        "_t": places.parse_structured(F.col(truth), normalise), "_p": places.parse_structured(F.col(pred), normalise)})
    same = {x: F.col(f"_t.{x}").eqNullSafe(F.col(f"_p.{x}")) for x in places.LEVELS}
    out = out.withColumns({
        "exact_match": places.all_of(list(same.values())),
        "exact_core_match": places.all_of([same[x] for x in places.CORE]),
    })
    if fuzzy is not None:
        out = out.withColumns({
            f"_fz_{x}": close_enough(F.col(f"_t.{x}"), F.col(f"_p.{x}"), fuzzy) for x in places.LEVELS})
        out = out.withColumns({
            "fuzzy_match": places.all_of([F.col(f"_fz_{x}") for x in places.LEVELS]),
            "fuzzy_core_match": places.all_of([F.col(f"_fz_{x}") for x in places.CORE]),
        })
    return out


def location_overall(df: DataFrame, by: list[str], truth: str, pred: str, fuzzy: float | None = 85.0,
                     normalise: bool = True) -> DataFrame:
    """Percentages of whole-record matches."""
    flags = ["exact_match", "exact_core_match"] + (["fuzzy_match", "fuzzy_core_match"] if fuzzy is not None else [])
    return location_matches(df, truth, pred, fuzzy, normalise).groupBy(*by).agg(
        *[(F.avg(F.col(x).cast("int")) * 100).alias(x) for x in flags], F.count("*").alias("total_examples"))


def location_levels(df: DataFrame, by: list[str], truth: str, pred: str, fuzzy: float | None = 85.0,
                    normalise: bool = True) -> DataFrame:
    """Per level and pooled (level 'micro'): exact and fuzzy precision, recall, f1 in percent, and support.

    Levels compare without case. Other locations are compared as sets of comma parts.
    """
    m = location_matches(df, truth, pred, fuzzy, normalise)

    def level(x: str) -> Column:
        t, p = F.col(f"_t.{x}"), F.col(f"_p.{x}")
        if x in places.CORE:
            n_t, n_p = t.isNotNull().cast("int"), p.isNotNull().cast("int")
            hit = F.coalesce(F.lower(t) == F.lower(p), F.lit(False)).cast("int")
            close = (t.isNotNull() & p.isNotNull() & F.col(f"_fz_{x}")).cast("int") if fuzzy is not None else F.lit(0)
            fuzzy_t, fuzzy_p = n_t, n_p
        else:
            ts, ps = places.lower_components(t), places.lower_components(p)
            n_t, n_p = F.coalesce(F.size(ts), F.lit(0)), F.coalesce(F.size(ps), F.lit(0))
            n_t, n_p = F.greatest(n_t, F.lit(0)), F.greatest(n_p, F.lit(0))
            hit = F.greatest(F.coalesce(F.size(F.array_intersect(ts, ps)), F.lit(0)), F.lit(0))
            # After the comma split of the parser a field holds one part, so the fuzzy match is one to one.
            fuzzy_t = F.coalesce((t != "").cast("int"), F.lit(0))
            fuzzy_p = F.coalesce((p != "").cast("int"), F.lit(0))
            close = (fuzzy_t * fuzzy_p * F.col(f"_fz_{x}").cast("int")) if fuzzy is not None else F.lit(0)
        return F.struct(
            F.lit(x).alias("level"), hit.alias("tp"), n_p.alias("predicted"), n_t.alias("support"),
            close.alias("fuzzy_tp"), fuzzy_p.alias("fuzzy_predicted"), fuzzy_t.alias("fuzzy_support"),
        )

    counted = ("tp", "predicted", "support", "fuzzy_tp", "fuzzy_predicted", "fuzzy_support")
    long = m.select(*by, F.inline(F.array(*[level(x) for x in places.LEVELS])))
    per = long.groupBy(*by, "level").agg(*[F.sum(c).alias(c) for c in counted])
    pooled = per.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counted]).withColumn("level", F.lit("micro"))
    both = per.unionByName(pooled)
    for prefix, tp, pr, su in (("exact_", "tp", "predicted", "support"),
                               ("fuzzy_", "fuzzy_tp", "fuzzy_predicted", "fuzzy_support")):
        if prefix == "fuzzy_" and fuzzy is None:
            continue
        both = both.withColumns({"_fp": F.col(pr) - F.col(tp), "_fn": F.col(su) - F.col(tp)})
        both = with_prf(both, 100.0, tp, "_fp", "_fn", prefix)
    keep = [f"{k}_{m_}" for k in (("exact", "fuzzy") if fuzzy is not None else ("exact",))
            for m_ in ("precision", "recall", "f1")]
    return both.select(*by, "level", *keep, "support")


def match_share_metrics(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """The case-blind set used for significance tests: mean of the four level matches, exact, exact core, in percent."""
    m = location_indicators(df, truth, pred)
    levels = [F.col(f"{x}_match").cast("int") for x in places.LEVELS]
    return m.groupBy(*by).agg(
        (F.avg(reduce(lambda a, b: a + b, levels) / 4) * 100).alias("micro_f1"),
        (F.avg(F.col("exact_match").cast("int")) * 100).alias("exact_match"),
        (F.avg(F.col("exact_core_match").cast("int")) * 100).alias("exact_core_match"),
        F.count("*").alias("n"),
    )


def location_indicators(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Case-blind match flags per level, two absent values matching each other."""
    out = settled(df, {
        "_t": places.parse_structured(F.col(truth), normalise=False),
        "_p": places.parse_structured(F.col(pred), normalise=False)})
    out = out.withColumns({
        f"{x}_match": F.lower(f"_t.{x}").eqNullSafe(F.lower(f"_p.{x}")) for x in places.LEVELS})
    return out.withColumns({
        "exact_match": places.all_of([F.col(f"{x}_match") for x in places.LEVELS]),
        "exact_core_match": places.all_of([F.col(f"{x}_match") for x in places.CORE]),
    }).drop("_t", "_p")


def field_matches(df: DataFrame, truth: str, pred: str, normalise: bool = True) -> DataFrame:
    """Row-level match per field, null where the truth has no value, and whole-record equality."""
    out = location_matches(df, truth, pred, None, normalise)
    for x in places.LEVELS:
        t, p = F.col(f"_t.{x}"), F.coalesce(F.col(f"_p.{x}"), F.lit(""))
        out = out.withColumn(f"{x}_match", F.when(t != "", F.lower(p) == F.lower(t)))
    return out.drop("_t", "_p", "exact_core_match")


def token_set_scores(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """Mean precision and recall on comma parts, their F1, and exact matches, in percent.

    Rows without truth parts count for the exact share only.
    """
    t, p = places.lower_components(F.col(truth)), places.lower_components(F.col(pred))
    shared = F.size(F.array_intersect(t, p))
    out = df.groupBy(*by).agg(
        (F.avg((F.trim(truth) == F.trim(pred)).cast("int")) * 100).alias("exact_match"),
        (F.coalesce(F.avg(F.when(F.size(t) > 0, ratio(shared, F.size(p)))), F.lit(0.0)) * 100).alias("precision_tokens"),
        (F.coalesce(F.avg(F.when(F.size(t) > 0, shared / F.size(t))), F.lit(0.0)) * 100).alias("recall_tokens"),
    )
    return out.withColumn("f1_tokens", f_score(F.col("precision_tokens"), F.col("recall_tokens")))


def component_recall(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """Exact share and mean recall on ', ' parts, in percent."""
    t = F.array_distinct(F.split(F.trim(truth), ", "))
    p = F.array_distinct(F.split(F.trim(pred), ", "))
    return df.groupBy(*by).agg(
        (F.avg((F.trim(truth) == F.trim(pred)).cast("int")) * 100).alias("exact_match"),
        (F.avg(F.size(F.array_intersect(t, p)) / F.size(t)) * 100).alias("recall"),
    )
