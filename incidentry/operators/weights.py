"""Label statistics, class and sample weights, augmentation plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.functions.probability import cosine
from incidentry.functions.spans import LABELS
from incidentry.operators.ranks import hash_rank


def label_support(df: DataFrame, labels: list[str], rare_below: float = 0.01) -> DataFrame:
    """(label, support, n, prevalence, rare, imbalance_ratio) from indicator columns, in one pass."""
    sums = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(x) for x in labels])
    long = sums.select("n", F.inline(F.array(*[
        F.struct(F.lit(x).alias("label"), F.col(x).alias("support")) for x in labels])))
    share = F.col("support") / F.col("n")
    return long.select(
        "label", "support", "n", share.alias("prevalence"), (share < rare_below).alias("rare"),
        F.when(F.col("support") > 0, F.max("support").over(_all()) / F.col("support")).alias("imbalance_ratio"))


def _all():
    from pyspark.sql import Window as W

    return W.partitionBy(F.lit(0))  # one row per label


def positive_weights(df: DataFrame, labels: list[str]) -> DataFrame:
    """Negatives over positives per label, the positives counted as at least one."""
    return label_support(df, labels).withColumn(
        "pos_weight",
        (F.col("n") - F.col("support")) / F.when(F.col("support") == 0, 1).otherwise(F.col("support")))


def conservative_weights(
    df: DataFrame, labels: list[str], cap: float | None = 3.0, root: bool = True, low: float = 1.0, high: float = 10.0,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """Positive weights capped, square-rooted, clipped.

    ``overrides`` has label and any of cap_ratio, sqrt_scaling, min_weight, max_weight;
    a null there means the default.
    """
    w = positive_weights(df, labels).select("label", "pos_weight")
    if overrides is not None:
        w = w.join(overrides, "label", "left")

    def setting(name: str, default):
        there = overrides is not None and name in overrides.columns
        return F.coalesce(F.col(name), F.lit(default)) if there else F.lit(default)

    capped = F.least("pos_weight", setting("cap_ratio", cap if cap is not None else float("inf")))
    scaled = F.when(setting("sqrt_scaling", root), F.sqrt(capped)).otherwise(capped)
    clipped = F.greatest(F.least(scaled, setting("max_weight", high)), setting("min_weight", low))
    return w.select("label", "pos_weight", clipped.alias("weight"))


def alpha_weights(df: DataFrame, labels: list[str], low: float = 0.25, high: float = 0.75) -> DataFrame:
    """sqrt(median prevalence / prevalence), clamped; the median of an even number is its lower middle value."""
    s = label_support(df, labels).withColumn(
        "pi", F.least(F.greatest("prevalence", F.lit(1e-6)), F.lit(1 - 1e-6)))
    ordered = F.array_sort(F.collect_list("pi").over(_all()))  # one value per label
    median = F.element_at(ordered, F.floor((F.size(ordered) + 1) / 2).cast("int"))
    return s.select(
        "label", "prevalence",
        F.greatest(F.least(F.sqrt(median / F.col("pi")), F.lit(high)), F.lit(low)).alias("alpha"))


def sample_weights(df: DataFrame, labels: list[str], out: str = "sample_weight") -> DataFrame:
    """Row weight: sum of inverse label frequencies over its labels, lifted to the least positive one, mean 1."""
    sums = df.agg(F.struct(*[
        F.greatest(F.sum(x), F.lit(1)).cast("double").alias(x) for x in labels]).alias("s")).scalar()
    raw = sum((F.col(x) / F.col(f"_pos.{x}") for x in labels), F.lit(0.0))
    weighted = df.withColumn("_pos", sums).withColumn("_w", raw).drop("_pos")
    # The least positive weight, and the sum and number of all, give the lifted mean in one pass.
    stats = weighted.agg(F.struct(
        F.coalesce(F.min(F.when(F.col("_w") > 0, F.col("_w"))), F.lit(1.0)).alias("low"), F.sum("_w").alias("total"),
        F.count_if(F.col("_w") <= 0).alias("zeros"), F.count("*").alias("n")).alias("s")).scalar()
    mean = (F.col("_s.total") + F.col("_s.zeros") * F.col("_s.low")) / F.col("_s.n")
    lifted = F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.col("_s.low"))
    return weighted.withColumn("_s", stats).withColumn(out, lifted / mean).drop("_w", "_s")


def tag_weights(df: DataFrame, text: str = "text", entities: str = "entities") -> DataFrame:
    """(tag_id, tag, count, weight): inverse frequency of BIO tags, tokens counted by white space."""
    def words(c):
        return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))

    total = words(F.col(text))
    inside = F.aggregate(entities, F.lit(0), lambda a, e: a + words(e.text))
    aggs = [F.sum(total).cast("bigint").alias("total"), F.sum(total - inside).cast("bigint").alias("O")]

    def own_of(label: str):
        return F.filter(F.col(entities), lambda e: e.label == label)

    for label in LABELS:
        own = own_of(label)
        aggs.append(F.sum(F.size(own)).cast("bigint").alias(f"B-{label}"))
        aggs.append(F.sum(F.aggregate(own, F.lit(0), lambda a, e: a + words(e.text) - 1)).cast("bigint").alias(f"I-{label}"))
    tags = ["O"] + [f"{k}-{label}" for label in LABELS for k in ("B", "I")]
    rows = F.array(*[
        F.struct(F.lit(i).alias("tag_id"), F.lit(t).alias("tag"), F.col(f"`{t}`").alias("count"))
        for i, t in enumerate(tags)])
    return df.agg(*aggs).select("total", F.inline(rows)).select(
        "tag_id", "tag", "count",
        F.when(F.col("count") > 0, F.col("total") / (len(tags) * F.col("count"))).otherwise(F.lit(1.0)).alias("weight"))


def augmentation_plan(df: DataFrame, labels: list[str], min_samples: int = 50, max_new: int = 500,
                      max_ratio: float = 1.0) -> DataFrame:
    """(label, support, to_add): rows to add per label, within the caps asked for."""
    need = F.greatest(F.lit(min_samples) - F.col("support"), F.lit(0))
    return label_support(df, labels).select(
        "label", "support",
        F.least(need, F.lit(max_new), F.floor(F.col("support") * max_ratio)).cast("bigint").alias("to_add"))


def augmentation_seeds(df: DataFrame, id_col: str, labels: list[str], seed: int = 42, **caps) -> DataFrame:
    """(label, id) of the rows to augment: rows with that label alone when there are any, else all its rows."""
    plan = augmentation_plan(df, labels, **caps).filter("to_add > 0")
    total = sum((F.col(x) for x in labels), F.lit(0))
    long = df.select(id_col, (total == 1).alias("_single"), F.explode(F.array_compact(F.array(*[
        F.when(F.col(x) == 1, F.lit(x)) for x in labels]))).alias("label"))
    has_single = long.groupBy("label").agg(F.max("_single").alias("_any"))
    pool = long.join(F.broadcast(has_single), "label").filter(F.col("_single") | ~F.col("_any"))  # one row per label
    ranked = hash_rank(pool, id_col, ["label"], seed, "_rank", "_n")
    return ranked.join(F.broadcast(plan), "label").filter(F.col("_rank") <= F.col("to_add")).select("label", id_col)


def accept_candidates(candidates: DataFrame, existing: DataFrame, text: str, seed_vec: str, cand_vec: str,
                      id_col: str, low: float = 0.85, high: float = 0.98) -> DataFrame:
    """Candidates within the similarity band, not in the existing texts, each text once (the first by id)."""
    near = candidates.withColumn("similarity", cosine(F.col(seed_vec), F.col(cand_vec))).filter(
        F.col("similarity").between(low, high))
    fresh = near.join(existing.select(text).distinct(), text, "left_anti")
    rest = [c for c in fresh.columns if c not in (text, seed_vec, cand_vec)]
    return fresh.groupBy(text).agg(F.min_by(F.struct(*rest), id_col).alias("_row")).select(text, "_row.*")
