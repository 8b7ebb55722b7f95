"""Train/validation/test splits and samples. Every choice follows a seeded hash of the row id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.operators.ranks import global_rank, hash_rank, id_digest, null_safe, running_totals
from incidentry.session import durable, maybe_broadcast


def temporal_split(df: DataFrame, date: str, id_col: str, train: float = 0.8, val_end: float = 0.9) -> DataFrame:
    """Adds ``split`` by date order, undated rows last, ties by id; cuts at int(train*n) and int(val_end*n).

    Rows are counted per date, and the dates are cumulated. Only the dates that a cut falls into, two at most, have
    their rows ranked by id; all other rows follow their date and are not moved.
    """
    order = [F.col(date).asc_nulls_last()]
    per_date = df.groupBy(date).agg(F.count("*").alias("_n"))
    dates = durable(running_totals(per_date, [], order, {"_n": "_end"}).withColumn("_start", F.col("_end") - F.col("_n")))
    total = dates.agg(F.coalesce(F.max("_end"), F.lit(0))).first()[0]
    cuts = [math.floor(total * train), math.floor(total * val_end)]

    def named(first: Column, last: Column) -> Column:
        """The split of the rows from place ``first`` to before ``last``, null if a cut parts them."""
        return F.when(last <= cuts[0], "train").when((first >= cuts[0]) & (last <= cuts[1]), "val").when(
            first >= cuts[1], "test")

    dates = dates.select(date, "_start", named(F.col("_start"), F.col("_end")).alias("split"))
    # One row per distinct date; a calendar is short, but its size is checked.
    placed = null_safe(df, maybe_broadcast(dates), [date])
    out = placed.filter("split is not null").drop("_start")
    for edge in dates.filter("split is null").collect():  # two rows at most
        rows = df.filter(F.col(date).eqNullSafe(F.lit(edge[date])))
        place = F.col("_rank") - 1 + edge["_start"]
        ranked = global_rank(rows, [F.col(id_col).asc()], "_rank")
        out = out.unionByName(ranked.withColumn("split", named(place, place + 1)).drop("_rank"))
    return out


def stratified_split(df: DataFrame, id_col: str, strata: list[str], train: float = 0.8, val: float = 0.1,
                     seed: int = 42) -> DataFrame:
    """Adds ``split``: the same shares within every stratum."""
    r = hash_rank(df, id_col, strata, seed, "_rank", "_n")
    i = F.col("_rank") - 1
    return r.withColumn(
        "split",
        F.when(i < F.round(F.col("_n") * train), "train").when(i < F.round(F.col("_n") * (train + val)), "val")
        .otherwise("test"),
    ).drop("_rank", "_n")


def group_split(df: DataFrame, id_col: str, group: str, seed: int = 42) -> DataFrame:
    """Adds ``split`` within each group: 60/20/20 with at least one row each from three on; two give train and test."""
    r = hash_rank(df, id_col, [group], seed, "_rank", "_n")
    n, i = F.col("_n"), F.col("_rank")
    n_train = F.greatest(F.floor(0.6 * n), F.lit(1))
    n_val = F.greatest(F.floor(0.2 * n), F.lit(1))
    large = F.when(i <= n_train, "train").when(i <= n_train + n_val, "val").otherwise("test")
    small = F.when(i == 1, "train").otherwise("test")
    return r.withColumn("split", F.when(n >= 3, large).otherwise(small)).drop("_rank", "_n")


def rarest_label(df: DataFrame, labels: list[str], out: str = "stratum") -> DataFrame:
    """Adds the rarest positive label of the row ('none' without one) as a stratum."""
    support = df.agg(F.struct(*[F.sum(x).alias(x) for x in labels]).alias("s")).scalar()
    items = F.array(*[
        F.when(F.col(x) == 1, F.struct(F.col(f"_support.{x}").alias("s"), F.lit(x).alias("l"))) for x in labels])
    return df.withColumn("_support", support).withColumn(
        out, F.coalesce(F.array_min(F.array_compact(items)).l, F.lit("none"))).drop("_support")


def multilabel_split(df: DataFrame, id_col: str, labels: list[str], train: float = 0.8, val: float = 0.1,
                     seed: int = 42) -> DataFrame:
    """Multi-label split: rows are stratified by their rarest label, so each label keeps its share."""
    return stratified_split(rarest_label(df, labels, "_stratum"), id_col, ["_stratum"], train, val, seed).drop("_stratum")


# Training fractions of the learning curves.
FRACTIONS = (1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)


def nested_fractions(df: DataFrame, id_col: str, strata: list[str], fractions=FRACTIONS, seed: int = 42) -> DataFrame:
    """Adds the smallest fraction whose sample holds the row; a fraction's sample is every row up to it."""
    r = hash_rank(df, id_col, strata, seed, "_rank", "_n")
    share = F.col("_rank") / F.col("_n")
    fit = F.lit(float(max(fractions)))
    for f in sorted(fractions, reverse=True):
        fit = F.when(share <= f, F.lit(float(f))).otherwise(fit)
    return r.withColumn("fraction", fit).drop("_rank", "_n")


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Seeded sample of n rows: a distributed top-n by hash."""
    return df.withColumn("_d", id_digest(id_col, seed)).orderBy("_d", id_col).limit(n).drop("_d")


def sample_per_group(df: DataFrame, id_col: str, group: str, k: int, seed: int = 42) -> DataFrame:
    """Seeded sample of up to k rows per group; each task keeps k per group before the shuffle."""
    from pyspark.sql import Window as W

    d = df.withColumn("_d", id_digest(id_col, seed))
    w = W.partitionBy(group).orderBy("_d", id_col)
    return d.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_d", "_rn")


def balanced(df: DataFrame, id_col: str, positive: Column, seed: int = 42) -> DataFrame:
    """All positives and as many hash-chosen other rows."""
    flagged = df.withColumn("_pos", F.coalesce(positive, F.lit(False)))
    n_pos = flagged.agg(F.count_if("_pos")).scalar()
    r = hash_rank(flagged, id_col, ["_pos"], seed, "_rank", "_n")
    return r.filter(F.col("_pos") | (F.col("_rank") <= n_pos)).drop("_pos", "_rank", "_n")


def uniform(digest: Column) -> Column:
    """Number in (0, 1) from the first 13 hex digits of a digest."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))


# The largest number that ``uniform`` gives lies below the cumulated probability of this many terms at PART_RATE,
# so the inversion ends by itself and cuts nothing.
PART_RATE = 8
TERMS = 64


def poisson_count(u: Column, rate: Column | float, terms: int = TERMS) -> Column:
    """Poisson draw by inversion of a uniform number, for a rate up to ``PART_RATE``."""
    if isinstance(rate, (int, float)):
        term = total = math.exp(-rate)
        count = F.when(u > total, 1).otherwise(0)
        for k in range(1, terms):
            term *= rate / k
            total += term
            count = count + F.when(u > total, 1).otherwise(0)
            # The rest of the terms together is at most twice the next one: no number of 53 bits lies beyond it.
            if k > 2 * rate and 2 * term * rate / (k + 1) < 2.0 ** -54:
                break
        return count
    first = F.exp(-rate)

    def step(acc: Column, k: Column) -> Column:
        term = acc.term * rate / k
        return F.struct(
            term.alias("term"), (acc.total + term).alias("total"),
            (acc["n"] + F.when(u > acc.total + term, 1).otherwise(0)).alias("n"))

    start = F.struct(first.alias("term"), first.alias("total"), F.when(u > first, 1).otherwise(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms - 1)), start, step, lambda acc: acc["n"])


def poisson_parts(id_col: str, rate: Column, seed: int = 42) -> Column:
    """Poisson draw for any rate: a sum of draws of rates up to ``PART_RATE``, each from a number of its own.

    The cost grows with the rate, as the draw does. Null and nonpositive rates draw 0.
    """
    rate = rate.cast("double")
    parts = F.ceil(rate / PART_RATE)

    def drawn(part: Column) -> Column:
        key = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), part.cast("string"))
        return F.struct(uniform(F.md5(key)).alias("u"))

    # The numbers are made before they are drawn from, once each.
    draws = F.transform(F.transform(F.sequence(F.lit(1), parts), drawn), lambda x: poisson_count(x.u, rate / parts))
    total = F.aggregate(draws, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    return F.when(rate > 0, total).otherwise(F.lit(0).cast("bigint"))


def weighted_resample(df: DataFrame, id_col: str, weight: str, seed: int = 42) -> DataFrame:
    """Resample with replacement in proportion to a mean-one weight; the expected size is the table's.

    Each row draws its own number of copies, so no row order or total is needed, and no weight is too large.
    """
    return df.withColumn("_k", poisson_parts(id_col, F.col(weight), seed)).filter("_k > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int")))).drop("_k")


def keep_known_labels(df: DataFrame, train: DataFrame, label: str) -> DataFrame:
    """Rows whose label occurs in the training rows."""
    return df.join(train.select(label).distinct(), label, "left_semi")


def fields_by_id(df: DataFrame, source: DataFrame, id_col: str, cols: list[str], order: list[str]) -> DataFrame:
    """Coded fields attached by id as text, the first match by ``order``; missing fields stay null."""
    key = F.col(id_col).cast("string")
    first = source.withColumn("_id", key).groupBy("_id").agg(
        F.min_by(F.struct(*cols), F.struct(*order)).alias("_row")).select("_id", "_row.*")
    left = df.withColumn("_id", key)
    return null_safe(left, first, ["_id"], "left").drop("_id")
