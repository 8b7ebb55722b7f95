"""Global ranks, running totals and exact quantiles without a single-task window.

A plain window over a whole table, or over one hot group, sorts it in one task.
Here the order is cut into many ranges first; each range is worked on alone and
then shifted by the totals of the ranges before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from incidentry.session import durable

BUCKET_DIGITS = 3  # 16**3 = 4096 hash buckets per stratum


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls match; the key columns of the left side are kept."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def running_totals(
    df: DataFrame, groups: list[str], order: list[Column], sums: dict[str, str],
) -> DataFrame:
    """Adds ``sums`` (value column to new column) as running totals per group in ``order``.

    Rows are range-partitioned on (groups, order), so one large group spreads over
    many tasks. Rows that tie in ``order`` must be merged before the call.
    """
    ranged = df.repartitionByRange(*[F.col(g) for g in groups], *order)
    ranged = durable(ranged.withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*groups, "_range").agg(*[F.sum(v).alias(f"_t_{n}") for v, n in sums.items()])
    before = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums.values()])
    local = W.partitionBy(*groups, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = null_safe(ranged, offsets, [*groups, "_range"])
    for value, name in sums.items():
        out = out.withColumn(name, F.col(f"_o_{name}") + F.sum(value).over(local))
    return out.drop("_range", *[f"_o_{n}" for n in sums.values()])


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in a total ``order``."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), [], order, {"_one": name}).drop("_one")


def quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float], weight: str | None = None) -> DataFrame:
    """Exact quantiles per group with linear interpolation; nulls are left out.

    Equal values are merged before the shuffle, and no group is held in one task. With ``weight``, a column of whole
    numbers, each row stands for so many equal ones.
    """
    freq = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        (F.sum(weight) if weight else F.count("*")).alias("_n"))
    cum = running_totals(freq, groups, [F.col(value).asc()], {"_n": "_cum"})
    size = cum.groupBy(*groups).agg(F.max("_cum").alias("_size"))
    ranked = null_safe(cum, size, groups) if groups else cum.withColumn("_size", size.scalar())
    picks, outs = [], []
    for name, p in probs.items():
        h = (F.col("_size") - 1) * F.lit(float(p))
        for tag, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            here = (F.col("_cum") - F.col("_n") <= pos) & (pos < F.col("_cum"))
            picks.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{tag}_{name}"))
        picks.append(F.max(h - F.floor(h)).alias(f"_w_{name}"))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + F.col(f"_w_{name}") * (hi - lo)).alias(name))
    return ranked.groupBy(*groups).agg(*picks).select(*groups, *outs)


def id_digest(id_col: str, seed: int) -> Column:
    """Reproducible pseudo-random order key of a row: md5 of seed and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def hash_rank(
    df: DataFrame, id_col: str, strata: list[str] | None = None, seed: int = 42,
    rank: str = "rank", size: str = "stratum_size",
) -> DataFrame:
    """Adds each row's rank in the seeded random order of its stratum, and the stratum's size.

    The hash space is cut into 4096 buckets, whose counts give the offsets, so a
    stratum with a large share of all rows is still sorted bucket by bucket.
    """
    strata = strata or []
    keyed = df.withColumn("_digest", id_digest(id_col, seed)).withColumn(
        "_bucket", F.conv(F.substring("_digest", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    counts = keyed.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    whole = W.partitionBy(*strata)  # at most 4096 rows per stratum
    offsets = counts.select(
        *strata, "_bucket",
        (F.sum("_n").over(whole.orderBy("_bucket")) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(whole).alias(size),
    )
    local = W.partitionBy(*strata, "_bucket").orderBy("_digest", id_col)
    out = null_safe(keyed, offsets, [*strata, "_bucket"])
    return out.withColumn(rank, F.row_number().over(local) + F.col("_offset")).drop("_digest", "_bucket", "_offset")
