"""Profiles of location columns and distance summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.functions.places import mentioned
from incidentry.operators.match import names_by_state
from incidentry.operators.ranks import null_safe, quantiles


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, present, missing, percent_present) in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in cols])
    return counts.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.col(c).alias("present"), (F.col("_n") - F.col(c)).alias("missing"),
            (F.col(c) * 100.0 / F.col("_n")).alias("percent_present")) for c in cols])))


def presence_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with both columns, only one, neither, either."""
    x, y = F.col(a).isNotNull(), F.col(b).isNotNull()
    return df.agg(
        F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias(f"only_{a}"), F.count_if(~x & y).alias(f"only_{b}"),
        F.count_if(~x & ~y).alias("neither"), F.count_if(x | y).alias("either"))


def text_presence(df: DataFrame, cols: list[str], text: str) -> DataFrame:
    """(column_name, present, in_text, percent_in_text): how often a value occurs in its text, case ignored."""
    aggs = []
    for c in cols:
        here = F.col(c).isNotNull() & F.col(text).isNotNull()
        aggs += [F.count_if(here).alias(f"{c}__n"), F.count_if(here & mentioned(F.trim(c), F.col(text))).alias(f"{c}__in")]
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("present"), F.col(f"{c}__in").alias("in_text"),
            F.when(F.col(f"{c}__n") > 0, F.col(f"{c}__in") * 100.0 / F.col(f"{c}__n")).otherwise(F.lit(0.0))
            .alias("percent_in_text")) for c in cols])))


# Keyword categories of free-text areas.
AREA_KEYWORDS = {
    "forest": ("forest", "reserve", "sanctuary", "park", "wildlife"),
    "police_station": ("police station", "ps ", " ps", "thana"),
    "block_tehsil": ("block", "tehsil", "taluk", "mandal", "tahsil"),
    "area_region": ("area", "region", "zone", "sector"),
    "geographic": ("hills", "valley", "ghat", "range", "mountains"),
}


def keyword_categories(df: DataFrame, col: str, keywords: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(category, n, percent) of values that hold one of a category's words; categories may overlap."""
    words = keywords or AREA_KEYWORDS
    sums = df.filter(F.col(col).isNotNull()).agg(F.count("*").alias("_n"), *[
        F.count_if(F.col(col).rlike("(?i)" + "|".join(w))).alias(k) for k, w in words.items()])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("category"), F.col(k).alias("n"),
                 F.when(F.col("_n") > 0, F.col(k) * 100.0 / F.col("_n")).otherwise(F.lit(0.0)).alias("percent"))
        for k in words])))


def similarity_bands(df: DataFrame, similarity: str) -> DataFrame:
    """Counts of identical, high, medium, low similarity, and mean, median, least, largest."""
    s = F.col(similarity)
    out = df.agg(
        F.count_if(s == 1).alias("identical"), F.count_if(s >= 0.8).alias("high"),
        F.count_if((s >= 0.5) & (s < 0.8)).alias("medium"), F.count_if(s < 0.5).alias("low"),
        F.avg(s).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"))
    return out.withColumn("median", quantiles(df, [], similarity, {"median": 0.5}).scalar())


def ambiguous_names(df: DataFrame, district: str, state: str) -> DataFrame:
    """Districts found in more than one state, with states and incidents."""
    return names_by_state(df, district, state).filter("num_states > 1")


def ambiguity_summary(df: DataFrame, district: str, state: str) -> DataFrame:
    """(num_states, districts, incidents, percent_of_incidents) by number of states."""
    names = names_by_state(df, district, state)
    total = df.agg(F.count("*")).scalar()
    return names.groupBy("num_states").agg(
        F.count("*").alias("districts"), F.sum("total_incidents").alias("incidents"),
    ).withColumn("percent_of_incidents", F.col("incidents") * 100.0 / total)


def ambiguous_incidents(df: DataFrame, district: str, state: str) -> DataFrame:
    """Incidents in ambiguous districts."""
    return df.join(ambiguous_names(df, district, state).select(district), district, "left_semi")


def disambiguation(df: DataFrame, district: str, state: str, village: str, other: str) -> DataFrame:
    """Per ambiguous district: incidents with a village, other areas, either, and the rate of either."""
    v, o = F.col(village).isNotNull(), F.col(other).isNotNull()
    pairs = df.filter(F.col(district).isNotNull()).groupBy(district, state).agg(
        F.count("*").alias("_n"), F.count_if(v).alias("_v"), F.count_if(o).alias("_o"), F.count_if(v | o).alias("_e"))
    return pairs.groupBy(district).agg(
        F.count(state).alias("num_states"), F.sum("_n").alias("total_incidents"), F.sum("_v").alias("has_village"),
        F.sum("_o").alias("has_other_areas"), F.sum("_e").alias("has_either"),
    ).filter("num_states > 1").withColumn("disambiguation_rate", F.col("has_either") * 100.0 / F.col("total_incidents"))


def group_overview(df: DataFrame, group: str, id_col: str, means: list[str]) -> DataFrame:
    """Count and column means per group, largest group first."""
    return df.groupBy(group).agg(F.count(id_col).alias("n"), *[F.avg(m).alias(f"avg_{m}") for m in means]).orderBy(
        F.col("n").desc(), group)


def hit_summary(df: DataFrame, group: str, hit: str) -> DataFrame:
    """(group, total, correct, accuracy percent)."""
    h = F.col(hit).cast("int")
    return df.groupBy(group).agg(
        F.count(h).alias("total"), F.sum(h).alias("correct"), (F.avg(h) * 100).alias("accuracy"))


def count_overview(df: DataFrame, value: str, by: str) -> DataFrame:
    """Zeros share, mean, median, largest of a count: for the whole table and per group.

    The whole-table row has a null group and ``is_total`` true.
    """
    zero = F.avg((F.col(value) == 0).cast("int")) * 100
    both = df.groupingSets([[F.col(by)], []], F.col(by)).agg(
        F.grouping(by).cast("boolean").alias("is_total"), F.count("*").alias("n"), zero.alias("percent_zero"),
        F.avg(value).alias("mean"), F.max(value).alias("max"))
    expanded = df.select(F.explode(F.array(
        F.struct(F.col(by), F.lit(False).alias("is_total")),
        F.struct(F.lit(None).cast(df.schema[by].dataType).alias(by), F.lit(True).alias("is_total")))).alias("g"), value)
    medians = quantiles(expanded.select(f"g.{by}", "g.is_total", value), [by, "is_total"], value, {"median": 0.5})
    return null_safe(both, medians, [by, "is_total"])


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """Bin number of a value with bins closed on the right; 0 at or below the first edge."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(value > e, 1).otherwise(0)
    return out


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, n, proportion) with bins closed on the right."""
    bins = df.groupBy(right_closed_bin(F.col(value), edges).alias("bin")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return bins.withColumn("proportion", F.col("n") / total)


DISTANCE_STEPS = (1, 5, 10, 50, 100)


def distance_summary(df: DataFrame, by: list[str], distance: str = "distance_km", steps=DISTANCE_STEPS) -> DataFrame:
    """n, mean, median, sample deviation, least, largest, and percent within each step; rows without a distance left out."""
    data = df.filter(F.col(distance).isNotNull())
    d = F.col(distance)
    main = data.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.min(d).alias("min"),
        F.max(d).alias("max"),
        *[(F.avg((d <= s).cast("int")) * 100).alias(f"pct_within_{s}km") for s in steps])
    median = quantiles(data, by, distance, {"median": 0.5})
    return null_safe(main, median, by) if by else main.withColumn("median", median.scalar())


def compare_strategies(df: DataFrame, pairs: dict[str, str], strategy: str = "strategy") -> DataFrame:
    """(strategy, pair, n, mean, median, within_10, within_50) for several distance columns at once."""
    long = df.select(strategy, F.inline(F.array(*[
        F.struct(F.lit(name).alias("pair"), F.col(c).alias("_d")) for name, c in pairs.items()])))
    keys = [strategy, "pair"]
    main = long.groupBy(*keys).agg(
        F.count("_d").alias("n"), F.avg("_d").alias("mean"), F.count_if(F.col("_d") <= 10).alias("within_10"),
        F.count_if(F.col("_d") <= 50).alias("within_50"))
    return null_safe(main, quantiles(long, keys, "_d", {"median": 0.5}), keys, "left")


def best_strategies(table: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Per pair: strategy with the least mean, the least median, the most within 10 km; first by name on ties."""
    def pick(key: Column) -> Column:
        return F.min_by(strategy, F.struct(key.isNull().alias("z"), key.alias("k"), strategy))

    return table.groupBy("pair").agg(
        pick(F.col("mean")).alias("lowest_mean"), pick(F.col("median")).alias("lowest_median"),
        pick(-F.col("within_10")).alias("most_within_10"))
