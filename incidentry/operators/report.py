"""Dashboard aggregates and comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from incidentry.operators.ranks import null_safe, running_totals

MEASURES = ("total_fatalities", "total_injuries", "total_abducted", "total_arrests", "total_surrenders")


def dashboard_rows(df: DataFrame, date: str = "Date") -> DataFrame:
    """Incident table with a typed date, year and month; unreadable dates become null."""
    stamp = F.col(date).cast("string").try_cast("timestamp")
    return df.withColumns({date: F.to_date(stamp), "year": F.year(stamp), "month": F.month(stamp)})


def select_rows(df: DataFrame, states: list[str] | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """Rows of chosen states and years, both ends included."""
    if states is not None:
        df = df.filter(F.col("state").isin(states))
    if years is not None:
        df = df.filter(F.col("year").between(*years))
    return df


def key_figures(df: DataFrame, measures=MEASURES) -> DataFrame:
    """Number of incidents and the sum of each measure."""
    return df.agg(F.count("*").alias("total_incidents"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])


def top_group(df: DataFrame, group: str, measure: str) -> DataFrame:
    """Group with the largest sum, the first in key order on a tie."""
    sums = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.coalesce(F.sum(measure), F.lit(0)).alias(measure))
    return sums.orderBy(F.col(measure).desc(), group).limit(1)


def monthly_timeline(df: DataFrame, date: str = "Date", count: str = "incidents") -> DataFrame:
    """Month ends from the first to the last month with their row counts, empty months as 0."""
    months = df.filter(F.col(date).isNotNull()).groupBy(F.last_day(date).alias("month_end")).agg(
        F.count("*").alias("_n"))
    bounds = months.agg(F.min("month_end").alias("a"), F.max("month_end").alias("b"))
    spine = bounds.filter("a is not null").select(F.explode(F.sequence(
        F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m"))
    spine = spine.select(F.last_day("m").alias("month_end"))
    return spine.join(months, "month_end", "left").select(
        "month_end", F.coalesce("_n", F.lit(0)).alias(count))


def totals_by(df: DataFrame, group: str, id_col: str = "Incident_Number", measures=MEASURES) -> DataFrame:
    """Incidents and measure sums per group, null groups left out."""
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(id_col).alias("total_incidents"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])


def fill_regions(totals: DataFrame, regions: DataFrame, name: str, group: str = "state") -> DataFrame:
    """Every region with its totals, 0 where there are none; names are compared trimmed and title-cased."""
    def key(c: str) -> Column:
        return F.trim(F.initcap(F.col(c)))

    left = regions.select(key(name).alias("region_name"))
    right = totals.withColumn("region_name", key(group)).drop(group)
    return left.join(right, "region_name", "left").na.fill(0)


def indicator_totals(df: DataFrame, cols: list[str]) -> DataFrame:
    """(indicator, total, share) of indicator columns, in one pass."""
    sums = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols])
    whole = sum((F.col(c) for c in cols), F.lit(0))
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("indicator"), F.col(c).cast("bigint").alias("total"),
                 F.when(whole > 0, F.col(c) / whole).otherwise(F.lit(0.0)).alias("share")) for c in cols])))


def pivot_counts(df: DataFrame, rows: str, cols: str, values: list) -> DataFrame:
    """Counts by two keys as a table with an explicit column list, 0 where empty."""
    return df.filter(F.col(rows).isNotNull() & F.col(cols).isNotNull()).groupBy(rows).pivot(cols, values).count().na.fill(0)


def daily_sums(df: DataFrame, date: str, measures: list[str]) -> DataFrame:
    return df.filter(F.col(date).isNotNull()).groupBy(date).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])


def counts_by(df: DataFrame, col: str, keep_null: bool = False, count: str = "n") -> DataFrame:
    """Row counts per value, largest first, then by value."""
    data = df if keep_null else df.filter(F.col(col).isNotNull())
    return data.groupBy(col).agg(F.count("*").alias(count)).orderBy(F.col(count).desc(), col)


def top_counts(df: DataFrame, col: str, k: int = 10, count: str = "n") -> DataFrame:
    """The k most frequent values."""
    return counts_by(df, col, count=count).limit(k)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows in key order."""
    return df.orderBy(key).limit(n)


def cumulative_years(df: DataFrame, year: str = "year") -> DataFrame:
    """Rows per year, running percentage, and whether 80 and 90 percent are reached first in that year."""
    per = df.filter(F.col(year).isNotNull()).groupBy(year).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n")).scalar()
    cum = running_totals(per, [], [F.col(year).asc()], {"n": "_cum"})
    pct = F.col("_cum") * 100.0 / total
    before = (F.col("_cum") - F.col("n")) * 100.0 / total
    return cum.select(
        year, "n", pct.alias("cum_percent"),
        ((pct >= 80) & (before < 80)).alias("reaches_80"), ((pct >= 90) & (before < 90)).alias("reaches_90"))


def wide_models(runs: DataFrame, base: DataFrame, key: str, models: list[str], model: str = "model",
                value: str = "prediction") -> DataFrame:
    """One row per base id with a prediction column per model, null where a model has none."""
    wide = runs.groupBy(key).pivot(model, models).agg(F.first(value))
    return base.join(wide, key, "left")


def combined_predictions(runs: dict[str, DataFrame], cols: list[str]) -> DataFrame:
    """Prediction tables of several models as one long table with the model's name."""
    out = None
    for name, df in runs.items():
        part = df.select(F.lit(name).alias("model"), *cols)
        out = part if out is None else out.unionByName(part)
    return out


def tag_run(df: DataFrame, **tags) -> DataFrame:
    """Constant run columns such as fraction and strategy added."""
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})


def stack_runs(dfs: list[DataFrame]) -> DataFrame:
    """Row union by name; missing columns become null."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def with_synthetic(real: DataFrame, made: DataFrame, source: str) -> DataFrame:
    """Augmented rows appended, marked by is_synthetic and synthetic_source."""
    a = real.withColumns({"is_synthetic": F.lit(0), "synthetic_source": F.lit(None).cast("string")})
    b = made.withColumns({"is_synthetic": F.lit(1), "synthetic_source": F.lit(source)})
    return a.unionByName(b, allowMissingColumns=True)


def union_first(tables: list[DataFrame], key: str) -> DataFrame:
    """Union with one row per key; earlier tables win."""
    tagged = [t.withColumn("_src", F.lit(i)) for i, t in enumerate(tables)]
    both = stack_runs(tagged)
    rest = [c for c in both.columns if c not in (key, "_src")]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), "_src").alias("_row")).select(key, "_row.*")


def order_by_mean(df: DataFrame, axes: dict[str, bool], score: str) -> DataFrame:
    """Adds ``<axis>_rank``: place of each axis value by its mean score, descending where the flag is set.

    Means come from a partial aggregation; only one row per axis value is ranked.
    """
    out = df
    for axis, descending in axes.items():
        means = df.groupBy(axis).agg(F.avg(score).alias("_m"))
        order = F.col("_m").desc() if descending else F.col("_m").asc()
        ranks = means.select(axis, F.row_number().over(W.orderBy(order, axis)).alias(f"{axis}_rank"))
        out = null_safe(out, ranks, [axis])
    return out


def best_per(df: DataFrame, group: str, candidate: str, score: str, largest: bool = True) -> DataFrame:
    """Candidate with the best score per group, the first by name on a tie."""
    key = -F.col(score) if largest else F.col(score)
    data = df.filter(F.col(score).isNotNull())
    pick = F.min_by(F.struct(candidate, score), F.struct(key.alias("s"), candidate))
    return data.groupBy(group).agg(pick.alias("_b")).select(group, f"_b.{candidate}", f"_b.{score}")


def spread(long: DataFrame, rows: list[str], name: Column, value: str, names: list[str]) -> DataFrame:
    """Long metrics to one wide row per key, with an explicit column list."""
    return long.withColumn("_name", name).groupBy(*rows).pivot("_name", names).agg(F.first(value))


def question_rows(df: DataFrame, text: str = "incident_summary") -> DataFrame:
    """Five question/answer rows per incident."""
    # Count column, question, answer noun.
    asked = (
        ("total_injuries", "How many injuries occurred in the incident?", "injuries"),
        ("total_arrests", "How many arrests were made in the incident?", "arrests"),
        ("total_surrenders", "How many people surrendered in the incident?", "surrenders"),
        ("total_fatalities", "How many fatalities occurred in the incident?", "fatalities"),
        ("total_abducted", "How many people were abducted in the incident?", "abducted"),
    )
    rows = F.array(*[
        F.struct(
            F.concat(F.lit(f"question: {q} context: "), F.col(text)).alias("input_text"),
            F.concat_ws(" ", F.col(c).cast("bigint").cast("string"), F.lit(noun)).alias("target_text"))
        for c, q, noun in asked])
    return df.select(*[c for c in df.columns if c != text], F.inline(rows))


def chat_messages(text: Column, system: str, template: str = "{text}", shots: list[tuple[str, str]] = ()) -> Column:
    """Message array (role, content): system, worked examples, then the text in the template."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    head, tail = template.split("{text}")
    turns = [message("system", F.lit(system))]
    for example, label in shots:
        turns += [message("user", F.lit(head + example + tail)), message("assistant", F.lit(label))]
    return F.array(*turns, message("user", F.concat(F.lit(head), text, F.lit(tail))))


# Prompt wording per model family, the text appended.
COUNT_PROMPTS = {
    "nt5": "answer_me: How many people were killed? Answer with only a number. context: ",
    "mt5": "<2en> How many people were killed? Answer with only a number.\n\n",
    "default": "How many people were killed? Answer with only a number.\n\n",
}
PLACE_PROMPT = ("Extract location hierarchy from incident: ",
                "\nFormat: state: <name>, district: <name>, village: <name>, other_locations: <name>. "
                "Use exact format with labels. Omit missing levels.")


def count_task_text(text: Column, family: str = "default") -> Column:
    return F.concat(F.lit(COUNT_PROMPTS.get(family, COUNT_PROMPTS["default"])), text)


def place_task_text(text: Column) -> Column:
    return F.concat(F.lit(PLACE_PROMPT[0]), text, F.lit(PLACE_PROMPT[1]))
