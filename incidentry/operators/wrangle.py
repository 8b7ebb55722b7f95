"""Wrangling of the hand-coded incident table: names, duplicates, recodes, task tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from incidentry.functions import recode
from incidentry.functions.text import blank_to_null, strip


def snake_names(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Snake-case column names, made unique with a number, then renamed."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c)
        name = re.sub(r"[^0-9A-Za-z]+", "_", name.replace("'", "")).strip("_").lower() or "x"
        name = f"x{name}" if name[0].isdigit() else name
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names).withColumnsRenamed(renames or {})


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order."""
    i, j = df.columns.index(first), df.columns.index(last)
    return df.columns[i : j + 1]


def relocate(df: DataFrame, cols: list[str], after: str) -> DataFrame:
    """Columns moved behind ``after``."""
    rest = [c for c in df.columns if c not in cols]
    i = rest.index(after) + 1
    return df.select(*rest[:i], *cols, *rest[i:])


def trim_strings(df: DataFrame) -> DataFrame:
    """Every string column trimmed of all white space, line ends included."""
    return df.select(*[
        strip(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def lower_names(df: DataFrame, first: str, last: str, suffix: str = "_name") -> DataFrame:
    """A column range lower-cased and suffixed, columns that have the suffix keep their name."""
    span = column_range(df, first, last)
    return df.select(*[
        F.lower(c).alias(c if c.endswith(suffix) else c + suffix) if c in span else F.col(c) for c in df.columns
    ])


def text_key(text: str) -> Column:
    """Grouping key of a text: its 16-byte digest, with null texts as one group."""
    return F.coalesce(F.unhex(F.md5(F.col(text))), F.unhex(F.lit("00")))


def repeated_keys(df: DataFrame, text: str, count: str) -> DataFrame:
    """(_key, count) of the texts that occur more than once.

    Only digests are shuffled, and copies are counted within each task first, so a
    group with a large share of all rows costs no more than any other.
    """
    counts = df.select(text_key(text).alias("_key")).groupBy("_key").agg(F.count("*").alias(count))
    return counts.filter(F.col(count) > 1)


def duplicate_groups(df: DataFrame, text: str, count: str = "dupe_count") -> DataFrame:
    """All rows whose text occurs more than once, with the number of copies.

    Spark broadcasts the repeated keys when they are small, and the rows stay where
    they are; otherwise it joins by shuffle, and AQE splits a hot group.
    """
    return df.withColumn("_key", text_key(text)).join(repeated_keys(df, text, count), "_key").drop("_key")


def without_duplicates(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text occurs exactly once; every copy of a repeated text goes, repeated nulls too."""
    keyed = df.withColumn("_key", text_key(text))
    return keyed.join(repeated_keys(df, text, "_n").select("_key"), "_key", "left_anti").select(*df.columns)


def recode_incidents(df: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Action, target and civilian-target indicators beside their source columns, success and damage recoded."""
    actions = recode.action_flags()
    targets = recode.target_flags()
    civilians = recode.civilian_flags(strict_reference=strict_reference)
    out = df.withColumns({
        **actions, **targets, **civilians,
        "action_successful": recode.yes_no(F.col("action_successful")),
        "property_damage": recode.is_yes(F.col("property_damage")),
    })
    out = relocate(out, list(actions), after="third_action")
    out = relocate(out, list(targets), after="second_target")
    return relocate(out, list(civilians), after="second_civilian_target")


def wrangle_coded(df: DataFrame, text: str = "incident_summary", strict_reference: bool = False) -> DataFrame:
    """Repeated summaries out, then recodes, then trimming: the order matters for the duplicates."""
    return trim_strings(recode_incidents(without_duplicates(df, text), strict_reference))


# Task table to (first column, last column), taken as a range in table order.
TASK_RANGES = {
    "action_type": ("armed_assault", "abduction"),
    "target_type": ("first_target", "other_civilian"),
    "deaths": ("total_fatalities", "other_armed_grp_fatalities"),
    "injuries": ("total_injuries", "non_maoist_armed_group_injuries"),
    "arrests": ("total_arrests", "unknown_arrests"),
    "surrenders": ("total_surrenders", "unknown_surrenders"),
    "location_info": ("state", "latitude"),
}
TASK_COLUMNS = {
    "property_damage": ["property_damage", "value_property_damage"],
    "abductions": ["total_abducted"],
    "identifying_info": ["year", "date", "incident_number"],
}
COMPLETE_ROWS = ("deaths", "injuries")


def task_table(df: DataFrame, task: str, text: str = "incident_summary") -> DataFrame:
    """Projection of the coded table for one task; count tasks keep complete rows only."""
    if task == "perpetrator":
        return df.filter(F.col("perpetrator").isin("Maoist", "Security", "Unknown")).select("perpetrator", text)
    cols = TASK_COLUMNS.get(task) or column_range(df, *TASK_RANGES[task])
    out = df.select(*cols, text)
    return out.na.drop() if task in COMPLETE_ROWS else out


def usable_counts(df: DataFrame, text: str, count: str) -> DataFrame:
    """Rows with a text other than blank or 'NA' and a readable count."""
    return df.filter(
        blank_to_null(F.col(text)).isNotNull() & (F.col(text) != "NA")
        & F.col(count).cast("string").try_cast("double").isNotNull()
    )


def stable_id(df: DataFrame, name: str, *cols: str) -> DataFrame:
    """Surrogate id from the row's own values, the same in every run; used only where ``name`` is missing."""
    made = F.concat(F.lit("generated_"), F.xxhash64(*[F.col(c) for c in cols]).cast("string"))
    if name in df.columns:
        return df.withColumn(name, F.coalesce(F.col(name).cast("string"), made))
    return df.withColumn(name, made)


def since(df: DataFrame, date: str, first: str = "2005-01-01") -> DataFrame:
    """Rows with a readable date on or after ``first``; the date as yyyy-MM-dd text."""
    stamp = F.col(date).cast("string").try_cast("timestamp")
    return df.filter(stamp >= F.lit(first).cast("timestamp")).withColumn(date, F.date_format(stamp, "yyyy-MM-dd"))


def sentinel_audit(df: DataFrame, cols: list[str], sentinel: str = "99") -> DataFrame:
    """Per column: values equal to the sentinel, and values that contain it."""
    aggs = []
    for c in cols:
        aggs += [F.count_if(F.col(c) == sentinel).alias(f"{c}__exact"),
                 F.count_if(F.col(c).contains(sentinel)).alias(f"{c}__contains")]
    stack = ", ".join(f"'{c}', `{c}__exact`, `{c}__contains`" for c in cols)
    return df.agg(*aggs).selectExpr(f"stack({len(cols)}, {stack}) as (field, exact_count, contains_count)")


def latest_of_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``, by partial aggregation."""
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_row")).select(key, "_row.*").select(*df.columns)
