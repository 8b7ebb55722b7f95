"""Label parsing of raw classifier answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentry.functions.similarity import closest_label
from incidentry.functions.text import strip

# Perpetrator labels, the default last.
PERPETRATORS = ["Maoist", "Security", "Unknown"]


def single_label(answer: Column, labels: list[str] = PERPETRATORS, threshold: float = 0.5) -> Column:
    """Valid label of an answer: equal apart from case, else the most similar one, else the last label."""
    text = strip(answer)
    table = F.create_map(*[x for label in reversed(labels) for x in (F.lit(label.lower()), F.lit(label))])
    exact = F.try_element_at(table, F.lower(text))
    guess = closest_label(labels, threshold)(F.when(exact.isNull(), text))
    return F.when(answer.isNotNull(), F.coalesce(exact, guess, F.lit(labels[-1])))


def label_parts(answer: Column) -> Column:
    """The comma-separated parts of an answer, lower case; none for a blank answer or 'none'."""
    low = F.lower(strip(answer))
    parts = F.transform(F.split(F.coalesce(answer, F.lit("")), ","), lambda p: F.lower(strip(p)))
    return F.when(answer.isNull() | (answer == "") | (low == "none"), F.array().cast("array<string>")).otherwise(parts)
