"""Parsing counts out of model answers, and finding the answer in the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentry.functions.text import NUMBER_WORDS, digits_to_long, let, strip


def whole_number(c: Column) -> Column:
    """First free-standing integer, 0 when there is none."""
    return F.coalesce(digits_to_long(F.regexp_extract(c, r"\b(\d+)\b", 1)), F.lit(0).cast("bigint"))


def number_word(c: Column) -> Column:
    """Value of the first number word, in counting order, found anywhere in the text."""
    low = F.lower(c)
    out = F.when(low.contains(NUMBER_WORDS[0]), 0)
    for value, word in enumerate(NUMBER_WORDS[1:], 1):
        out = out.when(low.contains(word), value)
    return out.cast("bigint")


def lenient_count(c: Column) -> Column:
    """Count in a free answer: a plain integer (negatives to 0), else the first digits, else a number word."""

    def parse(t: Column) -> Column:
        whole = F.regexp_extract(t, r"^([+-]?\d+(?:_\d+)*)$", 1)
        value = digits_to_long(F.replace(whole, F.lit("_"), F.lit("")))
        plain = F.when(value >= 0, value).when(value < 0, F.lit(0).cast("bigint"))
        return F.coalesce(plain, digits_to_long(F.regexp_extract(t, r"\d+", 0)), number_word(t))

    text = strip(F.rtrim(strip(c), F.lit(".")))
    return F.when(c.isNotNull() & (c != ""), let(text, parse))


def prediction_count(c: Column, kind: str = "seq2seq") -> Column:
    """Typed count of a raw prediction: regression output is rounded half to even and floored at 0."""
    zero = F.lit(0).cast("bigint")
    if kind == "regression":
        x = c.cast("string").try_cast("double")
        usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 9e18)
        return F.when(usable, F.greatest(F.bround(x, 0).try_cast("bigint"), zero)).otherwise(zero)
    return F.coalesce(lenient_count(c.cast("string")), zero)


def fatalities(c: Column, plausible_max: int = 200) -> Column:
    """Fatality count of a model answer.

    A fenced block is unwrapped, then the JSON field is taken if present, else the
    first number up to ``plausible_max``, else the first number, else 0.
    """
    zero = F.lit(0).cast("bigint")
    # Only the text around the first fenced block is taken off; without a fence nothing changes.
    inner = F.regexp_replace(c, r"(?is)^.*?```(?:json)?\s*(.*?)\s*```.*$", "$1")
    body = F.replace(F.when(c.contains("```"), inner).otherwise(c), F.lit("`"), F.lit(""))

    def from_numbers(numbers: Column) -> Column:
        values = F.transform(numbers, lambda x: x.try_cast("bigint"))
        return let(values, lambda v: F.coalesce(
            F.try_element_at(F.filter(v, lambda n: n <= plausible_max), F.lit(1)), F.try_element_at(v, F.lit(1))))

    def parse(b: Column) -> Column:
        field = digits_to_long(F.regexp_extract(b, r'"fatalities"\s*:\s*(-?\d+)', 1))
        given = F.when(field >= 0, field).when(field < 0, zero)
        return F.coalesce(given, from_numbers(F.regexp_extract_all(b, F.lit(r"(\d+)"), F.lit(1))), zero)

    return let(body, parse)


def five_counts(c: Column, missing: int = -100) -> Column:
    """The five 'name: value' lines of an answer as an array; unreadable values become ``missing``.

    Answers without five lines give five missing values.
    """
    lines = F.slice(F.split(c, "\n"), 1, 5)
    values = F.transform(
        lines,
        lambda line: F.coalesce(
            strip(F.try_element_at(F.split(line, ":"), F.lit(2))).try_cast("int"), F.lit(missing)),
    )
    empty = F.array(*[F.lit(missing)] * 5)
    return F.when(F.size(lines) == 5, values).otherwise(empty)


def readable_five(counts: Column, missing: int = -100) -> Column:
    """True when no value of :func:`five_counts` is missing."""
    return ~F.array_contains(counts, missing)


# Number-in-context patterns, tried in order. Group 1 leads up to the number, group 2 is the number.
CONTEXT_PATTERNS = (
    r"(?is)^(.*?\b)(\d+)\s+(?:people\s+)?(?:were\s+)?(?:killed|dead|died)",
    r"(?is)^(.*?(?:killed|killing)\s+)(\d+)",
    r"(?is)^(.*?(?:death|deaths)\s+(?:of\s+)?)(\d+)",
    r"(?is)^(.*?)(\d+)\s+(?:fatalities|casualties)",
)


def answer_span(text: Column, count: Column) -> Column:
    """Struct (answer_text, answer_start) of a count in its text; start is 0-based, -1 when absent.

    The count itself is looked for first, then numbers beside a death word, then any number.
    """
    answer = count.cast("string")
    at = F.regexp_instr(text, F.concat(F.lit(r"\b\Q"), answer, F.lit(r"\E\b"))) - 1
    found = [F.when(at >= 0, F.struct(answer.alias("answer_text"), at.alias("answer_start")))]
    for pattern in (*CONTEXT_PATTERNS, r"(?s)^(.*?\b)(\d+)\b"):
        number = F.regexp_extract(text, pattern, 2)
        start = F.length(F.regexp_extract(text, pattern, 1))
        found.append(F.when(number != "", F.struct(number.alias("answer_text"), start.alias("answer_start"))))
    return F.coalesce(*found, F.struct(answer.alias("answer_text"), F.lit(-1).alias("answer_start")))
