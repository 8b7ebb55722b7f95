"""Text cleaning and small scalar recodes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the characters Python calls white space, as a Java regex class body.
SPACE = r"\s\x1C-\x1F\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


# The same characters as a string.
WHITE = "".join(chr(n) for n in range(0x3001) if chr(n).isspace())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends (plain ``trim`` removes blanks only)."""
    return F.trim(c, F.lit(WHITE))


def digits_to_long(c: Column) -> Column:
    """Integer of a text that is either digits or ''. A failed cast costs an exception per row, so '' is not cast."""
    return F.nullif(c, F.lit("")).try_cast("bigint")


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank."""
    return F.regexp_replace(c, f"[{SPACE}]+", " ")


def blank_to_null(c: Column) -> Column:
    """Trimmed text, with blank text as null."""
    return F.nullif(strip(c), F.lit(""))


def truncate(c: Column, n: int) -> Column:
    """Texts longer than ``n`` characters are cut and marked with an ellipsis."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("...")))


def plain_html(c: Column) -> Column:
    """Text of an HTML fragment: tags dropped, the common entities decoded."""
    out = F.regexp_replace(c, r"(?s)<!--.*?-->|<[^>]*>", "")
    # Entities in decoding order, the ampersand last.
    for entity, char in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"),
        ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"),
    ):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def summary_text(c: Column) -> Column:
    """Incident summary as published: trimmed, single-spaced, then the fold marker removed.

    The marker goes last, so a blank before it stays.
    """
    return F.replace(squeeze(strip(c)), F.lit("Read less..."), F.lit(""))


# Month names of the page address to month numbers.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def month_number(month: Column) -> Column:
    """Two-digit month number of an English three-letter month name; null for anything else."""
    pairs = [F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")]
    return F.try_element_at(F.create_map(*pairs), month)


def day_of(date_text: Column) -> Column:
    """Day of a dash-separated date text: its last part, padded with zeros to at least two digits."""
    day = strip(F.element_at(F.split(strip(date_text), "-"), -1))
    return F.when(F.length(day) >= 2, day).otherwise(F.lpad(day, 2, "0"))


def incident_date(year: Column, month: Column, date_text: Column) -> Column:
    return F.concat_ws("-", year, month_number(month), day_of(date_text))


def series_key(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s))


def nfkc(c: Column) -> Column:
    """Unicode compatibility form. Pure ASCII text is its own form and is not sent to Python."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


# Spelled-out numbers, in search order.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


# State and territory aliases (lower case) to canonical names.
STATE_ALIASES = {
    "up": "Uttar Pradesh",
    "wb": "West Bengal",
    "uk": "Uttarakhand",
    "mp": "Madhya Pradesh",
    "hp": "Himachal Pradesh",
    "jk": "Jammu and Kashmir",
    "j&k": "Jammu and Kashmir",
    "tn": "Tamil Nadu",
    "ap": "Andhra Pradesh",
    "ts": "Telangana",
    "mh": "Maharashtra",
    "gj": "Gujarat",
    "pb": "Punjab",
    "rj": "Rajasthan",
    "br": "Bihar",
    "kl": "Kerala",
    "ka": "Karnataka",
    "cg": "Chhattisgarh",
    "ct": "Chhattisgarh",
    "od": "Odisha",
    "or": "Odisha",
    "nl": "Nagaland",
    "as": "Assam",
    "arpr": "Arunachal Pradesh",
    "ar": "Arunachal Pradesh",
    "sk": "Sikkim",
    "tr": "Tripura",
    "mz": "Mizoram",
    "ml": "Meghalaya",
    "ga": "Goa",
    "dl": "Delhi",
    "ch": "Chandigarh",
    "ld": "Lakshadweep",
    "py": "Puducherry",
    "an": "Andaman and Nicobar Islands",
    "dn": "Dadra and Nagar Haveli and Daman and Diu",
    "dd": "Dadra and Nagar Haveli and Daman and Diu",
    "jk&l": "Ladakh",
    "orissa": "Odisha",
    "uttaranchal": "Uttarakhand",
    "pondicherry": "Puducherry",
    "jammu & kashmir": "Jammu and Kashmir",
    "jammu and kashmir": "Jammu and Kashmir",
}


def canonical_state(name: Column, canonical: list[str], aliases: dict[str, str] | None = None) -> Column:
    """Canonical state of a name or alias; unknown names come back trimmed, missing ones as ''."""
    aliases = STATE_ALIASES if aliases is None else aliases
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    s = strip(name)
    return (
        F.when(name.isNull(), F.lit(""))
        .when(s.isin(canonical), s)
        .otherwise(F.coalesce(F.try_element_at(table, F.lower(s)), s))
    )


def is_valid_state(name: Column, canonical: list[str], aliases: dict[str, str] | None = None) -> Column:
    return F.coalesce(name != "", F.lit(False)) & canonical_state(name, canonical, aliases).isin(canonical)


# Descriptors taken off the end of place words, phrases first, as regex bodies.
PLACE_DESCRIPTORS = (
    r"police\s+station", r"police\s+camp", r"police\s+outpost", "district", r"dt\.?", r"dist\.?",
    "village", "town", "state", "mandal", "block", "area", "ps", r"p\.s\.?", "panchayat", "tehsil",
    "taluk", "division", "camp", "outpost", "road", "forest", "region", "locality",
)


def drop_descriptors(c: Column) -> Column:
    """Place name without generic words such as 'district' or 'police station', single-spaced."""
    out = strip(c)
    for word in PLACE_DESCRIPTORS:
        out = F.regexp_replace(out, rf"(?i)[{SPACE}]+{word}\b", "")
    return strip(squeeze(out))


# Abbreviations and their expansions, in order.
ABBREVIATIONS = (
    (r"\bdist\.?\b", "district"), (r"\bdt\.?\b", "district"), (r"\btaluk\b", "taluka"),
    (r"\bmandal\b", "mandalam"), (r"\bps\b", "police station"), (r"\bst\.?\b", "state"),
)


def matching_form(c: Column) -> Column:
    """Lower-case text with abbreviations written out and punctuation other than hyphens as blanks."""
    out = F.lower(c)
    for pattern, word in ABBREVIATIONS:
        out = F.regexp_replace(out, pattern, word)
    out = F.regexp_replace(out, r"(?U)[^\w\s\-]", " ")
    return F.coalesce(strip(squeeze(out)), F.lit(""))


# Words taken out of geocoder queries, in order, as plain substrings.
QUERY_STOP_WORDS = ("police", "station", "dam", "river", "rivers", "forests", "forest")


def drop_query_words(c: Column) -> Column:
    """Lower-case text with each stop word deleted wherever it occurs ('rivers' leaves its 's')."""
    out = F.lower(c)
    for word in QUERY_STOP_WORDS:
        out = F.replace(out, F.lit(word), F.lit(""))
    return out


def integer_id(c: Column) -> Column:
    """Numeric text as integer text ('12.0' to '12'); null when not numeric."""
    return c.cast("string").try_cast("double").try_cast("bigint").cast("string")


def title_label(c: Column) -> Column:
    """Column-style label to a display label: underscores to blanks, title case."""
    return F.initcap(F.regexp_replace(c, "_", " "))


def display_label(c: Column, names: dict[str, str]) -> Column:
    """Lookup in a fixed label map; unknown labels stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)
