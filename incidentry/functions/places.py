"""Structured location strings, component lists, and geocoder queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentry.functions.text import SPACE, blank_to_null, let, nfkc, squeeze, strip

LEVELS = ("state", "district", "village", "other_locations")
CORE = LEVELS[:3]


def clean_structured(c: Column, normalise: bool = True) -> Column:
    """Location text without generation artefacts.

    Compatibility form (optional, an Arrow UDF), no zero-width characters, ASCII
    punctuation, no short bracketed tags, single blanks, no outer blanks or commas.
    """
    out = nfkc(c) if normalise else c
    out = F.regexp_replace(out, r"[\x{200B}-\x{200D}\x{FEFF}]", "")
    out = F.translate(out, "：，", ":,")
    out = F.regexp_replace(out, r"\[[^\]\n\r]{1,10}\]", "")
    return F.trim(squeeze(out), F.lit(" ,\t\n\r"))


def parse_structured(c: Column, normalise: bool = True, keep_tail: bool = False) -> Column:
    """Struct (state, district, village, other_locations) of a ``label: value, ...`` string.

    Absent fields are null, empty ones ''. The last of repeated fields counts.
    Commas separate fields, so only the first of several other locations is
    kept; ``keep_tail`` keeps all of them.
    """

    def labelled(part: Column) -> Column:
        at = F.instr(part, ":")
        return F.struct(
            F.lower(strip(part.substr(F.lit(1), at - 1))).alias("label"),
            strip(part.substr(at + 1, F.length(part))).alias("value"))

    def fields(text: Column) -> Column:
        parts = F.filter(F.split(text, ","), lambda p: p.contains(":"))

        def pick(pairs: Column) -> Column:
            cols = {
                name: F.try_element_at(F.filter(pairs, lambda p: p.label == name), F.lit(-1)).value for name in LEVELS}
            if keep_tail:
                tail = r"(?is)(?:^|,)\s*other_locations\s*:(.*?)(?=,\s*(?:state|district|village)\s*:|$)"
                cols["other_locations"] = F.when(
                    cols["other_locations"].isNotNull(), strip(F.regexp_extract(text, tail, 1)))
            return F.struct(*[col.alias(name) for name, col in cols.items()])

        return let(F.transform(parts, labelled), pick)

    return let(F.coalesce(clean_structured(c, normalise), F.lit("")), fields)


def parse_answer(c: Column, normalise: bool = True) -> Column:
    """Parsed location of a chatty model answer: fences off, then the first run of ordered fields."""
    text = F.regexp_replace(strip(c), r"(?i)```(?:text|json)?\s*([\s\S]*?)\s*```", "$1")
    text = F.replace(text, F.lit("`"), F.lit(""))
    run = r"(?i)(state:\s*[^,]+" + "".join(rf"(?:,\s*{name}:\s*[^,]+)?" for name in LEVELS[1:]) + ")"
    found = F.regexp_extract(text, run, 1)
    return parse_structured(F.when(found != "", found).otherwise(text), normalise)


def build_structured(state: Column, district: Column, village: Column, other: Column) -> Column:
    """Structured string of the parts that hold text; '' when none does."""
    named = zip(LEVELS, (state, district, village, other), strict=True)
    return F.concat_ws(", ", *[F.concat(F.lit(f"{name}: "), blank_to_null(c)) for name, c in named])


def build_from(parsed: Column) -> Column:
    return build_structured(*[parsed.getField(name) for name in LEVELS])


def json_to_structured(c: Column) -> Column:
    """Structured string of a JSON answer; blank fields dropped, unreadable JSON gives ''."""
    schema = ", ".join(f"{name} string" for name in LEVELS)
    return F.coalesce(build_from(F.from_json(c, schema)), F.lit(""))


# ---- component lists ---------------------------------------------------------------------


def components(c: Column) -> Column:
    return F.transform(F.split(c, ","), strip)


def lower_components(c: Column) -> Column:
    """Distinct lower-case components that are not blank."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda p: F.lower(strip(p))), lambda p: p != ""))


def without_parens(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"[{SPACE}]*\([^)]*\)", ""))


def drop_repeats(other: Column, name: Column, list_slack: int, single_slack: int = 10) -> Column:
    """A comma list without the components that only repeat ``name``.

    A component repeats the name when it equals it, or contains it and is less
    than the slack longer; a single value also when the name contains it. Case is ignored.
    """
    whole, key = strip(other), F.lower(strip(name))
    low = F.lower(whole)

    def repeats(text: Column, slack: int) -> Column:
        return (text == key) | (text.contains(key) & (F.length(text) < F.length(key) + slack))

    kept = F.filter(components(whole), lambda p: ~repeats(F.lower(p), list_slack))
    single = repeats(low, single_slack) | (
        ~low.contains(key) & key.contains(low) & (F.length(low) < F.length(key) + single_slack))
    return (
        F.when(other.isNull() | name.isNull(), other)
        .when(low == key, F.lit(None).cast("string"))
        .when(whole.contains(","), F.when(F.size(kept) > 0, F.array_join(kept, ", ")))
        .when(~single, whole)
    )


def drop_block(other_areas: Column, block: Column) -> Column:
    return drop_repeats(other_areas, block, list_slack=20)


def drop_village(other_locations: Column, village: Column) -> Column:
    return drop_repeats(other_locations, village, list_slack=10)


def mentioned(name: Column, text: Column) -> Column:
    """True when the text holds the name, case ignored; false when either is missing."""
    return F.coalesce(F.lower(text).contains(F.lower(name)), F.lit(False))


def join_places(*cols: Column) -> Column:
    """Comma list of the places present, null when there is none."""
    return F.nullif(F.concat_ws(", ", *[strip(c) for c in cols]), F.lit(""))


def distinct_places(*cols: Column) -> Column:
    """Ordered, distinct, lower-case list of places with bracketed remarks taken off."""
    items = F.array(*[without_parens(F.lower(strip(c))) for c in cols])
    return F.array_distinct(F.filter(items, lambda p: p.isNotNull() & (p != "")))


def place_list(*cols: Column) -> Column:
    return F.array_join(distinct_places(*cols), ", ")


def recommended_places(district: Column, village: Column, other_areas: Column, block: Column) -> Column:
    """Recommended ground truth: district, block, village, other areas, each place once.

    The block comes second unless an earlier place already has its name.
    """
    rest = F.array(F.lower(strip(village)), F.lower(strip(other_areas)))
    block_name = without_parens(F.lower(strip(block)))
    new_block = block_name.isNotNull() & (block_name != "") & ~F.coalesce(
        F.array_contains(F.array_compact(F.array_append(rest, F.lower(strip(district)))), block_name), F.lit(False))
    head = F.array_compact(F.array(F.lower(strip(district))))
    tail = F.array_compact(rest)
    ordered = F.when(
        new_block & (F.size(head) == 0) & (F.size(tail) > 0),
        F.concat(F.slice(tail, 1, 1), F.array(block_name), F.slice(tail, 2, 2)),
    ).when(new_block, F.concat(head, F.array(block_name), tail)).otherwise(F.concat(head, tail))
    return F.array_join(
        F.array_distinct(F.filter(F.transform(ordered, without_parens), lambda p: p != "")), ", ")


def in_list(value: Column, places: Column) -> Column:
    """True when a place equals the value, contains it, or lies within it."""
    v = F.lower(strip(value))
    return F.coalesce(F.exists(places, lambda p: p.contains(v) | v.contains(p)), F.lit(False))


def found_in_text(places: Column, text: Column) -> Column:
    low = F.lower(text)
    return F.filter(places, lambda p: low.contains(p))


def not_found_in_text(places: Column, text: Column) -> Column:
    low = F.lower(text)
    return F.filter(places, lambda p: ~low.contains(p))


def share_of(part: Column, whole: Column) -> Column:
    """Percentage of two array sizes, 0 for an empty whole."""
    return F.when(F.size(whole) > 0, F.size(part) * 100.0 / F.size(whole)).otherwise(F.lit(0.0))


def overlap(truth: Column, other: Column) -> Column:
    """Percentage of the truth set found in the other set, null for an empty truth set."""
    t = F.array_distinct(truth)
    return F.when(F.size(t) > 0, F.size(F.array_intersect(t, other)) * 100.0 / F.size(t))


def has_text(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def location_level(village: Column, block: Column, district: Column, state: Column) -> Column:
    """Most specific level that holds text."""
    return (
        F.when(has_text(village), "village").when(has_text(block), "block")
        .when(has_text(district), "district").when(has_text(state), "state").otherwise("unknown")
    )


def block_strategy(equals_village: Column, equals_district: Column, in_text: Column) -> Column:
    return (
        F.when(equals_village, "Block=Village").when(equals_district, "Block=District")
        .when(in_text, "Mentioned in Text").otherwise("Learned Pattern")
    )


def has_fine_place(parsed: Column) -> Column:
    """True when a parsed location names a village or another place."""
    return F.coalesce(parsed.village != "", F.lit(False)) | F.coalesce(parsed.other_locations != "", F.lit(False))


# ---- geocoder queries --------------------------------------------------------------------


def geocode_request(parsed: Column, strategy: str = "full") -> Column:
    """Struct (address, state_filter, district_filter) for a geocoder, null when there is nothing to look up.

    Strategies: ``full`` asks for village and other places, ``village_only`` leaves
    the other places out, ``comma_delimited`` lists every part and sets no filter.
    The first two fall back to the district, then the state, and filter by the
    levels above the one asked for.
    """
    part = {name: F.when(parsed.getField(name) != "", parsed.getField(name)) for name in LEVELS}
    none = F.lit(None).cast("string")
    if strategy == "comma_delimited":
        address, by_state, by_district = F.concat_ws(", ", *[part[name] for name in LEVELS]), none, none
    else:
        fine = [part["village"]] + ([part["other_locations"]] if strategy == "full" else [])
        has_fine = F.coalesce(*fine).isNotNull()
        address = F.when(has_fine, F.concat_ws(", ", *fine)).otherwise(F.coalesce(part["district"], part["state"]))
        by_state = F.when(has_fine | part["district"].isNotNull(), part["state"])
        by_district = F.when(has_fine, part["district"])
    request = F.struct(
        address.alias("address"), by_state.alias("state_filter"), by_district.alias("district_filter"))
    return F.when(F.coalesce(address != "", F.lit(False)), request)


def smart_query(
    district: Column, village: Column, other_areas: Column, state: Column, num_states: Column, rule: str = "auto",
) -> Column:
    """Struct (query, includes_state, is_ambiguous, confidence) of a place query.

    ``num_states`` is the number of states that have the district's name. Rules:
    always, never, auto (ambiguous names only), hybrid (very ambiguous names, or
    ambiguous ones without a finer place).
    """
    ambiguous = F.coalesce(num_states > 1, F.lit(False))
    include = {
        "always": F.lit(True),
        "never": F.lit(False),
        "auto": ambiguous,
        "hybrid": F.coalesce(num_states > 2, F.lit(False))
        | (ambiguous & ~has_text(village) & ~has_text(other_areas)),
    }[rule]
    place = F.coalesce(blank_to_null(village), blank_to_null(other_areas))
    area = blank_to_null(district)
    area = F.when(F.lower(area).contains("district"), area).otherwise(F.concat(area, F.lit(" district")))
    query = F.concat_ws(", ", place, area, F.when(include, blank_to_null(state)), F.lit("India"))
    return F.struct(
        query.alias("query"), include.alias("includes_state"), ambiguous.alias("is_ambiguous"),
        F.when(~ambiguous | include, "high").otherwise("medium").alias("confidence"),
    )


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
