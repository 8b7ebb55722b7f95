"""Indicator recodes of hand-coded category columns, with their null rules stated per function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Indicator name to the coded action it stands for.
ACTIONS = {
    "armed_assault": "Armed Assault",
    "arrest": "Arrest",
    "bombing": "Bombing",
    "infrastructure": "Facility/Infrastructure Attack",
    "surrender": "Surrender",
    "seizure": "Seizure of Money, Weapons, Property etc",
    "abduction": "Hijacking/Kidnapping",
}

# Indicator name to the coded target, matched whole.
TARGETS = {
    "civilians": "Civilians",
    "maoist": "Maoist",
    "government_officials": "Government Officials",
    "security": "Security",
    "private_property": "Private Property",
    "mining_company": "Mining Company",
    "ngos": "NGOs",
}

# Child labels of each parent label.
TARGET_PARENTS = {
    "human_targets": ("civilians", "government_officials", "security"),
    "property_targets": ("private_property", "government_infrastructure"),
    "organizational_targets": ("mining_company", "ngos"),
    "armed_groups": ("maoist", "non_maoist_armed_group"),
    "other": ("no_target",),
}


def any_equals(value: str, *cols: str) -> Column:
    """1 when a column holds ``value``, else 0. A null never matches and never makes the result null."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.col(c).eqNullSafe(value)
    return hit.cast("int")


def any_matches(pattern: str, *cols: str) -> Column:
    """1/0 by regex over the columns, null when a null column leaves the answer open."""
    hit = F.col(cols[0]).rlike(pattern)
    for c in cols[1:]:
        hit = hit | F.col(c).rlike(pattern)
    return hit.cast("int")


def any_matches_known(pattern: str, *cols: str) -> Column:
    """1/0 by regex over the columns, a null counting as no match."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return hit.cast("int")


def action_flags(first: str = "first_action", second: str = "second_action", third: str = "third_action"):
    return {name: any_equals(value, first, second, third) for name, value in ACTIONS.items()}


def target_flags(first: str = "first_target", second: str = "second_target"):
    """Target indicators; the three pattern-based ones may be null."""
    flags = {name: any_equals(value, first, second) for name, value in TARGETS.items()}
    flags["government_infrastructure"] = any_matches(
        "Government Infrastructure|Government Property", first, second)
    flags["non_maoist_armed_group"] = any_matches("(?i)Non-Maoist armed group", first, second)
    flags["no_target"] = any_matches("No Target|Unknown|None", first)
    return flags


def civilian_flags(
    first: str = "first_civilian_target",
    second: str = "second_civilian_target",
    second_target: str = "second_target",
    strict_reference: bool = False,
):
    """Civilian-target indicators.

    ``strict_reference`` tests ``second_target`` in the last indicator when
    ``second_civilian_target`` is present, as the hand-coded table was built;
    the default tests the civilian column itself.
    """
    flags = {
        "former_maoist": any_equals("Former Maoist", first, second),
        "high_caste_landowner": any_matches_known(r"(?i)High Caste[/\\]Landowner", first, second),
        "police_informer": any_matches_known("Police? Informer", first, second),
        "businessman": any_equals("Businessman", first, second),
        "aspiring_politician": any_matches_known("Aspiring Politician", first, second),
        "other_elite": any_equals("Other Elite", first, second),
    }
    if strict_reference:
        by_second = F.col(second).isNotNull() & F.col(second_target).rlike("Other")
        hit = (F.col(first).isNotNull() & F.col(first).rlike("Other")) | by_second
        flags["other_civilian"] = hit.cast("int")
    else:
        flags["other_civilian"] = any_matches_known("Other", first, second)
    return flags


def yes_no(c: Column) -> Column:
    """Yes/No to 1/0, anything else to null."""
    return F.when(c == "Yes", 1).when(c == "No", 0)


def is_yes(c: Column) -> Column:
    """1 for Yes, 0 for any other value, null stays null."""
    return (c == "Yes").cast("int")


def parent_labels(available: list[str], parents=None) -> dict[str, Column]:
    """Parent indicators: the largest of the children that are there."""
    out = {}
    for parent, children in (parents or TARGET_PARENTS).items():
        present = [F.col(c) for c in children if c in available]
        if present:
            out[parent] = present[0] if len(present) == 1 else F.greatest(*present)
    return out


def above(prob: Column, threshold: float = 0.5) -> Column:
    """Strictly above the default cut; tuned cuts use :func:`at_least`."""
    return (prob > threshold).cast("int")


def at_least(prob: Column, threshold) -> Column:
    return (prob >= threshold).cast("int")


def clear_exclusive(flag: Column, others: list[Column]) -> Column:
    """An exclusive label is cleared when another label is set."""
    return F.when(F.greatest(*others, F.lit(0)) == 1, 0).otherwise(flag)


def argmax_label(values: Column, labels: list[str], default: str = "Unknown") -> Column:
    """Label at the first maximum of an array, with a default when there is none."""
    pos = F.array_position(values, F.array_max(values)).cast("int")
    table = F.array(*[F.lit(x) for x in labels])
    return F.coalesce(F.when(pos > 0, F.try_element_at(table, pos)), F.lit(default))


def zero_pattern(cols: list[str]) -> Column:
    """Stratum name: 'zero' or 'non-zero' per count column, joined by underscores."""
    return F.concat_ws("_", *[F.when(F.col(c) == 0, "zero").otherwise("non-zero") for c in cols])
