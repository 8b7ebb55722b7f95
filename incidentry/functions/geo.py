"""Distances and geocoder responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km, null when a coordinate is missing."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp = F.sin((p2 - p1) / 2)
    dl = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = dp * dp + F.cos(p1) * F.cos(p2) * dl * dl
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


RESPONSE_SCHEMA = (
    "status string, results array<struct<"
    "address_components:array<struct<long_name:string,types:array<string>>>,"
    "geometry:struct<location:struct<lat:double,lng:double>>>>"
)

# Output level to the response type that carries it, most specific first.
LEVEL_TYPES = {
    "subdistrict": "administrative_area_level_3",
    "district": "administrative_area_level_2",
    "state": "administrative_area_level_1",
}


def flatten_response(response: Column, with_state_level: bool = True, first_only: bool = False) -> Column:
    """Struct of the most specific place in a geocoder response.

    Fields: state, district, subdistrict, town_village, latitude, longitude, level.
    Among results of equal level the earlier one counts. ``with_state_level=False``
    ignores results that name a state only; ``first_only`` looks at the first result alone.
    """
    doc = F.from_json(response, RESPONSE_SCHEMA)
    results = F.when(doc.status == "OK", doc.results)
    if first_only:
        results = F.slice(results, 1, 1)

    def last_named(parts: Column, kind: str, barred: list[str]) -> Column:
        # A component counts for the first type in the list it carries.
        named = F.filter(
            parts,
            lambda p: F.array_contains(p.types, kind) & ~F.arrays_overlap(
                p.types, F.array(*[F.lit(b) for b in barred]).cast("array<string>")),
        )
        return F.try_element_at(named, F.lit(-1)).long_name

    def town(parts: Column) -> Column:
        areas = [LEVEL_TYPES["state"], LEVEL_TYPES["district"], LEVEL_TYPES["subdistrict"]]
        locality = last_named(parts, "locality", areas)
        sub = F.filter(
            parts,
            lambda p: F.array_contains(p.types, "sublocality") & ~F.arrays_overlap(
                p.types, F.array(*[F.lit(b) for b in [*areas, "locality"]])),
        )
        return F.coalesce(F.nullif(locality, F.lit("")), F.try_element_at(sub, F.lit(1)).long_name)

    def describe(r: Column, pos: Column) -> Column:
        parts = r.address_components
        t = town(parts)
        sd = last_named(parts, LEVEL_TYPES["subdistrict"], [LEVEL_TYPES["state"], LEVEL_TYPES["district"]])
        d = last_named(parts, LEVEL_TYPES["district"], [LEVEL_TYPES["state"]])
        s = last_named(parts, LEVEL_TYPES["state"], [])

        def there(c: Column) -> Column:
            return F.coalesce(c != "", F.lit(False))

        rank = F.when(there(t), 0).when(there(sd), 1).when(there(d), 2)
        if with_state_level:
            rank = rank.when(there(s), 3)
        return F.struct(
            rank.alias("rank"), pos.alias("pos"), s.alias("state"),
            F.when(rank < 3, d).alias("district"),
            F.when(rank < 2, sd).alias("subdistrict"),
            F.when(rank < 1, t).alias("town_village"),
            r.geometry.location.lat.alias("latitude"),
            r.geometry.location.lng.alias("longitude"),
            F.element_at(
                F.array(*[F.lit(x) for x in ("town_village", "subdistrict", "district", "state")]), rank + 1,
            ).alias("level"),
        )

    ranked = F.filter(F.transform(results, describe), lambda x: x["rank"].isNotNull())
    return F.array_min(ranked)
