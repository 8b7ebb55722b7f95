"""The five table jobs, each DataFrame in and DataFrame out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from incidentry.functions import counts, geo, labels, places, probability
from incidentry.functions.text import integer_id
from incidentry.operators import entities, match
from incidentry.operators.wrangle import since
from incidentry.session import durable, spread
from incidentry.sources.pages import incidents


def ingest_pages(pages: DataFrame) -> DataFrame:
    """Page table (series, year, month, html) to incident rows."""
    return incidents(pages)


LOCATION_COLUMNS = ("incident_number", "date", "state", "district", "village_name", "other_locations",
                    "latitude", "longitude", "incident_summary")


def clean_locations(coded: DataFrame, sentinel: str = "99", first_date: str = "2005-01-01") -> DataFrame:
    """Coded incidents to the augmented location table.

    Blocks count only when the summary names them; repeats of the block and then
    of the village leave the other areas; block and other areas merge; rows with
    the sentinel district, without a date or before ``first_date`` go.
    """
    block = F.when(places.mentioned(F.col("block"), F.col("incident_summary")), F.col("block"))
    out = coded.withColumn("block", block)
    out = out.withColumn("_areas", places.drop_block(F.col("other_areas"), F.col("block")))
    out = out.withColumn("other_locations", places.join_places(F.col("block"), F.col("_areas")))
    out = out.withColumn("other_locations", places.drop_village(F.col("other_locations"), F.col("village_name")))
    out = out.filter(F.coalesce(F.col("district") != sentinel, F.lit(True)))
    return since(out, "date", first_date).select(*LOCATION_COLUMNS)


def type_predictions(raw: DataFrame, task: str, column: str = "raw_output", classes: list[str] | None = None) -> DataFrame:
    """Raw model output to a typed ``prediction`` column.

    Tasks: count, fatalities, regression, five_counts, single_label, location, location_json.
    """
    c = F.col(column)
    parsers = {
        "count": lambda: counts.prediction_count(c),
        "regression": lambda: counts.prediction_count(c, "regression"),
        "fatalities": lambda: counts.fatalities(c),
        "five_counts": lambda: counts.five_counts(c),
        "single_label": lambda: labels.single_label(c, classes or labels.PERPETRATORS),
        "location": lambda: places.build_from(places.parse_answer(c)),
        "location_json": lambda: places.json_to_structured(c),
    }
    out = raw.withColumn("prediction", parsers[task]())
    return out.filter(counts.readable_five(F.col("prediction"))) if task == "five_counts" else out


def type_label_sets(raw: DataFrame, key: str, label_map: dict[str, str], column: str = "raw_output",
                    threshold: float = 0.5) -> DataFrame:
    """Comma answers to one 0/1 column per label, unknown words going to the most similar name.

    Every row is kept. Distinct words are matched, not rows: the words of all
    answers are reduced to a set before the similarity is computed.
    """
    from incidentry.functions.similarity import closest_label

    names = sorted(set(label_map.values()))
    words = raw.select(key, F.explode(labels.label_parts(F.col(column))).alias("word"))
    table = F.create_map(*[F.lit(x) for pair in label_map.items() for x in pair])
    known = words.withColumn("label", F.try_element_at(table, F.col("word")))
    guess = closest_label(list(label_map), threshold)
    unknown = known.filter("label is null").select("word").distinct().withColumn(
        "_guess", F.try_element_at(table, guess("word")))
    solved = known.join(unknown, "word", "left").withColumn("label", F.coalesce("label", "_guess")).filter("label is not null")
    flags = solved.groupBy(key).agg(*[F.max((F.col("label") == n).cast("int")).alias(n) for n in names])
    return raw.join(flags, key, "left").na.fill(0, names)


def apply_scorer(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], outputs: str,
                 batch_rows: int = 2_000) -> DataFrame:
    """Named outputs of a user's scorer added as columns.

    The scorer gets batches of rows and returns as many rows of ``outputs`` (a DDL
    string). It runs inside the tasks; none is shipped here.
    """
    added = StructType.fromDDL(outputs)
    schema = StructType(df.schema.fields + added.fields)
    names = added.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), batch_rows):
                part = pdf.iloc[s : s + batch_rows].reset_index(drop=True)
                made = scorer(part)[names].reset_index(drop=True)
                yield pd.concat([part, made], axis=1)

    return df.mapInPandas(run, schema)


def locate(structured: DataFrame, gazetteer: DataFrame, key: str = "incident_number", column: str = "prediction",
           max_dist: float = 0.4) -> DataFrame:
    """Structured locations to the closest gazetteer place: names, id, distances of the names, coordinates if it has them."""
    parsed = spread(structured, key).withColumn("_p", places.parse_structured(F.col(column)))
    # Parsed once, over all partitions; the match reads the names several times.
    names = durable(parsed.select(
        key, F.lower("_p.state").alias("state_name"), F.lower("_p.district").alias("district_name"),
        F.lower("_p.village").alias("village_name")))
    found = match.best_gazetteer_match(names, gazetteer, key, "gaz_id", max_dist)
    extra = [c for c in ("latitude", "longitude") if c in gazetteer.columns]
    return found.join(gazetteer.select("gaz_id", *extra), "gaz_id", "left") if extra else found


def flatten_geocodes(responses: DataFrame, key: str = "incident_number", column: str = "response", **how) -> DataFrame:
    """Geocoder responses to one row of place columns each; unusable responses give nulls."""
    return responses.withColumn("_g", geo.flatten_response(F.col(column), **how)).select(
        key, *[F.col(f"_g.{x}").alias(x) for x in (
            "state", "district", "subdistrict", "town_village", "latitude", "longitude", "level")])


def with_distances(geocoded: DataFrame, manual: DataFrame, key: str = "incident_number") -> DataFrame:
    """Geocoded rows beside the manual coordinates of the same id as text, with the distance in km."""
    left = geocoded.withColumn("_id", F.coalesce(integer_id(F.col(key)), F.col(key).cast("string")))
    right = manual.select(
        F.coalesce(integer_id(F.col(key)), F.col(key).cast("string")).alias("_id"),
        F.col("latitude").cast("string").try_cast("double").alias("manual_latitude"),
        F.col("longitude").cast("string").try_cast("double").alias("manual_longitude"))
    return left.join(right, "_id", "left").drop("_id").withColumn("distance_km", geo.haversine(
        F.col("latitude"), F.col("longitude"), F.col("manual_latitude"), F.col("manual_longitude")))


def fuse_states(preds: DataFrame, state_ids: list[str], conditional: DataFrame, alpha: float = 1.0, beta: float = 1.0,
                floor: float = 0.5, temperature: float = 1.0) -> DataFrame:
    """Fills blank states of parsed predictions from class logits and P(state | district).

    ``preds`` has parsed (struct) and logits (array in the order of ``state_ids``);
    ``conditional`` has district, state, p. Given states are kept.
    """
    prior = conditional.groupBy("district").agg(
        F.map_from_entries(F.collect_list(F.struct("state", "p"))).alias("_ps"))  # one entry per state
    joined = preds.withColumn("_d", F.trim("parsed.district")).join(
        prior.withColumnRenamed("district", "_d"), "_d", "left")
    aligned = F.transform(
        F.array(*[F.lit(s) for s in state_ids]), lambda s: F.coalesce(F.try_element_at("_ps", s), F.lit(1e-12)))
    mixed = probability.fuse(
        probability.softmax(F.col("logits"), temperature), F.when(F.col("_ps").isNotNull(), aligned), alpha, beta)
    guess = probability.confident_label(mixed, state_ids, floor)
    given = F.coalesce(F.trim("parsed.state") != "", F.lit(False))
    state = F.when(given, F.col("parsed.state")).otherwise(F.coalesce(guess, F.col("parsed.state")))
    return joined.withColumn("parsed", F.col("parsed").withField("state", state)).drop("_d", "_ps")


def build_training_tables(df: DataFrame, id_col: str = "incident_number", text: str = "incident_summary") -> dict[str, DataFrame]:
    """Span, token-tag and question-answer tables of coded incidents."""
    ner = entities.entity_dataset(df, id_col, text)
    spans = ner.select(F.col(f"metadata.{id_col}").alias(id_col), "text", "entities")
    out = {"spans": ner, "tokens": entities.token_table(spans, id_col)}
    if "total_fatalities" in df.columns:
        found = counts.answer_span(F.col(text), F.col("total_fatalities"))
        out["answers"] = df.select(id_col, F.col(text).alias("context"), found.alias("answer"))
    return out
