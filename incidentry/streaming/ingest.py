"""Incremental ingest of page files, raw-to-processed movement, continuous counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from incidentry.functions.text import strip
from incidentry.session import durable
from incidentry.sources.pages import incidents
from incidentry.sources.tables import sheet_values

PAGE_SCHEMA = "series string, year string, month string, html string"


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of newly arrived page files (Parquet)."""
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def earlier_batches(spark: SparkSession, path: str, batch_id: int, cols: str) -> DataFrame:
    """What batches before this one wrote. The partition filter keeps a replay from seeing its own rows."""
    schema = f"{cols}, batch_id bigint"
    try:
        return spark.read.schema(schema).parquet(path).filter(F.col("batch_id") < batch_id)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # nothing written yet
            return spark.createDataFrame([], schema)
        raise


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """The batch's own folder is replaced, so a batch that runs again leaves one copy."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def append_unseen(key: str, path: str, within: str | None = None):
    """foreachBatch writer: rows whose key no earlier batch wrote.

    All rows of a key that is new in the batch stay. A missing key is stored as '' and is a key like any other.

    ``within`` names a text column that the key fixes, such as the date of an incident
    number. Only stored rows within the batch's range of it can hold the same key, so
    the file statistics rule most of a long history out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = sheet_values(batch)  # compared as it is stored
        if within is None:
            seen = earlier_batches(spark, path, batch_id, f"`{key}` string").select(key)
        else:
            batch = durable(batch)  # read twice: once for the range, once to write
            low, high = batch.agg(F.min(within), F.max(within)).first()
            seen = earlier_batches(spark, path, batch_id, f"`{key}` string, `{within}` string").filter(
                F.col(within).between(low, high)).select(key)
        write_batch(batch.join(seen.distinct(), key, "left_anti").select(*batch.columns), path, batch_id)

    return write


def ingest_pages(pages: DataFrame, target: str, checkpoint: str, key: str = "Incident_ID",
                 available_now: bool = True) -> StreamingQuery:
    """Incidents of arriving pages appended once each.

    Parsing and numbering are per page and stateless; the sink itself is the memory
    of the keys, so the state store stays empty however long the stream runs.
    """
    writer = incidents(pages).writeStream.foreachBatch(
        append_unseen(key, target, within="Date")).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def move_batches(processed: DataFrame, target: str, checkpoint: str, key: str = "Incident_Number") -> StreamingQuery:
    """Processed rows into the processed zone, once per key; the raw zone is what is left (:func:`raw_left`)."""
    trimmed = processed.withColumn(key, strip(F.col(key).cast("string")))
    return trimmed.writeStream.foreachBatch(append_unseen(key, target)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def raw_left(raw: DataFrame, processed: DataFrame, key: str = "Incident_Number") -> DataFrame:
    from incidentry.sources.tables import remaining

    return remaining(raw, processed, key)


def daily_counts(events: DataFrame, ts: str, measures: list[str], delay: str = "2 days", group: str | None = None) -> DataFrame:
    """Daily row counts and sums of a stream with a watermark; also runs on a batch table."""
    keys = [F.window(ts, "1 day").alias("_w")] + ([F.col(group)] if group else [])
    out = events.withWatermark(ts, delay).groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.sum(m).alias(f"sum_{m}") for m in measures])
    return out.select(F.to_date("_w.start").alias("day"), *([group] if group else []), "n", *[f"sum_{m}" for m in measures])
