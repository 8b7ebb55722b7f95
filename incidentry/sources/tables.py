"""CSV, Parquet and key-based sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from incidentry.functions.text import strip
from incidentry.operators.report import dashboard_rows

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None, as_text: bool = False) -> DataFrame:
    """CSV with quoted commas and line ends. Typed by a schema; all text with ``as_text``; else inferred."""
    reader = spark.read.options(**CSV_OPTIONS)
    if schema is not None:
        return reader.schema(schema).csv(path)
    if as_text:
        names = reader.csv(path).columns
        return reader.schema(StructType([StructField(n, StringType()) for n in names])).csv(path)
    return reader.option("inferSchema", "true").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; one file per task."""
    df.write.mode(mode).options(header="true", quote='"', escape='"').csv(path)


def read_sheet(spark: SparkSession, path: str, date: str = "Date") -> DataFrame:
    """Published incident table with typed date, year and month."""
    return dashboard_rows(read_csv(spark, path, as_text=True), date)


def sheet_values(df: DataFrame) -> DataFrame:
    """Values a sheet can hold: infinities and not-a-number become null, missing text becomes ''."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)):
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            c = F.when(~bad, c)
        elif isinstance(f.dataType, StringType):
            c = F.coalesce(c, F.lit(""))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def unseen(incoming: DataFrame, existing: DataFrame | None, key: str) -> DataFrame:
    """Rows to append: all of them to an empty or missing table, none when a side lacks the key, else the new keys.

    Every incoming row of a new key stays, however often the key comes. A null key is a key like any other.
    """
    if existing is None or not existing.columns:
        return incoming
    if key not in existing.columns or key not in incoming.columns:
        if existing.limit(1).count() == 0 and key in incoming.columns:
            return incoming
        return incoming.limit(0)
    seen = existing.select(F.col(key).alias("_seen")).distinct()
    return incoming.join(seen, F.col(key).eqNullSafe(F.col("_seen")), "left_anti").select(*incoming.columns)


def append_new(incoming: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows of unseen keys to a Parquet table and return them; running it again appends nothing."""
    from incidentry.session import durable

    # Sanitised first, as stored keys are: a missing text key is ''.
    fresh = durable(unseen(sheet_values(incoming), read_if_there(incoming.sparkSession, path), key))
    fresh.write.mode("append").parquet(path)  # the target changes here, so the rows were fixed before
    return fresh


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """Parquet table, or null when its folder is not there. Any other failure is raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def remaining(raw: DataFrame, done: DataFrame, key: str = "Incident_Number") -> DataFrame:
    """Raw rows whose trimmed key is not among the processed ones; the key comes back trimmed text."""
    trimmed = raw.withColumn(key, strip(F.col(key).cast("string")))
    return trimmed.join(done.select(strip(F.col(key).cast("string")).alias(key)), key, "left_anti").select(*raw.columns)


def move_processed(processed: DataFrame, raw: DataFrame, processed_path: str, raw_next_path: str,
                   key: str = "Incident_Number") -> DataFrame:
    """Append processed rows, then write what is left of the raw zone to a new path (never over the one read)."""
    append_new(processed, processed_path, key)
    left = remaining(raw, processed, key)
    left.write.mode("errorifexists").parquet(raw_next_path)
    return left


def pending(work: DataFrame, results: DataFrame | None, keys: list[str]) -> DataFrame:
    """Work rows without a saved result."""
    return work if results is None else work.join(results.select(*keys), keys, "left_anti")
