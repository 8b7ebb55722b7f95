"""Metrics documents and nested gazetteers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS_SCHEMA = (
    "overall map<string,double>, bins map<string,map<string,double>>, levels map<string,map<string,double>>, "
    "per_label map<string,map<string,double>>, timing map<string,double>, "
    "micro_f1 double, macro_f1 double, weighted_f1 double"
)
GAZETTEER_SCHEMA = "map<string,map<string,map<string,struct<Latitude:string,Longitude:string>>>>"


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics documents with the file name as ``model``."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:_metrics)?\.json$", 1)
    return spark.read.schema(METRICS_SCHEMA).option("multiLine", "true").json(path).withColumn("model", name)


def metric_rows(docs: DataFrame, model: str = "model") -> DataFrame:
    """(model, section, part, metric, value) of every number in a metrics document."""
    flat = F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(None).cast("string").alias("part"), F.col(s).alias("m"))
        for s in ("overall", "timing") if s in docs.columns])
    top = [c for c in ("micro_f1", "macro_f1", "weighted_f1") if c in docs.columns]
    parts = [docs.select(model, F.inline(flat)).select(model, "section", "part", F.explode("m").alias("metric", "value"))]
    for s in ("bins", "levels", "per_label"):
        if s in docs.columns:
            parts.append(docs.select(model, F.lit(s).alias("section"), F.explode(s).alias("part", "m")).select(
                model, "section", "part", F.explode("m").alias("metric", "value")))
    if top:
        parts.append(docs.select(model, F.inline(F.array(*[
            F.struct(F.lit("overall").alias("section"), F.lit(None).cast("string").alias("part"),
                     F.lit(c).alias("metric"), F.col(c).alias("value")) for c in top]))).filter("value is not null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flat_name(part: Column, metric: Column) -> Column:
    """Wide column name of a metric: part and metric joined, the metric alone for overall numbers."""
    return F.concat_ws("_", part, metric)


def metrics_document(overall: DataFrame, parts: DataFrame, model: str, part: str, section: str) -> DataFrame:
    """(model, document): nested JSON of one overall row and several part rows per model."""
    o = [c for c in overall.columns if c != model]
    p = [c for c in parts.columns if c not in (model, part)]
    nested = parts.groupBy(model).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(part, F.struct(*p))))).alias(section))
    joined = overall.select(model, F.struct(*o).alias("overall")).join(nested, model, "left")
    return joined.select(model, F.to_json(F.struct("overall", section)).alias("document"))


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per line."""
    df.write.mode(mode).json(path)


def flat_gazetteer(df: DataFrame, doc: str) -> DataFrame:
    """(state, district, village, latitude, longitude) of nested gazetteer documents."""
    g = df.select(F.from_json(F.col(doc), GAZETTEER_SCHEMA).alias("g"))
    s = g.select(F.explode("g").alias("state", "d"))
    d = s.select("state", F.explode("d").alias("district", "v"))
    v = d.select("state", "district", F.explode("v").alias("village", "p"))
    return v.select("state", "district", "village", F.col("p.Latitude").alias("latitude"), F.col("p.Longitude").alias("longitude"))
