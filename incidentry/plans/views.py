"""Working tables derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.plans.catalog import table

INCIDENTS_SQL = """incidents AS (
  SELECT o_orderkey AS incident_number,
         CASE WHEN c_acctbal >= 0 THEN n_name END AS state,
         r_name AS region,
         CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
         CAST(floor(o_totalprice) AS BIGINT) % 10 AS total_fatalities,
         CAST(floor(o_totalprice / 10) AS BIGINT) % 10 AS total_injuries,
         o_orderkey % 3 AS total_abducted,
         (o_orderkey * 7) % 5 AS total_arrests,
         o_custkey % 4 AS total_surrenders,
         o_orderpriority AS priority, o_orderstatus AS status, c_mktsegment AS segment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey)"""


def incidents(spark, d: str) -> DataFrame:
    """Orders as incidents: nation as state (null for customers in debt), some undated rows, five counts."""
    price = F.col("o_totalprice")
    return (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_orderkey").alias("incident_number"),
            F.when(F.col("c_acctbal") >= 0, F.col("n_name")).alias("state"),
            F.col("r_name").alias("region"),
            F.when(~((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 7 == 0)), F.to_date("o_orderdate")).alias("date"),
            (F.floor(price) % 10).alias("total_fatalities"),
            (F.floor(price / 10) % 10).alias("total_injuries"),
            (F.col("o_orderkey") % 3).alias("total_abducted"),
            (F.col("o_orderkey") * 7 % 5).alias("total_arrests"),
            (F.col("o_custkey") % 4).alias("total_surrenders"),
            F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
            F.col("c_mktsegment").alias("segment"),
        )
    )


CODED_SQL = """coded AS (
  SELECT o_orderkey AS incident_number,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Armed Assault' WHEN '2-HIGH' THEN 'Bombing'
              WHEN '3-MEDIUM' THEN 'Arrest' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'Surrender' END AS first_action,
         CASE o_orderstatus WHEN 'F' THEN 'Hijacking/Kidnapping' WHEN 'P' THEN 'Arrest' END AS second_action,
         CASE WHEN o_orderkey % 5 = 0 THEN 'Seizure of Money, Weapons, Property etc'
              WHEN o_orderkey % 5 = 1 THEN 'Facility/Infrastructure Attack' END AS third_action,
         CASE o_orderkey % 8 WHEN 0 THEN 'Civilians' WHEN 1 THEN 'Maoist' WHEN 2 THEN 'Government Infrastructure'
              WHEN 3 THEN 'Non-Maoist Armed Group' WHEN 4 THEN 'No Target' WHEN 5 THEN 'Security'
              WHEN 6 THEN 'NGOs' END AS first_target,
         CASE o_custkey % 7 WHEN 0 THEN 'Government Property' WHEN 1 THEN 'Security' WHEN 2 THEN 'Mining Company'
              WHEN 3 THEN 'Other NGOs' WHEN 4 THEN 'Private Property' END AS second_target,
         CASE o_orderkey % 11 WHEN 0 THEN 'Polic Informer' WHEN 1 THEN 'High Caste\\Landowner' WHEN 2 THEN 'high caste/landowner'
              WHEN 3 THEN 'Other' WHEN 4 THEN 'Businessman' WHEN 5 THEN 'Former Maoist' END AS first_civilian_target,
         CASE o_custkey % 5 WHEN 0 THEN 'Other Civilian' WHEN 1 THEN 'Aspiring Politicians' WHEN 2 THEN 'Other Elite' END
              AS second_civilian_target,
         CASE o_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Unknown' END AS action_successful,
         CASE o_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS property_damage
  FROM orders)"""


def coded(spark, d: str) -> DataFrame:
    """Orders as hand-coded incidents with category columns, nulls and spelling variants."""

    def case(by, values: dict, other=None):
        out = None
        for k, v in values.items():
            out = F.when(by == k, v) if out is None else out.when(by == k, v)
        return out if other is None else out.otherwise(other)

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        k.alias("incident_number"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", None).otherwise(
            case(F.col("o_orderpriority"), {"1-URGENT": "Armed Assault", "2-HIGH": "Bombing", "3-MEDIUM": "Arrest"},
                 "Surrender")).alias("first_action"),
        case(F.col("o_orderstatus"), {"F": "Hijacking/Kidnapping", "P": "Arrest"}).alias("second_action"),
        case(k % 5, {0: "Seizure of Money, Weapons, Property etc", 1: "Facility/Infrastructure Attack"}).alias("third_action"),
        case(k % 8, {0: "Civilians", 1: "Maoist", 2: "Government Infrastructure", 3: "Non-Maoist Armed Group",
                     4: "No Target", 5: "Security", 6: "NGOs"}).alias("first_target"),
        case(c % 7, {0: "Government Property", 1: "Security", 2: "Mining Company", 3: "Other NGOs",
                     4: "Private Property"}).alias("second_target"),
        case(k % 11, {0: "Polic Informer", 1: "High Caste\\Landowner", 2: "high caste/landowner", 3: "Other",
                      4: "Businessman", 5: "Former Maoist"}).alias("first_civilian_target"),
        case(c % 5, {0: "Other Civilian", 1: "Aspiring Politicians", 2: "Other Elite"}).alias("second_civilian_target"),
        case(c % 3, {0: "Yes", 1: "No"}, "Unknown").alias("action_successful"),
        case(k % 3, {0: "Yes", 1: "No"}).alias("property_damage"),
    )


# Two models scored on the labelled documents; the score is a fixed function of the document.
SCORED_SQL = """scored AS (
  SELECT l.doc_id AS row_id, m.model, x.label,
         CASE x.label WHEN 'quality' THEN l.quality ELSE l.toxic END AS truth,
         ((d.n_chars * m.a + l.doc_id * m.b + CASE x.label WHEN 'quality' THEN 0 ELSE 37 END) % 100) / 100.0 * 0.7
           + CASE WHEN (CASE x.label WHEN 'quality' THEN l.quality ELSE l.toxic END) = 1 THEN 0.3 ELSE 0.0 END AS prob
  FROM labels l JOIN documents d USING (doc_id),
       (VALUES ('base', 7, 13), ('large', 11, 3)) AS m(model, a, b),
       (VALUES ('quality'), ('toxic')) AS x(label)),
long AS (SELECT *, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred FROM scored)"""


def scored(spark, d: str) -> DataFrame:
    """(row_id, model, label, truth, prob, pred) of two models on the labelled documents."""
    base = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")

    def one(model: str, a: int, b: int, label: str, shift: int):
        truth = F.col(label)
        noise = ((F.col("n_chars") * a + F.col("doc_id") * b + shift) % 100) / 100.0
        prob = noise * 0.7 + F.when(truth == 1, 0.3).otherwise(0.0)
        return F.struct(F.lit(model).alias("model"), F.lit(label).alias("label"), truth.alias("truth"), prob.alias("prob"))

    rows = F.array(*[one(m, a, b, x, s) for m, a, b in (("base", 7, 13), ("large", 11, 3))
                     for x, s in (("quality", 0), ("toxic", 37))])
    out = base.select(F.col("doc_id").alias("row_id"), F.inline(rows))
    return out.withColumn("pred", (F.col("prob") > 0.5).cast("int"))


# A class per document against a rule that errs on some of them.
CLASSED_SQL = """classed AS (
  SELECT doc_id AS row_id, lang AS true_label,
         CASE WHEN doc_id % 9 = 0 THEN 'en' WHEN n_chars % 13 = 0 THEN 'und' ELSE lang END AS pred_label,
         source AS model
  FROM documents)"""


def classed(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("true_label"),
        F.when(F.col("doc_id") % 9 == 0, "en").when(F.col("n_chars") % 13 == 0, "und").otherwise(F.col("lang"))
        .alias("pred_label"), F.col("source").alias("model"))


# Lines per order against two perturbed counts.
COUNTED_SQL = """counted AS (
  SELECT o_orderkey AS incident_number, o_orderpriority AS priority, CAST(count(l_orderkey) AS BIGINT) AS true_label,
         greatest(CAST(count(l_orderkey) AS BIGINT) + (o_orderkey % 5) // 3 - (o_orderkey % 7) // 5, 0) AS prediction,
         greatest(CAST(count(l_orderkey) AS BIGINT) + (o_orderkey % 11) // 8, 0) AS baseline
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority)"""


def counted(spark, d: str) -> DataFrame:
    """(incident_number, priority, true_label, prediction, baseline): line counts of orders, and two guesses."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k, n = F.col("o_orderkey"), F.coalesce("n", F.lit(0))
    zero = F.lit(0).cast("bigint")
    return o.select(
        k.alias("incident_number"), F.col("o_orderpriority").alias("priority"), n.alias("true_label"),
        F.greatest(n + F.floor(k % 5 / 3) - F.floor(k % 7 / 5), zero).alias("prediction"),
        F.greatest(n + F.floor(k % 11 / 8), zero).alias("baseline"))


# Structured locations of customers, and a model that misses some parts.
LOCATED_SQL = """located AS (
  SELECT c_custkey AS incident_number, r_name AS region,
         concat_ws(', ', 'state: ' || r_name, 'district: ' || n_name,
                   CASE WHEN c_custkey % 4 <> 0 THEN 'village: ' || c_mktsegment END,
                   CASE WHEN c_custkey % 3 = 0 THEN 'other_locations: ' || lower(c_mktsegment) END) AS ground_truth,
         concat_ws(', ', 'state: ' || CASE WHEN c_custkey % 5 = 0 THEN lower(r_name) ELSE r_name END,
                   CASE WHEN c_custkey % 7 <> 0 THEN 'district: ' || n_name END,
                   CASE WHEN c_custkey % 11 = 0 THEN 'village: ' || c_mktsegment || 'X'
                        WHEN c_custkey % 4 <> 0 THEN 'village: ' || c_mktsegment END,
                   CASE WHEN c_custkey % 6 = 0 THEN 'other_locations: ' || lower(c_mktsegment) END) AS prediction
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def located(spark, d: str) -> DataFrame:
    """(incident_number, region, ground_truth, prediction) as structured location strings."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    c = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def lab(name, col):
        return F.concat(F.lit(f"{name}: "), col)

    return c.select(
        k.alias("incident_number"), F.col("r_name").alias("region"),
        F.concat_ws(", ", lab("state", F.col("r_name")), lab("district", F.col("n_name")),
                    F.when(k % 4 != 0, lab("village", seg)),
                    F.when(k % 3 == 0, lab("other_locations", F.lower(seg)))).alias("ground_truth"),
        F.concat_ws(", ", lab("state", F.when(k % 5 == 0, F.lower("r_name")).otherwise(F.col("r_name"))),
                    F.when(k % 7 != 0, lab("district", F.col("n_name"))),
                    F.when(k % 11 == 0, lab("village", F.concat(seg, F.lit("X")))).when(k % 4 != 0, lab("village", seg)),
                    F.when(k % 6 == 0, lab("other_locations", F.lower(seg)))).alias("prediction"))


# Place columns of the coded location table, made from parts.
PLACES_SQL = """places AS (
  SELECT p_partkey AS incident_number, p_brand AS state, p_type AS district,
         CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS village_name,
         CASE WHEN p_partkey % 4 = 0 THEN split_part(p_name, ' ', 1) WHEN p_partkey % 4 = 1 THEN NULL ELSE split_part(p_name, ' ', 2) END AS block,
         CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name || ' Forest, ' || split_part(p_name, ' ', 1) || ' area'
              WHEN 2 THEN split_part(p_name, ' ', 1) || ' Hills' WHEN 3 THEN split_part(p_name, ' ', 2) ELSE 'PS (old), ' || p_name END AS other_areas,
         'Near ' || p_name || ' in ' || p_type || ' area, ' || CAST(p_size AS VARCHAR) || ' people were killed' AS incident_summary,
         CAST(p_size % 4 AS INTEGER) AS total_fatalities, p_size
  FROM part)"""


def places(spark, d: str) -> DataFrame:
    """Parts as coded places: brand as state, type as district, name as village, with block, areas and a text."""
    k, name = F.col("p_partkey"), F.col("p_name")
    first, second = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    return table(spark, d, "part").select(
        k.alias("incident_number"), F.col("p_brand").alias("state"), F.col("p_type").alias("district"),
        F.when(k % 3 != 0, name).alias("village_name"),
        F.when(k % 4 == 0, first).when(k % 4 != 1, second).alias("block"),
        F.when(k % 5 == 1, F.concat(name, F.lit(" Forest, "), first, F.lit(" area")))
        .when(k % 5 == 2, F.concat(first, F.lit(" Hills"))).when(k % 5 == 3, second)
        .when(k % 5 == 4, F.concat(F.lit("PS (old), "), name)).alias("other_areas"),
        F.concat(F.lit("Near "), name, F.lit(" in "), F.col("p_type"), F.lit(" area, "), F.col("p_size").cast("string"),
                 F.lit(" people were killed")).alias("incident_summary"),
        (F.col("p_size") % 4).cast("int").alias("total_fatalities"), "p_size")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
