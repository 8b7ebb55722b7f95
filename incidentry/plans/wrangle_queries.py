"""Recodes, duplicates, profiles, splits, samples and weights on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from incidentry.functions import places, recode
from incidentry.functions.text import integer_id
from incidentry.operators import match, profile, splits, weights, wrangle
from incidentry.plans import jobs, views
from incidentry.plans.catalog import query, table
from incidentry.plans.views import CODED_SQL, COUNTED_SQL, PLACES_SQL, with_

COD = with_(CODED_SQL)
PLA = with_(PLACES_SQL)


def _has(value: str, *cols: str) -> str:
    return "CASE WHEN " + " OR ".join(f"coalesce({c} = '{value}', FALSE)" for c in cols) + " THEN 1 ELSE 0 END"


def _rx(pattern: str, *cols: str, flags: str = "") -> str:
    return "CAST((" + " OR ".join(f"regexp_matches({c}, '{pattern}', '{flags or 'c'}')" for c in cols) + ") AS INTEGER)"


def _rx_known(pattern: str, *cols: str, flags: str = "") -> str:
    return "CAST((" + " OR ".join(
        f"coalesce(regexp_matches({c}, '{pattern}', '{flags or 'c'}'), FALSE)" for c in cols) + ") AS INTEGER)"


A3C = ("first_action", "second_action", "third_action")
T2C = ("first_target", "second_target")
C2C = ("first_civilian_target", "second_civilian_target")
FLAGS_SQL = ", ".join(
    [f"{_has(v, *A3C)} AS {k}" for k, v in recode.ACTIONS.items()]
    + [f"{_has(v, *T2C)} AS {k}" for k, v in recode.TARGETS.items()]
    + [f"{_rx('Government Infrastructure|Government Property', *T2C)} AS government_infrastructure",
       f"{_rx('Non-Maoist armed group', *T2C, flags='i')} AS non_maoist_armed_group",
       f"{_rx('No Target|Unknown|None', 'first_target')} AS no_target",
       f"{_has('Former Maoist', *C2C)} AS former_maoist",
       f"{_rx_known('High Caste[/' + chr(92) * 2 + ']Landowner', *C2C, flags='i')} AS high_caste_landowner",
       f"{_rx_known('Police Informer|Polic Informer', *C2C)} AS police_informer",
       f"{_has('Businessman', *C2C)} AS businessman",
       f"{_rx_known('Aspiring Politician', *C2C)} AS aspiring_politician",
       f"{_has('Other Elite', *C2C)} AS other_elite"])


@query("p05_p09_indicator_recodes", COD + f"""SELECT incident_number, {FLAGS_SQL},
  {_rx_known('Other', *C2C)} AS other_civilian,
  CASE action_successful WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS action_successful,
  CASE WHEN property_damage = 'Yes' THEN 1 WHEN property_damage IS NOT NULL THEN 0 END AS property_damage
FROM coded""")
def p05(spark, d):
    keep = ["incident_number", *recode.ACTIONS, *recode.TARGETS, "government_infrastructure", "non_maoist_armed_group",
            "no_target", "former_maoist", "high_caste_landowner", "police_informer", "businessman", "aspiring_politician",
            "other_elite", "other_civilian", "action_successful", "property_damage"]
    return wrangle.recode_incidents(views.coded(spark, d)).select(*keep)


@query("p07_strict_reference_civilians", COD + """SELECT incident_number, CASE
  WHEN coalesce(first_civilian_target LIKE '%Other%', FALSE) THEN 1
  WHEN second_civilian_target IS NULL THEN 0
  WHEN second_target IS NULL THEN NULL
  WHEN second_target LIKE '%Other%' THEN 1 ELSE 0 END AS other_civilian FROM coded""")
def p07(spark, d):
    return wrangle.recode_incidents(views.coded(spark, d), strict_reference=True).select("incident_number", "other_civilian")


@query("p01_p04_names_and_layout", """SELECT o_orderkey AS incident_number, o_orderpriority AS o_orderpriority,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders""")
def p01(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("O Order-Key"), F.col("o_custkey").alias("Last Name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("oOrderDate"), F.col("o_orderpriority").alias("O.OrderPriority"))
    out = wrangle.snake_names(o, {"o_order_key": "incident_number", "o_order_date": "o_orderdate",
                                  "o_order_priority": "o_orderpriority"}).drop("last_name")
    out = wrangle.relocate(out, ["o_orderpriority"], after="incident_number")
    return out.select(*wrangle.column_range(out, "incident_number", "o_orderdate"))


@query("p10_trim_strings", """SELECT doc_id, length(regexp_replace(chr(10) || text || ' ' || chr(9), '^\\s+|\\s+$', '', 'g')) AS n,
  lang FROM documents""")
def p10(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("\n"), F.col("text"), F.lit(" \t")).alias("text"),
        F.concat(F.lit("\t"), F.col("lang"), F.lit("\r\n")).alias("lang"))
    return wrangle.trim_strings(docs).select("doc_id", F.length("text").cast("bigint").alias("n"), "lang")


@query("p11_p12_gazetteer_names", """SELECT p_partkey AS id, lower(p_brand) AS state_name, lower(p_type) AS district_name,
  coalesce(CASE WHEN p_partkey % 3 <> 0 THEN lower(p_name) END, 'town ' || p_size) AS village_name FROM part""")
def p11(spark, d):
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.upper("p_brand").alias("state"), F.upper("p_type").alias("district"),
        F.when(F.col("p_partkey") % 3 != 0, F.upper("p_name")).alias("village_name"),
        F.concat(F.lit("town "), F.col("p_size").cast("string")).alias("town_name"))
    out = wrangle.lower_names(p, "state", "village_name")
    return out.withColumn("village_name", F.coalesce("village_name", "town_name")).drop("town_name")


@query("p13_p14_task_filters", COD + """SELECT incident_number, first_action, first_target FROM coded
WHERE first_action IN ('Armed Assault', 'Bombing') AND first_target IS NOT NULL""")
def p13(spark, d):
    c = views.coded(spark, d).filter(F.col("first_action").isin("Armed Assault", "Bombing"))
    return c.na.drop(subset=["first_target"]).select("incident_number", "first_action", "first_target")


@query("p03_p14_task_tables", COD + f""", f AS (SELECT *, {FLAGS_SQL} FROM coded)
SELECT 'action_type' AS task, count(*) AS n, CAST(sum(armed_assault + arrest + bombing + infrastructure + surrender + seizure + abduction) AS BIGINT) AS flags FROM f
UNION ALL SELECT 'target_type', count(*), CAST(sum(civilians + maoist + security + ngos) AS BIGINT) FROM f""")
def p03(spark, d):
    c = wrangle.recode_incidents(views.coded(spark, d)).withColumn("incident_summary", F.col("first_action"))
    a = wrangle.task_table(c, "action_type")
    t = wrangle.task_table(c, "target_type")
    total = sum((F.col(x) for x in recode.ACTIONS), F.lit(0))
    some = F.col("civilians") + F.col("maoist") + F.col("security") + F.col("ngos")
    return a.agg(F.lit("action_type").alias("task"), F.count("*").alias("n"), F.sum(total).alias("flags")).unionByName(
        t.agg(F.lit("target_type").alias("task"), F.count("*").alias("n"), F.sum(some).alias("flags")))


@query("p16_usable_counts", """SELECT doc_id, lang FROM documents
WHERE lang <> 'en' AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND trim(text) <> ''""")
def p16(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", "lang", F.when(F.col("lang") == "en", "NA").otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 5 == 0, "none").when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("string")).alias("count"))
    return wrangle.usable_counts(docs, "text", "count").select("doc_id", "lang")


@query("p17_sentinel_audit", """SELECT field, exact_count, contains_count FROM (
 SELECT 'p_size' AS field, count(*) FILTER (CAST(p_size AS VARCHAR) = '9') AS exact_count, count(*) FILTER (CAST(p_size AS VARCHAR) LIKE '%9%') AS contains_count FROM part
 UNION ALL SELECT 'p_brand', count(*) FILTER (p_brand = '9'), count(*) FILTER (p_brand LIKE '%9%') FROM part)""")
def p17(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").cast("string").alias("p_size"), "p_brand")
    return wrangle.sentinel_audit(p, ["p_size", "p_brand"], "9")


@query("p18_dates_since_2005", """SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS date, count(*) AS n FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1999-06-01' AND l_linenumber <> 3 GROUP BY 1, 2""")
def p18(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linenumber") == 3, "no date").otherwise(F.col("l_shipdate").cast("string")).alias("date"))
    return wrangle.since(li, "date", "1999-06-01").groupBy("l_orderkey", "date").agg(F.count("*").alias("n"))


@query("p19_stable_ids", "SELECT count(*) AS n, count(*) AS ids FROM lineitem")
def p19(spark, d):
    li = table(spark, d, "lineitem")
    out = wrangle.stable_id(li, "incident_number", *li.columns)
    return out.agg(F.count("*").alias("n"), F.count("incident_number").alias("ids"))


@query("p20_p21_ids_and_coordinates", """SELECT s_suppkey AS id, CAST(s_suppkey AS VARCHAR) AS incident_number,
 CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS latitude, CAST(s_nationkey AS DOUBLE) AS longitude FROM supplier""")
def p20(spark, d):
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".0")).alias("incident_number"),
        F.when(F.col("s_suppkey") % 4 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string")).alias("longitude"),
        F.col("s_nationkey").cast("string").alias("latitude"))
    return s.select("id", integer_id(F.col("incident_number")).alias("incident_number"),
                    F.col("longitude").try_cast("double").alias("latitude"),
                    F.col("latitude").try_cast("double").alias("longitude"))


@query("p25_parent_labels", COD + f""", f AS (SELECT *, {FLAGS_SQL} FROM coded)
SELECT incident_number, greatest(civilians, government_officials, security) AS human_targets,
 greatest(private_property, government_infrastructure) AS property_targets, greatest(mining_company, ngos) AS organizational_targets,
 greatest(maoist, non_maoist_armed_group) AS armed_groups, no_target AS other FROM f""")
def p25(spark, d):
    c = wrangle.recode_incidents(views.coded(spark, d))
    return c.select("incident_number", *[v.alias(k) for k, v in recode.parent_labels(c.columns).items()])


@query("a03_duplicate_groups", """SELECT doc_id, count(*) OVER (PARTITION BY text) AS dupe_count FROM documents
QUALIFY count(*) OVER (PARTITION BY text) > 1""")
def a03(spark, d):
    return wrangle.duplicate_groups(table(spark, d, "documents"), "text").select("doc_id", "dupe_count")


@query("j08_drop_all_copies", """SELECT doc_id, lang, n_chars FROM documents QUALIFY count(*) OVER (PARTITION BY text) = 1""")
def j08(spark, d):
    return wrangle.without_duplicates(table(spark, d, "documents"), "text").select("doc_id", "lang", "n_chars")


@query("a14_completeness", PLA + """SELECT column_name, present, (SELECT count(*) FROM places) - present AS missing,
  round(present * 100.0 / (SELECT count(*) FROM places), 6) AS percent_present FROM (
  SELECT 'village_name' AS column_name, count(village_name) AS present FROM places
  UNION ALL SELECT 'block', count(block) FROM places UNION ALL SELECT 'other_areas', count(other_areas) FROM places)""")
def a14(spark, d):
    out = profile.completeness(views.places(spark, d), ["village_name", "block", "other_areas"])
    return out.withColumn("percent_present", F.round("percent_present", 6))


@query("a15_presence_overlap", PLA + """SELECT count(*) FILTER (block IS NOT NULL AND other_areas IS NOT NULL) AS "both",
 count(*) FILTER (block IS NOT NULL AND other_areas IS NULL) AS only_block,
 count(*) FILTER (block IS NULL AND other_areas IS NOT NULL) AS only_other_areas,
 count(*) FILTER (block IS NULL AND other_areas IS NULL) AS neither,
 count(*) FILTER (block IS NOT NULL OR other_areas IS NOT NULL) AS either FROM places""")
def a15(spark, d):
    return profile.presence_overlap(views.places(spark, d), "block", "other_areas")


@query("a16_text_presence", PLA + """, t AS (SELECT 'block' AS column_name, block AS v, incident_summary AS s FROM places
 UNION ALL SELECT 'other_areas', other_areas, incident_summary FROM places UNION ALL SELECT 'state', state, incident_summary FROM places)
SELECT column_name, count(v) AS present, count(*) FILTER (contains(lower(s), lower(v))) AS in_text,
 round(count(*) FILTER (contains(lower(s), lower(v))) * 100.0 / count(v), 6) AS percent_in_text FROM t GROUP BY 1""")
def a16(spark, d):
    out = profile.text_presence(views.places(spark, d), ["block", "other_areas", "state"], "incident_summary")
    return out.withColumn("percent_in_text", F.round("percent_in_text", 6))


@query("a17_keyword_categories", PLA + """, v AS (SELECT other_areas AS v FROM places WHERE other_areas IS NOT NULL)
SELECT category, n, round(n * 100.0 / (SELECT count(*) FROM v), 6) AS percent FROM (
 SELECT 'forest' AS category, count(*) FILTER (regexp_matches(v, 'forest|reserve|sanctuary|park|wildlife', 'i')) AS n FROM v
 UNION ALL SELECT 'police_station', count(*) FILTER (regexp_matches(v, 'police station|ps | ps|thana', 'i')) FROM v
 UNION ALL SELECT 'block_tehsil', count(*) FILTER (regexp_matches(v, 'block|tehsil|taluk|mandal|tahsil', 'i')) FROM v
 UNION ALL SELECT 'area_region', count(*) FILTER (regexp_matches(v, 'area|region|zone|sector', 'i')) FROM v
 UNION ALL SELECT 'geographic', count(*) FILTER (regexp_matches(v, 'hills|valley|ghat|range|mountains', 'i')) FROM v)""")
def a17(spark, d):
    return profile.keyword_categories(views.places(spark, d), "other_areas").withColumn("percent", F.round("percent", 6))


@query("a18_label_support", """, t AS (SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS q, CAST(sum(toxic) AS BIGINT) AS x FROM labels)
SELECT label, support, n, round(support / n::DOUBLE, 6) AS prevalence, support / n::DOUBLE < 0.2 AS rare,
 round(greatest(q, x) / support::DOUBLE, 6) AS imbalance_ratio FROM t, LATERAL (VALUES ('quality', q), ('toxic', x)) AS v(label, support)
""".replace(", t AS", "WITH t AS", 1))
def a18(spark, d):
    out = weights.label_support(table(spark, d, "labels"), ["quality", "toxic"], rare_below=0.2)
    return out.withColumns({"prevalence": F.round("prevalence", 6), "imbalance_ratio": F.round("imbalance_ratio", 6)})


AMB = with_("""named AS (SELECT c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE '' END AS district, r_name AS state,
  CASE WHEN c_custkey % 4 = 0 THEN c_name END AS village, CASE WHEN c_custkey % 6 = 0 THEN n_name END AS other
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
 "per AS (SELECT district, count(DISTINCT state) AS num_states, count(*) AS total_incidents FROM named GROUP BY 1)")


def _named(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat("c_mktsegment", F.when(k % 3 == 0, F.col("n_name")).otherwise("")).alias("district"),
        F.col("r_name").alias("state"), F.when(k % 4 == 0, F.col("c_name")).alias("village"),
        F.when(k % 6 == 0, F.col("n_name")).alias("other"), k.alias("id"))


@query("a21_ambiguous_names", AMB + "SELECT district, num_states, CAST(total_incidents AS BIGINT) AS total_incidents FROM per WHERE num_states > 1")
def a21(spark, d):
    return profile.ambiguous_names(_named(spark, d), "district", "state")


@query("a21_ambiguity_summary", AMB + """SELECT num_states, count(*) AS districts, CAST(sum(total_incidents) AS BIGINT) AS incidents,
 round(sum(total_incidents) * 100.0 / (SELECT count(*) FROM named), 6) AS percent_of_incidents FROM per GROUP BY 1""")
def a21b(spark, d):
    out = profile.ambiguity_summary(_named(spark, d), "district", "state")
    return out.withColumn("percent_of_incidents", F.round("percent_of_incidents", 6))


@query("j11_ambiguous_incidents", AMB + """SELECT n.district, n.state, count(*) AS n FROM named n
WHERE n.district IN (SELECT district FROM per WHERE num_states > 1) GROUP BY 1, 2""")
def j11(spark, d):
    return profile.ambiguous_incidents(_named(spark, d), "district", "state").groupBy("district", "state").agg(F.count("*").alias("n"))


@query("a22_disambiguation", AMB + """SELECT n.district, max(p.num_states) AS num_states, count(*) AS total_incidents, count(village) AS has_village,
 count(other) AS has_other_areas, count(coalesce(village, other)) AS has_either,
 round(count(coalesce(village, other)) * 100.0 / count(*), 6) AS disambiguation_rate
FROM named n JOIN per p USING (district) WHERE p.num_states > 1 GROUP BY 1""")
def a22(spark, d):
    out = profile.disambiguation(_named(spark, d), "district", "state", "village", "other")
    return out.withColumn("disambiguation_rate", F.round("disambiguation_rate", 6))


F31_SQL = AMB.replace("r_name AS state,", "r_name AS state, c_custkey AS id,") + """SELECT id, concat_ws(', ', coalesce(village, other),
 district || CASE WHEN contains(lower(district), 'district') THEN '' ELSE ' district' END,
 CASE WHEN num_states > 2 OR (village IS NULL AND other IS NULL AND num_states > 1) THEN state END, 'India') AS query,
 num_states > 1 AS is_ambiguous,
 CASE WHEN num_states <= 1 OR num_states > 2 OR (village IS NULL AND other IS NULL) THEN 'high' ELSE 'medium' END AS confidence
FROM named JOIN per USING (district)"""


@query("f31_smart_queries", F31_SQL)
def f31(spark, d):
    n = _named(spark, d)
    per = match.names_by_state(n, "district", "state")
    q = places.smart_query(F.col("district"), F.col("village"), F.col("other"), F.col("state"), F.col("num_states"), "hybrid")
    return n.join(per, "district").select("id", q.alias("q")).select("id", "q.query", "q.is_ambiguous", "q.confidence")


@query("a24_j17_state_given_district", AMB + """, c AS (SELECT district, state, count(*) AS n FROM named GROUP BY 1, 2),
 t AS (SELECT district, sum(n) AS total FROM c GROUP BY 1), s AS (SELECT count(DISTINCT state) AS k FROM c)
SELECT district, state, n, round((n + 1.0) / (total + k), 6) AS p FROM c JOIN t USING (district), s
UNION ALL SELECT district, NULL, 0, round(1.0 / (total + k), 6) FROM t, s""")
def a24(spark, d):
    return match.conditional_probability(_named(spark, d), "district", "state").withColumn("p", F.round("p", 6))


@query("a20_group_overview", with_(COUNTED_SQL) + """SELECT priority, count(incident_number) AS n, round(avg(true_label), 6) AS avg_true_label,
 round(avg(prediction), 6) AS avg_prediction FROM counted GROUP BY 1""")
def a20(spark, d):
    out = profile.group_overview(views.counted(spark, d), "priority", "incident_number", ["true_label", "prediction"])
    return out.withColumns({c: F.round(c, 6) for c in ("avg_true_label", "avg_prediction")})


@query("p24_a23_block_strategies", PLA + """, s AS (SELECT CASE WHEN coalesce(block = village_name, FALSE) THEN 'Block=Village'
   WHEN coalesce(block = district, FALSE) THEN 'Block=District' WHEN coalesce(contains(lower(incident_summary), lower(block)), FALSE) THEN 'Mentioned in Text'
   ELSE 'Learned Pattern' END AS strategy, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS hit FROM places)
SELECT strategy, count(*) AS total, CAST(sum(hit) AS BIGINT) AS correct, round(avg(hit) * 100, 6) AS accuracy FROM s GROUP BY 1""")
def p24(spark, d):
    p = views.places(spark, d)
    s = places.block_strategy(
        F.col("block") == F.col("village_name"), F.col("block") == F.col("district"),
        places.mentioned(F.col("block"), F.col("incident_summary")))
    out = profile.hit_summary(p.select(s.alias("strategy"), (F.col("p_size") % 2 == 0).alias("hit")), "strategy", "hit")
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("p23_location_levels", PLA + """SELECT CASE WHEN village_name IS NOT NULL THEN 'village' WHEN block IS NOT NULL THEN 'block'
  WHEN incident_number % 2 = 0 THEN 'district' WHEN incident_number % 5 = 1 THEN 'state' ELSE 'unknown' END AS level, count(*) AS n FROM places GROUP BY 1""")
def p23(spark, d):
    p, k = views.places(spark, d), F.col("incident_number")
    level = places.location_level(
        F.col("village_name"), F.col("block"), F.when(k % 2 == 0, F.col("district")).otherwise(" "),
        F.when(k % 5 == 1, F.col("state")))
    return p.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


CLEAN_SQL = PLA + """
, a AS (SELECT *, CASE WHEN contains(lower(incident_summary), lower(block)) THEN block END AS b FROM places WHERE p_size <> 9),
o AS (SELECT *, CASE WHEN other_areas IS NULL OR b IS NULL THEN other_areas
    WHEN lower(b) = lower(other_areas) THEN NULL
    WHEN contains(other_areas, ',') THEN nullif(array_to_string([trim(x) for x in string_split(other_areas, ',')
       if lower(trim(x)) <> lower(b) AND NOT (contains(lower(x), lower(b)) AND length(trim(x)) < length(b) + 20)], ', '), '')
    WHEN contains(lower(other_areas), lower(b)) THEN CASE WHEN length(other_areas) < length(b) + 10 THEN NULL ELSE other_areas END
    WHEN contains(lower(b), lower(other_areas)) AND length(other_areas) < length(b) + 10 THEN NULL
    ELSE other_areas END AS oa FROM a),
m AS (SELECT *, nullif(concat_ws(', ', b, oa), '') AS ol FROM o),
v AS (SELECT *, CASE WHEN ol IS NULL OR village_name IS NULL THEN ol
    WHEN lower(village_name) = lower(ol) THEN NULL
    WHEN contains(ol, ',') THEN nullif(array_to_string([trim(x) for x in string_split(ol, ',')
       if lower(trim(x)) <> lower(village_name) AND NOT (contains(lower(x), lower(village_name)) AND length(trim(x)) < length(village_name) + 10)], ', '), '')
    WHEN contains(lower(ol), lower(village_name)) AND length(ol) < length(village_name) + 10 THEN NULL
    WHEN contains(lower(village_name), lower(ol)) AND length(ol) < length(village_name) + 10 THEN NULL
    ELSE ol END AS f FROM m)
SELECT incident_number, district, village_name, f AS other_locations FROM v"""


@query("f26_f27_clean_locations_job", CLEAN_SQL)
def f26(spark, d):
    p = views.places(spark, d).withColumns({
        "date": F.lit("2010-01-01"), "latitude": F.lit("1"), "longitude": F.lit("2"),
        "district": F.when(F.col("p_size") == 9, "99").otherwise(F.col("district"))})
    return jobs.clean_locations(p).select("incident_number", "district", "village_name", "other_locations")


@query("w04_temporal_split", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END NULLS LAST, o_orderkey) - 1 AS i,
 count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN i < floor(0.8 * n) THEN 'train' WHEN i < floor(0.9 * n) THEN 'val' ELSE 'test' END AS split FROM r""")
def w04(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("date"))
    return splits.temporal_split(o, "date", "o_orderkey").select("o_orderkey", "split")


def _ranked(sql_from: str, id_col: str, strata: str, seed: int = 42) -> str:
    over = f"PARTITION BY {strata}" if strata else ""
    return (f"SELECT *, row_number() OVER ({over} ORDER BY md5('{seed}:' || {id_col}), {id_col}) AS rk, "
            f"count(*) OVER ({over}) AS n FROM {sql_from}")


@query("w05_stratified_split", f"""WITH r AS ({_ranked('documents', 'doc_id', 'lang')})
SELECT doc_id, CASE WHEN rk - 1 < round(n * 0.6) THEN 'train' WHEN rk - 1 < round(n * 0.8) THEN 'val' ELSE 'test' END AS split FROM r""")
def w05(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return splits.stratified_split(docs, "doc_id", ["lang"], 0.6, 0.2).select("doc_id", "split")


@query("w06_f35_group_split", f"""WITH g AS (SELECT o_orderkey, concat_ws('_', CASE WHEN o_orderkey % 3 = 0 THEN 'zero' ELSE 'non-zero' END,
   CASE WHEN o_custkey = 0 THEN 'zero' ELSE 'non-zero' END, CASE WHEN o_orderkey < 4 THEN 'zero' ELSE 'non-zero' END) AS g FROM orders),
r AS ({_ranked('g', 'o_orderkey', 'g')})
SELECT o_orderkey, g, CASE WHEN n >= 3 THEN CASE WHEN rk <= greatest(floor(0.6 * n), 1) THEN 'train'
   WHEN rk <= greatest(floor(0.6 * n), 1) + greatest(floor(0.2 * n), 1) THEN 'val' ELSE 'test' END
  WHEN rk = 1 THEN 'train' ELSE 'test' END AS split FROM r""")
def w06(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 3).alias("a"), F.col("o_custkey").alias("b"),
        F.when(F.col("o_orderkey") < 4, 0).otherwise(1).alias("c"))
    g = o.withColumn("g", recode.zero_pattern(["a", "b", "c"]))
    return splits.group_split(g, "o_orderkey", "g").select("o_orderkey", "g", "split")


@query("w07_multilabel_split", f"""WITH s AS (SELECT CAST(sum(quality) AS BIGINT) AS q, CAST(sum(toxic) AS BIGINT) AS x FROM labels),
g AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN CASE WHEN q < x OR q = x THEN 'quality' ELSE 'toxic' END
   WHEN quality = 1 THEN 'quality' WHEN toxic = 1 THEN 'toxic' ELSE 'none' END AS stratum FROM labels, s),
r AS ({_ranked('g', 'doc_id', 'stratum')})
SELECT doc_id, CASE WHEN rk - 1 < round(n * 0.8) THEN 'train' WHEN rk - 1 < round(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM r""")
def w07(spark, d):
    return splits.multilabel_split(table(spark, d, "labels"), "doc_id", ["quality", "toxic"]).select("doc_id", "split")


@query("w08_nested_fractions", f"""WITH r AS ({_ranked('documents', 'doc_id', 'lang')})
SELECT doc_id, CASE WHEN rk / n::DOUBLE <= 0.03125 THEN 0.03125 WHEN rk / n::DOUBLE <= 0.0625 THEN 0.0625 WHEN rk / n::DOUBLE <= 0.125 THEN 0.125
 WHEN rk / n::DOUBLE <= 0.25 THEN 0.25 WHEN rk / n::DOUBLE <= 0.5 THEN 0.5 ELSE 1.0 END::DOUBLE AS fraction FROM r""")
def w08(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return splits.nested_fractions(docs, "doc_id", ["lang"]).select("doc_id", "fraction")


@query("w09_random_sample", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 300")
def w09(spark, d):
    return splits.sample_rows(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 300)


@query("w10_sample_per_group", f"WITH r AS ({_ranked('customer', 'c_custkey', 'c_nationkey')}) SELECT c_custkey, c_nationkey FROM r WHERE rk <= 2")
def w10(spark, d):
    return splits.sample_per_group(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", 2)


@query("w11_balanced_undersample", f"""WITH p AS (SELECT doc_id, toxic, toxic = 1 AS pos FROM labels), r AS ({_ranked('p', 'doc_id', 'pos')})
SELECT doc_id, toxic FROM r WHERE pos OR rk <= (SELECT count(*) FROM p WHERE pos)""")
def w11(spark, d):
    return splits.balanced(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", F.col("toxic") == 1)


WEIGHT_SQL = """w0 AS (SELECT doc_id, quality / greatest((SELECT sum(quality) FROM labels), 1)::DOUBLE + toxic / greatest((SELECT sum(toxic) FROM labels), 1)::DOUBLE AS w FROM labels),
w1 AS (SELECT doc_id, CASE WHEN w > 0 THEN w ELSE (SELECT min(w) FROM w0 WHERE w > 0) END AS w FROM w0),
w2 AS (SELECT doc_id, w / (SELECT avg(w) FROM w1) AS sample_weight FROM w1)"""


@query("a30_sample_weights", with_(WEIGHT_SQL) + "SELECT doc_id, round(sample_weight, 6) AS sample_weight FROM w2")
def a30(spark, d):
    out = weights.sample_weights(table(spark, d, "labels"), ["quality", "toxic"])
    return out.select("doc_id", F.round("sample_weight", 6).alias("sample_weight"))


def resample_sql(source: str) -> str:
    """Copies of each (doc_id, r) of ``source``: draws by parts of a rate up to 8, on a table of cumulated terms."""
    return f"""parts AS (SELECT doc_id, r / ceil(r / 8) AS r, unnest(range(1, CAST(ceil(r / 8) AS BIGINT) + 1)) AS part FROM {source} WHERE r > 0),
u AS (SELECT doc_id, part, r, (CAST('0x' || md5('42:' || doc_id || ':' || part)[1:13] AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM parts),
p AS (SELECT doc_id, u, sum(exp(i * ln(r) - r - lgamma(i + 1))) OVER (PARTITION BY doc_id, part ORDER BY i) AS c FROM u, generate_series(0, 120) AS g(i))
SELECT doc_id, CAST(generate_series AS INTEGER) AS copy FROM (SELECT doc_id, count(*) FILTER (u > c) AS k FROM p GROUP BY 1) AS q, LATERAL generate_series(1, k)"""


@query("w12_weighted_resample", with_(WEIGHT_SQL, "rates AS (SELECT doc_id, sample_weight AS r FROM w2)", resample_sql("rates")))
def w12(spark, d):
    w = weights.sample_weights(table(spark, d, "labels"), ["quality", "toxic"])
    return splits.weighted_resample(w, "doc_id", "sample_weight").select("doc_id", "copy")


@query("w12_resample_rare_labels", "WITH rates AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 120.0 + doc_id % 400 ELSE 0.25 END AS r FROM labels), "
       + resample_sql("rates"))
def w12b(spark, d):
    """Weights of several hundred, as labels of a tenth of a percent get them."""
    w = table(spark, d, "labels").withColumn("w", F.when(F.col("toxic") == 1, 120.0 + F.col("doc_id") % 400).otherwise(0.25))
    return splits.weighted_resample(w, "doc_id", "w").select("doc_id", "copy")


@query("a27_a28_class_weights", """WITH t AS (SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS q, CAST(sum(toxic) AS BIGINT) AS x FROM labels),
l AS (SELECT label, (n - s) / greatest(s, 1)::DOUBLE AS pos_weight FROM t, LATERAL (VALUES ('quality', q), ('toxic', x)) AS v(label, s))
SELECT label, round(pos_weight, 6) AS pos_weight, round(CASE label WHEN 'toxic' THEN greatest(least(least(pos_weight, 5.0), 10.0), 1.0)
  ELSE greatest(least(sqrt(least(pos_weight, 3.0)), 10.0), 1.0) END, 6) AS weight FROM l""")
def a28(spark, d):
    special = table(spark, d, "labels").limit(1).select(
        F.lit("toxic").alias("label"), F.lit(5.0).alias("cap_ratio"), F.lit(False).alias("sqrt_scaling"))
    out = weights.conservative_weights(table(spark, d, "labels"), ["quality", "toxic"], overrides=special)
    return out.select("label", F.round("pos_weight", 6).alias("pos_weight"), F.round("weight", 6).alias("weight"))


@query("a29_alpha_weights", with_(CODED_SQL) + """, f AS (SELECT avg(CASE WHEN first_target = 'Civilians' THEN 1.0 ELSE 0 END) AS a,
  avg(CASE WHEN second_target = 'Security' THEN 1.0 ELSE 0 END) AS b, avg(CASE WHEN first_action = 'Bombing' THEN 1.0 ELSE 0 END) AS c,
  avg(CASE WHEN property_damage = 'Yes' THEN 1.0 ELSE 0 END) AS d FROM coded),
l AS (SELECT label, p FROM f, LATERAL (VALUES ('a', a), ('b', b), ('c', c), ('d', d)) AS v(label, p)),
m AS (SELECT p AS med FROM l ORDER BY p LIMIT 1 OFFSET 1)
SELECT label, round(p, 6) AS prevalence, round(least(greatest(sqrt(med / p), 0.25), 0.75), 6) AS alpha FROM l, m""")
def a29(spark, d):
    c = views.coded(spark, d).select(
        recode.any_equals("Civilians", "first_target").alias("a"), recode.any_equals("Security", "second_target").alias("b"),
        recode.any_equals("Bombing", "first_action").alias("c"), recode.any_equals("Yes", "property_damage").alias("d"))
    out = weights.alpha_weights(c, ["a", "b", "c", "d"])
    return out.select("label", F.round("prevalence", 6).alias("prevalence"), F.round("alpha", 6).alias("alpha"))


@query("n13_augmentation_plan", """WITH t AS (SELECT CAST(sum(quality) AS BIGINT) AS q, CAST(sum(toxic) AS BIGINT) AS x FROM labels)
SELECT label, s AS support, CAST(least(greatest(1000 - s, 0), 500, floor(s * 0.5)) AS BIGINT) AS to_add FROM t, LATERAL (VALUES ('quality', q), ('toxic', x)) AS v(label, s)""")
def n13(spark, d):
    return weights.augmentation_plan(table(spark, d, "labels"), ["quality", "toxic"], 1000, 500, 0.5)


@query("n13_augmentation_seeds", f"""WITH t AS (SELECT CAST(sum(quality) AS BIGINT) AS q, CAST(sum(toxic) AS BIGINT) AS x FROM labels),
plan AS (SELECT label, least(greatest(1000 - s, 0), 500, floor(s * 0.5)) AS to_add FROM t, LATERAL (VALUES ('quality', q), ('toxic', x)) AS v(label, s)),
p AS (SELECT doc_id, 'quality' AS label, quality + toxic = 1 AS single FROM labels WHERE quality = 1
   UNION ALL SELECT doc_id, 'toxic', quality + toxic = 1 FROM labels WHERE toxic = 1),
pool AS (SELECT * FROM p WHERE single OR label NOT IN (SELECT label FROM p WHERE single)),
r AS ({_ranked('pool', 'doc_id', 'label')})
SELECT r.label, doc_id FROM r JOIN plan USING (label) WHERE rk <= to_add""")
def n13b(spark, d):
    return weights.augmentation_seeds(
        table(spark, d, "labels"), "doc_id", ["quality", "toxic"], min_samples=1000, max_new=500, max_ratio=0.5)


@query("a49_count_overview", with_(COUNTED_SQL) + """SELECT priority, grouping(priority) = 1 AS is_total, count(*) AS n,
 round(avg(CASE WHEN true_label = 0 THEN 1.0 ELSE 0 END) * 100, 6) AS percent_zero, round(avg(true_label), 6) AS mean, max(true_label) AS max,
 CAST(quantile_cont(true_label, 0.5) AS DOUBLE) AS median FROM counted GROUP BY GROUPING SETS ((priority), ())""")
def a49(spark, d):
    out = profile.count_overview(views.counted(spark, d), "true_label", "priority")
    return out.withColumns({"percent_zero": F.round("percent_zero", 6), "mean": F.round("mean", 6)})
