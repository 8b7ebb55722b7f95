"""Page ingest, parsing of model output, place text functions, streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from incidentry.functions import counts, places, text
from incidentry.plans import jobs, views
from incidentry.plans.catalog import query, scratch, table
from incidentry.plans.views import INCIDENTS_SQL, LOCATED_SQL, PLACES_SQL, with_
from incidentry.sources import pages as page_source
from incidentry.sources import tables
from incidentry.streaming import ingest

LOC = with_(LOCATED_SQL)
PLA = with_(PLACES_SQL)


# ---- pages -------------------------------------------------------------------------------

PAGES_SQL = """turns AS (SELECT conv_id, turn, 'Aug' AS month, CAST(2000 + conv_id % 20 AS VARCHAR) AS year, 'series-' || conv_id AS series,
  1 + turn % 3 AS day, trim(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') || ' ©’') AS summary,
  row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) AS nn FROM conversations)"""
INCIDENT_ROWS_SQL = with_(PAGES_SQL) + """SELECT 'I08' || lpad(CAST(day AS VARCHAR), 2, '0') || year[3:4] || CASE WHEN nn < 10 THEN '0' ELSE '' END || nn AS "Incident_Number",
 year || '-08-' || lpad(CAST(day AS VARCHAR), 2, '0') AS "Date", summary AS "Incident_Summary", series AS "Series" FROM turns"""


def conversation_pages(spark, d):
    """One page per conversation: every turn as an incident block with its date cell."""
    c = table(spark, d, "conversations")
    safe = c.withColumn("text", F.replace(F.replace(F.replace(
        "text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    row = F.concat(
        F.lit('<tr><td style="width: 15%;"> Aug-'), (1 + F.col("turn") % 3).cast("string"),
        F.lit(' </td><td><div class="card more">\n<div><b>'), F.col("text"), F.lit("</b></div> &copy;&#8217;</div></td></tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("r")))), lambda x: x.r), "\n")
    # A conversation is one page of the source, so its turns belong in one row.
    return safe.groupBy("conv_id").agg(F.concat(F.lit("<html><table>"), body, F.lit("</table></html>")).alias("html")).select(
        F.concat(F.lit("series-"), F.col("conv_id").cast("string")).alias("series"),
        (2000 + F.col("conv_id") % 20).cast("string").alias("year"), F.lit("Aug").alias("month"), "html")


@query("s06_w01_page_incidents", INCIDENT_ROWS_SQL)
def s06(spark, d):
    return jobs.ingest_pages(conversation_pages(spark, d)).drop("Incident_ID")


@query("s05_s06_raw_pages", """WITH x AS (SELECT page_id, regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a></li>', 1) AS li, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS h FROM pages)
SELECT page_id, CAST(len(li) AS INTEGER) AS items, md5(array_to_string([trim(regexp_replace(replace(x, '&amp;', '&'), '\\s+', ' ', 'g')) for x in li], '|')) AS digest FROM x WHERE len(li) = len(h)""")
def s05(spark, d):
    p = table(spark, d, "pages").select("page_id", "html")
    found = page_source.page_items(p, r"<li><a [^>]*>([^<]*)</a></li>", r'<a href="/([^"]*)"')
    return found.select("page_id", F.size("items").alias("items"), F.md5(F.array_join("items", "|")).alias("digest"))


@query("f01_f03_summary_and_keys", """SELECT page_id, replace(regexp_replace(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g'), 'Read less...', '') AS summary,
 string_split(url, '/')[-1] AS series, '2024-03-' || CASE WHEN page_id % 28 < 9 THEN '0' ELSE '' END || (page_id % 28 + 1) AS date FROM (
 SELECT page_id, url, '  ' || url || chr(10) || '  Read less... ' AS text FROM pages)""")
def f01(spark, d):
    p = table(spark, d, "pages")
    raw = F.concat(F.lit("  "), F.col("url"), F.lit("\n  Read less... "))
    day = F.concat(F.lit("Mar - "), (F.col("page_id") % 28 + 1).cast("string"))
    return p.select("page_id", text.summary_text(raw).alias("summary"), text.series_key(F.col("url")).alias("series"),
                    text.incident_date(F.lit("2024"), F.lit("Mar"), day).alias("date"))


# ---- counts ------------------------------------------------------------------------------

ANSWERS_SQL = """answers AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, CAST(l_quantity AS BIGINT) AS q, l_partkey % 9 AS kind FROM lineitem)"""


def _answers(spark, d):
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("bigint").cast("string")
    kind = F.col("l_partkey") % 9
    raw = (
        F.when(kind == 0, F.concat(F.lit(" "), q, F.lit(". "))).when(kind == 1, F.concat(F.lit("-"), q))
        .when(kind == 2, F.lit("two killed")).when(kind == 3, F.lit("none")).when(kind == 4, F.lit(""))
        .when(kind == 5, F.concat(F.lit("in 2009, "), q, F.lit(" died")))
        .when(kind == 6, F.concat(F.lit('```json\n{"fatalities": '), q, F.lit("}\n```")))
        .when(kind == 7, F.concat(F.lit("x -"), q)))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", raw.alias("raw_output"))


@query("f04_f07_counts_from_answers", with_(ANSWERS_SQL) + """SELECT id, l_partkey,
 CASE WHEN kind IN (0, 1, 6, 7) THEN q WHEN kind = 5 THEN 2009 ELSE 0 END AS first_number,
 CASE kind WHEN 0 THEN q WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 5 THEN 2009 WHEN 6 THEN q WHEN 7 THEN q END AS lenient,
 CASE WHEN kind IN (0, 1, 5, 6, 7) THEN q ELSE 0 END AS fatalities,
 CASE kind WHEN 0 THEN q WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 5 THEN 2009 WHEN 6 THEN q WHEN 7 THEN q ELSE 0 END AS parsed FROM answers""")
def f04(spark, d):
    a = _answers(spark, d)
    c = F.col("raw_output")
    out = jobs.type_predictions(a, "count").withColumnRenamed("prediction", "parsed")
    return out.select("id", "l_partkey", counts.whole_number(c).alias("first_number"),
                      counts.lenient_count(c).alias("lenient"), counts.fatalities(c).alias("fatalities"), "parsed")


@query("f06_regression_counts", """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE greatest(round_even(o_totalprice / 1000 - 100, 0), 0) END AS BIGINT) AS prediction FROM orders""")
def f06(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 4, "n/a").otherwise(
        (F.col("o_totalprice") / 1000 - 100).cast("string")).alias("raw_output"))
    return jobs.type_predictions(o, "regression").select("o_orderkey", "prediction")


@query("f08_five_line_counts", with_(INCIDENTS_SQL) + """SELECT incident_number, concat_ws('|', total_injuries, total_arrests, total_surrenders, total_fatalities, total_abducted) AS counts
FROM incidents WHERE incident_number % 4 <> 0 AND incident_number % 7 <> 0""")
def f08(spark, d):
    names = ["total_injuries", "total_arrests", "total_surrenders", "total_fatalities", "total_abducted"]
    i = views.incidents(spark, d)
    lines = F.array(*[F.concat(F.lit(f"{n}: "), F.col(n).cast("string")) for n in names])
    k = F.col("incident_number")
    raw = F.when(k % 4 == 0, F.array_join(F.slice(lines, 1, 3), "\n")).when(
        k % 7 == 0, F.concat(F.array_join(F.slice(lines, 1, 4), "\n"), F.lit("\ntotal: some"))).otherwise(
        F.concat(F.array_join(lines, "\n"), F.lit("\nThat is all.")))
    out = jobs.type_predictions(i.withColumn("raw_output", raw), "five_counts")
    return out.select("incident_number", F.array_join("prediction", "|").alias("counts"))


@query("f34_answer_spans", PLA + """SELECT incident_number, CAST(p_size AS VARCHAR) AS answer_text,
 CAST(length('Near ' || p_name2 || ' in ' || district || ' area, ') AS INTEGER) AS answer_start
FROM places JOIN (SELECT p_partkey, p_name AS p_name2 FROM part) ON p_partkey = incident_number""")
def f34(spark, d):
    p = views.places(spark, d)
    span = counts.answer_span(F.col("incident_summary"), F.col("total_fatalities"))
    return p.select("incident_number", span.alias("s")).select("incident_number", "s.answer_text", "s.answer_start")


# ---- labels ------------------------------------------------------------------------------


@query("f09_f19_single_labels", """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'Maoist' WHEN 1 THEN 'Security' WHEN 2 THEN 'Maoist' WHEN 3 THEN 'Security' WHEN 4 THEN 'Unknown'
 WHEN 5 THEN 'Unknown' END AS label FROM orders""")
def f09(spark, d):
    k = F.col("o_orderkey") % 7
    raw = F.when(k == 0, " maoist ").when(k == 1, "SECURITY").when(k == 2, "Maoists!").when(k == 3, "secur1ty forces").when(
        k == 4, "qqq").when(k == 5, "")
    o = table(spark, d, "orders").select("o_orderkey", raw.alias("raw_output"))
    return jobs.type_predictions(o, "single_label").select("o_orderkey", F.col("prediction").alias("label"))


ACTION_WORDS = {"armed assault": "armed_assault", "arrest": "arrest", "bombing": "bombing", "surrender": "surrender"}


@query("f10_label_sets", """SELECT o_orderkey, CASE WHEN k IN (0, 1, 4) THEN 1 ELSE 0 END AS armed_assault, CASE WHEN k IN (1, 3) THEN 1 ELSE 0 END AS arrest,
 CASE WHEN k IN (0, 3) THEN 1 ELSE 0 END AS bombing, CASE WHEN k = 4 THEN 1 ELSE 0 END AS surrender FROM (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)""")
def f10(spark, d):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, "Armed Assault, Bombing").when(k == 1, "arrest,armed assualt").when(k == 2, "None").when(
        k == 3, "bombings, ARREST , xyzzy").when(k == 4, "Armed  assault, surrendered")
    o = table(spark, d, "orders").select("o_orderkey", raw.alias("raw_output"))
    return jobs.type_label_sets(o, "o_orderkey", ACTION_WORDS).drop("raw_output")


# ---- structured locations ----------------------------------------------------------------

FIELDS_SQL = ", ".join(
    f"nullif(regexp_extract(prediction, '(^|, ){x}: ([^,]*)', 2), '') AS {x}" for x in places.LEVELS)


@query("f12_f14_parsed_answers", LOC + f"SELECT incident_number, {FIELDS_SQL} FROM located")
def f12(spark, d):
    c = views.located(spark, d)
    k = F.col("incident_number") % 3
    raw = F.when(k == 0, F.concat(F.lit("```text\nSure! "), F.col("prediction"), F.lit("\n```"))).when(
        k == 1, F.concat(F.lit(" [SEP] "), F.replace("prediction", F.lit("district:"), F.lit("district：")), F.lit(" ,"))
    ).otherwise(F.col("prediction"))
    p = F.when(k == 1, places.parse_structured(raw)).otherwise(places.parse_answer(raw))
    return c.select("incident_number", p.alias("p")).select("incident_number", "p.*")


@query("f13_build_structured", PLA + """SELECT incident_number, concat_ws(', ', 'state: ' || state, 'district: ' || district, 'village: ' || village_name, 'other_locations: ' || other_areas) AS location FROM places""")
def f13(spark, d):
    p = views.places(spark, d)
    return p.select("incident_number", places.build_structured(
        F.concat(F.lit(" "), "state"), F.col("district"), F.coalesce("village_name", F.lit(" ")), F.col("other_areas")).alias("location"))


@query("f15_json_to_structured", LOC + """SELECT incident_number, CASE WHEN incident_number % 5 = 0 THEN '' ELSE 'state: ' || region || CASE WHEN incident_number % 2 = 0 THEN ', village: v' || incident_number ELSE '' END END AS prediction FROM located""")
def f15(spark, d):
    c = views.located(spark, d)
    k = F.col("incident_number")
    doc = F.to_json(F.struct(
        F.col("region").alias("state"), F.lit(" ").alias("district"),
        F.when(k % 2 == 0, F.concat(F.lit("v"), k.cast("string"))).alias("village")))
    raw = F.when(k % 5 == 0, F.concat(F.lit("not json "), F.col("region"))).otherwise(doc)
    return jobs.type_predictions(c.withColumn("raw_output", raw).drop("prediction"), "location_json").select("incident_number", "prediction")


@query("f11_clean_texts", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\[[^\]\n\r]{1,10}\]', '', 'g'), '\s+', ' ', 'g'), '^[ ,]+|[ ,]+$', '', 'g')) AS digest FROM documents""")
def f11(spark, d):
    docs = table(spark, d, "documents")
    marked = F.concat(F.lit(", "), F.col("text"), F.lit("\n, "))
    return docs.select("doc_id", F.md5(places.clean_structured(marked)).alias("digest"))


@query("f16_truncate", "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 200) || '...' END AS text FROM documents")
def f16(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 200).alias("text"))


@query("f22_states", """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Uttar Pradesh' WHEN 1 THEN 'Odisha' WHEN 2 THEN 'Bihar' WHEN 3 THEN 'Jammu and Kashmir' WHEN 4 THEN c_name ELSE '' END AS state,
 c_custkey % 6 IN (0, 1, 2) AS valid FROM customer""")
def f22(spark, d):
    k = F.col("c_custkey") % 6
    raw = F.when(k == 0, " UP ").when(k == 1, "orissa").when(k == 2, "Bihar").when(k == 3, "J&K").when(
        k == 4, F.concat(F.lit(" "), F.col("c_name")))
    known = ["Uttar Pradesh", "Odisha", "Bihar"]
    return table(spark, d, "customer").select(
        "c_custkey", text.canonical_state(raw, known).alias("state"), text.is_valid_state(raw, known).alias("valid"))


@query("f23_f25_place_words", """SELECT p_partkey, p_name AS bare, lower(p_name) || ' district police station-' || p_size AS normal,
 replace(replace(replace(replace(lower(p_name || ' River and Forests Police Station'), 'police', ''), 'station', ''), 'river', ''), 'forests', '') AS query FROM part""")
def f23(spark, d):
    name = F.col("p_name")
    k = F.col("p_partkey") % 4
    dressed = F.concat(name, F.when(k == 0, " District").when(k == 1, " Police Station area").when(k == 2, "  village ").otherwise(" DIST"))
    return table(spark, d, "part").select(
        "p_partkey", text.drop_descriptors(dressed).alias("bare"),
        text.matching_form(F.concat(F.upper(name), F.lit(" DIST, (PS-"), F.col("p_size").cast("string"), F.lit(")"))).alias("normal"),
        text.drop_query_words(F.concat(name, F.lit(" River and Forests Police Station"))).alias("query"))


@query("f28_place_lists", PLA + """
, l AS (SELECT incident_number, [lower(state), lower(district), lower(block), lower(village_name), trim(regexp_replace(lower(other_areas), '\\s*\\([^)]*\\)', '', 'g'))] AS l FROM places),
 u AS (SELECT incident_number, i, l[i] AS v FROM l, range(1, 6) AS r(i) WHERE l[i] IS NOT NULL AND l[i] <> ''),
 f AS (SELECT incident_number, v, min(i) AS i FROM u GROUP BY 1, 2)
SELECT incident_number, string_agg(v, ', ' ORDER BY i) AS places FROM f GROUP BY 1""")
def f28(spark, d):
    p = views.places(spark, d)
    return p.select("incident_number", places.place_list(*[
        F.col(c) for c in ("state", "district", "block", "village_name", "other_areas")]).alias("places"))


@query("f29_f30_list_checks", PLA + """
, l AS (SELECT *, [trim(x) for x in string_split(lower(coalesce(other_areas, '')), ',') if trim(x) <> ''] AS a FROM places)
SELECT incident_number, coalesce(len([x for x in a if contains(x, lower(block)) OR contains(lower(block), x)]) > 0, FALSE) AS block_listed,
 CAST(len([x for x in a if contains(lower(incident_summary), x)]) AS INTEGER) AS found, CAST(len([x for x in a if NOT contains(lower(incident_summary), x)]) AS INTEGER) AS missing,
 round(CASE WHEN len(a) > 0 THEN len([x for x in a if contains(lower(incident_summary), x)]) * 100.0 / len(a) ELSE 0 END, 6) AS percent_found,
 round(len(list_intersect(list_distinct([x for x in [lower(village_name), lower(district)] if x IS NOT NULL]), a)) * 100.0
   / len(list_distinct([x for x in [lower(village_name), lower(district)] if x IS NOT NULL])), 6) AS overlap FROM l""")
def f29(spark, d):
    p = views.places(spark, d).withColumn(
        "a", F.filter(places.components(F.lower(F.coalesce("other_areas", F.lit("")))), lambda x: x != ""))
    found = places.found_in_text(F.col("a"), F.col("incident_summary"))
    truth = F.array_compact(F.array(F.lower("village_name"), F.lower("district")))
    return p.select(
        "incident_number", places.in_list(F.col("block"), F.col("a")).alias("block_listed"), F.size(found).alias("found"),
        F.size(places.not_found_in_text(F.col("a"), F.col("incident_summary"))).alias("missing"),
        F.round(places.share_of(found, F.col("a")), 6).alias("percent_found"),
        F.round(places.overlap(truth, F.col("a")), 6).alias("overlap"))


@query("p22_f32_geocode_requests", LOC + f""", f AS (SELECT incident_number, {FIELDS_SQL} FROM located)
SELECT incident_number, coalesce(nullif(concat_ws(', ', village, other_locations), ''), district, state) AS full_address,
 CASE WHEN coalesce(village, other_locations, district) IS NOT NULL THEN state END AS full_state,
 CASE WHEN coalesce(village, other_locations) IS NOT NULL THEN district END AS full_district,
 coalesce(village, district, state) AS village_address, CASE WHEN village IS NOT NULL THEN district END AS village_district,
 concat_ws(', ', state, district, village, other_locations) AS comma_address, coalesce(village, other_locations) IS NOT NULL AS fine FROM f""")
def f32(spark, d):
    c = views.located(spark, d).withColumn("p", places.parse_structured(F.col("prediction"), normalise=False))
    p = F.col("p")
    out = c.select("incident_number", places.geocode_request(p, "full").alias("a"),
                   places.geocode_request(p, "village_only").alias("b"),
                   places.geocode_request(p, "comma_delimited").alias("c"), places.has_fine_place(p).alias("fine"))
    return out.select(
        "incident_number", F.col("a.address").alias("full_address"), F.col("a.state_filter").alias("full_state"),
        F.col("a.district_filter").alias("full_district"), F.col("b.address").alias("village_address"),
        F.col("b.district_filter").alias("village_district"), F.col("c.address").alias("comma_address"), "fine")


RESULTS = ("array<struct<address_components:array<struct<long_name:string,types:array<string>>>,"
           "geometry:struct<location:struct<lat:double,lng:double>>>>")


@query("f33_geocoder_responses", """SELECT c_custkey AS incident_number, CASE WHEN k = 5 THEN NULL ELSE r_name END AS state, CASE WHEN k IN (3, 5) THEN NULL ELSE n_name END AS district,
 CASE WHEN k IN (1, 4) THEN c_mktsegment END AS subdistrict, CASE WHEN k IN (0, 4) THEN c_name END AS town_village,
 CASE k WHEN 5 THEN NULL WHEN 4 THEN 4.5 WHEN 0 THEN 1.5 WHEN 1 THEN 2.5 ELSE 3.5 END::DOUBLE AS latitude,
 CASE k WHEN 0 THEN 'town_village' WHEN 4 THEN 'town_village' WHEN 1 THEN 'subdistrict' WHEN 2 THEN 'district' WHEN 3 THEN 'state' END AS level
FROM (SELECT *, c_custkey % 6 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""")
def f33(spark, d):
    k = F.col("c_custkey") % 6
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def part(name, kind):
        return F.struct(name.alias("long_name"), F.array(F.lit("political"), F.lit(kind)).alias("types"))

    def result(parts, lat):
        return F.struct(F.array_compact(F.array(*parts)).alias("address_components"), F.struct(F.struct(
            F.lit(lat).alias("lat"), F.lit(70.0).alias("lng")).alias("location")).alias("geometry"))

    state = part(F.col("r_name"), "administrative_area_level_1")
    district = part(F.col("n_name"), "administrative_area_level_2")
    sub = part(F.col("c_mktsegment"), "administrative_area_level_3")
    town = part(F.col("c_name"), "locality")
    ward = part(F.lit("ward"), "sublocality")
    plain = result([state, F.when(k != 3, district)], 3.5)
    fine = F.when(k == 0, result([ward, town, district, state], 1.5)).when(k == 1, result([sub, district, state], 2.5)).when(
        k == 4, result([town, sub, district, state], 4.5))
    later = F.when(k == 0, result([part(F.lit("later"), "locality"), district, state], 9.5))
    doc = F.to_json(F.struct(
        F.when(k == 5, "ZERO_RESULTS").otherwise("OK").alias("status"),
        F.when(k == 5, F.array().cast(RESULTS)).otherwise(F.array_compact(F.array(plain, fine, later))).alias("results")))
    out = jobs.flatten_geocodes(c.select(F.col("c_custkey").alias("incident_number"), doc.alias("response")))
    return out.select("incident_number", "state", "district", "subdistrict", "town_village", "latitude", "level")


@query("j03_geocodes_beside_manual", with_(INCIDENTS_SQL) + """SELECT incident_number, CASE WHEN incident_number % 4 <> 0 AND total_abducted > 0 THEN round(6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)), 4) END AS distance_km
FROM (SELECT *, pow(sin(radians(total_injuries - total_fatalities) / 2), 2) AS a FROM incidents)""")
def j03(spark, d):
    i = views.incidents(spark, d)
    geo = i.select("incident_number", F.col("total_fatalities").cast("double").alias("latitude"), F.lit(70.0).alias("longitude"))
    manual = i.filter("total_abducted > 0").select(
        F.concat(F.col("incident_number").cast("string"), F.lit(".0")).alias("incident_number"),
        F.when(F.col("incident_number") % 4 == 0, "none").otherwise(F.col("total_injuries").cast("string")).alias("latitude"),
        F.lit("70").alias("longitude"))
    return jobs.with_distances(geo, manual).select("incident_number", F.round("distance_km", 4).alias("distance_km"))


@query("p30_display_labels", """SELECT DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'Threshold Tuning' WHEN '2-HIGH' THEN 'Focal Loss' ELSE 'class_weights' END AS strategy,
 CASE o_orderstatus WHEN 'F' THEN 'Armed Assault' ELSE 'Seizure' END AS label FROM orders""")
def p30(spark, d):
    o = table(spark, d, "orders")
    s = F.when(F.col("o_orderpriority") == "1-URGENT", "threshold_tuned").when(
        F.col("o_orderpriority") == "2-HIGH", "focal_tuned").otherwise("class_weights")
    x = F.when(F.col("o_orderstatus") == "F", "armed_assault").otherwise("seizure")
    return o.select(text.display_label(s, {"threshold_tuned": "Threshold Tuning", "focal_tuned": "Focal Loss"}).alias("strategy"),
                    text.title_label(x).alias("label")).distinct()


@query("e04_scorer_columns", """SELECT doc_id, CAST(length(text) AS BIGINT) AS n, contains(text, '@') AS has_at FROM documents""")
def e04(spark, d):
    def scorer(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": pdf["text"].str.len(), "has_at": pdf["text"].str.contains("@", regex=False)})

    docs = table(spark, d, "documents").select("doc_id", "text")
    return jobs.apply_scorer(docs, scorer, "n bigint, has_at boolean").select("doc_id", "n", "has_at")


# ---- streams -----------------------------------------------------------------------------


@query("t01_stream_page_ingest", "SELECT *, \"Series\" || '_' || \"Incident_Number\" AS \"Incident_ID\" FROM (" + INCIDENT_ROWS_SQL + ")")
def t01(spark, d):
    """Pages arrive in several files and are ingested in small batches; a second run finds nothing new."""
    root = scratch(spark, "ingest")
    conversation_pages(spark, d).repartition("series").write.parquet(f"{root}/pages")
    for _ in range(2):
        stream = ingest.page_stream(spark, f"{root}/pages", files_per_trigger=4)
        ingest.ingest_pages(stream, f"{root}/incidents", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/incidents").drop("batch_id")


@query("s07_append_twice", """SELECT doc_id, source, lang, n_chars FROM documents""")
def s07b(spark, d):
    """Two appends by a key that many rows share: all rows of a new key stay, rows of a stored key do not come again."""
    path = f"{scratch(spark, 'append')}/t"
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    tables.append_new(docs.filter("lang = 'en'").withColumn("key", F.col("lang")), path, "key")
    tables.append_new(docs.withColumn("key", F.col("lang")), path, "key")
    return spark.read.parquet(path).drop("key")


@query("t02_stream_raw_to_processed", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def t02(spark, d):
    root = scratch(spark, "move")
    done = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(
        F.col("l_orderkey").cast("string").alias("Incident_Number"), "l_linestatus")
    done.repartition("Incident_Number").write.parquet(f"{root}/scored")
    stream = spark.readStream.schema("Incident_Number string, l_linestatus string").option("maxFilesPerTrigger", 4).parquet(f"{root}/scored")
    ingest.move_batches(stream, f"{root}/processed", f"{root}/state").awaitTermination()
    raw = table(spark, d, "orders").select(F.col("o_orderkey").alias("Incident_Number"))
    left = ingest.raw_left(raw, spark.read.parquet(f"{root}/processed"))
    return left.select(F.col("Incident_Number").cast("bigint").alias("o_orderkey"))


DAILY_SQL = """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS sum_value FROM events GROUP BY 1, 2"""


@query("t03_stream_daily_counts", DAILY_SQL)
def t03(spark, d):
    root = scratch(spark, "daily")
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.repartitionByRange("ts").sortWithinPartitions("ts").write.parquet(f"{root}/events")
    stream = spark.readStream.schema(e.schema).parquet(f"{root}/events")
    out = ingest.daily_counts(stream, "ts", ["value"], "2 days", "event_type")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/daily/batch_id={batch_id}")

    q = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{root}/daily")
    last = rows.groupBy("day", "event_type").agg(F.max_by(F.struct("n", "sum_value"), "batch_id").alias("x"))
    return last.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "x.n", F.round("x.sum_value", 4).alias("sum_value"))


@query("t03_batch_daily_counts", DAILY_SQL)
def t03b(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ingest.daily_counts(e, "ts", ["value"], "2 days", "event_type")
    return out.withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "sum_value": F.round("sum_value", 4)})
