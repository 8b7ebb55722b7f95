"""Dashboard, reshaping, joins and sinks on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from incidentry.operators import match, metrics, profile, report, splits
from incidentry.operators.ranks import global_rank
from incidentry.plans import views
from incidentry.plans.catalog import query, scratch, table
from incidentry.plans.views import COUNTED_SQL, INCIDENTS_SQL, SCORED_SQL, with_
from incidentry.sources import documents, tables

INC = with_(INCIDENTS_SQL)
SUMS = ", ".join(f"CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}" for m in report.MEASURES)
STATES = [f"NATION_{i}" for i in range(0, 25)]
YEARS = list(range(1992, 2002))


@query("flagship_region_timeline", INC + f"""
, named AS (SELECT *, upper(substr(state, 1, 1)) || lower(substr(state, 2)) AS key FROM incidents
            WHERE date IS NOT NULL AND state IS NOT NULL),
months AS (SELECT last_day(date) AS m, count(*) AS n FROM named GROUP BY 1),
spine AS (SELECT last_day(CAST(x AS DATE)) AS m FROM (SELECT unnest(generate_series(
            (SELECT date_trunc('month', min(m)) FROM months), (SELECT max(m) FROM months), INTERVAL 1 MONTH)) AS x)),
per AS (SELECT last_day(date) AS m, region, count(*) AS incidents, CAST(sum(total_fatalities) AS BIGINT) AS fatalities,
               CAST(sum(CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent
        FROM named GROUP BY 1, 2)
SELECT strftime(spine.m, '%Y-%m-%d') AS month_end, r_name AS region, coalesce(incidents, 0) AS incidents,
       coalesce(fatalities, 0) AS fatalities, coalesce(urgent, 0) AS urgent
FROM spine CROSS JOIN region LEFT JOIN per ON per.m = spine.m AND per.region = r_name""")
def flagship(spark, d):
    """Null-safe filter, recode, month spine, region fill: every region and month, empty ones as 0."""
    inc = views.incidents(spark, d).filter("date is not null and state is not null")
    per = inc.withColumn("urgent", (F.col("priority") == "1-URGENT").cast("int")).groupBy(
        F.last_day("date").alias("month_end"), "region").agg(
        F.count("*").alias("incidents"), F.sum("total_fatalities").alias("fatalities"), F.sum("urgent").alias("urgent"))
    months = report.monthly_timeline(inc, "date", "_n").agg(F.min("month_end").alias("a"), F.max("month_end").alias("b"))
    span = months.select(F.transform(F.sequence(
        F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month")), F.last_day)).scalar()
    grid = table(spark, d, "region").select(F.col("r_name").alias("region"), F.explode(span).alias("month_end"))
    filled = grid.join(per, ["month_end", "region"], "left").na.fill(0)
    return filled.withColumn("month_end", F.date_format("month_end", "yyyy-MM-dd"))


@query("a01_counts_with_null_group", INC + "SELECT state, count(*) AS n FROM incidents GROUP BY state")
def a01(spark, d):
    return report.counts_by(views.incidents(spark, d), "state", keep_null=True)


@query("a02_distinct_values", "SELECT DISTINCT o_orderpriority AS priority, o_orderstatus AS status FROM orders")
def a02(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).distinct()


@query("a04_exact_row_dedup", "SELECT DISTINCT lang, source, n_chars FROM documents")
def a04(spark, d):
    return table(spark, d, "documents").select("lang", "source", "n_chars").dropDuplicates()


@query("a05_key_figures", INC + f"SELECT count(*) AS total_incidents, {SUMS} FROM incidents")
def a05(spark, d):
    return report.key_figures(views.incidents(spark, d))


@query("a06_deadliest_state", INC + """SELECT state, CAST(sum(total_fatalities) AS BIGINT) AS total_fatalities
FROM incidents WHERE state IS NOT NULL GROUP BY state ORDER BY 2 DESC, 1 LIMIT 1""")
def a06(spark, d):
    return report.top_group(views.incidents(spark, d), "state", "total_fatalities")


MONTHLY_SQL = """
, m AS (SELECT last_day(date) AS m, count(*) AS n FROM incidents WHERE date IS NOT NULL GROUP BY 1),
s AS (SELECT last_day(CAST(x AS DATE)) AS m FROM (SELECT unnest(generate_series(
  (SELECT date_trunc('month', min(m)) FROM m), (SELECT max(m) FROM m), INTERVAL 1 MONTH)) AS x))
SELECT strftime(s.m, '%Y-%m-%d') AS month_end, coalesce(n, 0) AS incidents FROM s LEFT JOIN m USING (m)"""


@query("a07_monthly_timeline", INC + MONTHLY_SQL)
def a07(spark, d):
    return report.monthly_timeline(views.incidents(spark, d), "date").withColumn(
        "month_end", F.date_format("month_end", "yyyy-MM-dd"))


@query("a07_event_timeline_sparse", """
WITH m AS (SELECT last_day(CAST(ts AS DATE)) AS m, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
s AS (SELECT last_day(CAST(x AS DATE)) AS m FROM (SELECT unnest(generate_series(
  (SELECT date_trunc('month', min(m)) FROM m), (SELECT max(m) FROM m), INTERVAL 1 MONTH)) AS x))
SELECT strftime(s.m, '%Y-%m-%d') AS month_end, coalesce(n, 0) AS events FROM s LEFT JOIN m USING (m)""")
def a07b(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").withColumn("day", F.to_date("ts"))
    return report.monthly_timeline(e, "day", "events").withColumn("month_end", F.date_format("month_end", "yyyy-MM-dd"))


@query("a08_state_totals", INC + f"""SELECT state, count(incident_number) AS total_incidents, {SUMS}
FROM incidents WHERE state IS NOT NULL GROUP BY state""")
def a08(spark, d):
    return report.totals_by(views.incidents(spark, d), "state", "incident_number")


@query("j07_region_fill", INC + f"""
, t AS (SELECT state, count(incident_number) AS total_incidents, {SUMS} FROM incidents
        WHERE state IS NOT NULL AND priority = '1-URGENT' AND total_fatalities = 9 AND segment = 'MACHINERY' GROUP BY state)
SELECT upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS region_name,
       coalesce(total_incidents, 0) AS total_incidents,
       {", ".join(f"coalesce({m}, 0) AS {m}" for m in report.MEASURES)}
FROM nation LEFT JOIN t ON n_name = state""")
def j07(spark, d):
    inc = views.incidents(spark, d).filter("priority = '1-URGENT' and total_fatalities = 9 and segment = 'MACHINERY'")
    return report.fill_regions(report.totals_by(inc, "state", "incident_number"), table(spark, d, "nation"), "n_name")


@query("a09_indicator_totals", with_(views.CODED_SQL) + """
, f AS (SELECT CAST(sum(CASE WHEN 'Armed Assault' IN (coalesce(first_action, ''), coalesce(second_action, ''), coalesce(third_action, '')) THEN 1 ELSE 0 END) AS BIGINT) AS a,
               CAST(sum(CASE WHEN 'Bombing' IN (coalesce(first_action, ''), coalesce(second_action, ''), coalesce(third_action, '')) THEN 1 ELSE 0 END) AS BIGINT) AS b,
               CAST(sum(CASE WHEN 'Surrender' IN (coalesce(first_action, ''), coalesce(second_action, ''), coalesce(third_action, '')) THEN 1 ELSE 0 END) AS BIGINT) AS c
        FROM coded)
SELECT indicator, total, round(total / CAST(a + b + c AS DOUBLE), 6) AS share FROM f,
  LATERAL (VALUES ('armed_assault', a), ('bombing', b), ('surrender', c)) AS v(indicator, total)""")
def a09(spark, d):
    from incidentry.functions.recode import action_flags

    coded = views.coded(spark, d).withColumns(action_flags())
    out = report.indicator_totals(coded, ["armed_assault", "bombing", "surrender"])
    return out.withColumn("share", F.round("share", 6))


@query("a10_state_year_pivot", INC + "SELECT state, " + ", ".join(
    f'CAST(count(*) FILTER (year(date) = {y}) AS BIGINT) AS "{y}"' for y in YEARS)
    + " FROM incidents WHERE state IS NOT NULL AND date IS NOT NULL GROUP BY state")
def a10(spark, d):
    inc = views.incidents(spark, d).withColumn("year", F.year("date"))
    return report.pivot_counts(inc, "state", "year", YEARS)


@query("a11_daily_sums", INC + """SELECT strftime(date, '%Y-%m-%d') AS date, CAST(sum(total_fatalities) AS BIGINT) AS total_fatalities,
CAST(sum(total_injuries) AS BIGINT) AS total_injuries FROM incidents WHERE date IS NOT NULL GROUP BY 1""")
def a11(spark, d):
    out = report.daily_sums(views.incidents(spark, d), "date", ["total_fatalities", "total_injuries"])
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("a12_month_of_year", INC + """SELECT CAST(month(date) AS INTEGER) AS month, count(*) AS n FROM incidents
WHERE date IS NOT NULL GROUP BY 1""")
def a12(spark, d):
    return report.counts_by(report.dashboard_rows(views.incidents(spark, d), "date"), "month")


@query("p15_state_year_filter", INC + """SELECT state, count(*) AS n FROM incidents
WHERE state IN ('NATION_1', 'NATION_7', 'NATION_20') AND year(date) BETWEEN 1994 AND 1996 GROUP BY state""")
def p15(spark, d):
    inc = report.dashboard_rows(views.incidents(spark, d), "date")
    return report.select_rows(inc, ["NATION_1", "NATION_7", "NATION_20"], (1994, 1996)).groupBy("state").agg(
        F.count("*").alias("n"))


@query("k01_top_states", INC + """SELECT state, count(*) AS n FROM incidents WHERE state IS NOT NULL
GROUP BY state ORDER BY n DESC, state LIMIT 10""")
def k01(spark, d):
    return report.top_counts(views.incidents(spark, d), "state", 10)


@query("k02_sheet_head", "SELECT o_orderkey AS incident_number, o_orderstatus AS status FROM orders ORDER BY o_orderkey LIMIT 25")
def k02(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("incident_number"), F.col("o_orderstatus").alias("status"))
    return report.first_rows(o, "incident_number", 25)


@query("k03_top_mismatches", with_(views.CLASSED_SQL) + """SELECT true_label || ' > ' || pred_label AS mismatch, count(*) AS n
FROM classed WHERE true_label <> pred_label GROUP BY 1 ORDER BY n DESC, mismatch LIMIT 5""")
def k03(spark, d):
    c = views.classed(spark, d).filter("true_label <> pred_label")
    return report.top_counts(c.withColumn("mismatch", F.concat_ws(" > ", "true_label", "pred_label")), "mismatch", 5)


@query("w03_cumulative_years", INC + """
, y AS (SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n FROM incidents WHERE date IS NOT NULL GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY year) * 100.0 / sum(n) OVER () AS pct,
             (sum(n) OVER (ORDER BY year) - n) * 100.0 / sum(n) OVER () AS before FROM y)
SELECT year, n, round(pct, 6) AS cum_percent, pct >= 80 AND before < 80 AS reaches_80, pct >= 90 AND before < 90 AS reaches_90 FROM c""")
def w03(spark, d):
    inc = views.incidents(spark, d).withColumn("year", F.year("date"))
    return report.cumulative_years(inc).withColumn("cum_percent", F.round("cum_percent", 6))


@query("j05_wide_model_merge", with_(SCORED_SQL) + """SELECT d.doc_id AS row_id,
  max(CASE WHEN model = 'base' THEN pred END) AS base, max(CASE WHEN model = 'large' THEN pred END) AS large
FROM documents d LEFT JOIN long ON long.row_id = d.doc_id AND label = 'toxic' GROUP BY 1""")
def j05(spark, d):
    runs = views.scored(spark, d).filter("label = 'toxic'")
    base = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"))
    return report.wide_models(runs, base, "row_id", ["base", "large"], value="pred")


@query("j03_j04_manual_coordinates", """
SELECT p_partkey AS incident_number, s_acctbal AS latitude, CAST(s_suppkey AS VARCHAR) AS matched_id
FROM part LEFT JOIN supplier ON CAST(p_partkey AS VARCHAR) = CAST(s_suppkey AS VARCHAR)""")
def j03(spark, d):
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("incident_number"), F.col("s_acctbal").alias("latitude"),
        F.col("s_suppkey").cast("string").alias("matched_id"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("incident_number"))
    return splits.fields_by_id(p, s, "incident_number", ["latitude", "matched_id"], ["matched_id"])


@query("j06_baseline_pairs", with_(COUNTED_SQL) + """SELECT incident_number, true_label, baseline AS prediction_baseline,
prediction AS prediction_model FROM counted""")
def j06(spark, d):
    c = views.counted(spark, d)
    base = c.select("incident_number", "true_label", F.col("baseline").alias("prediction"))
    return match.pair_with_baseline(base, c.select("incident_number", "true_label", "prediction"))


@query("j10_labels_in_training", """SELECT count(*) AS n, count(DISTINCT lang) AS labels FROM documents
WHERE lang IN (SELECT lang FROM documents WHERE source = 'src1' AND n_chars < 100)""")
def j10(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", "n_chars")
    kept = splits.keep_known_labels(docs, docs.filter("source = 'src1' and n_chars < 100"), "lang")
    return kept.agg(F.count("*").alias("n"), F.countDistinct("lang").alias("labels"))


@query("j18_fields_reattached", """
WITH r AS (SELECT l_orderkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS rn FROM lineitem)
SELECT o_orderkey, l_returnflag, l_linestatus FROM orders LEFT JOIN r ON o_orderkey = l_orderkey AND rn = 1""")
def j18(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return splits.fields_by_id(
        table(spark, d, "orders").select("o_orderkey"), li, "o_orderkey", ["l_returnflag", "l_linestatus"],
        ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"])


@query("w13_first_per_district_state", with_(views.PLACES_SQL) + """SELECT district, state,
  arg_min(village_name, incident_number) FILTER (village_name IS NOT NULL) AS village_name,
  arg_min(other_areas, incident_number) FILTER (other_areas IS NOT NULL) AS other_areas
FROM places GROUP BY district, state""")
def w13(spark, d):
    p = views.places(spark, d)
    key = F.col("incident_number")
    return p.groupBy("district", "state").agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(c) for c in ("village_name", "other_areas")])


@query("u01_stack_runs", """SELECT 'orders' AS run, o_orderkey AS id, o_orderstatus AS flag, NULL::DOUBLE AS value FROM orders
UNION ALL SELECT 'lines', l_orderkey, l_returnflag, l_quantity FROM lineitem""")
def u01(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("flag"))
    b = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("value"))
    return report.stack_runs([report.tag_run(a, run="orders"), report.tag_run(b, run="lines")])


@query("u02_union_first_kept", """SELECT coalesce(l.doc_id, d.doc_id) AS doc_id,
  CASE WHEN l.doc_id IS NOT NULL THEN 'labels' ELSE 'documents' END AS origin
FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id""")
def u02(spark, d):
    a = table(spark, d, "labels").select("doc_id", F.lit("labels").alias("origin"))
    b = table(spark, d, "documents").select("doc_id", F.lit("documents").alias("origin"))
    return report.union_first([a, b], "doc_id")


@query("u04_j15_wide_to_long", """SELECT doc_id AS row_id, label, truth, pred FROM (
  SELECT doc_id, 'quality' AS label, quality AS truth, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS pred FROM labels
  UNION ALL SELECT doc_id, 'toxic', toxic, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END FROM labels)""")
def u04(spark, d):
    wide = table(spark, d, "labels").select(
        F.col("doc_id").alias("row_id"), F.col("quality").alias("true_quality"), F.col("toxic").alias("true_toxic"),
        (F.col("doc_id") % 3 == 0).cast("int").alias("pred_quality"),
        (F.col("doc_id") % 4 == 0).cast("int").alias("pred_toxic"))
    return metrics.to_long(wide, ["row_id"], ["quality", "toxic"], probs=False)


@query("u05_long_to_wide", """SELECT l_orderkey AS id, sum(l_quantity) FILTER (l_returnflag = 'A') AS "A",
sum(l_quantity) FILTER (l_returnflag = 'N') AS "N", sum(l_quantity) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""")
def u05(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return report.spread(li, ["id"], F.col("l_returnflag"), "q", ["A", "N", "R"])


@query("u06_question_rows", INC + """
SELECT incident_number, 'question: ' || q || ' context: ' || priority AS input_text, CAST(n AS VARCHAR) || ' ' || noun AS target_text
FROM incidents, LATERAL (VALUES ('How many injuries occurred in the incident?', total_injuries, 'injuries'),
 ('How many arrests were made in the incident?', total_arrests, 'arrests'),
 ('How many people surrendered in the incident?', total_surrenders, 'surrenders'),
 ('How many fatalities occurred in the incident?', total_fatalities, 'fatalities'),
 ('How many people were abducted in the incident?', total_abducted, 'abducted')) AS v(q, n, noun)""")
def u06(spark, d):
    inc = views.incidents(spark, d).select("incident_number", "priority", *report.MEASURES)
    return report.question_rows(inc, "priority").select("incident_number", "input_text", "target_text")


@query("u07_synthetic_rows", """SELECT doc_id, 0 AS is_synthetic, NULL::VARCHAR AS synthetic_source FROM labels
UNION ALL SELECT doc_id, 1, 'copy' FROM labels WHERE toxic = 1""")
def u07(spark, d):
    lab = table(spark, d, "labels")
    return report.with_synthetic(lab.select("doc_id"), lab.filter("toxic = 1").select("doc_id"), "copy")


@query("u08_combined_predictions", with_(COUNTED_SQL) + """SELECT 'guess' AS model, incident_number, true_label, prediction FROM counted
UNION ALL SELECT 'baseline', incident_number, true_label, baseline FROM counted""")
def u08(spark, d):
    c = views.counted(spark, d)
    other = c.withColumn("prediction", F.col("baseline"))
    return report.combined_predictions({"guess": c, "baseline": other}, ["incident_number", "true_label", "prediction"])


@query("u09_tagged_runs", """SELECT doc_id, fraction, strategy FROM labels,
(VALUES (0.5::DOUBLE, 'baseline'), (1.0::DOUBLE, 'focal_tuned')) AS v(fraction, strategy)""")
def u09(spark, d):
    lab = table(spark, d, "labels").select("doc_id")
    return report.stack_runs([
        report.tag_run(lab, fraction=0.5, strategy="baseline"), report.tag_run(lab, fraction=1.0, strategy="focal_tuned")])


@query("w17_w18_heatmap_order", with_(views.CLASSED_SQL) + """
, s AS (SELECT model, true_label AS label, avg(CASE WHEN true_label = pred_label THEN 1.0 ELSE 0.0 END) AS score FROM classed GROUP BY 1, 2),
l AS (SELECT label, row_number() OVER (ORDER BY avg(score) DESC, label) AS label_rank FROM s GROUP BY label),
m AS (SELECT model, row_number() OVER (ORDER BY avg(score), model) AS model_rank FROM s GROUP BY model)
SELECT model, label, round(score, 6) AS score, CAST(label_rank AS INTEGER) AS label_rank, CAST(model_rank AS INTEGER) AS model_rank
FROM s JOIN l USING (label) JOIN m USING (model)""")
def w17(spark, d):
    s = views.classed(spark, d).groupBy("model", F.col("true_label").alias("label")).agg(
        F.avg((F.col("true_label") == F.col("pred_label")).cast("double")).alias("score"))
    out = report.order_by_mean(s, {"label": True, "model": False}, "score")
    return out.withColumn("score", F.round("score", 6))


@query("w02_w19_k04_best_model_per_label", with_(views.CLASSED_SQL) + """
, s AS (SELECT model, true_label AS label, avg(CASE WHEN true_label = pred_label THEN 1.0 ELSE 0.0 END) AS score FROM classed GROUP BY 1, 2)
SELECT label, model, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, model) AS rn FROM s) WHERE rn = 1""")
def w19(spark, d):
    s = views.classed(spark, d).groupBy("model", F.col("true_label").alias("label")).agg(
        F.avg((F.col("true_label") == F.col("pred_label")).cast("double")).alias("score"))
    return report.best_per(s, "label", "model", "score").withColumn("score", F.round("score", 6))


@query("p28_chat_messages", """
SELECT conv_id, turn, 'system' || '|' || 'Code the incident.' || '~' || 'user' || '|' || 'Text: Two men were held.' || chr(10) || 'Label:' || '~'
  || 'assistant' || '|' || 'Arrest' || '~' || 'user' || '|' || 'Text: ' || text || chr(10) || 'Label:' AS messages
FROM conversations WHERE role = 'user'""")
def p28(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'")
    m = report.chat_messages(F.col("text"), "Code the incident.", "Text: {text}\nLabel:", [("Two men were held.", "Arrest")])
    flat = F.array_join(F.transform(m, lambda x: F.concat_ws("|", x.role, x.content)), "~")
    return c.select("conv_id", "turn", flat.alias("messages"))


@query("p29_task_text", """SELECT conv_id, turn,
 'answer_me: How many people were killed? Answer with only a number. context: ' || text AS count_task,
 'Extract location hierarchy from incident: ' || text || chr(10) || 'Format: state: <name>, district: <name>, village: <name>, other_locations: <name>. Use exact format with labels. Omit missing levels.' AS place_task
FROM conversations""")
def p29(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", report.count_task_text(F.col("text"), "nt5").alias("count_task"),
        report.place_task_text(F.col("text")).alias("place_task"))


@query("a13_match_rate", """SELECT count(*) AS total_rows, count(l_orderkey) AS matched_rows,
round(count(l_orderkey) * 100.0 / count(*), 6) AS percent_matched
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey""")
def a13(spark, d):
    r = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey").distinct()
    m = table(spark, d, "orders").join(r, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return match.match_rate(m, "l_orderkey").withColumn("percent_matched", F.round("percent_matched", 6))


@query("s07_append_only_new", """SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def s07(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return tables.unseen(docs, table(spark, d, "labels"), "doc_id")


@query("s08_sheet_values", """SELECT o_orderkey AS id, CASE WHEN o_totalprice % 3 < 1 THEN NULL ELSE o_totalprice END AS amount,
CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS status FROM orders""")
def s08(spark, d):
    price = F.col("o_totalprice")
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(price % 3 < 1, F.lit(float("inf"))).otherwise(price).alias("amount"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"))
    return tables.sheet_values(o)


@query("s09_u03_j09_raw_minus_processed", """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN
(SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def s09(spark, d):
    raw = table(spark, d, "orders").select(F.col("o_orderkey"), "o_orderstatus")
    done = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(
        F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit(" ")).alias("o_orderkey")).distinct()
    return tables.remaining(raw, done, "o_orderkey").withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query("s10_dashboard_sheet", """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS date,
CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders""")
def s10(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("date"))
    return report.dashboard_rows(o, "date").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("s15_pending_work", """SELECT d.doc_id, m.model FROM documents d, (VALUES ('base'), ('large')) AS m(model)
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (m.model = 'base' OR l.toxic = 1))""")
def s15(spark, d):
    work = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit("base"), F.lit("large"))).alias("model"))
    done = table(spark, d, "labels").select("doc_id", F.explode(F.when(F.col("toxic") == 1, F.array(
        F.lit("base"), F.lit("large"))).otherwise(F.array(F.lit("base")))).alias("model"))
    return tables.pending(work, done, ["doc_id", "model"])


METRIC_DOC_SQL = with_(SCORED_SQL) + """
, k AS (SELECT model, label, sum(truth * pred) AS tp, sum((1 - truth) * pred) AS fp, sum(truth * (1 - pred)) AS fn FROM long GROUP BY 1, 2)"""


def _metric_docs(spark, d):
    per = metrics.strategy_scores(views.scored(spark, d), "model").select("model", "label", "precision", "recall", "f1")
    overall = per.groupBy("model").agg(F.avg("f1").alias("macro_f1"))
    docs = documents.metrics_document(overall, per, "model", "label", "per_label")
    return docs.select("model", F.from_json("document", documents.METRICS_SCHEMA).alias("x")).select("model", "x.*")


@query("s11_s12_metrics_round_trip", METRIC_DOC_SQL + """
, f AS (SELECT model, label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
   CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
   CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1 FROM k)
SELECT model, 'per_label' AS section, label AS part, metric, round(value, 6) AS value FROM f,
  LATERAL (VALUES ('precision', precision), ('recall', recall), ('f1', f1)) AS v(metric, value)
UNION ALL SELECT model, 'overall', NULL, 'macro_f1', round(avg(f1), 6) FROM f GROUP BY model""")
def s11(spark, d):
    rows = documents.metric_rows(_metric_docs(spark, d))
    return rows.filter("value is not null").withColumn("value", F.round("value", 6))


@query("s13_s14_b12_flat_metrics", METRIC_DOC_SQL + """
SELECT model, round(max(CASE WHEN label = 'quality' THEN tp / (tp + fp)::DOUBLE END), 6) AS quality_precision,
  round(max(CASE WHEN label = 'quality' THEN tp / (tp + fn)::DOUBLE END), 6) AS quality_recall,
  round(max(CASE WHEN label = 'quality' THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END), 6) AS quality_f1,
  round(max(CASE WHEN label = 'toxic' THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END), 6) AS toxic_f1
FROM k GROUP BY model""")
def s13(spark, d):
    rows = documents.metric_rows(_metric_docs(spark, d)).filter("section = 'per_label'")
    names = ["quality_precision", "quality_recall", "quality_f1", "toxic_f1"]
    wide = report.spread(rows, ["model"], documents.flat_name(F.col("part"), F.col("metric")), "value", names)
    return wide.select("model", *[F.round(n, 6).alias(n) for n in names])


@query("s16_nested_gazetteer", """SELECT DISTINCT r_name AS state, n_name AS district, c_mktsegment AS village,
CAST(n_nationkey AS VARCHAR) AS latitude, CAST(r_regionkey AS VARCHAR) AS longitude
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def s16(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "r_name", "n_name", "c_mktsegment", "n_nationkey", "r_regionkey").distinct()
    point = F.struct(F.col("n_nationkey").cast("string").alias("Latitude"), F.col("r_regionkey").cast("string").alias("Longitude"))
    v = c.groupBy("r_name", "n_name").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", point))).alias("v"))
    s = v.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "v"))).alias("d"))
    docs = s.select(F.to_json(F.create_map("r_name", "d")).alias("doc"))
    return documents.flat_gazetteer(docs, "doc")


@query("a50_right_closed_histogram", with_(COUNTED_SQL) + """
, b AS (SELECT CASE WHEN true_label > 9 THEN 5 WHEN true_label > 4 THEN 4 WHEN true_label > 2 THEN 3 WHEN true_label > 1 THEN 2
        WHEN true_label > 0 THEN 1 ELSE 0 END AS bin FROM counted)
SELECT bin, count(*) AS n, round(count(*) / (SELECT count(*) FROM b)::DOUBLE, 6) AS proportion FROM b GROUP BY bin""")
def a50(spark, d):
    out = profile.histogram(views.counted(spark, d), "true_label", [0, 1, 2, 4, 9])
    return out.withColumn("proportion", F.round("proportion", 6))


@query("k05_chronological", INC + """SELECT incident_number, CAST(row_number() OVER (ORDER BY date NULLS LAST, incident_number) AS BIGINT) AS position FROM incidents""")
def k05(spark, d):
    inc = views.incidents(spark, d).select("incident_number", "date")
    ranked = global_rank(inc, [F.col("date").asc_nulls_last(), F.col("incident_number").asc()], "position")
    return ranked.select("incident_number", "position")


@query("s01_s03_csv_round_trip", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text || ' "quoted", ' || chr(10) || lang) AS digest FROM documents""")
def s01(spark, d):
    path = scratch(spark, "csv")
    docs = table(spark, d, "documents").select(
        "doc_id", F.concat("text", F.lit(' "quoted", \n'), "lang").alias("text"))
    tables.write_csv(docs, path)
    back = tables.read_csv(spark, path, as_text=True)
    return back.select("doc_id", F.md5("text").alias("digest"))
