"""Fuzzy matching, names in texts, entity spans, embeddings on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from incidentry.functions import spans
from incidentry.functions.similarity import close_enough, gestalt_ratio, indel_ratio, jaro_distance
from incidentry.operators import entities, match, profile, weights
from incidentry.plans import jobs, views
from incidentry.plans.catalog import query, table
from incidentry.plans.views import PLACES_SQL, with_
from incidentry.session import spread

PLA = with_(PLACES_SQL)

# Part names with a letter dropped, two letters exchanged, or left alone; brand as state, type as district.
ALTERED_SQL = """altered AS (SELECT p_partkey AS incident_number, lower(p_brand) AS state_name,
  CASE WHEN p_partkey % 4 = 0 THEN substr(lower(p_type), 1, length(p_type) - 1) ELSE lower(p_type) END AS district_name,
  CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, 2) || substr(p_name, 4)
    ELSE substr(p_name, 1, 1) || substr(p_name, 3, 1) || substr(p_name, 2, 1) || substr(p_name, 4) END AS village_name, p_name FROM part)"""
GAZ_SQL = """gaz AS (SELECT lower(p_brand) AS state_name, lower(p_type) AS district_name, p_name AS village_name, min(p_partkey) AS gaz_id
  FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1, 2, 3)"""


def altered(spark, d):
    k, n = F.col("p_partkey"), F.col("p_name")
    kind = F.lower("p_type")
    return table(spark, d, "part").select(
        k.alias("incident_number"), F.lower("p_brand").alias("state_name"),
        F.when(k % 4 == 0, kind.substr(F.lit(1), F.length(kind) - 1)).otherwise(kind).alias("district_name"),
        F.when(k % 3 == 0, n).when(k % 3 == 1, F.concat(F.substring(n, 1, 2), F.substring(n, 4, 1000)))
        .otherwise(F.concat(F.substring(n, 1, 1), F.substring(n, 3, 1), F.substring(n, 2, 1), F.substring(n, 4, 1000)))
        .alias("village_name"), "p_name")


def gazetteer(spark, d):
    return table(spark, d, "part").filter("p_partkey % 5 <> 0").select(
        F.lower("p_brand").alias("state_name"), F.lower("p_type").alias("district_name"),
        F.col("p_name").alias("village_name"), F.col("p_partkey").alias("gaz_id"))


@query("f17_jaro_distance", with_(ALTERED_SQL) + "SELECT incident_number, round(1 - jaro_similarity(village_name, p_name), 6) AS distance FROM altered")
def f17(spark, d):
    return altered(spark, d).select("incident_number", F.round(jaro_distance(F.col("village_name"), F.col("p_name")), 6).alias("distance"))


@query("f18_levenshtein", with_(ALTERED_SQL) + """SELECT incident_number, CAST(CASE WHEN levenshtein(village_name, p_name) <= 1 THEN levenshtein(village_name, p_name) ELSE -1 END AS INTEGER) AS distance FROM altered""")
def f18(spark, d):
    return altered(spark, d).select("incident_number", F.levenshtein("village_name", "p_name", 1).alias("distance"))


@query("f19_f20_ratios", """SELECT p_partkey, round(2.0 * (length(p_name) - 1) / (2 * length(p_name) - 1), 6) AS gestalt, round(200.0 * (length(p_name) - 1) / (2 * length(p_name) - 1), 6) AS indel,
 200.0 * (length(p_name) - 1) / (2 * length(p_name) - 1) >= 95 AS close FROM part""")
def f19(spark, d):
    p = table(spark, d, "part")
    short = F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 1000))
    return p.select(
        "p_partkey", F.round(gestalt_ratio(short, "p_name"), 6).alias("gestalt"),
        F.round(indel_ratio(short, "p_name"), 6).alias("indel"), close_enough(F.upper(short), F.col("p_name"), 95.0).alias("close"))


@query("a19_similarity_bands", with_(ALTERED_SQL) + """, s AS (SELECT jaro_similarity(village_name, p_name) AS s FROM altered)
SELECT count(*) FILTER (s = 1) AS identical, count(*) FILTER (s >= 0.8) AS high, count(*) FILTER (s >= 0.5 AND s < 0.8) AS medium, count(*) FILTER (s < 0.5) AS low,
 round(avg(s), 6) AS mean, round(min(s), 6) AS min, round(max(s), 6) AS max, round(quantile_cont(s, 0.5), 6) AS median FROM s""")
def a19(spark, d):
    s = altered(spark, d).select((1 - jaro_distance(F.col("village_name"), F.col("p_name"))).alias("s"))
    out = profile.similarity_bands(s, "s")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "min", "max", "median")})


@query("j01_j02_best_gazetteer_match", with_(ALTERED_SQL, GAZ_SQL) + """, c AS (SELECT a.incident_number, g.gaz_id, g.district_name AS gd, g.village_name AS gv,
   1 - jaro_similarity(a.district_name, g.district_name) AS dd, 1 - jaro_similarity(a.village_name, g.village_name) AS vd
   FROM altered a JOIN gaz g USING (state_name)),
 r AS (SELECT *, row_number() OVER (PARTITION BY incident_number ORDER BY round(dd + vd, 9), gaz_id) AS rn FROM c WHERE dd <= 0.4 + 1e-9 AND vd <= 0.4 + 1e-9)
SELECT a.incident_number, gd AS gaz_district, gv AS gaz_village, r.gaz_id, round(dd, 6) AS district_dist, round(vd, 6) AS village_dist
FROM altered a LEFT JOIN r ON r.incident_number = a.incident_number AND rn = 1""")
def j01(spark, d):
    out = match.best_gazetteer_match(altered(spark, d).drop("p_name"), gazetteer(spark, d))
    return out.select("incident_number", "gaz_district", "gaz_village", "gaz_id",
                      F.round("district_dist", 6).alias("district_dist"), F.round("village_dist", 6).alias("village_dist"))


@query("j01_locate_job", with_(ALTERED_SQL, GAZ_SQL) + """, c AS (SELECT a.incident_number, g.gaz_id, 1 - jaro_similarity(a.district_name, g.district_name) AS dd, 1 - jaro_similarity(a.village_name, g.village_name) AS vd
   FROM altered a JOIN gaz g USING (state_name) WHERE a.incident_number % 2 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY incident_number ORDER BY round(dd + vd, 9), gaz_id) AS rn FROM c WHERE dd <= 0.2 + 1e-9 AND vd <= 0.2 + 1e-9)
SELECT a.incident_number, r.gaz_id, CAST(r.gaz_id AS DOUBLE) / 10 AS latitude FROM altered a LEFT JOIN r ON r.incident_number = a.incident_number AND rn = 1""")
def j01b(spark, d):
    a = altered(spark, d).withColumn("prediction", F.concat(
        F.lit("state: "), F.upper("state_name"), F.lit(", district: "), "district_name",
        F.when(F.col("incident_number") % 2 == 0, F.concat(F.lit(", village: "), "village_name")).otherwise("")))
    g = gazetteer(spark, d).withColumns({"latitude": F.col("gaz_id") / 10, "longitude": F.lit(70.0)})
    return jobs.locate(a.select("incident_number", "prediction"), g, max_dist=0.2).select("incident_number", "gaz_id", "latitude")


@query("j12_n01_names_in_texts", """WITH f AS (SELECT d.doc_id, b.item_id, instr(lower(d.text), lower(b.text)) - 1 AS at, row_number() OVER (PARTITION BY d.doc_id ORDER BY b.item_id) AS rn
  FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT d.doc_id, CAST(coalesce(f.at, -1) AS INTEGER) AS start, md5(b.text) AS found FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id AND rn = 1 LEFT JOIN benchmark b USING (item_id)""")
def j12(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = match.first_name_in_text(docs, table(spark, d, "benchmark"), "doc_id", "text", "text", "item_id", "found")
    return out.select("doc_id", spans.exact_span(F.col("text"), F.col("found")).alias("start"), F.md5("found").alias("found"))


J12_BY_TOKENS = """WITH n AS (SELECT p_name AS n, min(p_partkey) AS p FROM part GROUP BY 1),
 t AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'at pre' || p_name || 'ia today' WHEN 1 THEN 'no name here' ELSE 'both ' || p_name || ' and small box' END AS text FROM part)
SELECT id, (SELECT arg_min(n, p) FROM n WHERE contains(t.text, n)) AS found FROM t"""


@query("j12_names_in_texts_by_tokens", J12_BY_TOKENS)
def j12b(spark, d):
    p = table(spark, d, "part")
    k, n = F.col("p_partkey"), F.col("p_name")
    texts = p.select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("at pre"), n, F.lit("ia today"))).when(
        k % 3 == 1, "no name here").otherwise(F.concat(F.lit("both "), n, F.lit(" and small box"))).alias("text"))
    listed = p.groupBy(n.alias("n")).agg(F.min("p_partkey").alias("p"))
    return match.first_name_in_text(texts, listed, "id", "text", "n", "p", "found").select("id", "found")


@query("j13_district_by_keyword", """WITH n AS (SELECT p_name AS n, min(p_partkey) AS p FROM part GROUP BY 1),
 t AS (SELECT p_partkey AS id, p_name, p_partkey % 4 AS k, lower(CASE p_partkey % 4 WHEN 0 THEN 'Men of ' || replace(p_name, ' ', '-') || ' district met'
   WHEN 1 THEN 'From the ' || split_part(p_name, ' ', 1) || ' ' || p_name || ' District' WHEN 2 THEN 'Troops reached ' || p_name ELSE 'Nothing is named' END) AS text FROM part)
SELECT id, CASE WHEN k = 0 THEN p_name ELSE coalesce((SELECT arg_min(n, p) FROM n WHERE contains(t.text, n)), '') END AS found_district FROM t""")
def j13(spark, d):
    p = table(spark, d, "part")
    k, n = F.col("p_partkey"), F.col("p_name")
    texts = p.select(k.alias("id"), F.when(k % 4 == 0, F.concat(F.lit("Men of "), F.replace(n, F.lit(" "), F.lit("-")), F.lit(" district met")))
                     .when(k % 4 == 1, F.concat(F.lit("From the "), F.split_part(n, F.lit(" "), F.lit(1)), F.lit(" "), n, F.lit(" District")))
                     .when(k % 4 == 2, F.concat(F.lit("Troops reached "), n)).otherwise("Nothing is named").alias("text"))
    names = p.groupBy("p_name").agg(F.min("p_partkey").alias("pos"))
    return match.district_by_keyword(texts, names, "id", "text", "p_name", "pos").select("id", "found_district")


@query("j14_dictionary_tags", """WITH w AS (SELECT split_part(p_name, ' ', 1) AS word, 'block' AS label, 2 AS pr FROM part UNION SELECT split_part(p_name, ' ', 2), 'village', 3 FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1), 'district', 1 FROM part WHERE p_size = 1),
 b AS (SELECT word, arg_min(label, pr) AS label FROM w GROUP BY 1),
 t AS (SELECT incident_number AS id, unnest(string_split(s, ' ')) AS word, unnest(range(len(string_split(s, ' ')))) AS pos FROM (SELECT p_partkey AS incident_number, 'Near ' || p_name || ' in ' || p_type AS s FROM part))
SELECT id, CAST(pos AS INTEGER) AS pos, word, label FROM t JOIN b USING (word)""")
def j14(spark, d):
    p = table(spark, d, "part")
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    words = p.select(F.inline(F.array(
        F.struct(first.alias("word"), F.lit("block").alias("label"), F.lit(2).alias("priority")),
        F.struct(second.alias("word"), F.lit("village").alias("label"), F.lit(3).alias("priority")),
        F.struct(F.when(F.col("p_size") == 1, first).alias("word"), F.lit("district").alias("label"), F.lit(1).alias("priority"))))).filter("word is not null")
    texts = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("Near "), "p_name", F.lit(" in "), "p_type").alias("text"))
    return match.tag_words(texts, words, "id", "text")


# ---- entities ----------------------------------------------------------------------------

SPANS_SQL = PLA + """, e AS (SELECT incident_number, 'DISTRICT' AS label, district AS v, incident_summary AS s, village_name FROM places
  UNION ALL SELECT incident_number, 'VILLAGE', village_name, incident_summary, village_name FROM places WHERE village_name IS NOT NULL
  UNION ALL SELECT incident_number, 'OTHER_LOCATION', block, incident_summary, village_name FROM places WHERE block IS NOT NULL),
 f AS (SELECT *, instr(lower(s), lower(v)) - 1 AS st FROM e),
 kv AS (SELECT * FROM f a WHERE a.label <> 'OTHER_LOCATION' AND (a.label = 'DISTRICT' OR NOT EXISTS (SELECT 1 FROM f b WHERE b.incident_number = a.incident_number
   AND b.label = 'DISTRICT' AND a.st < b.st + length(b.v) AND a.st + length(a.v) > b.st))),
 k AS (SELECT * FROM kv UNION ALL SELECT * FROM f a WHERE a.label = 'OTHER_LOCATION' AND NOT EXISTS (SELECT 1 FROM kv b WHERE b.incident_number = a.incident_number
   AND a.st < b.st + length(b.v) AND a.st + length(a.v) > b.st))"""


def _coded(spark, d):
    p = views.places(spark, d)
    return p.select("incident_number", "district", "village_name", F.col("block").alias("other_locations"), "incident_summary")


@query("n01_n05_aligned_spans", SPANS_SQL + """SELECT incident_number, label, CAST(st AS INTEGER) AS start, CAST(st + length(v) AS INTEGER) AS "end", substr(s, st + 1, length(v)) AS text FROM k""")
def n04(spark, d):
    ner = entities.entity_dataset(_coded(spark, d))
    return ner.select(F.col("metadata.incident_number").cast("bigint").alias("incident_number"), F.inline("entities"))


@query("n12_a25_dataset_statistics", SPANS_SQL + """, c AS (SELECT p.incident_number, count(k.label) AS n FROM places p LEFT JOIN k USING (incident_number) GROUP BY 1)
SELECT count(*) AS total_examples, count(*) FILTER (n > 0) AS examples_with_entities, count(*) FILTER (n = 0) AS examples_without_entities, CAST(sum(n) AS BIGINT) AS total_entities,
 round(avg(n) FILTER (n > 0), 6) AS avg_entities_per_example, 0::BIGINT AS examples_with_all_types, 0::BIGINT AS n_state, (SELECT count(*) FROM k WHERE label = 'DISTRICT') AS n_district,
 (SELECT count(*) FROM k WHERE label = 'VILLAGE') AS n_village, (SELECT count(*) FROM k WHERE label = 'OTHER_LOCATION') AS n_other_location FROM c""")
def n12(spark, d):
    out = entities.dataset_statistics(entities.entity_dataset(_coded(spark, d)))
    return out.withColumn("avg_entities_per_example", F.round("avg_entities_per_example", 6))


@query("a26_tag_weights", SPANS_SQL + """, w AS (SELECT label, len(string_split(substr(s, st + 1, length(v)), ' ')) AS n FROM k),
 t AS (SELECT CAST(sum(len(string_split(incident_summary, ' '))) AS BIGINT) AS total FROM places),
 c AS (SELECT tag_id, tag, CAST(n AS BIGINT) AS n FROM (VALUES (0, 'O', (SELECT total - (SELECT sum(n) FROM w) FROM t)), (1, 'B-STATE', 0), (2, 'I-STATE', 0),
   (3, 'B-DISTRICT', (SELECT count(*) FROM w WHERE label = 'DISTRICT')), (4, 'I-DISTRICT', (SELECT sum(n - 1) FROM w WHERE label = 'DISTRICT')),
   (5, 'B-VILLAGE', (SELECT count(*) FROM w WHERE label = 'VILLAGE')), (6, 'I-VILLAGE', (SELECT sum(n - 1) FROM w WHERE label = 'VILLAGE')),
   (7, 'B-OTHER_LOCATION', (SELECT count(*) FROM w WHERE label = 'OTHER_LOCATION')), (8, 'I-OTHER_LOCATION', (SELECT sum(n - 1) FROM w WHERE label = 'OTHER_LOCATION'))) AS v(tag_id, tag, n))
SELECT tag_id, tag, n AS count, round(CASE WHEN n > 0 THEN total / (9.0 * n) ELSE 1 END, 6) AS weight FROM c, t""")
def a26(spark, d):
    return weights.tag_weights(entities.entity_dataset(_coded(spark, d))).withColumn("weight", F.round("weight", 6))


@query("n11_token_tags", SPANS_SQL + """, t AS (SELECT incident_number, incident_summary AS s, unnest(string_split(incident_summary, ' ')) AS token, unnest(range(len(string_split(incident_summary, ' ')))) AS pos FROM places),
 o AS (SELECT *, coalesce(sum(length(token) + 1) OVER (PARTITION BY incident_number ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM t)
SELECT o.incident_number, CAST(pos AS INTEGER) AS pos, token, CAST(coalesce(max((CASE label WHEN 'STATE' THEN 1 WHEN 'DISTRICT' THEN 2 WHEN 'VILLAGE' THEN 3 WHEN 'OTHER_LOCATION' THEN 4 END) * 2 - CASE WHEN k.st = o.st THEN 1 ELSE 0 END), 0) AS INTEGER) AS tag_id
FROM o LEFT JOIN k ON k.incident_number = o.incident_number AND o.st < k.st + length(v) AND o.st + length(token) > k.st GROUP BY 1, 2, 3""")
def n11(spark, d):
    tokens = jobs.build_training_tables(_coded(spark, d))["tokens"]
    return tokens.select(F.col("incident_number").cast("bigint").alias("incident_number"), "pos", "token", "tag_id")


TAGGED_SQL = """WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents),
 g AS (SELECT *, CASE length(token) % 6 WHEN 0 THEN 'B-STATE' WHEN 1 THEN 'I-STATE' WHEN 2 THEN 'I-DISTRICT' WHEN 3 THEN 'I-DISTRICT' ELSE 'O' END AS tag FROM t),
 l AS (SELECT *, CASE WHEN tag <> 'O' THEN substr(tag, 3) END AS label FROM g),
 o AS (SELECT *, CASE WHEN label IS NOT NULL AND (tag LIKE 'B-%' OR label IS DISTINCT FROM lag(label) OVER (PARTITION BY doc_id ORDER BY pos)) THEN 1 ELSE 0 END AS opens FROM l),
 s AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS sp FROM o)"""


SPANS_SQL = TAGGED_SQL + """SELECT doc_id, min(label) AS label, CAST(min(pos) AS INTEGER) AS start_token, CAST(max(pos) + 1 AS INTEGER) AS end_token,
 md5(string_agg(token, ' ' ORDER BY pos)) AS digest FROM s WHERE label IS NOT NULL GROUP BY doc_id, sp"""


def _tag(token):
    k = F.length(token) % 6
    return F.when(k == 0, "B-STATE").when(k == 1, "I-STATE").when(k.isin(2, 3), "I-DISTRICT").otherwise("O")


@query("w14_tags_to_spans", SPANS_SQL)
def w14(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("tokens"))
    out = entities.tag_arrays_to_spans(t.withColumn("tags", F.transform("tokens", _tag)), "doc_id", "tokens", "tags")
    return out.select("doc_id", "label", "start_token", "end_token", F.md5("text").alias("digest"))


@query("w14_token_rows_to_spans", SPANS_SQL)
def w14b(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    out = entities.tags_to_spans(t.withColumn("tag", _tag(F.col("token"))))
    return out.select("doc_id", "label", "start_token", "end_token", F.md5("text").alias("digest"))


def _entity(label, text, score, start=None, end=None):
    return F.struct(
        (F.lit(0) if start is None else start).cast("int").alias("start"),
        (F.length(text) if end is None else end).cast("int").alias("end"), label.alias("label"), text.alias("text"), score.alias("score"))


@query("n06_suppression", """SELECT p_partkey, CAST(CASE WHEN p_partkey % 10 <= 3 THEN 1 ELSE 2 END AS INTEGER) AS kept,
 CASE WHEN p_partkey % 10 <= 3 THEN CASE WHEN p_size >= 25 THEN 'a' ELSE 'b' END WHEN p_size >= 25 THEN 'a|b' ELSE 'b|a' END AS names FROM part""")
def n06(spark, d):
    k = F.col("p_partkey") % 10
    score = F.col("p_size") / 50
    e = F.array(_entity(F.lit("STATE"), F.lit("a"), score, F.lit(0), F.lit(10)),
                _entity(F.lit("STATE"), F.lit("b"), F.lit(0.49), k, k + 10))
    kept = spans.suppress(e)
    return table(spark, d, "part").select("p_partkey", F.size(kept).alias("kept"),
                                          F.array_join(F.transform(kept, lambda x: x.text), "|").alias("names"))


@query("n07_n09_adjusted_scores", """WITH s AS (SELECT p_partkey, p_size / 50.0 AS x, p_name FROM part),
 b AS (SELECT p_partkey, least(1.0, x + CASE WHEN p_partkey % 3 = 0 THEN 0.1 ELSE 0 END) AS y FROM s),
 m AS (SELECT p_partkey, least(1.0, y + 0.05) AS z FROM b)
SELECT p_partkey, round(z, 6) AS score FROM m WHERE z >= 0.5""")
def n07(spark, d):
    p = table(spark, d, "part")
    words = F.when(F.col("p_partkey") % 3 == 0, " is a Village").otherwise(" is there")
    t = F.concat(F.col("p_name"), words)
    e = F.array(_entity(F.lit("VILLAGE"), F.col("p_name"), F.col("p_size") / 50))
    out = p.select("p_partkey", e.alias("e"), t.alias("t")).withColumn("e", spans.boost_context(F.col("e"), F.col("t")))
    out = out.withColumn("e", spans.above_label_floor(spans.boost_multiword(F.col("e"))))
    return out.select("p_partkey", F.explode("e").alias("x")).select("p_partkey", F.round("x.score", 6).alias("score"))


@query("n10_filled_slots", """SELECT p_partkey, CASE WHEN p_size >= 25 THEN lower(p_brand) ELSE lower(p_type) END AS state, p_name AS village,
 concat_ws('|', 'hills', CASE WHEN p_size >= 25 THEN CASE WHEN (50 - p_size) / 50.0 >= 0.4 THEN lower(p_type) END ELSE CASE WHEN p_size / 50.0 >= 0.4 THEN lower(p_brand) END END) AS others,
 'state: ' || CASE WHEN p_size >= 25 THEN lower(p_brand) ELSE lower(p_type) END || ', village: ' || p_name || ', other_locations: ' || concat_ws(', ', 'hills',
   CASE WHEN p_size >= 25 THEN CASE WHEN (50 - p_size) / 50.0 >= 0.4 THEN lower(p_type) END ELSE CASE WHEN p_size / 50.0 >= 0.4 THEN lower(p_brand) END END) AS structured FROM part""")
def n10(spark, d):
    p = spread(table(spark, d, "part"), "p_partkey")
    e = F.array(
        _entity(F.lit("OTHER_LOCATION"), F.lit("hills area"), F.lit(0.5)),
        _entity(F.lit("STATE"), F.concat(F.lower("p_brand"), F.lit(" State")), F.col("p_size") / 50),
        _entity(F.lit("STATE"), F.lower("p_type"), (50 - F.col("p_size")) / 50),
        _entity(F.lit("VILLAGE"), F.concat("p_name", F.lit(" village")), F.lit(0.9)),
        _entity(F.lit("OTHER_LOCATION"), F.lit("hills"), F.lit(0.3)))
    out = p.select("p_partkey", spans.fill_slots(e).alias("s"))
    return out.select("p_partkey", F.col("s.STATE").alias("state"), F.col("s.VILLAGE").alias("village"),
                      F.array_join("s.OTHER_LOCATION", "|").alias("others"), spans.slots_to_structured(F.col("s")).alias("structured"))


@query("n02_n03_loose_spans")
def n02(spark, d):
    """Misspelt names located by the fuzzy window search; checked against brute force in the unit tests."""
    a = altered(spark, d).join(views.places(spark, d).select("incident_number", "incident_summary"), "incident_number")
    coded = a.select("incident_number", "village_name", "incident_summary")
    return entities.align_places(coded, "incident_number").select("incident_number", "start", "end", "label", "text")


def _seen(spark, d, wanted):
    a = altered(spark, d)
    return a.select("incident_number", F.col("p_name").alias("village_name"),
                    F.concat(F.lit("Seen near "), wanted(a), F.lit(", no one hurt")).alias("incident_summary"))


@query("n02_normal_spans", """SELECT p_partkey AS incident_number, 10 AS start, CAST(11 + length(p_name) AS INTEGER) AS "end", 'VILLAGE' AS label,
 substr(p_name, 1, instr(p_name, ' ') - 1) || ', ' || substr(p_name, instr(p_name, ' ') + 1) AS text FROM part WHERE contains(p_name, ' ')""")
def n02b(spark, d):
    """Names that stand in the text with a comma inside: equal in normal form, one character longer as written."""
    coded = _seen(spark, d, lambda a: F.regexp_replace("p_name", "^([^ ]*) ", "$1, ")).filter("village_name like '% %'")
    return entities.align_places(coded, "incident_number").select("incident_number", "start", "end", "label", "text")


@query("n03_misspelt_spans", with_(ALTERED_SQL) + """SELECT incident_number, 10 AS start, CAST(10 + length(village_name) AS INTEGER) AS "end", 'VILLAGE' AS label, village_name AS text FROM altered""")
def n03(spark, d):
    """Misspelt names at a known place: the fuzzy window is the name as written."""
    coded = _seen(spark, d, lambda a: F.col("village_name"))
    return entities.align_places(coded, "incident_number").select("incident_number", "start", "end", "label", "text")


@query("n14_accepted_candidates", """WITH p AS (SELECT a.vec_id, 'c' || a.vec_id % 200 AS text, list_cosine_similarity([x::DOUBLE for x in a.embedding], [x::DOUBLE for x in b.embedding]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
 k AS (SELECT text, vec_id, s, row_number() OVER (PARTITION BY text ORDER BY vec_id) AS rn FROM p WHERE s BETWEEN 0.0 AND 0.5 AND text NOT IN (SELECT 'c' || doc_id FROM labels WHERE toxic = 1))
SELECT text, vec_id, round(s, 6) AS similarity FROM k WHERE rn = 1""")
def n14(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("cand"))
    pairs = e.join(nxt, "vec_id").select(
        "vec_id", F.concat(F.lit("c"), (F.col("vec_id") % 200).cast("string")).alias("text"), F.col("embedding").alias("seed"), "cand")
    known = table(spark, d, "labels").filter("toxic = 1").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("text"))
    out = weights.accept_candidates(pairs, known, "text", "seed", "cand", "vec_id", 0.0, 0.5)
    return out.select("text", "vec_id", F.round("similarity", 6).alias("similarity"))
