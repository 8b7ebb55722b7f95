"""Edge rows of the column functions, with values worked out by hand."""

import random
import pytest
from pyspark.sql import functions as F

from incidentry.functions import counts, geo, labels, places, probability, recode, similarity, spans, text


def column(spark, values, expr, kind="string"):
    """Values of an expression over a one-column table, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


ANSWERS = ["3", "3.", "-2", "none", "two killed", "", None, "in 2009, 4 died", '```json\n{"fatalities": 5}\n```',
           "x -3", "250 then 12", "1_000", "+7"]


@pytest.mark.parametrize(("parse", "want"), [
    (counts.whole_number, [3, 3, 2, 0, 0, 0, 0, 2009, 5, 3, 250, 0, 7]),
    (counts.lenient_count, [3, 3, 0, 1, 2, None, None, 2009, 5, 3, 250, 1000, 7]),
    (counts.prediction_count, [3, 3, 0, 1, 2, 0, 0, 2009, 5, 3, 250, 1000, 7]),
    (counts.fatalities, [3, 3, 2, 0, 0, 0, 0, 4, 5, 3, 12, 1, 7]),
])
def test_counts(spark, parse, want):
    assert column(spark, ANSWERS, parse) == want


def test_negative_json_fatalities_are_zero(spark):
    assert column(spark, ['{"fatalities": -4}', "`9`", "999 only"], counts.fatalities) == [0, 9, 999]


def test_regression_rounds_half_to_even(spark):
    got = column(spark, ["2.5", "3.5", "-1.2", "nan", "inf", "oops", None],
                 lambda c: counts.prediction_count(c, "regression"))
    assert got == [2, 4, 0, 0, 0, 0, 0]


def test_five_counts(spark):
    whole = "a: 1\nb: 2\nc: 3\nd: 4\ne: 5"
    got = column(spark, [whole, whole + "\nmore: 9", "a: 1\nb: 2", whole.replace("3", "x"), None], counts.five_counts)
    missing = [-100] * 5
    assert got == [[1, 2, 3, 4, 5], [1, 2, 3, 4, 5], missing, [1, 2, -100, 4, 5], missing]


@pytest.mark.parametrize(("txt", "n", "want"), [
    ("On 5 May 3 people were killed", 3, ("3", 9)),
    ("In 2009, 4 people were killed near 7 huts", 12, ("4", 9)),
    ("killing 6 of 9 men", 1, ("6", 8)),
    ("deaths of 8", 2, ("8", 10)),
    ("about 10 casualties", 3, ("10", 6)),
    ("unit 77 moved", 3, ("77", 5)),
    ("nobody", 3, ("3", -1)),
    ("13 men, 3 women", 3, ("3", 8)),
])
def test_answer_span(spark, txt, n, want):
    row = spark.range(1).select(counts.answer_span(F.lit(txt), F.lit(n)).alias("s")).first().s
    assert (row.answer_text, row.answer_start) == want


def test_single_label(spark):
    got = column(spark, ["maoist", " SECURITY ", "Maoists", "Civilians", "", None, "Secruity"], labels.single_label)
    assert got == ["Maoist", "Security", "Maoist", "Unknown", "Unknown", None, "Security"]


def test_label_parts(spark):
    got = column(spark, ["Arrest, Bombing ", "None", "", None, "a,,b"], labels.label_parts)
    assert got == [["arrest", "bombing"], [], [], [], ["a", "", "b"]]


PARSE_CASES = [
    ("state: A, district: B, village: C, other_locations: D, E", ("A", "B", "C", "D")),
    ("district: B", (None, "B", None, None)),
    ("district: B, DISTRICT: Q", (None, "Q", None, None)),
    ("state: , district: b", ("", "b", None, None)),
    ("village：X [SEP] ,", (None, None, "X", None)),
    ("​state: ＡＢ", ("AB", None, None, None)),
    ("state: a: b", ("a: b", None, None, None)),
    ("", (None,) * 4), (None, (None,) * 4), ("no fields", (None,) * 4),
]


@pytest.mark.parametrize(("value", "want"), PARSE_CASES)
def test_parse_structured(spark, value, want):
    row = column(spark, [value], places.parse_structured)[0]
    assert tuple(row) == want


def test_keep_tail(spark):
    rows = column(spark, ["state: A, other_locations: D, E", "other_locations: D, E, village: V", "state: A"],
                  lambda c: places.parse_structured(c, keep_tail=True).other_locations)
    assert rows == ["D, E", "D, E", None]


def test_parse_answer_prefers_the_ordered_run(spark):
    rows = column(spark, ["```text\nSure! State: Bihar, district: Gaya\n```", "I think state: X, village: V. Thanks, bye",
                          "district: only"], places.parse_answer)
    assert [tuple(r) for r in rows] == [
        ("Bihar", "Gaya", None, None), ("X", None, "V. Thanks", None), (None, "only", None, None)]


def test_json_to_structured(spark):
    got = column(spark, ['{"state": " A ", "district": "", "village": null, "other_locations": "x"}', "broken", None],
                 places.json_to_structured)
    assert got == ["state: A, other_locations: x", "", ""]


def test_build_and_parse_round_trip(spark):
    s = "state: A, district: B, village: C, other_locations: D"
    assert column(spark, [s], lambda c: places.build_from(places.parse_structured(c))) == [s]


@pytest.mark.parametrize(("other", "block", "want"), [
    ("Makkuva", "makkuva", None), ("Makkuva Block, Nilgiri", "Makkuva", "Nilgiri"), ("Makkuva Block", "Makkuva", None),
    ("Makkuva and the far hills", "Makkuva", "Makkuva and the far hills"), ("Makk", "Makkuva", None),
    ("Hills", "Makkuva", "Hills"), (None, "Makkuva", None), ("Hills", None, "Hills"), ("Makkuva, Makkuva camp", "Makkuva", None),
])
def test_drop_block(spark, other, block, want):
    row = spark.createDataFrame([(other, block)], "o string, b string").select(
        places.drop_block(F.col("o"), F.col("b")).alias("x")).first()
    assert row.x == want


@pytest.mark.parametrize(("parts", "want"), [
    (("Gaya", "Tekari (old)", "hills", "BlockA (x)"), "gaya, blocka, tekari, hills"),
    ((None, "V", "o", "B"), "v, b, o"), (("D", None, None, "D"), "d"), ((None, None, None, "B"), "b"),
])
def test_recommended_places(spark, parts, want):
    row = spark.createDataFrame([parts], "d string, v string, o string, b string").select(
        places.recommended_places(*[F.col(c) for c in "dvob"]).alias("x")).first()
    assert row.x == want


def test_geocode_requests_fall_back(spark):
    values = ["state: S, district: D, village: V, other_locations: O", "state: S, district: D", "state: S", "x"]

    def asked(strategy):
        got = column(spark, values, lambda c: places.geocode_request(places.parse_structured(c), strategy))
        return [tuple(g) if g else None for g in got]

    assert asked("full") == [("V, O", "S", "D"), ("D", "S", None), ("S", None, None), None]
    assert asked("village_only") == [("V", "S", "D"), ("D", "S", None), ("S", None, None), None]
    assert asked("comma_delimited") == [("S, D, V, O", None, None), ("S, D", None, None), ("S", None, None), None]


def test_smart_query_rules(spark):
    df = spark.createDataFrame([("Gaya", None, None, "Bihar", 2)], "d string, v string, o string, s string, n int")

    def ask(rule):
        q = df.select(places.smart_query(*[F.col(c) for c in "dvosn"], rule).alias("q")).first().q
        return q.query, q.confidence

    assert ask("always") == ("Gaya district, Bihar, India", "high")
    assert ask("never") == ("Gaya district, India", "medium")
    assert ask("auto") == ("Gaya district, Bihar, India", "high")
    assert ask("hybrid") == ("Gaya district, Bihar, India", "high")


def test_geocoder_response(spark):
    def part(name, *kinds):
        return '{"long_name":"%s","types":[%s]}' % (name, ",".join(f'"{k}"' for k in kinds))

    def result(lat, *parts):
        return '{"address_components":[%s],"geometry":{"location":{"lat":%s,"lng":2}}}' % (",".join(parts), lat)

    a1, a2, a3 = (f"administrative_area_level_{i}" for i in (1, 2, 3))
    docs = [
        '{"status":"ZERO_RESULTS","results":[]}',
        '{"status":"OK","results":[%s,%s]}' % (result(1, part("S", a1)), result(2, part("D", a2), part("S", a1))),
        '{"status":"OK","results":[%s,%s]}' % (result(1, part("D1", a2)), result(2, part("D2", a2))),
        '{"status":"OK","results":[%s]}' % result(3, part("ward", "sublocality"), part("town", "locality"), part("B", a3)),
        '{"status":"OK","results":[%s]}' % result(3, part("w1", "sublocality"), part("w2", "sublocality")),
        "junk",
    ]
    got = column(spark, docs, geo.flatten_response)
    assert got[0] is None and got[5] is None
    assert (got[1].level, got[1].district, got[1].latitude) == ("district", "D", 2.0)
    assert (got[2].district, got[2].latitude) == ("D1", 1.0)
    assert (got[3].level, got[3].town_village, got[3].subdistrict) == ("town_village", "town", "B")
    assert got[4].town_village == "w1"
    only_state = column(spark, docs[1:2], lambda c: geo.flatten_response(c, first_only=True))[0]
    assert only_state.level == "state"
    assert column(spark, docs[1:2], lambda c: geo.flatten_response(c, False, True))[0] is None


def test_haversine(spark):
    row = spark.range(1).select(
        geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("q"),
        geo.haversine(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("n")).first()
    assert row.q == pytest.approx(6371 * 3.141592653589793 / 2)
    assert row.n is None


def test_recode_null_rules(spark):
    rows = [(None, None, None), (None, None, "Bombing"), ("Arrest", "Bombing", None)]
    df = spark.createDataFrame(rows, "first_action string, second_action string, third_action string")
    got = df.select(*[c.alias(n) for n, c in recode.action_flags().items()]).collect()
    assert [(r.bombing, r.arrest, r.surrender) for r in got] == [(0, 0, 0), (1, 0, 0), (1, 1, 0)]


def test_target_null_rules(spark):
    rows = [(None, "Government Property"), (None, "Security"), (None, None), ("NON-MAOIST ARMED GROUP", None), ("Unknown", None)]
    df = spark.createDataFrame(rows, "first_target string, second_target string")
    got = df.select(*[c.alias(n) for n, c in recode.target_flags().items()]).collect()
    assert [r.government_infrastructure for r in got] == [1, None, None, None, None]
    assert [r.non_maoist_armed_group for r in got] == [None, None, None, 1, None]
    assert [r.no_target for r in got] == [None, None, None, 0, 1]
    assert [r.security for r in got] == [0, 1, 0, 0, 0]


def test_civilian_spellings(spark):
    rows = [("Polic Informer", None, None), ("High Caste\\Landowner", None, None), ("high caste/LANDOWNER", None, None),
            (None, "Other", "Other"), (None, "Elite", "Other Elite"), (None, "Other", None)]
    df = spark.createDataFrame(rows, "first_civilian_target string, second_target string, second_civilian_target string")
    got = df.select(*[c.alias(n) for n, c in recode.civilian_flags().items()]).collect()
    assert [r.police_informer for r in got] == [1, 0, 0, 0, 0, 0]
    assert [r.high_caste_landowner for r in got] == [0, 1, 1, 0, 0, 0]
    assert [r.other_civilian for r in got] == [0, 0, 0, 1, 1, 0]
    strict = df.select(recode.civilian_flags(strict_reference=True)["other_civilian"].alias("x")).collect()
    assert [r.x for r in strict] == [0, 0, 0, 1, 0, 0]


def test_thresholds_and_exclusive_label(spark):
    assert column(spark, [0.5, 0.51], recode.above, "double") == [0, 1]
    assert column(spark, [0.5, 0.49], lambda c: recode.at_least(c, 0.5), "double") == [1, 0]
    row = spark.range(1).select(recode.clear_exclusive(F.lit(1), [F.lit(0), F.lit(1)]).alias("a"),
                                recode.clear_exclusive(F.lit(1), [F.lit(0)]).alias("b")).first()
    assert (row.a, row.b) == (0, 1)


def test_argmax_default(spark):
    got = column(spark, [[0.1, 0.7, 0.7], [], None, [0.0, 0.0, 0.0, 1.0]],
                 lambda c: recode.argmax_label(c, ["a", "b", "c"]), "array<double>")
    assert got == ["b", "Unknown", "Unknown", "Unknown"]


def test_text_helpers(spark):
    assert column(spark, ["\n\t a ", None], text.strip) == ["a", None]
    assert column(spark, ["a\n  b Read less..."], text.summary_text) == ["a b "]
    assert column(spark, ["Aug - 7", "x-12", "7"], text.day_of) == ["07", "12", "07"]
    assert column(spark, ["Aug", "Foo", None], text.month_number) == ["08", None, None]
    assert column(spark, ["rivers and forest"], text.drop_query_words) == ["s and "]
    assert column(spark, ["Gaya District", "PS Gaya Police  Station", "Area 51"], text.drop_descriptors) == ["Gaya", "PS Gaya", "Area 51"]
    assert column(spark, ["12.0", " 7 ", "x", None], text.integer_id) == ["12", "7", None, None]
    assert column(spark, ["abcdef", "abc"], lambda c: text.truncate(c, 3)) == ["abc...", "abc"]
    assert column(spark, ["a &lt;b&gt; <i>c</i><!-- <x> -->"], text.plain_html) == ["a <b> c"]


def jaro_plain(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, ma = list(range(len(b))), []
    for i, ch in enumerate(a):
        for j in free:
            if abs(i - j) <= reach and b[j] == ch:
                free.remove(j)
                ma.append((i, j))
                break
    if not ma:
        return 0.0
    sa = [a[i] for i, _ in ma]
    sb = [b[j] for j in sorted(j for _, j in ma)]
    t = sum(x != y for x, y in zip(sa, sb)) // 2
    m = len(ma)
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def lcs_plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity_blocks_equal_plain_loops():
    import random

    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    a, b = words[:150], words[150:]
    assert similarity.jaro_block(a, b).tolist() == pytest.approx([jaro_plain(x, y) for x, y in zip(a, b)])
    want = [200 * lcs_plain(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a, b)]
    assert similarity.indel_block(a, b).tolist() == pytest.approx(want)


def test_close_enough_nulls(spark):
    rows = [(None, None), (None, "a"), ("a", None), ("Gaya", "gaya"), ("jellyfish", "smellyfish"), ("abcdefghij", "abcdefghiX")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.x for r in df.select(similarity.close_enough(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [True, False, False, True, False, True]


def test_fusion(spark):
    df = spark.createDataFrame([([2.0, 1.0], [0.1, 0.9]), ([2.0, 1.0], None)], "l array<double>, p array<double>")
    got = df.select(probability.fuse(probability.softmax(F.col("l")), F.col("p")).alias("f")).collect()
    p0 = 2.718281828459045 / (1 + 2.718281828459045)
    want = p0 * 0.1 / (p0 * 0.1 + (1 - p0) * 0.9)
    assert got[0].f == pytest.approx([want, 1 - want])
    assert got[1].f == pytest.approx([p0, 1 - p0])


def entity_rows(spark, items, expr, scored=False):
    fields = "start:int,end:int,label:string,text:string" + (",score:double" if scored else "")
    df = spark.createDataFrame([(items,)], f"e array<struct<{fields}>>")
    return df.select(expr(F.col("e")).alias("x")).first().x


def test_resolve_overlaps_leaves_none(spark):
    items = [(0, 10, "OTHER_LOCATION", "a"), (2, 6, "STATE", "b"), (5, 12, "DISTRICT", "c"), (20, 25, "VILLAGE", "d"),
             (20, 28, "VILLAGE", "e"), (28, 30, "VILLAGE", "f")]
    got = [x.text for x in entity_rows(spark, items, spans.resolve_overlaps)]
    assert got == ["b", "e", "f"]


def test_suppression_at_the_limit(spark):
    # Shared 5 of a union of 10: exactly one half, which is kept.
    items = [(0, 5, "STATE", "short", 0.4), (0, 10, "STATE", "long", 0.9), (0, 6, "STATE", "gone", 0.8)]
    got = [x.text for x in entity_rows(spark, items, spans.suppress, scored=True)]
    assert got == ["long", "short"]
    by_length = entity_rows(spark, [i[:4] for i in items], lambda e: spans.suppress(e, by_score=False))
    assert [x.text for x in by_length] == ["long", "short"]


def test_slots(spark):
    items = [(0, 0, "STATE", "Bihar State", 0.9), (0, 0, "STATE", "Odisha", 0.5), (0, 0, "VILLAGE", "Gaya", 0.3),
             (0, 0, "VILLAGE", "Tekari village", 0.2), (0, 0, "OTHER_LOCATION", "hills area", 0.1), (0, 0, "OTHER_LOCATION", "hills", 0.1)]
    got = entity_rows(spark, items, spans.fill_slots, scored=True)
    assert (got.STATE, got.DISTRICT, got.VILLAGE, got.OTHER_LOCATION) == ("Bihar", None, "Gaya", ["hills", "Odisha"])
    raw = entity_rows(spark, items, lambda e: spans.fill_slots(e, normalise=False), scored=True)
    assert raw.OTHER_LOCATION == ["hills area", "hills", "Odisha", "Tekari village"]


def test_loose_spans(spark):
    rows = [("Attack near Gaya Dist. today", "Gaya district"), ("Raid at Lalgharh camp", "Lalgarh"), ("Nothing here", "Lalgarh"),
            (None, "x"), ("text", None), ("Raid at Medinipore", "Medinipur district")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, n string")
    got = {r.i: (r.s.start, r.s.end) for r in df.select("i", spans.loose_span()(F.col("t"), F.col("n")).alias("s")).collect()}
    assert rows[0][0][got[0][0]:got[0][1]].strip(" .") == "Gaya Dist"
    assert rows[1][0][got[1][0]:got[1][1]] == "Lalgharh"
    assert got[2] == got[3] == got[4] == (None, None)
    assert got[5] == (None, None)  # a risky name needs support nearby


def test_fuzzy_windows_lose_none():
    """A window with a high enough ratio is never ruled out by its characters."""
    r = random.Random(4)
    ruled_out = 0
    for _ in range(60):
        words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 15))]
        wanted = "".join(r.choice("abcdé") for _ in range(4)) + " " + r.choice(words or ["abc"])
        size = len(wanted.split())
        every = {(i, j) for i in range(len(words)) for j in range(i + 1, min(i + size + 2, len(words)) + 1)}
        kept = set(spans._windows(words, wanted.split(), 70.0))
        assert kept <= every
        for i, j in every - kept:
            ruled_out += 1
            text = " ".join(words[i:j])
            assert 200.0 * lcs_plain(text, wanted) < 70.0 * (len(text) + len(wanted))
    assert ruled_out > 100


def test_token_tags(spark):
    df = spark.createDataFrame([("in New Delhi city", [(3, 12, "STATE", "New Delhi")])],
                               f"text string, entities {spans.ENTITY}")
    tokens = spans.word_offsets(F.col("text"))
    row = df.select(tokens.alias("w"), spans.tag_tokens(tokens, F.col("entities")).alias("t")).first()
    assert [(w.token, w.start, w.end) for w in row.w] == [("in", 0, 2), ("New", 3, 6), ("Delhi", 7, 12), ("city", 13, 17)]
    assert row.t == [0, 1, 2, 0]
