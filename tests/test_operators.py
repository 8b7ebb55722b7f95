"""Operators against brute force, and properties that must hold."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from incidentry.operators import (
    bootstrap, calibration, curves, entities, match, metrics, overlap_scores, profile, ranks, report, splits, weights, wrangle,
)
from tests.test_functions import jaro_plain, lcs_plain


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---- ranks -------------------------------------------------------------------------------


def test_running_totals_with_a_hot_group(spark):
    rnd = random.Random(1)
    data = [("hot" if i % 3 else f"g{i % 7}", i, rnd.randint(0, 9)) for i in range(600)]
    df = spark.createDataFrame(data, "g string, k int, v int").repartition(6)
    got = {(r.g, r.k): r.cum for r in ranks.running_totals(df, ["g"], [F.col("k").asc()], {"v": "cum"}).collect()}
    sums = {}
    for g, k, v in sorted(data, key=lambda x: x[1]):
        sums[g] = sums.get(g, 0) + v
        assert got[g, k] == sums[g]


def test_running_totals_group_null(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 5)], "g string, k int, v int")
    got = rows_of(ranks.running_totals(df, ["g"], [F.col("k").desc()], {"v": "c"}).na.fill("-"), "g", "k", "c")
    assert got == [("-", 1, 5), ("-", 2, 3), ("a", 1, 5)]


def test_global_rank_is_a_permutation(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("x"))
    got = rows_of(ranks.global_rank(df, [F.col("x").asc()]), "x", "rank")
    assert [r for _, r in got] == list(range(1, 1001))


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("a", None), ("b", 4.0), ("a", 2.0)], "g string, v double")
    got = rows_of(ranks.quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.9}), "g", "q1", "q2", "q3")
    assert got == [("a", 1.75, 2.0, pytest.approx(7.6)), ("b", 4.0, 4.0, 4.0)]


def test_hash_rank_is_dense_and_repeatable(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 5 > 0, "hot").otherwise(None).alias("s"))
    a = rows_of(ranks.hash_rank(df, "id", ["s"]), "id", "rank", "stratum_size")
    b = rows_of(ranks.hash_rank(df.repartition(7), "id", ["s"]), "id", "rank", "stratum_size")
    assert a == b
    assert sorted(r for i, r, _ in a if i % 5) == list(range(1, 401))
    assert sorted(r for i, r, _ in a if not i % 5) == list(range(1, 101))


# ---- wrangling ---------------------------------------------------------------------------

TEXTS = [(1, "x"), (2, "x"), (3, "x"), (4, None), (5, None), (6, " y"), (7, "y"), (8, "z")]


def test_every_copy_goes(spark):
    df = spark.createDataFrame(TEXTS, "id int, t string")
    assert rows_of(wrangle.without_duplicates(df, "t"), "id") == [(6,), (7,), (8,)]
    assert wrangle.without_duplicates(df, "t").columns == ["id", "t"]
    assert rows_of(wrangle.duplicate_groups(df, "t"), "id", "dupe_count") == [(1, 3), (2, 3), (3, 3), (4, 2), (5, 2)]


def test_snake_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Incidence Number", "incidence.number", "2nd Target", "totalNumber"])
    assert wrangle.snake_names(df, {"total_number": "n"}).columns == ["incidence_number", "incidence_number_2", "x2nd_target", "n"]


def test_task_table_ranges(spark):
    df = spark.createDataFrame([(1, 2, None, "t"), (1, 2, 3, "u")],
                               "total_fatalities int, govt int, other_armed_grp_fatalities int, incident_summary string")
    assert rows_of(wrangle.task_table(df, "deaths"), "incident_summary") == [("u",)]
    assert wrangle.task_table(df, "deaths").columns == df.columns


def test_stable_id_only_fills_gaps(spark):
    df = spark.createDataFrame([("7", "a"), (None, "b")], "incident_number string, t string")
    one = rows_of(wrangle.stable_id(df, "incident_number", "t"), "t", "incident_number")
    two = rows_of(wrangle.stable_id(df.repartition(3), "incident_number", "t"), "t", "incident_number")
    assert one == two and one[0] == ("a", "7") and one[1][1].startswith("generated_")


# ---- matching ----------------------------------------------------------------------------


def fuzzy_tables(spark, n=90, seed=5):
    rnd = random.Random(seed)

    def name():
        return "".join(rnd.choice("abrinlsé ") for _ in range(rnd.randint(1, 9))).strip() or "a"

    districts = [name() for _ in range(6)]
    gaz = [(f"s{rnd.randint(0, 1)}", rnd.choice(districts), name(), i) for i in range(n)]

    def bent(w):
        i = rnd.randrange(len(w))
        return (w[:i] + w[i + 1:]) or "q"

    inc = []
    for i in range(n):
        s, d, v, _ = rnd.choice(gaz)
        kind = rnd.randint(0, 3)
        inc.append((i, s if i % 17 else "elsewhere", bent(d) if kind == 1 else d,
                    None if i % 19 == 0 else bent(v) if kind == 2 else name() if kind == 3 else v))
    inc.append((1, "s0", districts[0], name()))  # a repeated key
    a = spark.createDataFrame(inc, "incident_number int, state_name string, district_name string, village_name string")
    g = spark.createDataFrame(gaz, "state_name string, district_name string, village_name string, gaz_id int")
    return inc, gaz, a, g


@pytest.mark.parametrize("limit", [0.4, 0.15])
def test_best_match_equals_brute_force(spark, limit):
    inc, gaz, a, g = fuzzy_tables(spark)
    best = {}
    for key, s, d, v in inc:
        best.setdefault(key, None)
        for gs, gd, gv, gid in gaz:
            if v is None or s != gs:
                continue
            x, y = 1 - jaro_plain(d, gd), 1 - jaro_plain(v, gv)
            if x <= limit + 1e-9 and y <= limit + 1e-9:
                cand = (round(x + y, 9), gid)
                best[key] = min(best[key], cand) if best[key] else cand
    got = match.best_gazetteer_match(a, g, max_dist=limit).collect()
    assert len(got) == len(best)
    for r in got:
        want = best[r.incident_number]
        assert (r.gaz_id if r.gaz_id is not None else None) == (want[1] if want else None)


def test_prefilter_loses_no_pair(spark):
    rnd = random.Random(9)
    names = sorted({"".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 8))) for _ in range(120)})
    left = spark.createDataFrame([("s", n) for n in names[::2]], "s string, a string")
    right = spark.createDataFrame([("s", n) for n in names[1::2]], "s string, b string")
    for limit in (0.1, 0.2, 0.4):
        got = rows_of(match.close_pairs(left, right, ["s"], "a", "b", limit), "a", "b")
        want = sorted((x, y) for x in names[::2] for y in names[1::2] if 1 - jaro_plain(x, y) <= limit + 1e-9)
        assert got == want


def test_names_in_texts(spark):
    texts = [(1, "the goat sat"), (2, "in new delhi"), (3, ""), (4, None), (5, "ab  cd"), (6, "xnew delhix a"), (6, "goa and more")]
    names = [("new delhi", 2), ("goa", 1), ("b  c", 3), ("a", 9), (" ", 0), (None, 0), ("goat", None)]
    t = spark.createDataFrame(texts, "id int, t string")
    n = spark.createDataFrame(names, "n string, p int")
    want = [(1, "goa"), (2, "new delhi"), (3, None), (4, None), (5, "b  c"), (6, "goa"), (6, "new delhi")]
    got = match.first_name_in_text(t, n, "id", "t", "n", "p")
    assert sorted(((r.id, r.found_name) for r in got.collect()), key=str) == sorted(want, key=str)


def test_district_by_keyword(spark):
    texts = [(1, "Men of North-Goa district met"), (2, "near south goa"), (3, "the West district office"), (4, "quiet"),
             (5, "in goa goa district"), (6, " district first"), (7, None), (1, "the same id")]
    t = spark.createDataFrame(texts, "id int, t string")
    d = spark.createDataFrame([("North Goa", 1), ("South Goa", 2), ("Goa", 3)], "n string, p int")
    want = [(1, ""), (1, "north goa"), (2, "south goa"), (3, ""), (4, ""), (5, "goa"), (6, ""), (7, "")]
    assert sorted((r.id, r.found_district) for r in match.district_by_keyword(t, d, "id", "t", "n", "p").collect()) == want


def test_conditional_probability_sums_to_one(spark):
    df = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "a"), (" ", "a"), ("d2", None)], "d string, s string")
    got = match.conditional_probability(df, "d", "s", 0.5).collect()
    for d in ("d1", "d2"):
        seen = {r.s: r.p for r in got if r.d == d}
        other = seen.pop(None)
        assert sum(seen.values()) + other * (2 - len(seen)) == pytest.approx(1.0)
    assert len(got) == 5


def test_resample_has_no_bound_on_copies(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate([0.0, None, -1.0, 0.4, 7.9, 60.0, 500.0, 5000.0] * 20)], "id int, w double")
    got = {r.id: r["count"] for r in splits.weighted_resample(df, "id", "w").groupBy("id").count().collect()}
    for k, w in enumerate([0.0, None, -1.0, 0.4, 7.9, 60.0, 500.0, 5000.0]):
        counts = [got.get(i, 0) for i in range(k, 160, 8)]
        rate = max(w or 0, 0)
        assert abs(sum(counts) - 20 * rate) <= 6 * (20 * rate) ** 0.5
        assert rate == 0 or len(set(counts)) > 1 or rate < 1


# ---- splits ------------------------------------------------------------------------------


def test_splits_cover_and_keep_shares(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("s"))
    got = splits.stratified_split(df, "id", ["s"]).groupBy("s", "split").count().collect()
    share = {(r.s, r.split): r["count"] for r in got}
    assert sum(share.values()) == 1000
    assert share["hot", "train"] == round(666 * 0.8)


@pytest.mark.parametrize(("n", "want"), [(1, ["train"]), (2, ["test", "train"]), (3, ["test", "train", "val"]),
                                        (10, ["test"] * 2 + ["train"] * 6 + ["val"] * 2)])
def test_group_split_sizes(spark, n, want):
    df = spark.range(n).withColumn("g", F.lit("x"))
    assert sorted(r.split for r in splits.group_split(df, "id", "g").collect()) == want


def test_fractions_are_nested(spark):
    df = spark.range(640).withColumn("s", F.col("id") % 2)
    got = splits.nested_fractions(df, "id", ["s"]).groupBy("fraction").count().collect()
    size = {r.fraction: r["count"] for r in got}
    assert size == {1 / 32: 20, 1 / 16: 20, 1 / 8: 40, 1 / 4: 80, 1 / 2: 160, 1.0: 320}


def test_temporal_split_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(i, None if i >= 8 else f"2020-01-0{1 + i // 4}") for i in range(10)], "id int, d string")
    got = dict(rows_of(splits.temporal_split(df, "d", "id"), "id", "split"))
    assert [got[i] for i in range(10)] == ["train"] * 8 + ["val", "test"]


def test_resample_keeps_the_size_about(spark):
    df = spark.range(4000).withColumn("w", F.when(F.col("id") % 2 == 0, 1.5).otherwise(0.5))
    out = splits.weighted_resample(df, "id", "w")
    even = out.filter("id % 2 = 0").count()
    assert abs(out.count() - 4000) < 250
    assert abs(even - 3000) < 250


# ---- metrics -----------------------------------------------------------------------------


def test_micro_is_pooled_and_support_adds_up(spark):
    rnd = random.Random(2)
    data = [(i, rnd.choice("abc"), rnd.choice("abcd")) for i in range(300)]
    df = spark.createDataFrame(data, "id int, t string, p string")
    counts = metrics.class_counts(df, [], "t", "p").collect()
    assert sum(r.support for r in counts) == 300
    acc = sum(t == p for _, t, p in data) / 300
    got = metrics.f1_scores(df, [], "t", "p").first()
    assert got.micro_f1 == pytest.approx(acc)


def test_label_without_positives(spark):
    long = spark.createDataFrame([(1, "a", 0, 1), (2, "a", 0, 0), (1, "b", 1, 1), (2, "b", 0, 0)], "id int, label string, truth int, pred int")
    got = {r.label: r for r in metrics.multilabel_report(long, []).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].f1, got["a"].support) == (0.0, 0.0, 0.0, 0)
    assert got["macro avg"].f1 == 0.5
    masked = {r.label for r in metrics.multilabel_report(long, [], mask_zero=True).collect()}
    assert "a" not in masked


def test_count_metrics_nulls(spark):
    df = spark.createDataFrame([(0, 0), (3, None), (4, 6)], "true_label long, prediction long")
    drop = metrics.count_metrics(df, []).first()
    miss = metrics.count_metrics(df, [], on_null="miss").first()
    assert (drop.n, drop.mae, drop.mdae) == (2, 1.0, 1.0)
    assert (miss.n, miss.mae, miss.nonzero_mae) == (3, pytest.approx(5 / 3), 2.5)


def test_empty_bins_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (7, 6)], "true_label long, prediction long")
    got = {r.bin: (r.n, r.mae) for r in metrics.count_metrics_by_bin(df, []).collect()}
    assert got == {"0": (1, 0.0), "1": (0, 0.0), "2": (0, 0.0), "3-5": (0, 0.0), "6+": (1, 1.0)}


LOCATIONS = [
    ("state: Bihar, district: Gaya, village: Tekari", "state: bihar, district: Gaya, village: Tekarii"),
    ("state: Bihar, other_locations: Hills", "state: Bihar, other_locations: hills"),
    ("district: Gaya", "state: Bihar"), (None, None), ("village: Abcdefghij", "village: Xyz"),
]


def test_fuzzy_location_metrics(spark):
    df = spark.createDataFrame(LOCATIONS, "t string, p string")
    o = metrics.location_overall(df, [], "t", "p").first()
    # Whole records mind case; the fuzzy ones do not. Two empty records are equal.
    assert (o.exact_match, o.exact_core_match, o.fuzzy_match, o.fuzzy_core_match) == (20.0, 40.0, 60.0, 60.0)
    lv = {r.level: r for r in metrics.location_levels(df, [], "t", "p").collect()}
    assert (lv["village"].exact_f1, lv["village"].fuzzy_f1, lv["village"].support) == (0.0, 50.0, 2)
    assert (lv["state"].exact_precision, lv["state"].exact_recall) == (pytest.approx(200 / 3), 100.0)
    assert lv["other_locations"].fuzzy_f1 == 100.0
    assert lv["micro"].support == sum(lv[x].support for x in ("state", "district", "village", "other_locations"))


def test_rouge_equals_plain(spark):
    pairs = [(1, "The cat, sat on mats", "the cat on the mat"), (2, "", "a b"), (3, "same text", "same text")]
    got = overlap_scores.rouge(spark.createDataFrame(pairs, "id int, p string, t string"), "id", "p", "t").first()
    import re

    def f(shared, n, m):
        return 2 * shared / (n + m) if n + m else 0.0

    want = []
    for _, p, t in pairs:
        a, b = re.findall("[a-z0-9]+", p.lower()), re.findall("[a-z0-9]+", t.lower())
        want.append((f(sum(min(a.count(w), b.count(w)) for w in set(a)), len(a), len(b)), f(lcs_plain(a, b), len(a), len(b))))
    assert got.rouge1 == pytest.approx(sum(x for x, _ in want) / 3)
    assert got.rougeL == pytest.approx(sum(y for _, y in want) / 3)


def test_ngrams_are_counted_within_their_row(spark):
    """No n-gram becomes a row of its own, so memory does not grow with their number; null texts have none."""
    df = spark.createDataFrame([(1, "a b a b c", "a b a c"), (2, "x", "x"), (3, None, "y z"), (4, "a b a b", "b a b a b")],
                               "id int, p string, t string")
    got = overlap_scores.bleu(df, "id", "p", "t")
    r = got.first()
    assert (r.precision_1, r.precision_2, r.precision_3, r.precision_4) == pytest.approx((9 / 10, 5 / 7, 3 / 5, 1 / 3))
    for out in (got, overlap_scores.rouge(df, "id", "p", "t")):
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


# ---- curves ------------------------------------------------------------------------------


def scored(spark, n=200, seed=4):
    rnd = random.Random(seed)
    data = [(i, lab, rnd.randint(0, 1), rnd.randint(0, 20) / 20) for i in range(n) for lab in ("a", "b")]
    return data, spark.createDataFrame(data, "row_id int, label string, truth int, prob double")


def test_auc_equals_pair_counting(spark):
    data, long = scored(spark)
    got = {r.label: r.auc for r in curves.roc_auc(long, ["label"]).collect()}
    for lab in ("a", "b"):
        pos = [p for _, x, t, p in data if x == lab and t]
        neg = [p for _, x, t, p in data if x == lab and not t]
        wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
        assert got[lab] == pytest.approx(wins / len(pos) / len(neg))


def f1_at(data, lab, t):
    tp = sum(1 for _, x, y, p in data if x == lab and y and p >= t)
    bad = sum(1 for _, x, y, p in data if x == lab and (p >= t) != bool(y))
    return 2 * tp / (2 * tp + bad) if tp else 0.0


def test_thresholds_equal_brute_force(spark):
    data, long = scored(spark)
    grid = curves.even_grid(0.0, 1.0, 101)
    for r in curves.best_thresholds(long, ["label"]).collect():
        best = max(grid, key=lambda t: (round(f1_at(data, r.label, t), 12), -t))
        assert (r.threshold, r.f_beta) == (best, pytest.approx(f1_at(data, r.label, best)))


def test_constant_scores_take_the_first_threshold(spark):
    long = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5)], "label string, truth int, prob double")
    assert curves.best_thresholds(long, ["label"]).first().threshold == 0.0


@pytest.mark.parametrize("objective", ["macro", "micro"])
def test_coordinate_ascent_never_loses(spark, objective):
    data, long = scored(spark, 80)
    chosen = curves.coordinate_thresholds(long, objective)

    def score(th):
        if objective == "macro":
            return sum(f1_at(data, lab, t) for lab, t in th.items()) / len(th)
        tp = sum(1 for _, x, y, p in data if y and p >= th[x])
        bad = sum(1 for _, x, y, p in data if (p >= th[x]) != bool(y))
        return 2 * tp / (2 * tp + bad)

    assert score(chosen) >= score({"a": 0.5, "b": 0.5})
    for lab in chosen:
        for t in curves.even_grid(0.05, 0.95, 19):
            assert score({**chosen, lab: t}) <= score(chosen) + 1e-12


def test_temperature_is_at_the_minimum(spark):
    rnd = random.Random(8)
    data = [(rnd.gauss(0, 4),) for _ in range(500)]
    data = [(z, int(rnd.random() < 1 / (1 + math.exp(-z / 3)))) for (z,) in data]
    t = calibration.fit_sigmoid_temperature(spark.createDataFrame(data, "logit double, truth int"))

    def nll(temp):
        return sum(math.log1p(math.exp(-abs(z / temp))) + max(z / temp, 0) - z / temp * y for z, y in data)

    assert nll(t) <= min(nll(t * 1.01), nll(t * 0.99)) + 1e-6
    assert 2 < t < 4.5


def test_softmax_temperature(spark):
    df = spark.createDataFrame([([4.0, 0.0], 0)] * 3 + [([4.0, 0.0], 1)], "l array<double>, y int")
    # Three in four are right, so the best temperature makes the odds 3: exp(4 / t) = 3.
    assert calibration.fit_softmax_temperature(df, "l", "y") == pytest.approx(4 / math.log(3), rel=1e-3)


@pytest.mark.parametrize("right", [1, 501, 3])
def test_temperature_without_bounds(spark, right):
    """The odds are exp(4 / t): the best temperature is below zero for right < wrong, and large where they are close."""
    wrong = {1: 3, 501: 500, 3: 1}[right]
    want = 4 / math.log(right / wrong)
    rows = spark.createDataFrame([([4.0, 0.0], 0)] * right + [([4.0, 0.0], 1)] * wrong, "l array<double>, y int")
    assert calibration.fit_softmax_temperature(rows, "l", "y", bounds=None) == pytest.approx(want, rel=1e-9)
    long = rows.selectExpr("4.0D as logit", "1 - y as truth")
    assert calibration.fit_sigmoid_temperature(long, bounds=None) == pytest.approx(want, rel=1e-9)


# ---- loose spans -------------------------------------------------------------------------


def test_loose_search_runs_once_over_all_partitions(spark):
    df = spark.createDataFrame([(i, "seen near larg ring today", "large ring") for i in range(50)],
                               "incident_number int, incident_summary string, village_name string").coalesce(1)
    out = entities.align_places(df, "incident_number")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("Exchange hashpartitioning")  # the search is above the exchange
    assert {(r.start, r.end, r.text) for r in out.collect()} == {(10, 19, "larg ring")} and out.count() == 50


# ---- costly work per row is spread --------------------------------------------------------


def test_locations_are_parsed_once_over_all_partitions(spark):
    from incidentry.plans import jobs

    rows = spark.createDataFrame([(i, "state: A, district: B, village: large ring") for i in range(40)],
                                 "incident_number int, prediction string").coalesce(1)
    gaz = spark.createDataFrame([(7, "a", "b", "large ring", 1.5)],
                                "gaz_id int, state_name string, district_name string, village_name string, latitude double")
    out = jobs.locate(rows, gaz)
    assert "prediction" not in out._jdf.queryExecution().executedPlan().toString()  # names are read as written
    assert {(r.gaz_id, r.latitude) for r in out.collect()} == {(7, 1.5)} and out.count() == 40


# ---- bootstrap ---------------------------------------------------------------------------


def test_draws_add_up_to_n(spark):
    w = bootstrap.draw_weights(spark, 40, 7).groupBy("rep").agg(F.sum("weight").alias("w"))
    assert rows_of(w, "rep", "w") == [(r, 40) for r in range(7)]


def test_in_and_out_of_bag_are_disjoint(spark):
    df = spark.range(50)
    inside = {(r.rep, r.id) for r in bootstrap.resample(df, "id", 5).collect()}
    outside = {(r.rep, r.id) for r in bootstrap.left_out(df, "id", 5).collect()}
    assert not inside & outside
    assert len(inside | outside) == 250


@pytest.mark.parametrize("mode", ["exact", "poisson"])
def test_interval_holds_the_estimate(spark, mode):
    df = spark.range(400).select("id", (F.col("id") % 4).alias("true_label"), (F.col("id") % 5 % 4).alias("prediction"))
    score = bootstrap.count_scores("true_label", "prediction")["mae"]
    row = bootstrap.bootstrap_interval(df, "id", [], score, 60, mode=mode).first()
    point = metrics.count_metrics(df, []).first().mae
    assert row.lower < point < row.upper
    assert row.mean == pytest.approx(point, rel=0.05)


@pytest.mark.parametrize("size", [1, 7, 30, 31, 400, 10 ** 6])
def test_cells_are_drawn_as_their_rows_would_be(spark, size):
    """Mean and variance of drawn rows are the size, those of left-out rows that of the size's trials."""
    digests = spark.range(4000).select(F.md5(F.col("id").cast("string")).alias("d"), F.lit(size).cast("long").alias("n"))
    drawn = digests.select(bootstrap.poisson_of_size(F.col("d"), F.col("n")).alias("k"))
    out = digests.select(bootstrap.binomial_of_size(F.col("d"), F.col("n"), bootstrap.LEFT_OUT).alias("k"))
    p = math.exp(-1)
    for df, mean, var in ((drawn, size, size), (out, size * p, size * p * (1 - p))):
        row = df.agg(F.avg("k").alias("m"), F.variance("k").alias("v"), F.min("k").alias("lo"), F.max("k").alias("hi")).first()
        assert row.m == pytest.approx(mean, abs=5 * math.sqrt(var / 4000))
        assert row.v == pytest.approx(var, rel=0.15)
        assert row.lo >= 0 and (df is drawn or row.hi <= size)


def test_cells_cost_replicates_times_cells(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 4).alias("true_label"), (F.col("id") % 5 % 4).alias("prediction"))
    df = df.unionByName(spark.createDataFrame([(-1, None, 1), (-2, None, None)], df.schema))
    cells = bootstrap.resample_cells(df, ["true_label", "prediction"], 9)
    assert cells.count() <= 9 * 18
    score = bootstrap.count_scores("true_label", "prediction")["mae"]
    row = bootstrap.bootstrap_interval(df, "id", [], score, 80).first()
    point = metrics.count_metrics(df.filter("id >= 0"), []).first().mae
    assert row.lower < point < row.upper and row.replicates == 80
    assert bootstrap.bootstrap_interval(df.limit(0), "id", [], score, 5).first().replicates == 0


def test_paired_locations_of_equal_models_do_not_differ(spark):
    rows = [(i, "a" if i % 2 else None, f"state: s{i % 3}, village: v{i % 5}", f"state: S{i % 3}, village: v{i % 4}") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, truth string, pred string")
    got = bootstrap.paired_location_test(df, ["g"], "truth", "pred", "pred", 40).collect()
    assert len(got) == 6 and all(r["diff"] == 0 and r.p == 1.0 and not r.significant for r in got)
    better = bootstrap.paired_location_test(df, ["g"], "truth", "pred", "truth", 40).collect()
    assert all(r.p == 0.0 and r.better and r.model_mean == 100 for r in better)


def test_pr_auc_is_the_integral_of_precision(spark):
    """Against a sum over very short pieces of each step; ties, a first step of negatives, and groups of one class."""
    groups = {"mixed": [(0.9, 1), (0.9, 0), (0.8, 0), (0.7, 1), (0.7, 1), (0.7, 0), (0.2, 0), (0.1, 1)],
              "late": [(0.9, 0), (0.8, 0), (0.5, 1), (0.4, 0), (0.3, 1)], "right": [(0.9, 1), (0.8, 1), (0.1, 0)],
              "none": [(0.9, 0)], "all": [(0.4, 1), (0.4, 1)]}
    rows = [(g, p, t) for g, xs in groups.items() for p, t in xs]
    got = dict(rows_of(curves.pr_auc(spark.createDataFrame(rows, "g string, prob double, truth int"), ["g"]), "g", "pr_auc"))
    for g, xs in groups.items():
        total = sum(t for _, t in xs)
        if not total:
            assert got[g] is None
            continue
        tp = fp = area = 0.0
        for p in sorted({p for p, _ in xs}, reverse=True):
            dp, dq = sum(t for q, t in xs if q == p), sum(1 - t for q, t in xs if q == p)
            pieces = 20_000
            for k in range(pieces if dp else 0):
                share = (k + 0.5) / pieces
                area += dp / pieces * (tp + dp * share) / (tp + dp * share + fp + dq * share)
            tp, fp = tp + dp, fp + dq
        assert got[g] == pytest.approx(area / total, abs=1e-6)


def test_subsequence_lengths():
    r = random.Random(6)
    for _ in range(300):
        x, y = ([r.choice("abcd") for _ in range(r.randrange(0, 90))] for _ in range(2))
        assert overlap_scores.subsequence_length(x, y) == lcs_plain(x, y)


def test_p_value_bounds(spark):
    df = spark.createDataFrame([("same", 0.0)] * 4 + [("up", 1.0)] * 4 + [("half", 1.0), ("half", -1.0)], "g string, d double")
    got = dict(rows_of(df.groupBy("g").agg(bootstrap.p_value(F.col("d")).alias("p")), "g", "p"))
    assert got == {"same": 1.0, "up": 0.0, "half": 1.0}


# ---- entities and reports ----------------------------------------------------------------


def test_tags_to_spans_edges(spark):
    tags = ["I-STATE", "I-STATE", "B-STATE", "O", "I-DISTRICT", "I-STATE", "B-VILLAGE", "I-VILLAGE", "I-VILLAGE", "I-VILLAGE"]
    words = ["w0", "w1", "w2", "w3", "w4", "w5", "w6", "[SEP]", "w8", "w9"]
    df = spark.createDataFrame([(1, i, w, t) for i, (w, t) in enumerate(zip(words, tags))], "doc_id int, pos int, token string, tag string")
    got = rows_of(entities.tags_to_spans(df), "start_token", "end_token", "label", "text")
    assert got == [(0, 2, "STATE", "w0 w1"), (2, 3, "STATE", "w2"), (4, 5, "DISTRICT", "w4"), (5, 6, "STATE", "w5"),
                   (6, 7, "VILLAGE", "w6"), (8, 10, "VILLAGE", "w8 w9")]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_spans_over_block_borders(spark, block):
    rng = random.Random(block)
    tags = ["B-STATE", "I-STATE", "I-STATE", "I-STATE", "I-DISTRICT", "O", None]
    rows = [(d, p, f"w{p}" if rng.random() < 0.95 else "[SEP]", rng.choice(tags[:4] if d == 1 else tags))
            for d in (0, 1, 2, None) for p in range(60) if rng.random() < 0.9]
    # One span through many blocks, and an empty block between two tokens of one span.
    rows += [(3, p, f"w{p}", "I-STATE") for p in (*range(20), *range(40, 50))]
    df = spark.createDataFrame(rows, "doc_id int, pos int, token string, tag string")
    want = []
    for d in (0, 1, 2, 3, None):
        open_ = None
        for _, p, w, g in sorted((r for r in rows if r[0] == d), key=lambda r: r[1]):
            label = g[2:] if g and g != "O" and w != "[SEP]" else None
            if label and open_ and open_[1] == label and g[0] == "I":
                open_[3], open_[4] = p + 1, f"{open_[4]} {w}"
            else:
                open_ = [d, label, p, p + 1, w] if label else None
                want += [open_] if label else []
    got = [tuple(r) for r in entities.tags_to_spans(df, block=block).collect()]
    assert sorted(got, key=str) == sorted((tuple(r) for r in want), key=str)


def test_spans_inside_a_block_are_shuffled_once(spark):
    """Only pieces at the ends of a block go on to the join and the second grouping."""
    df = spark.createDataFrame([(1, p, f"w{p}", "B-STATE") for p in range(30)], "doc_id int, pos int, token string, tag string")
    found = entities.tags_to_spans(df, block=10)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Union", 1)[1].split("\n")[1:]
    depth = plan[0].index(":-")
    inner = [line for k, line in enumerate(plan) if "+-" not in "".join(x[depth:depth + 2] for x in plan[:k + 1])]
    assert sum("Exchange" in line for line in inner) == 1 and not any("Join" in line for line in inner)
    assert found.count() == 30


def test_array_spans_equal_row_spans(spark):
    rng = random.Random(5)
    tags = ["B-STATE", "I-STATE", "I-STATE", "I-DISTRICT", "O", "B", "", None]
    words = ["a", "\u00fc b", "", "[SEP]", None]
    rows = [(d, [rng.choice(words) for _ in range(rng.randrange(40))], [rng.choice(tags) for _ in range(rng.randrange(40))])
            for d in range(60)]
    rows += [(100, None, ["B-STATE"]), (101, ["a"], None), (102, [], []), (None, ["a", "b"], ["B-STATE", "I-STATE"])]
    df = spark.createDataFrame(rows, "doc_id int, w array<string>, g array<string>").repartition(3)
    long = df.select("doc_id", F.posexplode(F.arrays_zip("w", "g")).alias("pos", "x")).select(
        "doc_id", "pos", F.col("x.w").alias("token"), F.col("x.g").alias("tag")).filter("token is not null or tag is not null")
    want = entities.tags_to_spans(long.withColumn("tag", F.expr("if(token is null, 'O', tag)")))
    got = entities.tag_arrays_to_spans(df, "doc_id", "w", "g")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert entities.tag_arrays_to_spans(df.limit(0), "doc_id", "w", "g").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_micro_thresholds_beat_every_choice(spark, seed):
    rng = random.Random(seed)
    rows = [(label, int(rng.random() < p), round(rng.random(), 2)) for label, p in (("a", 0.5), ("b", 0.1), ("c", 0.02)) for _ in range(40)]
    grid = [0.1, 0.3, 0.5, 0.7, 0.9]
    got = curves.micro_thresholds(spark.createDataFrame(rows, "label string, truth int, prob double"), grid).orderBy("label").collect()

    def f1(choice):
        limit = dict(zip("abc", choice))
        tp, fp, fn = (sum(1 for x, t, p in rows if (t == 1) == a and (p >= limit[x]) == b) for a, b in ((True, True), (False, True), (True, False)))
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0

    best = max(f1(c) for c in itertools.product(grid, repeat=3))
    assert [r.micro_f1 for r in got] == [pytest.approx(best)] * 3
    assert f1([r.threshold for r in got]) == pytest.approx(best)


def test_micro_thresholds_without_hits(spark):
    df = spark.createDataFrame([("a", 0, 0.2), ("b", 0, 0.9)], "label string, truth int, prob double")
    assert rows_of(curves.micro_thresholds(df), "label", "threshold", "micro_f1") == [("a", 0.5, 0.0), ("b", 0.5, 0.0)]
    assert curves.micro_thresholds(df.limit(0)).count() == 0


def test_timeline_fills_months(spark):
    df = spark.createDataFrame([("2020-01-31",), ("2020-04-01",), ("2020-04-02",), (None,)], "d string").select(F.to_date("d").alias("Date"))
    got = [(str(a), n) for a, n in rows_of(report.monthly_timeline(df), "month_end", "incidents")]
    assert got == [("2020-01-31", 1), ("2020-02-29", 0), ("2020-03-31", 0), ("2020-04-30", 2)]
    assert report.monthly_timeline(df.filter("Date is null")).count() == 0


def test_best_strategy_ignores_missing(spark):
    df = spark.createDataFrame([("s1", None, 1.0), ("s2", 30.0, 5.0), ("s3", 5.0, 9.0)], "strategy string, a double, b double")
    table = profile.compare_strategies(df, {"x": "a", "y": "b"})
    got = {r.pair: (r.lowest_mean, r.most_within_10) for r in profile.best_strategies(table).collect()}
    assert got == {"x": ("s3", "s3"), "y": ("s1", "s1")}


def test_alpha_uses_the_lower_median(spark):
    df = spark.createDataFrame([(1, 1, 1, 0), (1, 1, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0)], "a int, b int, c int, d int")
    got = {r.label: r.alpha for r in weights.alpha_weights(df, ["a", "b", "c", "d"]).collect()}
    # Prevalences 1, .5, .25, 0: the lower middle value is .25.
    assert got == {"a": pytest.approx(0.5, abs=1e-3), "b": pytest.approx(math.sqrt(0.5)), "c": 0.75, "d": 0.75}


def test_sample_weights_have_mean_one(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 1), (0, 0)], "a int, b int")
    got = [r.sample_weight for r in weights.sample_weights(df, ["a", "b"]).collect()]
    assert sum(got) == pytest.approx(4) and min(got) > 0
    assert max(got) == pytest.approx(1.0 / (2.5 / 4))


def test_slots_are_filled_over_all_partitions(spark, tmp_path):
    from incidentry.plans import catalog

    catalog.load_all()
    spark.createDataFrame([(i, "hot bolt", "Brand#1", "SMALL", i) for i in range(40)],
                          "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").coalesce(
        1).write.parquet(str(tmp_path / "part.parquet"))
    out = catalog.QUERIES["n10_filled_slots"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("AS structured") < plan.index("Exchange hashpartitioning(p_partkey")  # the work is above the exchange
    assert out.count() == 40
