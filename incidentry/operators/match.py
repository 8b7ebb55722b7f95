"""Place-name matching: best fuzzy gazetteer entry, names inside texts, dictionary tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.functions.similarity import jaro_once
from incidentry.functions.text import strip
from incidentry.session import durable, maybe_broadcast

# Fixed value: letters from rare to common; any other character counts as rarer.
LETTER_ORDER = "zqxjkvbpygfwmucldrhsnioate "
# Distance limits tried in turn. A best pair within a limit beats every pair outside it.
STEPS = (0.1, 0.2)
TOLERANCE = 1e-9  # distances are sums of quotients; ties are settled on nine digits


def _marks(name: Column) -> Column:
    """Characters of a name as numbered marks ('a1', 'a2', ...), rare characters first."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    numbered = F.transform(
        chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda d: d == c)).cast("string")))
    keyed = F.transform(
        numbered,
        lambda m: F.struct(F.instr(F.lit(LETTER_ORDER), F.lower(F.substring(m, 1, 1))).alias("k"), m.alias("m")))
    return F.transform(F.array_sort(keyed), lambda x: x.m)


def _need(la: Column, lb: Column, limit: float) -> Column:
    """Least number of common characters of two names whose Jaro distance is within ``limit``.

    From (m/la + m/lb + 1)/3 >= 1 - limit, the value with no transposition.
    """
    return F.ceil((2.0 - 3.0 * limit) * la * lb / (la + lb) - 1e-9)


def _keys(df: DataFrame, name: str, partner_lengths: Column, own: str, other: str, limit: float) -> DataFrame:
    """One row per name, partner length and prefix mark.

    Two names with enough common marks share one within the first
    ``length - need + 1`` marks of each, so joining on the mark loses no pair.
    """
    out = df.withColumns({"_marks": _marks(F.col(name)), own: F.length(name), "_lengths": partner_lengths})
    out = out.withColumn(other, F.explode("_lengths")).drop("_lengths")
    out = out.filter(_need(F.col(own), F.col(other), limit) <= F.least(own, other))
    size = F.col(own) - _need(F.col(own), F.col(other), limit) + 1
    marks = F.slice("_marks", 1, F.greatest(size, F.lit(0)).cast("int"))
    prefix = f"_prefix{own}"
    return out.withColumn(prefix, marks).withColumn("_mark", F.explode(prefix)).drop("_marks")


def close_pairs(left: DataFrame, right: DataFrame, on: list[str], name_l: str, name_r: str, limit: float) -> DataFrame:
    """Distinct pairs of names within a Jaro distance, with equal ``on`` columns; the distance as ``_dist``.

    Both sides hold one row per (on, name). No pair is formed unless the names share
    a prefix mark and their lengths allow the distance.
    """
    # The lengths that occur: some dozens of numbers per side.
    a = _keys(left, name_l, right.agg(F.collect_set(F.length(name_r))).scalar(), "_la", "_lb", limit)
    b = _keys(right, name_r, left.agg(F.collect_set(F.length(name_l))).scalar(), "_lb", "_la", limit)
    joined = a.join(b, [*on, "_la", "_lb", "_mark"])
    # A pair may share several marks; it is kept at the first one only.
    once = F.element_at(F.array_intersect("_prefix_la", "_prefix_lb"), 1) == F.col("_mark")
    pairs = joined.filter(once).select(*left.columns, *[c for c in right.columns if c not in on])
    return pairs.withColumn("_dist", 1.0 - jaro_once(name_l, name_r)).filter(F.col("_dist") <= limit + TOLERANCE)


def best_gazetteer_match(
    incidents: DataFrame, gazetteer: DataFrame, key: str = "incident_number", gaz_id: str = "gaz_id",
    max_dist: float = 0.4,
) -> DataFrame:
    """The closest gazetteer entry per incident, null columns where none is close enough.

    Both tables have state_name, district_name, village_name. States must be equal,
    the Jaro distances of district and village each at most ``max_dist``; the least
    sum wins, then the least gazetteer id. One row per key: repeated keys are merged.

    Distinct name triples are matched, not incidents. Equal names are settled by an
    equi-join. The rest goes through rising limits: when the best sum found within
    a limit does not exceed it, no pair outside the limit can be better, and the
    triple is done. Only what is left reaches the loosest limit.
    """
    names = ["state_name", "district_name", "village_name"]
    gaz = gazetteer.filter(F.col("village_name").isNotNull() & F.col("district_name").isNotNull()).groupBy(*names).agg(
        F.min(gaz_id).alias(gaz_id))
    # Both sides feed every round, so each is written once.
    gaz = durable(gaz.select("state_name", F.col("district_name").alias("gaz_district"),
                             F.col("village_name").alias("gaz_village"), gaz_id))
    want = incidents.select(*names).filter(
        F.col("village_name").isNotNull() & F.col("district_name").isNotNull()).distinct()

    exact = want.join(
        gaz,
        (want.state_name == gaz.state_name) & (want.district_name == gaz.gaz_district)
        & (want.village_name == gaz.gaz_village),
    ).select(*[want[c] for c in names], gaz.gaz_district, gaz.gaz_village, gaz[gaz_id],
             F.lit(0.0).alias("district_dist"), F.lit(0.0).alias("village_dist"))
    done = exact
    rest = durable(want.join(exact.select(*names), names, "left_anti"))
    for limit in [s for s in STEPS if s < max_dist] + [max_dist]:
        if rest.isEmpty():
            break
        found = _best_within(rest, gaz, names, gaz_id, limit)
        if limit < max_dist:
            found = durable(found.filter(F.col("district_dist") + F.col("village_dist") <= limit))
            rest = durable(rest.join(found.select(*names), names, "left_anti"))
        done = done.unionByName(found)

    best = incidents.join(done, names, "left")
    total = F.round(F.col("district_dist") + F.col("village_dist"), 9)
    cols = [c for c in best.columns if c != key]
    order = F.struct(total.isNull().alias("n"), total.alias("d"), F.col(gaz_id).alias("g"))
    return best.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_b")).select(key, "_b.*")


def _best_within(want: DataFrame, gaz: DataFrame, names: list[str], gaz_id: str, limit: float) -> DataFrame:
    """Best gazetteer entry per name triple with both distances within ``limit``."""
    districts = durable(close_pairs(
        want.select("state_name", "district_name").distinct(),
        gaz.select("state_name", "gaz_district").distinct(),
        ["state_name"], "district_name", "gaz_district", limit,
    ).withColumnRenamed("_dist", "district_dist"))
    # Village names are compared once per pair of districts that are close.
    left = want.join(districts, ["state_name", "district_name"])
    on = ["state_name", "gaz_district"]
    pairs = close_pairs(
        left.select(*on, "village_name").distinct(), gaz.select(*on, "gaz_village", gaz_id),
        on, "village_name", "gaz_village", limit,
    ).withColumnRenamed("_dist", "village_dist")
    cand = left.join(pairs, [*on, "village_name"])
    value = F.struct("gaz_district", "gaz_village", gaz_id, "district_dist", "village_dist")
    order = F.struct(F.round(F.col("district_dist") + F.col("village_dist"), 9).alias("d"), F.col(gaz_id).alias("g"))
    return cand.groupBy(*names).agg(F.min_by(value, order).alias("_b")).select(*names, "_b.*")


def match_rate(matched: DataFrame, found: str) -> DataFrame:
    """Rows, matched rows, percent matched."""
    return matched.agg(
        F.count("*").alias("total_rows"), F.count(found).alias("matched_rows"),
        (F.count(found) / F.count("*") * 100).alias("percent_matched"))


# ---- names in texts ----------------------------------------------------------------------

# Keys that a text and a name in it share, by the number of the name's words. Inside a name words are whole words of the
# text; its first word may begin, and its last word end, inside a longer one.
PAIR, WORD, SEAM, PIECE = "pair", "word", "seam", "piece"
#: Keys of a name at most, the longest ones; the one that the fewest texts hold is used.
ANCHORS = 3
#: Characters on each side of the seam of two words, and of a piece of a single word.
SEAM_SIDE, PIECE_SIZE = 2, 3


def _hashed(kind: str, *parts: Column) -> Column:
    """A key as 64 bits, so that a number of keys is a number of bytes; keys that collide are told apart when verified."""
    return F.xxhash64(F.lit(kind), *parts)


def _pieces(word: Column, size: int) -> Column:
    """The pieces of ``size`` characters of a word."""
    places = F.when(F.length(word) >= size, F.sequence(F.lit(1), F.length(word) - size + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(places, lambda i: word.substr(i, F.lit(size)))


def name_anchors(names: DataFrame, name: str) -> DataFrame:
    """(name, kind, a, b, size, key) of the keys of distinct names; a text that holds a name holds all of its keys."""
    words = names.select(name, F.split(name, r"\s+").alias("w")).withColumn("m", F.size("w"))

    def rows(at_words: str, kind: str, found: Column) -> DataFrame:
        return words.where(at_words).select(name, F.lit(kind).alias("kind"), F.explode(found).alias("s")).select(
            name, "kind", "s.a", "s.b", "s.size")

    def longest(found: Column) -> Column:
        """The few longest of an array of structs (length, ...)."""
        return F.slice(F.sort_array(F.array_distinct(found), asc=False), 1, ANCHORS)

    def side(word: Column, at_end: bool) -> Column:
        size = F.least(F.lit(SEAM_SIDE), F.length(word))
        return F.right(word, size) if at_end else F.left(word, size)

    inner = F.slice("w", F.lit(2), F.greatest(F.lit(0), F.col("m") - 3))
    after = F.slice("w", F.lit(3), F.greatest(F.lit(0), F.col("m") - 3))
    pairs = longest(F.zip_with(inner, after, lambda a, b: F.struct(
        (F.length(a) + F.length(b)).alias("size"), a.alias("a"), b.alias("b"))))
    first, last = F.col("w")[0], F.col("w")[1]
    seam = F.array(F.struct(side(first, True).alias("a"), side(last, False).alias("b"), F.lit(0).alias("size")))
    piece = F.least(F.lit(PIECE_SIZE), F.length(first))
    pieces = F.when(F.length(first) > 2, _pieces(first, 3)).when(F.length(first) > 1, _pieces(first, 2)).otherwise(
        _pieces(first, 1))
    found = rows("m > 3", PAIR, pairs).unionByName(
        rows("m = 3", WORD, F.array(F.struct(F.col("w")[1].alias("a"), F.lit("").alias("b"), F.lit(0).alias("size"))))).unionByName(
        rows("m = 2", SEAM, seam)).unionByName(rows("m = 1", PIECE, F.transform(
            F.array_distinct(pieces), lambda g: F.struct(g.alias("a"), F.lit("").alias("b"), piece.alias("size")))))
    return found.withColumn("key", F.xxhash64("kind", "a", "b"))


def _text_keys(texts: DataFrame, shapes: list) -> DataFrame:
    """(_key, key) of the texts (_key, words): all keys of the shapes that names have (kind, length of a and of b)."""
    kinds = {s.kind for s in shapes}
    found = []
    if kinds & {PAIR, SEAM}:
        n = F.greatest(F.lit(0), F.size("words") - 1)
        # Neighbours are exploded first and hashed as columns, which keeps both in generated code.
        pairs = texts.select("_key", F.inline(F.arrays_zip(
            F.slice("words", F.lit(1), n).alias("a"), F.slice("words", F.lit(2), n).alias("b"))))
        keys = [_hashed(PAIR, F.col("a"), F.col("b"))] if PAIR in kinds else []
        keys += [_hashed(SEAM, F.right("a", F.lit(s.la)), F.left("b", F.lit(s.lb))) for s in shapes if s.kind == SEAM]
        found.append(pairs.select("_key", keys[0].alias("key") if len(keys) == 1 else F.explode(F.array(*keys)).alias("key")))
    if kinds & {WORD, PIECE}:
        single = texts.select("_key", F.explode("words").alias("a"))
        if WORD in kinds:
            found.append(single.select("_key", _hashed(WORD, F.col("a"), F.lit("")).alias("key")))
        for s in shapes:
            if s.kind == PIECE:
                pieces = single.distinct().select("_key", F.explode(_pieces(F.col("a"), s.la)).alias("g"))
                found.append(pieces.select("_key", _hashed(PIECE, F.col("g"), F.lit("")).alias("key")))
    return reduce(DataFrame.unionByName, found)


def first_name_in_text(
    texts: DataFrame, names: DataFrame, text_id: str, text: str, name: str, position: str, out: str = "found_name",
) -> DataFrame:
    """Adds the first listed name that occurs in the text as a substring, null when none does.

    A text that holds a name holds the name's keys: two neighbouring words from inside it, or, for shorter names, the
    inner word, the characters around the only blank, or pieces of the only word. Texts are filtered by the keys that names
    have; of the keys of a name the one that the fewest texts hold brings the candidates, and each is verified. Texts
    are not moved, only their digests. What a row gets depends on its text alone, not on ``text_id``. Null and blank
    names match nothing; names without a position come last, equal positions by the name.
    """
    listed = names.select(F.col(name).alias("n"), F.col(position).alias("p")).filter("trim(n) <> ''").distinct()
    anchors = durable(name_anchors(listed.select("n").distinct(), "n"))
    shapes = anchors.select("kind", F.when(F.col("kind").isin(SEAM, PIECE), F.length("a")).alias("la"),
                            F.when(F.col("kind") == SEAM, F.length("b")).alias("lb")).distinct().collect()  # 14 at most
    keyed = texts.withColumn("_key", F.md5(F.col(text)))
    known = keyed.filter("_key is not null")
    blank = keyed.filter("_key is null").withColumn(out, F.lit(None).cast("string"))
    if not shapes:
        return known.withColumn(out, F.lit(None).cast("string")).unionByName(blank).drop("_key")
    keys = _text_keys(known.select("_key", F.split(F.col(text), r"\s+").alias("words")), shapes)
    hits = durable(keys.join(maybe_broadcast(anchors.select("key").distinct()), "key", "left_semi").distinct())
    spread = hits.groupBy("key").agg(F.count("*").alias("_spread"))
    rare = anchors.join(spread, "key", "left").groupBy("n").agg(
        F.min(F.struct(F.coalesce("_spread", F.lit(0)).alias("s"), F.col("key").alias("k"))).alias("a"))
    rare = rare.filter("a.s > 0").select("n", F.col("a.k").alias("key"))
    candidates = hits.join(rare, "key").select("_key", "n").distinct()
    # Few texts have candidates: where these are few as well, they go to the texts and no text is moved.
    checked = known.select("_key", F.col(text).alias("_text")).join(maybe_broadcast(candidates), "_key").filter(
        F.col("_text").contains(F.col("n"))).select("_key", "n").distinct().join(listed, "n")
    first = checked.groupBy("_key").agg(F.min_by("n", F.struct(F.col("p").isNull().alias("l"), "p", "n")).alias(out))
    return known.join(maybe_broadcast(durable(first)), "_key", "left").unionByName(blank).drop("_key")


def district_by_keyword(texts: DataFrame, districts: DataFrame, text_id: str, text: str, name: str,
                        position: str, out: str = "found_district") -> DataFrame:
    """District named in a text.

    The run of known words before the first ' district' is taken when it is a listed
    district; otherwise the first listed district that occurs in the text; else ''.
    Runs are found per distinct text, like the names.
    """
    low = texts.withColumn("_low", F.lower(F.col(text)))
    names = districts.select(F.lower(name).alias("n"), F.col(position).alias("p")).filter("trim(n) <> ''")
    known = names.select(F.explode(F.split("n", r"\s+")).alias("w")).union(names.select("n")).filter("w <> ''").distinct()
    before = F.split(strip(F.split(F.col("_low"), " district", 2)[0]), r"\s+")
    with_word = low.filter(F.col("_low").contains(" district")).select(
        F.md5("_low").alias("_key"), "_low").dropDuplicates(["_key"])
    exploded = with_word.select("_key", F.posexplode(before).alias("i", "w"))
    # A word is known as it stands or with its dashes as blanks.
    forms = exploded.select("_key", "i", "w", F.explode(F.array("w", F.replace("w", F.lit("-"), F.lit(" ")))).alias("form"))
    hits = forms.join(maybe_broadcast(known.withColumnRenamed("w", "form").withColumn("_k", F.lit(True))), "form", "left").groupBy(
        "_key", "i").agg(F.first("w").alias("w"), F.max(F.coalesce("_k", F.lit(False))).alias("_ok"))
    runs = hits.groupBy("_key").agg(
        F.coalesce(F.max(F.when(~F.col("_ok"), F.col("i"))), F.lit(-1)).alias("_stop"),
        F.array_sort(F.collect_list(F.struct("i", "w"))).alias("_ws"))
    run = F.filter(F.col("_ws"), lambda x: x.i > F.col("_stop"))
    run = F.replace(F.array_join(F.transform(run, lambda x: x.w), " "), F.lit("-"), F.lit(" "))
    listed = names.select(F.col("n").alias("_run")).distinct()
    named = runs.select("_key", run.alias("_run")).join(listed, "_run", "left_semi")
    guess = first_name_in_text(low, names, text_id, "_low", "n", "p", out="_first").withColumn("_key", F.md5("_low"))
    run = guess.filter("_key is not null").join(named, "_key", "left")
    # Null texts match no run; they stay out of the join, where they would all share one key.
    run = run.unionByName(guess.filter("_key is null").withColumn("_run", F.lit(None).cast("string")))
    return run.withColumn(out, F.coalesce("_run", "_first", F.lit(""))).drop("_key", "_low", "_run", "_first")


def tag_words(texts: DataFrame, dictionary: DataFrame, text_id: str, text: str) -> DataFrame:
    """(text_id, pos, word, label) of words found in a dictionary (word, label, priority); the least priority wins."""
    best = dictionary.groupBy("word").agg(F.min_by("label", "priority").alias("label"))
    words = texts.select(text_id, F.posexplode(F.split(F.col(text), r"\s+")).alias("pos", "word"))
    return words.join(maybe_broadcast(best), "word").select(text_id, "pos", "word", "label")


# ---- name statistics ---------------------------------------------------------------------


def names_by_state(df: DataFrame, district: str, state: str) -> DataFrame:
    """Per district: number of states and incidents. Pre-aggregated to (district, state) first."""
    pairs = df.filter(F.col(district).isNotNull()).groupBy(district, state).agg(F.count("*").alias("_n"))
    return pairs.groupBy(district).agg(F.count(state).alias("num_states"), F.sum("_n").alias("total_incidents"))


def conditional_probability(df: DataFrame, district: str, state: str, smoothing: float = 1.0) -> DataFrame:
    """P(state | district) with Laplace smoothing.

    One row for each pair that occurs, and one with a null state for each district: the probability of any state that
    does not occur with it. Every district and state can be read off these, without a row for each.
    """
    pairs = df.filter((F.trim(district) != "") & (F.trim(state) != "")).groupBy(
        F.trim(district).alias(district), F.trim(state).alias(state)).agg(F.count("*").alias("n"))
    states = pairs.agg(F.countDistinct(state)).scalar()
    per = pairs.groupBy(district).agg(F.sum("n").alias("_total"), F.collect_list(F.struct(state, "n")).alias("_seen"))
    none = F.array(F.struct(F.lit(None).cast("string").alias(state), F.lit(0).cast("bigint").alias("n")))
    rows = per.select(district, "_total", F.inline(F.concat("_seen", none)))
    return rows.select(district, state, "n", ((F.col("n") + smoothing) / (F.col("_total") + smoothing * states)).alias("p"))


def pair_with_baseline(baseline: DataFrame, model: DataFrame, key: str = "incident_number",
                       truth: str = "true_label", pred: str = "prediction") -> DataFrame:
    """Baseline and model predictions of the same incident with the same truth."""
    b = baseline.select(key, truth, F.col(pred).alias("prediction_baseline"))
    return b.join(model.withColumnRenamed(pred, "prediction_model"), [key, truth])
