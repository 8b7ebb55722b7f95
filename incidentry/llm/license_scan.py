"""License scan by diagonal voting, in built-in expressions only.

All rolling k-grams of a text's words are joined to the places where they stand in the license phrases. A gram at word
``i`` that stands at ``j`` of a phrase votes for the diagonal ``i - j``, where the phrase would start. A diagonal with
a vote from every gram is an exact place. Neighbouring diagonals, a few inserted or missing words apart, are merged,
and a merged span carries its label if it covers enough words of the phrase. The join compares the words themselves
beside their hash, so every vote is verified.

The phrases are fixed, so their table of grams is broadcast. A row none of whose gram hashes is in that table keeps
one row, and only the others' grams are exploded; what is shuffled are a row's figures and its votes.

Defined results: null or empty text has no words, no places, empty labels and score 0. Repeated rows and ids give one
row each. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
#: Diagonals of one phrase this far apart or nearer are one span.
MAX_SHIFT = 3
#: Share of a phrase's words that a span must cover to carry its label.
LEAST_COVER = 0.8

# The base phrases and their labels.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Phrases of our own, in the words that common notices use.
OWN_PHRASES = (
    ("agpl", "gnu affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("bsd", "released under the bsd license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
PHRASES = tuple((label, tuple(text.split()), True) for label, text in BASE_PHRASES) + tuple(
    (label, tuple(text.split()), False) for label, text in OWN_PHRASES)

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text. ``lower`` changes letters beyond A-Z too, which cannot make or break an ASCII phrase but for
    the Kelvin sign, the one letter that it turns into an ASCII word character alone."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(text.contains("K"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _at(words: Column, i: Column) -> list[Column]:
    return [F.element_at(words, (i + k).cast("int")) for k in range(K)]


def phrase_grams(spark) -> DataFrame:
    """(phrase, place, size, label, base, words of the gram, hash)."""
    rows = [(p, j, len(words), label, base, *words[j:j + K])
            for p, (label, words, base) in enumerate(PHRASES) for j in range(len(words) - K + 1)]
    names = ", ".join(f"g{k} string" for k in range(K))
    grams = spark.createDataFrame(rows, f"phrase int, place int, size int, label string, base boolean, {names}")
    return grams.withColumn("hash", F.xxhash64(*[f"g{k}" for k in range(K)]))


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_words, phrase, size, label, base, diagonal, votes, covered): one row for each diagonal that a row of
    ``docs`` votes for, and for each row one with null phrase. ``covered`` has a bit for each word of the phrase."""
    spark = docs.sparkSession
    grams = phrase_grams(spark)
    hashes = F.array(*[F.xxhash64(*map(F.lit, words[j:j + K]))
                       for _, words, _ in PHRASES for j in range(len(words) - K + 1)])
    split = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
                        words_of(F.col(text_col)).alias("words"))
    places = F.when(F.size("words") >= K, F.sequence(F.lit(1), F.size("words") - K + 1))
    hashed = split.select("id", "row", "words", F.transform(
        places, lambda i: F.xxhash64(*_at(F.col("words"), i))).alias("hashes"))
    whole = F.transform(F.sequence(F.lit(1), F.size("words") - K + 1), lambda i: F.struct(
        (i - 1).alias("at"), F.element_at("hashes", i.cast("int")).alias("hash"),
        *[w.alias(f"w{k}") for k, w in enumerate(_at(F.col("words"), i))]))
    rows = hashed.select("id", "row", F.size("words").cast("long").alias("n_words"), F.explode_outer(
        F.when(F.arrays_overlap("hashes", hashes), whole)).alias("gram"))
    met = rows.select("id", "row", "n_words", "gram.*").join(
        F.broadcast(grams.withColumnRenamed("hash", "phrase_hash")),
        (F.col("hash") == F.col("phrase_hash")) & (F.col("w0") == F.col("g0")) & (F.col("w1") == F.col("g1"))
        & (F.col("w2") == F.col("g2")), "left")
    bits = F.expr(f"shiftleft({2 ** K - 1}L, place)")
    return met.groupBy("row", "id", "n_words", "phrase", "size", "label", "base", (F.col("at") - F.col("place")).alias(
        "diagonal")).agg(F.count("place").alias("votes"), F.bit_or(bits).alias("covered")).withColumn(
        "diagonal", F.when(F.col("phrase").isNotNull(), F.col("diagonal")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``score`` is the largest share of a phrase's words that one span covers.
    """
    found = votes(docs, id_col, text_col)
    line = Window.partitionBy("row", "phrase").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(line) > MAX_SHIFT
    marked = found.withColumn("span", F.when(F.col("phrase").isNotNull(), F.sum(
        F.coalesce(far, F.lit(False)).cast("int")).over(line)))
    exact = F.col("base") & (F.col("votes") == F.col("size") - K + 1)
    spans = marked.groupBy("row", "id", "n_words", "phrase", "span").agg(
        F.first("label").alias("label"), (F.bit_count(F.bit_or("covered")) / F.first("size")).alias("cover"),
        F.count(F.when(exact, 1)).alias("places"), F.min(F.when(exact, F.col("diagonal"))).alias("first"),
        F.max(F.when(exact, F.col("diagonal"))).alias("last"))
    named = F.when((F.col("cover") >= LEAST_COVER) | (F.col("places") > 0), F.col("label"))
    joined = [F.array_join(F.array_sort(F.collect_set(c)), ",") for c in (
        F.when(F.col("places") > 0, F.col("label")), named)]
    return spans.groupBy("row", "id", "n_words").agg(
        F.sum("places").alias("n_base"), F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"), joined[0].alias("base_labels"), joined[1].alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    ).select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
