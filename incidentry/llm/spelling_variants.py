"""Spelling variants: words that one inserted, deleted or replaced code point makes alike, by variable-length grams.

1. Words are counted over all texts; each task adds up its batches before the shuffle.
2. The gram dictionary holds every gram of ``MIN_GRAM`` characters, and longer ones up to ``MAX_GRAM`` only below
   frequent grams: rare grams are not lengthened, their longer forms are pruned. What tells the dictionary apart is
   thus the set of frequent grams. A gram is frequent above a share of all places, so there are ``EXTENDED`` of each
   length at most, whatever the corpus.
3. A word between its ends ``^`` and ``$`` is decomposed into the longest gram of the dictionary at each place. Whether
   a gram is lengthened depends on its own characters alone, so an edit changes just the grams that reach over it: from
   the first that does to the edited place, at most ``affected`` places. That bound is each word's own.
4. So a word within one edit keeps its first ``a`` and last ``b`` grams with ``a + b >= places - affected``. Lists of
   grams are merged up to that number at once: a key is the first ``j`` and the last ``T - j`` grams, for each ``j``, and
   words under one key are candidates. ``T`` is the word's own bound and the lower ones that a word one character shorter
   may have, and one of a pair stands under its own bound.
5. Candidates are verified by their edit distance inside the join, so only near pairs come out of it. Very long words
   take part by a digest and are verified after it.

Defined results: null texts have no words; a null id counts as the empty text before the colon; rows that repeat an id
are counted one by one. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import LOWER, arrow_schema, written

MIN_GRAM, MAX_GRAM = 2, 3
#: Frequent grams of one length at most: one is frequent above ``places / EXTENDED``.
EXTENDED = 20_000
#: Grams of so many places or fewer are never frequent.
RARE_PLACES = 50
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One in so many (document, word) pairs loses a code point before words are counted.
DAMAGE = 31
#: A form is used so many times as often as its word.
FORM_FACTOR = 10

#: Words of more code points are sent by a digest and fetched again, as each has as many keys as characters.
USUAL_LENGTH = 64

# Only runs that can give a word: a match is a maximal run all the same, as it is greedy and starts at the run's start.
_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_PRIME = (1 << 61) - 1
_BASE = 0x1B873593CC9E2D51 % _PRIME


def words_of(doc_id: object, text: str | None) -> Counter:
    """The words of a text with their counts, damaged by the crc32 of ``<doc_id>:<word>`` where 31 divides it."""
    low = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
    head = zlib.crc32(("" if doc_id is None else str(doc_id)).encode("utf-8", "surrogatepass") + b":")
    out: Counter = Counter()
    for word, n in Counter(_RUN.findall(low)).items():
        h = zlib.crc32(word.encode("utf-8"), head)
        if h % DAMAGE == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < LEAST_LENGTH:
                continue
        out[word] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of seven code points or more that occur twice or more in all texts together."""
    import pyarrow as pa

    target = arrow_schema("word string, n long")

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in words_of(i, text).items():
                    found[word] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), target[0].type), pa.array(list(found.values()), target[1].type)], schema=target)

    return docs.select(id_col, text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def frequent_grams(words: DataFrame) -> frozenset:
    """The grams below which the dictionary has longer ones; at most ``EXTENDED`` of each length."""
    import pyarrow as pa

    target = arrow_schema("gram string, n long")

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for word in batch.column(0).to_pylist():
                padded = f"^{word}$"
                for q in range(MIN_GRAM, MAX_GRAM):
                    found.update(padded[p:p + q] for p in range(len(padded) - q + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), target[0].type), pa.array(list(found.values()), target[1].type)], schema=target)

    places = F.lit(words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0])
    grams = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    common = grams.where((F.col("n") > RARE_PLACES) & (F.col("n") > places / EXTENDED))
    return frozenset(r.gram for r in common.select("gram").toLocalIterator())


def gram_ends(padded: str, frequent: frozenset) -> list[int]:
    """Where the longest gram of the dictionary ends, for each place of a word between its ends."""
    size, ends = len(padded), []
    for p in range(size - MIN_GRAM + 1):
        end = p + MIN_GRAM
        while end - p < MAX_GRAM and end < size and padded[p:end] in frequent:
            end += 1
        ends.append(end)
    return ends


def affected(ends: list[int], size: int) -> int:
    """The most places from the first gram that reaches an edited character to that character; a word has ``size``
    characters with its ends. At most ``MAX_GRAM``."""
    most = first = 0
    for at in range(1, size):
        while first < at and ends[first] <= at:
            first += 1
        if first < len(ends) and ends[first] > at:
            most = max(most, min(at, len(ends) - 1) - first + 1)
    return most


def keys_of(word: str, frequent: frozenset) -> list[tuple[int, bool]]:
    """(key, whether it is under the word's own bound) for each number of merged grams ``T`` and split of it."""
    padded = f"^{word}$"
    size = len(padded)
    ends = gram_ends(padded, frequent)
    places = len(ends)
    heads, tails, power = [0], [0] * (size + 1), 1
    for c in padded:
        heads.append((heads[-1] * _BASE + ord(c) + 1) % _PRIME)
    for k in range(size - 1, -1, -1):
        tails[k] = (tails[k + 1] + (ord(padded[k]) + 1) * power) % _PRIME
        power = power * _BASE % _PRIME
    reach = [0]
    for end in ends:
        reach.append(max(reach[-1], end))
    own = places - affected(ends, size)
    # A word one character shorter has one place less, and at most MAX_GRAM of them affected.
    low = max(0, places - 1 - MAX_GRAM)
    out = []
    for merged in range(low, own + 1):
        for j in range(merged + 1):
            start = places - (merged - j) if merged > j else size
            key = (heads[reach[j]] * 0x9E3779B97F4A7C15 + tails[start] * 0xC2B2AE3D27D4EB4F
                   + merged * 0x165667B19E3779F9 + j * 0x27D4EB2F165667C5) & (2 ** 64 - 1)
            key ^= key >> 29
            out.append((key - (1 << 64) if key >> 63 else key, merged == own))
    return out


def _named(words: DataFrame) -> DataFrame:
    """(name, word, n): a word of usual length is its own name, a longer one goes by ``#`` and a digest."""
    return words.select(F.when(F.length("word") <= USUAL_LENGTH, F.col("word")).otherwise(
        F.concat(F.lit("#"), F.md5("word"))).alias("name"), "word", "n")


def _keyed(words: DataFrame, frequent: frozenset) -> DataFrame:
    """(key, name, length, n, own) of every word, the name in its place."""
    import pyarrow as pa

    schema = "key long, name string, length int, n long, own boolean"
    target = arrow_schema(schema)
    sent = words.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for batch in batches:
            keys, at, own, length = [], [], [], []
            for i, word in enumerate(batch.column(1).to_pylist()):
                for key, mine in keys_of(word, sent.value):
                    keys.append(key)
                    at.append(i)
                    own.append(mine)
                    length.append(len(word))
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column(0).take(rows).cast(target[1].type),
                 pa.array(length, pa.int32()), batch.column(2).take(rows), pa.array(own, pa.bool_())], schema=target)

    return _named(words).mapInArrow(run, schema)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of the distinct ``words`` (word, n) that one edit makes alike, both ways round."""
    keyed = _keyed(words, frequent_grams(words))
    left = keyed.where("own").drop("own")
    right = keyed.select("key", *[F.col(c).alias(f"other_{c}") for c in ("name", "length", "n", "own")])
    # Under one of the two bounds, and once if it is both words' own.
    met = left.join(right, "key").where("not other_own or name < other_name").where(
        "abs(length - other_length) <= 1 and name <> other_name").where(
        "greatest(length, other_length) > {0} or levenshtein(name, other_name, 1) = 1".format(USUAL_LENGTH))
    swapped = F.col("name") > F.col("other_name")
    met = met.select(
        F.when(swapped, F.col("other_name")).otherwise(F.col("name")).alias("name"),
        F.when(swapped, F.col("other_n")).otherwise(F.col("n")).alias("n"),
        F.when(swapped, F.col("name")).otherwise(F.col("other_name")).alias("other_name"),
        F.when(swapped, F.col("n")).otherwise(F.col("other_n")).alias("other_n"),
        (F.greatest("length", "other_length") > USUAL_LENGTH).alias("long")).distinct()
    met = written(met, "near-names")
    found = met.where("not long").select(F.col("name").alias("word"), "n", F.col("other_name").alias("other"), "other_n")
    whole = _named(words.where(F.length("word") >= USUAL_LENGTH)).drop("n")
    long = met.where("long").join(whole, "name").join(
        whole.select(F.col("name").alias("other_name"), F.col("word").alias("other")), "other_name")
    found = found.unionByName(
        long.where("levenshtein(word, other, 1) = 1").select("word", "n", "other", "other_n"))
    return found.unionByName(found.select(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"),
        F.col("n").alias("other_n")))


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of the largest count, if it is used ten times as often."""
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("b")
    met = pairs.groupBy(F.col("word").alias("near_word")).agg(F.count("*").alias("n_near"), best)
    joined = words.join(met, words["word"] == met["near_word"], "left")
    is_form = -F.col("b.m") >= FORM_FACTOR * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("b.w")).alias("form"), F.when(is_form, -F.col("b.m")).alias("form_n"))


def roots(steps: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form (word, form): the end of the chain of forms.

    Each round doubles how far a word sees, and counts grow tenfold along a chain, so five rounds see its end.
    """
    now = steps.select("word", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = written(now.join(further, "root", "left"), "roots")
        if joined.where("next is not null").isEmpty():
            return joined.select("word", "root")
        now = joined.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, form, root, n, n_near and form_n."""
    words = written(word_counts(docs, id_col, text_col), "words")
    formed = written(forms(words, near_pairs(words)), "forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
