"""Near duplicates by MinHash: sets of two-word shingles that overlap by 80 of 100 or more, and their components.

1. A row's set gives ``BANDS * ROWS`` minima, each of a universal hash ``a x + b`` of its own, in one pass over the
   text. Equal sets are one class, found by a fingerprint; all later steps work on classes.
2. ``ROWS`` neighbouring minima are a band. Two sets of similarity 0.8 agree in a band with probability 0.26, and in
   none of the 48 with 5e-7: that is the share of links banding may lose. Sets that agree in a band share a bucket.
3. Pairs are taken from buckets by ``set_links``: stars around the most central set, all pairs of small buckets, and
   keys of shared shingles for large ones, so no bucket is paired whole and none is cut.
4. A pair goes on if the signatures, one byte of each minimum, agree in enough places for 0.8 (the bound is six
   standard deviations away), and is a link if the whole sets say so.
5. Links become components by alternating large-star and small-star rounds.

Defined results: null or empty text has an empty set, is its own component and is linked with nothing; rows that
repeat an id are one document with several texts; a null id counts for nothing in a component, stays null where no
other id is there, and a text that only rows without an id hold links nothing. Words are cut and lower-cased (A-Z) as in the n-gram join. Set fingerprints and shingles are 64-bit
hashes. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import checked_broadcast, in_few_tasks, mixed, row_map, written
from incidentry.llm.components import components
from incidentry.llm.ngram_join import fingerprint, place_components, word_hashes
from incidentry.llm.set_links import links_within

SHINGLE = 2
#: Minima in a band, and bands.
ROWS, BANDS = 6, 48
SEED = 20240229
#: Least share of equal signature bytes of a pair that may be linked: 0.8 less six standard deviations.
SIGNATURE_SHARE = 0.8 - 6 * (0.8 * 0.2 / (ROWS * BANDS)) ** 0.5
#: Shingles hashed at once, times the number of hashes: what a core's cache holds.
BLOCK = 256

_BASE = 0x9E3779B97F4A7C15 | 1


def hash_family(count: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of ``count`` universal hashes of 32 bits."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2 ** 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2 ** 32, count, dtype=np.uint32)


_FACTORS, _ADDENDS = hash_family(ROWS * BANDS)
_BAND_FACTORS = np.random.default_rng(SEED + 1).integers(0, 2 ** 63, ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text as signed values; a shorter text is one shingle."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    k = min(size, n)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(_BASE) + words[j:j + n - k + 1]
        return np.unique(mixed(h).view(np.int64))


def minima(tokens: np.ndarray) -> np.ndarray:
    """The least value of every hash of the family over a set that is not empty."""
    short = (tokens.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), 2 ** 32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(short), BLOCK):
            np.minimum(least, (short[at:at + BLOCK, None] * _FACTORS + _ADDENDS).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band of minima."""
    with np.errstate(over="ignore"):
        sums = (least.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64)
        return mixed(sums + np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE)).view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n, the fingerprint ``ref`` of its set and the band keys; these are null for no words."""

    def one(i, text):
        tokens = shingle_set(text)
        if not len(tokens):
            return i, 0, fingerprint(tokens), None
        return i, len(tokens), fingerprint(tokens), band_keys(minima(tokens)).tolist()

    kind = dict(docs.dtypes)[id_col]
    return row_map(docs, one, f"id {kind}, n int, ref long, bands array<long>", [id_col, text_col], rows=200)


def buckets(rows: DataFrame) -> DataFrame:
    """(key, ref, n) of the bands that more than one class falls into; ``rows`` is the table of signatures."""
    bands = rows.where("n > 0").select("ref", "n", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("ref").alias("lo"), F.max("ref").alias("hi")).where("lo <> hi").select("key")
    return bands.join(shared, "key", "left_semi").distinct()


def signature(least: np.ndarray) -> bytes:
    """One byte of each minimum."""
    return least.astype(np.uint8).tobytes()


def alike(x: bytes, y: bytes) -> bool:
    """Whether two signatures agree in enough places for linked sets."""
    equal = int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum())
    return equal >= SIGNATURE_SHARE * ROWS * BANDS


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ref, tokens, signature) of the wanted classes (id of a row that holds the set, ref), from their texts."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        checked_broadcast(wanted.select("id", F.col("ref").alias("wanted")), 32), "id")

    def one(ref, text):
        tokens = shingle_set(text)
        if fingerprint(tokens) != ref:
            return None, None, None
        return ref, tokens.tolist(), signature(minima(tokens))

    found = row_map(texts, one, "ref long, tokens array<long>, signature binary", ["wanted", "text"], rows=200)
    return found.where("ref is not null").dropDuplicates(["ref"])


def links(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) between classes, by banding, signatures and whole sets."""
    keys = written(buckets(rows), "buckets")
    count = keys.count()
    # The set that shares most buckets is the most central one.
    central = keys.groupBy("ref").agg((-F.count("*")).cast("double").alias("rank"))
    keys = keys.join(central, "ref").select("key", "ref", "n", F.col("n").alias("cap"), F.lit(True).alias("short"), "rank")
    met = written(in_few_tasks(rows.where("n > 0").join(central.select("ref"), "ref", "left_semi").groupBy("ref").agg(
        F.min("id").alias("id")), count), "bucketed-classes")
    full = written(in_few_tasks(_full_sets(docs, met.where("id is not null"), id_col, text_col), count), "full-sets")
    named = rows.where("n > 0").select("id", "ref")
    several = named.groupBy("id").agg(F.min("ref").alias("lo"), F.max("ref").alias("hi")).where("lo <> hi")
    one_id = named.join(several, "id").where("ref <> lo").select(F.col("ref").alias("a"), F.col("lo").alias("b"))
    return links_within(keys, full, one_id, alike)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, ``n_shingles``, ``component_id``, the least id reachable by links, and ``kept``.

    ``kept`` is true where the id is that of its component, so one document of each group stays.
    """
    rows = written(signatures(docs, id_col, text_col), "signatures")
    roots = components(links(docs, rows, id_col, text_col))
    return place_components(rows, roots, id_col).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id is not that of their component. Rows that repeat a kept id or have none stay."""
    gone = written(near_components(docs, id_col, text_col).where("not kept").select(id_col).distinct(), "repeats")
    return docs.join(checked_broadcast(gone, 16), id_col, "left_anti")
