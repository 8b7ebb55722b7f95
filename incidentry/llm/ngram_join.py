"""N-gram Jaccard join: documents whose sets of five-word shingles overlap by 80 of 100 or more, and their components.

The join is exact. Equal sets are one class, found by a fingerprint. Between classes:

1. The shingles in one fixed range of the hash space are counted over all classes. Shingles are ordered by how
   many classes hold them, so those that one class alone holds come first. A class with more of these than its
   prefix is long has no partner and leaves. That takes out nearly all, among them documents that share passages.
2. The rest are counted over their whole sets and ordered again, rare shingles first.
3. Two sets that overlap enough share at least ``l`` shingles in prefixes that are lengthened by ``l - 1``. Either
   one of these is rare, and is a key of its own; or all are frequent, and as they fall into ``l - 1`` groups by
   hash, two of them meet in one group: every pair of frequent shingles in a group of the prefix is a key. ``l``
   follows from a size class, and sets of neighbouring classes write keys for both. The smaller set of a pair
   needs the shorter prefix ``n - 8n/9``, so only its keys of that prefix are matched.
4. Under each key every set is first held against one set, the most central, and small keys are paired. Large keys
   whose sets are not in one component are lengthened by shingles outside of their smallest set until they are small
   (``set_links``): a combination of ever more tokens. A large group of copies costs a few pairs a member and round.

Set fingerprints and shingles are 64-bit hashes. Defined results: null or empty text has an empty set, is its own
component and is linked with nothing; rows that repeat an id are one document with several texts; a null id counts
for nothing in a component and stays null where no other id is there. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import LOWER, checked_broadcast, mixed, row_map, worker_store, written
from incidentry.llm.components import components
from incidentry.llm.set_links import links_within

SHINGLE = 5
#: Shingles held by so many classes or fewer are rare: each is a key of its own.
RARE = 8
#: The range of hashes counted first, as a share of all.
HEAD_SHARE = 0.3
_HEAD_END = int(HEAD_SHARE * 2 ** 64) - 2 ** 63

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 to the 64, at least ``n`` of them."""
    store = worker_store("powers", lambda: [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(store[0]) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        inverse = pow(_BASE, -1, 2 ** 64)
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            store[k] = np.cumprod(steps, dtype=np.uint64)
    return store[0], store[1]


def word_hashes(text: str | None, table: bytes = LOWER) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, its bytes changed by ``table`` first, from running sums."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(table), np.uint8)
    solid = np.concatenate(([False], ~_SPACE[raw], [False])).view(np.int8)
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        return mixed(h + mixed((ends - starts).astype(np.uint64)))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text, as signed 64-bit values."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    k = min(SHINGLE, n)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(_BASE) + words[j:j + n - k + 1]
        return np.unique(mixed(h).view(np.int64))


def fingerprint(tokens: np.ndarray) -> int:
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(n: int) -> int:
    """The least overlap of a set of ``n`` with any partner."""
    return (4 * n + 4) // 5


def _class_starts() -> list[int]:
    starts = [1]
    while starts[-1] < 2 ** 48:
        starts.append((5 * starts[-1] + 3) // 4)
    return starts


CLASS_STARTS = _class_starts()


def groups_of(size_class: int) -> int:
    """Groups of frequent shingles in a size class: about four shingles of the longest prefix in each."""
    longest = CLASS_STARTS[min(size_class + 2, len(CLASS_STARTS) - 1)] - 1
    return max(1, (longest - needed(longest) + 1) // 4)


def keys_of(n: int, shared: list[tuple[int, int]]) -> list[tuple[int, bool]]:
    """(key, whether the key is in the shorter prefix) of a set of ``n`` shingles.

    ``shared`` are the (count, shingle) that other sets hold too; all others come before them in the order.
    """
    ordered = sorted(shared)
    alone = n - len(ordered)
    own = bisect_right(CLASS_STARTS, n) - 1
    out: dict[int, bool] = {}
    for size_class in (own, own - 1):
        if size_class < 0:
            continue
        g = groups_of(size_class)
        long, short = n - needed(n) + g + 1, n - (8 * n + 8) // 9 + g + 1
        if short - alone <= g:  # too few shared shingles to meet a larger set
            short = 0
        groups: dict[int, list[tuple[int, int]]] = {}
        for at, (count, token) in enumerate(ordered[:max(0, long - alone)], alone):
            if count <= RARE:
                out[token] = out.get(token, False) or at < short
            else:
                groups.setdefault((token >> 17) % g, []).append((token, at))
        for members in groups.values():
            for j, (b, at_b) in enumerate(members):
                for a, at_a in members[:j]:
                    pair = np.array([min(a, b), max(a, b), size_class], np.int64)
                    out[fingerprint(pair)] = max(at_a, at_b) < short
    return list(out.items())


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n, the fingerprint ``ref`` of its set, and ``head``, its shingles in the range counted first."""

    def one(i, text):
        tokens = shingles(text)
        return i, len(tokens), fingerprint(tokens), tokens[:np.searchsorted(tokens, _HEAD_END)].tolist()

    kind = dict(docs.dtypes)[id_col]
    return row_map(docs, one, f"id {kind}, n int, ref long, head array<long>", [id_col, text_col], rows=200)


def _held_by_others(tokens: DataFrame) -> DataFrame:
    """Of (ref, token) rows: the tokens that more than one ref holds, with the number of rows."""
    return tokens.groupBy("token").agg(
        F.min("ref").alias("lo"), F.max("ref").alias("hi"), F.count("*").alias("count")).where("lo <> hi").select(
        "token", "count")


def _hopeful(sets: DataFrame) -> DataFrame:
    """Classes that may have a partner: (ref, id of a row that holds the set, n)."""
    head = sets.select("ref", F.explode("head").alias("token"))
    shared = written(_held_by_others(head).select("token"), "shared-shingles")
    met = head.join(shared, "token").groupBy("ref").agg(F.count("*").alias("met"))
    classes = sets.where("n >= 4").groupBy("ref").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first(F.size("head")).alias("in_head"),
        F.count("*").alias("copies"))
    alone = F.col("in_head") - F.coalesce(F.col("met"), F.lit(0)) / F.col("copies")
    return classes.join(met, "ref", "left").where(alone < F.expr("n - (4 * n + 4) div 5 + 1")).select("ref", "id", "n")


def _full_sets(docs: DataFrame, hopeful: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ref, n, tokens) of the classes still in question, from their texts."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        checked_broadcast(hopeful.select("id", F.col("ref").alias("wanted")), 32), "id")

    def one(wanted, text):
        tokens = shingles(text)
        ref = fingerprint(tokens)
        return (ref, len(tokens), tokens.tolist()) if ref == wanted else (None, None, None)

    found = row_map(texts, one, "ref long, n int, tokens array<long>", ["wanted", "text"], rows=200)
    return found.where("ref is not null").dropDuplicates(["ref"])


def _keys(full: DataFrame) -> DataFrame:
    """(key, ref, n, cap, short): ``cap`` is the number of shingles that other sets hold too."""
    tokens = full.select("ref", F.explode("tokens").alias("token"))
    shared = written(_held_by_others(tokens), "counted-shingles")
    lists = tokens.join(shared, "token").groupBy("ref").agg(
        F.collect_set(F.struct("count", "token")).alias("shared"))
    sized = full.select("ref", "n").distinct().join(lists, "ref")
    short = "n - (4 * n + 4) div 5 + 1"
    sized = sized.where(f"n - size(shared) < {short}")

    def one(ref, n, shared):
        keys = keys_of(n, [(x["count"], x["token"]) for x in shared])
        return ref, n, len(shared), [{"key": k, "short": s} for k, s in keys]

    return row_map(sized, one, "ref long, n int, cap int, keys array<struct<key:long,short:boolean>>",
                   ["ref", "n", "shared"], rows=200).select("ref", "n", "cap", F.inline("keys"))


def links(docs: DataFrame, sets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) between classes: enough of them to join all that are linked."""
    hopeful = written(_hopeful(sets), "hopeful")
    full = written(_full_sets(docs, hopeful, id_col, text_col), "full-sets")
    lone = ((F.col("n") - F.col("cap")) / F.col("n")).alias("rank")
    keys = written(_keys(full).select("key", "ref", "n", "cap", "short", lone), "keys")
    return links_within(keys, full, _one_id(sets))


def _one_id(sets: DataFrame) -> DataFrame:
    """Links between the classes of rows that repeat an id with other texts."""
    rows = sets.where("n > 0").select("id", "ref")
    several = rows.groupBy("id").agg(F.min("ref").alias("lo"), F.max("ref").alias("hi")).where("lo <> hi")
    return rows.join(several, "id").where("ref <> lo").select(F.col("ref").alias("a"), F.col("lo").alias("b"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, ``n_shingles`` and ``component_id``, the least id reachable by links."""
    sets = written(shingle_sets(docs, id_col, text_col), "shingle-sets")
    roots = components(links(docs, sets, id_col, text_col))
    return place_components(sets, roots, id_col)


def place_components(sets: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    classes = sets.where("n > 0").groupBy("ref").agg(F.min("id").alias("least")).join(
        roots.select(F.col("node").alias("ref"), "root"), "ref", "left").withColumn("root", F.coalesce("root", "ref"))
    classes = written(classes, "classes")
    whole = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = classes.join(whole, "root").select("ref", "component_id")
    rows = sets.select("id", "n", "ref")
    found = rows.where("n > 0").join(placed, "ref").select("id", "n", "component_id")
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(empty).select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of its least id. Empty texts are linked with nothing and stay.

    Of rows that repeat the kept id one stays. Rows without an id cannot be told apart and all stay.
    """
    placed = written(near_components(docs, id_col, text_col), "components")
    gone = placed.where(f"not {id_col} <=> component_id").select(id_col).distinct()
    kept = docs.join(checked_broadcast(gone, 16), id_col, "left_anti")
    twice = placed.where("n_shingles > 0").groupBy(id_col).count().where("count > 1").select(id_col)
    twice = written(twice.join(gone, id_col, "left_anti"), "repeated-ids")
    if twice.isEmpty():
        return kept
    sent = checked_broadcast(twice, 16)
    return kept.join(sent, id_col, "left_anti").unionByName(
        kept.join(sent, id_col, "left_semi").dropDuplicates([id_col]))


