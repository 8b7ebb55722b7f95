"""Benchmark decontamination: words of documents that lie in a window of benchmark words.

The windows of all items are gathered into one set, a hash per window, and sent to every task when the set is
measured to be small. A document's windows are looked up by hash and each hit is verified word by word. A set
beyond the bound is joined by hash instead; both ways give the same rows.

Defined results: null or empty text has no words; an item without words has no window; an item of fewer words
than a window is one window of its own length. Items that repeat an id count once; an item whose id is null
takes part under the empty id. Repeated documents give one row each. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import plain_words, row_map, sha256

WINDOW = 10
#: Windows of the benchmark that are broadcast at most; their words are bounded with them.
MAX_BROADCAST_BYTES = 48 * 1024 * 1024

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def windows_of(words: list, size: int = WINDOW) -> list[tuple]:
    if not words:
        return []
    if len(words) < size:
        return [tuple(words)]
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]


def rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit polynomial of each window of ``size`` ids."""
    n = len(ids) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        with np.errstate(over="ignore"):
            for k in range(size):
                h = h * _FACTOR + ids[k:k + n]
    return h


class WindowSet:
    """Windows of benchmark items: word numbers, and for each length the sorted hashes and what they stand for."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple, set[str]] = {}
        for item, text in items:
            for w in windows_of(plain_words(text), size):
                key = tuple(self.numbers.setdefault(x, len(self.numbers) + 1) for x in w)
                owners.setdefault(key, set()).add(item)
        self.owners = {k: tuple(sorted(v)) for k, v in owners.items()}
        self.hashes: dict[int, np.ndarray] = {}
        for n in sorted({len(k) for k in owners}):
            keys = np.array([k for k in owners if len(k) == n], np.uint64)
            h = np.zeros(len(keys), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    h = h * _FACTOR + keys[:, k]
            self.hashes[n] = np.unique(h)

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items found."""
        hit, found = np.zeros(len(words), bool), set()
        number = self.numbers.get
        ids = np.fromiter([number(w, 0) for w in words], np.uint64, len(words))
        for n, hashes in self.hashes.items():
            rolls = rolled(ids, n)
            if not len(rolls):
                continue
            at = np.searchsorted(hashes, rolls)
            at[at == len(hashes)] = 0
            for i in np.flatnonzero(hashes[at] == rolls):
                who = self.owners.get(tuple(ids[i:i + n].tolist()))
                if who:
                    hit[i:i + n] = True
                    found.update(who)
        return hit, found


def _text_spans(text: str, hit: np.ndarray) -> str:
    """The text without its hit words; what stands between two hit words goes with them."""
    raw = text.encode("utf-8", "surrogatepass")
    import re

    out, last, n = [], 0, len(hit)
    for i, m in enumerate(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)):
        if hit[i]:
            if i == 0 or not hit[i - 1]:
                out.append(raw[last:m.start()])
            last = m.end()
        elif i + 1 == n:
            break
    out.append(raw[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                            F.coalesce(F.col(text_col), F.lit("")).alias("words"))


def window_set(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW,
               max_bytes: int = MAX_BROADCAST_BYTES) -> WindowSet | None:
    """The windows of a benchmark measured to be small, else None. A window is about 100 bytes to each of text."""
    items = _items(benchmark, item_col, text_col)
    total = items.agg(F.sum(F.octet_length("words") + 64)).first()[0] or 0
    if total * 20 > max_bytes:
        return None
    return WindowSet([(r.item, r.words) for r in items.collect()], size)


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", size: int = WINDOW,
         max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    found = window_set(benchmark, item_col, item_text, size, max_bytes)
    if found is None:
        return _joined_hits(docs, benchmark, id_col, text_col, item_col, item_text, size, schema)
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def one(i, text):
        words = plain_words(text)
        hit, items = sent.value.find(words)
        n = int(hit.sum())
        return i, len(words), n, len(items), sha256(",".join(sorted(items))), n > 0

    return row_map(docs, one, schema, [id_col, text_col])


def _hashed(words: list[bytes], size: int) -> list[tuple[int, int]]:
    """(start, hash) of each window; the hash is of the words' bytes, so any two tasks agree on it."""
    import xxhash

    return [(i, xxhash.xxh3_64_intdigest(b" ".join(words[i:i + size])) - 2 ** 63)
            for i in range(len(words) - size + 1)]


def _joined_hits(docs, benchmark, id_col, text_col, item_col, item_text, size, schema):
    """Windows of both sides meet in a shuffled join by hash; each row's hits are gathered and verified."""
    lengths = [r[0] for r in row_map(
        _items(benchmark, item_col, item_text),
        lambda item, text: (min(size, len(plain_words(text))),), "n int", ["item", "words"]).distinct().collect()]
    lengths = sorted(n for n in lengths if n)  # at most ``size`` values

    def item_rows(batches):
        import pyarrow as pa

        for batch in batches:
            item, key, words = [], [], []
            for who, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                w = plain_words(text)
                n = min(size, len(w))
                for i, h in _hashed(w, n) if n else []:
                    item.append(who), key.append(h), words.append(b" ".join(w[i:i + n]))
            yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.string()), "key": pa.array(key, pa.int64()),
                                              "window": pa.array(words, pa.binary())})

    def doc_rows(batches):
        import pyarrow as pa

        for batch in batches:
            row, at, key, words = [], [], [], []
            for r, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                w = plain_words(text)
                for n in lengths:
                    for i, h in _hashed(w, n):
                        row.append(r), at.append(i), key.append(h), words.append(b" ".join(w[i:i + n]))
            yield pa.RecordBatch.from_pydict({"row": pa.array(row, pa.string()), "at": pa.array(at, pa.int32()),
                                              "key": pa.array(key, pa.int64()), "window": pa.array(words, pa.binary())})

    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col), text.alias("body"), F.sha2(text, 256).alias("row"))
    items = _items(benchmark, item_col, item_text).mapInArrow(item_rows, "item string, key long, window binary")
    windows = named.select("row", "body").dropDuplicates(["row"]).mapInArrow(
        doc_rows, "row string, at int, key long, window binary")
    met = windows.join(items.distinct(), ["key", "window"])
    size_of = F.size(F.split(F.col("window").cast("string"), " "))
    spans = met.select("row", "item", F.explode(F.sequence(F.col("at"), F.col("at") + size_of - 1)).alias("word"))
    counts = spans.groupBy("row").agg(F.countDistinct("word").alias("n_hit"))
    whose = met.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sized = row_map(named, lambda i, body, row: (i, row, len(plain_words(body))),
                    f"`{id_col}` {dict(docs.dtypes)[id_col]}, row string, n_words long", [id_col, "body", "row"])
    items_col = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return sized.join(counts, "row", "left").join(whose, "row", "left").select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size(items_col).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_col, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "drop", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", size: int = WINDOW,
                  max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` with hit documents dropped (``drop``) or their hit words cut out (``remove_spans``).

    Columns are kept as they are. A benchmark beyond the bound drops by the join; cutting spans needs the set.
    """
    found = window_set(benchmark, item_col, item_text, size, max_bytes)
    if found is None:
        if action != "drop":
            raise ValueError("a benchmark beyond max_bytes can only drop documents")
        marked = docs.withColumn("__row", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
        bad = _joined_hits(marked, benchmark, "__row", text_col, item_col, item_text, size, "")
        return marked.join(bad.where("contaminated").select("__row").distinct(), "__row", "left_anti").drop("__row")
    sent = docs.sparkSession.sparkContext.broadcast(found)

    if action == "drop":
        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            return pd.Series([not sent.value.find(plain_words(t))[0].any() for t in texts], dtype=bool)

        return docs.where(clean(F.col(text_col)))

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t):
            hit = sent.value.find(plain_words(t))[0]
            return _text_spans(t, hit) if hit.any() else t

        return pd.Series([one(t) for t in texts], dtype=object)

    return docs.withColumn(text_col, cut(F.col(text_col)))
