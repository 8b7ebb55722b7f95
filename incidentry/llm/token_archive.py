"""Token ids in shards compressed by Re-Pair: frequent pairs of ids become nonterminals, again and again.

Documents are dealt out by ranges of their id, so shards follow each other in ascending order. A shard holds whole
documents, about ``SHARD_TOKENS`` ids, and has its own rules. In each round the pairs of the shard are counted
exactly; of the most frequent ones those are replaced together whose left and right symbols do not meet, as then
no two of them overlap and the order of replacing makes no difference. The end id takes part in no rule, so every
document starts at a symbol. Each rule's expansion length is stored, and single documents or ranges can be decoded.

A shard is one row of a Parquet table, written by Spark's own committer to any store: its place (``part``,
``seq``), the ids of its documents, and ``payload``, whose layout is

    magic "RPS1", then little-endian u64: width of a symbol in bytes, first nonterminal, rules, symbols, documents
    rules: pairs of u32 | expansion lengths: u32 each | symbols: u16 or u32 each
    first symbol of each document and the end: u64 | first id of each document and the end: u64
    crc32 of all this: u32

Defined results: null text is empty and gives the end id alone; null ids come first; rows that repeat an id follow
each other, ordered by a hash of their text; an empty table gives an empty archive. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentry.llm.common import arrow_schema, worker_store

SHARD_TOKENS = 2_000_000
ROUNDS = 6
#: A pair that stands so often or more pays for its rule.
LEAST_COUNT = 16
#: Parts of texts, and words in lower case, whose ids one Python worker remembers.
REMEMBERED = 900_000, 900_000
MAGIC = b"RPS1"
#: A part of plain letters, one code point each in lower case and normal form, and the signs that end it; or any other.
#: The signs are all of ASCII but the apostrophe, which may join the letters after it.
PLAIN = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-į]+)([!-&(-/:-@\[-`{-~]*)|(.*))$", re.M)

def _byte_names() -> dict[int, int]:
    """Code points that byte-level models name bytes by: printable bytes by themselves, the rest in order from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(rest)}


BYTE_NAMES = _byte_names()


class Encoder:
    """Ids of texts by the tokenizers library, with the ids of single words remembered.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its parts between
    blanks in a row. Parts not yet met are encoded by the library, those of plain letters many at a time.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 2 ** 15 * 2 else "<u4"
        width = np.dtype(self.kind).itemsize
        self.code = [i.to_bytes(width, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        # Whether letters are lower-cased, and whether lower-case words reach the model as they are.
        probes = ["a", "the", "word", "unbelievably", "é", "ñandú", "ąćį", "straße"]
        self.lowers = self._single([p.upper() for p in probes[:-1]]) == self._single(probes[:-1])
        self.direct = self.lowers and self._modelled(probes) == self._single(probes)
        self.known: dict[bytes, bytes] = {}
        #: Ids of words of plain letters, in lower case where the tokenizer makes them so.
        self.cores: dict[str, bytes] = {}

    def _single(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [b"".join(map(self.code.__getitem__, e.ids)) for e in found]

    def _modelled(self, words: list[str]) -> list[bytes]:
        """Ids from the library's model alone, of words in lower case; their bytes are named as byte-level models do."""
        number, pieces = self.code.__getitem__, self.tokenizer.model.tokenize
        named = [w if w.isascii() else w.encode("utf-8").decode("latin-1").translate(BYTE_NAMES) for w in words]
        return [b"".join([number(t.id) for t in pieces(w)]) for w in named]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters; they go straight to the model where probes show that this is the same."""
        return self._modelled(words) if self.direct else self._letters(words)

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters; a run of them is encoded as one text and cut at the ids that end a word."""
        out: list[bytes] = []
        groups = [words[i:i + 500] for i in range(0, len(words), 500)]
        width = np.dtype(self.kind).itemsize
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(list(map(" ".join, groups)),
                                                                      add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()]
            if len(cuts) - 1 != len(group):
                out += self._single(group)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def learn(self, parts: set[bytes]) -> None:
        if len(self.cores) > REMEMBERED[1]:
            self.cores.clear()
        raws = list(parts)
        found = PLAIN.findall(b"\n".join(raws).decode("utf-8", "surrogatepass"))
        words = [c.lower() for c, _, _ in found] if self.lowers else [c for c, _, _ in found]
        tails = {t for _, t, _ in found}
        rest = sorted({r for _, _, r in found} | tails)
        cores = sorted(set(words).difference(self.cores, ("",)))
        self.cores.update(zip(cores, self._words(cores)))
        others = dict(zip(rest, self._single(rest)))
        core = self.cores
        self.known.update(zip(raws, [
            (core[w] + others[t] if t else core[w]) if w else others[r] for w, (_, t, r) in zip(words, found)]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if len(self.known) > REMEMBERED[0]:
            self.known.clear()
        parts = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        found = [list(map(self.known.get, ps)) for ps in parts]
        gaps = [_gaps(ids) for ids in found]
        new = {ps[k] for ps, at in zip(parts, gaps) for k in at}
        if new:
            self.learn(new)
        for ps, ids, at in zip(parts, found, gaps):
            for k in at:
                ids[k] = self.known[ps[k]]
        return list(map(b"".join, found))


def _gaps(ids: list) -> list[int]:
    """Where ``ids`` holds None."""
    out, at = [], -1
    try:
        while True:
            at = ids.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    edge = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    counts = np.diff(edge)
    often = counts >= LEAST_COUNT
    return keys[edge[:-1][often]], counts[often]


def _slot(keys: np.ndarray) -> np.ndarray:
    """A slot of 2 to the 18 for each pair."""
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


def _apart(hits: np.ndarray) -> np.ndarray:
    """Of ascending places in runs of neighbours, every other one from the start of its run."""
    if len(hits) < 2:
        return hits
    starts = np.concatenate(([True], np.diff(hits) != 1))
    first = np.maximum.accumulate(np.where(starts, np.arange(len(hits)), 0))
    return hits[(np.arange(len(hits)) - first) % 2 == 0]


def re_pair(symbols: np.ndarray, first: int, end: int, most_rules: int, rounds: int = ROUNDS):
    """(symbols, rules): ``rules[k]`` is the pair that ``first + k`` stands for. ``end`` is in no rule."""
    s, rules = symbols.astype(np.uint32), []
    narrow = first + most_rules <= 2 ** 16
    shift, kind = (16, np.uint32) if narrow else (32, np.uint64)
    for _ in range(rounds):
        room = most_rules - len(rules)
        if len(s) < 2 or room <= 0:
            break
        keys = (s[:-1].astype(kind) << kind(shift)) | s[1:].astype(kind)
        free = s != end
        pairs, counts = _counted(keys[free[:-1] & free[1:]])
        order = np.lexsort((pairs, -counts))
        lefts, rights, chosen = set(), set(), []
        for key in pairs[order].tolist():
            a, b = key >> shift, key & ((1 << shift) - 1)
            if a == b:
                if a in lefts or a in rights:
                    continue
                lefts.add(a), rights.add(a)
            elif a in rights or b in lefts:
                continue
            else:
                lefts.add(a), rights.add(b)
            chosen.append((key, len(rules) + len(chosen)))
            if len(chosen) >= room:
                break
        if not chosen:
            break
        wanted = np.array(sorted(chosen), np.uint64)
        is_left = np.zeros(first + len(rules) + 1, bool)
        is_right = is_left.copy()
        is_left[list(lefts)] = True
        is_right[list(rights)] = True
        names = wanted[:, 0].astype(kind)
        # Most places are ruled out by their symbols or a hash of their pair.
        listed = np.zeros(2 ** 18, bool)
        listed[_slot(names)] = True
        at = np.flatnonzero(is_left[s[:-1]] & is_right[s[1:]])
        at = at[listed[_slot(keys[at])]]
        near = np.searchsorted(names, keys[at])
        near[near == len(names)] = 0
        hit = names[near] == keys[at]
        at, near = at[hit], near[hit]
        same = s[at] == s[at + 1]
        if same.any():
            keep = ~same
            keep[np.isin(at, _apart(at[same]))] = True
            at, near = at[keep], near[keep]
        s[at] = (wanted[near, 1] + np.uint64(first)).astype(np.uint32)
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        s = s[stay]
        rules += [(key >> shift, key & ((1 << shift) - 1)) for key, _ in chosen]
    return s, np.array(rules, np.uint32).reshape(-1, 2)


def pack(docs: list[bytes], kind: str, vocabulary: int, end: int) -> bytes:
    """One shard of documents, each the bytes of its ids with ``end`` last."""
    ids = np.frombuffer(b"".join(docs), kind)
    width = np.dtype(kind).itemsize
    sizes = np.fromiter(map(len, docs), np.int64, len(docs)) // width
    starts = np.concatenate(([0], np.cumsum(sizes))).astype("<u8")
    room = 2 ** 16 - vocabulary if width == 2 else 2 ** 20
    symbols, rules = re_pair(ids, vocabulary, end, max(0, room))
    lengths = np.ones(vocabulary + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist(), vocabulary):
        lengths[k] = lengths[a] + lengths[b]
    begins = np.concatenate(([0], np.cumsum(lengths[symbols])))
    at = np.searchsorted(begins, starts.astype(np.int64)).astype("<u8")
    body = b"".join((
        MAGIC, struct.pack("<5Q", width, vocabulary, len(rules), len(symbols), len(docs)),
        rules.astype("<u4").tobytes(), lengths[vocabulary:].astype("<u4").tobytes(), symbols.astype(kind).tobytes(),
        at.tobytes(), starts.tobytes()))
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A packed shard, open for decoding."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC or zlib.crc32(memoryview(payload)[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("not a whole shard")
        width, self.first, rules, symbols, docs = struct.unpack_from("<5Q", payload, 4)
        self.kind, at = f"<u{width}", 44
        parts = []
        for kind, n in (("<u4", 2 * rules), ("<u4", rules), (self.kind, symbols), ("<u8", docs + 1), ("<u8", docs + 1)):
            parts.append(np.frombuffer(payload, kind, n, at))
            at += parts[-1].nbytes
        self.rules, self.lengths, self.symbols, self.at, self.starts = parts
        self.rules = self.rules.reshape(-1, 2)
        self._flat, self._offsets, self._sizes = self._expansions(width)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def _expansions(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all symbols in a row, where each symbol's begin, and how many they are."""
        known: list[bytes] = []

        def of(symbol: int) -> bytes:
            return symbol.to_bytes(width, "little") if symbol < self.first else known[symbol - self.first]

        for a, b in self.rules.tolist():  # a rule names earlier symbols only
            known.append(of(a) + of(b))
        sizes = np.concatenate((np.ones(self.first, np.int64), self.lengths.astype(np.int64)))
        flat = np.concatenate((np.arange(self.first).astype(self.kind), np.frombuffer(b"".join(known), self.kind)))
        return flat, np.cumsum(sizes) - sizes, sizes

    def _decoded(self, a: int, b: int) -> np.ndarray:
        symbols = self.symbols[a:b]
        sizes = self._sizes[symbols]
        before = np.cumsum(sizes) - sizes
        return self._flat[np.repeat(self._offsets[symbols] - before, sizes) + np.arange(int(sizes.sum()))]

    def ids(self, doc: int | None = None) -> np.ndarray:
        """The ids of one document of the shard, or of all."""
        return self._decoded(0, len(self.symbols)) if doc is None else self._decoded(
            int(self.at[doc]), int(self.at[doc + 1]))

    def window(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of a document; only the symbols that reach into it are expanded."""
        a, b = int(self.at[doc]), int(self.at[doc + 1])
        ends = np.cumsum(self._sizes[self.symbols[a:b]])
        stop = min(stop, int(ends[-1]) if len(ends) else 0)
        if start >= stop:
            return np.zeros(0, self.kind)
        lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[lo - 1]) if lo else 0
        return self._decoded(a + lo, a + hi)[start - skipped:stop - skipped]


def write_archive(docs: DataFrame, path: str, tokenizer: str, end: int = 1, id_col: str = "doc_id",
                  text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text, append ``end`` and write the shards to ``path``. ``tokenizer`` is a tokenizer file."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()  # a vocabulary, of a fixed size
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    kind = dict(docs.dtypes)[id_col]
    schema = f"part int, seq int, ids array<{kind}>, n_tokens long, payload binary"

    target = arrow_schema(schema)

    def shards(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = worker_store(f"encoder-{hash(sent.value)}", lambda: Encoder(sent.value), large=True)
        part, seq, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        width = np.dtype(encoder.kind).itemsize
        tail = end.to_bytes(width, "little")
        vocabulary = encoder.tokenizer.get_vocab_size()

        def row():
            payload = pack(held, encoder.kind, vocabulary, end)
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(
                (part, seq, ids, size // width, payload), target)], schema=target)

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                piece = batch.slice(at, 100)
                for i, raw in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist())):
                    if held and size + len(raw) > shard_tokens * width:
                        yield row()
                        seq, ids, held, size = seq + 1, [], [], 0
                    ids.append(i), held.append(raw + tail)
                    size += len(held[-1])
        if held:
            yield row()

    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), tie.alias("tie")).repartitionByRange(
        "id", "tie").sortWithinPartitions("id", "tie")
    dealt.select("id", "text").mapInArrow(shards, schema).write.parquet(path)


def read_archive(archive: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of an archive: its id, ``start``, ``n_tokens`` and ``ids_crc32``, from the decoded ids."""
    kind = dict(archive.dtypes)["ids"].removeprefix("array<")[:-1]
    schema = f"part int, seq int, id {kind}, local long, n_tokens long, ids_crc32 long"

    target = arrow_schema(schema)

    def unpack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                part, seq, ids, payload = (batch.column(c)[k].as_py() for c in range(4))
                shard = Shard(payload)
                wide = memoryview(shard.ids().astype("<u4")).cast("B")
                starts = shard.starts.tolist()
                crc = [zlib.crc32(wide[4 * a:4 * b]) for a, b in zip(starts, starts[1:])]
                n = len(ids)
                columns = ([part] * n, [seq] * n, ids, starts[:-1], np.diff(starts).tolist(), crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip(columns, target)], schema=target)

    rows = archive.select("part", "seq", "ids", "payload").mapInArrow(unpack, schema)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each writing task
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = archive.select("part", "seq", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = shards.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "seq", (F.col("base") + F.col("inner")).alias("base"))
    return rows.join(bases, ["part", "seq"]).select(
        F.col("id").alias(id_col), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
