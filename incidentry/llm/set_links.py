"""Links between token sets that share keys: no pairing of large groups, and no link lost.

A key stands for a group of sets, any two of which may overlap by 80 of 100. Every group is first held against one
set ``c``, the most central; groups whose sets are all in one component are done. Where few sets are outside the
component that most are in, and few others in it, these are paired. Any other group is taken apart by what its sets
share with ``c``. Two linked sets ``x`` and ``y`` share at least ``4 (|x| + |y|) / 9`` tokens. Either

- they share tokens outside of ``c``. Of these, the rare ones that members of several components hold are keys of the
  next round, each of a group without ``c``; or
- each shares that many with ``c``. Unless both are linked with ``c``, one of them, ``x``, is not, and then ``y`` is
  smaller than ``9 |x & c| / 4 - |x|``, which is smaller than ``c``. Sets of such sizes are a group of the next round,
  again without ``c``; near copies of one size have none.

Before that, groups whose sets differ little from ``c``, or of which few sets are outside the component that most are in,
are done by these differences alone. With ``D(x)`` the tokens that ``x`` or ``c`` holds and the other does not, and
``far(x) = 5 |c - x| + 4 |x - c| - |c|``, ``x`` is linked with ``c`` where ``far(x) <= 0``, and with ``y`` where
``9 |D(x) & D(y)| >= far(x) + far(y) + |c|``. Blocks of the sets outside meet blocks of all: no whole set is sent, no row is
made for a pair, and each set writes one link for each component it reaches. A set meets a bounded number of differences
so; groups beyond that are taken apart.

Rounds end when only small groups are open, or when all pairs of larger ones are no more than a quarter of the keys
there were at first; such a rest is paired, so pairs stay in proportion to the keys. No pair has ``c`` in it again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import arrow_schema, checked_broadcast, in_few_tasks, let_go_large, written

#: A group is paired at once when that makes no more pairs than a group of so many sets has.
FEW = 16
#: What is left of larger groups is paired when it makes no more pairs than this or than a quarter of the keys at first.
PAIRS_AT_ONCE = 100_000
#: A set is held against at most so many differences of other sets for each of ``PAIRS_AT_ONCE``, without a row for a pair.
DIFFERENCES = 40
#: Rows and differences in a block.
BLOCK_ROWS, BLOCK_TOKENS = 1_000, 1_000_000
#: Tables of a few numbers a row are sent to all tasks when they are measured to hold at most so many bytes. A join then
#: needs no shuffle; rounds on small tables are many, and each shuffle costs a task for every partition.
SENT_BYTES = 8 * 1024 * 1024
#: Pairs compared at once in Python, and pairs that one task compares at least: each carries two whole sets.
SLICE, PAIRS_A_TASK = 500, 5_000

#: Columns of a key table. ``cap`` bounds the overlap with any other set, ``short`` says whether the set may be the
#: smaller one of a pair under this key, and the least ``rank`` is the most central.
KEY = ("key", "ref", "n", "cap", "short", "rank")


def with_sets(pairs: DataFrame, count: int, full: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(a, b, the set of a, the set of b)`` over at most ``count`` pairs (a, b); it yields rows of ``schema``.

    ``full`` is (ref, tokens), one row a ref. Where it has signatures too, ``run`` gets both after the sets.
    """
    import pyarrow as pa

    target = arrow_schema(schema)
    signed = "signature" in full.columns
    held = ["tokens", *(["signature"] if signed else [])]
    left, right = (full.select(F.col("ref").alias(c), *[F.col(h).alias(f"{c}_{h}") for h in held]) for c in ("a", "b"))

    def over(batches):
        let_go_large()
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            values, offsets = [], []
            for c in (2, 3):
                column = batch.column(c)
                values.append(column.flatten().to_numpy(zero_copy_only=False))
                offsets.append(column.offsets.to_numpy() - column.offsets[0].as_py())
            names = [batch.column(k).to_pylist() for k in (0, 1)]
            signatures = zip(*(batch.column(k).to_pylist() for k in (4, 5))) if signed else [()] * batch.num_rows
            rows = [row for i, (a, b, both) in enumerate(zip(*names, signatures))
                    for row in run(a, b, *(v[o[i]:o[i + 1]] for v, o in zip(values, offsets)), *both)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [()] * len(target), target)], schema=target)

    columns = [f"{c}_{h}" for h in held for c in ("a", "b")]
    held = in_few_tasks(pairs, count).join(left, "a").join(right, "b").select("a", "b", *columns)
    return in_few_tasks(held, count, PAIRS_A_TASK).mapInArrow(over, schema)


def _sent(df: DataFrame, bytes_per_row: int) -> DataFrame:
    return checked_broadcast(df, bytes_per_row, SENT_BYTES)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def verified(pairs: DataFrame, count: int, full: DataFrame,
             alike: Callable[[bytes, bytes], bool] | None = None) -> DataFrame:
    """(a, b) of the pairs (a, b) that are linked: alike by their signatures, and by their whole sets."""

    def run(a, b, x, y, *signatures):
        if alike is None or alike(*signatures):
            overlap = _common(x, y)
            if 100 * overlap >= 80 * (len(x) + len(y) - overlap):
                yield a, b

    return with_sets(pairs, count, full, run, "a long, b long")


def unordered(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _centred(keys: DataFrame) -> DataFrame:
    """Keys that more than one set holds, with their most central set ``centre`` and their least size ``least``."""
    centres = keys.groupBy("key").agg(
        F.min(F.struct("rank", "ref", "n")).alias("c"), F.min("n").alias("least"),
        F.min("ref").alias("lo"), F.max("ref").alias("hi")).where("lo <> hi").select(
        "key", F.col("c.ref").alias("centre"), F.col("c.n").alias("centre_n"), "least")
    return keys.join(centres, "key")


def _still_open(rows: DataFrame, count: int, roots: DataFrame) -> DataFrame:
    """The ``count`` rows of keys whose sets are in more than one component, with their ``root``, the root ``major`` of the
    component that most sets of the key are in, the number ``minors`` of the other sets, and that of ``all`` sets."""
    rows = rows.drop("root", "major", "minors", "all").join(
        _sent(roots.select(F.col("node").alias("ref"), "root"), 16), "ref", "left").withColumn(
        "root", F.coalesce("root", "ref"))
    parts = rows.groupBy("key", "root").agg(F.count("*").alias("part"))
    apart = parts.groupBy("key").agg(
        F.max(F.struct("part", "root")).alias("m"), F.sum("part").alias("all")).where("all > m.part").select(
        "key", F.col("m.root").alias("major"), (F.col("all") - F.col("m.part")).alias("minors"), "all")
    return rows.join(_sent(written(in_few_tasks(apart, count), "apart-keys"), 32), "key")


_OTHER = ("ref", "n", "cap", "root", "short")
#: No overlap is larger than what either set shares with any other, and it must reach 4/9 of both sizes together.
_NEAR = "9 * least(cap, other_cap, n, other_n) >= 4 * (n + other_n)"


def _few_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of the few sets outside the major component of a key with its sets of other components.

    The centre has been held against all of them. The smaller set of a pair must be there as ``short``.
    """
    rows = rows.where("ref <> centre")
    others = rows.select("key", *[F.col(c).alias(f"other_{c}") for c in _OTHER])
    minor = _sent(rows.where("root <> major").select("key", *_OTHER), 40)
    short = "case when n < other_n then short when n > other_n then other_short else short or other_short end"
    return others.join(minor, "key").where("root <> other_root").where(short).where(
        _NEAR).select(*unordered("ref", "other_ref"))


def _around(rows: DataFrame, count: int, full: DataFrame) -> DataFrame:
    """Sets of ``rows`` held against the centres of their keys: what both share, and the tokens of one alone.

    ``far`` is how far a set is from a link with its centre, at most 0 where there is one.
    """

    def run(a, b, x, y, *signatures):
        outside, missing = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
        far = 5 * len(missing) + 4 * len(outside) - len(y)
        yield a, b, len(y), len(x) - len(outside), far, far <= 0, outside.tolist(), missing.tolist()

    held = rows.where("ref <> centre").select(F.col("ref").alias("a"), F.col("centre").alias("b")).distinct()
    return with_sets(held, count, full, run, "ref long, centre long, centre_n int, overlap int, far int, linked boolean, "
                                             "outside array<long>, missing array<long>")


def _groups(around: DataFrame) -> DataFrame:
    """Centres whose sets are in more than one component: the root ``major`` of the component that most are in, the numbers
    of blocks of all sets and of the others, and whether these are ``apart`` too many to be held against all sets."""
    parts = around.groupBy("centre", "root").agg(
        F.count("*").alias("part"), F.sum(F.size("outside") + F.size("missing")).alias("tokens"))
    groups = parts.groupBy("centre").agg(F.max(F.struct("part", "root", "tokens")).alias("m"), F.sum("part").alias("all"),
                                         F.sum("tokens").alias("tokens")).where("all > m.part")
    blocks = f"ceil(greatest(({{0}}) / {BLOCK_ROWS}, ({{1}}) / {BLOCK_TOKENS}))"
    return groups.select(
        "centre", F.col("m.root").alias("major"), F.expr(blocks.format("all", "tokens")).cast("int").alias("all_blocks"),
        F.expr(blocks.format("all - m.part", "tokens - m.tokens")).cast("int").alias("minor_blocks"),
        F.expr(f"(all - m.part) * (tokens / all) > {DIFFERENCES * PAIRS_AT_ONCE}").alias("apart"))


def _met_in_blocks(around: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (a, b) of sets outside the major component of their centre: one for each block and component they reach."""
    import pyarrow as pa

    target = arrow_schema("a long, b long")

    def run(table):
        table = table.combine_chunks()
        ref, root, far, centre_n = (table.column(c).to_numpy() for c in ("ref", "root", "far", "centre_n"))
        column = table.column("tokens").combine_chunks()
        offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
        ids = np.unique(column.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        size, minor = np.diff(offsets), table.column("minor").to_numpy(zero_copy_only=False)
        # What a set gains at most from differences in common, less its own distance: the other's must not be more.
        gain = 9 * size - far - centre_n
        members = np.flatnonzero(~minor)
        members = members[np.argsort(-gain[members], kind="stable")]
        starts = np.concatenate(([0], np.cumsum(size[members])))
        met = np.concatenate([ids[offsets[k]:offsets[k + 1]] for k in members]) if len(members) else ids[:0]
        held, falling, out = np.zeros(len(ids) + 1, bool), -gain[members], []
        for k in np.flatnonzero(minor):
            near = int(np.searchsorted(falling, -far[k], side="right"))
            if not near:
                continue
            own = ids[offsets[k]:offsets[k + 1]]
            held[own] = True
            sums = np.concatenate(([0], np.cumsum(held[met[:starts[near]]])))
            held[own] = False
            others = members[:near]
            common = sums[starts[1:near + 1]] - sums[starts[:near]]
            linked = others[(9 * common >= far[k] + far[others] + centre_n[k]) & (root[others] != root[k])]
            for y in linked[np.unique(root[linked], return_index=True)[1]]:
                out.append((max(ref[k], ref[y]), min(ref[k], ref[y])))
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else ((), ()), target)], schema=target)

    rows = around.select("ref", "root", "far", "centre_n", "centre", F.concat("outside", "missing").alias("tokens")).join(
        _sent(groups.where("not apart"), 24), "centre")
    block = F.xxhash64("ref", F.lit("block"))
    every = rows.withColumn("minor", F.lit(False)).withColumn("i", F.pmod(block, "all_blocks")).withColumn(
        "j", F.explode(F.expr("sequence(0L, minor_blocks - 1L)")))
    others = rows.where("root <> major").withColumn("minor", F.lit(True)).withColumn(
        "i", F.explode(F.expr("sequence(0L, all_blocks - 1L)"))).withColumn("j", F.pmod(block, "minor_blocks"))
    columns = ["centre", "i", "j", "ref", "root", "far", "centre_n", "minor", "tokens"]
    return every.select(*columns).unionByName(others.select(*columns)).groupBy("centre", "i", "j").applyInArrow(
        run, "a long, b long")


def _keys_inside(rows: DataFrame, count: int) -> DataFrame:
    """Groups of the sets whose overlaps with their centre allow a link without any other token."""
    sized = rows.withColumn("cap_n", F.expr("9 * overlap div 4 - n")).withColumn(
        "from_n", F.expr("greatest(least, (4 * n + 4) div 5)"))
    apart = F.expr("not linked and cap_n >= from_n")
    asking = sized.where(apart).groupBy("key").agg(
        F.max("cap_n").alias("to"), F.min("from_n").alias("from"), F.min("n").alias("asking_n"))
    met = sized.join(_sent(written(in_few_tasks(asking, count), "asking-keys"), 24), "key").where(
        apart | F.expr("n between `from` and `to` and 9 * overlap >= 4 * (n + asking_n)"))
    return met.select(F.xxhash64("key", "centre").alias("key"), "ref", "n", "cap", "short", "rank")


def _keys_outside(rows: DataFrame, count: int, around: DataFrame) -> DataFrame:
    """Keys for pairs that share tokens outside the centre of their group: one for each centre and token.

    A set of ``n`` that shares ``overlap`` with the centre must share ``needed`` more with a partner, so these many less
    one of its tokens outside need no key: the ones most of the group holds. Tokens that one component alone holds come
    first in the order and need none either.
    """
    members = rows.where("ref <> centre").groupBy("ref", "centre").agg(
        F.min("least").alias("least"), *[F.first(c).alias(c) for c in ("n", "cap", "rank", "root")])
    held = members.join(around.select("ref", "centre", "overlap", "outside"), ["ref", "centre"]).withColumn(
        "needed", F.expr("greatest(1, (4 * (n + greatest(least, (4 * n + 4) div 5)) + 8) div 9 - overlap)"))
    held = held.where("size(outside) >= needed")
    tokens = held.select("ref", "centre", "root", F.explode("outside").alias("token"))
    shared = tokens.groupBy("centre", "token").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("count")).where("lo <> hi").select(
        "centre", "token", "count")
    lists = tokens.join(_sent(written(in_few_tasks(shared, count), "shared-tokens"), 24), ["centre", "token"]).groupBy("ref", "centre").agg(
        F.sort_array(F.collect_list(F.struct("count", "token"))).alias("shared"))
    lists = held.drop("outside").join(lists, ["ref", "centre"]).where("size(shared) >= needed")
    prefix = F.slice("shared", F.lit(1), F.expr("size(shared) - needed + 1").cast("int"))
    keys = lists.select("ref", "n", "cap", "rank", "centre", F.explode(prefix).alias("t"))
    return keys.select(F.xxhash64("centre", "t.token").alias("key"), "ref", "n", "cap", F.lit(True).alias("short"), "rank")


def _reached(links: DataFrame) -> DataFrame:
    """(node, root): the least node within two links and the node itself. All of a star get one root."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(near.select(F.col("a").alias("b"), "m"), "b").groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("a"), F.min("m")).alias("root"))


def links_within(keys: DataFrame, full: DataFrame, known: DataFrame,
                 alike: Callable[[bytes, bytes], bool] | None = None) -> DataFrame:
    """Links (a, b) that join every two linked sets under a common key of ``keys``; ``known`` are links found before.

    ``full`` is (ref, tokens[, signature]), one row a ref. ``alike`` may say from two signatures that a pair is surely
    not linked, before whole sets are compared.
    """
    found, pairs, most, allowed = written(known, "known-links"), [], 0, None
    joined, centred = found, _centred(keys)
    while True:
        rows = written(centred, "centred-keys")
        count = rows.count()
        allowed = allowed or max(PAIRS_AT_ONCE, count // 4)
        stars = rows.where("ref <> centre").where("5 * least(n, centre_n) >= 4 * greatest(n, centre_n)").select(
            *unordered("ref", "centre")).distinct()
        stars = written(verified(stars, count, full, alike), "star-links")
        found = found.unionByName(stars)
        # Components need not be whole here: what is taken apart too far is paired, not lost.
        roots = written(in_few_tasks(_reached(joined.unionByName(stars)), count), "reached")
        # What was joined before is one link a set from now on.
        joined = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        rows = written(_still_open(rows, count, roots), "open-keys")
        is_large = F.col("minors") * F.col("all") > FEW * FEW
        large, few = rows.where(is_large), rows.where(~is_large)
        left, more = rows.agg(*[F.coalesce(F.sum(F.when(c, F.col("minors"))), F.lit(0)) for c in (is_large, ~is_large)]).first()
        most += more
        if left <= allowed:
            most += left
            pairs.append(_few_pairs(rows))
            break
        pairs.append(_few_pairs(few))
        around = _around(large, count, full).join(
            _sent(roots.select(F.col("node").alias("ref"), "root"), 16), "ref", "left").withColumn(
            "root", F.coalesce("root", "ref"))
        around = written(around, "around-centre")
        groups = written(in_few_tasks(_groups(around), count), "groups")
        found = found.unionByName(written(_met_in_blocks(around, groups), "block-links"))
        apart = groups.where("apart").select("centre")
        if apart.isEmpty():
            break
        large, around = (df.join(_sent(apart, 8), "centre", "left_semi") for df in (large, around))
        overlaps = _sent(around.select("ref", "centre", "overlap", "linked"), 24)
        keys = written(in_few_tasks(_keys_inside(large.join(overlaps, ["ref", "centre"]), count).unionByName(
            _keys_outside(large, count, around)), count), "narrower-keys")
        centred = in_few_tasks(_centred(keys), keys.count())
    rest = reduce(DataFrame.unionByName, pairs).distinct()
    return found.unionByName(written(verified(rest, most, full, alike), "cross-links"))
