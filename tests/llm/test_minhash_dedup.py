import random
import re

import numpy as np
import pytest

from incidentry.llm import minhash_dedup as m
from incidentry.llm import set_links
from tests.llm.helpers import edge_docs, edited, empty_docs, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_set(text):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def slow_components(rows):
    """rows: (id, text); (id, n, component, kept) of each."""
    sets = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 80 * len(sets[a] | sets[b]) or (
                    rows[a][0] == rows[b][0] is not None and sets[a] and sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = []
    for k, ((i, _), s) in enumerate(zip(rows, sets)):
        c = i if not s else least.get(find(k))
        out.append(repr((i, len(s), c, i == c)))
    return sorted(out)


def table(seed):
    """Prose, groups of near copies about the limit, copies cut short, and a passage in many texts."""
    r = random.Random(seed)
    texts = [prose(s, r.choice([1, 2, 3, 5, 8, 20, 60, 150])) for s in range(20)]
    base, passage = prose(99, 120), prose(98, 60)
    texts += [edited(base, s, r.choice([0, 0.01, 0.03, 0.05, 0.08, 0.1])) for s in range(90)]
    words = base.split(" ")
    texts += [" ".join(words[k:k + r.randrange(85, 110)]) for k in range(0, 30)]
    texts += [passage + " " + prose(1000 + s, r.choice([5, 10, 14, 60])) for s in range(40)]
    texts += [edited(texts[s], s, 0.05) for s in range(0, 20, 2)] + [texts[3], texts[3].upper()]
    return list(enumerate(texts))


@pytest.mark.parametrize("few", [16, 2])
def test_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(set_links, "FEW", few)
    rows = table(few)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in m.near_components(docs).collect()) == slow_components(rows)


@pytest.mark.parametrize("few,at_once", [(8, 100_000)])
def test_links_within_one_large_key_lose_none(spark, monkeypatch, few, at_once):
    """All sets under one key: near and far copies, chains of them, and copies with tokens left out."""
    monkeypatch.setattr(set_links, "FEW", few)
    monkeypatch.setattr(set_links, "PAIRS_AT_ONCE", at_once)
    r = random.Random(few)
    base = r.sample(range(10 ** 6), 100)
    sets = {}
    for k in range(90):
        # Copies of the base or of another copy, with so many tokens of it drawn anew, a few of them cut short.
        s = set(sets[r.randrange(k)] if k % 6 == 5 else base)
        gone = r.choice([2, 4, 9, 12, 14])
        s -= set(r.sample(sorted(s), gone))
        s |= set(r.sample(range(10 ** 6, 10 ** 6 + 2000), 0 if k % 9 == 4 else gone))
        sets[k] = sorted(s)
    full = spark.createDataFrame(list(sets.items()), "ref long, tokens array<long>")
    keys = spark.createDataFrame([(1, k, len(s), len(s), True, float(k % 7)) for k, s in sets.items()],
                                 "key long, ref long, n int, cap int, short boolean, rank double")
    got = set_links.links_within(keys, full, spark.createDataFrame([], "a long, b long")).collect()
    links = {(a, b) for a in sets for b in sets if b < a
             and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    assert {(x.a, x.b) for x in got} <= links

    def roots(pairs):
        root = {k: k for k in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(k) for k in sets]

    assert roots([(x.a, x.b) for x in got]) == roots(links)


def test_edges(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(repr(tuple(r)) for r in m.near_components(docs).collect()) == slow_components(rows)
    assert m.near_components(empty_docs(spark)).count() == 0
    kept = m.keep_one(docs)
    assert set(kept.columns) == set(docs.columns)
    assert 7 not in [r.doc_id for r in kept.collect()]


def test_minima_estimate_similarity():
    r = np.random.default_rng(4)
    for share in (0.5, 0.8, 0.95):
        both = r.integers(-2 ** 63, 2 ** 63, 4000)
        n = int(4000 * (1 - share) / (2 * share))
        x, y = (np.unique(np.concatenate((both, r.integers(-2 ** 63, 2 ** 63, n)))) for _ in range(2))
        a, b = m.minima(x), m.minima(y)
        assert abs((a == b).mean() - share) < 0.1
        if share >= 0.8:
            assert (m.band_keys(a) == m.band_keys(b)).any()
            assert m.alike(m.signature(a), m.signature(b))


def test_small_tables_take_few_tasks(spark):
    """A round over few rows writes a file for each core at most, however many shuffle partitions there are."""
    from incidentry.llm.components import components

    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        links = spark.range(2000).selectExpr("id + 1 - id % 10 as a", "id - id % 10 as b")
        found = components(links)
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert found.where("root = node - node % 10").count() == found.count() == 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_later_rounds_join_one_link_a_set(spark, monkeypatch):
    """Roots of a round come from the roots before it and its own links, not from all links found so far."""
    monkeypatch.setattr(set_links, "FEW", 2)
    monkeypatch.setattr(set_links, "PAIRS_AT_ONCE", 1)
    seen, reached = [], set_links._reached
    monkeypatch.setattr(set_links, "_reached", lambda df: seen.append(df) or reached(df))
    r = random.Random(5)
    bases = [r.sample(range(10 ** 6), 100) for _ in range(6)]
    sets = {}
    for k in range(90):
        gone = r.choice([2, 4, 9])
        sets[k] = sorted((set(bases[k % 6]) - set(r.sample(bases[k % 6], gone))) | set(bases[0][:30]))
    keys = spark.createDataFrame([(x, k, len(s), len(s), True, 0.0) for k, s in sets.items() for x in (1, 2, 3)],
                                 "key long, ref long, n int, cap int, short boolean, rank double")
    full = spark.createDataFrame(list(sets.items()), "ref long, tokens array<long>")
    set_links.links_within(keys, full, spark.createDataFrame([], "a long, b long")).count()
    assert len(seen) > 1 and seen[1].count() < 2 * len(sets)
    assert "node" in seen[1]._jdf.queryExecution().logical().toString()


def test_few_sets_outside_a_large_group_are_not_paired_with_it(spark, monkeypatch):
    """Sets outside the component of a large key are told apart by their tokens, and none meets its centre twice."""
    monkeypatch.setattr(set_links, "PAIRS_AT_ONCE", 1)
    seen, verified = [], set_links.verified
    monkeypatch.setattr(set_links, "verified", lambda pairs, *rest: seen.append(pairs) or verified(pairs, *rest))
    r = random.Random(7)
    base, sets = r.sample(range(10 ** 6), 100), {}
    for k in range(60):
        # The last 12 share 70 tokens with the others, too few for a link; two of them are copies of two more.
        s = base[:70 if k >= 48 else 97]
        sets[k] = sorted(s + [10 ** 6 + 1000 * k + j for j in range(100 - len(s))])
    for k in (58, 59):
        sets[k] = sorted(sets[k - 4][:-2] + [-k, k + 2 * 10 ** 6])
    full = spark.createDataFrame(list(sets.items()), "ref long, tokens array<long>")
    keys = [(1, k, 100, 100, True, float(k)) for k in sets] + [(2, k, 100, 100, True, float(k)) for k in (0, 50)]
    got = set_links.links_within(spark.createDataFrame(keys, "key long, ref long, n int, cap int, short boolean, rank double"),
                                 full, spark.createDataFrame([], "a long, b long")).collect()
    links = {(x.a, x.b) for x in got}
    assert links == {(k, 0) for k in range(1, 48)} | {(58, 54), (59, 55)}
    pairs = [(x.a, x.b) for df in seen for x in df.collect()]
    assert len(pairs) == len(set(pairs)) <= 2 * len(sets)


@pytest.mark.parametrize("at_once", [1, 50, 1000])
def test_blocks_of_differences_against_brute_force(spark, monkeypatch, at_once):
    """Groups held against the differences of few or many others, in blocks of a few sets."""
    for name, value in (("FEW", 2), ("PAIRS_AT_ONCE", at_once), ("BLOCK_ROWS", 7), ("BLOCK_TOKENS", 900)):
        monkeypatch.setattr(set_links, name, value, raising=False)
    rows = table(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in m.near_components(docs).collect()) == slow_components(rows)


def test_sets_just_outside_a_large_group_take_one_round(spark, monkeypatch):
    """Near copies of one set, and sets a little too far from it for a link: no round for each centre, no row for a pair."""
    for name, value in (("PAIRS_AT_ONCE", 500), ("BLOCK_ROWS", 60), ("BLOCK_TOKENS", 4000)):
        monkeypatch.setattr(set_links, name, value, raising=False)
    rounds, pairs, reached, verified = [], [], set_links._reached, set_links.verified
    monkeypatch.setattr(set_links, "_reached", lambda df: rounds.append(df) or reached(df))
    monkeypatch.setattr(set_links, "verified", lambda df, *rest: pairs.append(df) or verified(df, *rest))
    r = random.Random(11)
    base, fresh, sets = r.sample(range(10 ** 6), 100), iter(range(2 * 10 ** 6, 3 * 10 ** 6)), {0: None}
    sets[0] = sorted(base)
    for k in range(1, 240):
        # Every sixth differs too much from the base; half of these are linked with the copy they are made of.
        s, gone = set(sets[r.randrange(k)] if k % 12 == 6 else base), {0: 13, 6: 11}.get(k % 12, r.randrange(1, 5))
        sets[k] = sorted((s - set(r.sample(sorted(s), gone))) | {next(fresh) for _ in range(gone)})
    full = spark.createDataFrame(list(sets.items()), "ref long, tokens array<long>")
    keys = spark.createDataFrame([(x, k, len(s), len(s), True, float(k)) for k, s in sets.items() for x in (1, 2)],
                                 "key long, ref long, n int, cap int, short boolean, rank double")
    got = {(x.a, x.b) for x in set_links.links_within(keys, full, spark.createDataFrame([], "a long, b long")).collect()}
    links = {(a, b) for a in sets for b in range(a)
             if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}

    def roots(found):
        root = list(range(len(sets)))
        for _ in sets:
            for a, b in found:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert got <= links and roots(got) == roots(links)
    assert len({x for x in roots(links)}) > 10 and any(b and roots(links)[a] == 0 for a, b in got)
    assert len(rounds) == 1 and sum(df.count() for df in pairs) < 2 * len(sets)
