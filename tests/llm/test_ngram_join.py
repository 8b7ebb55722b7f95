import random
import re

import numpy as np
import pytest

from incidentry.llm import ngram_join as j
from incidentry.llm import set_links
from incidentry.llm.components import components
from tests.llm.helpers import edge_docs, edited, empty_docs, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_set(text):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_components(rows):
    """rows: (id, text); (id, n, component) of each."""
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
    return sorted(repr((i, len(s), i if not s else least.get(find(k)))) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def table(seed):
    r = random.Random(seed)
    texts = [prose(s, r.choice([3, 5, 8, 20, 60, 150])) for s in range(20)]
    base, passage = prose(99, 120), prose(98, 60)
    texts += [edited(base, s, r.choice([0, 0.005, 0.01, 0.02, 0.03])) for s in range(60)]
    texts += [passage + " " + prose(1000 + s, r.choice([5, 10, 14, 60])) for s in range(40)]
    texts += [edited(texts[s], s, 0.02) for s in range(0, 20, 2)] + [texts[3], texts[3].upper()]
    return list(enumerate(texts))


@pytest.mark.parametrize("few,rare", [(16, 8), (2, 2), (2, 0), (2, 3)])
def test_against_brute_force(spark, monkeypatch, few, rare):
    monkeypatch.setattr(set_links, "FEW", few)
    monkeypatch.setattr(j, "RARE", rare)
    rows = table(few + rare)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in j.near_components(docs).collect()) == slow_components(rows)


def test_edges(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(repr(tuple(r)) for r in j.near_components(docs).collect()) == slow_components(rows)
    assert j.near_components(empty_docs(spark)).count() == 0
    kept = j.keep_one(docs)
    assert set(kept.columns) == set(docs.columns)
    left = [r.doc_id for r in kept.collect()]
    assert left.count(3) == 3 and 7 not in left and 6 in left  # of id 3 the blank rows stay, and one of the others


def test_word_hashes_tell_words_apart():
    texts = ["a b\tc", "ab c", "a  bc", "abc", "cba", "", None, "É é"]
    seen = {}
    for t in texts:
        words = WORDS.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        got = j.word_hashes(t).tolist()
        assert len(got) == len(words)
        for w, h in zip(words, got):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_prefixes_lose_no_pair():
    """Two sets that overlap enough share a key, one of them by its shorter prefix, whatever the counts are."""
    r = random.Random(1)
    for _ in range(300):
        n = r.choice([4, 5, 9, 12, 30, 100, 400])
        both = set(r.sample(range(10 ** 6), n))
        x = both | set(r.sample(range(10 ** 6, 2 * 10 ** 6), r.randrange(0, n // 8 + 1)))
        y = both | set(r.sample(range(2 * 10 ** 6, 3 * 10 ** 6), r.randrange(0, n // 8 + 1)))
        if 100 * len(x & y) < 80 * len(x | y) or x == y:
            continue
        count = {t: r.choice([2, 3, 5, 9, 50]) for t in x | y}
        shared = [[(count[t], t) for t in s & both] + [(2, t) for t in s - both if r.random() < 0.5] for s in (x, y)]
        keys = [dict(j.keys_of(len(s), k)) for s, k in zip((x, y), shared)]
        small = 0 if len(x) <= len(y) else 1
        common = set(keys[0]) & set(keys[1])
        assert any(keys[small][k] for k in common) or len(x) == len(y) and any(keys[1][k] for k in common)


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)] + [(5, 5), (None, 1)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_size_classes():
    starts = j.CLASS_STARTS
    for n in [*range(1, 500), 10 ** 5, 10 ** 6]:
        for m in {n, (5 * n) // 4}:
            assert abs(np.searchsorted(starts, m, "right") - np.searchsorted(starts, n, "right")) <= 1
