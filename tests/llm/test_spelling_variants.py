import random
import re
import zlib
from collections import Counter

import pytest

from incidentry.llm import spelling_variants as v
from tests.llm.helpers import edge_docs, empty_docs


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def slow_variants(rows):
    counts = Counter()
    for i, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    form, near = {}, {}
    for w, n in words.items():
        close = [x for x in words if x != w and one_edit(w, x)]
        near[w] = len(close)
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(repr((w, form[w], root(w), n, near[w], words.get(form[w]))) for w, n in words.items())


def corpus(seed):
    r = random.Random(seed)
    parts = ["tion", "ment", "ar", "e", "o", "est", "qu", "é", "ß", "n", "an", "li"]
    base = ["".join(r.choice(parts) for _ in range(r.randint(3, 6))) for _ in range(60)]
    base += ["abcdefg", "abcdefgh", "bcdefgh", "abcdefghi", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "x" * 300, "x" * 299 + "y"]

    def bent(w):
        k, c = r.randrange(len(w) + 1), r.choice("abcdeé")
        return r.choice([w[:k] + c + w[k:], w[:k] + w[k + 1:], w[:k] + c + w[k + 1:]])

    rows = []
    for i in range(60):
        words = [r.choice(base) for _ in range(60)] + [bent(r.choice(base)) for _ in range(12)] * 2
        words += [base[0]] * 40 + [bent(base[0])] * 3
        r.shuffle(words)
        rows.append((i, r.choice([" ", ", ", "1"]).join(words).replace("a", "A", 5)))
    return rows


@pytest.mark.parametrize("seed,rare,most", [(1, 50, 3), (2, 0, 3), (3, 5, 5), (4, 10 ** 9, 4)])
def test_against_brute_force(spark, monkeypatch, seed, rare, most):
    monkeypatch.setattr(v, "RARE_PLACES", rare)
    monkeypatch.setattr(v, "MAX_GRAM", most)
    rows = corpus(seed)
    got = v.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    slow = slow_variants(rows)
    assert sorted(repr(tuple(r)) for r in got.collect()) == slow
    assert sum("None" not in x for x in slow) > 5


def test_chains_end_at_the_last_form(spark):
    words = {"abcdefg": 100_000, "abcdefgh": 10_000, "abcdefghi": 1000, "abcdefghij": 100, "abcdefghijk": 10, "zzzzzzz": 5}
    steps = [("abcdefgh", "abcdefg"), ("abcdefghi", "abcdefgh"), ("abcdefghij", "abcdefghi"), ("abcdefghijk", "abcdefghij")]
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    formed = v.forms(table, v.near_pairs(table))
    assert sorted((r.word, r.form) for r in formed.where("form is not null").collect()) == steps
    assert {r.root for r in v.roots(formed.where("form is not null")).collect()} == {"abcdefg"}


def test_every_near_pair_shares_a_key():
    r = random.Random(5)
    letters = "abcé"
    for _ in range(3000):
        word = "".join(r.choice(letters) for _ in range(r.randint(7, 14)))
        frequent = frozenset("".join(r.choice(letters + "^$") for _ in range(q)) for q in (2, 2, 2, 2, 2) for _ in range(3))
        k, c = r.randrange(len(word)), r.choice(letters)
        other = r.choice([word[:k] + c + word[k:], word[:k] + word[k + 1:], word[:k] + c + word[k + 1:]])
        if len(other) < 7 or other == word:
            continue
        a, b = dict(v.keys_of(word, frequent)), dict(v.keys_of(other, frequent))
        assert any(a[x] or b[x] for x in set(a) & set(b))
        ends = v.gram_ends(f"^{word}$", frequent)
        assert 1 <= v.affected(ends, len(word) + 2) <= v.MAX_GRAM


def test_edges(spark):
    rows = [(None, "Straße straße STRAßE elephants"), (1, None), (1, ""), (2, "elephants elephant's elephantt " * 3),
            (2, "Elephants× elephantſ"), (3, "y" * 50_000 + " " + "y" * 50_000), (4, "a b c short")]
    docs = spark.createDataFrame([(*x, "w", 1) for x in rows], "doc_id long, text string, word string, n int")
    assert sorted(repr(tuple(r)) for r in v.variants(docs).collect()) == slow_variants(rows)
    assert v.variants(empty_docs(spark)).count() == 0
    edge = edge_docs(spark)
    assert sorted(repr(tuple(r)) for r in v.variants(edge).collect()) == slow_variants([(r.doc_id, r.text) for r in edge.collect()])
