import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from incidentry.llm import decontaminate as dc
from incidentry.llm import quality_rules as q
from incidentry.llm.common import sha256
from tests.llm.helpers import EDGE_TEXTS, edge_docs, edited, empty_docs, prose

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_figures(text):
    text = text or ""
    w = BLANK_WORDS.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if BLANK_WORDS.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(lines), len(re.findall("[A-Z]", text)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB# \n\t\x0bé|")), max_size=60))
def test_figures(text):
    assert q.figures(text) == slow_figures(text)


def test_ledger_edges(spark):
    rows = q.ledger(edge_docs(spark)).collect()
    assert len(rows) == len(EDGE_TEXTS) + 4
    for r in rows:
        if r.doc_id is not None and r.doc_id != 3:
            assert tuple(r[c] for c in q.FIGURES) == slow_figures(EDGE_TEXTS[r.doc_id])
    assert q.ledger(empty_docs(spark)).count() == 0


def test_policies_and_ablation(spark):
    texts = [prose(1), prose(2) + " ###" * 60, "word", "SHOUT " * 70, prose(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    book = q.ledger(docs).cache()
    kept = {r.doc_id for r in book.where(~q.rejected()).collect()}
    assert kept == {0, 4} == {r.doc_id for r in q.apply_policy(docs).collect()}
    assert q.apply_policy(docs).columns == docs.columns
    got = {r.rule: (r.n_failed, r.n_only_this) for r in q.ablation(book).collect()}
    failed = {r.doc_id: {n for i, n in enumerate(q.RULES) if r.failed >> i & 1} for r in book.collect()}
    for rule in {x for f in failed.values() for x in f}:
        assert got[rule] == (sum(rule in f for f in failed.values()), sum(f == {rule} for f in failed.values()))


def slow_hits(text, items):
    w = PLAIN.findall(dc.plain_words and (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hit, found = set(), set()
    for item, t in items:
        b = PLAIN.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        n = min(10, len(b))
        windows = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), sha256(",".join(sorted(found))), bool(hit)


@pytest.mark.parametrize("max_bytes", [10 ** 9, 0])
def test_hits_against_brute_force(spark, max_bytes):
    items = [(10, prose(5, 30)), (9, "short item"), (2, prose(5, 30)), (None, prose(6, 12)), (4, ""), (5, None)]
    texts = [prose(7) + " " + prose(5, 30) + ", End", "A SHORT item. short\nitem", prose(6, 12).upper(), prose(8), prose(5, 9),
             edited(prose(5, 30), 1, 0.05), *EDGE_TEXTS]
    docs = edge_docs(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.hits(docs, bench, max_bytes=max_bytes).collect()
    want = sorted(repr((r.doc_id, *slow_hits(r.text, items))) for r in docs.collect())
    assert sorted(repr(tuple(r)) for r in got) == want
    clean = dc.decontaminate(docs, bench, max_bytes=max_bytes)
    assert clean.columns == docs.columns or set(clean.columns) == set(docs.columns)
    assert clean.count() == sum(not slow_hits(r.text, items)[4] for r in docs.collect())
    assert dc.hits(empty_docs(spark), bench, max_bytes=max_bytes).count() == 0


def test_remove_spans(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "A One, two three. End."), (2, "clean, text"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dc.decontaminate(docs, bench, "remove_spans").collect()}
    assert got == {1: "A . End.", 2: "clean, text", 3: None}
