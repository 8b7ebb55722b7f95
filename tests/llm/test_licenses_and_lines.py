import re

from incidentry.llm import license_scan as ls
from incidentry.llm import line_templates as lt
from tests.llm.helpers import EDGE_TEXTS, edge_docs, empty_docs, prose

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_base(text):
    w = PLAIN.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(i, label) for label, phrase in ls.BASE_PHRASES for p in [phrase.split()]
              for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = ["Released under the MIT License.\n" + prose(1), "cc by nc cc by nc, CC-BY-NC", "Apache License, Version 2.0; under the mit license" * 2,
         "licensed under the kind apache software license version 2 0", "under the mit", "İunder the mit license K", "the mit license under",
         "Permission is hereby granted, free of charge, to any person obtaining copies of this software"]


def test_places_against_brute_force(spark):
    docs = edge_docs(spark, [*EDGE_TEXTS, *TEXTS])
    got = ls.scan(docs).collect()
    want = sorted(repr((r.doc_id, *slow_base(r.text))) for r in docs.collect())
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    near = next(r for r in got if r.doc_id == len(EDGE_TEXTS) + 7)
    assert near.labels == "mit" and near.n_base == 0 and near.score >= ls.LEAST_COVER
    assert ls.scan(empty_docs(spark)).count() == 0


def test_neighbouring_diagonals_merge(spark):
    text = "this is free and unencumbered software now released into the public domain"
    row = ls.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == "unlicense" and row.base_labels == ""


def test_recurring_templates_go(spark):
    texts = [f"{prose(i, 12)}\nUser name{chr(97 + i)} logged in from host {i} at port {7 * i}\n\n{prose(500 + i, 9)}\nSeen in all twelve of them" for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in lt.drop_recurring(docs).collect():
        lines = texts[r.doc_id].split("\n")
        assert r.text == "\n".join([lines[0], lines[1], lines[2], lines[3]]) and (r.n_lines, r.n_dropped) == (4, 1)
    logs = [f"{prose(i, 12)}\nUser logged in from name{'abcdefghijkl'[i]} at port {7 * i} again" for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(logs)), "doc_id long, text string")
    assert all(r.n_dropped == 1 and r.text == logs[r.doc_id].split("\n")[0] for r in lt.drop_recurring(docs).collect())


def test_only_different_texts_count(spark):
    many = "\n".join(f"the ratio of {x} in the sample" for x in "abcdefghijkl")
    copied = f"{prose(1, 9)}\nall copies of one text say this"
    docs = spark.createDataFrame([(0, many), (1, prose(2, 9)), *((k, copied) for k in range(2, 30))], "doc_id long, text string")
    rows = lt.drop_recurring(docs).collect()
    assert len(rows) == 30 and all(r.n_dropped == 0 for r in rows)


def test_passages_recur_from_two_texts_on(spark):
    passage, short = prose(7, lt.LONG_LINE), prose(8, lt.LONG_LINE - 1)
    texts = [f"{prose(10 + k, 9)}\n{passage}\n{short}" for k in range(2)] + [prose(9, 80)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_dropped, r.text) for r in lt.drop_recurring(docs).collect()}
    assert got == {k: (1, f"{prose(10 + k, 9)}\n{short}") if k < 2 else (0, texts[k]) for k in range(5)}


def test_line_edges(spark):
    docs = edge_docs(spark)
    rows = lt.drop_recurring(docs).collect()
    assert len(rows) == docs.count() and all(r.n_dropped == 0 for r in rows)
    assert sorted(r.text for r in rows) == sorted(r.text or "" for r in docs.collect())
    assert lt.drop_recurring(empty_docs(spark)).count() == 0


def test_no_python_in_the_plans(spark):
    for df in (ls.scan(edge_docs(spark)), lt.drop_recurring(edge_docs(spark))):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_masks_of_all_lines_are_not_written(spark, monkeypatch):
    """Of lines in leaves that few texts reach only hashes are kept; templates still have the masks of theirs."""
    columns, written = {}, lt.written
    monkeypatch.setattr(lt, "written", lambda df, name: columns.update({name: df.columns}) or written(df, name))
    logs = [f"job {i} ended with code {i % 3} today\n{prose(100 + i, 12)}" for i in range(30)]
    docs = spark.createDataFrame([*enumerate(logs), (99, logs[0]), (100, None)], "doc_id long, text string")
    found = lt.templates(docs, lt.lines_by_leaf(docs)).collect()
    assert "mask" not in columns["lines"] and "mask" in columns["leaf-lines"]
    assert [(r.mask, r.support) for r in found] == [("job <*> ended with code <*> today", 30)]
    rows = {r.doc_id: (r.n_dropped, r.text) for r in lt.drop_recurring(docs).collect()}
    assert rows[99] == rows[0] == (1, logs[0].split("\n")[1]) and rows[100] == (0, "")
