import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from incidentry.llm import fill_in_middle as f
from tests.llm.helpers import EDGE_TEXTS, edge_docs, empty_docs, prose

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = EDGE_TEXTS + ["a<P>b c", "x <M", "<", ">P> <", "end <P", "ends in blanks  ", " \n", "é ü  x", "a\x1cb\x85c\x1f d",
                      "𝒳 y 𝒵" * 40]


def slow_row(i, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_brute_force(spark):
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 3 else prose(i, i % 200)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = f.transform(docs).withColumn("back", f.restored(F.col("output"), F.col("form"))).collect()
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    text = dict(rows)
    for r in out:
        assert tuple(r)[:6] == slow_row(r.doc_id, text[r.doc_id])
        assert r.back == (text[r.doc_id] or "")


def test_edges(spark):
    edge = edge_docs(spark, TEXTS)
    got = f.transform(edge).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(slow_row(r.doc_id, r.text)) for r in edge.collect())
    assert f.transform(empty_docs(spark)).count() == 0 and f.index_rows(empty_docs(spark)).count() == 0


def test_lines_keep_their_error():
    r = random.Random(2)
    shapes = [[1] * 5000, [r.randrange(1, 9) for _ in range(20_000)], [r.choice([1, 1000]) for _ in range(3000)],
              [1] * 2000 + [50] * 2000 + [3] * 2000, [10 ** 6, 1, 10 ** 6], [1], []]
    for lengths in shapes:
        bounds = np.concatenate(([0], np.cumsum(np.array(lengths, np.int64)))).astype(np.int64)
        for error in (1, 10, 100):
            index = f.fit(bounds, error)
            assert index.cuts(range(len(bounds))) == bounds.tolist()
            assert np.abs(index.residuals.astype(int)).max() <= error + 1
    assert len(f.fit(np.arange(10 ** 6, dtype=np.int64) * 7).firsts) == 1


def test_stored_index_cuts_the_same(spark):
    docs = spark.createDataFrame([(i, prose(i, 3 * i) + "  ") for i in range(40)] + [(99, None)], "doc_id long, text string")
    stored = f.index_rows(docs).select("doc_id", "n", F.explode(F.sequence(F.lit(0), "n")).alias("rank"), "segments", "residuals")
    cuts = stored.select("doc_id", "rank", f.cut_at(F.col("segments"), F.col("residuals"), F.col("rank")).alias("cut")).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    bounds = {i: f.boundaries(t).tolist() for i, t in text.items()}
    assert all(bounds[r.doc_id][r.rank] == r.cut for r in cuts) and len(cuts) == sum(map(len, bounds.values()))
