import numpy as np

from incidentry.llm import mixing as m
from tests.llm.helpers import edge_docs, empty_docs, prose

SLURS = ["vile", "foul", "nasty", "rotten"]


def labelled(spark, n=300):
    rows, labels = [], []
    for i in range(n):
        words = prose(i, 60).split()
        kind = i % 3
        if kind == 1:
            words = [w + "###" for w in words]
        if kind == 2:
            words[5::15] = [SLURS[(i + k) % 4] for k in range(len(words[5::15]))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = m.fit(docs, labels.where("doc_id < 210"))
    got = m.memberships(docs.where("doc_id >= 210"), model).collect()
    right = sum(int(np.argmax(r.p)) == r.doc_id % 3 for r in got)
    assert right >= 0.9 * len(got)
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in got)


def test_rates_meet_targets(spark):
    docs, labels = labelled(spark)
    rows = m.mixed_rates(docs, labels, shares=(0.8, 0.15, 0.05)).collect()
    p, n, rate = np.array([r.p for r in rows]), np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    total = (rate[:, None] * n[:, None] * p).sum(0)
    assert (rate >= 0).all()
    assert np.allclose(total, np.array([0.8, 0.15, 0.05]) * n.sum(), rtol=1e-3)


def test_steps_against_a_plain_loop(spark):
    r = np.random.default_rng(1)
    p, n = r.dirichlet([1, 1, 1], 50), r.integers(1, 400, 50)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    target = np.array([0.9, 0.05, 0.05]) * n.sum()
    history = m.fit_rates(rows, target, steps=12, tolerance=0)
    a, rate = n[:, None] * p, np.ones(50)
    inverse = np.linalg.pinv(a.T @ a, rcond=1e-9, hermitian=True)
    for h in history:
        step = inverse @ (a.T @ rate - target)
        assert np.allclose(h, step, rtol=1e-6, atol=1e-12)
        rate = np.maximum(0, rate - a @ step)
    got = [x[0] for x in rows.select(m.rate_of(history)).collect()]
    assert np.allclose(sorted(got), sorted(rate))


def test_remix_keeps_columns_and_whole_copies(spark):
    docs, labels = labelled(spark)
    out = m.remix(docs, labels, (1.0, 0.5, 0.25))
    assert out.columns == docs.columns
    kept = {}
    for r in out.collect():
        kept[r.doc_id % 3] = kept.get(r.doc_id % 3, 0) + 1
    assert kept[0] >= 95 and 30 <= kept[1] <= 70 and kept.get(2, 0) <= 50


def test_edges(spark):
    _, labels = labelled(spark)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, None), (10 ** 9, 0, 0), (5, 1, 0)],
                                                   "doc_id long, quality int, toxic int"))
    docs = edge_docs(spark)
    rows = m.mixed_rates(docs, odd, factors=(1.0, 0.5, 0.25)).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    assert all(r.rate == 1 for r in rows if r.n_tokens == 0)
    none = m.mixed_rates(docs, labels.limit(0), shares=(0.5, 0.3, 0.2)).collect()
    assert all(np.allclose(r.p, 1 / 3) for r in none)
    assert m.mixed_rates(empty_docs(spark), labels, shares=(0.5, 0.3, 0.2)).count() == 0
    assert set(m.remix(docs, odd, (1.0, 0.5, 0.25)).columns) == set(docs.columns)
