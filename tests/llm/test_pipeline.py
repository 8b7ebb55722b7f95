import random

import pytest

import corpus_pipeline as cp
from incidentry.llm import mixing
from tests.llm.helpers import edited, prose
from tests.llm.test_ngram_join import slow_components
from tests.llm.test_quality_and_decontamination import slow_figures, slow_hits

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    r = random.Random(5)
    texts = [prose(i, r.choice([20, 70, 120])) for i in range(60)]
    texts += [edited(texts[i], i, 0.01) for i in range(0, 60, 3)] + [texts[1], "### " * 80, None, ""]
    bench = [(i, prose(900 + i, 25)) for i in range(3)]
    texts += [prose(300 + i, 60) + " " + bench[i][1] for i in range(3)]
    docs = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, bench = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def fails(text):
        n, chars, symbols, dup, rep, lines, upper = slow_figures(text)
        return (n < 50 or 100 * rep > 50 * n or 100 * symbols > 25 * n or 100 * dup > 60 * lines or chars > 30 * n or chars < 2 * n
                or 100 * upper > 60 * chars)

    good = sorted(i for i, t in rows if not fails(t))
    kept = cp.quality(spark, docs, folder)
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == good

    rows = [(i, t) for i, t in rows if i in good]
    unique = sorted({eval(x)[2] for x in slow_components(rows)})
    kept = cp.near_duplicates(spark, kept, folder)
    assert set(kept.columns) == set(columns) and sorted(r.doc_id for r in kept.collect()) == unique

    clean = sorted(i for i, t in rows if i in unique and not slow_hits(t, bench)[4])
    assert 0 < len(clean) < len(unique)
    kept = cp.benchmark_free(spark, kept, folder)
    assert set(kept.columns) == set(columns) and sorted(r.doc_id for r in kept.collect()) == clean

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    times = mixing.mixed_rates(kept, labels, factors=cp.MIX_FACTORS).join(kept.select("doc_id", "text"), "doc_id").select(
        "doc_id", mixing.copies(mixing.F.col("rate"), mixing.F.col("doc_id"), mixing.F.col("text")).alias("n")).collect()
    mixed = cp.mix(spark, kept, folder)
    assert set(mixed.columns) == set(columns)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in times for _ in range(r.n))


def test_run(spark, folder):
    got = cp.run(spark, folder).orderBy("start").collect()
    assert got and [n for n, _ in cp.STAGES][0] == "quality rules" and len(cp.STAGES) == 5
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
