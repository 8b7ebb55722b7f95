import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from incidentry.llm import token_archive as ta
from tests.llm.helpers import EDGE_TEXTS, edge_docs, edited, empty_docs, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return ta.Encoder(f.read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=st.sampled_from(list("aZéİßK'.,!? \ń <|>e")), max_size=30)), max_size=4))
def test_same_ids_as_the_library(encoder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["don't <|endoftext|> Stop."]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode(texts)] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(2, 6), max_size=60), min_size=1, max_size=6))
def test_round_trip_of_shards(docs):
    ta_least, ta.LEAST_COUNT = ta.LEAST_COUNT, 2
    try:
        raw = [np.array([*d, 1], "<u2").tobytes() for d in docs]
        shard = ta.Shard(ta.pack(raw, "<u2", 7, 1))
    finally:
        ta.LEAST_COUNT = ta_least
    assert shard.ids().tobytes() == b"".join(raw)
    for k, d in enumerate(raw):
        ids = np.frombuffer(d, "<u2")
        assert shard.ids(k).tolist() == ids.tolist()
        assert shard.window(k, 1, 4).tolist() == ids[1:4].tolist()


def test_rules_compress():
    ids = np.array(([5, 6, 7, 8] * 500 + [1]) * 4, np.uint32)
    symbols, rules = ta.re_pair(ids, 100, 1, 50)
    assert len(symbols) < len(ids) / 8 and (rules != 1).all()


def test_archive_of_edges(spark, tmp_path, encoder):
    docs = edge_docs(spark, [*EDGE_TEXTS, edited(prose(1), 1, 0.1)])
    path = str(tmp_path / "a")
    ta.write_archive(docs, path, PATH, shard_tokens=500)
    got = ta.read_archive(spark.read.parquet(path)).orderBy("start").collect()
    texts = {}
    for r in docs.collect():
        ids = encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        texts.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
        texts[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
    assert not any(texts.values())
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    assert spark.read.parquet(path).count() > 3


def test_empty_archive(spark, tmp_path):
    path = str(tmp_path / "b")
    ta.write_archive(empty_docs(spark), path, PATH)
    assert ta.read_archive(spark.read.parquet(path)).count() == 0


def test_large_stores_of_a_worker_go_with_their_stage(monkeypatch):
    """The encoder's words must not stay in a worker that has gone on to another operator."""
    from incidentry.llm import common

    monkeypatch.setattr(common, "_stage", lambda: 1)
    made = [common.worker_store("test-large", list, large=True), common.worker_store("test-small", list)]
    common.let_go_large()
    assert common.worker_store("test-large", list, large=True) is made[0]
    monkeypatch.setattr(common, "_stage", lambda: 2)
    common.let_go_large()
    assert common.worker_store("test-large", list, large=True) is not made[0]
    assert common.worker_store("test-small", list) is made[1]
