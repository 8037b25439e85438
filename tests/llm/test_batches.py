"""Python gets, and hands back, batches of bounded size; an encoder holds one tokenizer."""

import pyarrow as pa

import corpus_pipeline
from lakeloom.llm import sentencepiece_ops, shared

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_parts_hold_all_rows_and_few_bytes(monkeypatch):
    monkeypatch.setattr(shared, "BATCH_BYTES", 1000)
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 100] * 95 + [None, "", "y" * 5000]})
    found = list(shared.parts(batch))
    assert pa.Table.from_batches(found).to_pylist() == batch.to_pylist() and len(found) > 9
    assert [p.num_rows for p in shared.parts(batch.slice(0, 1))] == [1] and list(shared.parts(batch.slice(0, 0))) == []
    assert max(p.nbytes for p in found[:-1]) < 2000


def test_stages_bound_batches_and_keep_the_callers_setting(spark):
    docs = spark.createDataFrame([(i, "some words " * 2000) for i in range(1500)], "doc_id long, text string").coalesce(1)
    was = spark.conf.getAll.get(KEY)
    try:
        spark.conf.unset(KEY)
        ids = corpus_pipeline.sentencepiece(spark, docs, "")
        assert spark.conf.get(KEY) == str(shared.BATCH_BYTES)
        sent = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
        assert max(r.n for r in sent.collect()) < 2 * shared.BATCH_BYTES
        assert len({tuple(r.ids) for r in ids.select("ids").collect()}) == 1 and ids.count() == 1500
        spark.conf.set(KEY, "1000000b")
        corpus_pipeline.sentencepiece(spark, docs, "")
        assert spark.conf.get(KEY) == "1000000b"
    finally:
        spark.conf.set(KEY, was) if was else spark.conf.unset(KEY)


def test_an_encoder_of_words_has_one_tokenizer():
    encoder = sentencepiece_ops.TextEncoder(sentencepiece_ops.load_model(), 2)
    assert encoder.words is not None and encoder.tok is None
