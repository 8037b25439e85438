"""Many small files are moved and read in tasks; whole texts are encoded from their words and checked."""

import base64
import os
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm import sentencepiece_ops
from lakeloom.sources import files, tables


def test_driver_moves_no_file(spark, tmp_dir, monkeypatch):
    """The commit leaves the files where tasks wrote them; tasks move them, and nothing stays beside the target."""
    rows = [(f"{i % 4}/{i}.bin", base64.b64encode(bytes([i])).decode()) for i in range(40)] + [("0/none.bin", None), (".hidden", "AA=="), ("_h/x", "AA==")]
    df = spark.createDataFrame(rows, "name string, content string").repartition(5)
    seen = []
    monkeypatch.setattr(files, "_clear_target", lambda *a: seen.append(a[1]) or a[0].create_dir(a[1], recursive=True))
    files.export_files(df, f"{tmp_dir}/e", "name", "content")
    assert seen == [f"{tmp_dir}/e"] and os.listdir(tmp_dir) == ["e"]
    got = {r.path: bytes(r.content) for r in files.read_files(spark, f"{tmp_dir}/e").collect()}
    assert got == {f"{tmp_dir}/e/{i % 4}/{i}.bin": bytes([i]) for i in range(40)} | {f"{tmp_dir}/e/0/none.bin": b""}
    assert files.read_files(spark, f"{tmp_dir}/nothing").count() == 0


def test_documents_of_one_file_each(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(files, "TASK_FILES", 3)
    for i, text in enumerate(['{"a": 1}', "broken", "", '{"a": 2}\n', "é"]):
        os.makedirs(f"{tmp_dir}/d/{i % 2}", exist_ok=True)
        with open(f"{tmp_dir}/d/{i % 2}/{i}.json", "w", encoding="utf-8") as f:
            f.write(text)
    found = tables.scan_json_docs(spark, f"{tmp_dir}/d", T.StructType([T.StructField("a", T.LongType())]))
    got = {os.path.basename(r.path): (r.raw, r.doc and r.doc.a) for r in found.collect()}
    assert got == {"0.json": ('{"a": 1}', 1), "1.json": ("broken", None), "3.json": ('{"a": 2}\n', 2), "4.json": ("é", None)}


def test_ids_of_words_are_ids_of_texts():
    """Put together from words that were met before or not, a text's ids are those of the text at once."""
    model = sentencepiece_ops.load_model()
    encoder = sentencepiece_ops.TextEncoder(model, 2, verify=True)
    encoder.words.limit = 50
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab e▁\n\té\u0000𝄞  the") for _ in range(rng.randint(0, 80))) for _ in range(300)] + [None, "", " ", "▁", " a ", "a" * 5000, "▁▁ x"]
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        ids = encoder(part)
        whole = [e.ids for e in encoder.tok.encode_batch_fast([t or "" for t in part], add_special_tokens=False)]
        assert [sentencepiece_ops.np.frombuffer(i, "<i4").tolist() for i in ids] == whole
        back, same = encoder.checked(part, ids)
        assert all(back) and all(same)
        wrong = [i[4:] if len(i) > 4 else i + i + b"\5\0\0\0" for i in ids]
        assert not any(encoder.checked(part, wrong)[1])


def test_a_worker_keeps_its_encoder(spark):
    model = sentencepiece_ops.load_model()
    assert sentencepiece_ops._encoder(model, 2, False) is sentencepiece_ops._encoder(model, 2, False)
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 0, F.repeat(F.lit("one two "), F.col("id").cast("int"))).alias("text"))
    got = sentencepiece_ops.encode(docs.repartition(3), model=model)
    assert got.where("size(ids) = 0").count() == 1 and got.count() == 20
