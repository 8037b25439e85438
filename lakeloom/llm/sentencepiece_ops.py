"""SentencePiece ids of whole texts, their decoding, and parity with the reference library."""

from __future__ import annotations

import os
import re
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepiece_model import BYTE, SPACE, build_tokenizer, parse_model, words_are_independent
from .shared import appended, query, read, slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts of one multithreaded call hold about this many characters (a longer text is a call of its own).
CALL_CHARS = 1 << 18
#: Texts of a batch that are Python strings at once.
ROWS = 256
#: A word with the markers before it, as the model's tokenizer splits a text that begins with a marker.
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")


def load_model(path: str = MODEL_PATH) -> bytes:
    """The model file's bytes; the driver reads them and ships them with the tasks (half a MB)."""
    with open(path, "rb") as f:
        return f.read()


def _tokenizer(model: bytes, threads: int):
    os.environ["RAYON_NUM_THREADS"] = str(threads)  # read when the library makes its pool
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    return build_tokenizer(model)


class _WordIds(dict):
    """Ids (int32 bytes) of words with the markers before them; forgets its words when it holds ``limit``."""

    def __init__(self, model: bytes, limit: int = 1 << 17):
        super().__init__()
        self.tok, self.limit = build_tokenizer(model, prefix=False), limit
        self.size = np.array([1 if kind == BYTE else len(p.encode()) for p, _, kind in parse_model(model).pieces], np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode words end to end; each has the ids whose bytes are its own."""
        ids = np.array(self.tok.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, "<i4")
        done, ends = np.cumsum(self.size[ids]), np.cumsum([len(w.encode()) for w in words])
        last = np.minimum(np.searchsorted(done, ends), len(ids) - 1)
        if (done[last] == ends).all():
            until = (last + 1).tolist()
            self.update((w, ids[i:j].tobytes()) for w, i, j in zip(words, [0, *until], until, strict=False))
        else:  # unknown characters, which no byte stands for
            self.update((w, np.array(e.ids, "<i4").tobytes()) for w, e in zip(words, self.tok.encode_batch_fast(words, add_special_tokens=False), strict=True))

    def of(self, texts: list[list[str]]) -> list[bytes]:
        if len(self) > self.limit:
            self.clear()
        if new := sorted(set(chain.from_iterable(texts)).difference(self)):
            self._learn(new)
        return [b"".join(map(self.__getitem__, words)) for words in texts]


class TextEncoder:
    """Ids of whole texts; on request each is decoded again and compared with the sentencepiece library.

    Where a model's words are independent, a text's ids are put together from
    those of all its words, each word encoded once a while; other models encode
    the text at once.
    """

    def __init__(self, model: bytes, threads: int, verify: bool = False):
        self.model, self.threads, self.library, parsed = model, threads, None, parse_model(model)
        self.words = _WordIds(model) if words_are_independent(parsed) else None
        self.pieces = None
        if verify:
            import sentencepiece
            self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
            if self.words is not None:
                self.pieces = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, _, kind in parsed.pieces]

    @cached_property
    def tok(self):
        """The tokenizer of texts at once, made when it is asked for; None where the words' tokenizer does and nothing is verified."""
        return None if self.words is not None and self.library is None else _tokenizer(self.model, self.threads)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian int32."""
        if self.words is None:
            return [np.array(e.ids, "<i4").tobytes() for e in self.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        return self.words.of([WORDS.findall((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts])

    def _same(self, ids: list[int], text: str) -> bool:
        return b"".join(map(self.pieces.__getitem__, ids)) == (" " + text.replace(SPACE, " ") if text else "").encode()

    def checked(self, texts: list[str | None], ids: list[bytes]) -> tuple[list[bool], list[bool]]:
        """Whether each text's ids decode to it (U+2581 is the space it stands for), and whether the library has the same ids for it."""
        plain, lists = [t or "" for t in texts], [np.frombuffer(i, "<i4").tolist() for i in ids]
        if self.pieces is not None:
            back = list(map(self._same, lists, plain))
        else:
            back = [a == t.replace(SPACE, " ") for a, t in zip(self.tok.decode_batch(lists, skip_special_tokens=False), plain, strict=True)]
        return back, [a == b for a, b in zip(lists, self.library.encode(plain, num_threads=self.threads), strict=True)]


@lru_cache(1)
def _encoder(model: bytes, threads: int, verify: bool) -> TextEncoder:
    """The encoder of a Python worker, kept for its next task."""
    return TextEncoder(model, threads, verify)


def _threads(docs: DataFrame, threads: int | None) -> int:
    """Threads of a task's calls: by default the cores that Spark gives a task, and two at least."""
    return threads or max(2, int(docs.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1")))


def encode(docs: DataFrame, text_col: str = "text", *, model: bytes, out: str = "ids", threads: int | None = None) -> DataFrame:
    """``docs`` with ``out``: the ids of the whole text (array<int>; empty for null and empty texts).

    Every column passes through, so ``out`` must not be one of them.  Each row is
    encoded on its own, repeated ones too; an empty table gives no rows.
    """
    threads = _threads(docs, threads)

    def make():
        encoder = _encoder(model, threads, False)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            parts, sizes, column = [], [0], batch.column("__text")
            for at in range(0, len(column), ROWS):
                for texts in slices(column.slice(at, ROWS).to_pylist(), CALL_CHARS):
                    ids = encoder(texts)
                    sizes += [len(i) // 4 for i in ids]
                    parts += ids
            return [pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))]
        return run

    return appended(docs, {"__text": text_col}, make, f"{out} array<int>")


def decode(docs: DataFrame, ids_col: str = "ids", *, model: bytes, out: str = "decoded", threads: int | None = None) -> DataFrame:
    """``docs`` with ``out``: the text of an id array; empty for null and empty arrays."""
    threads = _threads(docs, threads)

    def make():
        tok = _tokenizer(model, threads)
        return lambda batch: [pa.array(tok.decode_batch([i or [] for i in batch.column("__ids").to_pylist()], skip_special_tokens=False), pa.string())]

    return appended(docs, {"__ids": F.col(ids_col)}, make, f"{out} string")


def encoding_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: bytes,
                    threads: int | None = None) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_hash`` (xxh3 of the ids as little-endian int32), ``round_trip``, ``parity``.

    ``round_trip`` says that decoding the whole text's ids gives it back, with
    U+2581 read as the space it stands for; ``parity`` that the sentencepiece
    library gives the same ids for the whole text.  Null and empty texts have no tokens and are true in both.  Repeated
    rows are each reported; other columns are not read; an empty table gives no rows.
    """
    threads = _threads(docs, threads)

    def make():
        encoder = _encoder(model, threads, True)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            count, digest, back, same = [], [], [], []
            for texts in slices(batch.column("__text").to_pylist(), CALL_CHARS):
                ids = encoder(texts)
                decoded, agreed = encoder.checked(texts, ids)
                count += [len(i) // 4 for i in ids]
                digest += map(xxhash.xxh3_64_hexdigest, ids)
                back += decoded
                same += agreed
            return [pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back), pa.array(same)]
        return run

    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    return appended(ids, {}, make, "n_tokens long, ids_hash string, round_trip boolean, parity boolean").drop("__text")


@query("op10_sentencepiece")
def op10_sentencepiece(spark, sf_dir):
    return encoding_report(read(spark, sf_dir, "documents"), model=load_model())
