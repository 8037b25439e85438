"""Text quality: random-indexing word vectors pooled per document, a two-layer network, calibrated.

Every token has a sparse random index vector: +1 in one dimension and -1 in
another.  Its context vector is the sum of the index vectors of the tokens up to
two places away, over every text of the corpus: tasks sum what they have seen
and Spark adds the vectors up.  The most frequent tokens of the corpus have a
vector each (their number is a parameter, so that the table can be shipped);
rarer ones share ``SHARED`` further vectors by hash, since a token seen a few
times has no context to speak of.  Centred and scaled, context vectors are
averaged over a text, together with the tokens' own index vectors and the spread
of both.  A two-layer network in numpy is fitted on a bounded labelled sample,
and one temperature, chosen on sample texts that the fit left aside, calibrates
its probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import appended, crc_mod, query, read, written
from .subwords import Adam, sigmoid

OWN, SHARED, DIM, SEED = 1 << 15, 8192, 32, 17
ROWS = OWN + SHARED
#: Tokens that a task counts before it hands them on, and whose rows it remembers; texts that it holds as Python strings at once.
HELD_TOKENS, HELD_TEXTS = 1 << 16, 1024
OFFSETS = (1, 2)
HIDDEN = 32
#: Bounds of the labelled sample, per label.
SAMPLE_GOOD, SAMPLE_POOR = 4000, 4000
#: Words, numbers, and runs of other marks.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Texts are gathered into pieces of about this many tokens, smaller ones to pool (a row of vectors each), and so many texts at most.
PIECE, POOL_PIECE, PIECE_TEXTS = 200_000, 40_000, 4096


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The two dimensions of each row's index vector."""
    rng = np.random.default_rng(SEED)
    plus = rng.integers(0, DIM, ROWS)
    return plus, (plus + rng.integers(1, DIM, ROWS)) % DIM


def token_hash(token: str) -> int:
    h = xxhash.xxh3_64_intdigest(token, seed=SEED)
    return h - (1 << 64) if h >> 63 else h


class TokenRows(dict):
    """Token to row: below ``OWN`` the token's own, from there on one that it shares."""

    def __init__(self, own: dict[int, int]):
        super().__init__()
        self.own = own

    def __missing__(self, token: str) -> int:
        if len(self) > HELD_TOKENS:
            self.clear()
        h = token_hash(token)
        value = self[token] = self.own.get(h, OWN + h % SHARED)
        return value


def held_texts(batches):
    """The batches' texts, ``HELD_TEXTS`` at a time."""
    for batch in batches:
        column = batch.column("__text")
        for at in range(0, len(column), HELD_TEXTS):
            yield column.slice(at, HELD_TEXTS).to_pylist()


def frequent_tokens(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """Hash to row of the ``OWN`` most frequent tokens of all texts (ties: the smaller hash)."""
    def counts(batches):
        held: Counter = Counter()
        for texts in held_texts(batches):
            for t in texts:
                if t:
                    held.update(TOKEN.findall(t))
            if len(held) > HELD_TOKENS:
                yield flushed(held)
        if held:
            yield flushed(held)

    def flushed(held: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(map(token_hash, held), pa.int64()), pa.array(held.values(), pa.int64())], names=["token", "n"])
        held.clear()
        return out

    parts = docs.select(F.col(text_col).alias("__text")).mapInArrow(counts, "token long, n long")
    top = parts.repartition("token").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(OWN)
    return {h: i for i, h in enumerate(sorted(r["token"] for r in top.collect()))}


def token_rows(text: str, rows: TokenRows) -> np.ndarray:
    found = TOKEN.findall(text)
    return np.fromiter(map(rows.__getitem__, found), np.int64, len(found))


def pieces(texts: list[str | None], rows: TokenRows, most: int = PIECE):
    """(rows of all tokens, tokens per text) of the texts, some at a time."""
    own, size = [], 0
    for i, t in enumerate(texts):
        own.append(token_rows(t, rows) if t else np.empty(0, np.int64))
        size += len(own[-1])
        if size >= most or len(own) == PIECE_TEXTS or i == len(texts) - 1:
            yield np.concatenate(own), np.array([len(x) for x in own])
            own, size = [], 0


def context_sums(tokens: np.ndarray, counts: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
    """Sums of the index vectors of neighbours, rows x dimensions."""
    text = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros(ROWS * DIM, np.int64)
    for d in OFFSETS:
        same = text[d:] == text[:-d]
        a, b = tokens[:-d][same], tokens[d:][same]
        for x, y in ((a, b), (b, a)):
            total += np.bincount(x * DIM + plus[y], minlength=ROWS * DIM)
            total -= np.bincount(x * DIM + minus[y], minlength=ROWS * DIM)
    return total.reshape(ROWS, DIM)


def context_vectors(docs: DataFrame, own: dict[int, int], text_col: str = "text") -> np.ndarray:
    """The corpus's word vectors (``ROWS`` x ``DIM``): sums over every text, centred and scaled to length 1."""
    names = [f"c{i}" for i in range(DIM)]
    shipped = docs.sparkSession.sparkContext.broadcast(own)

    def sums(batches):
        rows, (plus, minus) = TokenRows(shipped.value), index_vectors()
        total, seen = np.zeros((ROWS, DIM), np.int64), np.zeros(ROWS, np.int64)
        for texts in held_texts(batches):
            for tokens, counts in pieces(texts, rows):
                total += context_sums(tokens, counts, plus, minus)
                seen += np.bincount(tokens, minlength=ROWS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at]), *(pa.array(total[at, i]) for i in range(DIM))], names=["row", "seen", *names])

    parts = docs.select(F.col(text_col).alias("__text")).mapInArrow(sums, "row long, seen long, " + ", ".join(f"{n} long" for n in names))
    table = parts.groupBy("row").agg(F.sum("seen").alias("seen"), *[F.sum(n).alias(n) for n in names]).toArrow()  # ROWS rows at most
    at = table.column("row").to_numpy()
    out, seen = np.zeros((ROWS, DIM)), np.zeros(ROWS)
    seen[at] = table.column("seen").to_numpy()
    for i, n in enumerate(names):
        out[at, i] = table.column(n).to_numpy()
    out /= np.maximum(seen, 1)[:, None]
    out -= (out * seen[:, None]).sum(axis=0) / max(seen.sum(), 1)
    out[seen == 0] = 0
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray, rows: TokenRows) -> np.ndarray:
    """Per text the mean and spread of its tokens' context vectors, the mean of their index vectors, and how many differ."""
    plus, minus = index_vectors()
    out = []
    for tokens, counts in pieces(texts, rows, POOL_PIECE):
        n = len(counts)
        part = np.zeros((n, 3 * DIM + 2))
        if len(tokens):
            some = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[some]
            size, text = counts[some, None], np.repeat(np.arange(n), counts)
            # double sums, so that a text's figures don't depend on the texts around it
            own = vectors[tokens].astype(float)
            mean = np.add.reduceat(own, starts, axis=0) / size
            square = np.add.reduceat(own * own, starts, axis=0) / size
            part[some, :DIM], part[some, DIM : 2 * DIM] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
            index = np.bincount(text * DIM + plus[tokens], minlength=n * DIM) - np.bincount(text * DIM + minus[tokens], minlength=n * DIM)
            part[some, 2 * DIM : 3 * DIM] = index.reshape(n, DIM)[some] / size
            part[:, -2] = np.bincount(np.unique(text * ROWS + tokens) // ROWS, minlength=n) / np.maximum(counts, 1)
            part[:, -1] = np.log1p(counts)
        out.append(part)
    return np.concatenate(out) if out else np.zeros((0, 3 * DIM + 2))


@dataclass
class QualityModel:
    own: dict[int, int]
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        u = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.tanh(u @ self.layers["a"] + self.layers["b"]) @ self.layers["c"] + self.layers["d"][0]

    def scores(self, texts: list[str | None], rows: TokenRows) -> np.ndarray:
        return sigmoid(self.logits(pooled(texts, self.vectors, rows)) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, own: dict[int, int], vectors: np.ndarray, *, steps: int = 400, rate: float = 0.01, decay: float = 1e-3,
          seed: int = 9) -> QualityModel:
    """Fit network and temperature; without rows of both labels nothing can be told apart, and every text scores (next to) 1."""
    y = np.asarray(y, float)
    wide = x.shape[1]
    if not 0 < y.sum() < len(y):
        flat = {"a": np.zeros((wide, 1)), "b": np.zeros(1), "c": np.zeros(1), "d": np.array([60.0])}
        return QualityModel(own, vectors, np.zeros(wide), np.ones(wide), flat, 1.0)
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(y), bool)
    for v in (0, 1):
        mine = np.flatnonzero(y == v)
        aside[rng.permutation(mine)[: len(mine) // 5]] = True
    u, target = x[~aside], y[~aside]
    centre, scale = u.mean(axis=0), np.maximum(u.std(axis=0), 1e-4)
    u = np.clip((u - centre) / scale, -8, 8)
    params = {"a": rng.normal(0, wide**-0.5, (wide, HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1)}
    adam = Adam(params, rate)
    for _ in range(steps):
        h = np.tanh(u @ params["a"] + params["b"])
        e = (sigmoid(h @ params["c"] + params["d"][0]) - target) / len(target)
        back = np.outer(e, params["c"]) * (1 - h * h)
        adam.step({"a": u.T @ back + decay * params["a"], "b": back.sum(axis=0), "c": h.T @ e + decay * params["c"], "d": np.array([e.sum()])})
    model = QualityModel(own, vectors, centre, scale, params, 1.0)
    held = aside if 0 < y[aside].sum() < aside.sum() else np.ones(len(y), bool)
    z, n = model.logits(x[held]), y[held].sum()
    # targets a little inside 0 and 1, as a sample without errors would ask for certainty
    aim = np.where(y[held] == 1, (n + 1) / (n + 2), 1 / (held.sum() - n + 2))

    def loss(t: float) -> float:
        p = np.clip(sigmoid(z / t), 1e-12, 1 - 1e-12)
        return -(aim * np.log(p) + (1 - aim) * np.log(1 - p)).mean()

    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                usable=lambda c: crc_mod(c, 4) != 2) -> QualityModel:
    """Word vectors from every text of ``docs``; the network from a bounded sample of rows that ``usable`` admits.

    Of each label the ids with the smallest hashes are taken, at most
    ``SAMPLE_GOOD`` and ``SAMPLE_POOR``; their whole texts are pooled in the tasks
    and only the pooled vectors collected.  Without texts of both labels the model rejects nothing.  Ids with conflicting or null labels
    and rows with null ids are not used; an id's repeated rows count once.
    """
    words = frequent_tokens(docs, text_col)
    vectors = context_vectors(docs, words, text_col)
    shipped = docs.sparkSession.sparkContext.broadcast((words, vectors))
    own = (labels.select(F.col(id_col).cast("long").alias("__id"), F.col("quality").alias("__y")).filter("__id is not null and __y is not null")
           .filter(usable("__id")).groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).filter("__y = __z"))
    order = F.xxhash64("__id")
    picked = [own.filter(F.col("__y") == v).orderBy(order, "__id").limit(n).select("__id", "__y") for v, n in ((1, SAMPLE_GOOD), (0, SAMPLE_POOR))]

    def pool(batches):
        rows = TokenRows(shipped.value[0])
        for batch in batches:
            if batch.num_rows:
                x = pooled(batch.column("__text").to_pylist(), shipped.value[1], rows).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"__id": batch.column("__id"), "__y": batch.column("__y"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    text = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).filter("__text is not null")
    sample = written(picked[0].unionAll(picked[1]).select("__id", F.col("__y").cast("int")), "sample")
    found = text.join(F.broadcast(sample), "__id").select("__id", "__y", "__text").mapInArrow(pool, "__id long, __y int, x binary")
    rows = found.groupBy("__id", "__y").agg(F.min("x").alias("x")).orderBy("__id").collect()
    wide = 3 * DIM + 2
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, wide).astype(float)
    return train(x, np.array([r["__y"] for r in rows]), words, vectors)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the calibrated probability, 0 to 1, that the whole text is of good quality.

    Only the text is read.  Null, empty and blank texts score as a text without
    tokens.  Every column passes through, so ``out`` must not be one of them;
    repeated rows are each scored; an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        rows = TokenRows(shipped.value.own)
        return lambda batch: [pa.array(np.concatenate([shipped.value.scores(texts, rows) for texts in held_texts([batch])]), pa.float64())]

    return appended(docs, {"__text": text_col}, make, f"{out} double")


@query("op6_quality")
def op6_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
