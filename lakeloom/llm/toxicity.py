"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Words run from white space to white space without outer punctuation, so digits
and marks put for letters stay in them.  A word's vector is the mean of the
embeddings of its character n-grams (and of itself) that the training sample has
often enough, so misspellings share vectors with the words they vary.  A window of neighbouring words is the mean
of its words' vectors and goes into a linear softmax.  Embeddings and softmax
are trained together: first every window of a toxic text counts as toxic, then
only the window that the model finds worst (the others may well be clean).  A
text scores by its worst window, through a logistic fit on sample texts that
the training left aside; their worst windows are found in the tasks, over whole
texts of any length.

As the softmax is linear, a trained model is one number for each n-gram, and
scoring a text is a running sum over its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import appended, crc_mod, query, read, slices, written
from .subwords import Adam, WordTable, logistic_fit, marked_words, ngram_ids, sigmoid

BITS, LO, HI, DIM = 17, 3, 5, 8
WINDOW, STRIDE = 2, 1
#: An n-gram counts if so many texts of the sample have it.
LEAST_TEXTS = 5
#: Bounds of the labelled sample, per label: whole texts, since a piece of one may lack what made it toxic.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 2000
#: Of a label, training takes whole texts of about this many characters for each that the sample may have, but TRAIN_LEAST texts at least.
TRAIN_CHARS, TRAIN_LEAST = 6_000, 2 * LEAST_TEXTS
#: Texts are scored some characters at a time.
CALL_CHARS = 2_000_000
#: Training goes over texts of about this many words at a time, and over as many n-grams.
TRAIN_PART = 50_000


@dataclass
class ToxicityModel:
    table: np.ndarray  # a number for each n-gram; NaN where it is not known
    bias: float
    slope: float
    intercept: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        ids, owner = ngram_ids(words, LO, HI, BITS)
        known = ~np.isnan(self.table[ids])
        total = np.bincount(owner[known], self.table[ids[known]], len(words))
        return total / np.maximum(np.bincount(owner[known], minlength=len(words)), 1)

    def worst(self, texts: list[str], words: WordTable) -> np.ndarray:
        """The softmax's log-odds of each text's worst window."""
        tokens = [marked_words(t.lower()) if t else [] for t in texts]
        counts = np.array([len(t) for t in tokens], np.int64)
        index = words.index([w for t in tokens for w in t])
        worst = np.full(len(texts), self.bias)
        if len(index):
            begin, size, text = windows(counts)
            total = np.concatenate([[0.0], np.cumsum(words.values[index])])
            logit = (total[begin + size] - total[begin]) / size + self.bias
            worst = np.full(len(texts), -np.inf)
            np.maximum.at(worst, text, logit)
            worst[counts == 0] = self.bias
        return worst

    def scores(self, texts: list[str], words: WordTable) -> np.ndarray:
        logits = [self.worst(part, words) for part in slices(texts, CALL_CHARS)]
        return sigmoid(self.slope * np.concatenate(logits) + self.intercept) if logits else np.zeros(0)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of the windows over texts laid end to end; together they cover every word."""
    per = np.where(counts > WINDOW, 1 + -(-(counts - WINDOW) // STRIDE), (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = np.cumsum(counts) - counts
    within = np.minimum(nth * STRIDE, np.maximum(counts[text] - WINDOW, 0))
    return start[text] + within, np.minimum(counts[text], WINDOW), text


def sorted_ngrams(words: list[str], part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, word) in order of the words."""
    ids, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for at in range(0, len(words), part):
        gram, owner = ngram_ids(words[at : at + part], LO, HI, BITS)
        order = np.argsort(owner, kind="stable")
        ids.append(gram[order].astype(np.int32))
        owners.append((owner[order] + at).astype(np.int32))
    return np.concatenate(ids), np.concatenate(owners)


def set_aside(y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of each label a fifth, for the logistic fit."""
    aside = np.zeros(len(y), bool)
    for v in (0, 1):
        own = np.flatnonzero(y == v)
        aside[rng.permutation(own)[: len(own) // 5]] = True
    return aside


def rejects_nothing() -> ToxicityModel:
    """What a sample without texts of both labels gives: every text scores (next to) 0."""
    return ToxicityModel(np.full(1 << BITS, np.nan), 0.0, 1.0, -60.0)


def calibrate(model: ToxicityModel, worst: np.ndarray, y: np.ndarray, aside: np.ndarray) -> ToxicityModel:
    """Fit the logistic cut on texts left aside, or on all if those lack a label."""
    held = aside if 0 < y[aside].sum() < aside.sum() else np.ones(len(y), bool)
    model.slope, model.intercept = logistic_fit(worst[held], y[held])
    return model


def train(texts: list[str], labels: np.ndarray, *, first: int = 10, steps: int = 25, rate: float = 0.15, seed: int = 3) -> ToxicityModel:
    """Fit a model; without texts of both labels it rejects nothing."""
    y = np.asarray(labels, float)
    if not 0 < y.sum() < len(y):
        return rejects_nothing()
    rng = np.random.default_rng(seed)
    aside = set_aside(y, rng)
    model = embed([t for t, left in zip(texts, aside, strict=True) if not left], y[~aside], rng, first=first, steps=steps, rate=rate)
    words = WordTable(model.word_scores, 1 << 16)
    worst = np.concatenate([model.worst(part, words) for part in slices(texts, CALL_CHARS // 4)])
    return calibrate(model, worst, y, aside)


def text_runs(counts: np.ndarray) -> list[tuple[slice, slice]]:
    """(texts, words) of texts laid end to end, about ``TRAIN_PART`` words at a time (a longer text alone)."""
    ends, start, out = np.cumsum(counts), 0, []
    while start < len(counts):
        before = ends[start] - counts[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + TRAIN_PART, "right")))
        out.append((slice(start, stop), slice(before, ends[stop - 1])))
        start = stop
    return out


def summed(index: np.ndarray, values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """``np.bincount(index, values[at], size)`` without copies of the whole; sums are taken in the same order."""
    out = np.zeros(size)
    for i in range(0, len(index), TRAIN_PART):
        np.add.at(out, index[i : i + TRAIN_PART], values[at[i : i + TRAIN_PART]])
    return out


@dataclass
class WindowRun:
    """Windows of some training texts; places count from the run's first word, ``own`` are its windows among all."""
    words: slice
    own: slice
    begin: np.ndarray
    size: np.ndarray
    toxic: np.ndarray
    first: np.ndarray  # of each text
    per_text: np.ndarray

    @staticmethod
    def of(counts: np.ndarray, y: np.ndarray) -> list[WindowRun]:
        out, at = [], 0
        for texts, words in text_runs(counts):
            begin, size, text = windows(counts[texts])
            first = np.flatnonzero(np.diff(text, prepend=-1))
            if len(begin):
                out.append(WindowRun(words, slice(at, at + len(begin)), begin.astype(np.int32), size.astype(np.int32), y[texts][text] == 1,
                                     first.astype(np.int32), np.diff(first, append=len(text)).astype(np.int32)))
            at += len(begin)
        return out


def known_ngrams(counts: np.ndarray, word: np.ndarray, ids: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The n-grams that enough training texts have."""
    seen = [np.zeros(0, np.int64)]
    for texts, words in text_runs(counts):
        doc = np.repeat(np.arange(texts.start, texts.stop), counts[texts])
        seen.append(np.unique(doc * len(reach) + word[words].astype(np.int64)))
    seen = np.concatenate(seen)
    starts = np.cumsum(reach) - reach
    texts_of = np.zeros(1 << BITS, np.int64)
    for part in np.array_split(seen, max(1, len(seen) // 20_000)):
        d, w = np.divmod(part, len(reach))
        at = np.repeat(starts[w], reach[w]) + np.arange(reach[w].sum()) - np.repeat(np.cumsum(reach[w]) - reach[w], reach[w])
        # a text that lies in two parts counts twice at most, for the n-grams at the seam
        texts_of += np.bincount(np.unique(np.repeat(d, reach[w]) << BITS | ids[at]) & ((1 << BITS) - 1), minlength=1 << BITS)
    return np.flatnonzero(texts_of >= LEAST_TEXTS)


def embed(texts: list[str], y: np.ndarray, rng: np.random.Generator, *, first: int = 10, steps: int = 25, rate: float = 0.15) -> ToxicityModel:
    """Embeddings and softmax, without the logistic cut, from texts of both labels.

    The driver trains, so beside a number for each word and window and two for
    each n-gram of a word it holds what belongs to ``TRAIN_PART`` words.
    """
    vocabulary: dict[str, int] = {}
    word = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in marked_words(t.lower())), np.int32) for t in texts]
    counts, word = np.array([len(r) for r in word], np.int64), np.concatenate(word)
    ids, owner = sorted_ngrams(list(vocabulary))
    n_words = len(vocabulary)
    del vocabulary
    known = known_ngrams(counts, word, ids, np.bincount(owner, minlength=n_words))
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    gram = place[ids]
    owner, gram = owner[gram >= 0], gram[gram >= 0]
    del ids
    share_of = 1 / np.maximum(np.bincount(owner, minlength=n_words), 1)

    params = {"e": rng.normal(0, 0.1, (len(known), DIM)), "w": rng.normal(0, 0.5, DIM), "b": np.zeros(1)}
    adam = Adam(params, rate)
    runs = WindowRun.of(counts, y)
    n_windows = runs[-1].own.stop if runs else 0
    d, used = np.zeros(n_windows), np.zeros(n_windows, bool)
    for step in range(first + steps):
        # the softmax is linear: every sum over vectors is a sum over one number for each n-gram
        of_word = summed(owner, params["e"] @ params["w"], gram, n_words) * share_of
        before, n_used = 0.0, {True: 0, False: 0}
        for r in runs:
            total = np.cumsum(np.concatenate([[before], of_word[word[r.words]]]))
            before = total[-1]
            z = d[r.own] = (total[r.begin + r.size] - total[r.begin]) / r.size + params["b"][0]
            used[r.own] = True
            if step >= first:
                used[r.own] = ~(r.toxic & (z < np.repeat(np.maximum.reduceat(z, r.first), r.per_text)))
            for v in n_used:
                n_used[v] += int((used[r.own] & (r.toxic == v)).sum())
        # both labels weigh the same
        weight = {v: np.float32(1) / np.float32(max(n, 1)) for v, n in n_used.items()}
        spread = np.zeros(n_words)
        for r in runs:
            d[r.own] = np.where(used[r.own], np.where(r.toxic, weight[True], weight[False]), np.float32(0)) * (sigmoid(d[r.own]) - r.toxic)
            pick = np.flatnonzero(d[r.own])
            size = r.size[pick]
            at = np.repeat(r.begin[pick] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            np.add.at(spread, word[r.words][at], np.repeat(d[r.own][pick] / size, size))
        bias = d.sum()
        of_gram = summed(gram, spread * share_of, owner, len(known))
        adam.step({"e": np.outer(of_gram, params["w"]) + 1e-6 * params["e"], "w": of_gram @ params["e"] + 1e-6 * params["w"], "b": np.array([bias])})
    table = np.full(1 << BITS, np.nan)
    table[known] = params["e"] @ params["w"]
    return ToxicityModel(table, float(params["b"][0]), 1.0, 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, bounds: dict[int, int], usable) -> DataFrame:
    """Whole texts (``__id``, ``__y``, ``__text``) of a sample that doesn't depend on the order of rows, written.

    Of each label value the ids with a text that have the smallest hashes, at
    most ``bounds[value]`` of them.  Ids with conflicting labels, null labels and
    null texts are not used.
    """
    text = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).filter("__id is not null and __text is not null")
    own = (labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label).alias("__y")).filter("__id is not null and __y is not null")
           .filter(usable("__id")).groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).filter("__y = __z"))
    own = own.join(text.select("__id"), "__id", "left_semi")
    order = F.xxhash64("__id")
    picks = [own.filter(F.col("__y") == v).orderBy(order, "__id").limit(n).select("__id", F.col("__y").cast("int").alias("__y")) for v, n in bounds.items()]
    picked = picks[0]
    for p in picks[1:]:
        picked = picked.unionAll(p)
    # one text of an id: repeated rows are no further evidence
    rows = text.join(F.broadcast(written(picked, "picked")), "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text"))
    return written(rows, "sample")


def to_train(sizes: np.ndarray, y: np.ndarray, aside: np.ndarray, bounds: dict[int, int]) -> np.ndarray:
    """The texts to train on, in the order given: of each label up to its characters, those left aside excepted."""
    taken = np.zeros(len(y), bool)
    for v, n in bounds.items():
        own = np.flatnonzero((y == v) & ~aside)
        before = np.cumsum(sizes[own]) - sizes[own]
        taken[own] = (before < n * TRAIN_CHARS) | (np.arange(len(own)) < TRAIN_LEAST)
    return taken


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 usable=lambda c: crc_mod(c, 5) != 0) -> ToxicityModel:
    """Train on a bounded sample of the rows that ``usable`` admits.

    Training collects whole texts up to a number of characters; the others of the
    sample stay in the tasks and serve the logistic fit, whatever their length.
    Without texts of both labels the model rejects nothing.
    """
    bounds = {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}
    sample = labelled_sample(docs, labels, "toxic", id_col, text_col, bounds, usable)
    rows = sample.select("__id", "__y", F.length("__text").alias("size")).orderBy(F.xxhash64("__id"), "__id").collect()
    ids, y = np.array([r["__id"] for r in rows], np.int64), np.array([r["__y"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return rejects_nothing()
    rng = np.random.default_rng(3)
    taken = to_train(np.array([r["size"] for r in rows], np.int64), y, set_aside(y, rng), bounds)
    texts = {r["__id"]: r["__text"] for r in sample.filter(F.col("__id").isin(ids[taken].tolist())).select("__id", "__text").collect()}
    model = embed([texts.pop(i) for i in ids[taken].tolist()], y[taken], rng)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        words = WordTable(shipped.value.word_scores, 1 << 16)
        return lambda batch: [pa.array(np.concatenate([shipped.value.worst(part, words) for part in slices(batch.column("__text").to_pylist(), CALL_CHARS // 4)]), pa.float64())]

    found = dict(appended(sample, {}, make, "worst double").select("__id", "worst").collect())
    return calibrate(model, np.array([found[i] for i in ids.tolist()]), y, ~taken)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the probability, 0 to 1, that the whole text is toxic.

    Only the text is read.  Null, empty and wordless texts score as a window
    without known words.  Every column passes through, so ``out`` must not be one
    of them; repeated rows are each scored; an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        words = WordTable(shipped.value.word_scores)
        return lambda batch: [pa.array(shipped.value.scores(batch.column("__text").to_pylist(), words), pa.float64())]

    return appended(docs, {"__text": text_col}, make, f"{out} double")


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
