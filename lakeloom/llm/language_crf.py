"""Language of words and texts by a linear-chain conditional random field.

Each word gets a potential for every language: the mean weight of its hashed
affixes and n-grams (n-grams of ``<word>``: those with a mark are prefixes and
suffixes), of the word itself, and of the lexicons (per language the words that
the training sample has most), plus learned transitions between neighbouring words.
Forward-backward gives each word's probability of each language, so a text may
switch languages; the text's language is the one with the most probability over
its letters.

The model is trained in numpy on a bounded sample.  A sequence is a run of one
text's words or, half of the time, of two texts' in turn, so that transitions
are learned from switches.  In prediction the chain covers the whole text: words
are cut into blocks, the blocks' transfer matrices are multiplied first, and
messages between blocks then give those inside, for all texts of a batch at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import appended, crc_mod, query, read, slices
from .subwords import Adam, WordTable, letter_runs, ngram_ids

BITS, LO, HI = 17, 2, 4
#: Training sample: so many texts per language, a piece of so many characters of each.
SAMPLE_TEXTS, SAMPLE_CHARS = 600, 1500
LEXICON = 200
SEQUENCES, LENGTH = 3000, 40
BLOCK = 64
UNDETERMINED = "und"
#: Texts are predicted some characters at a time.
CALL_CHARS = 2_000_000


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # weights of hashed features, features x languages
    lexicon: dict[str, int]  # word -> row of lexicon_weights
    lexicon_weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def potentials(self, words: list[str]) -> np.ndarray:
        """exp(potential) of each word and language, scaled to a largest value of 1."""
        ids, owner = ngram_ids(words, LO, HI, BITS)
        n = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        out = np.stack([np.bincount(owner, self.table[ids, k], len(words)) / n for k in range(len(self.languages))], axis=1)
        row = np.fromiter((self.lexicon.get(w, len(self.lexicon)) for w in words), np.int64, len(words))
        out += self.lexicon_weights[row]
        return np.exp(out - out.max(axis=1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.reshape(len(x), -1).sum(axis=1).reshape(-1, *[1] * (x.ndim - 1))


def marginals(emit: np.ndarray, counts: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """P(label of each word | its text) by forward-backward over texts laid end to end.

    ``emit`` holds exp(potential) of all words.  Texts are padded to whole
    blocks with words whose step changes nothing.
    """
    labels = emit.shape[1]
    counts = counts[counts > 0]
    blocks = -(-counts // BLOCK)
    first = np.cumsum(blocks) - blocks
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first * BLOCK, counts)
    total = int(blocks.sum())
    e = np.ones((total * BLOCK, labels))
    e[place] = emit
    e = e.reshape(total, BLOCK, labels)
    real = np.zeros(total * BLOCK, bool)
    real[place] = True
    real = real.reshape(total, BLOCK)
    move = np.exp(transitions - transitions.max())
    begin = np.exp(start - start.max())
    opens = np.zeros(total, bool)
    opens[first] = True

    def step(x: np.ndarray, t: int) -> np.ndarray:
        """Advance row messages (blocks x rows x labels) over word t; the first word of a text has no transition."""
        moved = x @ move
        if t == 0:
            moved = np.where(opens[:, None, None], x, moved)
        return np.where(real[:, t, None, None], moved * e[:, t, None, :], x)

    # transfer matrix of each block
    transfer = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for t in range(BLOCK):
        transfer = step(transfer, t)
        if t % 8 == 7:
            transfer = _scaled(transfer)
    # messages between blocks, for all texts in step
    into = np.empty((total, labels))
    back = np.empty((total, labels))
    a, b = np.tile(begin, (len(blocks), 1)), np.ones((len(blocks), labels))
    for j in range(int(blocks.max()) if len(blocks) else 0):
        on = np.flatnonzero(blocks > j)
        k = first[on] + j
        into[k] = a[on]
        a[on] = _scaled(np.einsum("ni,nij->nj", a[on], transfer[k]))
        k = first[on] + blocks[on] - 1 - j
        back[k] = b[on]
        b[on] = _scaled(np.einsum("nij,nj->ni", transfer[k], b[on]))
    # inside the blocks
    forward = np.empty((total, BLOCK, labels))
    x = into[:, None, :]
    for t in range(BLOCK):
        x = _scaled(step(x, t))
        forward[:, t] = x[:, 0]
    y = back
    for t in range(BLOCK - 1, -1, -1):
        forward[:, t] *= y
        moved = (y * e[:, t]) @ move.T
        if t == 0:
            break
        y = np.where(real[:, t, None], _scaled(moved), y)
    return _scaled(forward.reshape(-1, labels)[place])


def predict(texts: list[str | None], model: LanguageModel, words: WordTable) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the language's share of the letters' probability."""
    tokens = [letter_runs(t.lower()) if t else [] for t in texts]
    counts = np.array([len(t) for t in tokens], np.int64)
    flat = [w for t in tokens for w in t]
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if flat and model.languages:
        index = words.index(flat)
        p = marginals(words.values[index], counts, model.transitions, model.start)
        p = p * np.fromiter(map(len, flat), float, len(flat))[:, None]
        some = np.flatnonzero(counts)
        share = np.add.reduceat(p, (np.cumsum(counts) - counts)[some], axis=0)
        share /= share.sum(axis=1, keepdims=True)
        for i, row in zip(some, share, strict=True):
            names[i] = model.languages[int(row.argmax())]
            scores[i] = min(float(row.max()), 1.0)
    return names, scores


def _gradient(emit: np.ndarray, gold: np.ndarray, transitions: np.ndarray, start: np.ndarray):
    """Gradients of the mean negative log-likelihood of sequences of one length, by forward-backward."""
    n, length, labels = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    move = np.exp(transitions)
    forward, backward = np.empty_like(e), np.ones_like(e)
    forward[:, 0] = _scaled(np.exp(start) * e[:, 0])
    for t in range(1, length):
        forward[:, t] = _scaled((forward[:, t - 1] @ move) * e[:, t])
    for t in range(length - 2, -1, -1):
        backward[:, t] = _scaled((backward[:, t + 1] * e[:, t + 1]) @ move.T)
    post = forward * backward
    post /= post.sum(axis=2, keepdims=True)
    pair = forward[:, :-1, :, None] * move * (backward * e)[:, 1:, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    eye = np.eye(labels)
    seen = eye[gold]
    d_move = (pair.sum(axis=(0, 1)) - np.einsum("nti,ntj->ij", seen[:, :-1], seen[:, 1:])) / (n * length)
    return (post - seen) / (n * length), d_move, (post[:, 0] - seen[:, 0]).sum(axis=0) / (n * length)


def train(texts: list[str], langs: list[str], *, steps: int = 60, rate: float = 0.5, seed: int = 5) -> LanguageModel:
    """Fit the field; the languages are those of the sample's texts with letters."""
    tokens = [letter_runs(t.lower()) for t in texts]
    own = [(t, g) for t, g in zip(tokens, langs, strict=True) if t]
    languages = sorted({g for _, g in own})
    labels = len(languages)
    if not labels:
        return LanguageModel([], np.zeros((1 << BITS, 0)), {}, np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0))
    code = {g: i for i, g in enumerate(languages)}
    lexicon: dict[str, int] = {}
    for g in languages:
        counts = Counter(w for t, k in own if k == g for w in t)
        for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, len(lexicon))
    rng = np.random.default_rng(seed)
    by_language = [[t for t, k in own if k == g] for g in languages]

    def run(size: int) -> tuple[list[str], int]:
        g = int(rng.integers(labels))
        t = by_language[g][int(rng.integers(len(by_language[g])))]
        at = int(rng.integers(len(t)))
        return [t[(at + i) % len(t)] for i in range(size)], g

    vocabulary: dict[str, int] = {}
    word, gold = np.empty((SEQUENCES, LENGTH), np.int64), np.empty((SEQUENCES, LENGTH), np.int64)
    for s in range(SEQUENCES):
        cut = int(rng.integers(1, LENGTH)) if s % 2 else LENGTH
        at = 0
        for size in (cut, LENGTH - cut):
            if size:
                part, g = run(size)
                word[s, at : at + size] = [vocabulary.setdefault(w, len(vocabulary)) for w in part]
                gold[s, at : at + size] = g
                at += size
    names = list(vocabulary)
    ids, owner = ngram_ids(names, LO, HI, BITS)
    share = 1 / np.bincount(owner, minlength=len(names))
    row = np.array([lexicon.get(w, len(lexicon)) for w in names])
    params = {"table": np.zeros((1 << BITS, labels)), "lexicon": np.zeros((len(lexicon) + 1, labels)), "move": np.zeros((labels, labels)), "start": np.zeros(labels)}
    adam = Adam(params, rate)
    flat = word.reshape(-1)
    for _ in range(steps):
        emit = np.stack([np.bincount(owner, params["table"][ids, k], len(names)) * share for k in range(labels)], axis=1) + params["lexicon"][row]
        d, d_move, d_start = _gradient(emit[word], gold, params["move"], params["start"])
        by_word = np.stack([np.bincount(flat, d[:, :, k].reshape(-1), len(names)) for k in range(labels)], axis=1)
        grads = {"table": np.stack([np.bincount(ids, (by_word[:, k] * share)[owner], 1 << BITS) for k in range(labels)], axis=1),
                 "lexicon": np.stack([np.bincount(row, by_word[:, k], len(lexicon) + 1) for k in range(labels)], axis=1), "move": d_move, "start": d_start}
        adam.step({k: g + 1e-6 * params[k] for k, g in grads.items()})
    return LanguageModel(languages, params["table"], lexicon, params["lexicon"], params["move"], params["start"])


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
                  usable=lambda c: crc_mod(c, 4) != 2) -> LanguageModel:
    """Train on at most ``SAMPLE_TEXTS`` ids per language of the rows that ``usable`` admits.

    Of each text a piece of ``SAMPLE_CHARS`` characters is taken whose place the
    id's hash decides.  Rows with a null id, text or language are not used; of a
    repeated id with one language one text is.  The texts are collected.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__text"))
    rows = rows.filter("__id is not null and __lang is not null and __text is not null").filter(usable("__id"))
    order = F.xxhash64("__id", "__lang")
    picked = rows.select("__id", "__lang").distinct().withColumn("__part", F.pmod(order, F.lit(256)))
    for keys in (["__lang", "__part"], ["__lang"]):  # first within parts, as one language may have most of the rows
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "__id"))
        picked = picked.withColumn("__n", nth).filter(F.col("__n") <= SAMPLE_TEXTS).drop("__n")
    picked = picked.drop("__part")
    size = F.length("__text")
    piece = F.substr("__text", F.when(size > SAMPLE_CHARS, F.pmod(order, size - SAMPLE_CHARS + 1) + 1).otherwise(1).cast("int"), F.lit(SAMPLE_CHARS))
    rows = rows.withColumn("__text", piece).join(F.broadcast(picked), ["__id", "__lang"])
    sample = rows.groupBy("__id", "__lang").agg(F.min("__text").alias("__text")).orderBy("__id", "__lang").collect()
    return train([r["__text"] for r in sample], [r["__lang"] for r in sample])


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with ``out`` and ``score``, from the whole text alone.

    Null texts and texts without letters (Unicode category L) are ``und`` with
    score 0.  Ties go to the first language in order.  Every column passes
    through; the two names must not be among them (``ValueError``); repeated rows
    are each predicted; an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        words = WordTable(shipped.value.potentials)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            names, scores = [], []
            for texts in slices(batch.column("__text").to_pylist(), CALL_CHARS):
                found, share = predict(texts, shipped.value, words)
                names += found
                scores += share.tolist()
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
        return run

    return appended(docs, {"__text": F.col(text_col)}, make, f"`{out}` string, `{score}` double")


@query("op4_language")
def op4_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = fit_languages(docs)
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
