"""Character n-grams of words as hashed features, and small numpy training tools."""

from __future__ import annotations

import re

import numpy as np

#: Runs of letters, and of number signs that are no digits (superscripts, fractions), which ``letter_runs`` takes out.
LETTERS = re.compile(r"[^\W\d_]+")
#: Runs from a letter to the last letter or digit: digits and the marks that are put for letters belong to the word, marks between words don't.
MARKED = re.compile(r"""[^\W\d_](?:[^\s.,;:?/()\[\]{}"'<>|\u2010-\u2026-]*[^\W_])?""")


def letter_runs(text: str) -> list[str]:
    """Runs of letters (Unicode category L)."""
    found = LETTERS.findall(text)
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def marked_words(text: str) -> list[str]:
    """Words with their digits and marks, outer punctuation left off."""
    return MARKED.findall(text)


def ngram_ids(words: list[str], lo: int, hi: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word index) of the n-grams of ``<word>`` and of the whole word, for all words at once."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)

    def mixed(h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - bits)).astype(np.int64)

    step = np.uint64(0x100000001B3)
    ids, owner = [], []
    h = points
    for n in range(2, hi + 1):
        h = h[:-1] * step + points[n - 1 :]
        if n >= lo:
            inside = word[: len(h)] == word[n - 1 :]
            ids.append(mixed(h[inside], n))
            owner.append(word[: len(h)][inside])
        if len(h) < 2:
            break
    # a polynomial over the whole word, from differences of a running sum
    power = np.cumprod(np.full(int(sizes.max()), step, np.uint64))
    offset = np.arange(len(points)) - np.repeat(ends - sizes, sizes)
    ids.append(mixed(np.add.reduceat(points * power[offset], ends - sizes), 1))
    owner.append(np.arange(len(words)))
    return np.concatenate(ids), np.concatenate(owner)


class WordTable(dict):
    """Value vector (or number) of each word, computed for all unseen words of a batch at once."""

    def __init__(self, compute, limit: int = 1 << 18):
        super().__init__()
        self.compute, self.limit = compute, limit
        self.rows: list = []

    def index(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words in ``self.values``."""
        if len(self) > self.limit:
            self.clear()
            self.rows = []
        new = list(set(words).difference(self))
        if new:
            start = len(self)
            self.update(zip(new, range(start, start + len(new)), strict=True))
            self.rows.append(self.compute(new))
        if len(self.rows) > 1:
            self.rows = [np.concatenate(self.rows)]
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    @property
    def values(self) -> np.ndarray:
        return self.rows[0]


class Adam:
    """Adam over a dictionary of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.params[k] -= self.rate * m / (np.sqrt(v) + 1e-8)


def column_sums(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """For each index below ``size`` the sum of its rows of a matrix."""
    return np.stack([np.bincount(index, rows[:, d], size) for d in range(rows.shape[1])], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 200) -> tuple[float, float]:
    """Slope and intercept of a one-variable logistic regression.

    ``x`` is scaled first; with the small ridge, separable data is cut about
    midway between its closest points.
    """
    middle, scale = x.mean(), max(x.std(), 1e-9)
    u = (x - middle) / scale
    weight = 1 / len(x)
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * u + b)
        e, w = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(e * u).sum() + ridge * a, e.sum()])
        hess = np.array([[(w * u * u).sum() + ridge, (w * u).sum()], [(w * u).sum(), w.sum() + 1e-9]])
        move = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        a, b = a - move[0], b - move[1]
    return float(a / scale), float(b - a * middle / scale)
