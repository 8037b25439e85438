"""Training in the driver holds little beside the sample's words."""

import random
import tracemalloc

import numpy as np
import pytest

from lakeloom.llm import toxicity


def texts(n: int, words: int) -> tuple[list[str], np.ndarray]:
    rng = random.Random(5)
    own = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(3000)]
    bad = ["v1lest", "nasti", "d1rty"]
    out = [" ".join(rng.choice(bad) if i % 3 == 0 and rng.random() < 0.02 else rng.choice(own) for _ in range(words)) for i in range(n)]
    return out, np.array([float(i % 3 == 0) for i in range(n)])


def test_training_needs_few_bytes_a_word():
    sample, y = texts(300, 1500)
    tracemalloc.start()
    toxicity.embed(sample, y, np.random.default_rng(3), first=1, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * 300 * 1500


@pytest.mark.parametrize("part", [1, 97])
def test_parts_give_the_same_model(monkeypatch, part):
    sample, y = texts(40, 30)
    sample += ["", "one", "...", "v1lest nasti"]
    y = np.concatenate([y, [0, 1, 1, 1]])
    whole = toxicity.embed(sample, y, np.random.default_rng(3), first=2, steps=3)
    monkeypatch.setattr(toxicity, "TRAIN_PART", part)
    parts = toxicity.embed(sample, y, np.random.default_rng(3), first=2, steps=3)
    assert np.array_equal(whole.table, parts.table, equal_nan=True) and whole.bias == parts.bias


def test_texts_without_words():
    model = toxicity.embed(["", "...", "?"], np.array([0.0, 1.0, 0.0]), np.random.default_rng(3), first=1, steps=1)
    assert np.isnan(model.table).all()
