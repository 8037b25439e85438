"""Word shingles as 64-bit hashes and MinHash signatures over them.

Words are hashed once each (xxh3) and shingle hashes are combined from the word
hashes in numpy, so a text costs one dictionary lookup per word.  Two different
shingles of one pair of texts share a hash with probability about
``n * m / 2**64`` (under 1e-10 for texts of 40,000 words).
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Byte to byte: ASCII letters (lower-cased), digits and every byte of a non-ASCII character stay, others become spaces.
ALNUM = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


class WordHashes(dict):
    """Word (bytes) to 64-bit hash; forgets its words when it holds ``limit``."""

    def __init__(self, limit: int = 1 << 18):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def plain_words(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased: punctuation never hides a match."""
    return text.translate(ALNUM).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sequence(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Hashes of the k-word shingles in text order; fewer words make one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(k, n)
    out = h[: n - width + 1].copy()
    for j in range(1, width):
        out = _mix(out) + h[j : n - width + 1 + j]
    return _mix(out + np.uint64(width))


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of ``count`` multiply-shift hash functions."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    return a, b


def minhash(values: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1024) -> np.ndarray:
    """Signature of a non-empty set as uint32; memory is ``block * len(a)`` words."""
    best = None
    for at in range(0, len(values), block):
        part = values[at : at + block]
        low = (np.multiply.outer(a, part) + b[:, None]).min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return (best >> np.uint64(32)).astype(np.uint32)
