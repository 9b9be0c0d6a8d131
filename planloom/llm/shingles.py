"""Hashed word shingles of packs of texts."""

from __future__ import annotations

import zlib

import numpy as np

from .common import mix64

SIZE = 5
MOST_CACHED = 200_000


class Shingler:
    """64-bit hashes of the runs of SIZE words (split at space and \\t..\\r). A text with fewer words,
    but at least one, has a single shingle of all its words; one without words has none."""

    def __init__(self, short: bool = True):
        self.short = short
        self.known: dict[bytes, int] = {}

    def code(self, word: bytes) -> int:
        if len(self.known) > MOST_CACHED:
            self.known.clear()
        out = self.known[word] = zlib.crc32(word) | zlib.adler32(word) << 32
        return out

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of all texts in a row, and where each text's begin (one more entry at the end)."""
        get, code = self.known.get, self.code
        codes, sizes = [], []
        for t in texts:
            words = t.encode("utf-8", "surrogatepass").split()
            sizes.append(len(words))
            codes += [get(w) or code(w) for w in words]
        c = mix64(np.array(codes, np.uint64))
        n_words = np.array(sizes, np.int64)
        n = np.maximum(n_words - SIZE + 1, np.where(n_words > 0, 1, 0) if self.short else 0)
        begin = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(begin[-1]) + np.repeat(np.cumsum(n_words) - n_words - begin[:-1], n)
        left = np.repeat(np.cumsum(n_words), n) - at  # words from here to the text's end
        padded = np.concatenate([c, np.zeros(SIZE, np.uint64)])
        h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
        for k in range(SIZE):
            h = mix64(h * np.uint64(0x100000001B3) + np.where(left > k, padded[at + k], np.uint64(k + 1)))
        return h, begin
