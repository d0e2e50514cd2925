"""Word hashes and word n-grams of whole texts, straight from their bytes."""

from __future__ import annotations

import numpy as np

from pitchline.llm.byte_grams import END, padded
from pitchline.llm.common import mix

SPLIT = np.zeros(256, bool)
SPLIT[[0x20, *range(0x09, 0x0E), END]] = True
WEIGHT = mix(np.arange(1, 257, dtype=np.uint64))
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and each text's word count."""
    stream, lengths = padded(data, offsets, 0)
    solid = ~SPLIT[stream]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if len(solid) and solid[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]  # the last byte is an end mark, so every word ends
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(lengths), np.int64)
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    powers = np.multiply.accumulate(np.full(int(sizes.max()), BASE, np.uint64))
    value = WEIGHT[stream[solid]] * powers[place]
    hashes = mix(np.add.reduceat(value, first) + sizes.astype(np.uint64))
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, np.cumsum(lengths))]))
    return hashes, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word n-grams in order; a shorter text has one, of all its words; none without words."""
    n = len(words)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(made) - made), made) + np.arange(int(made.sum()))
    end = np.repeat(first + counts, made)
    key = np.zeros(len(at), np.uint64)
    for j in range(size):
        inside = at + j < end
        word = words[np.minimum(at + j, max(n - 1, 0))] if n else words
        key = np.where(inside, mix(key + word + np.uint64(j + 1)), key)
    return key, made


def row_minimum(values: np.ndarray, lengths: np.ndarray, empty: int = 0xFFFFFFFFFFFFFFFF) -> np.ndarray:
    """Least value of each row's stretch; ``empty`` for rows without values."""
    out = np.full(len(lengths), empty, np.uint64)
    full = lengths > 0
    if full.any():
        out[full] = np.minimum.reduceat(values, (np.cumsum(lengths) - lengths)[full])
    return out
