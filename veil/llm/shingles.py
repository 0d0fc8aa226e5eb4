"""Words and word shingles of many texts at once, as 64-bit hashes (helper of operators 4 and 8)."""

from __future__ import annotations

import numpy as np

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit permutation that spreads close values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``hashes, begins, ends, offsets``: words (runs without blanks) of all texts.

    ``begins`` and ``ends`` are places in ``b"\\n".join(texts)``; text i has the words ``offsets[i]:offsets[i + 1]``.
    A word's hash depends on its bytes and length only.
    """
    joined = b"\n".join(texts)
    if fold:
        joined = joined.translate(_FOLD)
    data = np.frombuffer(joined + b"\n", dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[data]))))
    begins, ends = edge[0::2], edge[1::2]
    lengths = ends - begins
    # Eight bytes at a time, so that long words take few and short words one round.
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.lib.stride_tricks.sliding_window_view(padded, 8)
    hashes = lengths.astype(np.uint64) * _STEP
    keep = np.uint64(0xFFFFFFFFFFFFFFFF)
    rows, at = np.arange(len(begins)), 0
    while len(rows):
        left = lengths[rows] - at
        chunk = np.ascontiguousarray(lanes[begins[rows] + at]).view("<u8").ravel()
        short = left < 8
        if short.any():
            chunk[short] &= keep >> (np.uint64(64) - np.uint64(8) * left[short].astype(np.uint64))
        hashes[rows] = mix(hashes[rows] * _STEP ^ chunk)
        at += 8
        rows = rows[left > 8]
    starts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    offsets = np.concatenate(([0], np.searchsorted(begins, starts)))
    return hashes, begins, ends, offsets


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive hashes at every place (the last ``size - 1`` places are missing)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    for j in range(size):
        out = mix(out * _STEP ^ hashes[j:j + n])
    return out


def sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """``values, offsets``: each text's distinct shingles, sorted. A text of fewer words is one shingle; one without words has none."""
    hashes, _, _, offsets = words_of(texts, fold=True)
    counts = np.diff(offsets)
    grams = np.concatenate((windows(hashes, size), np.zeros(min(size - 1, len(hashes)), dtype=np.uint64)))
    each = np.maximum(counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), each)
    first = np.cumsum(each) - each
    place = np.arange(len(doc)) - first[doc] + offsets[:-1][doc]
    values = grams[place]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        values[first[i]] = windows(hashes[offsets[i]:offsets[i + 1]], int(counts[i]))[0]
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[new], doc[new]
    return values, np.searchsorted(doc, np.arange(len(texts) + 1))
