"""Fast similarity sketching of sets of 64-bit hashes.

Round i < T throws every element into one of T bins with value i + fraction; round T + j throws
all elements into bin j. A bin keeps its least value, so rounds are needed only until every bin
is full, and after the last T rounds every bin is. Two sets agree in a bin with probability
equal to their Jaccard similarity, and the number of agreeing bins is concentrated as if the bins
were independent.
"""

from __future__ import annotations

import numpy as np

from corpuscle.llm.words import mix

T = 128
_SEEDS = mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ROUND = np.arange(2 * T, dtype=np.uint64) << np.uint64(56)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(elements: np.ndarray) -> np.ndarray:
    """T values of a set that has elements; they do not depend on order or repetition."""
    out = np.full(T, _EMPTY, np.uint64)
    n, i = len(elements), 0
    while i < T:
        most = max(1, min(T - i, 5 * T // n if not i else 2 * T // n + 1))
        h = mix(elements[None, :] ^ _SEEDS[i : i + most, None])
        np.minimum.at(out, (h & np.uint64(T - 1)).astype(np.int64).ravel(), ((h >> np.uint64(8)) | _ROUND[i : i + most, None]).ravel())
        i += most
        if out.max() != _EMPTY:
            return out
    for j in np.flatnonzero(out == _EMPTY):
        out[j] = (mix(elements ^ _SEEDS[T + j]) >> np.uint64(8)).min() | _ROUND[T + j]
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each run of `rows` coordinates, distinct between runs."""
    cut = values.reshape(-1, rows)
    out = np.arange(1, len(cut) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(rows):
        out = mix(out + cut[:, k])
    return out
