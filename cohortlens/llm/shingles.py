"""Sets of hashed word shingles, and their sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cohortlens.llm.arrow import mixed, powers, space_words, string_hashes

#: Words of a shingle.
WORDS = 5
_BASE = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's 5-word shingles.

    A text of fewer words gives its whole sequence as one shingle, one without words none.
    """
    codes, starts, words = space_words(texts)
    hashes = string_hashes(words)[codes]
    step = powers(_BASE, WORDS)
    runs = np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        runs += hashes[k : k + len(runs)] * step[k]
    runs = mixed(runs)
    out = []
    for start, end in zip(starts.tolist(), starts[1:].tolist(), strict=False):
        n = end - start
        if n >= WORDS:
            out.append(np.unique(runs[start : end - WORDS + 1]))
        elif n:
            short = (hashes[start:end] * step[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mixed(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fast_sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Fast similarity sketches, a row of ``size`` coordinates for each set.

    In round i an element goes to the bin its i-th hash names, in the later ``size`` rounds
    to bin i. A bin holds its smallest value of the earliest round that reached it; rounds
    end when a set's bins are all filled, which needs at most twice ``size`` of them. Two
    sets agree in a coordinate with the probability of their similarity. An empty set's
    coordinates stay at the largest value.
    """
    lens = np.array([len(s) for s in sets], np.int64)
    out = np.full(len(sets) * size, np.iinfo(np.uint64).max, np.uint64)
    values = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), lens)
    seeds = np.arange(1, 2 * size + 1, dtype=np.uint64) * _BASE
    for i in range(2 * size):
        if not len(values):
            break
        hashed = mixed(values + seeds[i])
        bins = (hashed >> np.uint64(33)) % np.uint64(size) if i < size else np.uint64(i - size)
        placed = (np.uint64(i) << np.uint64(55)) | (mixed(hashed) >> np.uint64(9))
        np.minimum.at(out, owner * size + bins.astype(np.int64), placed)
        empty = (out.reshape(-1, size) == np.iinfo(np.uint64).max).any(1)
        still = empty[owner]
        values, owner = values[still], owner[still]
    return out.reshape(-1, size)


def band_hashes(sketches: np.ndarray, bands: int) -> np.ndarray:
    """A hash for each run of coordinates; equal runs of different bands differ."""
    rows = sketches.shape[1] // bands
    parts = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    mix = (mixed(parts) * powers(_BASE, rows)).sum(2, dtype=np.uint64)
    return mixed(mix + np.arange(1, bands + 1, dtype=np.uint64))


def set_key(values: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    if not len(values):
        return b""
    one, two = mixed(values).sum(dtype=np.uint64), mixed(values ^ _BASE).sum(dtype=np.uint64)
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")
