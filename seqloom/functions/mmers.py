"""Short words of m bases as numbers: normalisation, and phred probabilities."""

from __future__ import annotations

import functools
import re

import numpy as np


def reverse_value(v: np.ndarray, m: int) -> np.ndarray:
    """Value (first base highest) of the reverse complement."""
    out = np.zeros_like(v)
    for j in range(m):
        out = (out << 2) | (3 - ((v >> (2 * j)) & 3))
    return out


def little_endian(v: np.ndarray, m: int) -> np.ndarray:
    """The value with the first base in the lowest bits, from the one with it in the highest; its own inverse."""
    out = np.zeros_like(v)
    for j in range(m):
        out = (out << 2) | ((v >> (2 * j)) & 3)
    return out


#: Words that make poor signatures: ends in TTT, TGT or TT*, AA anywhere but at the first two bases, begins with ACA.
NOT_ALLOWED = "(TTT|TGT|TT.)$|.AA|^ACA"


@functools.cache
def normalised(m: int) -> np.ndarray:
    """Per value the lesser of the word and its reverse complement among the allowed ones; 4^m if neither is."""
    values = np.arange(4**m)
    words = ["".join("ACGT"[(v >> (2 * (m - 1 - j))) & 3] for j in range(m)) for v in values]
    bad = np.array([bool(re.search(NOT_ALLOWED, w)) for w in words])
    own = np.where(bad, 4**m, values)
    return np.minimum(own, own[reverse_value(values, m)])


def probability_right(quality: np.ndarray) -> np.ndarray:
    """Probability that a base with a phred quality is right; a quality of 0 or 1 says nothing: a quarter."""
    q = np.clip(np.asarray(quality, np.float64), 0, 63)
    return np.where(q <= 1, 0.25, 1.0 - np.power(10.0, -q / 10.0))
