"""Vectorised k-mer windows over Arrow string buffers: two bits a base, 31 bases or fewer in a long.

This is the inside of the k-mer tokeniser.  A batch of reads is one byte array; all windows of the batch are
packed together by doubling (windows of 1, 2, 4, ... bases), so the work per base is a handful of numpy
instructions, against one substring call per window and row in the plain expression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MAX_PACKED = 31

_CODE = np.full(256, 4, np.uint8)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    for _b in _pair:
        _CODE[_b] = _i


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string array; nulls become empty strings."""
    if strings.null_count:
        strings = strings.fill_null("")
    if not pa.types.is_large_string(strings.type):
        strings = strings.cast(pa.large_string())
    _, off, data = strings.buffers()
    offsets = np.frombuffer(off, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0]
    return offsets - (offsets[0] if len(offsets) else 0), raw


def _windows(x: np.ndarray, k: int, combine) -> np.ndarray:
    """Values of all k-windows of x; combine(left, right, len_right) joins the values of two neighbouring windows."""
    done, size, acc, power, width = None, 0, None, x, 1
    rest = k
    n = len(x)
    while rest:
        if rest & 1:
            if acc is None:
                acc, size = power[: n - width + 1], width
            else:
                keep = n - (size + width) + 1
                acc = combine(acc[:keep], power[size : size + keep], width, size)
                size += width
        rest >>= 1
        if rest:
            keep = n - 2 * width + 1
            power = combine(power[: max(keep, 0)], power[width : width + max(keep, 0)], width, width)
            width *= 2
    return acc


def packed_windows(offsets: np.ndarray, raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed window, its packed reverse complement, row number, position in the row from 0) of each valid window.

    A window is valid if it lies in one row and holds only A, C, G, T (either case).  The packing keeps the
    order of the strings, so the lesser number is the lesser string.
    """
    if not 1 <= k <= MAX_PACKED:
        raise ValueError(f"k must be from 1 to {MAX_PACKED} for packed k-mers")
    n, none = len(raw), np.zeros(0, np.int64)
    if n < k:
        return none, none, none, none
    code = _CODE[raw]
    bad = np.zeros(n + 1, np.int64)
    np.cumsum(code == 4, out=bad[1:])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    last = n - k + 1
    start = np.flatnonzero((bad[k:] == bad[:last]) & (row[k - 1 :] == row[:last]))
    bits = (code & 3).astype(np.int64)
    forward = _windows(bits, k, lambda a, b, wide, _: (a << (2 * wide)) | b)[start]
    backward = _windows(3 - bits, k, lambda a, b, _, left: (b << (2 * left)) | a)[start]
    at = row[start]
    return forward, backward, at, start - offsets[at]


def packed_kmers(offsets: np.ndarray, raw: np.ndarray, k: int, both_strands: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(packed k-mer, row number) of each valid window; canonical if ``both_strands``."""
    forward, backward, row, _ = packed_windows(offsets, raw, k)
    return np.minimum(forward, backward) if both_strands else forward, row


def unpack(kmers: np.ndarray, k: int) -> pa.Array:
    """Strings of packed k-mers."""
    kmers = np.asarray(kmers, np.int64)
    out = np.empty((len(kmers), k), np.uint8)
    letters = np.frombuffer(b"ACGT", np.uint8)
    for j in range(k):
        out[:, j] = letters[(kmers >> (2 * (k - 1 - j))) & 3]
    offsets = np.arange(0, (len(kmers) + 1) * k, k, dtype=np.int32)
    return pa.StringArray.from_buffers(len(kmers), pa.py_buffer(offsets), pa.py_buffer(out.tobytes()))


_SWAPS = tuple((np.uint64(width), np.uint64(mask)) for width, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)))


def reverse_values(kmers: np.ndarray, k: int) -> np.ndarray:
    """Packed reverse complements: all bits turned, then neighbouring pairs, nibbles, bytes, ... swapped."""
    x = ~np.asarray(kmers, np.int64).view(np.uint64)
    for width, mask in _SWAPS:
        x = ((x & mask) << width) | ((x >> width) & mask)
    return (x >> np.uint64(64 - 2 * k)).view(np.int64)


def reverse_packed(column, k: int):
    """Column of packed reverse complements, by Arrow batches (as an expression it would double at every swap)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def reverse(x):
        return x.__class__(reverse_values(x.to_numpy(np.int64), k))

    return reverse(column)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scattering of longs, as unsigned."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def packed_runs(offsets: np.ndarray, raw: np.ndarray, k: int, m: int = 7) -> tuple[np.ndarray, ...]:
    """(minimizer, row number, position, windows, bases, bases) of runs of valid k-windows that follow one another in a row and share their minimizer.

    The minimizer is the least of the scattered canonical m-mers in a window, so a k-mer and its reverse complement have the same one,
    wherever they stand. A run has at most 31 windows; its first 31 bases are packed in one long and the next 31 in another, zeros after them.
    """
    m = min(m, k)
    n, none = len(raw), np.zeros(0, np.int64)
    _, _, row, pos = packed_windows(offsets, raw, k)
    if not len(row):
        return none.astype(np.int32), none, none.astype(np.int32), none.astype(np.int32), none, none
    bits = (_CODE[raw] & 3).astype(np.int64)
    forward = _windows(bits, m, lambda a, b, wide, _: (a << (2 * wide)) | b)
    backward = _windows(3 - bits, m, lambda a, b, _, left: (b << (2 * left)) | a)
    least = _windows(_mixed(np.minimum(forward, backward)), k - m + 1, lambda a, b, *_: np.minimum(a, b))
    at = offsets[row] + pos
    key = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    begin = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
    most = min(31, 2 * MAX_PACKED - k + 1)
    begin = np.flatnonzero(since % most == 0)
    size = np.diff(np.r_[begin, len(at)])
    words = _windows(np.r_[bits, np.zeros(2 * MAX_PACKED, np.int64)], MAX_PACKED, lambda a, b, wide, _: (a << (2 * wide)) | b)
    start, bases = at[begin], size + k - 1
    x, y = (words[start + i * MAX_PACKED] & -(np.int64(1) << (2 * np.clip((i + 1) * MAX_PACKED - bases, 0, MAX_PACKED))) for i in (0, 1))
    return (key[begin] >> np.uint64(49)).astype(np.int32), row[begin], pos[begin].astype(np.int32), size.astype(np.int32), x, y


def windows_of_runs(a: np.ndarray, b: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed k-mers of all runs of :func:`packed_runs`, one after the other; number in its run of each)."""
    j = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    a, b = np.repeat(a, size), np.repeat(b, size)
    over = np.maximum(j + k - MAX_PACKED, 0)  # bases from the second long
    high = (a >> (2 * np.maximum(MAX_PACKED - j - k, 0))) & ((np.int64(1) << (2 * (k - over))) - 1)
    low = np.where(over > 0, b >> (2 * (MAX_PACKED - over)), 0)
    return (high << (2 * over)) | low, j
