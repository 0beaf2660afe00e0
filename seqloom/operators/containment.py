"""Reads of one table against each other: equal ones once, both strands as one text, and where whole stretches of one stand in others.

A stretch of a read (its longest runs of valid windows) that has no frequent window matches itself in full, so of all its exact matches only
those of the whole stretch lie in no longer one. Such places are found without joining the seeds: the least scattered k-mer of the first
windows of the stretch is looked up among the k-mers that are the least of as many windows of a target, and the text is compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.packing import _CODE, _mixed, _windows, buffers, packed_windows

BITS = 1 << 24  # of the filters of k-mers: 2 MB each, whatever the data
_MMER = 13
_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def pack_texts(strings: pa.Array) -> pa.Array:
    """Texts as bytes: four bases a byte after the length modulo 4; texts with anything but A, C, G, T as they are after 255."""
    offsets, raw = buffers(strings)
    size = np.diff(offsets)
    code = np.full(256, 4, np.uint8)
    code[_LETTERS] = range(4)
    code = code[raw]
    bad = np.r_[0, np.cumsum(code == 4)]
    plain = bad[offsets[1:]] == bad[offsets[:-1]]
    quads = np.where(plain, -(-size // 4), 0)
    start = np.cumsum(quads) - quads
    row = np.repeat(np.arange(len(size)), size)
    own = plain[row]
    padded = np.zeros((int(quads.sum()), 4), np.uint8)
    padded.reshape(-1)[4 * start[row[own]] + (np.arange(len(raw)) - offsets[row])[own]] = code[own]
    packed = padded @ np.array([64, 16, 4, 1], np.uint8)
    length = 1 + np.where(plain, quads, size)
    out_at = np.r_[0, np.cumsum(length)]
    out = np.empty(int(out_at[-1]), np.uint8)
    out[out_at[:-1]] = np.where(plain, size % 4, 255)
    body = np.ones(len(out), bool)
    body[out_at[:-1]] = False
    of_plain = np.repeat(plain, length)
    out[body & of_plain] = packed
    out[body & ~of_plain] = raw[~own]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(out_at.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def unpack_texts(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the texts of :func:`pack_texts`."""
    offsets, raw = buffers(packed.cast(pa.large_binary()).view(pa.large_string()))
    head, body = raw[offsets[:-1]], np.diff(offsets) - 1
    plain = head != 255
    size = np.where(plain, 4 * body - (4 - head.astype(np.int64)) % 4, body)
    at = np.r_[0, np.cumsum(size)]
    row = np.repeat(np.arange(len(size)), size)
    pos = np.arange(int(at[-1])) - at[row]
    own = plain[row]
    value = raw[offsets[row] + 1 + np.where(own, pos >> 2, pos)]
    return at, np.where(own, _LETTERS[(value >> (2 * (3 - (pos & 3))).astype(np.uint8)) & 3], value)


def text_of(table: DataFrame, row_id: str, key: str = "key", seq: str = "seq") -> DataFrame:
    """(row_id, seq) of packed texts."""

    def run(batches):
        for b in batches:
            at, raw = unpack_texts(b.column(1))
            text = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw.astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([b.column(0), text.cast(pa.string())], [row_id, seq])

    return table.select(F.col(row_id).cast("long").alias(row_id), key).mapInArrow(run, f"`{row_id}` long, `{seq}` string")


def keyed_reads(reads: DataFrame) -> DataFrame:
    """(read_id, tid, as_is, key, n_as_is, n_turned) of reads (read_id, seq) with any base: tid is the least read_id of the same read key, as_is
    whether the text is the key itself. One row of each key has the packed key and how many reads have it as it is and turned.
    """

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pack_texts(b.column(2))], ["read_id", "as_is", "key"])

    s = reads.where("seq is not null").select(F.col("read_id").cast("long").alias("read_id"), S.squeeze("seq").alias("s")).where(F.col("s").rlike("[ACGT]"))
    s = s.withColumn("r", S.reverse_complement("s")).select("read_id", (F.col("s") <= F.col("r")).alias("as_is"), F.least("s", "r").alias("key"))
    s = s.mapInArrow(run, "read_id long, as_is boolean, key binary")
    whole, first = Window.partitionBy("key"), Window.partitionBy("key").orderBy("read_id")
    s = s.withColumn("tid", F.min("read_id").over(whole)).withColumn("n_as_is", F.count_if("as_is").over(whole)).withColumn("n_turned", F.count_if(~F.col("as_is")).over(whole))
    one = F.row_number().over(first) == 1
    s = s.withColumn("one", one)
    return s.select("read_id", "tid", "as_is", *(F.when(F.col("one"), F.col(c)).alias(c) for c in ("key", "n_as_is", "n_turned")))


def _bits(values: np.ndarray) -> np.ndarray:
    """Positions of k-mers in a filter."""
    return (_mixed(values) >> np.uint64(40)).astype(np.int64)


def _in(bitmap: bytes, values: np.ndarray) -> np.ndarray:
    at = _bits(values)
    return (np.frombuffer(bitmap, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def filter_of(kmers: DataFrame, kmer: str) -> bytes:
    """A filter that passes at least the given k-mers; fixed in size."""

    def run(batches):
        own = np.zeros(BITS, bool)
        for b in batches:
            own[_bits(b.column(0).to_numpy())] = True
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32))], ["at"])

    out = np.zeros(BITS, bool)
    words = kmers.select(F.col(kmer).cast("long").alias("k")).mapInArrow(run, "at int")
    words = words.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at & 31)")).alias("bits"))
    for r in words.toLocalIterator():  # at most 2^19 rows
        v = np.uint32(r.bits & 0xFFFFFFFF)
        out[32 * r.word : 32 * r.word + 32] = (v >> np.arange(32, dtype=np.uint32)) & 1
    return np.packbits(out, bitorder="little").tobytes()


def _scattered(kmers: np.ndarray, level: int) -> np.ndarray:
    return _mixed(kmers * 4 + level)


LEVELS = (64, 16, 1)


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first window, windows) of stretches of windows that follow one another."""
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1]) if len(at) else np.zeros(0, np.int64)
    return begin, np.diff(np.r_[begin, len(at)])


def _probes(kmers: np.ndarray, at: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first window, windows) of the stretches of a level: the window of least value of the first LEVELS[level]."""
    begin, size = _stretches(at)
    wide = LEVELS[level]
    own = (size >= wide) & (size < (LEVELS[level - 1] if level else np.inf))
    begin, size = begin[own], size[own]
    v = _scattered(kmers, level)
    least = v[begin[:, None] + np.arange(wide)].argmin(axis=1) if len(begin) else begin
    return begin + least, begin, size


def _selected(kmers: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
    """Which windows are the least of LEVELS[level] that follow one another, ties all of them."""
    wide, v = LEVELS[level], _scattered(kmers, level)
    if wide == 1:
        return np.ones(len(v), bool)
    if len(v) < wide:
        return np.zeros(len(v), bool)
    least = np.where(at[wide - 1 :] - at[: len(at) - wide + 1] == wide - 1, _windows(v, wide, lambda a, b, *_: np.minimum(a, b)), np.uint64(0))
    pad = np.zeros(wide - 1, np.uint64)
    most = _windows(np.r_[pad, least, pad], wide, lambda a, b, *_: np.maximum(a, b))
    return (most == v) & (most > 0)


def _minimizers(raw: np.ndarray, offsets: np.ndarray, row: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scattered least m-mer, 32 bits, of each window; whether the window is the first that has it at this place)."""
    m = min(_MMER, k)
    bits = (_CODE[raw] & 3).astype(np.int64)
    join = lambda a, b, wide, _: (a << (2 * wide)) | b
    turn = lambda a, b, _, left: (b << (2 * left)) | a
    v = _mixed(np.minimum(_windows(bits, m, join), _windows(3 - bits, m, turn))) >> np.uint64(32) << np.uint64(32)
    v |= np.arange(len(v), dtype=np.uint64)
    least = _windows(v, k - m + 1, lambda a, b, *_: np.minimum(a, b))[offsets[row] + pos]
    return (least >> np.uint64(32)).astype(np.int64), np.r_[True, least[1:] != least[:-1]]


def survey(keys: DataFrame, k: int, most: int, parts: int) -> tuple[bytes | None, bytes]:
    """(filter of m-mers, None if there are none; filter of the k-mers by which short stretches are looked up).

    A window that stands more than ``most`` times in the targets has a least m-mer that is chosen at more than ``most`` places; those are the
    m-mers of the first filter. What is shuffled are sorted values of 32 bits, packed as differences.
    """

    def choose(batches):
        held, n, low = [], 0, []

        def flush():
            x, c = np.unique(np.concatenate(held), return_counts=True)
            edge = np.searchsorted(x, (np.arange(parts + 1) << 32) // parts)
            for p in np.flatnonzero(np.diff(edge)):
                j = slice(edge[p], edge[p + 1])
                gap = np.diff(x[j], prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
                yield int(p), np.concatenate([*gap, np.minimum(c[j], 255).astype(np.uint8)]).tobytes()

        for b in batches:
            offsets, raw = unpack_texts(b.column(0))
            fwd, rev, row, pos = packed_windows(offsets, raw, k)
            if not len(fwd):
                continue
            value, new = _minimizers(raw, offsets, row, pos, k)
            held.append(value[new])
            n += len(held[-1])
            kmers, at = np.minimum(fwd, rev), offsets[row] + pos
            low += [kmers[_probes(kmers, at, i)[0]] for i in range(1, len(LEVELS))]
            if n > 4_000_000:
                yield rows(flush())
                held, n = [], 0
        if held:
            yield rows(flush())
        if low:
            yield rows([(-1, np.unique(_bits(np.concatenate(low))).astype("<u4").tobytes())])

    def rows(pairs):
        pairs = list(pairs)
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int32()), pa.array([x for _, x in pairs], pa.binary())], ["part", "packed"])

    def add_up(t):
        blobs = t.column(1).to_pylist()
        if t.column(0)[0].as_py() < 0:
            found = np.zeros(BITS, bool)
            for x in blobs:
                found[np.frombuffer(x, "<u4")] = True
            out = np.packbits(found, bitorder="little").tobytes()
        else:
            xs, cs = [], []
            for x in blobs:
                planes = np.frombuffer(x, np.uint8).reshape(5, -1)
                xs.append(np.cumsum(planes[:4].T.copy().view("<u4").reshape(-1).astype(np.int64)))
                cs.append(planes[4])
            x, at = np.unique(np.concatenate(xs), return_inverse=True)
            out = x[np.bincount(at, np.concatenate(cs), len(x)) > most].astype("<i8").tobytes()
        return pa.table({"part": t.column(0).slice(0, 1), "packed": pa.array([out], pa.binary())})

    found = keys.select("key").mapInArrow(choose, "part int, packed binary").groupBy("part").applyInArrow(add_up, "part int, packed binary")
    heavy, short = np.zeros(BITS, bool), bytes(BITS // 8)
    for r in found.toLocalIterator():
        if r.part < 0:
            short = bytes(r.packed)
        else:
            heavy[_bits(np.frombuffer(r.packed, "<i8"))] = True
    return np.packbits(heavy, bitorder="little").tobytes() if heavy.any() else None, short


def frequent(keys: DataFrame, k: int, most: int, mmers: bytes) -> DataFrame:
    """(fwd, n_occ): windows that stand more than ``most`` times in the targets, counted among those with an m-mer of the filter."""

    def run(batches):
        for b in batches:
            offsets, raw = unpack_texts(b.column(0))
            fwd, _, row, pos = packed_windows(offsets, raw, k)
            if len(fwd):
                x, n = np.unique(fwd[_in(mmers, _minimizers(raw, offsets, row, pos, k)[0])], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n)], ["fwd", "n"])

    return keys.select("key").mapInArrow(run, "fwd long, n long").groupBy("fwd").agg(F.sum("n").alias("n_occ")).where(F.col("n_occ") > most)


def windows_among(texts: DataFrame, row_id: str, k: int, among: bytes) -> DataFrame:
    """(row_id, pos, fwd, rev): windows of packed texts whose canonical k-mer passes the filter."""

    def run(batches):
        for b in batches:
            fwd, rev, row, pos = packed_windows(*unpack_texts(b.column(1)), k)
            j = np.flatnonzero(_in(among, np.minimum(fwd, rev)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[j])), pa.array(pos[j].astype(np.int32)), pa.array(fwd[j]), pa.array(rev[j])], [row_id, "pos", "fwd", "rev"])

    return texts.select(row_id, "key").mapInArrow(run, f"`{row_id}` long, pos int, fwd long, rev long")


def contained(keys: DataFrame, k: int, short: bytes, avoid: bytes | None, parts: int) -> DataFrame:
    """(read_id, tid, fwd, rpos, tpos, qpos, len, n): every place where a stretch of a text (tid, key) stands in one of them, on either strand; n is the
    length of the text. Texts with a window that passes ``avoid`` are targets only; ``short``: see :func:`survey`."""
    names = ["kmer", "tid", "pos", "start", "len", "key"]

    def cut(batches):
        for b in batches:
            offsets, raw = unpack_texts(b.column(1))
            fwd, rev, row, pos = packed_windows(offsets, raw, k)
            if not len(fwd):
                continue
            kmers, at = np.minimum(fwd, rev), offsets[row] + pos
            odd = _in(avoid, kmers) if avoid else np.zeros(len(kmers), bool)
            whole = np.bincount(row, odd, len(offsets)) == 0
            for i in range(len(LEVELS)):
                chosen = _selected(kmers, at, i) & ~odd
                if i:
                    chosen &= _in(short, kmers)
                start, size = np.zeros(len(kmers), np.int32), np.zeros(len(kmers), np.int32)
                place, first, many = _probes(kmers, at, i)
                place, first, many = (x[whole[row[place]]] for x in (place, first, many))
                start[place], size[place] = pos[first], many + (k - 1)
                j = np.flatnonzero(chosen)
                of = pa.array(row[j])
                cols = [pa.array(_scattered(kmers[j], i).view(np.int64)), b.column(0).take(of), pa.array(pos[j].astype(np.int32)), pa.array(start[j]), pa.array(size[j]), b.column(1).take(of)]
                yield pa.RecordBatch.from_arrays(cols, names)

    def match(batches):
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        if not t.num_rows:
            return
        kmer, tid, pos, start, size = (t.column(i).to_numpy() for i in range(5))
        offsets, raw = unpack_texts(t.column(5).chunk(0))
        code, n = _CODE[raw], np.diff(offsets)
        order = np.argsort(kmer, kind="stable")
        probe, ordered = np.flatnonzero(size > 0), kmer[order]
        lo, hi = np.searchsorted(ordered, kmer[probe]), np.searchsorted(ordered, kmer[probe], "right")
        for i in range(0, len(probe), 20_000):
            a, b = lo[i : i + 20_000], hi[i : i + 20_000]
            p = np.repeat(probe[i : i + 20_000], b - a)
            q = order[np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(len(p))]
            for fwd in (True, False):
                before = pos[p] - start[p]
                at = pos[q] - (before if fwd else size[p] - k - before)
                ok = np.flatnonzero((at >= 0) & (at + size[p] <= n[q]))
                for c in range(0, len(ok), 50_000):
                    yield from compared(p[ok[c : c + 50_000]], q[ok[c : c + 50_000]], at[ok[c : c + 50_000]], fwd, code, offsets, n, tid, start, size)

    def compared(p, q, at, fwd, code, offsets, n, tid, start, size):
        if not len(p):
            return
        length = size[p].astype(np.int64)
        begin = np.cumsum(length) - length
        j = np.arange(int(length.sum())) - np.repeat(begin, length)
        left = code[np.repeat(offsets[p] + start[p] + (0 if fwd else length - 1), length) + (j if fwd else -j)]
        right = code[np.repeat(offsets[q] + at, length) + j]
        same = np.logical_and.reduceat(left == (right if fwd else 3 - right), begin)
        p, q, at, length = p[same], q[same], at[same], length[same]
        qpos = start[p]
        rpos = qpos if fwd else n[p] - qpos - length
        as_int = lambda x: pa.array(np.asarray(x).astype(np.int32))
        cols = [pa.array(tid[p]), pa.array(tid[q]), pa.array(np.full(len(p), fwd)), as_int(rpos), as_int(at), as_int(qpos), as_int(length), as_int(n[p])]
        yield pa.RecordBatch.from_arrays(cols, ["read_id", "tid", "fwd", "rpos", "tpos", "qpos", "len", "n"])

    rows = keys.select("tid", "key").mapInArrow(cut, "kmer long, tid long, pos int, start int, len int, key binary")
    return rows.repartition(parts, "kmer").mapInArrow(match, "read_id long, tid long, fwd boolean, rpos int, tpos int, qpos int, len int, n int")
