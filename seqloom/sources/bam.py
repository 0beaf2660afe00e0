"""Reader of BAM files: alignment records in binary, packed in blocks of gzip.

A file is one value of Spark's binary source, so it is read by one task and may have at most 2 GB; larger ones are given as
several files, as alignments of a library usually are. Fixed fields are taken from all records of a file at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The bases in the order of their 4-bit numbers.
_BASES = "=ACMGRSVTWYHKDBN"
_PAIRS = [a + b for a in _BASES for b in _BASES]
_SCHEMA = "file string, line_no long, name string, flag int, target string, pos int, mapq int, seq string"


def inflate(raw: bytes) -> bytes:
    """All gzip members of a file, one after the other."""
    out = []
    while raw:
        d = zlib.decompressobj(31)
        out.append(d.decompress(raw))
        if not d.eof:
            raise ValueError("the file ends inside a block")
        raw = d.unused_data
    return b"".join(out)


def _header(data: bytes) -> tuple[list[tuple[str, int]], int]:
    """([(name, length) of the targets], where the records begin)."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    n, at, targets = struct.unpack_from("<i", data, at)[0], at + 4, []
    for _ in range(n):
        size = struct.unpack_from("<i", data, at)[0]
        name = data[at + 4 : at + 3 + size].decode()
        targets.append((name, struct.unpack_from("<i", data, at + 4 + size)[0]))
        at += 8 + size
    return targets, at


def records(data: bytes) -> dict[str, list]:
    """Columns of the alignment records of inflated BAM data; names and bases as text, target -1 as null."""
    targets, at = _header(data)
    starts, end = [], len(data)
    while at + 4 <= end:
        starts.append(at + 4)
        at += 4 + struct.unpack_from("<i", data, at)[0]
    if at != end:
        raise ValueError("the file ends inside a record")
    start = np.array(starts, np.int64)
    fixed = np.frombuffer(data, np.uint8)[start[:, None] + np.arange(32)] if len(start) else np.zeros((0, 32), np.uint8)
    field = lambda i, kind: np.ascontiguousarray(fixed[:, i : i + np.dtype(kind).itemsize]).view(kind)[:, 0]
    ref, pos, cigar, flag, bases = field(0, "<i4"), field(4, "<i4"), field(12, "<u2"), field(14, "<u2"), field(16, "<i4")
    name_size, mapq = fixed[:, 8].astype(np.int64), fixed[:, 9]
    names, seqs = [], []
    for s, n, c, k in zip(starts, name_size.tolist(), cigar.tolist(), bases.tolist()):
        names.append(data[s + 32 : s + 31 + n].decode())
        q = s + 32 + n + 4 * c
        seqs.append("".join([_PAIRS[x] for x in data[q : q + (k + 1) // 2]])[:k] or "*")
    known = [t for t, _ in targets]
    return {"name": names, "flag": flag.astype(np.int32), "target": [known[r] if r >= 0 else None for r in ref.tolist()], "pos": pos, "mapq": mapq.astype(np.int32), "seq": seqs}


def _contents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def read_bam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, name, flag, target, pos, mapq, seq) of BAM files, as :func:`text.read_sam` gives them; pos from 0, a null target is unaligned."""

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                r = records(inflate(content.as_py()))
                n = len(r["name"])
                for i in range(0, n, 50_000):
                    part = {k: v[i : i + 50_000] for k, v in r.items()}
                    size = len(part["name"])
                    cols = [pa.array([file] * size, pa.string()), pa.array(np.arange(i, i + size)), *(pa.array(v) if isinstance(v, np.ndarray) else pa.array(v, pa.string()) for v in part.values())]
                    yield pa.RecordBatch.from_arrays(cols, ["file", "line_no", *part])

    return _contents(spark, paths).mapInArrow(run, _SCHEMA)


def bam_targets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, name, length) of the targets in the headers; files to be read together must agree in them."""

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                t, _ = _header(inflate(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(t), pa.string()), pa.array([x for x, _ in t], pa.string()), pa.array([x for _, x in t], pa.int32())], ["file", "name", "length"])

    return _contents(spark, paths).mapInArrow(run, "file string, name string, length int")
