"""Frequency of every distinct term, kept up to date by signed deltas.

Terms here are the canonical k-mers of reads, counted per group (library) with that group's k.  A delta names
the records that were added (sign +1), deleted (-1) or changed (-1 with the old text, +1 with the new one); only
these are read and tokenised.  Their counts of occurrences and of records are merged into a table of counts
partitioned by term.

Stages of a delta:

1. equal reads of a group are combined to one read with a weight (map-side combine, so that a read with a third
   of all rows costs one row per task); what a change leaves as it was cancels to weight 0 and is dropped;
2. each task packs the windows of its reads into longs, sorts them and adds up equal ones, then sends each
   partition of the term space one block of sorted terms: a few rows of packed arrays instead of a row per
   window, which keeps the shuffle near 8 bytes a distinct term and task;
3. the blocks of a partition are merged with each other and with the stored counts of that partition.

The counts lie bucketed by partition, so a delta moves its own blocks and nothing of the store.  The number of partitions
follows the terms stored and the windows of the delta; when it has to grow, the store is divided anew in the same pass.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.packing import MAX_PACKED, buffers, packed_kmers, unpack
from ..functions.sequence import canonical, squeeze
from ..plans.workspace import Workspace

_BLOCK = "part int, grp int, terms binary, occ binary, rec binary"
_COUNTS = "part int, grp int, term long, n_occ long, n_rec long"


def _spread(x: np.ndarray) -> np.ndarray:
    """Mix the bits of packed terms, so that their top bits are spread evenly."""
    u = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        u = (u ^ (u >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        u = (u ^ (u >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return u ^ (u >> np.uint64(32))


def _add_up(terms: np.ndarray, occ: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums per distinct term, sorted by term."""
    order = np.argsort(terms, kind="stable")
    terms = terms[order]
    at = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
    if not len(at):
        return terms, occ, rec
    return terms[at], np.add.reduceat(occ[order], at), np.add.reduceat(rec[order], at)


def _tokenise(parts: int, ks: dict[int, int]):
    def blocks(batches):
        for b in batches:
            grp, weight = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            out = []
            for g in np.unique(grp):
                mine = np.flatnonzero(grp == g)
                offsets, raw = buffers(b.column(1).take(pa.array(mine)))
                term, row = packed_kmers(offsets, raw, ks[int(g)])
                if not len(term):
                    continue
                w = weight[mine][row]
                # a record counts once for a term: its first window with it, in (term, record) order
                order = np.lexsort((row, term))
                t, r = term[order], row[order]
                first = np.concatenate(([True], (t[1:] != t[:-1]) | (r[1:] != r[:-1])))
                t, occ, rec = _add_up(t, w[order], w[order] * first)
                part = (_spread(t) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                part, t, occ, rec = part[order], t[order], occ[order], rec[order]
                at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                for i, j in zip(at, [*at[1:], len(part)]):
                    out.append((int(part[i]), int(g), t[i:j].tobytes(), occ[i:j].tobytes(), rec[i:j].tobytes()))
            for i in range(0, len(out), 256):
                cols = list(zip(*out[i : i + 256]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])],
                    ["part", "grp", "terms", "occ", "rec"],
                )

    return blocks


def _counts_of(table: pa.Table) -> dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    found: dict[int, list] = {}
    for b in table.to_batches():
        g = b.column(b.schema.get_field_index("grp")).to_pylist()
        blobs = [b.column(b.schema.get_field_index(n)) for n in ("terms", "occ", "rec")]
        for i, x in enumerate(g):
            found.setdefault(x, []).append(tuple(np.frombuffer(c[i].as_buffer(), np.int64) for c in blobs))
    return found


def _result(part: int, groups: dict[int, list]) -> pa.Table:
    cols: list[list] = [[], [], [], []]
    for g, pieces in groups.items():
        t, occ, rec = _add_up(*(np.concatenate([p[i] for p in pieces]) for i in range(3)))
        keep = (occ != 0) | (rec != 0)
        for c, x in zip(cols, (np.full(int(keep.sum()), g, np.int32), t[keep], occ[keep], rec[keep])):
            c.append(x)
    join = lambda c, kind: np.concatenate(c) if c else np.zeros(0, kind)
    n = sum(len(x) for x in cols[0])
    return pa.table(
        {"part": np.full(n, part, np.int32), "grp": join(cols[0], np.int32), "term": join(cols[1], np.int64), "n_occ": join(cols[2], np.int64), "n_rec": join(cols[3], np.int64)}
    )


def _build(key, blocks):
    return _result(key[0].as_py(), _counts_of(blocks))


def _merge(key, stored, blocks):
    groups = _counts_of(blocks)
    if stored.num_rows:
        grp = stored["grp"].to_numpy()
        have = [stored[n].to_numpy() for n in ("term", "n_occ", "n_rec")]
        for g in np.unique(grp):
            m = grp == g
            groups.setdefault(int(g), []).append(tuple(x[m] for x in have))
    return _result(key[0].as_py(), groups)


def _divide(parts: int):
    """Stored counts with the partitions of another number of them."""

    def run(batches):
        for b in batches:
            part = (_spread(b.column(1).to_numpy(zero_copy_only=False)) % np.uint64(parts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), *(b.column(i) for i in range(4))], ["part", "grp", "term", "n_occ", "n_rec"])

    return run


class TermCounts:
    """Persistent counts of the k-mers of each group, updated by signed deltas.

    ``ks`` gives k per group number (k of at most 31). Null sequences, sequences shorter than k and windows with
    anything but bases have no terms. Case and white space are ignored. A term whose counts come to 0 leaves the
    table. Groups without k are ignored; an empty delta changes nothing.

    ``path``: folder to keep the counts in; counts that lie there are opened, with their own ``ks``. A delta is written as a
    new table, named in a note beside it, and only then is the old table removed, so a delta that fails leaves the counts as
    they were. A delta with a ``delta_id`` that was merged before is not merged again.
    """

    MOST_BUCKETS = 16_384

    def __init__(self, spark: SparkSession, ks: dict[int, int], terms_per_part: int = 4_000_000, path: str | None = None):
        if any(not 1 <= k <= MAX_PACKED for k in ks.values()):
            raise ValueError(f"k must be from 1 to {MAX_PACKED}")
        self.spark = spark
        self.ws = Workspace(spark, "terms", path)
        self.state = self.ws.noted() or {"ks": list(ks.items()), "terms_per_part": terms_per_part, "parts": 0, "buckets": 0, "rows": 0, "name": None, "taken": []}
        self.ks = {int(g): int(k) for g, k in self.state["ks"]}
        self._now: tuple[str, DataFrame] | None = None

    def _stored(self) -> DataFrame:
        name = self.state["name"]
        if self._now is None or self._now[0] != name:
            self._now = name, self.ws.read_bucketed(name, StructType.fromDDL(_COUNTS), self.state["buckets"], ["part"], sort=False)
        return self._now[1]

    def apply(self, delta: DataFrame, n_bases: int, delta_id: str | None = None) -> None:
        """Merge a delta with columns grp, seq, sign.  ``n_bases`` bounds its windows; with the terms stored it sizes the partitions."""
        if delta_id is not None and delta_id in self.state["taken"]:
            return
        parts, buckets = self.state["parts"], self.state["buckets"]
        needed = -(-(self.state["rows"] + int(n_bases)) // self.state["terms_per_part"])
        divided = needed > parts or not parts
        if divided:
            parts = max(needed, 2 * parts, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            buckets = min(parts, self.MOST_BUCKETS)
        reads = (
            delta.where(F.col("seq").isNotNull() & F.col("grp").isin(*self.ks))
            .groupBy(F.col("grp").cast("int").alias("grp"), canonical(squeeze("seq")).alias("seq"))
            .agg(F.sum("sign").alias("sign"))
            .where("sign != 0")
        )
        # one task a bucket, as the stored counts are
        blocks = reads.select("grp", "seq", "sign").mapInArrow(_tokenise(parts, self.ks), _BLOCK).repartition(buckets, "part")
        if self.state["name"] is None:
            merged = blocks.groupBy("part").applyInArrow(_build, _COUNTS)
        else:
            stored = self._stored()
            if divided:
                stored = stored.select("grp", "term", "n_occ", "n_rec").mapInArrow(_divide(parts), _COUNTS).repartition(buckets, "part")
            merged = stored.groupBy("part").cogroup(blocks.groupBy("part")).applyInArrow(_merge, _COUNTS)
        old, name = self.state["name"], f"counts-{uuid.uuid4().hex}"
        rows = self.ws.write_bucketed(merged, name, buckets, ["part"], sort=False).count()
        state = {**self.state, "parts": parts, "buckets": buckets, "rows": rows, "name": name}
        if delta_id is not None:
            state["taken"] = [*state["taken"], delta_id]
        self.ws.note(state)
        self.state = state
        if old is not None:
            self.ws.drop(old)

    def counts(self) -> DataFrame:
        """part, grp, term (packed), n_occ, n_rec."""
        if self.state["name"] is None:
            return self.spark.createDataFrame([], _COUNTS)
        return self._stored()


def spell(df: DataFrame, ks: dict[int, int], keep: str) -> DataFrame:
    """Replace ``grp`` and ``term`` by ``kmer``, the term as text; ``keep`` is the schema of the other columns in order."""
    names = [c.split()[0] for c in keep.split(", ")]

    def text(batches):
        for b in batches:
            grp, term = b.column(0).to_numpy(), b.column(1).to_numpy()
            for g in np.unique(grp):
                m = np.flatnonzero(grp == g)
                whole = len(m) == len(grp)
                others = [b.column(2 + i) if whole else b.column(2 + i).take(pa.array(m)) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*others, unpack(term if whole else term[m], ks[int(g)])], [*names, "kmer"])

    return df.select("grp", "term", *names).mapInArrow(text, f"{keep}, kmer string")
