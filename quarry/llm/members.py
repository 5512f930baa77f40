"""Sets of 64-bit hashes of any size: which hashes occur often enough, and a bitmap of bounded size that tells tasks where they may be."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A hash's first bits name its bucket, so many bytes after them stand for it; hashes that a task holds before it writes them.
BUCKET_BITS, KEPT_BYTES, HELD = 10, 5, 1 << 20
#: Bits of the bitmap for each member, and the binary logarithm of the most it has (32 MB): beyond that more hashes are taken for members, and none is missed.
BITS_EACH, MOST_BITS = 32, 28
_KEPT = 8 * KEPT_BYTES


class Members:
    """A bitmap over the first `log` bits of hashes: has() is true for all members, and for few other hashes."""

    def __init__(self, bits: np.ndarray, log: int) -> None:
        self.bits, self.log = bits, log

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.log)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _unpacked(parts: list[pa.Buffer]) -> np.ndarray:
    x = np.concatenate([np.frombuffer(p, np.uint8) for p in parts]).reshape(-1, KEPT_BYTES)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :KEPT_BYTES] = x
    return out.view("<u8").reshape(-1)


def _packed(kept: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(kept.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES])


def packed(hashes: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(b, s): the hashes (unsigned), bucket by bucket; one that a task holds more than once goes twice."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        h = np.repeat(h, np.minimum(n, 2))
        edge = np.searchsorted(h >> np.uint64(64 - BUCKET_BITS), np.arange(1 << BUCKET_BITS, dtype=np.uint64))
        used = np.flatnonzero(np.diff(np.append(edge, len(h))))
        data = _packed((h >> np.uint64(64 - BUCKET_BITS - _KEPT)) & np.uint64((1 << _KEPT) - 1))
        ends = (np.append(edge[used], len(h)) * KEPT_BYTES).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.BinaryArray.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(ends), pa.py_buffer(data)])], ["b", "s"])

    held, n = [], 0
    for h in hashes:
        for a in range(0, len(h), HELD):
            held.append(h[a : a + HELD])
            n += len(held[-1])
            if n >= HELD:
                yield out(held)
                held, n = [], 0
    if n:
        yield out(held)


def members(rows: DataFrame, least: int) -> Members:
    """Those of the hashes that `packed` wrote into rows (b, s) that occur `least` (1 or 2) times or more.

    The hashes meet by buckets, five bytes each, a bucket at a time. What comes to the driver and goes to the tasks is the bitmap.
    """

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for b, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != now and held:
                    yield from found(now, held)
                    held = []
                now = b
                held.append(s.as_buffer())
        if held:
            yield from found(now, held)

    def found(b: int, held: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
        kept, n = np.unique(_unpacked(held), return_counts=True)
        kept = kept[n >= least]
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(kept)], pa.int64()), pa.array([_packed(kept).tobytes()], pa.binary())], ["b", "n", "s"])

    by_bucket = cut(rows.repartition("b").sortWithinPartitions("b").mapInArrow(often, "b int, n long, s binary"))
    n = by_bucket.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    log = min(MOST_BITS, max(BUCKET_BITS + 3, (BITS_EACH * n).bit_length()))
    size = log - BUCKET_BITS

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                on = np.zeros(1 << size, dtype=bool)
                on[_unpacked([s.as_buffer()]) >> np.uint64(_KEPT - size)] = True
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], ["b", "s"])

    bits, each = np.zeros(1 << (log - 3), np.uint8), 1 << (size - 3)
    for batch in by_bucket.select("b", "s").mapInArrow(drawn, "b int, s binary").toArrow().to_batches():
        for b, s in zip(batch.column(0).to_pylist(), batch.column(1)):
            bits[b * each : (b + 1) * each] = np.frombuffer(s.as_buffer(), np.uint8)
    return Members(bits, log)
