"""Packing in space-filling-curve order: neighbours on a Hilbert curve share sequences.

A document's vector counts its token ids; a hashed projection of signs (each id has a fixed point of -1 and 1 in a few dimensions) takes it, divided by its size, to the mean of
its ids' points, and a grid and the Hilbert curve take that to one key. Documents are range-sorted by the key and laid end to end; every CONTEXT tokens a sequence ends, so no sequence but the last is short, and the last is cut
at powers of two. Tokens are stored once and travel once, as 16-bit ids: bounds of the range sort and the tokens before each of its parts are
taken from the keys and sizes alone.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import blobs, shared_dir, small_batches, text_chunks
from .hilbert import hilbert_key

#: Tokens of a sequence; what ends a document; the tokenizer's file.
CONTEXT, END_ID, TOKENIZER = 4096, 2, "word_bpe_49k.json"
DIMENSIONS, GRID_BITS = 3, 11
#: Places on the curve and scrambled order within a place, in one number that a double holds exactly.
SCRAMBLE_BITS = 20
#: Bytes of tokens that a sorted partition holds, about, and partitions at most; of larger tables a partition holds more, and its sort spills.
PART_BYTES, MAX_PARTS = 32_000_000, 8192
#: Units (see `units`) whose ids a worker keeps; beyond that it forgets those that it met once.
_KEEP_UNITS = 400_000
#: Byte kinds: 0 letter of ASCII or of two-byte Latin, 1 ASCII sign other than the apostrophe, 2 anything else.
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = 0
_KIND[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and chr(x) != "'"]] = 1


def units(w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, word) of the units that the words are encoded by.

    The tokenizer's pieces never cross white space, and a piece of letters never reaches into signs: a word of Latin letters and then signs (no apostrophe) is
    two units. Every other word is one.
    """
    kind = _KIND[w.buf]
    # The signs of multiplication and division are the two of their range that aren't letters.
    cross = np.flatnonzero((w.buf[:-1] == 0xC3) & ((w.buf[1:] == 0x97) | (w.buf[1:] == 0xB7)))
    kind[cross] = 2
    sign, other = np.concatenate([[0], np.cumsum(kind == 1)]), np.concatenate([[0], np.cumsum(kind == 2)])
    back = np.concatenate([[0], np.cumsum((kind[:-1] == 1) & (kind[1:] == 0)), [0]])
    signs = sign[w.ends] - sign[w.starts]
    pure = (other[w.ends] == other[w.starts]) & (back[w.ends - 1] == back[w.starts]) & (kind[w.starts] == 0) & (signs > 0)
    first = np.where(pure, w.ends - signs, w.ends)
    extra = np.flatnonzero(pure)
    word = np.concatenate([np.arange(len(w.starts)), extra])
    start, end = np.concatenate([w.starts, first[extra]]), np.concatenate([first, w.ends[extra]])
    order = np.argsort(word, kind="stable")
    return start[order], end[order], word[order]


class UnitIds:
    """Token ids of units, each encoded once by a worker."""

    def __init__(self, path: str):
        # One thread: the cores belong to the tasks, and each thread would hold memory of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.clear()

    def clear(self, room: int = 0) -> None:
        """Forget all units; there is room for _KEEP_UNITS, or for `room` of one very long text."""
        none = np.zeros(0, np.uint64)
        self.room = max(_KEEP_UNITS, room)
        self.table = words.Table(none, none.astype(np.int32), room=self.room)
        self.hashes, self.hits = np.zeros(self.room, np.uint64), np.zeros(self.room, np.int32)
        self.size, self.start, self.count = 0, np.zeros(self.room, np.int32), np.zeros(self.room, np.int32)
        self.arena, self.used = np.zeros(1 << 14, np.uint16), 0

    def _thin(self) -> None:
        """Forget all units but those met most often, a third of _KEEP_UNITS at most."""
        n, hashes, hits, start, count, arena = self.size, self.hashes, self.hits, self.start, self.count, self.arena
        room = _KEEP_UNITS // 3
        least = max(2, int(np.partition(hits[:n], n - room)[n - room]) + 1) if n > room else 2
        kept = np.flatnonzero(hits[:n] >= least)
        self.clear()
        at = np.arange(len(kept))
        self.table.put(hashes[kept], at.astype(np.int32))
        sizes = count[kept].astype(np.int64)
        ahead = np.cumsum(sizes) - sizes
        self.arena = np.zeros(max(1 << 14, int(sizes.sum())), np.uint16)
        self.used, self.size = int(sizes.sum()), len(kept)
        self.arena[: self.used] = arena[np.repeat(start[kept].astype(np.int64) - ahead, sizes) + np.arange(self.used)]
        # Halved, so that what was frequent once doesn't stay for ever.
        self.hashes[at], self.hits[at], self.start[at], self.count[at] = hashes[kept], hits[kept] // 2, ahead, sizes

    def _add(self, hashes: np.ndarray, found: list[bytes]) -> np.ndarray:
        ids: list = [None] * len(found)
        whole = []
        for k, x in enumerate(found):
            # Lower-cased letters of ASCII are one piece as they stand; the merges alone give their ids.
            if x.isalpha() and x.isascii():
                ids[k] = [t.id for t in self.merges.tokenize(x.lower().decode())]
            else:
                whole.append(k)
        for a in range(0, len(whole), 20_000):
            part = whole[a : a + 20_000]
            for k, e in zip(part, self.tokenizer.encode_batch([found[k].decode("utf-8", "replace") for k in part], add_special_tokens=False)):
                ids[k] = e.ids
        flat, sizes = np.array([x for t in ids for x in t], dtype=np.uint16), np.array([len(t) for t in ids], dtype=np.int64)
        while self.used + len(flat) > len(self.arena):
            self.arena = np.concatenate([self.arena, self.arena])
        at = np.arange(self.size, self.size + len(ids))
        self.arena[self.used : self.used + len(flat)] = flat
        self.count[at], self.start[at], self.hashes[at] = sizes, self.used + np.cumsum(sizes) - sizes, hashes
        self.table.put(hashes, at.astype(np.int32))
        self.used += len(flat)
        self.size += len(ids)
        return at

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end after it; number of each text's)."""
        w = words.split(texts, lower=False)
        start, end, word = units(w)
        h = words.xxh64(w.buf, start, end - start)
        row = self.table.get(h, -1).astype(np.int64)
        new = np.flatnonzero(row < 0)
        if len(new):
            u, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            if self.size + len(u) > self.room:
                if len(u) > _KEEP_UNITS // 2 and len(texts) > 1:
                    (a, n), (b, m) = self.encode(texts[: len(texts) // 2]), self.encode(texts[len(texts) // 2 :])
                    return np.concatenate([a, b]), np.concatenate([n, m])
                self._thin() if len(u) <= _KEEP_UNITS // 2 else self.clear(len(np.unique(h)))
                row = self.table.get(h, -1).astype(np.int64)
                new = np.flatnonzero(row < 0)
                u, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            row[new] = self._add(u, [w.buf[start[i] : end[i]].tobytes() for i in new[first]])[inverse]
        self.hits[: self.size] += np.bincount(row, minlength=self.size).astype(np.int32)
        count, doc = self.count[row].astype(np.int64), w.doc[word]
        total = np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64) + 1
        out = np.empty(int(total.sum()), dtype=np.uint16)
        out[np.cumsum(total) - 1] = END_ID
        # Each unit's ids go where those before it and the ends before its text leave off.
        ahead = np.cumsum(count) - count
        step = np.arange(int(count.sum())) - np.repeat(ahead, count)
        out[np.repeat(ahead + doc, count) + step] = self.arena[np.repeat(self.start[row].astype(np.int64), count) + step]
        return out, total


_worker: dict[str, UnitIds] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _projection(vocabulary: int) -> np.ndarray:
    """Each id's hashed point: DIMENSIONS values of -1 or 1."""
    with np.errstate(over="ignore"):
        h = words.mix(np.arange(1, vocabulary + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([((h >> np.uint64(7 * k)) & np.uint64(1)).astype(np.float32) * 2 - 1 for k in range(DIMENSIONS)], axis=1)


def curve_keys(ids: np.ndarray, total: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The Hilbert key of each text from its ids; a grid cell spans a fixed part of the mean's range, so equal texts have equal keys."""
    doc = np.repeat(np.arange(len(total)), total)
    mean = np.stack([np.bincount(doc, weights=projection[ids, k], minlength=len(total)) for k in range(DIMENSIONS)], axis=1) / total[:, None]
    cell = np.clip(((mean + 1) / 2 * (1 << GRID_BITS)).astype(np.int64), 0, (1 << GRID_BITS) - 1)
    return hilbert_key(cell, GRID_BITS)


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, place, n, mark, ids): where the text is on the curve, the number of its tokens, their CRC-32, and the tokens (16 bits each, little-endian), the end included.

    place is the curve key followed by a scramble of doc_id and tokens, so that texts of equal keys, which may be a third of all, can be told apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or tokenizer_path(TOKENIZER)
        own = _worker.get(file) or _worker.setdefault(file, UnitIds(file))
        projection = _projection(1 << 16)
        for batch in text_chunks(batches):
            ids, total = own.encode(blobs(batch))
            key = curve_keys(ids, total, projection)
            offsets = np.concatenate([[0], np.cumsum(total) * 2]).astype(np.int32)
            ids = ids.astype("<u2")
            mark = pa.array([zlib.crc32(ids[a // 2 : b // 2]) for a, b in zip(offsets, offsets[1:])], pa.int64())
            data = pa.Array.from_buffers(pa.binary(), len(total), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), pa.array(total), mark, data], ["doc_id", "key", "n", "mark", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key long, n long, mark long, ids binary")
    place = F.col("key") * (1 << SCRAMBLE_BITS) + F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << SCRAMBLE_BITS))
    return rows.select("doc_id", place.alias("place"), "n", "mark", "ids")


def _stored(tokens: DataFrame) -> DataFrame:
    """tokens written once, compressed, in the shared folder, and read from there."""
    folder = f"{shared_dir(tokens.sparkSession)}/tokens-{uuid.uuid4().hex}"
    tokens.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(folder)
    return tokens.sparkSession.read.schema(tokens.schema).parquet(folder)


def _last_cuts(tokens: int, context: int) -> list[tuple[int, int]]:
    """(start, size) of the short sequences that hold what is left after the full ones: powers of two, the largest first."""
    at, out = tokens // context * context, []
    while at < tokens:
        size = 1 << ((tokens - at).bit_length() - 1)
        out.append((at, size))
        at += size
    return out


def pack(docs: DataFrame, context: int = CONTEXT, path: str | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents, ids being the piece's tokens (16 bits each).

    digest: in place of ids comes ids_crc32, the CRC-32 of the piece's ids as 32-bit integers.

    Null and empty texts are an end alone. Documents of equal keys go by a scramble of their ids, then by id and CRC-32; repeated rows are packed as often as they occur. A text
    however long is cut where sequences end. Further columns are ignored; an empty table gives an empty result.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    tokens = _stored(tokenised(docs, path))
    total, rows = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The curve is cut at quantiles of place into parts; what lies before each part is known before any token moves.
    parts = int(max(1, min(rows, MAX_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * total / PART_BYTES))))
    cut_at = tokens.agg(F.percentile_approx("place", [k / parts for k in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    bounds = np.unique(np.array(cut_at or [], dtype=np.int64))
    parted = tokens.withColumn("part", _part(F.col("place"), bounds))
    sizes = dict(parted.groupBy("part").agg(F.sum("n")).collect())
    ahead = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(len(bounds) + 1)])]).astype(np.int64)
    full = total // context
    edges = np.array([a for a, _ in _last_cuts(total, context)] + [total], dtype=np.int64)

    names = ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = -1, 0
        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                batch = whole.slice(low, 2000)
                row, start, length, seq, offset, piece = [], [], [], [], [], []
                for k, (n, own, ids) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist())):
                    if own != part:
                        part, seen = own, int(ahead[own])
                    at, begin, stop = seen, seen, seen + n
                    seen = stop
                    while at < stop:
                        if at < full * context:
                            s, a, b = at // context, at // context * context, at // context * context + context
                        else:
                            i = int(np.searchsorted(edges, at, side="right")) - 1
                            s, a, b = full + i, int(edges[i]), int(edges[i + 1])
                        to, x = min(stop, b), at - begin
                        row.append(k), start.append(x), length.append(to - at), seq.append(s), offset.append(at - a)
                        piece.append(ids[2 * x : 2 * (x + to - at)])
                        at = to
                index = pa.array(row, pa.int64())
                count = lambda x: pa.array(x, pa.int64())
                ids = count([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in piece]) if digest else pa.array(piece, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(index), count(start), count(length), ids, batch.column(1).take(index), count(seq), count(offset)],
                    names,
                )

    spread = parted.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "place", "doc_id", "mark")
    held = "ids_crc32 long" if digest else "ids binary"
    return spread.select("doc_id", "n", "ids", "part").mapInArrow(run, f"doc_id {kind}, start long, length long, {held}, doc_tokens long, sequence_id long, offset long")


def _part(place: Column, bounds: np.ndarray) -> Column:
    """How many of the sorted bounds lie below the place, by binary search."""
    steps = max(1, int(len(bounds)).bit_length())
    padded = F.lit(np.concatenate([bounds, np.full((1 << steps) - len(bounds), np.iinfo(np.int64).max)]).tolist()).cast("array<bigint>")
    halves = F.array(*[F.lit(1 << (steps - 1 - k)) for k in range(steps)])
    return F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(padded, at + half - 1) < place, at + half).otherwise(at))


def pack_digests(docs: DataFrame, context: int = CONTEXT, path: str | None = None) -> DataFrame:
    """The result columns of the query: pack's pieces, the CRC-32 of their ids as 32-bit integers in place of the ids."""
    return pack(docs, context, path, digest=True)
