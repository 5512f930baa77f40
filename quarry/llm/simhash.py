"""SimHash fingerprints, and links between close ones by anchor-point covering.

The anchors are a covering code: the words of the Hamming code of length 63 (narrower fingerprints are filled with zeros up
to it, for a shortened code has a larger covering radius), with any bits beyond the 63rd left free. Every bit string has an anchor within covering radius R = 1. Two fingerprints that
differ in at most t = 2 bits have a midpoint within t / 2 = 1 of both, and that midpoint an anchor within R: so both meet at
an anchor within R + t / 2 = 2, and replicating each fingerprint to its anchors within 2 (33 of them) finds every link,
where R + t with no use of the midpoint would take 684. An anchor cannot meet more than 1 + 64 + 2016 different
fingerprints, whatever the data: copies are folded into one row before, and no group grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import words
from .common import blobs, columns, cut, forget, small_batches, text_chunks
from .components import components

#: Differing bits up to which the code below finds every link.
THRESHOLD = 2
#: Shingles whose bits are counted at a time.
_BITS_AT_ONCE = 100_000


def majority_bits(h: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """For each text a fingerprint: a bit is 1 if it is set in over half of the text's hashes; zero if it has none.

    h: hashes in the order of doc, the texts' indices.
    """
    counts = np.zeros((texts, 64), dtype=np.int32)
    for a in range(0, len(h), _BITS_AT_ONCE):
        part, own = h[a : a + _BITS_AT_ONCE], doc[a : a + _BITS_AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edges = np.flatnonzero(np.diff(own, prepend=-1))
        for x, y in zip(edges, [*edges[1:], len(own)]):
            counts[own[x]] += bits[x:y].sum(axis=0, dtype=np.int32)
    total = np.bincount(doc, minlength=texts)
    return np.packbits(counts * 2 > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the 64-bit SimHash of the XXH64 of all word shingles, repeats included, of each whole text.

    A-Z are lower-cased; words are runs of characters other than blank and \\x09-\\x0D; a text of fewer words than `width` is
    one shingle; one without words (or null) has fingerprint 0. One row for each row of docs; fp is the signed form.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            w = words.split(blobs(batch))
            start, length, doc = w.shingles(width)
            fp = majority_bits(words.xxh64(w.buf, start, length, seed), doc, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def anchors(fp: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): for each fingerprint of `bits` bits its anchors within distance 2; of fewer than 63 bits the rest are zeros, but not the anchors'.

    Bits 1 to 63 of the code are bits 0 to 62 of the fingerprint; the syndrome of a fingerprint is the exclusive or of
    the numbers of its set bits, and is zero for a codeword.
    """
    n = 63
    syndrome = np.zeros(len(fp), dtype=np.int64)
    for k in range(1, n + 1):
        syndrome ^= np.where((fp >> np.uint64(k - 1)) & np.uint64(1), k, 0)
    one = np.uint64(1)
    rows, out = [], []

    def add(r: np.ndarray, flip: np.ndarray) -> None:
        rows.append(r)
        out.append(fp[r] ^ flip)

    zero = np.flatnonzero(syndrome == 0)
    add(zero, np.zeros(len(zero), np.uint64))
    for extra in range(63, bits):
        add(zero, np.full(len(zero), one << np.uint64(extra)))
    s = np.flatnonzero(syndrome)
    near = s[syndrome[s] <= n]
    flip = one << (syndrome[near] - 1).astype(np.uint64)
    add(near, flip)
    for extra in range(63, bits):
        add(near, flip | (one << np.uint64(extra)))
    for i in range(1, n + 1):
        j = syndrome[s] ^ i
        on = (j > i) & (j <= n)
        add(s[on], (one << np.uint64(i - 1)) | (one << (j[on] - 1).astype(np.uint64)))
    return np.concatenate(rows), np.concatenate(out)


_ONES = np.array([bin(x).count("1") for x in range(65536)], dtype=np.uint8)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return sum(_ONES[(x >> np.uint64(k)) & np.uint64(0xFFFF)].astype(np.int64) for k in (0, 16, 32, 48))


def _spanning(fp: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the same of these fingerprints as all links of at most THRESHOLD bits would, and are links."""
    left, edges = np.ones(len(fp), dtype=bool), []
    for first in range(len(fp)):
        if not left[first]:
            continue
        left[first] = False
        todo = [first]
        while todo:
            x = todo.pop()
            rest = np.flatnonzero(left)
            near = rest[differing(fp[rest], fp[x]) <= THRESHOLD] if len(rest) else rest
            left[near] = False
            edges += [(x, int(y)) for y in near]
            todo += near.tolist()
    return edges


def links(distinct: DataFrame, bits: int = 64) -> DataFrame:
    """(fp_a, fp_b): links of at most 2 differing bits, enough to connect all that such links connect.

    distinct: (fp) or (block, fp), each once. With blocks, only fingerprints of the same block are compared, and links has a
    block too. An anchor's fingerprints (a bounded number) are compared in place, and only a spanning forest leaves.
    """
    block = "block" if "block" in distinct.columns else None
    keys = (["block"] if block else []) + ["anchor"]

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                part = batch.slice(a, 20_000)
                fp = part.column(part.schema.get_field_index("fp")).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                row, anchor = anchors(fp, bits)
                cols = [pa.array(anchor.view(np.int64)), pa.array(fp[row].view(np.int64))]
                if block:
                    cols = [part.column(part.schema.get_field_index("block")).take(pa.array(row)), *cols]
                yield pa.RecordBatch.from_arrays(cols, [*keys, "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False)).astype(np.int64) for i in range(batch.num_columns)]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
            if not len(cols[0]):
                continue
            same = np.ones(len(cols[0]) - 1, dtype=bool)
            for x in cols[:-1]:
                same &= x[1:] == x[:-1]
            edges = np.concatenate([[0], np.flatnonzero(~same) + 1])
            held = [x[edges[-1] :] for x in cols]
            yield from found(cols, edges)
        if held is not None:
            yield from found(held, np.array([0, len(held[0])]))

    def found(cols: list[np.ndarray], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = cols[-1].view(np.uint64)
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]
        two = two[differing(fp[two], fp[two + 1]) <= THRESHOLD]
        parts = [(two, two + 1)]
        for k in np.flatnonzero(sizes > 2):
            a = edges[k]
            if pairs := _spanning(fp[a : edges[k + 1]]):
                x = np.array(pairs) + a
                parts.append((x[:, 0], x[:, 1]))
        x, y = (np.concatenate(p) for p in zip(*parts))
        if len(x):
            out = ([cols[0][x]] if block else []) + [cols[-1][x], cols[-1][y]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], (["block"] if block else []) + ["fp_a", "fp_b"])

    head = "block long, " if block else ""
    placed = distinct.select(*([F.col("block").cast("long")] if block else []), "fp").mapInArrow(replicate, f"{head}anchor long, fp long")
    placed = placed.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return placed.mapInArrow(compare, f"{head}fp_a long, fp_b long").distinct()


def simhash_components(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp_copies): each document's fingerprint and its component.

    Fingerprints link at 2 or fewer differing bits, documents with equal ones always; component_id is the smallest doc_id
    reachable. Null or empty texts have fingerprint 0, which links like any other; a row with a null doc_id keeps its fingerprint
    but never names a component, unless all its component has null ids; repeated rows come out as often as they went in; further columns of
    docs are ignored. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, width=width, seed=seed).select(F.col("id").alias("doc_id"), "fp"))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("fp_copies")))
    found = links(distinct.select("fp"))
    of = components(found.select(F.col("fp_a").alias("u"), F.col("fp_b").alias("v")))
    named = distinct.join(of, distinct["fp"] == of["node"], "left").select("fp", "least", "fp_copies", F.coalesce("component", "fp").alias("part"))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "part").select("fp", "component_id", "fp_copies")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp_copies")


#: Near-duplicate search: blocks of the wide fingerprint, bits of each, and the similarity of word shingles that makes a link.
BLOCKS, BLOCK_BITS, SHINGLE, SIMILARITY = 4, 40, 5, 0.8
#: Shingles in this many of one in SAMPLE texts come last in the order of prefixes, COMMON of them at most. Speed hangs on them, results don't.
SAMPLE, COMMON_IN, COMMON = 16, 3, 1 << 17
#: Rounds in which each text is compared with one other, before all pairs of a bucket are compared that are still apart.
STARS, BEST_ROUNDS = 1, 1
#: Rows of two numbers that are broadcast, and shared shingles that travel to all tasks (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS, SHARED_ROWS = 500_000, 2_000_000
#: Pairs of one text that one group of a comparison holds, about.
PAIRS_OF_ONE = 500
#: Texts of one shingle that are paired with each other; more are told apart by their differences from one of them, in so many rounds at most.
FEW_TEXTS, ROUNDS = 100, 3
#: Numbers of differences that a batch holds, about.
_DIFFERENCES_AT_ONCE = 500_000


def _few(df: DataFrame) -> DataFrame:
    """df, written, and broadcast in joins if it is small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _identity(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's words in order."""
    ends = np.cumsum(w.counts)
    out = np.empty((len(ends), 2), dtype=np.uint64)
    for k, (n, to) in enumerate(zip(w.counts.tolist(), ends.tolist())):
        whole = xxhash.xxh3_128_intdigest(w.buf[w.starts[to - n] : w.ends[to - 1]] if n else b"")
        out[k] = whole & 0xFFFFFFFFFFFFFFFF, whole >> 64
    return out[:, 0].copy().view(np.int64), out[:, 1].copy().view(np.int64)


def _common(docs: DataFrame, width: int) -> np.ndarray:
    """The hashes, sorted, of the shingles that a sample of the texts shows to be common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            w = words.split(blobs(batch))
            start, length, doc = w.shingles(width)
            h = words.xxh64(w.buf, start, length)
            edge = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for a, b in zip(edge, edge[1:]):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[a:b]).view(np.int64))], ["h"])

    some = small_batches(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "h long")
    counted = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_IN)
    return np.sort(columns(counted.orderBy(F.desc("n"), "h").limit(COMMON).select("h"))["h"].astype(np.int64).view(np.uint64))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of h is in the sorted array."""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), dtype=bool)


def _prefixes(h: np.ndarray, doc: np.ndarray, texts: int, common: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n of each text; text, place, shingle of each kept one): the different shingles' number and the first of them, common ones last: two texts that are `similarity` alike share one of these."""
    order = np.lexsort((h, _among(h, common), doc))
    h, doc = h[order], doc[order]
    once = np.ones(len(h), dtype=bool)
    once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[once], doc[once]
    n = np.bincount(doc, minlength=texts)
    most = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
    at = np.arange(len(h)) - (np.cumsum(n) - n)[doc]
    kept = at < most[doc]
    return n, doc[kept], at[kept], h[kept]


def _wide(docs: DataFrame) -> DataFrame:
    """(doc_id, t, t2, f0..f3): two hashes of the text's words in order, and four 40-bit SimHashes of its set of words, one bit string cut in four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << BLOCK_BITS) - 1)
        for batch in text_chunks(batches):
            n = batch.num_rows
            w = words.split(blobs(batch))
            h = w.hashes()
            key = h ^ words.mix(w.doc.astype(np.uint64) + np.uint64(1))
            _, one = np.unique(key, return_index=True)
            one.sort()
            f = [majority_bits(words.mix(h[one] + np.uint64(k)) if k else h[one], w.doc[one], n) for k in range(3)]
            rest = np.uint64(BLOCK_BITS)
            parts = [x & mask for x in f] + [(f[0] >> rest) | ((f[1] >> rest) & np.uint64(0xFFFF)) << np.uint64(24)]
            cols = [*[pa.array(x) for x in _identity(w)], *[pa.array(x.view(np.int64)) for x in parts]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "t", "t2", "f0", "f1", "f2", "f3"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, t long, t2 long, f0 long, f1 long, f2 long, f3 long")


#: Bytes of a shingle's hash in a set: of two sets of 1,000, one pair in a million shares one more than it should.
SET_BYTES = 5


def _shortened(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]).tobytes()


def _whole(b: pa.Buffer | bytes) -> np.ndarray:
    """The different numbers that `_shortened` made."""
    x = np.frombuffer(b, np.uint8).reshape(-1, SET_BYTES)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :SET_BYTES] = x
    return np.unique(out.view("<u8").reshape(-1))


def _shingle_sets(asked: DataFrame, width: int) -> DataFrame:
    """(t, s) of asked (t, text), where t is the text's hash: the different hashes of its word shingles, SET_BYTES each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            w = words.split(blobs(batch))
            start, length, doc = w.shingles(width)
            h = words.xxh64(w.buf, start, length)
            edge = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            own = np.flatnonzero(_identity(w)[0] == batch.column(0).to_numpy(zero_copy_only=False))
            sets = [_shortened(np.unique(h[edge[k] : edge[k + 1]])) for k in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(sets, pa.binary())], ["t", "s"])

    return asked.select("t", "text").mapInArrow(run, "t long, s binary")


def _beside_hubs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, k, v, s) in order of u and k: the set of each v beside that of its u, which comes first with a null v.

    The set of u comes once to each group of its pairs; a text of many pairs has many groups, so that none is long.
    """
    groups = cut(pairs.groupBy("u").agg(F.ceil(F.count("*") / PAIRS_OF_ONE).cast("int").alias("k")))
    of = lambda name: sets.select(F.col("t").alias(name), "s")
    each = pairs.join(groups, "u").select("u", F.pmod(F.xxhash64("v"), F.col("k")).cast("int").alias("k"), "v").join(of("v"), "v").select("u", "k", "v", "s")
    hubs = groups.select("u", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("k")).join(of("u"), "u").select("u", "k", F.lit(None).cast("long").alias("v"), "s")
    return hubs.union(each).repartition("u", "k").sortWithinPartitions("u", "k", F.col("v").asc_nulls_first())


def _alike(own: int, other: int, common: int, similarity: float) -> bool:
    return common >= similarity * (own + other - common)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (u, v) whose shingle sets have at least this Jaccard similarity; two texts without words are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            us, vs = [], []
            for u, v, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                x = _whole(s.as_buffer())
                if v is None:
                    hub, own = u, x
                elif u == hub and _alike(len(own), len(x), len(np.intersect1d(own, x, assume_unique=True)), similarity):
                    us.append(u), vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return _beside_hubs(pairs, sets).mapInArrow(run, "u long, v long")


def _differences(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v, m, n, near, x) of pairs (u, v): how many shingles u and v have, whether they are alike, and the shingles that one of them has alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None

        def batch_of(rows: list[tuple], apart: list[np.ndarray]) -> pa.RecordBatch:
            u, v, m, n, near = zip(*rows) if rows else ([],) * 5
            ends = np.cumsum([0, *(len(x) for x in apart)]).astype(np.int32)
            x = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*apart, np.zeros(0, np.uint64)]).astype(np.int64)))
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (u, v, m, n)], pa.array(near, pa.bool_()), x], ["u", "v", "m", "n", "near", "x"])

        for batch in batches:
            rows, apart, held = [], [], 0
            for u, v, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                x = _whole(s.as_buffer())
                if v is None:
                    hub, own = u, x
                elif u == hub:
                    apart.append(np.setxor1d(own, x, assume_unique=True))
                    rows.append((u, v, len(own), len(x), _alike(len(own), len(x), (len(own) + len(x) - len(apart[-1])) // 2, similarity)))
                    held += len(apart[-1])
                    if held >= _DIFFERENCES_AT_ONCE:
                        yield batch_of(rows, apart)
                        rows, apart, held = [], [], 0
            yield batch_of(rows, apart)

    return _beside_hubs(pairs, sets).mapInArrow(run, "u long, v long, m long, n long, near boolean, x array<long>")


def _difference_prefixes(differences: DataFrame, similarity: float) -> DataFrame:
    """(lead, h, t, near, deep, n, d, at) of _differences: each text's differences from its leader, rarest first, as far as one of those shared must come; h tells leader and shingle.

    Let r = (1 - similarity) / (1 + similarity): sets are alike if their symmetric difference is at most r times the sum of their sizes. The symmetric difference of two
    texts is that of their differences d and e from the leader of m shingles, so texts of n and o shingles share c = (d + e - r (n + o)) / 2 of these at least. A text that isn't near
    (alike the leader) has e > r (o + m): others, near or not, share over (d - r (n - m)) / 2 with it. With e >= c and o <= m + e, one that isn't near shares (d - r (n + m)) / (1 + r)
    or more with any; what comes so late that only a near text can share it first is deep. Two near texts are left to their leader.
    """
    r = (1 - similarity) / (1 + similarity)
    with_far, with_any = (F.col("d") - r * (F.col("n") - F.col("m"))) / 2, (F.col("d") - r * (F.col("n") + F.col("m"))) / (1 + r)
    least = lambda c: F.greatest(F.lit(1), F.ceil(c - 1e-6)).cast("int")
    often = differences.select("u", F.explode("x").alias("x")).groupBy("u", "x").agg(F.count("*").alias("often")).where("often > 1")
    each = differences.select("u", "v", F.explode("x").alias("x")).join(often, ["u", "x"], "left")
    order = each.groupBy("u", "v").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "x"))).alias("order"))
    sized = differences.select("u", "v", "m", "n", "near", F.size("x").alias("d")).where("d > 0")
    sized = sized.withColumn("early", F.col("d") - F.when(F.col("near"), least(with_far)).otherwise(F.greatest(least(with_far), least(with_any))))
    sized = sized.withColumn("late", F.when(F.col("near"), F.col("early")).otherwise(F.col("d") - least(with_any)))
    kept = sized.join(order, ["u", "v"]).withColumn("order", F.slice("order", 1, F.col("late") + 1))
    rows = kept.select(F.col("u").alias("lead"), F.col("v").alias("t"), "near", "early", "n", "d", F.posexplode("order").alias("at", "e")).where("e.often > 1")
    return rows.select("lead", F.xxhash64("lead", "e.x").alias("h"), "t", "near", (F.col("at") > F.col("early")).alias("deep"), "n", "d", "at")


def _pairs_by_differences(rows: DataFrame, similarity: float) -> DataFrame:
    """(u, v, c): the pairs of texts of different parts that can be so alike, by the place of a difference that they share (see _difference_prefixes); c orders them."""
    r = (1 - similarity) / (1 + similarity)
    needed = (F.col("x.d") + F.col("y.d") - r * (F.col("x.n") + F.col("y.n"))) / 2
    can = (F.col("x.part") != F.col("y.part")) & (F.least(F.col("x.d") - F.col("x.at"), F.col("y.d") - F.col("y.at")) >= needed - 1e-6)
    early = rows.where("not deep")
    among = early.alias("x").join(early.alias("y"), ["lead", "h"]).where((F.col("x.t") < F.col("y.t")) & can)
    across = rows.where("near").alias("x").join(rows.where("deep").alias("y"), ["lead", "h"]).where(can)
    ends = [F.least("x.t", "y.t").alias("u"), F.greatest("x.t", "y.t").alias("v"), (F.lit(1) / (F.col("x.n") + F.col("y.n"))).alias("c")]
    return among.select(*ends).union(across.select(*ends)).groupBy("u", "v").agg(F.sum("c").alias("c"))


def _possible(x: str, y: str, similarity: float) -> Column:
    """Whether texts that share the shingles at x.at and y.at of their orders, and none before, can be so alike, by their sizes and what is left of them."""
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    shared = F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at"))
    return shared * (1 + similarity) >= similarity * n - 1e-6


def _enough(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (u, v) that share so much of their prefixes that they can be so alike; rows: (h, t, n), with all that the texts of a pair share.

    A shingle that both texts have, but not both prefixes, lies beyond the prefix that ends first: there are fewer of them than similarity times the longer text's number.
    """
    texts = cut(rows.groupBy("t").agg(F.max("n").alias("n"), F.collect_set("h").alias("p")))
    of = lambda name: texts.select(F.col("t").alias(name), F.col("n").alias(f"n_{name}"), F.col("p").alias(f"p_{name}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").withColumn("c", F.size(F.array_intersect("p_u", "p_v")))
    return both.where(_reachable("c", "n_u", "n_v", similarity)).select("u", "v")


def _reachable(c: str, n: str, m: str, similarity: float) -> Column:
    """Whether texts of n and m shingles that share c of their prefixes can be so alike (see _enough)."""
    rest = F.greatest(F.ceil(similarity * F.col(n) - 1e-9), F.ceil(similarity * F.col(m) - 1e-9)) - 1
    return F.col(c) + rest >= similarity / (1 + similarity) * (F.col(n) + F.col(m)) - 1e-6


def _pairs_of_few(few: DataFrame, many: DataFrame, similarity: float) -> DataFrame:
    """(u, v, c): the pairs of texts of different parts that meet in `few` and share so much of their prefixes that they can be so alike, and what part of their shingles that is.

    few, many: (h, t, n, at, part) of the shingles that few and many texts have. Alike texts whose first shared one is in few are found here; those in many, by which they may share more, count as shared.
    """
    rows = few.join(many.groupBy("t").agg(F.count("*").alias("others")), "t", "left")
    more = F.least(F.coalesce("x.others", F.lit(0)), F.coalesce("y.others", F.lit(0)))
    both = rows.alias("x").join(rows.alias("y"), "h").where((F.col("x.t") < F.col("y.t")) & (F.col("x.part") != F.col("y.part")))
    counted = both.groupBy(F.col("x.t").alias("u"), F.col("y.t").alias("v")).agg(
        F.count("*").alias("c"), F.first(more).alias("more"), F.first("x.n").alias("nu"), F.first("y.n").alias("nv"), F.max(_possible("x", "y", similarity)).alias("ok")
    )
    counted = counted.withColumn("most", F.col("c") + F.col("more"))
    return counted.where(F.col("ok") & _reachable("most", "nu", "nv", similarity)).select("u", "v", (F.col("c") / (F.col("nu") + F.col("nv"))).alias("c"))


def _shared_prefixes(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(h, t, n, at): the shingles of prefixes that occur in those of two or more different texts, once for each text t; n is the text's number of shingles, at the place among them.

    A first pass finds which shingles these are, by an aggregate with partial minima and maxima; a second leaves the rest of the prefixes where the texts are.
    """
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, width))

    def prefixes(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        w = words.split(blobs(batch))
        start, length, doc = w.shingles(width)
        n, doc, at, h = _prefixes(words.xxh64(w.buf, start, length), doc, batch.num_rows, common.value, similarity)
        return h, _identity(w)[0][doc], n[doc], at

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            h, t, _, _ = prefixes(batch)
            order = np.lexsort((t, h))
            h, t = h[order], t[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[1:] != h[:-1]
            last = np.append(new[1:], True) if len(h) else new
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(t[new]), pa.array(t[last])], ["h", "lo", "hi"])

    texts = small_batches(docs).select("text")
    shared = cut(texts.mapInArrow(ends, "h long, lo long, hi long").groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("h"))
    forget(docs.sparkSession)
    few = shared.count() <= SHARED_ROWS
    known = docs.sparkSession.sparkContext.broadcast(np.sort(columns(shared)["h"].astype(np.int64).view(np.uint64)) if few else None)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            cols = prefixes(batch)
            if known.value is not None:
                on = _among(cols[0], known.value)
                cols = [x[on] for x in cols]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in cols], ["h", "t", "n", "at"])

    rows = texts.mapInArrow(found, "h long, t long, n long, at long")
    rows = cut((rows if few else rows.join(shared, "h")).groupBy("h", "t").agg(F.min("n").alias("n"), F.min("at").alias("at")))
    forget(docs.sparkSession)
    return rows


def _of_prefixes(left: DataFrame, linked: DataFrame, alike: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """components() of the links that `linked`, components of texts, and all pairs of texts that are alike make; left: _shared_prefixes of the texts; sets: _shingle_sets of texts (t).

    Texts that are alike share a shingle of their prefixes. Only shingles that texts of different components share are looked at. In each of some rounds one text leads
    each shingle's texts, and each text is compared with the leader that it meets most often; what is still in different components then pair by pair where a shingle has few texts.
    Where it has many, such as of a large group of near copies, all are compared with one of them. Alike texts that aren't both alike that one share a difference from it, one of
    a prefix of their differences (see _least_shared): these are looked at in the place of the shingle, again with a leader where many share one.
    """

    def placed(rows: DataFrame, of: DataFrame) -> DataFrame:
        named = of.select(F.col("node").alias("t"), "component")
        return rows.join(named, "t", "left").withColumn("part", F.coalesce("component", "t")).drop("component")

    def met(rows: DataFrame) -> DataFrame:
        apart = rows.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("h")
        return cut(rows.join(_few(apart), "h").select("h", "t", "n", "at"))

    def linked_to(found: DataFrame) -> DataFrame:
        return cut(components(linked.select(F.col("node").alias("u"), F.col("component").alias("v")).union(found)))

    def linked_by(pairs: DataFrame) -> DataFrame:
        return linked_to(alike(cut(pairs)))

    def apart(pairs: DataFrame) -> DataFrame:
        """Those of pairs (u, v, ...) that are in different components."""
        part = lambda name: linked.select(F.col("node").alias(name), F.col("component").alias(f"part_{name}"))
        both = pairs.join(part("u"), "u", "left").join(part("v"), "v", "left")
        return both.where(F.coalesce("part_u", "u") != F.coalesce("part_v", "v")).select(*pairs.columns)

    left = met(placed(left, linked))
    for k in range(STARS):
        if left.isEmpty():
            return linked
        now = placed(left, linked)
        # The least edited text of a group shares most: it leads at first, and any other in later rounds.
        shared = now.groupBy("t").agg((-F.count("*") / F.max("n")).alias("share"))
        rank = F.struct("share", "t") if k == 0 else F.struct(F.xxhash64("t", F.lit(k)))
        star = now.join(shared, "t").withColumn("rank", rank).groupBy("h").agg(F.min(F.struct("rank", "t", "n", "at", "part")).alias("one"))
        both = star.select("h", "one.*").alias("x").join(now.alias("y"), "h").where((F.col("x.part") != F.col("y.part")) & _possible("x", "y", similarity))
        met_often = both.select(F.col("x.t").alias("u"), F.col("y.t").alias("v")).groupBy("v", "u").agg(F.count("*").alias("n"))
        linked = linked_by(_enough(met_often.groupBy("v").agg(F.max_by("u", F.struct("n", "u")).alias("u")).select("u", "v"), left, similarity))
        forget(left.sparkSession)
        left = met(placed(left, linked))
    if left.isEmpty():
        return linked
    # All pairs that share enough. First each text's best one, so that most of the others end up in one component and needn't be compared.
    parts, now = [], left
    for k in range(ROUNDS):
        now = placed(now, linked)
        # Pairs that are looked at: of the first round all, then those that can share the difference first.
        work = F.count("*") if k == 0 else (F.pow(F.sum((~F.col("deep")).cast("long")), F.lit(2)) + F.sum(F.col("near").cast("long")) * F.sum(F.col("deep").cast("long"))) / F.count("*")
        sizes = now.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), work.cast("long").alias("work")).where("lo <> hi").select("h", "work")
        now = cut(now.join(_few(sizes), "h"))
        few, many = now.where(F.col("work") <= FEW_TEXTS), now.where(F.col("work") > FEW_TEXTS)
        last = k == ROUNDS - 1 or many.isEmpty()
        if last:
            few, many = now, now.limit(0)
        parts.append(cut(_pairs_by_differences(few, similarity) if k else _pairs_of_few(few, many, similarity)))
        if last:
            break
        # The text that has most of these shingles leads, so that there are few leaders.
        rank = many.join(many.groupBy("t").agg((-F.count("*")).alias("met")), "t").groupBy("h").agg(F.min(F.struct("met", "t")).alias("one"))
        led = cut(many.select("h", "t").join(rank.select("h", F.col("one.t").alias("u")), "h").where("t <> u").select("u", F.col("t").alias("v")).distinct())
        asked = sets(led.select(F.col("u").alias("t")).union(led.select(F.col("v").alias("t"))).distinct())
        differences = cut(_differences(led, asked, similarity))
        linked = linked_to(differences.where("near").select("u", "v"))
        now = cut(_difference_prefixes(differences, similarity))
        forget(left.sparkSession)
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    pairs = cut(apart(found.groupBy("u", "v").agg(F.max("c").alias("c")))) if len(parts) > 1 else parts[0]
    for _ in range(BEST_ROUNDS):
        if pairs.isEmpty():
            return linked
        ends = pairs.select("u", "v", "c", F.col("u").alias("t")).union(pairs.select("u", "v", "c", F.col("v").alias("t")))
        best = cut(ends.groupBy("t").agg(F.max_by(F.struct("u", "v"), F.struct("c", "u", "v")).alias("p")).select("p.u", "p.v").distinct())
        linked = linked_by(best)
        pairs = cut(apart(pairs.join(best, ["u", "v"], "left_anti")))
    return linked_by(pairs.select("u", "v"))


def _groups(docs: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """((doc_id, t, group_id, group_t), (doc_id, t)): the documents that aren't their group's first, t being a text's hash, and its first (smallest doc_id, then t); and all documents.

    Rows with a null doc_id take no part, nor do different texts of equal t, which would be taken for one (the second hash tells).
    """
    known = docs.where("doc_id is not null")
    wide = cut(_wide(known))
    whole = cut(wide.groupBy("t").agg(F.min("doc_id").alias("id"), F.min("t2").alias("lo"), F.max("t2").alias("hi"), *[F.min(f"f{k}").alias(f"f{k}") for k in range(BLOCKS)]))
    texts, mixed = whole.where("lo = hi"), F.broadcast(cut(whole.where("lo <> hi").select("t")))
    blocks = texts.select("t", F.posexplode(F.array(*[f"f{k}" for k in range(BLOCKS)])).alias("block", "fp")).withColumn("block", F.col("block").cast("long"))
    distinct = cut(blocks.groupBy("block", "fp").agg(F.min("t").alias("least"), F.count("*").alias("n")))
    same = blocks.join(distinct.where("n > 1"), ["block", "fp"]).where("t <> least").select(F.col("least").alias("u"), F.col("t").alias("v"))
    near = cut(links(distinct.select("block", "fp"), BLOCK_BITS))
    forget(docs.sparkSession)
    of = lambda end, name: distinct.select("block", F.col("fp").alias(end), F.col("least").alias(name))
    across = near.join(of("fp_a", "u"), ["block", "fp_a"]).join(of("fp_b", "v"), ["block", "fp_b"]).where("u <> v").select("u", "v")

    def sets_of(nodes: DataFrame) -> DataFrame:
        asked = cut(nodes.join(texts.select("t", "id"), "t").select(F.col("id").alias("doc_id"), "t"))
        n = asked.count()
        # The text of asked documents isn't shuffled while their ids fit a broadcast.
        sets = cut(_shingle_sets(known.select("doc_id", "text").join(F.broadcast(asked) if n <= BROADCAST_ROWS else asked, "doc_id"), width))
        if sets.count() > n:
            sets = cut(sets.groupBy("t").agg(F.any_value("s").alias("s")))
        return sets

    def alike(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("u").alias("t")).union(pairs.select(F.col("v").alias("t"))).distinct()
        return cut(_similar(pairs, sets_of(nodes), similarity))

    linked = cut(components(alike(cut(same.union(across).distinct()))))
    forget(docs.sparkSession)
    left = _shared_prefixes(known, width, similarity).join(mixed, "t", "left_anti")
    linked = _of_prefixes(left, linked, alike, sets_of, similarity)
    named = texts.join(linked, texts["t"] == linked["node"]).select("t", "component", "id")
    first = named.groupBy("component").agg(F.min(F.struct("id", "t")).alias("first"))
    of_text = named.join(first, "component").select("t", F.col("first.id").alias("group_id"), F.col("first.t").alias("group_t"))
    alone = texts.join(of_text.select("t"), "t", "left_anti").select("t", F.col("id").alias("group_id"), F.col("t").alias("group_t"))
    own = wide.select("doc_id", "t")
    return own.join(of_text.union(alone), "t").where("doc_id <> group_id or t <> group_t").select("doc_id", "t", "group_id", "group_t").distinct(), own


def near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, group_id): for each document that isn't its group's first, the first's doc_id, which is the group's smallest; the rest has no row.

    Texts with the same words in the same order are copies. Two others link if the sets of their word shingles are at least `similarity` alike; a group is what
    links and copies connect, and none is missed. Most links are found among the texts that come within 2 bits in some block of a 160-bit fingerprint:
    in a group of equal blocks each text is compared to the first, in an anchor's group along a spanning forest. Those that this leaves out share
    a shingle of their prefixes (see _of_prefixes), where texts of one group needn't be compared again. Null and empty texts are copies of each other. Rows with
    a null doc_id take no part. A doc_id whose rows have different texts is a document for each of them. An empty table gives an empty result; further columns are ignored.
    """
    return _groups(docs, width, similarity)[0].select("doc_id", "group_id").distinct()


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of near duplicates, that of the smallest doc_id, and all columns, whatever their names.

    Of rows that share doc_id and words one stays; rows that share the doc_id alone are different documents. Null and empty texts are copies of each other. Rows with a
    null doc_id stay. An empty table gives an empty result.
    """
    gone, own = _groups(docs, width, similarity)
    gone = cut(gone.select(F.col("doc_id").alias("_gone_id"), F.col("t").alias("_gone_t")))
    twice = cut(own.groupBy("doc_id", "t").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_gone_id"), F.col("t").alias("_gone_t")))
    # Columns go by their place, so that none can clash.
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_of, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text):
            t = _identity(words.split(blobs(batch, text)))[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t)], [*batch.schema.names, "_t"])

    keyed = small_batches(rows).mapInArrow(run, StructType([*rows.schema.fields, StructField("_t", LongType())]))
    is_one = (F.col(id_of) == F.col("_gone_id")) & (F.col("_t") == F.col("_gone_t"))
    left = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, is_one, "left_anti")
    if not twice.isEmpty():
        few = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
        again = left.join(few, is_one, "left_semi")
        one = again.select(id_of, "_t", F.struct(*rows.columns).alias("row")).groupBy(id_of, "_t").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        left = left.join(few, is_one, "left_anti").select(*rows.columns).unionByName(one.select("row.*"))
    return left.select(*rows.columns).toDF(*names)
