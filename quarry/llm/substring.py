"""Substring deduplication by sliding sentence spans.

From every sentence on a run of SPAN consecutive sentences, or as many more as make MIN_WORDS words, is hashed; the hashes of all documents meet by buckets, and the places of those that repeat in one join; sentences that any
non-first occurrence of a repeated run covers are removed. A sentence ends after a word that ends with . ! or ?, and at a line end. Stretches of more than LONG words
without such an end are cut after words that a hash of the word and the one before picks, so that the same passage is cut alike wherever it begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import blobs, cut, small_batches, text_chunks
from .members import members, packed

SPAN, MIN_WORDS, LONG = 3, 10, 16
#: In long stretches one word in so many ends a sentence.
PICK = 4
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".!?"]] = True


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def sentences(w: words.Words, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of each sentence of the words, which are split with places; hashes: of the words, if they are known."""
    n = len(w.doc)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.ones(n, dtype=bool)
    begins[1:] = (w.doc[1:] != w.doc[:-1]) | (w.line[1:] != w.line[:-1]) | _STOPS[w.buf[w.ends[:-1] - 1]]
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, n))
    if (size > LONG).any():
        h = w.hashes() if hashes is None else hashes
        with np.errstate(over="ignore"):
            picked = words.mix(h[1:] + h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(PICK) == 0
        # The first word of a stretch isn't picked: the one before it is another text's or line's.
        begins[2:] |= picked[:-1] & ~begins[1:-1] & np.repeat(size > LONG, size)[2:]
        first = np.flatnonzero(begins)
    return first, w.doc[first]


def span_hashes(w: words.Words, first: np.ndarray, doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, sentences, hash) of the run that begins at each sentence, where the text is long enough."""
    n = len(first)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = np.diff(np.append(first, len(w.doc)))
    place = (np.arange(len(w.doc)) - np.repeat(first, size)).astype(np.uint64)
    total, count, run, at = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint64), np.arange(n)
    with np.errstate(over="ignore"):
        one = np.add.reduceat(words.mix(hashes + place * np.uint64(0x9E3779B97F4A7C15)), first)
        # A sentence has a word at least, so MIN_WORDS rounds are enough.
        for k in range(max(SPAN, MIN_WORDS)):
            at = at[at + k < n]
            at = at[(doc[at + k] == doc[at]) & ((k < SPAN) | (total[at] < MIN_WORDS))]
            run[at] = words.mix(run[at] * np.uint64(0xC2B2AE3D27D4EB4F) + one[at + k])
            total[at] += size[at + k]
            count[at] += 1
    whole = np.flatnonzero((count >= SPAN) & (total >= MIN_WORDS))
    return whole, count[whole], run[whole]


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first sentence, sentences, hash) of the runs of a batch's texts."""
    w = words.split(blobs(batch), places=True)
    hashes = w.hashes()
    first, doc = sentences(w, hashes)
    at, m, h = span_hashes(w, first, doc, hashes)
    return doc[at], at - np.searchsorted(doc, np.arange(batch.num_rows))[doc[at]], m, h


def _repeated(docs: DataFrame) -> Broadcast:
    """Where the hashes of runs that occur twice or more may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(_runs(batch)[3] for batch in text_chunks(batches))

    return docs.sparkSession.sparkContext.broadcast(members(small_batches(docs).select("text").mapInArrow(run, "b int, s binary"), 2))


def _spans(docs: DataFrame, among: Broadcast) -> DataFrame:
    """(doc_id, t, i, m, h): the hash, one of those `among` the given, of the run of m sentences that begins at sentence i of the text with hash t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            cols = _runs(batch)
            on = among.value.has(cols[3])
            doc, i, m, h = (x[on] for x in cols)
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(i.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(h.view(np.int64))], ["doc_id", "t", "i", "m", "h"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"doc_id {kind}, t long, i int, m int, h long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, t, i, m): runs that occur before, by doc_id (null before all), text and place, elsewhere or in the same document; t is the text's hash.

    Most runs occur once: five bytes of each run's hash are shuffled to find the others, of which alone the places are. A run that the bitmap takes for a repeated one by mistake
    is dropped by its count.
    """
    # Hashed three times: spans take more room written than their texts do.
    spans = _spans(docs, _repeated(docs))
    first = spans.groupBy("h").agg(F.min(F.struct("doc_id", "t", "i")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    joined = spans.join(cut(first), "h")
    return joined.where(~(F.struct("doc_id", "t", "i").eqNullSafe(F.col("first")))).select("doc_id", "t", "i", "m")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the text less the removed sentences, and n_sentences, n_removed, removed_chars; a row for each row of docs.

    A document is a doc_id and a text: rows that share both are cut alike, rows that share the doc_id alone (null is one too) each by its own text. The first occurrence
    of a run is that in the smallest doc_id (null before all), of its texts that of the smallest hash, the earliest there. A null text stays null, texts of few words have no runs and
    stay as they are; what lies between two kept sentences stays byte for byte. Further columns are ignored; an empty table gives an empty result. A run that a third of all documents
    shares is a third of the join's left side, which the join splits; each document's own list of runs is bounded by its length. Only texts that lose sentences are shuffled.
    """
    marks = repeated_spans(docs).groupBy(F.col("doc_id").alias("mark_id"), F.col("t").alias("mark_t")).agg(F.collect_set(F.col("i").cast("long") * 16 + F.col("m")).alias("runs"))
    marks = cut(marks)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(_unsigned(batch.column(0)) for batch in batches)

    known = docs.sparkSession.sparkContext.broadcast(members(marks.select("mark_t").mapInArrow(marked, "b int, s binary"), 1))
    same = F.col("doc_id").eqNullSafe(F.col("mark_id")) & (F.col("t") == F.col("mark_t"))

    def those(batches: Iterator[pa.RecordBatch], cut_down: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.value.has(_unsigned(batch.column(2))) == cut_down))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.nulls(b.num_rows)], ["doc_id", "text", "runs"]) for b in those(batches, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            texts = blobs(batch)
            w = words.split(texts, places=True)
            first, doc = sentences(w)
            base = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            out, total, removed = list(batch.column(1).to_pylist()), np.diff(base), np.zeros(batch.num_rows, np.int64)
            chars = np.zeros(batch.num_rows, np.int64)
            for k, runs in enumerate(batch.column(2).to_pylist()):
                if not runs or out[k] is None:
                    continue
                begin, size = np.divmod(np.array(runs, dtype=np.int64), 16)
                change = np.zeros(total[k] + 1, dtype=np.int64)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + size, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = [*w.at[first[base[k] : base[k + 1]]].tolist(), len(texts[k])]
                kept = texts[k][: edge[0]] + b"".join(texts[k][edge[i] : edge[i + 1]] for i in np.flatnonzero(~gone))
                text = kept.decode()
                removed[k], chars[k] = gone.sum(), len(out[k]) - len(text)
                out[k] = text
            cols = [batch.column(0), pa.array(out, pa.string()), pa.array(total.astype(np.int64)), pa.array(removed), pa.array(chars)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "n_sentences", "n_removed", "removed_chars"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_sentences long, n_removed long, removed_chars long"
    texts = small_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("t"))
    shorter = texts.mapInArrow(lambda batches: those(batches, True), f"doc_id {kind}, text string, t long").join(marks, same, "left").select("doc_id", "text", "runs")
    return texts.mapInArrow(whole, schema).union(shorter.mapInArrow(run, schema))
