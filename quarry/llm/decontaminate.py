"""Benchmark decontamination by spaced seeds: hashes of word windows in which fixed masks leave some places out.

A mask's hash is the same for a benchmark window and a training window that differ only where the mask doesn't look, so substituted words don't hide a
leak. Seeds of all benchmark items and of all training windows are joined; each hit aligns item and document, and the words around it, over the
item's whole length, are compared one to one. DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1: the word counts, 0: it may differ. Of items of 16 words that keep 60 % of them these find 0.91 (of 30 words: all), see the test.
MASKS = ("10010101", "10100011", "11000101", "11110000")
SPAN = len(MASKS[0])
#: Least share of an item's words found in place.
MIN_SHARE = 0.5
#: Bytes of seeds, and of the items' words, up to which they are broadcast; beyond that the join shuffles. A seed is a hash, an item's id and two numbers.
BROADCAST_BYTES, SEED_BYTES = 32_000_000, 48
NOT_WORD = r"[^\p{L}\p{N}]+"


def word_array(text: Column) -> Column:
    """The text's words: lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _windows(df: DataFrame, mask: str, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """keep, pos and h: for each window of df.words (as long as `mask`) and each of masks its hash; pos is the window's first word, from 0."""
    span = len(mask)
    looked = [k for k in range(span) if any(m[k] == "1" for m in masks)]
    # Word k of every window: the words from the k-th on, as many as there are windows. (A filter on the size would split the text twice.)
    n = F.greatest(F.size("words") - span + 1, F.lit(0))
    columns = [F.slice("words", F.lit(k + 1), n).alias(f"w{k}") for k in looked]
    places = F.slice(F.sequence(F.lit(0), F.size("words")), F.lit(1), n).alias("pos")
    rows = df.select(*keep, F.inline(F.arrays_zip(places, *columns)))
    hashes = [F.xxhash64(F.concat_ws(" ", F.lit(m), *[F.col(f"w{k}") for k in range(span) if m[k] == "1"])) for m in masks]
    return rows.select(*keep, "pos", F.explode(F.array(*hashes)).alias("h"))


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(h, item_id, item_pos, size) of all windows of all items (item_id, words) of SPAN words or more; a shorter item, whole, has one seed."""
    size = F.size("words").alias("size")
    long = _windows(items.where(F.size("words") >= SPAN).select("item_id", "words", size), MASKS[0], ["item_id", "size"], MASKS)
    short = items.where(F.size("words").between(1, SPAN - 1))
    # The mask's name, as many ones as there are words, begins what is hashed.
    whole = short.select("item_id", size, F.lit(0).alias("pos"), F.xxhash64(F.concat_ws(" ", F.repeat(F.lit("1"), F.size("words")), F.array_join("words", " "))).alias("h"))
    return long.union(whole).select("h", "item_id", F.col("pos").alias("item_pos"), "size")


def _aligned(region: Column, item_words: Column, shift: Column) -> Column:
    """How many of the item's words stand in the region, the part of the document that the item falls on when shifted so."""
    skipped = F.greatest(-shift, F.lit(0))
    return F.size(F.filter(F.transform(item_words, lambda w, i: F.get(region, i - skipped) == w), lambda x: x))


def _region(words: Column, size: Column, shift: Column) -> Column:
    return F.slice(words, F.greatest(shift, F.lit(0)) + 1, F.greatest(size + F.least(shift, F.lit(0)), F.lit(0)))


def _leaks(docs: DataFrame, items: DataFrame, min_share: float) -> DataFrame:
    """(doc_id, t, item_id, n, back, size): for each document, known by doc_id and the hash t of its text, and each item found in it the best alignment; back is minus the shift."""
    words = items.select("item_id", word_array(F.col("text")).alias("words")).distinct()
    seeds = benchmark_seeds(words)
    short = [r.n for r in words.where(F.size("words").between(1, SPAN - 1)).select(F.size("words").alias("n")).distinct().collect()]
    weight = words.agg(F.sum(F.size("words")), F.sum(F.octet_length(F.array_join("words", " ")) + 16 * F.size("words"))).first()
    few = (weight[0] or 0) * len(MASKS) * SEED_BYTES <= BROADCAST_BYTES and (weight[1] or 0) <= BROADCAST_BYTES
    own = docs.select("doc_id", F.xxhash64("text").alias("t"), word_array(F.col("text")).alias("words"))
    shift = (F.col("pos") - F.col("item_pos")).alias("shift")
    key = ["doc_id", "t", "item_id", "shift", "size"]

    def hits_of(mask: str, masks: tuple[str, ...]) -> DataFrame:
        if few:
            # Window, probe and cut-out are one generated stage: only hits leave it, with no more words than the item has.
            met = _windows(own, mask, ["doc_id", "t", "words"], masks).join(F.broadcast(seeds), "h").select("doc_id", "t", "item_id", shift, "size", "words")
            return met.select(*key, _region(F.col("words"), F.col("size"), F.col("shift")).alias("region"))
        slim = _windows(own, mask, ["doc_id", "t"], masks).join(seeds, "h").select("doc_id", "t", "item_id", shift, "size").distinct()
        back = slim.join(own.select(F.col("doc_id").alias("own_id"), F.col("t").alias("own_t"), "words").distinct(), F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("t").eqNullSafe(F.col("own_t")))
        return back.select(*key, _region(F.col("words"), F.col("size"), F.col("shift")).alias("region"))

    hits = hits_of(MASKS[0], MASKS)
    for n in sorted(short):
        hits = hits.union(hits_of("1" * n, ("1" * n,)))
    text = words.select("item_id", F.col("words").alias("item_words"))
    # Two items of one id and size are told apart by their words: each hit is verified with both.
    whole = hits.join(F.broadcast(text) if few else text, "item_id").where(F.size("item_words") == F.col("size"))
    matched = whole.select("doc_id", "t", "item_id", "shift", "size", _aligned(F.col("region"), F.col("item_words"), F.col("shift")).alias("n")).where(F.col("n") >= min_share * F.col("size"))
    best = matched.groupBy("doc_id", "t", "item_id").agg(F.max(F.struct("n", (-F.col("shift")).alias("back"), "size")).alias("b"))
    return best.select("doc_id", "t", "item_id", "b.*")


def overlaps(docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, item_id, n_matched, n_item_words, share, doc_word): for each document and item found in it the best alignment.

    docs: (doc_id, text), items: (item_id, text). doc_word is the document's word (from 0) that the item's first word falls on, negative if the document holds
    only an end of the item. Items of fewer words than the masks span are found whole, word by word. Null and empty texts give no rows; repeated rows give one; rows that
    share a doc_id (null is one too) give the best of them; of alignments that tie the earliest counts; further columns are ignored. Empty tables give an empty result.
    Nothing is grouped but the verified hits of one document and item.
    """
    best = _leaks(docs, items, min_share).groupBy("doc_id", "item_id").agg(F.max(F.struct("n", "back", "size")).alias("b"))
    share = F.col("b.n") / F.col("b.size")
    return best.select(
        "doc_id", "item_id", F.col("b.n").cast("long").alias("n_matched"), F.col("b.size").cast("long").alias("n_item_words"), share.alias("share"), (-F.col("b.back")).cast("long").alias("doc_word")
    )


def decontaminate(docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    A document is a doc_id and a text: of rows that share the doc_id (null is one too) those go whose text holds an item. Null and empty texts stay, clean repeated rows all stay;
    empty tables give all documents.
    """
    bad = _leaks(docs, items, min_share).select(F.col("doc_id").alias("bad_id"), F.col("t").alias("bad_t")).distinct()
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("row.text") == F.col("bad_t"))
    return named.join(bad, same, "left_anti").select("row.*")
