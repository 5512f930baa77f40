"""Quality rules whose thresholds follow the corpus: mergeable quantile sketches per language and source.

Each document has a few ratios. A sketch of a ratio is a histogram over logarithmic buckets (a quantile comes out within
RELATIVE_ERROR); two sketches merge by adding bucket counts, so groupBy().count() with partial sums builds them, in any order and with
the same result, and a language's sketch is the sum of its sources' sketches. The documents' sizes have sketches of their own. From a group's quantiles comes
the threshold (see `limits`); the filter joins it to the group's documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import words
from .common import blobs, cut, small_batches, text_chunks

#: Least words, and most percent of words in repeated windows, of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
RELATIVE_ERROR = 0.02
_GAMMA = (1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR)
#: Ratios below this are one bucket.
_LEAST = 1e-4
#: Documents that a language's quantiles weigh in those of its sources, and those of all documents in a language's.
PRIOR = 20
#: A threshold lies this many spreads and units above the median.
SPREAD = 6.0
#: Ratio: (size, step, root): its unit, the least difference that a document shows, is step / size, or step / sqrt(size) of a mean.
UNITS = {
    "symbol_ratio": ("size_words", 1.0, False), "upper_ratio": ("size_chars", 1.0, False), "dup_line_ratio": ("size_lines", 1.0, False),
    "repeat_ratio": ("size_words", float(WINDOW), False), "word_chars_mean": ("size_words", 2.0, True),
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _repeat_words(w: words.Words, texts: int) -> np.ndarray:
    """For each text its words in 8-word windows that occur twice or more in it."""
    h = w.hashes()
    if len(h) < WINDOW:
        return np.zeros(texts, dtype=np.int64)
    m = len(h) - WINDOW + 1
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        run = np.zeros(m, dtype=np.uint64)
        for k in range(WINDOW):
            run = run * factor + h[k : k + m]
        run = words.mix(run) ^ words.mix(w.doc[:m].astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(w.doc[:m] == w.doc[WINDOW - 1 :])
    order = at[np.argsort(run[at], kind="stable")]
    same = run[order[1:]] == run[order[:-1]]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(len(h) + 1, dtype=np.int64)
    hit = order[twice]
    np.add.at(change, hit, 1)
    np.add.at(change, hit + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(w.doc[covered], minlength=texts)


def _upper(b: bytes, s: str) -> int:
    """Bytes (the first of each character, but for rare alphabets) that lower-casing changes."""
    low = s.lower().encode()
    if len(low) != len(b):
        return sum(c.isupper() for c in s)
    return int(np.count_nonzero(np.frombuffer(b, np.uint8) != np.frombuffer(low, np.uint8)))


def counts(texts: list[bytes], strings: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text, given as UTF-8 bytes and as an Arrow string array."""
    w = words.split(texts)
    blank = [b.translate(None, b" \t\n\r\x0b\x0c") for b in texts]
    continued = bytes(range(0x80, 0xC0))
    out = {
        "n_words": w.counts,
        "word_chars": np.array([len(b.translate(None, continued)) for b in blank]),
        "n_symbols": np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in blank]),
        "n_repeat_words": _repeat_words(w, len(texts)),
    }
    dup, n_lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, b in enumerate(texts):
        lines = b.split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x.split()]
            n_lines[i], dup[i] = len(lines), len(lines) - len(set(lines))
        else:
            n_lines[i] = bool(w.counts[i])
    upper = np.array([_upper(b, s or "") for b, s in zip(texts, strings.to_pylist())])
    return out | {"n_dup_lines": dup, "n_lines": n_lines, "n_upper": upper}


def measured(docs: DataFrame, text: str, with_text: bool = False) -> DataFrame:
    """docs, with or without the column `text`, with its COUNTS, each in a column named _<count>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text):
            at = batch.schema.get_field_index(text)
            found = counts(blobs(batch, text), batch.column(at))
            kept = [i for i in range(batch.num_columns) if with_text or i != at]
            cols = [batch.column(i) for i in kept] + [pa.array(found[k].astype(np.int64)) for k in COUNTS]
            yield pa.RecordBatch.from_arrays(cols, [batch.schema.names[i] for i in kept] + [f"_{k}" for k in COUNTS])

    schema = StructType(list((docs if with_text else docs.drop(text)).schema.fields))
    for k in COUNTS:
        schema = schema.add(f"_{k}", "long")
    return small_batches(docs).mapInArrow(run, schema)


def _ratios() -> dict[str, Column]:
    n = F.greatest(F.col("_n_words"), F.lit(1)).cast("double")
    return {
        "symbol_ratio": F.col("_n_symbols") / n,
        "upper_ratio": F.col("_n_upper") / F.greatest(F.col("_word_chars"), F.lit(1)).cast("double"),
        "dup_line_ratio": F.col("_n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)).cast("double"),
        "repeat_ratio": F.col("_n_repeat_words") / n,
        "word_chars_mean": F.col("_word_chars") / n,
    }


def _sizes() -> dict[str, Column]:
    least = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    return {"size_words": least("_n_words"), "size_chars": least("_word_chars"), "size_lines": least("_n_lines")}


def base_failed() -> Column:
    return (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words"))


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): the quantile sketch of each ratio and size for each language and source (nulls as '')."""
    each = F.array(*[F.struct(F.lit(k).alias("ratio"), v.alias("x")) for k, v in (_ratios() | _sizes()).items()])
    bucket = F.when(F.col("r.x") < _LEAST, F.lit(None).cast("int")).otherwise(F.ceil(F.log(F.col("r.x")) / math.log(_GAMMA)).cast("int"))
    rows = stats.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.explode(each).alias("r"))
    return rows.groupBy("lang", "source", F.col("r.ratio").alias("ratio"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, ratio, total, q25, q50) of merged sketches; a bucket counts by the middle of its bounds."""
    merged = sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "ratio")
    run = F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first()))
    value = F.coalesce(2 * F.pow(F.lit(_GAMMA), F.col("bucket")) / (_GAMMA + 1), F.lit(0.0))
    seen = merged.select(*by, "ratio", value.alias("x"), run.alias("upto"), F.sum("n").over(group).alias("total"))
    least = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("x")))
    return seen.groupBy(*by, "ratio").agg(F.max("total").alias("total"), least(0.25).alias("q25"), least(0.5).alias("q50"))


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, max_<ratio>...): thresholds of each group.

    A threshold is median + SPREAD * (median - lower quartile + unit): the lower half of a group tells what its ordinary documents vary by, and stays right while up
    to half of the group is junk; the unit (see UNITS), at the lower quartile of the group's sizes, is what a single symbol, line or window makes in a short document of it.
    Quantiles of small groups are drawn towards their language's, and those towards all documents', as if PRIOR documents of it were in the group.
    """

    def level(by: list[str], p: str) -> DataFrame:
        q = _quantiles(sketch, by)
        return q.select(*by, "ratio", F.col("total").cast("double").alias(f"{p}_n"), F.col("q50").alias(f"{p}_mid"), (F.col("q50") - F.col("q25")).alias(f"{p}_low"), F.col("q25").alias(f"{p}_q25"))

    joined = level(["lang", "source"], "a").join(level(["lang"], "b"), ["lang", "ratio"]).join(level([], "c"), "ratio")

    def drawn(k: str) -> Column:
        b = (F.col("b_n") * F.col(f"b_{k}") + PRIOR * F.col(f"c_{k}")) / (F.col("b_n") + PRIOR)
        return ((F.col("a_n") * F.col(f"a_{k}") + PRIOR * b) / (F.col("a_n") + PRIOR)).alias(k)

    worked = joined.select("lang", "source", "ratio", *[drawn(k) for k in ("mid", "low", "q25")])
    of = lambda ratio, k: F.max(F.when(F.col("ratio") == ratio, F.col(k)))
    wide = worked.groupBy("lang", "source").agg(*[of(r, k).alias(f"{r}_{k}") for r in UNITS for k in ("mid", "low")], *[of(r, "q25").alias(r) for r in _sizes()])
    unit = lambda size, step, root: F.lit(step) / (F.sqrt(size) if root else F.col(size))
    most = [(F.col(f"{r}_mid") + SPREAD * (F.col(f"{r}_low") + unit(*u))).alias(f"max_{r}") for r, u in UNITS.items()]
    return wide.select("lang", "source", *most)


def judged(stats: DataFrame, thresholds: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """stats with base_failed and kept, by a join on language and source (nulls as '')."""
    t = thresholds.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[F.col(f"max_{k}").alias(f"_max_{k}") for k in UNITS])
    on = (F.coalesce(lang, F.lit("")) == F.col("_lang")) & (F.coalesce(source, F.lit("")) == F.col("_source"))
    joined = stats.join(t, on, "left")
    fine = F.lit(True)
    for k, ratio in _ratios().items():
        fine = fine & (ratio <= F.col(f"_max_{k}"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(True)))


def quality(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the ratios.

    Null texts are empty (and fail the base rules), null languages and sources make groups of their own; repeated rows
    count as often as they occur; further columns are ignored; an empty table gives an empty result.
    """
    stats = cut(measured(docs.select("doc_id", "lang", "source", "text"), "text"))
    out = judged(stats, limits(sketches(stats)))
    plain = [F.col(f"_{k}").alias(k) for k in COUNTS[:5]]
    return out.select("doc_id", *plain, "base_failed", "kept", *[v.alias(k) for k, v in _ratios().items()])


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns, whatever their names. Texts are measured twice and never shuffled.

    Null and empty texts go (the base rules fail them); null ids stay, null languages and sources make groups of their own; repeated rows stay or go together. An empty
    table gives an empty result.
    """
    stats = cut(measured(docs.select("lang", "source", "text"), "text"))
    thresholds = cut(limits(sketches(stats)))
    # Columns go by their place, so that none can clash with the counts.
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, own))
    again = measured(docs.toDF(*own), at["text"], with_text=True)
    kept = judged(again, thresholds, at["lang"], at["source"]).where("kept")
    return kept.select(*[F.col(k).alias(name) for name, k in at.items()])
