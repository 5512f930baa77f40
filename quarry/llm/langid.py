"""Language identification by hierarchical discrimination: the language family first, then one-versus-one support vector machines within it.

A text is its relative frequencies of hashed byte n-grams (1 to 3 bytes of lower-cased letters, words padded by blanks), square-rooted and scaled to length
one. Families come from the training data: languages whose mean vectors are closer than those of all on average are joined (average linkage). The family model is one
linear machine for each family against the rest; within a family of several languages there is one linear machine for each pair, and pairwise
votes decide, summed margins breaking ties. All machines are trained in numpy by dual coordinate descent on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blobs, cut, held_out, small_batches, text_chunks

#: Slots of a text's vector.
SLOTS = 1 << 12
#: Labelled documents of each language, and of all languages, that the machines are fitted on, at most (those of least hash).
PER_LANGUAGE, SAMPLE_LIMIT = 400, 6000
#: Languages that are learned at most: of a table with more labels, those with the most documents.
MAX_LANGUAGES = 1000
#: Cost of a margin violation, and passes over the sample.
COST, PASSES = 4.0, 30
UNKNOWN = "und"

_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _letters() -> np.ndarray:
    """Byte -> the byte counted: letters and bytes of longer characters stay (A-Z lower-cased), all else is a blank."""
    to = np.full(256, 32, dtype=np.uint8)
    to[0x80:] = np.arange(0x80, 0x100)
    to[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    to[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return to


_LETTERS = _letters()


def vector(text: bytes) -> np.ndarray:
    """The text's unit vector, float32 of SLOTS; zero if it has no letter."""
    a = _LETTERS[np.frombuffer(b" " + text.lower() + b" ", np.uint8)]
    # Upper case of Latin-1 letters: C3 80-9E are C3 A0-BE in lower case.
    after = np.flatnonzero(a[:-1] == 0xC3) + 1
    a[after] = np.where((a[after] >= 0x80) & (a[after] <= 0x9E) & (a[after] != 0x97), a[after] + 0x20, a[after])
    keep = (a != 32) | (np.concatenate([[False], a[:-1] != 32]))
    a = a[keep].astype(np.uint64)
    if not len(a):
        return np.zeros(SLOTS, np.float32)
    count = np.zeros(SLOTS)
    with np.errstate(over="ignore"):
        code = np.zeros(len(a) + 3, np.uint64)
        for n in (1, 2, 3):
            code = code[: len(a) - n + 1] * np.uint64(256) + a[n - 1 :] if n > 1 else a.copy()
            if not len(code):
                break
            slot = ((code + np.uint64(n << 40)) * _FACTORS[n - 1]) >> np.uint64(52)
            count += np.bincount(slot.astype(np.int64), minlength=SLOTS) / n
    v = np.sqrt(count)
    return (v / np.linalg.norm(v)).astype(np.float32)


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (hinge loss) by dual coordinate descent; y is 1 or -1, the classes weigh alike."""
    rng = np.random.default_rng(seed)
    n = len(y)
    share = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1)))
    top = cost * share
    x1 = np.hstack([x, np.ones((n, 1), np.float32)])
    q = np.einsum("ij,ij->i", x1, x1)
    alpha, w = np.zeros(n), np.zeros(x1.shape[1])
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(n):
            g = y[i] * (x1[i] @ w) - 1
            old = alpha[i]
            alpha[i] = min(max(old - g / q[i], 0.0), top[i])
            if (d := alpha[i] - old) != 0:
                w += d * y[i] * x1[i]
                most = max(most, abs(d))
        if most < 1e-3:
            break
    return w[:-1].astype(np.float32), float(w[-1])


@dataclass
class Model:
    """families: lists of languages; top: (weights, bias) of each family against the rest; pairs: (family, i, j) -> machine, positive for i."""

    families: list[list[str]]
    top: tuple[np.ndarray, np.ndarray]
    pairs: dict[tuple[int, int, int], tuple[np.ndarray, float]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1: the family's share times the language's) of each vector."""
        soft = lambda s: (lambda e: e / e.sum(axis=1, keepdims=True))(np.exp(2 * (s - s.max(axis=1, keepdims=True))))
        f = x @ self.top[0].T + self.top[1]
        share, family = soft(f), f.argmax(axis=1)
        names, score = np.empty(len(x), dtype=object), share[np.arange(len(x)), family].astype(np.float64)
        for k, langs in enumerate(self.families):
            on = np.flatnonzero(family == k)
            if not len(on):
                continue
            votes, margin = np.zeros((len(on), len(langs))), np.zeros((len(on), len(langs)))
            for i in range(len(langs)):
                for j in range(i + 1, len(langs)):
                    w, b = self.pairs[k, i, j]
                    m = x[on] @ w + b
                    votes[:, i] += m > 0
                    votes[:, j] += m <= 0
                    margin[:, i] += m
                    margin[:, j] -= m
            best = (votes + margin / (1 + np.abs(margin).sum(axis=1, keepdims=True))).argmax(axis=1)
            names[on] = np.array(langs, dtype=object)[best]
            score[on] *= soft(margin)[np.arange(len(on)), best]
        return names.tolist(), np.clip(score, 0, 1)


def fit(x: np.ndarray, labels: list[str]) -> Model:
    langs = sorted(set(labels))
    y = np.array([langs.index(v) for v in labels])
    means = np.stack([x[y == k].mean(axis=0) for k in range(len(langs))])
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    cosine = unit @ unit.T
    # Average linkage, as long as two families are more alike than languages are on average.
    off = cosine[~np.eye(len(langs), dtype=bool)]
    groups = [[k] for k in range(len(langs))]
    while len(groups) > 1:
        near, i, j = max((float(cosine[np.ix_(g, h)].mean()), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups[:i]))
        if near <= float(off.mean()) + 1e-9:
            break
        groups[j] = sorted(groups[j] + groups.pop(i))
    if len(groups) == 1:
        top = (np.zeros((1, x.shape[1]), np.float32), np.zeros(1, np.float32))
    else:
        fitted = [fit_machine(x, np.where(np.isin(y, g), 1, -1)) for g in groups]
        top = (np.stack([w for w, _ in fitted]), np.array([b for _, b in fitted], np.float32))
    pairs = {}
    for k, g in enumerate(groups):
        for i in range(len(g)):
            for j in range(i + 1, len(g)):
                on = np.isin(y, [g[i], g[j]])
                pairs[k, i, j] = fit_machine(x[on], np.where(y[on] == g[i], 1, -1))
    return Model([[langs[m] for m in g] for g in groups], top, pairs)


def train(labelled: DataFrame) -> Model | None:
    """The model of labelled rows (doc_id, text, lang), lang not null; None without any.

    The sample: of each language its rows of least hash of text and doc_id, about PER_LANGUAGE of them, fewer if all languages' would exceed SAMPLE_LIMIT.
    Vectors are made where the texts are; only they come to the driver.
    """
    spark = labelled.sparkSession
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return None
    each = max(4, min(PER_LANGUAGE, SAMPLE_LIMIT // len(counts)))
    share = spark.createDataFrame([(k, min(1.0, 1.3 * each / n)) for k, n in counts.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.join(F.broadcast(share), "lang").where(draw <= F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            rows = [vector(t).astype(np.float16).tobytes() for t in blobs(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["lang", "v"])

    rows = cut(chosen.mapInArrow(run, "lang string, v binary")).limit(2 * SAMPLE_LIMIT).collect()
    rows = sorted(rows, key=lambda r: (r.lang, bytes(r.v)))
    x = np.stack([np.frombuffer(r.v, np.float16).astype(np.float32) for r in rows]) if rows else np.zeros((0, SLOTS), np.float32)
    on = x.any(axis=1)
    return fit(x[on], [r.lang for r, k in zip(rows, on) if k]) if on.any() else None


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang).

    Learned from text and lang of rows with a lang whose crc32 of doc_id as text modulo 5 isn't 0 (held_out: it is 0). lang_pred is 'und' and score 0 if text is null or has
    no letter, and if there is nothing to learn from. Repeated rows come out as often as they went in; further columns are ignored; an
    empty table gives an empty result.
    """
    out_of = held_out(F.col("doc_id"), 0)
    model = train(docs.select("doc_id", "text", "lang").where(~out_of & F.col("lang").isNotNull() & has_letter(F.col("text"))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            letter = np.array(batch.column(3).to_pylist(), dtype=bool)
            names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            on = np.flatnonzero(letter)
            if shared.value is not None and len(on):
                texts = blobs(batch)
                for a in range(0, len(on), 256):
                    part = on[a : a + 256]
                    found, s = shared.value.predict(np.stack([vector(texts[k]) for k in part]))
                    score[part] = s
                    for k, name in zip(part, found):
                        names[k] = name
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = small_batches(docs).select("doc_id", out_of.alias("held_out"), "text", has_letter(F.col("text")).alias("letter"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
