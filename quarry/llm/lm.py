"""Log-bilinear language model, trained in numpy with noise-contrastive estimation, and the smoothed unigram base beside it.

Tokens are the words of a text and one end. The model predicts a token's class from the two tokens before: the most frequent tokens are classes of
their own, as many as grow with the vocabulary (see `outputs_of`), all others share CLASSES classes by their last bytes; within such a class a word has its smoothed share of the
class's training count. So P(token) = P(class | two classes before) * P(token | class), a normalised distribution over all training words and one unseen word a class.

Passes over the texts: count the training words (hash, count; partial sums, one shuffle); train; score. For training the texts, as classes of two bytes a token, go to shards
by the hash of their id and text; each shard is followed in the order of these hashes from a common start, and the shards' parameters are averaged in the order of their
numbers by a tree of bounded groups: the result hangs on the rows alone, not on how they are partitioned. Counts of the frequent words travel to the tasks as a table of
bounded size; the others are joined. Words are known by their 64-bit XXH64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .words import Table
from .common import blobs, columns, cut, held_out, small_batches, text_chunks

#: Classes of the words without one of their own, and classes in all, at least and at most (both powers of two).
CLASSES, LEAST_OUTPUTS, MOST_OUTPUTS = 64, 512, 2048
#: Most words whose counts travel to every task (16 bytes each).
FREQUENT = 1 << 18
#: The hash that stands for the end of a text.
END_HASH = np.uint64(0x5BD1E9955BD1E995)
DIMENSIONS, BATCH, NOISE, RATE = 24, 4096, 96, 0.15
#: Training words of the common start, on the driver, and the passes over them; texts of more than a tenth of it are no part of the start.
WARM_WORDS, WARM_PASSES = 300_000, 3
#: Training tokens of a shard, about.
SHARD_TOKENS = 4_000_000
#: Words whose counts a task sums up before it hands them on.
_COUNT_AT_ONCE = 2_000_000
#: Parameter vectors that one averaging task reads at most.
_FAN_IN = 64


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class of a rare word, text) of all tokens, each text's end after its words."""
    w = words.split(texts)
    at = np.arange(len(w.doc)) + w.doc
    ends = np.cumsum(w.counts + 1) - 1
    h = np.full(len(w.doc) + len(texts), END_HASH, dtype=np.uint64)
    rare = np.zeros(len(h), dtype=np.int64)
    doc = np.empty(len(h), dtype=np.int64)
    h[at], doc[at] = w.hashes(), w.doc
    doc[ends] = np.arange(len(texts))
    last, before = w.buf[w.ends - 1].astype(np.int64), w.buf[np.maximum(w.ends - 2, w.starts)].astype(np.int64)
    rare[at] = (last * 31 + before * 7 + (last * before) // 16) % CLASSES
    return h, rare, doc


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, cls, c): how often each token occurs in docs (text), by its hash; cls is its class as a rare word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> pa.RecordBatch:
            h, cls, c = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h, cls, c = h[order], cls[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(cls[first].astype(np.int32)), pa.array(np.add.reduceat(c, first))], ["h", "cls", "c"])

        for batch in text_chunks(batches):
            h, rare, _ = _tokens(blobs(batch))
            u, first, c = np.unique(h, return_index=True, return_counts=True)
            held.append((u, rare[first], c))
            size += len(u)
            if size >= _COUNT_AT_ONCE:
                yield summed()
                held, size = [], 0
        if held:
            yield summed()

    parts = docs.select("text").mapInArrow(run, "h long, cls int, c long")
    return parts.groupBy("h").agg(F.min("cls").alias("cls"), F.sum("c").alias("c"))


def outputs_of(distinct: int) -> int:
    """Classes in all for so many different words: the power of two nearest to their square root, within the bounds."""
    return 1 << round(math.log2(min(max(math.sqrt(max(distinct, 1)), LEAST_OUTPUTS), MOST_OUTPUTS)))


def start_parameters(noise: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """R: vectors of classes as context (the last stands before a text's beginning), Q: as outcome, C: a matrix for each of the two places, b: biases."""
    rng = np.random.default_rng(seed)
    d, n = DIMENSIONS, len(noise)
    return {
        "R": rng.normal(0, 0.1, (n + 1, d)).astype(np.float32),
        "Q": rng.normal(0, 0.1, (n, d)).astype(np.float32),
        "C": np.stack([np.eye(d), 0.5 * np.eye(d)]).astype(np.float32),
        "b": np.log(noise).astype(np.float32),
    }


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in ("R", "Q", "C", "b")])


def unpack(v: np.ndarray) -> dict[str, np.ndarray]:
    d, out, at = DIMENSIONS, {}, 0
    n = (len(v) - 2 * d * d - d) // (2 * d + 1)
    for k, shape in (("R", (n + 1, d)), ("Q", (n, d)), ("C", (2, d, d)), ("b", (n,))):
        size = math.prod(shape)
        out[k] = v[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


class Trainer:
    """Noise-contrastive estimation by AdaGrad; the noise is the classes' unigram distribution, drawn anew for each batch and shared by its tokens."""

    def __init__(self, p: dict[str, np.ndarray], noise: np.ndarray, seed: int):
        self.p, self.noise = {k: v.copy() for k, v in p.items()}, noise
        self.log_kp = np.log(noise * NOISE).astype(np.float32)
        self.cdf = np.cumsum(noise)
        self.rng = np.random.default_rng(seed)
        self.squares = {k: np.full_like(v, 0.1) for k, v in p.items()}
        self.seen, self.n = 0, len(noise)

    def _scatter(self, index: np.ndarray, grad: np.ndarray, rows: int) -> np.ndarray:
        d = grad.shape[1]
        flat = (index[:, None] * d + np.arange(d)).ravel()
        return np.bincount(flat, weights=grad.ravel(), minlength=rows * d).reshape(rows, d).astype(np.float32)

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        """one, two: the classes one and two tokens before each target."""
        p, n = self.p, len(target)
        draw = np.minimum(np.searchsorted(self.cdf, self.rng.random(NOISE)), self.n - 1)
        e1, e2 = p["R"][one], p["R"][two]
        r = e1 @ p["C"][0] + e2 @ p["C"][1]
        q, qn = p["Q"][target], p["Q"][draw]
        st = np.einsum("ij,ij->i", r, q) + p["b"][target] - self.log_kp[target]
        sn = r @ qn.T + p["b"][draw] - self.log_kp[draw]
        gt = 1 / (1 + np.exp(np.clip(st, -30, 30)))
        gn = -1 / (1 + np.exp(np.clip(-sn, -30, 30)))
        dr = gt[:, None] * q + gn @ qn
        grads = {
            "R": self._scatter(one, dr @ p["C"][0].T, self.n + 1) + self._scatter(two, dr @ p["C"][1].T, self.n + 1),
            "Q": self._scatter(target, gt[:, None] * r, self.n) + self._scatter(draw, gn.T @ r, self.n),
            "C": np.stack([e1.T @ dr, e2.T @ dr]),
            "b": (np.bincount(target, weights=gt, minlength=self.n) + np.bincount(draw, weights=gn.sum(axis=0), minlength=self.n)).astype(np.float32),
        }
        for k, g in grads.items():
            g = g / np.float32(math.sqrt(n))
            self.squares[k] += g * g
            p[k] += np.float32(RATE) * g / np.sqrt(self.squares[k])
        self.seen += n

    def fit(self, classes: np.ndarray, first: np.ndarray) -> None:
        """classes of consecutive tokens; first: where in its run each token is (0: it begins the run)."""
        one, two = before(classes, first, self.n)
        for a in range(0, len(classes), BATCH):
            self.step(one[a : a + BATCH], two[a : a + BATCH], classes[a : a + BATCH])


def before(classes: np.ndarray, place: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two tokens before each token; `begin` before a text's first."""
    one, two = np.full(len(classes), begin), np.full(len(classes), begin)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    one[place == 0] = begin
    two[place < 2] = begin
    return one, two


def log_normalisers(p: dict[str, np.ndarray], one: np.ndarray) -> np.ndarray:
    """For each of the classes `one` before, and every class two before (a column each), the log of the context's normaliser, from batched matrix products."""
    b = p["R"] @ p["C"][1]
    z = np.empty((len(one), len(b)), dtype=np.float32)
    for k, x in enumerate(p["R"][one] @ p["C"][0]):
        s = (x + b) @ p["Q"].T + p["b"]
        m = s.max(axis=1)
        z[k] = m + np.log(np.exp(s - m[:, None]).sum(axis=1))
    return z


def normalisers(spark: SparkSession, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A, B, z): A[one] + B[two] is a context's vector, z[one, two] the log of its normaliser, whose rows are worked out by tasks."""
    shared = spark.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in log_normalisers(shared.value, one)], pa.binary())], ["id", "z"])

    n = len(p["R"])
    rows = sorted(spark.range(0, n, numPartitions=min(n, 12)).mapInArrow(run, "id long, z binary").collect(), key=lambda r: r.id)
    return p["R"] @ p["C"][0], p["R"] @ p["C"][1], np.stack([np.frombuffer(r.z, np.float32) for r in rows])


@dataclass
class Frequent:
    """The words that travel to the tasks: by hash, their class in the model (-1: a rare word's) and count; head: classes that are one word."""

    table: Table
    counts: np.ndarray
    classes: np.ndarray
    head: int

    def find(self, h: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1, class) of tokens."""
        at = self.table.get(h, -1)
        known = at >= 0
        c, cls = np.full(len(h), -1, dtype=np.int64), self.head + rare
        c[known] = self.counts[at[known]]
        own = self.classes[at[known]]
        cls[known] = np.where(own >= 0, own, cls[known])
        return c, cls


def _frequent(counts: DataFrame, head: int) -> Frequent:
    """The most frequent words, FREQUENT at most: all with at least the least count for which they are so few."""
    bins = counts.groupBy(F.floor(F.log("c") * 16).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    least, total = 1 << 62, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        total += r["n"]
        if total > FREQUENT:
            break
        least = r["least"]
    got = columns(counts.where(F.col("c") >= least).select("h", "c"))
    h, c = got["h"].view(np.uint64), got["c"]
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    classes = np.full(len(h), -1)
    classes[:head] = np.arange(min(head, len(h)))
    return Frequent(Table(h, np.arange(len(h))), c, classes, head)


def _classes(texts: list[bytes], frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """(classes of all tokens, number of each text's)."""
    h, rare, doc = _tokens(texts)
    return frequent.find(h, rare)[1], np.bincount(doc, minlength=len(texts))


def _places(sizes: np.ndarray) -> np.ndarray:
    """The place in its text, up to 2, of each token of texts of these sizes."""
    return np.minimum(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), 2)


def _average(vectors: DataFrame) -> np.ndarray | None:
    """The mean of (shard, weight, v) rows, v being packed parameters, by a tree whose groups are _FAN_IN shards, added up in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, weight = None, None, 0.0

        def mean() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["shard", "weight", "v"])

        for batch in batches:
            for own, _, n, v in zip(*(c.to_pylist() for c in batch.columns)):
                if group is not None and own != group:
                    yield mean()
                x = np.frombuffer(v, np.float32).astype(np.float64) * n
                total, weight = (x, n) if own != group else (total + x, weight + n)
                group = own
        if group is not None:
            yield mean()

    level = cut(vectors)
    while level.count() > _FAN_IN:
        grouped = level.select(F.floor(F.col("shard") / _FAN_IN).alias("group"), "shard", "weight", "v")
        level = cut(grouped.repartition("group").sortWithinPartitions("group", "shard").mapInArrow(run, "shard long, weight double, v binary"))
    rows = sorted(level.collect(), key=lambda r: r.shard)
    if not rows:
        return None
    total = sum(r.weight for r in rows)
    return sum(np.frombuffer(r.v, np.float32).astype(np.float64) * (r.weight / total) for r in rows).astype(np.float32)


def train(training: DataFrame, frequent: Frequent, noise: np.ndarray, tokens: int) -> dict[str, np.ndarray]:
    """Parameters from the training rows (doc_id, text), the same for the same rows in any order and any partitions."""
    spark = training.sparkSession
    known = spark.sparkContext.broadcast(frequent)

    def classes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            cls, sizes = _classes(blobs(batch), known.value)
            ends = np.cumsum(sizes)
            data = [cls[b - n : b].astype("<u2").tobytes() for b, n in zip(ends, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["key", "cls"])

    texts = training.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(classes_of, "key long, cls binary")
    shards = max(1, math.ceil(tokens / SHARD_TOKENS))
    number = F.pmod(F.shiftright("key", 20), F.lit(shards)).alias("shard")
    p = start_parameters(noise)
    share = min(1.0, WARM_WORDS / max(tokens, 1))
    drawn = (F.pmod("key", F.lit(1 << 20)) < int(share * (1 << 20)) + 1) & (F.octet_length("cls") <= WARM_WORDS // 5)
    rows = sorted((r.key, bytes(r.cls)) for r in texts.where(drawn).collect())
    if rows:
        cls = np.frombuffer(b"".join(x for _, x in rows), "<u2").astype(np.int64)
        place = _places(np.array([len(x) // 2 for _, x in rows]))
        warm = Trainer(p, noise, seed=1)
        for _ in range(WARM_PASSES):
            warm.fit(cls, place)
        p = warm.p
    start = spark.sparkContext.broadcast(pack(p))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, held, size = None, None, [], 0

        def learned() -> pa.RecordBatch:
            teach()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([float(own.seen)]), pa.array([pack(own.p).tobytes()], pa.binary())], ["shard", "weight", "v"])

        def teach() -> None:
            nonlocal held, size
            if held:
                own.fit(np.frombuffer(b"".join(held), "<u2").astype(np.int64), _places(np.array([len(x) // 2 for x in held])))
            held, size = [], 0

        for batch in batches:
            for number, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != shard:
                    if own is not None:
                        yield learned()
                    shard, own = number, Trainer(unpack(start.value), noise, seed=2)
                held.append(x)
                size += len(x)
                # A step's texts are those that make it up, whatever batch they came in.
                if size >= 16 * BATCH:
                    teach()
        if own is not None:
            yield learned()

    spread = texts.select(number, "key", "cls").repartition("shard").sortWithinPartitions("shard", "key", "cls").select("shard", "cls")
    mean = _average(spread.mapInArrow(follow, "shard long, weight double, v binary"))
    return p if mean is None else unpack(mean)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    held_out: crc32 of doc_id as text (null: empty) modulo 5 is 1; the other rows are learned from. Null texts are empty: an end alone. With
    no training rows all counts are zero and every token's base probability is one. The result doesn't hang on order or partitions. Repeated rows count as often as they occur.
    Further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = small_batches(docs).select("doc_id", "text")
    out_of = held_out(F.col("doc_id"), 1)
    training = docs.where(~out_of)
    counts = cut(count_tokens(training))
    by_class = counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    total, distinct = sum(r.n for r in by_class), sum(r.v for r in by_class)
    outputs = outputs_of(distinct)
    head = outputs - CLASSES
    frequent = _frequent(counts, head)
    # Rare classes hold what is left of their words once the head words are taken out.
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        n_class[r.cls], v_class[r.cls] = r.n, r.v
    own = frequent.classes >= 0
    if own.any():
        heads = columns(counts.where(F.col("c") >= int(frequent.counts[own].min())).select("h", "cls", "c"))
        at = frequent.table.get(heads["h"].view(np.uint64), -1)
        took = (at >= 0) & (frequent.classes[at] >= 0)
        np.subtract.at(n_class, heads["cls"][took], heads["c"][took])
        np.subtract.at(v_class, heads["cls"][took], 1)
    mass = np.concatenate([np.zeros(head), n_class + 1.0])
    mass[: int(own.sum())] += frequent.counts[own] + 1.0
    noise = np.maximum(mass, 0.5) / np.maximum(mass, 0.5).sum()
    p = train(training, frequent, noise, total)
    a, b, z = normalisers(spark, p)
    model = spark.sparkContext.broadcast((a, b, z, p["Q"], p["b"]))
    known = spark.sparkContext.broadcast(frequent)
    within = -np.log10(n_class + 0.5 * (v_class + 1))
    ln10 = math.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, z, q, bias = model.value
        number = TaskContext.get().partitionId() << 33
        for batch in text_chunks(batches):
            n = batch.num_rows
            h, rare, doc = _tokens(blobs(batch))
            c, cls = known.value.find(h, rare)
            begins = np.searchsorted(doc, np.arange(n))
            one, two = before(cls, np.arange(len(doc)) - begins[doc], outputs)
            logp = np.empty(len(cls))
            for x in range(0, len(cls), 200_000):
                i, j, t = one[x : x + 200_000], two[x : x + 200_000], cls[x : x + 200_000]
                logp[x : x + 200_000] = np.einsum("ij,ij->i", a[i] + b[j], q[t]) + bias[t] - z[i, j]
            logp /= ln10
            apart = cls >= head
            logp[apart] += within[cls[apart] - head]
            logc = np.log10(np.where(c >= 0, c, 0) + 0.5)
            logc[c < 0] = 0
            sums = [np.bincount(doc, weights=x, minlength=n) for x in (np.ones(len(doc)), c >= 0, logc, logp + np.where(apart, logc, 0))]
            ids = number + np.arange(n)
            number += n
            # A rare word's count comes by a join: one row for each text and word.
            left = np.flatnonzero(c < 0)
            key = words.mix(doc[left].astype(np.uint64)) ^ h[left]
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(key[order].view(np.int64)) != 0])) if len(left) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(left)))
            word = left[order[first]]
            m = len(word)
            kind = lambda x, y, t: pa.array(np.concatenate([x, y]).astype(t))
            yield pa.RecordBatch.from_arrays(
                [
                    kind(ids, ids[doc[word]], np.int64), pa.concat_arrays([batch.column(0), pa.nulls(m, batch.column(0).type)]),
                    kind(ids, h[word].view(np.int64), np.int64), kind(np.zeros(n), np.ones(m), np.int32), kind(np.ones(n), times, np.int64),
                    kind(sums[0], np.zeros(m), np.int64), kind(sums[1], np.zeros(m), np.int64), kind(sums[2], np.zeros(m), np.float64), kind(sums[3], np.zeros(m), np.float64),
                ],
                ["row", "doc_id", "h", "rare", "times", "tokens", "known", "logc", "logp"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.mapInArrow(run, f"row long, doc_id {kind}, h long, rare int, times long, tokens long, known long, logc double, logp double")
    joined = parts.join(counts.select("h", "c", F.lit(1).alias("rare")), ["h", "rare"], "left")
    logc = F.when(F.col("rare") == 1, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).otherwise(0.0)
    whole = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("tokens").alias("n_tokens"), F.sum(F.col("known") + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("logc") + logc).alias("logc"), F.sum(F.col("logp") + logc).alias("score"),
    )
    base = F.col("logc") - F.col("n_tokens") * math.log10(total + 0.5 * (distinct + 1))
    return whole.select("doc_id", out_of.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
