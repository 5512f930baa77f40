"""Splits, budgets, windows and masks (P1-P16, W3-W7). Draws are functions of stable ids, so that they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import config as c
from quarry.functions import text as X
from quarry.operators.ranks import range_of, with_places


def strided_split(docs: DataFrame, by: str, order: str = "doc_id", stride: int = c.VAL_STRIDE) -> DataFrame:
    """Split is 'val' for the last of every `stride` documents of a group, in (numeric) order, else 'train'."""
    placed = with_places(docs, by, [order], range_of(docs, order))
    return placed.withColumn("split", F.when(F.col("place") % stride == stride - 1, "val").otherwise("train")).drop("place", "before")


def proportional_budget(docs: DataFrame, budget: int, by: str = "source", least: int = c.MIN_FILE_BYTES) -> DataFrame:
    """(group, size, share, keep_prob): a group's part of the budget, and the chance with which its documents are kept (three times as many as needed, at most all)."""
    sizes = docs.groupBy(by).agg(F.sum(F.length("text")).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    share = F.floor(F.lit(budget) * F.col("size") / F.col("total"))
    rows = sizes.crossJoin(F.broadcast(total)).where(F.col("size") >= least).select(by, "size", share.alias("share"))
    return rows.withColumn("keep_prob", F.least(F.lit(1.0), 3 * F.col("share") / F.col("size")))


def budget_sample(docs: DataFrame, budget: int, by: str = "source", seed: str = "sample") -> DataFrame:
    """From each group documents that their draw keeps, in order, until the group's share is reached (the one that reaches it included)."""
    kept = docs.join(proportional_budget(docs, budget, by), by).where(X.draw(F.col("doc_id").cast("string"), F.lit(seed)) <= F.col("keep_prob"))
    placed = with_places(kept, by, ["doc_id"], range_of(docs, "doc_id"), F.length("text"))
    return placed.where("before < share").drop("size", "share", "keep_prob", "place")


def shuffled(docs: DataFrame, seed: str) -> Column:
    """A sort key that shuffles by id."""
    return F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(seed)))


def shuffled_places(docs: DataFrame, by: str, seed: str) -> DataFrame:
    """Docs with place, from 1, in the group's shuffled order. The key is even, so that its first digits make the ranges."""
    keyed = docs.withColumn("_key", shuffled(docs, seed))
    placed = with_places(keyed, by, ["_key"], F.conv(F.substring("_key", 1, 2), 16, 10).cast("int"))
    return placed.withColumn("place", F.col("place") + 1).drop("_key", "before")


def stream_offsets(docs: DataFrame, by: str, size: Column) -> DataFrame:
    """P10: docs with a, the sum of `size` of all before, by group and then doc_id."""
    placed = with_places(docs, by, ["doc_id"], range_of(docs, "doc_id"), size)
    sizes = docs.groupBy(by).agg(F.sum(size).alias("m"))
    # As many rows as there are groups.
    ahead = with_places(sizes, None, [by], F.lit(0), F.col("m")).select(F.col(by).alias("_by"), F.col("before").alias("ahead"))
    return placed.join(ahead, F.col(by).eqNullSafe(F.col("_by"))).withColumn("a", F.col("ahead") + F.col("before")).drop("_by", "ahead", "before", "place")


def slice_chunks(total: int, chunk: int, chunks: int = 100) -> list[tuple[int, int]]:
    """P10: (start, stop) of `chunks` evenly spaced runs of `chunk` tokens of a stream of `total`."""
    last = max(total - chunk, 0)
    n = max(min(chunks, total // max(chunk, 1)), 1)
    return [(int(i * last / (n - 1)) if n > 1 else 0, (int(i * last / (n - 1)) if n > 1 else 0) + min(chunk, total)) for i in range(n)]


def window_starts(length: Column, block: int, windows: int) -> Column:
    """`windows` evenly spaced starts in a stream of `length` tokens, for blocks of `block` and one target after."""
    last = F.greatest(length - block - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: (i * last / F.lit(max(windows - 1, 1))).cast("bigint"))


def shifted(tokens: Column, start: Column, block: int) -> Column:
    """(x, y): a block of tokens and the same block one later."""
    return F.struct(F.slice(tokens, (start + 1).cast("int"), F.lit(block)).alias("x"), F.slice(tokens, (start + 2).cast("int"), F.lit(block)).alias("y"))


def random_windows(streams: DataFrame, block: int, windows: int, seed: str = "batch", mask: bool = False) -> DataFrame:
    """(doc_id, i, start, x, y, m) of streams (doc_id, tokens, and mask if asked for): `windows` drawn blocks of each stream of more than `block` + 1 tokens, and the same one later.

    A start is uniform below size - block - 1, and hangs on id, number and seed alone. m is the mask under y, the targets; a stream whose mask isn't as long as its tokens fails.
    """
    hi = F.size("tokens") - block - 1
    at = F.floor(X.draw(F.col("doc_id").cast("string"), F.col("i").cast("string"), F.lit(seed)) * hi).cast("int")
    drawn = streams.where(hi > 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(windows - 1)))).withColumn("start", at)
    part = lambda k, ahead: F.slice(k, F.col("start") + 1 + ahead, F.lit(block))
    same = F.when(F.size("mask") == F.size("tokens"), part("mask", 1)).otherwise(F.raise_error(F.lit("mask and tokens differ in length"))) if mask else None
    return drawn.select("doc_id", "i", "start", part("tokens", 0).alias("x"), part("tokens", 1).alias("y"), *([same.alias("m")] if mask else []))


def replay_windows(own: DataFrame, other: DataFrame, block: int, windows: int, probability: float, seed: str = "replay") -> DataFrame:
    """(seq, replayed, x, y): `windows` sequences, each wholly of `other` with this probability, else of `own` (stream_id from 0 without gaps, tokens).

    A sequence draws its corpus, then a stream of it, then a start; the streams are met by equi-joins on their numbers.
    """
    if not 0 <= probability <= 1:
        raise ValueError("probability must lie between 0 and 1")
    spark = own.sparkSession
    text = F.col("id").cast("string")
    seqs = spark.range(windows).select(F.col("id").alias("seq"), (X.draw(text, F.lit("corpus"), F.lit(seed)) < probability).alias("replayed"), X.draw(text, F.lit("stream"), F.lit(seed)).alias("d"), X.draw(text, F.lit("start"), F.lit(seed)).alias("e"))

    def drawn(streams: DataFrame, replayed: bool) -> DataFrame:
        long = streams.where(F.size("tokens") > block + 1)
        n = streams.agg(F.count("*")).first()[0]
        asked = seqs.where(F.col("replayed") == replayed).withColumn("stream_id", F.floor(F.col("d") * n).cast("long"))
        start = F.floor(F.col("e") * (F.size("tokens") - block - 1)).cast("int")
        met = asked.join(long, "stream_id").withColumn("start", start)
        return met.select("seq", "replayed", F.slice("tokens", F.col("start") + 1, F.lit(block)).alias("x"), F.slice("tokens", F.col("start") + 2, F.lit(block)).alias("y"))

    return drawn(own, False).union(drawn(other, True))


def first_to_budget(docs: DataFrame, budget: int) -> DataFrame:
    """Documents with something in them, by doc_id, until their characters reach the budget; the one that reaches it is taken."""
    some = docs.where(F.trim("text") != "")
    return with_places(some, None, ["doc_id"], range_of(some, "doc_id"), F.length("text")).where(F.col("before") < budget).drop("place")


def replay_probability(target: float, share: float) -> float:
    """How often to draw from the replayed corpus so that `target` of the scored tokens are the new corpus's, of whose tokens `share` are scored."""
    if not 0 < target < 1 or not 0 < share <= 1:
        raise ValueError("target must lie between 0 and 1, share be above 0 and at most 1")
    return 1 - target / (share * (1 - target) + target)


def learning_rate(step: Column, warm: int, total: int, top: float, least: float) -> Column:
    """Linear up to `warm`, a cosine down to `least` at `total`, flat after."""
    part = (step - warm) / F.lit(float(max(total - warm, 1)))
    return F.when(step < warm, top * (step + 1) / F.lit(float(warm))).when(step > total, F.lit(least)).otherwise(least + 0.5 * (1 + F.cos(part * F.pi())) * (top - least))


def masked_mean(loss: Column, mask: Column) -> Column:
    """An aggregate: the mean loss under the mask, 0 where it is empty."""
    return F.coalesce(F.sum(loss * mask) / F.nullif(F.sum(mask), F.lit(0)), F.lit(0.0))


def word_ids(text: Column, vocabulary: int = 50_000) -> Column:
    """P6's stand-in tokenizer: each token a number from 2 on, by its MD5; an end (1) after each text."""
    ids = F.transform(X.raw_tokens(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % (vocabulary - 2) + 2).cast("int"))
    return F.concat(ids, F.array(F.lit(c.EOS)))


def sft_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n_prompt, n_answer, tokens, mask): each assistant turn as an example; the mask is 0 over all said before, 1 over the answer and its end."""
    before = F.concat_ws("\n", F.collect_list(F.concat(F.initcap("role"), F.lit(": "), F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)))
    asked = turns.withColumn("prompt", F.concat(before, F.lit("\nAssistant:"))).where("role = 'assistant'")
    p, a = X.raw_tokens(F.col("prompt")), X.raw_tokens(F.col("text"))
    sized = asked.select("conv_id", "turn", F.size(p).alias("n_prompt"), (F.size(a) + 1).alias("n_answer"), F.concat(p, a).alias("tokens"))
    return sized.withColumn("mask", F.concat(F.array_repeat(F.lit(0), F.col("n_prompt")), F.array_repeat(F.lit(1), F.col("n_answer"))))
