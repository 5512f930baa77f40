"""Exact deduplication of documents, paragraphs and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config as c
from quarry.functions import text as X


def content_key(text: Column) -> Column:
    return F.sha1(X.normal_space(text))


def dedupe_documents(docs: DataFrame, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The first document of each text (white space apart), in `order`.

    First places come from an aggregate with partial sums, not a window, so that a text which a third of all documents share is no hot group.
    """
    key = docs.withColumn("_key", content_key(F.col("text")))
    first = key.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"))
    return key.join(first, "_key").where(F.struct(*order).eqNullSafe(F.col("_first"))).drop("_key", "_first")


def dedupe_paragraphs(docs: DataFrame, separator: str = "\n\n", least: int = c.MIN_BLOCK_CHARS) -> DataFrame:
    """(doc_id, text, kept, dropped) of docs (doc_id, text): later copies of blocks of at least `least` characters go; documents without a block left go."""
    blocks = docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("i", "block"))
    long = F.length(X.normal_space(F.col("block"))) >= least
    keyed = blocks.withColumn("_key", F.when(long, content_key(F.col("block"))))
    long_blocks = keyed.where("_key is not null")
    first = long_blocks.groupBy("_key").agg(F.min(F.struct("doc_id", "i")).alias("_first"))
    judged = long_blocks.join(first, "_key").withColumn("keep", F.struct("doc_id", "i") == F.col("_first")).select("doc_id", "i", "block", "keep")
    # Short blocks have no key and don't meet anywhere.
    marked = judged.unionByName(keyed.where("_key is null").select("doc_id", "i", "block", F.lit(True).alias("keep")))
    whole = marked.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("keep") & (F.trim("block") != ""), F.struct("i", "block")))).alias("parts"), F.sum(F.col("keep").cast("long")).alias("kept"), F.sum((~F.col("keep")).cast("long")).alias("dropped")
    )
    return whole.where(F.size("parts") > 0).select("doc_id", F.array_join(F.transform("parts", lambda p: p["block"]), separator).alias("text"), "kept", "dropped")


def biggest_of(rows: DataFrame, key: str, size: str, order: tuple[str, ...]) -> DataFrame:
    """Of rows that share a key the biggest, then the first in order; rows without a key stay."""
    columns = [F.col(f"`{x}`") for x in rows.columns]
    # Bigger first, then smaller in order: a minimum with partial aggregation, not a window over a site's pages.
    first = F.struct((-F.col(size)).alias("_s"), *[F.col(x).alias(f"_{k}") for k, x in enumerate(order)])
    named = rows.where((F.col(key).isNotNull()) & (F.col(key) != ""))
    best = named.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*columns), first).alias("row")).select("row.*")
    return best.unionByName(rows.where(F.col(key).isNull() | (F.col(key) == "")))


def dedupe_report(docs: DataFrame, group: str = "source") -> DataFrame:
    """Documents, different texts and characters of each group, and of all (group null)."""
    keyed = docs.select(group, content_key(F.col("text")).alias("k"), F.length("text").alias("n"))
    return keyed.rollup(group).agg(F.count("*").alias("docs"), F.count_distinct("k").alias("distinct_docs"), F.sum("n").alias("chars"))
