"""Audits and scans of crawled and generated texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X

LOOP_TOKENS, LOOP_TIMES = 8, 3
MIN_REMOTE, LEAST_SHARE = 20_000, 0.4
# Words that name a row of a list.
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "1st": 1, "2nd": 2, "3rd": 3, "4th": 4, "5th": 5, "6th": 6, "7th": 7, "8th": 8}


def size_audit(remote: DataFrame, local: DataFrame, min_remote: int = MIN_REMOTE, share: float = LEAST_SHARE) -> DataFrame:
    """(title, remote, local) of remote (title, size) that are large and whose best local copy (title, size) holds less than `share` of them."""
    best = local.groupBy("title").agg(F.max("size").alias("local"))
    rows = remote.where(F.col("size") >= min_remote).join(best, "title", "left").select("title", F.col("size").alias("remote"), F.coalesce("local", F.lit(0)).cast("long").alias("local"))
    return rows.where(F.col("local") < share * F.col("remote"))


def loops(tokens: Column) -> Column:
    """The last LOOP_TOKENS tokens occur LOOP_TIMES times or more, overlaps counted."""
    n = F.size(tokens)
    tail = F.slice(tokens, n - LOOP_TOKENS + 1, F.lit(LOOP_TOKENS))
    seen = F.size(F.filter(F.sequence(F.lit(1), n - LOOP_TOKENS + 1), lambda i: F.slice(tokens, i, F.lit(LOOP_TOKENS)) == tail))
    return F.when(n < LOOP_TOKENS, F.lit(False)).otherwise(seen >= LOOP_TIMES)


def image_name(wikitext: Column) -> Column:
    """The first image field's value, '' if there is none or it is 200 characters or longer."""
    name = F.trim(F.regexp_extract(wikitext, r"(?m)^\|\s*Image1?\s*=[ \t]*(\S[^\n]*)$", 1))
    return F.when(F.length(name) < 200, name).otherwise(F.lit(""))


def sample_lines(docs: DataFrame) -> DataFrame:
    """K6: (doc_id, line) of every line with something on it, trimmed: what a tokenizer is trained from."""
    return docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")


def row_reference(text: Column) -> Column:
    """The row of a list that a reply names by a number or ordinal, if it names one alone; null otherwise."""
    words = X.raw_tokens(text)
    at = F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in kv])
    named = F.filter(F.transform(words, lambda w: F.coalesce(F.try_element_at(at, w), F.when(w.rlike(r"^\d{1,2}$"), w.cast("int")))), lambda x: x.isNotNull())
    return F.when(F.size(named) == 1, F.get(named, F.lit(0)))
