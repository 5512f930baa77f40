"""What a question that names nothing may have meant: unknown words replaced by known ones that look alike.

Only questions that resolve to nothing get here. A misspelt word meets known words of nearly its length that share a pair of letters with it, by equi-joins; the
similarity itself (Ratcliff and Obershelp's) has no built-in form and is computed by an Arrow function over those pairs alone.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarry.functions import text as X

SIMILAR, MATCHES, MAX_UNKNOWN, LENGTH_BAND = 0.8, 8, 2, 2


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)])


def _pairs(df: DataFrame, word: str) -> DataFrame:
    """Each word with its letter pairs, first and last marked."""
    padded = F.concat(F.lit("^"), F.col(word), F.lit("$"))
    return df.select(word, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: padded.substr(i, F.lit(2))))).alias("pair"))


def similar_words(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """(word, term, ratio, rnk): for each of unknown (word) the up to MATCHES terms of known (term) that are at least SIMILAR; ties by the later word.

    A ratio of SIMILAR leaves at most LENGTH_BAND letters' difference in words of up to ten letters and always a shared pair of letters, ends counted.
    """
    near = F.abs(F.length("word") - F.length("term")) <= F.greatest(F.lit(LENGTH_BAND), F.floor(F.length("word") / 4).cast("int"))
    met = _pairs(unknown.distinct(), "word").join(_pairs(known.distinct(), "term"), "pair").where(near).select("word", "term").distinct()
    scored = met.withColumn("ratio", _ratio("word", "term")).where(F.col("ratio") >= SIMILAR)
    order = Window.partitionBy("word").orderBy(F.desc("ratio"), F.desc("term"))
    return scored.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= MATCHES)


def corrections(questions: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, corrected): questions (qid, question) with one or two unknown words, each replaced by its best known look-alike; the rest has no row."""
    key = questions.select("qid", X.query_key_or_all(F.col("question")).alias("key"))
    words = key.select("qid", F.posexplode("key").alias("i", "word"))
    lost = words.join(known.select(F.col("term").alias("word")).distinct(), "word", "left_anti")
    few = lost.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") <= MAX_UNKNOWN)
    best = similar_words(lost.select("word"), known).where("rnk = 1").select("word", "term")
    fixed = words.join(few, "qid").join(best, "word", "left").withColumn("lost", F.lit(False))
    gone = lost.select("qid", "i", F.lit(True).alias("is_lost"))
    marked = fixed.join(gone, ["qid", "i"], "left").where("is_lost is null or term is not null")
    whole = marked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("is_lost"), F.col("term")).otherwise(F.col("word")).alias("w")))).alias("ws"), F.count("*").alias("m"))
    return whole.join(key.select("qid", F.size("key").alias("k")), "qid").where("m = k").select("qid", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("corrected"))


def typo_probes(words: DataFrame) -> DataFrame:
    """(word, kind, typo): each word with its middle letter dropped, doubled, and exchanged with the next."""
    mid = (F.length("word") / 2).cast("int")
    a, b = F.substring("word", F.lit(1), mid), F.substring(F.col("word"), mid + 1, F.length("word"))
    one, rest = F.substring(b, 1, 1), F.substring(b, F.lit(2), F.length(b))
    kinds = {"drop": F.concat(a, rest), "double": F.concat(a, one, b), "swap": F.concat(a, F.substring(rest, 1, 1), one, F.substring(rest, F.lit(2), F.length(rest)))}
    return words.where("length(word) > 4").select("word", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("typo")) for k, v in kinds.items()])).alias("p")).select("word", "p.kind", "p.typo").where("typo <> word")
