"""Registered queries over tokens, BM25 and headlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config as c
from quarry.functions import text as X
from quarry.operators import search as S
from quarry.plans import sql as Q
from quarry.sources.records import documents


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question): the different raw tokens of each benchmark text."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(F.col("item_id").alias("qid"), F.array_join(F.array_distinct(X.raw_tokens(F.col("text"))), " ").alias("question"))


def index(spark: SparkSession, sf_dir: str) -> S.Index:
    """The stored index of the documents table."""
    return S.stored_index(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet"))


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).docs.select("doc_id", F.col("len").alias("n_tokens"), F.col("n_terms").alias("n_distinct"))


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).terms


def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).one.select("n", F.round("avg_len", 6).alias("avg_len"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = S.top_k(S.bm25_scores(index(spark, sf_dir), questions(spark, sf_dir)).withColumn("score", F.round("score", 6)), 10)
    return top.select("qid", "rnk", "doc_id", "score")


def bm25_boosted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = S.top_k(S.boosted_scores(documents(spark, sf_dir), questions(spark, sf_dir), index(spark, sf_dir)).withColumn("score", F.round("score", 6)), 10)
    return top.select("qid", "rnk", "doc_id", "score")


def entity_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.entity_terms(index(spark, sf_dir), questions(spark, sf_dir))


def headline_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.headline_division(index(spark, sf_dir), S.entity_terms(index(spark, sf_dir), questions(spark, sf_dir)))


_QUESTIONS = f"""
questions AS (SELECT item_id AS qid, array_to_string(d, ' ') AS question
  FROM (SELECT item_id, list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda p: list_position(t, p[1]) = p[2]), lambda p: p[1]) AS d
        FROM (SELECT item_id, {Q.raw_tokens("text")} AS t FROM benchmark)))"""

_BM25 = f"""
tok AS MATERIALIZED (SELECT doc_id, {Q.tokenize("text")} AS t FROM documents),
stats AS (SELECT doc_id, len(t) AS len FROM tok),
one AS (SELECT count(*) AS n, avg(len) AS avg_len FROM stats),
posts AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
asked AS MATERIALIZED (SELECT DISTINCT qid, unnest({Q.tokenize("question")}) AS term FROM questions),
idf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM posts GROUP BY term), one),
heads AS MATERIALIZED (SELECT DISTINCT doc_id, unnest({Q.tokenize(Q.headline("text"))}) AS term FROM documents),
scores AS MATERIALIZED (SELECT qid, p.doc_id, sum(idf * tf * {c.K1 + 1} / (tf + {c.K1} * (1 - {c.B} + {c.B} * len / avg_len)) + CASE WHEN h.term IS NULL THEN 0 ELSE {c.HEADLINE_BOOST} * idf END) AS score
  FROM posts p JOIN asked USING (term) JOIN idf USING (term) JOIN stats s ON s.doc_id = p.doc_id LEFT JOIN heads h ON h.doc_id = p.doc_id AND h.term = p.term, one GROUP BY ALL)"""

_ENTITY = f"""
kept AS (SELECT qid, list_transform(CASE WHEN len(list_filter(t, lambda x: NOT list_contains({Q.words(c.QUESTION_WORDS)}, x))) > 0
    THEN list_filter(t, lambda x: NOT list_contains({Q.words(c.QUESTION_WORDS)}, x)) ELSE t END, lambda x: {Q.singular("x")}) AS t
  FROM (SELECT qid, {Q.tokenize("question")} AS t FROM questions)),
terms AS (SELECT DISTINCT qid, unnest(t) AS term FROM kept),
rare AS (SELECT qid, terms.term, coalesce(df, 0) <= {c.ENTITY_DF_RATIO} * n AS rare, count(*) OVER (PARTITION BY qid) AS k
  FROM terms LEFT JOIN (SELECT term, count(*) AS df FROM posts GROUP BY term) d ON d.term = terms.term, one),
entity AS (SELECT qid, term FROM (SELECT *, bool_or(rare) OVER (PARTITION BY qid) AS found FROM rare) WHERE k = 1 OR rare OR NOT found),
singles AS MATERIALIZED (SELECT DISTINCT doc_id, {Q.singular("term")} AS term FROM heads),
named AS (SELECT qid, doc_id, n_terms FROM (SELECT qid, doc_id, count(*) AS met FROM singles JOIN entity USING (term) GROUP BY ALL) JOIN (SELECT qid, count(*) AS n_terms FROM entity GROUP BY qid) USING (qid) WHERE met = n_terms)"""

_TOP = "SELECT qid, rnk, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rnk FROM r) WHERE rnk <= 10"

QUERIES = {f.__name__: f for f in (token_stats, term_df, doc_length_stats, bm25_topk, bm25_boosted_topk, entity_query_terms, headline_division)}
ORACLES = {
    "token_stats": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {Q.tokenize('text')} AS t FROM documents)",
    "term_df": f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({Q.tokenize('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term",
    "doc_length_stats": f"SELECT count(*) AS n, round(avg(len({Q.tokenize('text')})), 6) AS avg_len FROM documents",
    "bm25_topk": f"WITH {_QUESTIONS}, {_BM25}, r AS (SELECT qid, doc_id, round(score, 6) AS score FROM scores) {_TOP}",
    "bm25_boosted_topk": f"""WITH {_QUESTIONS}, {_BM25}, {_ENTITY},
 hs AS (SELECT d.doc_id, contains({Q.headline("text")}, '(') AS has_paren, count(s.term) AS head_len FROM documents d LEFT JOIN singles s USING (doc_id) GROUP BY ALL),
 r AS (SELECT qid, doc_id, round(score
     + CASE WHEN n_terms IS NULL THEN 0 ELSE {c.FULL_HEAD_BONUS} - {c.BREVITY_PENALTY} * greatest(0, head_len - n_terms) + {c.NOTABILITY_WEIGHT} * ln(1 + len) END
     + CASE WHEN NOT has_paren AND len(list_filter({Q.tokenize("question")}, lambda t: regexp_full_match(t, 'earth-\\d+'))) = 0 THEN {c.MAIN_CONTINUITY_BONUS} ELSE 0 END, 6) AS score
   FROM scores JOIN stats USING (doc_id) JOIN hs USING (doc_id) JOIN questions USING (qid) LEFT JOIN named USING (qid, doc_id)) {_TOP}""",
    "entity_query_terms": f"WITH {_QUESTIONS}, {_BM25}, {_ENTITY} SELECT qid, term FROM entity",
    "headline_division": f"WITH {_QUESTIONS}, {_BM25}, {_ENTITY} SELECT qid, doc_id, n_terms FROM named",
}
