"""Registered queries over audits and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import audit as A
from quarry.plans import sql as Q
from quarry.sources.records import documents


def size_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose document of the same number is far smaller."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("title"), F.length("html").cast("long").alias("size"))
    return A.size_audit(pages, documents(spark, sf_dir).select(F.col("doc_id").alias("title"), "size"), min_remote=5000)


def loop_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", X.raw_tokens(F.col("text")).alias("t")).select("doc_id", A.loops(F.col("t")).alias("loops"))


def tokenizer_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.sample_lines(documents(spark, sf_dir))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("n_chars"))


def row_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, F.concat(F.lit("number "), F.col("p_size").cast("string"))).when(k == 1, "the second one please").when(k == 2, "the first or the third").otherwise(F.col("p_name"))
    return p.select("p_partkey", A.row_reference(said).alias("row"))


def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    wiki = F.concat(F.lit("{{X Template\n| Image = "), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat("p_name", F.lit(".jpg"))), F.lit("\n| Image1 = "), F.col("p_brand"), F.lit("\n}}"))
    return p.select("p_partkey", A.image_name(wiki).alias("file"))


QUERIES = {f.__name__: f for f in (size_audit, loop_flags, tokenizer_sample, row_references, image_names)}
ORACLES = {
    "size_audit": "SELECT page_id AS title, length(html) AS remote, coalesce(length(text), 0) AS local FROM pages LEFT JOIN documents ON doc_id = page_id WHERE length(html) >= 5000 AND coalesce(length(text), 0) < 0.4 * length(html)",
    "loop_flags": f"""WITH t AS (SELECT doc_id, {Q.raw_tokens('text')} AS t FROM documents), w AS (SELECT doc_id, len(t) AS n, i, array_to_string(t[i : i + 7], ' ') AS k FROM (SELECT doc_id, t, unnest(range(1, len(t) - 6)) AS i FROM t WHERE len(t) >= 8)),
 c AS (SELECT doc_id, count(*) AS m FROM (SELECT *, max(CASE WHEN i = n - 7 THEN k END) OVER (PARTITION BY doc_id) AS tail FROM w) WHERE k = tail GROUP BY doc_id) SELECT t.doc_id, coalesce(m >= 3, false) AS loops FROM t LEFT JOIN c USING (doc_id)""",
    "tokenizer_sample": "SELECT doc_id, count(*) AS lines, sum(length(x))::BIGINT AS n_chars FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x FROM documents) WHERE x <> '' GROUP BY doc_id",
    "row_references": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 2 END AS row FROM part",
    "image_names": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_name || '.jpg' END AS file FROM part",
}
