"""Registered queries over sessions, examples, curation and spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import examples as E
from quarry.operators import spell
from quarry.operators.curate import curate
from quarry.plans import name_plans
from quarry.plans import sql as Q
from quarry.streaming import ingest, session


def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn is about: the first capitalised long word of the last user turn that has one."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    named = F.nullif(F.regexp_extract("text", r"([A-Z][a-z]{7,})", 1), F.lit(""))
    return session.replay(t.select("conv_id", "turn", F.when(F.col("role") == "user", named).alias("named")))


def progress_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return ingest.progress(e).select(F.unix_micros("start").alias("start_us"), "total", "failed")


def sft_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.qa_pairs(name_plans.customer_records(spark, sf_dir)).unionByName(E.open_ended(name_plans.customer_records(spark, sf_dir)))


def sft_examples_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = name_plans.customer_records(spark, sf_dir).withColumn("grp", F.col("doc_id") % 7)
    return E.mix_report(E.dataset(records, "grp"))


def decoy_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = name_plans.customer_records(spark, sf_dir).withColumn("grp", F.col("doc_id") % 7)
    return E.decoy_context(records, "grp").select("doc_id", "other_id", F.length("context").cast("long").alias("n_chars"))


def curated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1-C17 over pages made into wiki markup: a template of nested links, and the page's whole text as its history."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    words = X.raw_tokens(X.strip_html(F.col("html")))
    w = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit("x"))
    wiki = F.concat(
        F.lit("{{Some Template\n| CurrentAlias = "), w(0), F.lit("\n| Creators = [[A|"), w(1), F.lit("]]; {{m|x|"), w(2), F.lit("}}\n| Reality = 6160\n| Powers = * [["), w(3), F.lit("]]<ref>no</ref>\n* '''"), w(4),
        F.lit("'''\n}}\n[[Category:Filed]]\n== History ==\n"), F.array_join(words, " "), F.lit(" [[File:x.png|thumb|a [[b]] c]]\n"),
    )
    return curate(p.select(F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), wiki.alias("wikitext")))


def typo_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spell.typo_probes(_names(spark, sf_dir))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(X.raw_tokens(F.col("p_name"))).alias("word")).distinct()


def spell_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = typo_probes(spark, sf_dir).select(F.concat_ws(":", "word", "kind").alias("qid"), F.col("typo").alias("question"))
    return spell.corrections(probes, _names(spark, sf_dir).select(F.col("word").alias("term")))


QUERIES = {f.__name__: f for f in (session_replay, progress_windows, sft_examples, sft_examples_mix, decoy_context, curated_pages, typo_probes, spell_corrections)}

_FIELDS = """WITH rec AS (SELECT c_custkey AS doc_id, c_name, CASE WHEN c_custkey % 3 > 0 THEN n_name || ' and ' || r_name ELSE '' END AS created,
 'Comics Vol 1 5, ' || lower(c_mktsegment) || ', Formerly: and ' || lower(r_name) || ' Category: x' AS powers, lower(c_mktsegment) AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),"""
_EXAMPLES = f"""{name_plans._RECORDS}, g AS (SELECT *, replace(created, '; ', ' and ') AS made, 'Comics Vol 1 5, ' || seg || ', Formerly: and ' || reg || ' Category: x' AS pow, {Q.draw("doc_id::VARCHAR", "'gate-qa'", "'qa'")} < {E.GATES["qa"]} AS qa,
   {Q.draw("doc_id::VARCHAR", "'gate-open'", "'qa'")} < {E.GATES["open"]} AS op, {Q.draw("doc_id::VARCHAR", "'gate-unknown'", "'qa'")} < {E.GATES["unknown"]} AS un FROM rec),
 ex AS (SELECT doc_id, 'qa' AS kind, 'Who created ' || c_name || '?' AS user, c_name || ' was created by ' || made || '.' AS assistant FROM g WHERE qa AND created <> ''
   UNION ALL SELECT doc_id, 'qa', 'What can ' || c_name || ' do?', c_name || ' has these powers: ' || pow || '.' FROM g WHERE qa UNION ALL SELECT doc_id, 'qa', 'What does ' || c_name || ' work as?', c_name || ' works as ' || seg || '.' FROM g WHERE qa
   UNION ALL SELECT doc_id, 'open', 'Who is ' || c_name || '?', c_name || ' - ' || CASE WHEN created <> '' THEN 'created by: ' || made || '; ' ELSE '' END || 'powers: ' || pow || '; occupation: ' || seg || '.' FROM g WHERE op)"""

ORACLES = {
    "sft_examples": f"WITH {_EXAMPLES} SELECT * FROM ex",
    "sft_examples_mix": f"""WITH {_EXAMPLES}, un AS (SELECT count(*) AS n FROM (SELECT un, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) AS p FROM g) WHERE un AND p > 1),
 k AS (SELECT kind, count(*) AS n FROM ex GROUP BY kind UNION ALL SELECT 'unknown', n FROM un WHERE n > 0) SELECT kind, n, round(n / sum(n) OVER (), 9) AS share FROM k""",
    "session_replay": r"""SELECT conv_id, turn, last_value(named IGNORE NULLS) OVER w AS about, named IS NOT NULL AS fresh, least(20, count(*) OVER w)::INTEGER AS turns_kept
 FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN nullif(regexp_extract(text, '([A-Z][a-z]{7,})', 1), '') END AS named FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "progress_windows": "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1",
    "typo_probes": r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS word FROM part), m AS (SELECT word, length(word) // 2 AS k FROM w WHERE length(word) > 4)
 SELECT * FROM (SELECT word, 'drop' AS kind, left(word, k) || substr(word, k + 2) AS typo FROM m UNION ALL SELECT word, 'double', left(word, k) || substr(word, k + 1, 1) || substr(word, k + 1) FROM m
 UNION ALL SELECT word, 'swap', left(word, k) || substr(word, k + 2, 1) || substr(word, k + 1, 1) || substr(word, k + 3) FROM m) WHERE typo <> word""",
    "decoy_context": f"""{_FIELDS} txt AS (SELECT doc_id, doc_id % 7 AS grp, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) AS p FROM rec),
 sized AS (SELECT c_custkey AS doc_id, length(c_name) * 2 + 7 + CASE WHEN c_custkey % 3 > 0 THEN 15 + length(n_name) + length(r_name) ELSE 0 END + 9 + 16 + length(c_mktsegment) + 14 + length(r_name) + 12 + 13 + length(c_mktsegment) + 26 AS n
   FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 q AS (SELECT *, p - 1 - floor({Q.draw("doc_id::VARCHAR", "'decoy'")} * least(300, p - 1))::BIGINT AS o FROM txt WHERE p > 1)
 SELECT q.doc_id, t.doc_id AS other_id, (a.n + CASE WHEN least(b.n, greatest(0, 2400 - a.n)) = 0 THEN 0 ELSE 2 + least(b.n, greatest(0, 2400 - a.n)) END)::BIGINT AS n_chars
 FROM q JOIN txt t ON t.grp = q.grp AND t.p = q.o JOIN sized a ON a.doc_id = q.doc_id JOIN sized b ON b.doc_id = t.doc_id""",
}
