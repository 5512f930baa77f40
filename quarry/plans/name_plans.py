"""Registered queries over names, resolution, answers and passages. Parts stand in for records: few names that many rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config as c
from quarry.functions import text as X
from quarry.operators import answers as A
from quarry.operators import names as N
from quarry.operators import search as S
from quarry.plans import search_plans
from quarry.plans import sql as Q
from quarry.sources import records as R


#: Parts whose claims one task gathers, about.
PARTS_OF_TASK = 50_000


def part_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims to names: a part is its name, goes by its brand, and is also known by its type."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    claim = lambda col, prov: F.transform(X.keys_of(F.col(col)), lambda k: F.struct(k.alias("name"), prov.cast("int").alias("prov")))
    page = F.col("p_size") % 3 != 0
    names = F.concat(claim("p_name", F.when(page, 2).otherwise(1)), claim("p_brand", F.lit(1)), claim("p_type", F.lit(0)))
    # Parts are dealt out by key before their names are told apart, to so many tasks that none gathers the claims of more than PARTS_OF_TASK.
    p = p.repartition(p.count() // PARTS_OF_TASK + 1, "p_partkey")
    rows = p.select(F.col("p_partkey").alias("doc_id"), F.floor(F.col("p_retailprice") * F.col("p_size")).cast("long").alias("size"), (F.col("p_partkey") % 7 == 0).alias("main"), page.alias("page"), F.explode(names).alias("n"))
    return rows.groupBy(F.col("n.name").alias("name"), "doc_id").agg(F.first("size").alias("size"), F.first("main").alias("main"), F.max("n.prov").alias("prov"), F.first("page").alias("page"))


def part_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of several shapes about suppliers' favourite parts; some words are known to no name."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 10 = 0")
    k = F.col("p_partkey") % 4
    question = F.when(k == 0, F.concat(F.lit("who created the "), "p_name")).when(k == 2, F.concat(F.lit("tell me about "), F.split("p_name", " ")[0])).otherwise(F.concat("p_name", F.lit(" zyxtha")))
    return p.select(F.col("p_partkey").alias("qid"), F.when(F.col("p_partkey") % 30 == 0, F.concat("p_name", F.lit(" and "), F.lower("p_type"))).otherwise(question).alias("question"))


def notable(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 12")
    return p.select(F.explode(X.keys_of(F.col("p_name"))).alias("name"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.name_index(part_claims(spark, sf_dir), notable(spark, sf_dir))


def name_index_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select(F.array_join("name", " ").alias("name"), "rnk", "doc_id", "size", "main", "prov", "page", "famous")


def legacy_top24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.legacy(part_claims(spark, sf_dir)).select(F.array_join("name", " ").alias("name"), "rnk", "doc_id", "prov")


def name_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retained claims of each name."""
    return _index(spark, sf_dir).groupBy("name").agg(F.count("*").alias("rivals")).select(F.array_join("name", " ").alias("name"), "rivals")


def resolve_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.resolve(_index(spark, sf_dir), part_questions(spark, sf_dir))


def resolve_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = N.confidence(_index(spark, sf_dir), part_questions(spark, sf_dir))
    return got.select("qid", F.round("confidence", 9).alias("confidence"), (F.col("confidence") < c.CONFIDENCE_TO_ASK).alias("ask"))


def variants_of_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    recs = p.select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" (Earth-"), F.col("p_size").cast("string"), F.lit(")"))).otherwise(F.col("p_name")).alias("headline"), F.floor("p_retailprice").cast("long").alias("size"))
    return N.variants(recs, part_questions(spark, sf_dir))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.documents(spark, sf_dir)
    top = S.top_k(S.bm25_scores(search_plans.index(spark, sf_dir), search_plans.questions(spark, sf_dir)).withColumn("score", F.round("score", 6)), 24)
    extra = docs.select("doc_id", "headline", F.concat_ws("|", "headline", "source").alias("identity"), (F.size(F.split("text", "\n")) - 1).alias("field_count"), F.col("size").cast("long").alias("size"))
    return F.broadcast(top).join(extra, "doc_id")


def candidates_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.candidates(_ranked(spark, sf_dir)).select("qid", "place", "doc_id", "score")


def ambiguity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.candidates(_ranked(spark, sf_dir)).where("place = 1").select("qid", "doc_id", "ambiguous")


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = S.top_k(S.bm25_scores(search_plans.index(spark, sf_dir), search_plans.questions(spark, sf_dir)).withColumn("score", F.round("score", 6)), 6)
    blocks = F.broadcast(top).join(R.documents(spark, sf_dir).select("doc_id", F.col("text").alias("block")), "doc_id")
    return A.context_blocks(blocks.select("qid", "rnk", "block")).select("qid", "n_blocks", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("context_md5"))


def passage_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of each question's three best documents."""
    top = S.top_k(S.bm25_scores(search_plans.index(spark, sf_dir), search_plans.questions(spark, sf_dir)).withColumn("score", F.round("score", 6)), 3)
    docs = R.documents(spark, sf_dir)
    asked = F.broadcast(top.join(search_plans.questions(spark, sf_dir), "qid")).join(docs, "doc_id").select(F.concat_ws("-", "qid", "rnk").alias("qid"), "question", F.lit("").alias("headline"), F.lit("").alias("page"), F.col("text").alias("body"))
    return A.passages(asked).select("qid", F.md5("passage").alias("passage_md5"))


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers rendered as fielded records."""
    cu = spark.read.parquet(f"{sf_dir}/customer.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey")).join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = lambda label, v: F.concat(F.lit(f"\n{label}: "), v)
    text = F.concat(
        "c_name", line("Page", F.col("c_name")), F.when(F.col("c_custkey") % 3 > 0, line("Created by", F.concat(F.col("n_name"), F.lit("; "), F.col("r_name")))).otherwise(F.lit("")),
        line("Powers", F.concat(F.lit("Comics Vol 1 5; "), F.lower("c_mktsegment"), F.lit("; ;Formerly:; "), F.lower("r_name"), F.lit(" Category: x"))), line("Occupation", F.lower("c_mktsegment")), F.lit("\nHistory:\nOccupation: none"),
    )
    return cu.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.profile_rows(customer_records(spark, sf_dir))


def field_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    q = F.when(k == 0, "Who created them?").when(k == 1, "what powers does it have").otherwise("what do they do for a living")
    return A.field_answers(customer_records(spark, sf_dir).select(F.col("doc_id").alias("qid"), q.alias("question"), "text"))


def humanize_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    names = n.where("n_nationkey % 5 <> 0 or n_regionkey = 0").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("v"))
    return names.select("n_regionkey", X.humanize(F.col("v")).alias("reads"))


def image_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's own image (a part of its key), else that of its customer, else none."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    images = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("title"), F.col("p_name").alias("file"))
    own, other = images.select(F.col("title").alias("t1"), F.col("file").alias("own")), images.select(F.col("title").alias("t2"), F.col("file").alias("cover"))
    return o.join(own, F.col("o_orderkey") == F.col("t1"), "left").join(other, F.col("o_custkey") == F.col("t2"), "left").select("o_orderkey", F.coalesce("own", "cover", F.lit("")).alias("file"))


def category_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within three steps of a root in a cyclic graph (a nation leads to two others), with the least depth: a frontier joined at each step."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("a"))
    edges = n.select("a", ((F.col("a") * 3 + 1) % 25).alias("b")).union(n.select("a", ((F.col("a") * 7 + 2) % 25).alias("b")))
    seen = spark.range(1).select(F.col("id").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for depth in range(1, 4):
        front = front.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.union(front)
    return seen


def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved share by kind of question, and of all."""
    q = part_questions(spark, sf_dir)
    kind = F.when(F.col("question").startswith("who"), "who").when(F.col("question").startswith("tell"), "tell").otherwise("other")
    got = q.join(resolve_batch(spark, sf_dir), "qid", "left").select(kind.alias("kind"), F.col("doc_id").isNotNull().cast("int").alias("hit"))
    return got.rollup("kind").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 9).alias("rate"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of questions that would be asked back at each threshold; the thresholds are a bounded list."""
    conf = N.confidence(_index(spark, sf_dir), part_questions(spark, sf_dir))
    marks = [1.5, 2.0, 3.0, 5.0, 8.0]
    one = conf.agg(*[F.round(F.avg((F.col("confidence") < m).cast("int")), 9).alias(f"t{k}") for k, m in enumerate(marks)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("threshold"), F.col(f"t{k}").alias("rate")) for k, m in enumerate(marks)])).alias("r")).select("r.*")


QUERIES = {
    f.__name__: f
    for f in (
        name_index_top8, legacy_top24, name_rivals, resolve_batch, resolve_confidence, variants_of_name, candidates_identity, ambiguity_flags, context_blocks, passage_select, profile_rows, field_answers, humanize_lists,
        image_chain, category_walk, eval_rollup, threshold_sweep,
    )
}

_CLAIMS = f"""raw AS (SELECT p_partkey AS doc_id, floor(p_retailprice * p_size)::BIGINT AS size, p_partkey % 7 = 0 AS main, p_size % 3 <> 0 AS page, p_name, p_brand, p_type FROM part),
 claims AS MATERIALIZED (SELECT name, doc_id, any_value(size) AS size, any_value(main) AS main, max(prov)::INTEGER AS prov, any_value(page) AS page FROM (
   SELECT {Q.norm("p_name")} AS name, doc_id, size, main, CASE WHEN page THEN 2 ELSE 1 END AS prov, page FROM raw UNION ALL SELECT {Q.norm("p_brand")}, doc_id, size, main, 1, page FROM raw
   UNION ALL SELECT {Q.norm("p_type")}, doc_id, size, main, 0, page FROM raw) WHERE len(name) > 0 GROUP BY name, doc_id)"""
_INDEX = f"""{_CLAIMS}, known AS (SELECT DISTINCT {Q.norm("p_name")} AS name, true AS known FROM part WHERE p_partkey < 12),
 r1 AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY main DESC, prov > 0 DESC, length(greatest(size, 1)::VARCHAR) DESC, prov DESC, size DESC, doc_id) AS r1 FROM claims LEFT JOIN known USING (name)),
 r2 AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page DESC, prov DESC, size DESC, main DESC, r1) AS r2 FROM r1),
 fam AS (SELECT *, coalesce(known, false) AND max(CASE WHEN r2 = 1 THEN size END) OVER w >= {c.NOTABLE_SIZE_RATIO} * max(CASE WHEN r1 = 1 THEN size END) OVER w AS famous FROM r2 WINDOW w AS (PARTITION BY name)),
 idx AS MATERIALIZED (SELECT name, (CASE WHEN famous THEN r2 ELSE r1 END)::INTEGER AS rnk, doc_id, size, main, prov, page, famous FROM fam WHERE CASE WHEN famous THEN r2 ELSE r1 END <= {c.NAMES_KEPT})"""
_ASKED = f"""pq AS (SELECT p_partkey AS qid, CASE WHEN p_partkey % 30 = 0 THEN p_name || ' and ' || lower(p_type) WHEN p_partkey % 4 = 0 THEN 'who created the ' || p_name WHEN p_partkey % 4 = 2 THEN 'tell me about ' || split_part(p_name, ' ', 1)
   ELSE p_name || ' zyxtha' END AS question FROM part WHERE p_partkey % 10 = 0),
 asked AS (SELECT qid, {Q.query_key("question")} AS key FROM pq)"""
_MATCH = """names AS (SELECT DISTINCT name FROM idx), vocab AS (SELECT list(DISTINCT t) AS v FROM (SELECT unnest(name) AS t FROM names)),
 tiers AS (SELECT qid, key, name, CASE WHEN key = name THEN 2 WHEN list_has_all(key, name) THEN 1 WHEN list_has_all(name, key) AND len(name) - len(key) <= 1 THEN 0 END AS tier FROM asked JOIN names ON list_has_any(key, name)),
 hits AS MATERIALIZED (SELECT qid, name, tier FROM tiers, vocab WHERE tier IS NOT NULL AND (tier <> 1 OR len(list_filter(key, lambda t: NOT list_contains(name, t) AND NOT list_contains(v, t))) = 0)),
 ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier <> 1 DESC, main OR famous DESC, prov > 0 DESC, size DESC, tier DESC, doc_id) AS place FROM hits JOIN idx USING (name))"""
_RESOLVE = "best AS (SELECT qid, doc_id, array_to_string(name, ' ') AS name FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS r FROM ranked WHERE rnk = 1 AND (tier <> 0 OR prov = 2)) WHERE r = 1)"
_CONF = """perdoc AS (SELECT qid, doc_id, min(place) AS place, arg_min(size, place) AS size, arg_min(prov, place) AS prov FROM ranked GROUP BY ALL),
 peers AS (SELECT * FROM (SELECT *, arg_min(prov, place) OVER (PARTITION BY qid) AS lead_prov FROM perdoc) WHERE lead_prov <> 2 OR prov = 2),
 two AS (SELECT qid, size, row_number() OVER (PARTITION BY qid ORDER BY place) AS r FROM peers),
 conf AS (SELECT pq.qid, CASE WHEN max(CASE WHEN r = 2 THEN size END) > 0 THEN max(CASE WHEN r = 1 THEN size END) / max(CASE WHEN r = 2 THEN size END) ELSE 'Infinity'::DOUBLE END AS confidence FROM pq LEFT JOIN two USING (qid) GROUP BY pq.qid)"""
_RANKED_DOCS = f"""{search_plans._QUESTIONS}, {search_plans._BM25}, r AS (SELECT qid, doc_id, round(score, 6) AS score FROM scores),
 top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rnk FROM r) WHERE rnk <= 24)"""
_CANDIDATES = f"""{_RANKED_DOCS}, ex AS (SELECT qid, doc_id, score, {Q.headline("text")} AS headline, {Q.headline("text")} || '|' || source AS identity, len(string_split(text, chr(10))) - 1 AS field_count, length(text) AS size FROM top JOIN documents USING (doc_id)),
 o AS (SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY qid, identity ORDER BY score DESC, doc_id) AS i FROM ex) WHERE i = 1),
 pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM o) WHERE r <= 8),
 ld AS (SELECT *, max(score) OVER (PARTITION BY qid) AS ts, max(CASE WHEN r = 1 THEN headline END) OVER (PARTITION BY qid) AS head FROM pl),
 ti AS (SELECT *, headline = head AND ts > 0 AND (ts - score) / abs(ts) < {c.FLAGSHIP_MARGIN} AS tied FROM ld),
 pr AS (SELECT *, tied AND row_number() OVER (PARTITION BY qid ORDER BY tied DESC, field_count DESC, size DESC, r) = 1 AS promoted FROM ti),
 cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY promoted DESC, r)::INTEGER AS place FROM pr)"""
_RECORDS = """rec AS (SELECT c_custkey AS doc_id, c_name, CASE WHEN c_custkey % 3 > 0 THEN n_name || '; ' || r_name ELSE '' END AS created, lower(c_mktsegment) AS seg, lower(r_name) AS reg
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

ORACLES = {
    "name_index_top8": f"WITH {_INDEX} SELECT array_to_string(name, ' ') AS name, rnk, doc_id, size, main, prov, page, famous FROM idx",
    "legacy_top24": f"WITH {_CLAIMS} SELECT array_to_string(name, ' ') AS name, rnk, doc_id, prov FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY size DESC, doc_id DESC, prov DESC)::INTEGER AS rnk FROM claims WHERE prov < 2) WHERE rnk <= {c.LEGACY_KEPT}",
    "name_rivals": f"WITH {_INDEX} SELECT array_to_string(name, ' ') AS name, count(*) AS rivals FROM idx GROUP BY ALL",
    "resolve_batch": f"WITH {_INDEX}, {_ASKED}, {_MATCH}, {_RESOLVE} SELECT * FROM best",
    "resolve_confidence": f"WITH {_INDEX}, {_ASKED}, {_MATCH}, {_CONF} SELECT qid, round(confidence, 9) AS confidence, confidence < {c.CONFIDENCE_TO_ASK} AS ask FROM conf",
    "variants_of_name": f"""WITH {_ASKED}, recs AS (SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN p_name || ' (Earth-' || p_size || ')' ELSE p_name END AS headline, floor(p_retailprice)::BIGINT AS size, {Q.norm("p_name")} AS key FROM part),
 m AS (SELECT qid, headline, size, doc_id, count(*) OVER (PARTITION BY qid) AS n_variants FROM asked JOIN recs USING (key)),
 o AS (SELECT qid, headline, max(struct_pack(s := size, h := headline, d := doc_id)) AS b, any_value(n_variants) AS n_variants FROM m GROUP BY ALL)
 SELECT qid, n_variants, rnk, headline FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY b DESC)::INTEGER AS rnk FROM o) WHERE rnk <= 12""",
    "candidates_identity": f"WITH {_CANDIDATES} SELECT qid, place, doc_id, score FROM cand",
    "ambiguity_flags": f"""WITH {_CANDIDATES}, two AS (SELECT qid, max(CASE WHEN place = 1 THEN score END) AS s1, max(CASE WHEN place = 2 THEN score END) AS s2 FROM cand GROUP BY qid)
 SELECT qid, doc_id, CASE WHEN s2 IS NULL THEN false WHEN s1 <= 0 THEN true ELSE (s1 - s2) / abs(s1) < {c.AMBIGUITY_MARGIN} END AS ambiguous FROM cand JOIN two USING (qid) WHERE place = 1""",
    "context_blocks": f"""WITH {_RANKED_DOCS}, b AS (SELECT qid, rnk, text, sum(length(text)) OVER (PARTITION BY qid ORDER BY rnk) AS upto FROM top JOIN documents USING (doc_id) WHERE rnk <= 6)
 SELECT qid, count(*) AS n_blocks, length(string_agg(text, chr(10) || chr(10) ORDER BY rnk)) AS n_chars, md5(string_agg(text, chr(10) || chr(10) ORDER BY rnk)) AS context_md5 FROM b WHERE upto <= {c.CONTEXT_CHARS} OR rnk = 1 GROUP BY qid""",
    "passage_select": rf"""WITH {_RANKED_DOCS}, k AS (SELECT qid || '-' || rnk AS id, text, list_distinct({Q.query_key("question")}) AS terms FROM top JOIN documents USING (doc_id) JOIN questions USING (qid) WHERE rnk <= 3),
 ss AS (SELECT id, terms, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), ';\s+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= {c.MIN_SENTENCE_CHARS} AND NOT regexp_matches(x, '{A.BOILERPLATE}')) AS s FROM k),
 se AS (SELECT id, terms, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM ss),
 hi AS (SELECT id, i, x, unnest(list_filter(terms, lambda t: list_contains({Q.norm("x")}, t))) AS t FROM se),
 sc AS (SELECT id, i, any_value(x) AS x, round(sum(w), 9) AS score FROM hi JOIN (SELECT id, t, 1 / count(*) AS w FROM hi GROUP BY ALL) USING (id, t) GROUP BY id, i),
 rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, i) AS r, max(score) OVER (PARTITION BY id) AS best FROM sc)
 SELECT id AS qid, md5(string_agg(x, ' ' ORDER BY i)) AS passage_md5 FROM rk WHERE r <= {A.PASSAGE_SENTENCES} AND score >= {A.PASSAGE_FLOOR} * best GROUP BY id""",
    "profile_rows": f"""WITH {_RECORDS}, f AS (SELECT doc_id, 1 AS o, 'Powers' AS label, seg || '; ' || reg AS value FROM rec UNION ALL SELECT doc_id, 2, 'Created by', created FROM rec WHERE created <> '' UNION ALL SELECT doc_id, 4, 'Occupation', seg FROM rec)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o)::INTEGER AS place, label, value FROM f""",
    "field_answers": f"""WITH {_RECORDS} SELECT doc_id AS qid, CASE doc_id % 3 WHEN 0 THEN 'creator' WHEN 1 THEN 'powers' ELSE 'occupation' END AS intent,
 CASE doc_id % 3 WHEN 0 THEN 'I don''t have ' || c_name || '''s created by in my sources.' WHEN 1 THEN c_name || '''s powers include ' || seg || ' and ' || reg || '.' ELSE c_name || ' works as ' || seg || '.' END AS answer FROM rec""",
    "humanize_lists": """SELECT n_regionkey, CASE WHEN len(v) = 1 THEN v[1] ELSE array_to_string(v[:-2], ', ') || ' and ' || v[-1] END AS reads
 FROM (SELECT n_regionkey, list(n_name ORDER BY n_name) AS v FROM nation WHERE n_nationkey % 5 <> 0 OR n_regionkey = 0 GROUP BY 1)""",
    "image_chain": "SELECT o_orderkey, coalesce(a.p_name, b.p_name, '') AS file FROM orders LEFT JOIN part a ON a.p_partkey = o_orderkey LEFT JOIN part b ON b.p_partkey = o_custkey",
    "category_walk": """WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 7 + 2) % 25 FROM nation),
 w(node, depth) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT e.b::BIGINT, depth + 1 FROM w JOIN e ON e.a = w.node WHERE depth < 3) SELECT node, min(depth)::INTEGER AS depth FROM w GROUP BY node""",
    "eval_rollup": f"""WITH {_INDEX}, {_ASKED}, {_MATCH}, {_RESOLVE} SELECT kind, count(*) AS n, round(avg(hit), 9) AS rate FROM (SELECT CASE WHEN starts_with(question, 'who') THEN 'who' WHEN starts_with(question, 'tell') THEN 'tell' ELSE 'other' END AS kind,
 (best.doc_id IS NOT NULL)::INTEGER AS hit FROM pq LEFT JOIN best USING (qid)) GROUP BY ROLLUP (kind)""",
    "threshold_sweep": f"WITH {_INDEX}, {_ASKED}, {_MATCH}, {_CONF} SELECT m::DOUBLE AS threshold, round(avg((confidence < m)::INTEGER), 9) AS rate FROM conf, (SELECT unnest([1.5, 2.0, 3.0, 5.0, 8.0]) AS m) GROUP BY m",
}
